"""Phrases, lexical search and shards against brute force, on fixtures with nulls, empties, ties, repeats and odd columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cinderpatch.llm import collocations, kd_shards, lexical_search, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, size int, shard int, slot int, place string, mark int, node int, cut int"


def documents(spark, rows):
    """(id, text, lang, source) with extra columns that have the names that the operators use inside."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", 1, 2, 3, "p", 4, 5, 6) for r in rows], SCHEMA)


def varied():
    texts = [None, "", " \n", "é😀 ß", *(f"text {i} " * (i % 40 + 1) for i in range(300)), "long " * 2_000]
    rows = [(i, t, None if i % 11 == 0 else "ab"[i % 2], f"s{i % 5 if i % 3 else 0}") for i, t in enumerate(texts)]
    copies = [(1_000 + i, "a copy of some text", "ab"[i % 2], f"s{i % 4}") for i in range(40)]
    return [*rows, *copies, (None, "no id", "a", "s1"), (7, rows[7][1], "b", "s2"), (7, rows[7][1], "b", "s2")]


def size(text):
    return len((text or "").encode()) + 1


def shards_of(spark, rows, **how):
    frame = documents(spark, rows)
    return [(r["key"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in kd_shards.shard_documents(frame.repartition(3, "n_chars"), **how).collect()]


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards_are_whole_even_and_gapless(spark, n):
    rows = varied()
    got = shards_of(spark, rows, shards=n)
    assert sorted(map(repr, ((k, s, c) for k, s, c, _, _ in got))) == sorted(repr((i, size(t), zlib.crc32((t or "").encode()))) for i, t, _, _ in rows)
    weight, places = defaultdict(int), defaultdict(list)
    for _, s, _, shard, slot in got:
        weight[shard] += s
        places[shard].append(slot)
    assert set(weight) == set(range(n)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(size(t) for _, t, _, _ in rows)
    assert max(weight.values()) - min(weight.values()) <= largest + 2 * sum(weight.values()) * kd_shards.GROUP_SLACK
    assert len({shard for _, _, c, shard, _ in got if c == zlib.crc32(b"a copy of some text")}) == 1


def scalar_tree(points, shards, first=0):
    """Brute force: points are (codes, text hash, weight); exact weighted medians along the widest dimension."""
    if shards == 1:
        return {p[1]: first for p in points}
    spread = [(max(p[0][d] for p in points) - min(p[0][d] for p in points)) / WIDTH[d] for d in range(3)]
    dim, half = spread.index(max(spread)), shards // 2
    points = sorted(points, key=lambda p: (p[0][dim], p[1]))
    goal, upto = sum(p[2] for p in points) * half / shards, 0
    for at, p in enumerate(points):  # noqa: B007
        if upto + p[2] >= goal:
            break
        upto += p[2]
    at += not goal - upto < upto + p[2] - goal
    return scalar_tree(points[:at], half, first) | scalar_tree(points[at:], shards - half, first + half)


def test_shards_equal_a_plain_tree(spark, monkeypatch):
    """With no slack the cuts are the exact weighted medians of the groups of equal texts."""
    monkeypatch.setattr(kd_shards, "SLACK", 0.0)
    monkeypatch.setattr(kd_shards, "GROUP_SLACK", 1.0)
    frame = documents(spark, varied())
    codes = [kd_shards._code(frame, d) for d in kd_shards.DIMENSIONS]
    hashed = frame.select(*codes, kd_shards._text_hash("text"), kd_shards.size_of(frame["text"]), "text").collect()
    points, crc = {}, {}
    for *code, mark, weight, text in hashed:
        old, w = points.get(mark, (code, 0))
        points[mark], crc[zlib.crc32((text or "").encode())] = ([*map(min, old, code)], w + weight), mark
    points = [(c, m, w) for m, (c, w) in points.items()]
    global WIDTH
    WIDTH = [max(1, max(p[0][d] for p in points) - min(p[0][d] for p in points)) for d in range(3)]
    told = scalar_tree(points, 6)
    assert all(shard == told[crc[c]] for _, _, c, shard, _ in shards_of(spark, varied(), shards=6))


def test_dimensions_keep_their_order_and_nulls_lie_below(spark):
    frame = spark.createDataFrame([(1, -5, "b"), (2, None, None), (3, 7, "b"), (4, 2**62, "a"), (5, -(2**62), "a")], "id int, n bigint, s string")
    rows = frame.select("id", kd_shards._code(frame, "n").alias("n"), kd_shards._code(frame, "s").alias("s")).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["n"])] == [2, 5, 1, 3, 4]
    by_id = {r["id"]: r["s"] for r in rows}
    assert by_id[1] == by_id[3] != by_id[4] == by_id[5] and by_id[2] < min(by_id[1], by_id[4])


def test_a_hot_text_is_cut_where_it_must_be(spark):
    rows = [(i, "the same text again", "a", "s") for i in range(200)] + [(1_000 + i, f"other {i:04d} text here", "a", "s") for i in range(200)]
    weight = defaultdict(int)
    for _, s, _, shard, _ in shards_of(spark, rows, shards=8):
        weight[shard] += s
    assert len(weight) == 8 and max(weight.values()) - min(weight.values()) <= 2 * 20 + 8 * 20


def test_shards_by_target_bytes_and_rows_with_texts(spark):
    rows = varied()
    total = sum(size(t) for _, t, _, _ in rows)
    assert len({r[3] for r in shards_of(spark, rows, target_bytes=total // 5)}) == 6 - (total % 5 == 0)
    frame = documents(spark, rows)
    at = kd_shards.groups(frame)
    points = kd_shards.saved(kd_shards._placed(frame, at, "place_", "doc_id", "text").select(kd_shards.F.col("place_").alias("place"), kd_shards.size_of(frame["text"]).alias("size")))
    tree = kd_shards.fit(points, 4)
    whole = kd_shards.locate(frame, at, tree, shard="in_shard")
    assert whole.columns == [*frame.columns, "in_shard"] and whole.count() == len(rows)
    assert {r[0] for r in whole.select("in_shard").distinct().collect()} == {0, 1, 2, 3}


def test_shards_of_the_registered_query(spark):
    got = queries.op13_kd_shards(spark, "/root/testdata/sf0.001").toPandas()
    weights = got.groupby("shard")["size"].sum()
    assert list(weights.index) == list(range(8)) and weights.max() - weights.min() <= got["size"].max()
    assert (got["law"] == "bytes").all() and got["grown_shard"].isna().all()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(rows, items, k):
    """All items against all documents, by the formula."""
    held = [(i, plain_terms(t)) for i, t, *_ in rows]
    held = [(i, Counter(w), len(w)) for i, w in held if w]
    n, all_terms, df = len(held), sum(x[2] for x in held), Counter(t for x in held for t in x[1])
    found = []
    for item, text in items:
        scores = []
        for key, tf, size in held:
            m = 100 - 25 + (25 * size * n) // all_terms
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in plain_terms(text) if t in tf)
            if score > 0 and key is not None:
                scores.append((-score, key))
        found += [(item, r + 1, key, -score) for r, (score, key) in enumerate(sorted(scores)[:k])]
    return sorted(found)


def searched():
    rng, words = random.Random(5), [f"w{i}" for i in range(60)] + ["É", "ñandú", "日本", "x9"]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.choice([1, 3, 20, 90]))), "a", "s") for i in range(400)]
    passage = "w50 w51 É-w52 W53, ñandú_w54"
    rows += [(1_000 + i, passage if i % 2 else passage.upper() + " W1", "a", "s") for i in range(60)]
    rows += [(2_000, None, "a", "s"), (2_001, "", "a", "s"), (2_002, " --- ", "a", "s"), (None, passage, "a", "s"), (3, rows[3][1], "a", "s"), (2_003, "w50 " * 3_000, "a", "s")]
    items = [(1, passage), (2, "w0 w0 w1"), (3, None), (4, "..."), (5, "unseen words"), (6, rows[5][1]), (6, "w3 w9 w27"), (None, "日本 x9")]
    return rows, items


@pytest.mark.parametrize(("block", "values"), [(2_048, 1 << 18), (3, 40)])
def test_search_equals_the_formula(spark, monkeypatch, block, values):
    """In one block with one bucket, and in blocks with many small buckets that most items skip."""
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", block)
    monkeypatch.setattr(lexical_search, "BUCKET_VALUES", values)
    rows, items = searched()
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in lexical_search.top_k(documents(spark, rows), asked, k=5).collect()]
    key = lambda x: (x[0] is None, *x)
    want = [x for item in items for x in plain_search(rows, [item], 5)]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sorted(got, key=lambda x: key((x[0] or 0, *x[1:])))


def test_search_bounds_hold_and_prune():
    """No vector that can reach a bar is left out, and most others are."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    weights, n = rng.integers(1, 9_000, 300), 500
    sets = [np.sort(rng.choice(300, rng.integers(1, 60), replace=False)).astype(np.int32) for _ in range(n)]
    values = [rng.integers(1, 900_000, len(s)).astype(np.int32) for s in sets]
    length = np.array([math.sqrt(sum(weights[s] * v.astype(float) ** 2)) for s, v in zip(sets, values, strict=True)])
    falling = np.argsort(-length)
    part = pa.table({"key": falling, "length": length[falling], "terms": pa.array([sets[i] for i in falling], pa.list_(pa.int32())), "impacts": pa.array([values[i] for i in falling], pa.list_(pa.int32()))})
    bucket = lexical_search.Bucket(part.combine_chunks().to_batches()[0], 300)
    asked = [Counter({int(t): int(c) for t, c in zip(rng.choice(300, 25, replace=False), rng.integers(1, 4, 25), strict=True)}) for _ in range(20)]
    items = lexical_search.Items.weighed(asked, weights)
    rests = items.lengths()
    work, left = np.zeros(300, dtype=np.int64), 0
    for i, counts in enumerate(asked):
        exact = np.array([sum(counts[int(t)] * int(weights[t]) * int(v) for t, v in zip(sets[r], values[r], strict=True)) for r in falling])
        assert (bucket.scores(items, i, np.arange(n), work) == exact).all() and not work.any()
        assert (exact <= rests[i][0] * length[falling]).all()
        bar = int(np.sort(exact)[-10])
        rows = bucket.survivors(items, i, bar, rests[i])
        assert set(np.flatnonzero(exact >= bar)) <= set(rows)
        left += len(rows)
    assert left < 0.5 * n * len(asked)


def plain_mining(rows, least, top):
    """Every phrase of every piece, then the rules one after another."""
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            counts[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        told = []
        for p, a in found.items():
            score, cut = min((2_000_000 * a // (f[p[:c]] + f[p[c:]]), c) for c in range(1, len(p)))
            inside = any(100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p))
            if not inside:
                told.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, r, p.decode(), -a, l, x, totals[lang], -s) for r, (s, a, p, l, x) in enumerate(sorted(told)[:top], 1)]
    return sorted(out)


def phrased():
    rng, words = random.Random(7), ["the", "of", "Red", "fox", "jumps", "é", "日本", "a-b", "x\u00a0y", "#", "|"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\x1c "]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["new york city hall. " * 9, "in the hot pair, " * 40, "hot pair w1 hot pair w2 hot pair w3 " * 12, "one long piece without any end " * 80]
    rows = [(i, t, [None, "und", "en", "de"][i % 4], "s") for i, t in enumerate(texts)]
    return [*rows, (900, None, "en", "s"), (901, "", "fr", "s"), (902, " .\t\n", "it", "s"), (0, texts[0], None, "s"), (None, texts[5], "en", "s")]


@pytest.mark.parametrize(("entries", "burst", "chunk", "words", "hot", "parts"), [(3 << 17, 1 << 12, 1 << 20, 120_000, 16, 4), (40, 3, 50, 30, 1, 4), (40, 3, 50, 30, 8, 400)])
def test_phrases_equal_plain_counts(spark, monkeypatch, entries, burst, chunk, words, hot, parts):
    """In one go, and with bursts, spills, new tries, cut texts and hot prefixes all over."""
    for name, value in (("ENTRIES", entries), ("BURST", burst), ("CHUNK", chunk), ("WORDS", words), ("HOT_COUNT", hot), ("HOT_PARTS", parts)):
        monkeypatch.setattr(collocations, name, value)
    rows = phrased()
    given = documents(spark, rows).selectExpr("coalesce(lang, 'und') as lang", "text")
    assert (len(collocations._hot(given, 1, 8)) > 20) == (parts == 400)
    for top in (2_000, 3):
        if parts == 400:  # buckets of buckets
            monkeypatch.setattr(collocations, "WAYS", 3)
            monkeypatch.setattr(collocations, "GATHERED", 500)
        got = sorted(tuple(r) for r in collocations.mine(documents(spark, rows).repartition(3), least=5, top=top).collect())
        assert got == plain_mining(rows, 5, top) and len(got) >= 9


def test_trie_bursts_and_spills_largest_subtrees():
    trie, pieces = collocations.Trie(), [f"a b{i} c" for i in range(6_000)] + ["x y z"] * 50
    trie.add(collocations.windows("\n".join(pieces).encode(), 0, trie.words))
    names = trie.words.names
    assert type(trie.roots[names.index(b"a")]) is dict and type(trie.roots[names.index(b"x")]) is defaultdict
    before = trie.entries
    w, n = trie.spill(before // 2 + 1)
    assert set(w[0]) == {names.index(b"a")} and trie.entries == before - len(n) <= before // 2 + 1
    w, n = trie.spill(0)
    at = [names.index(x) for x in (b"x", b"y", b"z")]
    assert trie.entries == 0 and n[(w == np.array([[*at, 0]]).T).all(axis=0)].tolist() == [50]


def test_scores_are_exact_beyond_64_bits(spark):
    a = 5 * 10**12
    wide = lambda c: f"cast({c} as decimal(20, 0))"
    got = spark.sql(f"select 2000000 * {wide(a)} div ({wide(a + 1)} + {wide(a + 3)})").first()[0]
    assert got == 2_000_000 * a // (2 * a + 4)
