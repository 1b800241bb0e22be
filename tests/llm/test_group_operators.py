"""Operators that shuffle, and the pipeline, against brute force."""

import hashlib
import math
import random
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cinderpatch.llm import chat_format, components, hamming_search, jaccard_join, queries

from .test_text_operators import plain_quality, scalar_language

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(repr, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())


def linked(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def near_copies():
    """Families of near copies with a shared passage, exact copies, short texts, nulls."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 200]))] + passage
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [None, "", " \n", "One Two", "one two", "one two three", "ÀB c d", "àb c d", texts[0], texts[0].upper(), "solo " * 50]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("k, percent, group, few", [(4, 85, 256, 16), (5, 80, 4, 0), (3, 60, 2, 1)])
def test_jaccard_join(spark, monkeypatch, k, percent, group, few):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "VISITORS", 3 * group)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "FILTER_BITS", 64 * group)
    monkeypatch.setattr(jaccard_join, "SAMPLE_EVERY", 2)
    texts = near_copies()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()] + [(None, "no id", 1, "x")], "doc_id bigint, text string, n int, digest string")
    got = {r["key"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df, k=k, percent=percent).collect()}
    assert got.pop(None) == (1, None)
    assert got == linked(texts, k, percent)


def test_jaccard_join_without_shared_keys(spark, monkeypatch):
    """With one key of many values hardly any copies meet early: the matrix alone must find every link."""
    monkeypatch.setattr(jaccard_join, "band_keys", lambda tokens: [int(tokens[::7].sum() >> 1)] * jaccard_join.BANDS)
    texts = near_copies()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {r["key"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == linked(texts, 4, 85)


def test_rows_that_repeat_an_id_are_one_node(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, None), (2, b), (3, a), (4, c), (4, c), (5, c)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((r["key"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4)]


def test_keep_one(spark):
    texts = near_copies()
    df = spark.createDataFrame([(i, t, "z", 1, 2) for i, t in texts.items()] + [(0, texts[0], "a", 1, 2), (None, texts[1], "z", 1, 2)], "doc_id bigint, text string, key string, _key int, row int")
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted({c for _, c in linked(texts, 5, 80).values()})
    assert [r["key"] for r in rows if r["doc_id"] == 0] in ([], ["a"]) and [r["text"] for r in rows if r["doc_id"] is None] == [texts[1]]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and parent[a] != parent[b]:
                parent[a] = parent[b] = min(parent[a], parent[b])
                changed = True
    assert got == parent
    assert components.components(df.where("false")).count() == 0


def hamming_brute(vectors, k):
    codes = {i: [x is not None and x > 0 for x in v] for i, v in vectors.items() if v is not None and i is not None}
    out = set()
    for q in codes:
        if q % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(codes[q], codes[i], strict=True)), i) for i in codes if i != q)
            out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("n, block", [(3, 1 << 18), (400, 8), (400, 1 << 18)])
def test_hamming_search(spark, monkeypatch, n, block):
    monkeypatch.setattr(hamming_search, "BLOCK", block)
    monkeypatch.setattr(hamming_search, "PROBES", 4000 if block < 100 else 1 << 20)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64))
    vectors = {i: (centres[i % 6] + rng.normal(size=64) * 0.8).tolist() for i in range(n)}
    vectors |= {n + i: vectors[0] for i in range(n // 2)}  # a hot code
    vectors[n + 1000] = None
    vectors[n + 1001] = [None, float("nan")] + [1.0] * 62
    brute = hamming_brute({i: v if v is None else [None if x is None or x != x else x for x in v] for i, v in vectors.items()}, 10)
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()] + [(None, vectors[0], 0), (0, vectors[0], 0)], "vec_id bigint, embedding array<double>, code int")
    got = hamming_search.top_k(df, F.col("id") % 20 == 0).collect()
    assert len(got) == len(brute) and {(r["query"], r["rank"], r["id"], r["distance"]) for r in got} == brute


def test_rows_into_the_hamming_search_grow_with_the_tables(spark):
    """Twice the codes and queries make twice the visits, as long as the codes are cut alike; more bits in a
    block's name add to them only what they add to the radius."""
    cuts = [hamming_search.Cuts(n) for n in (60_000, 120_000)]
    assert cuts[0].segments == cuts[1].segments and cuts[0].prefix == cuts[1].prefix
    for radius in (1, 3):
        counts = []
        for n, c in zip((60_000, 120_000), cuts, strict=True):
            asked = spark.range(n // 20).select(F.xxhash64("id").alias("code"), F.lit(64).cast("bigint").alias("bound"))
            counts.append(hamming_search.visits(asked, c, radius).count())
        assert counts[1] == 2 * counts[0] <= 2 * 3000 * 4 * 16
    large = hamming_search.Cuts(1 << 30)
    assert len(large.segments) == 3 and large.prefix == 12
    one = spark.range(1).select(F.col("id").alias("code"), F.lit(64).cast("bigint").alias("bound"))
    assert hamming_search.visits(one, large, 2).count() == 3 * (1 + 12 + 66)


def test_chat_round_trip(spark):
    says = ["<|im_end|>", "\\", "\\|", "<\\|", "a<", "|b", "<|turn|>", "", None, "x\ny", "<|nl|>", "<<||>>", "\\\\<|", "é😀"]
    rng = random.Random(6)
    turns, expected = [], {}
    for conv in range(40):
        own = []
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "assistant", "sys\ntem", "<|im_start|>", None])
            text = "".join(x or "" for x in rng.choices(says, k=rng.randint(0, 4))) if rng.random() < 0.9 else None
            own.append((role, text))
            turns.append((conv, turn, role, text, "extra", 1))
        expected[conv] = [(r or "", t or "") for r, t in own]
    turns.append((None, 0, "user", "null id", "extra", 1))
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string, key string, turns int").repartition(3)
    made = chat_format.format_chats(df)
    got = made.select(
        "key", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.learned_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    ).collect()
    assert len(got) == 41
    for r in got:
        if r["key"] is not None:
            assert [(t["role"], t["text"]) for t in r["turns"]] == expected[r["key"]]
            assert r["loss"] == "".join(t for role, t in expected[r["key"]] if role == "assistant")
    merged = made.where("key is null").first()["formatted"]
    assert merged == "<|im_start|>user\nnull id<|im_end|>\n"


def test_chat_merges_and_probe(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b")], "conv_id int, turn int, role string, text string")
    r = chat_format.format_chats(df).first()
    assert r["formatted"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|turn|>b<|turn|>c<|im_end|>\n"
    probe = queries.op6_chat_format(spark, SF).where("conv_id = -1").first()
    says = "<|im_end|><|im_start|>assistant ok"
    assert probe["loss_sha256"] == hashlib.sha256(says.encode()).hexdigest() and probe["n_turns"] == 2
    plan = chat_format.format_chats(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark, tmp_path):
    """Stage by stage over a table with planted cases, each result held against its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("n_chars > 1500 and lang = 'en'").orderBy("doc_id").first()
    copy = clean["text"].replace(" the ", " teh ", 1)
    planted = [(90_001, clean["text"], "en", "s", 1), (90_002, copy, "en", "s", 1), (90_003, None, None, None, None), (90_004, "", "en", "s", 0), (90_005, "word!! " * 80, "en", "s", 1), (90_006, f"{clean['text']} Write to jane.doe@example.org now.", None, "s", 1)]
    table = docs.unionByName(spark.createDataFrame(planted, docs.schema)).withColumn("key", F.lit("k"))
    now, kept = table, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert now.columns == table.columns
            kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert kept["quality"] == {r["doc_id"]: t for r in table.collect() if (t := plain_quality(r["text"])) is not None}
    learned = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{tmp_path}/quality").collect()]
    plain, sure = scalar_language(learned), set()
    for i, text in kept["quality"].items():
        sums, n = plain(text)
        if n and 1 / sum(math.exp((v - max(sums.values())) / math.sqrt(n)) for v in sums.values()) >= 0.5:
            sure.add(i)
    assert set(kept["language"]) == sure
    assert not {90_003, 90_004, 90_005} & set(kept["quality"]) and {90_001, 90_002, 90_006} <= set(kept["quality"])
    assert set(kept["language"]) <= set(kept["quality"]) and len(kept["language"]) >= 0.97 * len(kept["quality"])
    classes = linked(kept["language"], 5, 80)
    assert set(kept["near_duplicates"]) == {c for _, c in classes.values()}
    assert not {90_001, 90_002, 90_006} & set(kept["near_duplicates"])
    assert set(kept["personal_data"]) == set(kept["near_duplicates"])
    assert not any("@example" in t or "@mail" in t for t in kept["personal_data"].values())
    packed = now.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert {r["doc_id"] for r in packed} == set(kept["personal_data"]) and all(r["n"] == r["all"] for r in packed)


def test_pipeline_on_an_empty_table(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0


def test_nothing_else_imports_the_subpackage():
    import subprocess

    out = subprocess.run([sys.executable, "-c", "import sys, cinderpatch, cinderpatch.plans.queries; print([m for m in sys.modules if 'llm' in m])"], capture_output=True, text=True)
    assert out.stdout.strip().endswith("[]")
