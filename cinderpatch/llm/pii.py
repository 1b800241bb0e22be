"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, schemes and identifier cues. At each
anchor a small deterministic parser expands to the left and right, fixes the boundary and validates it
(address parts, Luhn and mod-97 check digits). Text without anchors costs one pass and nothing else.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``: the leftmost non-overlapping matches of their
patterns, of which those that fail validation are dropped. Added kinds: ``login`` (user and password
before the host of an address), ``iban`` and ``ssn`` after their cues. Cues count in any case; the first
number starts within ``WORDS`` words after its cue, whatever their length and the marks between them, each further
one within as many after the last. An account's country tells its length; where the country is unknown, the longest end that validates counts.

Defined results: null text counts as the empty text and has no spans; repeated rows stay repeated; spans of
several kinds may share characters, and those with equal starts stand in the order of ``KINDS``; a very long
text is scanned whole, in time linear in it; an empty table gives an empty result; columns other than the
named ones are ignored by ``find`` and kept by ``redact_documents``.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, map_rows

# Kinds in order, anchors, and the boundaries that the parsers know.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "ssn")
BASE_KINDS = 4
CUES = {"iban": ("iban",), "ssn": ("ssn", "social")}
WORDS = 8
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/@:?#]++:[^\s/@?#]++@(?=[A-Za-z0-9\[])")
SECURITY = re.compile(r"[\s-]++security", re.IGNORECASE)
MARKS, WORD = re.compile(r"[\W_]*+"), re.compile(r"[^\W_]*+")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20\xa0\u202f-]?[A-Za-z0-9]){11,30}")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
FIRST_DIGIT = re.compile(r"[^\W_0-9]*+([0-9])")
GOES_ON = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: Characters of an account by country.
LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

SPANS = "array<struct<start:int,kind:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = int(c) * (1 + at % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban_end(text: str, at: int) -> int | None:
    """End of the account that starts here, if one does."""
    if not (m := IBAN.match(text, at)):
        return None
    places = [i for i in range(at, m.end()) if text[i].isalnum()]
    known = LENGTHS.get(text[at : at + 2].upper())
    for n in (known,) if known else range(len(places), 14, -1):
        if n > len(places):
            continue
        end = places[n - 1] + 1
        if text[end : end + 1] in GOES_ON:
            continue
        account = "".join(text[i] for i in places[:n])
        if (account.isupper() or known and account.islower()) and mod97(account):
            return end
    return None


def ssn_end(text: str, at: int) -> int | None:
    return m.end() if (m := SSN.match(text, at)) else None


def after_cues(text: str, cues: list[int], kind: str) -> list[tuple[int, int]]:
    """(start, end) of the numbers within ``WORDS`` words after the cues that end at these places, in order. The walk
    from a cue stops at the next one, which looks at what follows, so each word is looked at once."""
    out: list[tuple[int, int]] = []
    for n, cue in enumerate(cues, 1):
        at, left, following = cue, WORDS, cues[n] if n < len(cues) else len(text) + 1
        if out and cue <= out[-1][1]:
            continue  # inside a number: the walk that found it has gone on from its end, or stopped at a later cue
        while left:
            start = MARKS.match(text, at).end()
            if start >= min(following, len(text)):
                break
            place = start
            if kind == "ssn" and (d := FIRST_DIGIT.match(text, start, following)):
                place = d.start(1)
            end = ssn_end(text, place) if kind == "ssn" else iban_end(text, place)
            if end:
                out.append((place, end))
                at, left = end, WORDS
                following = cues[i] if (i := bisect_right(cues, end)) < len(cues) else len(text) + 1
                continue
            at, left = WORD.match(text, start, following).end(), left - 1
            if at == following:
                break
    return out


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in sorted(DIGITS):
        found.add_word(c, (1, "digit"))
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(word, (len(word), kind))
    for kind, words in CUES.items():
        for word in words:
            for cased in itertools.product(*({c.lower(), c.upper()} for c in word)):
                found.add_word("".join(cased), (len(word), kind))
    found.make_automaton()
    return found


def spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = 0
    cues: dict[str, list[int]] = {"iban": [], "ssn": []}
    for last, (size, kind) in automaton.iter(text):
        at = last + 1 - size
        if kind == "digit":
            if at and text[at - 1] in DIGITS:
                continue  # the parsers start with the run of digits
            if at >= ip_end and (m := ADDRESS.match(text, at)):
                ip_end = m.end()
                if all(len(p) < 4 and int(p) <= 255 or not p.strip("0") or int(p[-400:]) <= 255 and not p[:-400].strip("0") for p in m[0].split(".")):
                    out.append((at, 1, ip_end))
            if at >= card_end and (m := CARD.match(text, at)):
                card_end = m.end()
                if card_end - at < 40 and 14 <= len(digits := only_digits(m[0])) <= 19 and luhn(digits):
                    out.append((at, 2, card_end))
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL_PART:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out.append((start, 0, email_end))
        elif kind == "plus":
            if (m := PHONE.match(text, at)) and 10 <= len(only_digits(m[0])) <= 15:
                out.append((at, 3, m.end()))
        elif kind == "scheme":
            if m := LOGIN.match(text, last + 1):
                out.append((m.start(), 4, m.end() - 1))
        else:
            after = last + 1
            if size == len("social"):
                if not (m := SECURITY.match(text, after)):
                    continue
                after = m.end()
            cues[kind].append(after)
    for kind, ends in cues.items():
        out += [(start, KINDS.index(kind), end) for start, end in after_cues(text, ends, kind)]
    return sorted(set(out))


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """Overlapping spans become one mark, named after the first."""
    parts, at, open_until = [], 0, -1
    for start, kind, end in found:
        if start >= open_until:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        open_until = at = max(end, open_until)
    return "".join([*parts, text[at:]])


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, and spans (code points, end exclusive; kind is its place in ``KINDS``)."""

    def make() -> Callable:
        automaton = anchors()

        def row(r: dict):
            yield r["key"], [dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans(r["text"] or "", automaton)]

        return row

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    return map_rows(rows, make, f"key bigint, spans {SPANS}", [pa.field("key", pa.int64()), pa.field("spans", SPAN_TYPE)])


def redact_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every span in ``text`` becomes a mark such as ``<EMAIL>``; n_chars follows; no
    document goes. Columns are those of the input."""

    @F.arrow_udf("string")
    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = anchors()
        for texts in batches:
            parts = [
                pa.array([None if t is None else redact(t, spans(t, automaton)) for t in texts.slice(at, SLICE_ROWS).to_pylist()], pa.string())
                for at in range(0, len(texts), SLICE_ROWS)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    names = docs.columns
    out = docs.withColumn("text", cleaned(F.col("text").cast("string")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*names)
