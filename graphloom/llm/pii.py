"""Operator 6, personal data: patterns propose spans, checksums confirm them, context words move the score.

The base kinds (email, ip, card, phone) always stay; their score tells how sure the span is. The method adds ``iban``
spans (mod 97; of several possible ends the furthest that passes) and ``card_like`` numbers, which fail Luhn but stand
beside words that announce a card; these stay from a score of KEEP on. All patterns run
in linear time: an address is grown from its ``@`` to both sides, digit runs are entered at their start only.

Defined results: null and empty text have no spans; a base candidate that fails its check is dropped without a retry;
spans of different kinds may overlap; ties in start are ordered by kind as listed; a text is scanned whole however long
it is; repeated rows are scanned like any other; an empty table gives no rows. Extra columns are kept by
:func:`with_spans` and :func:`masked`; a column that has the new one's name already is kept too, the new one then gets
underscores at its end. A text is one string in a worker; scores are whole hundredths.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.llm.common import fresh, table

KINDS = ("email", "ip", "card", "phone", "iban", "card_like")
BASE = KINDS[:4]
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
#: Words near a span that speak for its kind, and words that speak against any kind.
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|contact|write|reach|address)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login|client)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|credit|debit|payment)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|contact)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|transfer|bic|swift)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:example|sample|version|serial|isbn|order no)\b")
#: Scores in hundredths: of a kind, for a word that speaks for it, for one that speaks against, and the least to stay.
SCORE = {"email": 70, "ip": 60, "card": 70, "phone": 60, "iban": 70, "card_like": 30}
FOR, CONTRARY, KEEP = 25, 20, 50
#: Characters on either side where words count.
NEAR = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def ibans(text: str):
    """Account numbers that pass mod 97. White space may part or follow one, so a run of groups is tried from its longest end at a word's end down."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 4
        for end in range(m.end(), m.start() + 14, -1):
            if text[end - 1] != " " and not (text[end : end + 1].isascii() and text[end : end + 1].isalnum()):
                bare = text[m.start() : end].replace(" ", "")
                if 15 <= len(bare) <= 34 and mod97(bare):
                    yield m.start(), end
                    at = end
                    break


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's score, moved by words within NEAR characters."""
    around = text[max(0, start - NEAR) : start] + " \x00 " + text[end : end + NEAR]
    said = CONTEXT["card" if kind == "card_like" else kind].search(around)
    return min(100, max(0, SCORE[kind] + FOR * bool(said) - CONTRARY * bool(AGAINST.search(around)))) / 100


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans as (kind, start, end, score) by start, then kind as listed."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += ((s, 0, e) for s, e in emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                found.append((m.start(), 2 if luhn(digits) else 5, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    found += ((s, 4, e) for s, e in ibans(text))
    scored = ((KINDS[k], s, e, score(text, KINDS[k], s, e)) for s, k, e in sorted(found))
    return [x for x in scored if x[0] in BASE or x[3] * 100 >= KEEP]


def with_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """docs and its spans as an array of (kind, start, end, score); places count code points, end is exclusive."""

    def scan(batch: pa.Array) -> pa.Array:
        rows = [[dict(zip(("kind", "start", "end", "score"), x)) for x in spans_of(t.as_py())] for t in batch]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))

    scan.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return docs.withColumn(fresh(docs, out), F.arrow_udf(scan, SPANS)(F.col(text)))


def mask(text: str | None) -> str | None:
    """text with each run of overlapping spans replaced by the kind of its first."""
    spans = spans_of(text)
    if not spans:
        return text
    out, at, held = [], 0, None
    for kind, s, e, _ in spans:
        if s >= at or held is None:
            out += [text[at:s], f"[{kind.upper()}]"]
        at, held = max(at, e) if held is not None and s < at else e, kind
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in text replaced by ``[KIND]``; columns as they were."""

    def run(batch: pa.Array) -> pa.Array:
        return pa.array([mask(t.as_py()) for t in batch], pa.string())

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return docs.withColumn(text, F.arrow_udf(run, "string")(F.col(text)))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the scores of all spans in the order of ``spans``."""
    docs = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "found").select("doc_id", "found")
    scores = F.concat_ws(",", F.transform("found", lambda s: F.format_number(s["score"], 2)))
    counts = [F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return docs.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), scores.alias("scores"))
