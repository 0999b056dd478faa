"""Operator 3, best-fit packing of documents into sequences, planned on the histogram of lengths.

A plan needs only how many pieces have each length, at most ``capacity`` numbers however large the corpus is. Pieces
above a third of the capacity are matched greedily, the longest with the longest that still fits, at most two a bin;
the others go, longest first, into the smallest gap that holds them, and a new bin is opened only where no gap does.
Bins that look alike are planned together as one group with a count, so the plan is small. Every piece then finds its
place by its rank among the pieces of its length, and ranks come from counts per partition, not from a global sort.

Defined results: null and empty texts are one piece with the end token alone; only documents longer than the capacity
are cut; equal lengths are ranked by partition and place; repeated rows are packed like any other; an empty table gives
no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from graphloom.llm.common import pinned, spread, table

END = 1
#: Token ids of at most so many distinct words are remembered by a worker.
REMEMBER = 700_000
_LOADED: dict[str, Words] = {}


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Words:
    """Ids of words by a tokenizer file, with a memory of the words met.

    Nearly all cost of a word is the pipeline around its merges. For words of printable ASCII and Latin-1 letters that
    pipeline is lower case, the file's own split pattern and byte names, so they are split here and only their pieces go
    to the model; other words, and files whose steps differ, go through the whole tokenizer.
    """

    _PLAIN = regex.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.names = Tokenizer.from_file(path), {}, byte_names()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [a["content"].lower() for a in made["added_tokens"]]
        steps = [(made[k] or {}).get(f"{k.replace('_', '')}s", []) for k in ("normalizer", "pre_tokenizer")]
        split = steps[1][0] if steps[1] else {}
        plain = [[x["type"] for x in s] for s in steps] == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and made["model"]["type"] == "BPE"
        plain = plain and (split["behavior"], split["invert"], steps[1][1]["add_prefix_space"], steps[1][1]["use_regex"]) == ("Removed", True, False, False)
        self.split = regex.compile(split["pattern"]["Regex"]) if plain else None

    def learn(self, words: list[str]) -> None:
        other = []
        for w in words:
            low = w.lower()
            if self.split is None or not self._PLAIN.fullmatch(w) or any(s in low for s in self.special):
                other.append(w)
                continue
            found = []
            for piece in self.split.findall(low):
                ids = self.known.get(piece)
                if ids is None:
                    named = piece if piece.isascii() else "".join(map(self.names.__getitem__, piece.encode()))
                    tokens = self.model.tokenize(named)
                    ids = self.known[piece] = struct.pack(f"<{len(tokens)}I", *(t.id for t in tokens))
                found.append(ids)
            self.known[w] = b"".join(found)
        encoded = self.tokenizer.encode_batch(other, add_special_tokens=False) if other else []
        self.known |= {w: struct.pack(f"<{len(e.ids)}I", *e.ids) for w, e in zip(other, encoded)}


def ids_of(text: str, path: str) -> bytes:
    """Little-endian 32-bit ids. The tokenizer drops white space and never joins over it, so words are encoded on their own; ASCII blanks alone are split at, as any other white space is left to the tokenizer."""
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    memory = _LOADED[path]
    words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    missing = [w for w in set(words) if w not in memory.known]
    if missing:
        if len(memory.known) + len(missing) > REMEMBER:
            memory.known.clear()
            missing = list(set(words))
        memory.learn(missing)
    return b"".join(map(memory.known.__getitem__, words))


def pieces(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))}
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(t.as_py() or "", path) + END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (d, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else []))
                    for c, v in zip(out, row):
                        out[c].append(v)
            types = {"doc_id": batch.schema.field(0).type, "piece": pa.int32(), "ids": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in out.items()], names=list(out))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """counts of lengths -> rows (length, first rank, how many, first sequence, offset).

    A group stands for ``n`` like bins and lists its slots (length, first rank, offset); using part of a group splits it.
    """
    left, used = dict(counts), dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, list]]] = {}
    open_gaps: list[int] = []

    def put(gap: int, n: int, slots: list) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(open_gaps, gap)
        gaps[gap].append((n, slots))

    def take(length: int, n: int) -> int:
        first = used[length]
        used[length] += n
        left[length] -= n
        return first

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    small = sorted((x for x in left if 3 * x <= capacity), reverse=True)
    ascending = large[::-1]
    for x in large:
        while left[x]:
            k = bisect_left(ascending, capacity - x + 1) - 1
            while k >= 0 and (ascending[k] > x or left[ascending[k]] < 1 + (ascending[k] == x)):
                k -= 1
            if k < 0:
                n = left[x]
                put(capacity - x, n, [(x, take(x, n), 0)])
                break
            y = ascending[k]
            n = left[x] // 2 if x == y else min(left[x], left[y])
            a = take(x, n)
            put(capacity - x - y, n, [(x, a, 0), (y, take(y, n), x)])
    for x in small:
        while left[x]:
            k = bisect_left(open_gaps, x)
            if k == len(open_gaps):
                q = capacity // x
                n = max(1, left[x] // q)
                m = min(q, left[x])
                put(capacity - m * x, n, [(x, take(x, n), i * x) for i in range(m)])
                continue
            gap = open_gaps[k]
            have, slots = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[k]
            n = min(have, left[x])
            if have > n:
                put(gap, have - n, [(s, r + n, o) for s, r, o in slots])
            put(gap - x, n, [*slots, (x, take(x, n), capacity - gap)])
    rows, sequence = [], 0
    for gap in open_gaps:
        for n, slots in gaps[gap]:
            rows += ((s, r, n, sequence, o) for s, r, o in slots)
            sequence += n
    return rows


def packed(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """cut (with a column length) and each row's sequence_id and offset."""
    cut = pinned(cut)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    rows = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    sent = cut.sparkSession.sparkContext.broadcast(rows)
    part = cut.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    local = part.withColumn("local", F.row_number().over(Window.partitionBy("part", "length").orderBy("row")) - 1)
    sizes = part.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = local.join(spread(base), ["part", "length"]).withColumn("rank", F.col("before") + F.col("local"))

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        r = sent.value
        x, k = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(r[:, 0] << 44 | r[:, 1], x << 44 | k, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(r[at, 3] + k - r[at, 1]), pa.array(r[at, 4])], names=["sequence_id", "offset"])

    place.__annotations__ = {"length": pa.Array, "rank": pa.Array, "return": pa.Array}
    return ranked.withColumn("place", F.arrow_udf(place, "sequence_id long, offset long")("length", "rank")).select(*cut.columns, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece with its ids' checksum, sequence and offset there; with_ids adds the ids."""
    return packed(pieces(docs, path, capacity, id_col, text, with_ids), capacity)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
