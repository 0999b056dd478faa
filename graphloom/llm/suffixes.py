"""Operator 9, removal of byte strings that start in a document with a smaller id, by a hash-compared suffix sort.

A corpus has too many suffixes to sort at once, so they are brought together first. Each 50-byte string has an anchor,
the 20-byte gram in it with the smallest hash; equal strings have equal anchors. Neighbouring strings with one anchor
make a run. Runs with equal anchor and run hash fall at once, all but those of the smallest document; what fell is joined
to long spans, whose bytes are then compared with those of the spans they repeat. Where an anchor has different runs, the
suffixes from the anchor are sorted by a mergesort whose comparisons take a logarithmic number of steps, as prefix
polynomial hashes and binary search find the common extension. The sorted order is checked on the bytes of neighbours;
strings with equal right part (a stretch of the order) and equal left part are one class, and each is compared byte by
byte with the first of its class before it falls.

Hash collisions cost time, never results: a sort found wrong is done again on bytes, classes likewise, and runs that were
called equal and are not make the whole search start again with another base.

No task holds an unbounded group. Anchors that a sample of the documents shows to be frequent are dealt by run, not by
anchor; a group of more than ``most`` suffixes is cut into finer ones, step by step, by the bytes around the anchor that
half, a quarter, ... of its strings share, down to single strings, whose copies are counted by map-side minima. The
sample decides where rows go and nothing else. Anchors are worked on in slices of the hash space: a pass over the texts
per slice, but a shuffle of a slice only.

Defined results: null and empty text has zero bytes, texts under 50 bytes lose nothing; strings in rows of one id do not
count against each other, whatever their texts; rows with a null id are neither cut nor counted against others; repeated
rows get equal results; an empty table gives no rows. Extra columns are not read. Intermediate tables are deleted at the
end. While the search runs, ``fileCleanup`` is set for the session: finished queries give back their shuffle files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import pinned, removed, shared_dir, spread, table

#: Odd base of the polynomials, and multipliers that mix hashes.
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PLACE = np.uint64((1 << 30) - 1)
#: Bytes of documents that are hashed together at least; longer documents are hashed in overlapping parts of LONG.
CHUNK, LONG = 1 << 18, 1 << 20
#: A group of suffixes is sorted by one task up to so many (under 100 bytes each, and 8 more bytes a byte for hashes).
MOST = 100_000
#: Spans that fell are cut where the span they repeat crosses a multiple of so many bytes, so copies ask for the same ones.
GRID = 2048
#: Keys of groups beyond MOST are broadcast up to so many, else joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: One in so many documents shows which anchors are frequent.
SAMPLE = 64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: A 64-bit number for each byte value, made by the mixer.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for later calls."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[base] = (both[0], both[1])
    up, down = _POWERS[base]
    return up[:n], down[:n]


def base_of(attempt: int) -> int:
    """An odd base per attempt."""
    return BASE * (2 * attempt + 1) % (1 << 64)


class Hashes:
    """Prefix polynomial hashes of a buffer; bits below 64 make them weak, for tests."""

    def __init__(self, data: np.ndarray, base: int = BASE, bits: int = 64) -> None:
        up, self.down = powers(len(data) + 1, base)
        self.mask = None if bits == 64 else np.uint64((1 << bits) - 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * up[:-1], out=self.sums[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each buffer[start:end]."""
        out = (self.sums[end] - self.sums[start]) * self.down[start]
        return out if self.mask is None else mixed(out) & self.mask


def runs_of(data: np.ndarray, ends: np.ndarray, size: int, gram: int, base: int = BASE) -> tuple[np.ndarray, ...] | None:
    """Over documents laid end to end, ends[k] being where document k stops: for each run its document, first and last string, anchor's place, anchor hash and run hash; None if no document has a string."""
    n = len(data)
    if n < size:
        return None
    h = Hashes(data, base)
    at = np.arange(n - gram + 1)
    grams = mixed(h.part(at, at + gram))
    v = (grams & ~PLACE) | at.astype(np.uint64)
    span, width = 1, size - gram + 1
    low = v
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & PLACE).astype(np.int64)
    stop = np.full(len(place), False)
    for k in range(1, size):  # strings that would cross an end
        cross = ends - k
        stop[cross[(cross >= 0) & (cross < len(place))]] = True
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (stop[1:] != stop[:-1])
    new[ends[ends < len(place)]] = True
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(place)]]) - 1
    keep = ~stop[first]
    first, last = first[keep], last[keep]
    if not len(first):
        return None
    anchor = place[first]
    whole = mixed(h.part(first, last + size) + (last - first).astype(np.uint64) * MIX1 + (anchor - first).astype(np.uint64) * MIX2)
    return np.searchsorted(ends, first, side="right"), first, last, anchor, grams[anchor], whole


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 20_000) -> Iterator[dict[str, np.ndarray]]:
    """Stretches of a stream sorted by key that end where a key ends, each of at least so many rows but the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield columns(whole.slice(0, cut))
        held = whole.slice(cut).to_batches()
    if held:
        yield columns(pa.Table.from_batches(held))


def columns(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: (t.column(c).to_numpy() if t.schema.field(c).type != pa.binary() else t.column(c).to_pylist()) for c in t.schema.names}


def starts(*cols: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it."""
    out = np.zeros(len(cols[0]), bool)
    out[:1] = True
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


class Suffixes:
    """Suffixes of a buffer, each with an end, sorted within keys."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, key: np.ndarray, bits: int = 64) -> None:
        self.data, self.at, self.end, self.key, self.h = data, at, end, key, Hashes(data, BASE, bits)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions, by binary search over prefix hashes."""
        a, b = self.at[x], self.at[y]
        most = np.minimum(self.end[x] - a, self.end[y] - b)
        out = np.zeros(len(x), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            to = out + step
            fits = to <= most
            i = np.flatnonzero(fits)
            same = self.h.part(a[i], a[i] + to[i]) == self.h.part(b[i], b[i] + to[i])
            out[i[same]] = to[i[same]]
            step //= 2
        return out

    def less(self, x: np.ndarray, y: np.ndarray, equal: bool) -> np.ndarray:
        """x before y; equal: or level with it."""
        out = self.key[x] < self.key[y]
        i = np.flatnonzero(self.key[x] == self.key[y])
        p, q = x[i], y[i]
        n = self.common(p, q)
        left, right = self.end[p] - self.at[p] - n, self.end[q] - self.at[q] - n
        pad = len(self.data) - 1
        byte = self.data[np.minimum(self.at[p] + n, pad)] < self.data[np.minimum(self.at[q] + n, pad)]
        out[i] = np.where((left > 0) & (right > 0), byte, np.where((left == 0) & (right == 0), equal, left == 0))
        return out

    def sorted(self) -> np.ndarray:
        """Bottom-up mergesort; a merge finds every row's place in the other half by binary search, all rows at once."""
        n = len(self.at)
        order, width = np.arange(n), 1
        while width < n:
            block = np.arange(n) // width
            second = block % 2 == 1
            base = np.where(second, (block - 1) * width, (block + 1) * width)
            lo, hi = np.minimum(base, n), np.minimum(base + width, n)
            start = lo.copy()
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                other, own = order[mid], order[open_]
                before = np.empty(len(open_), bool)
                s = second[open_]
                before[s] = self.less(other[s], own[s], True)
                before[~s] = self.less(other[~s], own[~s], False)
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            place = np.where(second, (block - 1) * width, block * width) + (np.arange(n) - block * width) + (lo - start)
            merged = np.empty(n, order.dtype)
            merged[place] = order
            order, width = merged, width * 2
        return order


    def extensions(self, order: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
        """Common extension of each suffix in order with the one before it, by bytes (-1 across keys), and whether the order is right."""
        x, y = order[:-1], order[1:]
        out, right = np.full(len(x), -1, np.int64), bool((self.key[x] <= self.key[y]).all())
        reach, pad = np.arange(most), len(self.data) - 1
        same = np.flatnonzero(self.key[x] == self.key[y])
        for k in range(0, len(same), 20_000):
            i = same[k : k + 20_000]
            a, b = self.at[x[i]], self.at[y[i]]
            left, other = self.end[x[i]] - a, self.end[y[i]] - b
            equal = self.data[np.minimum(a[:, None] + reach, pad)] == self.data[np.minimum(b[:, None] + reach, pad)]
            n = np.minimum(np.where(equal.all(axis=1), most, (~equal).argmax(axis=1)), np.minimum(left, other))
            out[i] = n
            byte = self.data[np.minimum(a + n, pad)] < self.data[np.minimum(b + n, pad)]
            right &= bool(((n == left) | ((n < other) & byte)).all())
        return out, right

    def checked(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted order and extensions, both right by bytes: an order that a collision spoilt is made again on bytes."""
        order = self.sorted()
        ext, right = self.extensions(order, most)
        if not right:
            raw = self.data.tobytes()
            order = np.array(sorted(range(len(self.at)), key=lambda i: (self.key[i], raw[self.at[i] : self.end[i]])), np.int64)
            ext, _ = self.extensions(order, most)
        return order, ext


def covered_strings(g: dict[str, np.ndarray], size: int, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For contexts g(key, doc, n, off, ctx): pairs (row, string in its run) that also start in a smaller document."""
    ctx = g["ctx"]
    lens = np.array([len(c) for c in ctx], np.int64)
    begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
    data = np.frombuffer(b"".join(ctx), np.uint8)
    anchor = begin + g["off"]
    s = Suffixes(data, anchor, begin + lens, g["key"], bits)
    order, ext = s.checked(size)
    off, n, doc, reach = g["off"][order], g["n"][order], g["doc"][order], np.arange(size)

    def bytes_at(at: np.ndarray) -> np.ndarray:
        return data[at[:, None] + reach]

    for back in range(int(off.max(initial=0)) + 1):  # strings that start so many bytes before the anchor
        i = np.flatnonzero((back <= off) & (off - back < n))
        if len(i) < 2:
            continue
        level = np.concatenate([[0], np.cumsum(ext < size - back)])[i]
        at = anchor[order[i]] - back
        left = s.h.part(at, at + back)
        for by_bytes in (False, True):
            if by_bytes:  # equal hashes of unequal bytes: number the strings themselves
                level, left = np.unique(bytes_at(at), axis=0, return_inverse=True)[1].reshape(-1), np.zeros(len(i), np.uint64)
            by = np.lexsort((doc[i], left, level))
            new = starts(level[by], left[by])
            first = by[np.flatnonzero(new)][np.cumsum(new) - 1]
            hit = doc[i][by] > doc[i][first]
            x, y = by[hit], first[hit]
            if all((bytes_at(at[x[k : k + 20_000]]) == bytes_at(at[y[k : k + 20_000]])).all() for k in range(0, len(x), 20_000)):
                break
        if len(x):
            yield order[i[x]], off[i[x]] - back


def keyed_documents(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, copy, text): copy is a hash of the text where an id has several rows, else 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    twice = pinned(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 and doc is not null").select(F.col("doc").alias("again")))
    if twice.isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("copy"), "text")
    copy = F.when(F.col("again").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")))
    return rows.join(spread(twice), F.col("doc") == F.col("again"), "left").select("doc", copy.alias("copy"), "text")


def scanned(size: int, gram: int, base: int, bits: int, take: Callable) -> Callable:
    """A map over batches of (doc, copy, text): take(rows of runs) where rows are doc, copy, first string, number of strings, anchor's offset, anchor hash, run hash."""
    mask = np.uint64((1 << bits) - 1) if bits < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple[int, int, int, np.ndarray]] = []
        held: list[tuple] = []
        waiting = kept = 0

        def flush() -> int:
            doc, copy, shift = (np.array([t[k] for t in texts], np.int64) for k in (0, 1, 2))
            ends = np.cumsum([len(t[3]) for t in texts])
            found = runs_of(np.concatenate([t[3] for t in texts]), ends, size, gram, base)
            texts.clear()
            if found is None:
                return 0
            k, first, last, anchor, h, r = found
            begin = np.concatenate([[0], ends[:-1]])[k]
            held.append((doc[k], copy[k], first - begin + shift[k], last - first + 1, anchor - first, h.view(np.int64), (r & mask).view(np.int64)))
            return len(k)

        for batch in batches:
            for doc, copy, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = as_bytes(t.as_py())
                for shift in range(0, max(1, len(data) - size + 1), LONG):
                    texts.append((doc, copy, shift, data[shift : shift + LONG + size - 1]))
                    waiting += len(texts[-1][3])
                    if waiting >= CHUNK:
                        kept, waiting = kept + flush(), 0
                    if kept >= 500_000:
                        yield from take(tuple(np.concatenate(c) for c in zip(*held)))
                        held.clear()
                        kept = 0
        if texts:
            flush()
        if held:
            yield from take(tuple(np.concatenate(c) for c in zip(*held)))

    return scan


def frequent_anchors(keyed: DataFrame, size: int, gram: int, base: int, parts: int) -> np.ndarray:
    """Anchors that make up more than a quarter of an average partition in a sample of the documents: at most 4 * parts."""

    def anchors(rows: tuple) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(rows[5])], names=["h"])

    some = keyed.filter(F.col("doc").isNotNull() & (F.pmod(F.xxhash64("doc", "copy"), F.lit(SAMPLE)) == 0))
    counts = pinned(some.mapInArrow(scanned(size, gram, base, 64, anchors), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.array(sorted(r.h for r in counts.filter((F.col("n") >= 8) & (F.col("n") * 4 * parts > total)).collect()), np.int64)


#: Rows between the two passes: p deals them, z packs n, off and the mark below; x is the real anchor of a frequent one, or
#: the copy of the document that a fallen run repeats, whose id is then in r and whose place is in oat.
ROW = "p long, r long, doc long, copy long, at int, z int, oat int, x long"
LIVE, FREQUENT, FALLEN = 0, 1, 2
MET = "kind byte, h long, g long, doc long, copy long, at int, n int, off int"


def arrow(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    kinds = {"byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) if isinstance(c, list) else pa.array(np.asarray(c).astype(kinds[t].to_pandas_dtype())) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def owners(doc: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In rows sorted by run and document, new where a run starts: each row's first, and whether the row is of a larger document."""
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return first, doc > doc[first]


def joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, copy, list of fallen runs) -> one row per span of neighbouring runs that repeat neighbouring runs."""
    for batch in batches:
        lists = batch.column(2)
        v = lists.flatten()
        lens = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), lens)
        h, g, at, n, off = (v.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "g", "at", "n", "off"))
        by = np.lexsort((at, row))
        row, h, g, at, n, off = (c[by] for c in (row, h, g, at, n, off))
        new = starts(row, h, g, off // GRID)
        new[1:] |= (at[1:] != at[:-1] + n[:-1]) | (off[1:] != off[:-1] + n[:-1])
        first = np.flatnonzero(new)
        if len(first):
            doc, copy = (batch.column(k).to_numpy() for k in (0, 1))
            yield arrow("doc long, copy long, h long, g long, at int, n int, off int", doc[row[first]], copy[row[first]], h[first], g[first], at[first], np.add.reduceat(n, first), off[first])


def covered_once(keyed: DataFrame, base_dir: str, size: int, gram: int, slices: int, most: int, base: int, bits: int) -> DataFrame | None:
    """Covered strings (doc, copy, at, n: n strings from byte at on), or None if runs of equal hashes were found to differ."""
    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = frequent_anchors(keyed, size, gram, base, parts)

    def runs(part: int) -> Callable:
        def take(rows: tuple) -> Iterator[pa.RecordBatch]:
            """Runs that fall already here are dealt by their own document, so that copies do not meet in one task."""
            mine = rows[5].view(np.uint64) % np.uint64(slices) == part
            doc, copy, at, n, off, h, r = (c[mine] for c in rows)
            by = np.lexsort((doc, r, h))
            doc, copy, at, n, off, h, r = (c[by] for c in (doc, copy, at, n, off, h, r))
            first, fall = owners(doc, starts(h, r)) if len(h) else (by, by == 1)
            often = np.isin(h, frequent)
            mark = np.where(fall, FALLEN, np.where(often, FREQUENT, LIVE))
            own = mixed(h.view(np.uint64) ^ mixed(r.view(np.uint64))).view(np.int64)
            p = np.where(fall, mixed(doc.view(np.uint64)).view(np.int64), np.where(often, own, h))
            yield arrow(ROW, p, np.where(fall, doc[first], r), doc, copy, at, n | off << 8 | mark << 16, np.where(fall, at[first], 0), np.where(fall, copy[first], np.where(often, h, 0)))

        return scanned(size, gram, base, bits, take)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: covered, as (h, g) has it from byte off on; 1: to be compared."""
        for g in groups(batches, "p"):
            mark, n, off = g["z"] >> 16, g["z"] & 0xFF, g["z"] >> 8 & 0xFF
            f = mark == FALLEN
            if f.any():
                yield arrow(MET, np.zeros(f.sum()), g["r"][f], g["x"][f], g["doc"][f], g["copy"][f], g["at"][f], n[f], g["oat"][f])
            p, r, doc, copy, at, n, off, mark, x = (c[~f] for c in (g["p"], g["r"], g["doc"], g["copy"], g["at"], n, off, mark, g["x"]))
            if not len(p):
                continue
            first, fall = owners(doc, starts(p, r))
            if fall.any():
                o = first[fall]
                yield arrow(MET, np.zeros(len(o)), doc[o], copy[o], doc[fall], copy[fall], at[fall], n[fall], at[o])
            p, doc, copy, at, n, off, mark, x = (c[~fall] for c in (p, doc, copy, at, n, off, mark, x))
            edge = np.flatnonzero(starts(p))
            varied = np.minimum.reduceat(doc, edge) < np.maximum.reduceat(doc, edge)
            use = np.repeat(varied, np.diff(np.append(edge, len(p)))) | (mark == FREQUENT)
            if use.any():
                yield arrow(MET, np.ones(use.sum()), np.where(mark == FREQUENT, x, p)[use], np.zeros(use.sum()), doc[use], copy[use], at[use], n[use], off[use])

    for part in range(slices):
        found = keyed.filter("doc is not null").mapInArrow(runs(part), ROW)
        found.repartition(parts, "p").sortWithinPartitions("p", "r", "doc").mapInArrow(meet, MET).write.partitionBy("kind").parquet(f"{base_dir}/met/slice={part}")
    met = spark.read.schema(f"{MET}, slice int").parquet(f"{base_dir}/met")
    run = F.struct("h", "g", "at", "n", "off")
    met.filter("kind = 0").groupBy("doc", "copy").agg(F.collect_list(run).alias("runs")).mapInArrow(
        joined_spans, "doc long, copy long, h long, g long, at int, n int, off int"
    ).write.parquet(f"{base_dir}/spans")
    spans = spark.read.parquet(f"{base_dir}/spans")
    # A span and the one it repeats ask for their bytes under one name (h, g, off, n).
    repeats = spans.select("doc", "copy", F.lit(0).cast("byte").alias("kind"), "h", "g", "at", "n", "off")
    source = spans.select("h", "g", "off", "n").distinct().select(F.col("h").alias("doc"), F.col("g").alias("copy"), F.lit(0).cast("byte").alias("kind"), "h", "g", F.col("off").alias("at"), "n", "off")
    near = met.filter("kind = 1").select("doc", "copy", "kind", "h", "g", "at", "n", "off")
    asked = repeats.unionByName(source).unionByName(near).groupBy("doc", "copy").agg(F.collect_list(F.struct("kind", "h", "g", "at", "n", "off")).alias("asked"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, copy, t, asked_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                data = as_bytes(t.as_py()).tobytes()
                v = asked_.values
                kind, h, g, at, n, off = (v.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "h", "g", "at", "n", "off"))
                ctx = [data[a : a + m - 1 + size] for a, m in zip(at.tolist(), n.tolist())]
                yield arrow(f"{MET}, ctx binary", kind, h, g, np.full(len(h), doc), np.full(len(h), copy), at, n, off, ctx)

    texts = keyed.join(spread(asked), ["doc", "copy"]).select("doc", "copy", "text", "asked")
    texts.mapInArrow(contexts, f"{MET}, ctx binary").write.partitionBy("kind").parquet(f"{base_dir}/ctx")
    ctx = spark.read.schema(f"{MET}, ctx binary").parquet(f"{base_dir}/ctx")
    differ = ctx.filter("kind = 0").groupBy("h", "g", "off", "n").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b")).filter("a <> b")
    if not differ.isEmpty():
        return None
    cols = ["doc", "copy", "at", "n"]
    found = spans.select(cols)
    for one in compared(ctx.filter("kind = 1").select(F.col("h").alias("key"), "doc", "copy", "at", "n", "off", "ctx"), base_dir, size, gram, most, parts, bits):
        found = found.union(one.select(cols))
    return found


PIECE = "key long, doc long, copy long, at int, n int, off int, ctx binary"


def compared(contexts: DataFrame, base_dir: str, size: int, gram: int, most: int, parts: int, bits: int) -> Iterator[DataFrame]:
    """Covered strings among contexts (PIECE), each level of group sizes in a table of its own."""
    spark = contexts.sparkSession

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "key"):
            for row, k in covered_strings(g, size, bits):
                yield arrow("doc long, copy long, at int, n int", g["doc"][row], g["copy"][row], g["at"][row] + k, np.ones(len(row)))

    def finer(width: int) -> Callable:
        """Strings that start at width neighbouring distances before the anchor share the bytes around it, which are their new key."""

        def cut_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for _, doc, copy, at, n, off, ctx in zip(*(c.to_pylist() for c in batch.columns)):
                    for c in range((off - n + 1) // width, off // width + 1):
                        k0, k1 = max(0, off - (c + 1) * width + 1), min(n - 1, off - c * width)
                        core = ctx[off - c * width : off - c * width + size - width + 1]
                        key = xxhash.xxh64_intdigest(core, c)
                        out.append((key - (1 << 64) if key >> 63 else key, doc, copy, at + k0, k1 - k0 + 1, off - k0, ctx[k0 : k1 + size]))
                if out:
                    yield arrow(PIECE, *(list(c) for c in zip(*out)))

        return cut_

    width = 1 << (size - gram).bit_length()
    while True:
        level = f"{base_dir}/near-{width}"
        big = pinned(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > most).select("key"))
        n_big = big.count()
        keys = F.broadcast(big) if n_big <= BROADCAST_KEYS else spread(big)
        small = contexts.join(keys, "key", "left_anti") if n_big else contexts
        small.repartition(parts, "key").sortWithinPartitions("key", "doc").mapInArrow(compare, "doc long, copy long, at int, n int").write.parquet(level)
        yield spark.read.parquet(level)
        if not n_big:
            return
        rest = contexts.join(keys, "key", "left_semi").select(contexts.columns)
        if width == 1:  # single strings, and copies of one another
            least = rest.groupBy("ctx").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("ctx", "first")
            rest.join(spread(least), "ctx").filter("doc > first").select("doc", "copy", "at", "n").write.parquet(f"{level}-copies")
            yield spark.read.parquet(f"{level}-copies")
            return
        width //= 2
        rest.mapInArrow(finer(width), PIECE).write.parquet(f"{base_dir}/pieces-{width}")
        contexts = spark.read.parquet(f"{base_dir}/pieces-{width}")


def cut(text: str | None, packed: np.ndarray | None, size: int = 50) -> tuple[bytes, int, int]:
    """Remaining bytes, removed bytes and maximal removed runs; packed: first string << 32 | number of strings."""
    data = as_bytes(text).tobytes()
    if packed is None or not len(packed):
        return data, 0, 0
    p = np.sort(np.asarray(packed, np.int64))
    a = p >> 32
    b = np.maximum.accumulate(a + (p & 0xFFFFFFFF) - 1 + size)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    begin, end = a[first], b[np.append(first[1:], len(a)) - 1]
    kept = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
    return kept, int((end - begin).sum()), len(first)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 50, gram: int = 20, slices: int = 2, most: int = MOST, bits: int = 64, with_kept: bool = True) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes). bits weakens the hashes of a first attempt, for tests."""
    spark = docs.sparkSession
    keyed = keyed_documents(docs, id_col, text)
    folder = f"{shared_dir(spark)}/strings-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        attempt = 0
        while (covered := covered_once(keyed, f"{folder}/{attempt}", size, gram, slices, most, base_of(attempt), 64 if attempt else bits)) is None:
            removed(spark, f"{folder}/{attempt}")
            attempt += 1
        packed = covered.groupBy(F.col("doc").alias("d"), F.col("copy").alias("c")).agg(F.collect_list(F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")).alias("packed"))

        def apply(texts: pa.Array, packed_: pa.Array) -> pa.Array:
            rows = [cut(t.as_py(), None if not p.is_valid else p.values.to_numpy(), size) for t, p in zip(texts, packed_)]
            return pa.StructArray.from_arrays(
                [pa.array([r[0] if with_kept else None for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())],
                names=["kept", "n_removed", "n_spans", "kept_sha256"],
            )

        apply.__annotations__ = {"texts": pa.Array, "packed_": pa.Array, "return": pa.Array}
        both = keyed.join(spread(packed), (F.col("doc") == F.col("d")) & (F.col("copy") == F.col("c")), "left")
        done = both.select("doc", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.arrow_udf(apply, "kept binary, n_removed long, n_spans long, kept_sha256 string")("text", "packed").alias("x"))
        done.select(F.col("doc").alias(id_col), "n_bytes", "x.n_removed", "x.n_spans", "x.kept_sha256", *(["x.kept"] if with_kept else [])).write.parquet(f"{folder}/done")
        removed(spark, f"{folder}/{attempt}")
    finally:
        if before is None:
            spark.conf.unset(cleanup)
        else:
            spark.conf.set(cleanup, before)
    return spark.read.parquet(f"{folder}/done")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), with_kept=False)
