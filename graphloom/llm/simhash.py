"""Operator 2, SimHash near-dedup by bit-sliced comparison.

Fingerprints are made per document in Arrow batches. Distinct fingerprints are blocked by the pigeonhole rule: of
``radius + k`` bit blocks, two fingerprints at most ``radius`` bits apart agree on at least ``k``. Inside a block the
fingerprints lie as 64 bit planes; one XOR per plane updates the distances of 64 candidates a word, carry-save counters
add them up, and the scan of a block ends as soon as every candidate is beyond the radius. A block gives the edges of a
spanning forest, not its pairs, and a large block is cut into tiles, so no task holds an unbounded group. Classes come
from alternating large-star and small-star steps over checkpointed edges.

Defined results: null or wordless text has fingerprint zero and is linked like any other; fewer words than a shingle
count as one shingle; ties (a bit set in exactly half the shingles) give 0; repeated rows keep their rows and share a
class; a class whose ids are all null has a null ``component_id``; an empty table gives no rows. Extra columns stay out
of :func:`near_duplicate_classes` and are kept by :func:`keep_one_per_class`.

The pipeline's stage, :func:`keep_one_per_class`, compares fingerprints in the same way and checks what a class links by
exact Jaccard similarity of shingles. At 0.8 about 10 of 64 bits differ, too many for blocks, so the links that fingerprints
miss come from an exact join of the shingle sets, by prefixes in one global order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from graphloom.llm.common import LOWER, UPPER, pinned, spread, table

SEED = 42
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: The pipeline's stage: texts whose five-word shingles have at least this Jaccard similarity (a fraction) are near copies.
NEAR = (4, 5)
#: Keys of the texts to compare are broadcast up to so many (16 bytes each), else joined by shuffle.
BROADCAST_TEXTS = 1_000_000
#: With this setting a query's shuffles are deleted as soon as it has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def fingerprint(text: str | None, shingle: int = 4, step: int = 1 << 16) -> int:
    """The 64-bit SimHash; shingles are hashed ``step`` at a time, so a long text needs little memory."""
    words = words_of(text)
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    counts, total = np.zeros(64, np.int64), 0
    while part := list(islice(shingles, step)):
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 4) -> DataFrame:
    """docs and the fingerprint as a signed 64-bit number."""

    def signed(batch: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in batch], np.uint64).view(np.int64), pa.int64())

    signed.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    signed = F.arrow_udf(signed, LongType())
    return docs.withColumn(out, signed(F.col(text)))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit i of plane b is bit b of fingerprint i."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    wide = np.zeros((64, -(-len(fps) // 64) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def within(queries: np.ndarray, planes: np.ndarray, radius: int, every: int = 8) -> np.ndarray | None:
    """(queries, words) bit sets of the candidates at most ``radius`` bits away; None once all are beyond it.

    Four carry-save counters hold the distances (0 to 7, then a sticky overflow), 64 candidates a word.
    """
    flip = np.where(np.unpackbits(queries.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool), ONES, np.uint64(0))
    shape = (len(queries), planes.shape[1])
    one, two, four, over = (np.zeros(shape, np.uint64) for _ in range(4))
    for b in range(64):
        x = planes[b][None, :] ^ flip[:, b][:, None]
        carry = one & x
        one ^= x
        x = two & carry
        two ^= carry
        carry = four & x
        four ^= x
        over |= carry
        if b % every == every - 1:
            far = over | beyond(one, two, four, radius)
            if (far == ONES).all():
                return None
    return ~(over | beyond(one, two, four, radius))


def beyond(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Bit sets of the counters (0 to 7) above ``radius``."""
    found = np.zeros_like(one)
    for n in range(radius + 1, 8):
        found |= (one if n & 1 else ~one) & (two if n & 2 else ~two) & (four if n & 4 else ~four)
    return found


def forest(left: np.ndarray, right: np.ndarray | None, radius: int, step: int = 256) -> list[tuple[int, int]]:
    """Edges (root, member) that connect what lies within the radius; right None: all of left with all of left."""
    own = right is None
    to = left if own else right
    if len(left) == 0 or len(to) < 1 + own:
        return []
    planes, valid = planes_of(to), np.arange(-(-len(to) // 64) * 64) < len(to)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at in range(0, len(left), step):
        part = left[at : at + step]
        if (hit := within(part, planes, radius)) is None:
            continue
        near = np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little").astype(bool)[:, : len(to)] & valid[: len(to)]
        for i in np.flatnonzero(near.sum(axis=1) > own):
            a = find(int(part[i]))
            for b in {find(int(x)) for x in to[near[i]]} - {a}:
                a, b = (a, b) if a < b else (b, a)
                parent[b] = a
    return [(r, x) for x in list(parent) if (r := find(x)) != x]


def block_layout(n: int, radius: int, most: int = 4096) -> list[tuple[int, ...]]:
    """Bit masks, one per key: each choice of k of radius + k blocks; k grows with the number of fingerprints n, so that evenly spread ones fill a key with at most ``most``. Every layout finds every link."""
    k = 1
    while k < 4 and n / 2 ** (64 * k // (radius + k)) > most:
        k += 1
    ends = [64 * i // (radius + k) for i in range(radius + k + 1)]
    blocks = [((1 << ends[i + 1]) - 1) ^ ((1 << ends[i]) - 1) for i in range(radius + k)]
    return [sum(c) for c in combinations(blocks, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = 4, tile: int = 8192) -> DataFrame:
    """fps(fp) distinct signed fingerprints -> (u, v), edges that connect exactly the fingerprints joined by links."""
    spark = fps.sparkSession
    masks = block_layout(fps.count(), radius)
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("k", "v"))
    parts = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", "v", F.ceil(F.col("n") / tile).cast("int").alias("c"))
    own = F.expr("cast(pmod(xxhash64(fp), c) as int)")
    tiles = (
        keyed.join(spread(parts), ["k", "v"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select("k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") < F.col("other")).cast("int").alias("side"), "fp")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(n, "k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ("k", "v", "i", "j")):
            fp = block["fp"].view(np.uint64)
            if block["i"][0] == block["j"][0]:
                found = forest(fp, None, radius)
            else:
                first = block["side"] == 1
                found = forest(fp[first], fp[~first], radius)
            if found:
                pairs = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return dealt.mapInArrow(scan, "u long, v long")


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of equal, adjacent keys in a sorted stream, as columns; a group may span batches."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        if held and any(held[-1][k][-1] != cols[k][0] for k in keys):
            yield {c: np.concatenate([h[c] for h in held]) for c in cols}
            held = []
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            change |= cols[k][1:] != cols[k][:-1]
        cuts = np.flatnonzero(change) + 1
        at = 0
        for end in cuts:
            piece = {c: v[at:end] for c, v in cols.items()}
            yield {c: np.concatenate([*(h[c] for h in held), piece[c]]) for c in cols} if held else piece
            held, at = [], end
        held.append({c: v[at:] for c, v in cols.items()})
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


#: Edges a task, where there are too few to fill all shuffle partitions.
EDGES_A_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (u, root): the smallest vertex of each edge's component, by alternating large and small stars.

    A step joins edges with each vertex's smallest neighbour; both sides are shuffled by the join, so adaptive execution
    splits a hub. Tasks read EDGES_A_TASK edges or more while there are fewer than shuffle partitions times that. Each round ends in a checkpoint; the steps end when no edge moves.
    """

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return tuple(r)

    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = pinned(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = mark(edges)
    while before[0]:
        parts = min(most, 1 + before[0] // EDGES_A_TASK)
        both = edges.coalesce(parts).union(edges.coalesce(parts).select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low.coalesce(parts), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = pinned(large.coalesce(parts))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low.coalesce(parts), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = pinned(moved.union(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(parts))
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select("u", F.col("v").alias("root"))


def classes_of(marked: DataFrame, id_col: str, fp: str, radius: int) -> DataFrame:
    """marked(id, fp) -> (fp, component_id) for every distinct fingerprint."""
    nodes = pinned(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("node")))
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "node", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("node").alias("component_id"))
    return rooted.join(spread(least), "root").select("fp", "component_id")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row per row of docs: id, fingerprint as 16 hex digits, component_id (smallest id reachable over links)."""
    marked = pinned(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", "fp", shingle).select("doc_id", "fp"))
    return marked.join(spread(classes_of(marked, "doc_id", "fp", radius)), "fp").select(
        F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def led_by_class(marked: DataFrame, radius: int) -> DataFrame:
    """marked(node, fp) -> (node_u, node_v), once each: every node beside the smallest node of its fingerprint's class."""
    led = marked.select("node", "fp").distinct().join(spread(classes_of(marked, "node", "fp", radius)), "fp").filter("node <> component_id")
    return led.select(F.col("component_id").alias("node_u"), F.col("node").alias("node_v")).distinct()


def shingles_of(text: str | None, shingle: int = 5, step: int = 1 << 16) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles; fewer words than a shingle are one, no words none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64)
    made = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    parts = []
    while part := list(islice(made, step)):
        parts.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))))
    return np.unique(np.concatenate(parts).view(np.int64))


#: Columns of :func:`parities`: 256 bits of a shingle set.
PARITIES = ("p0", "p1", "p2", "p3")


def parities(shingles: np.ndarray) -> np.ndarray:
    """Per bucket of the hashes' low eight bits, whether an odd number of shingles fall in it; two sets differ in as many shingles as these bits at least."""
    odd = np.bincount((shingles & 255).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def head_size(n: int) -> int:
    """Of n shingles in one global order, two texts that reach NEAR share one among their first so many."""
    up, down = NEAR
    return n - -(-up * n // down) + 1 if n else 0


def _listed(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def common_shingles(docs: DataFrame, text: str, shingle: int, share: int = 8, least: int = 8, most: int = 100_000) -> dict[int, int]:
    """Shingles seen often in a share of the texts, with their counts. They only order the shingles, so they bear on cost and never on the result."""

    def whole(batch: pa.Array) -> pa.Array:
        return _listed([shingles_of(t.as_py(), shingle) for t in batch])

    whole.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(share)) == 0).select(F.col(text).alias("t")).distinct()
    seen = some.select(F.explode(F.arrow_udf(whole, "array<long>")("t")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return {r.g: r.n for r in settled(seen.filter(F.col("n") >= least).orderBy(F.desc("n"), "g").limit(most)).collect()}


def settled(df: DataFrame) -> DataFrame:
    """df pinned, and the shuffles that made it deleted at once, whoever still refers to df. Checkpoints that nothing refers to go when the driver's collector has run, so it runs here."""
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        out = pinned(df.select("*"))  # the setting counts when a query is made
    finally:
        conf.unset(DROP_SHUFFLES) if before is None else conf.set(DROP_SHUFFLES, before)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def first_of_node(rows: DataFrame) -> DataFrame:
    """rows(node, th, r, ...) with unique r -> one row a node, that with the smallest th. Few nodes have copies, so only their keys are joined and the rows stay where they are."""
    copied = settled(rows.groupBy("node").agg(F.min(F.struct("th", "r")).alias("m"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("node", F.col("m.r").alias("lead")))
    if copied.count() <= BROADCAST_TEXTS:
        return rows.join(F.broadcast(copied), "node", "left").filter("lead is null or lead = r").drop("lead", "r")
    return settled(rows.join(spread(copied), "node", "left").filter("lead is null or lead = r").drop("lead", "r"))


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns."""
    return F.xxhash64(*docs.columns)


def similar_classes(docs: DataFrame, id_col: str, text: str, shingle: int, radius: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, th (hash of the text), o (hash of the row), root; rows share a root if a chain of texts, each NEAR the next by exact Jaccard similarity of shingles, joins them.

    Texts with equal shingles are one node. Fingerprints as in :func:`near_duplicate_classes` are linked within the radius, and
    each node of a class is compared in full with its first. For links beyond that: two sets that reach NEAR share a shingle
    among the first ``head_size`` of each in any common order (here: rare ones first); such pairs, after bounds on size,
    position and parities, are compared in full, unless chains of others join them already.
    """
    up, down = NEAR
    common = common_shingles(docs, text, shingle)
    keys = np.array(sorted(common), np.int64)
    often = np.array([common[k] for k in keys.tolist()], np.int64)

    def sketch(batch: pa.Array) -> pa.Array:
        node, size, heads, odd = [], [], [], []
        for t in batch:
            g = shingles_of(t.as_py(), shingle)
            node.append(xxhash.xxh64_intdigest(g.tobytes(), SEED))
            size.append(len(g))
            odd.append(parities(g))
            weight = np.zeros(len(g), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                weight = np.where(keys[at] == g, often[at], 0)
            heads.append(g[np.lexsort((g, weight))[: head_size(len(g))]])
        bits = np.array(odd, np.int64).reshape(-1, len(PARITIES))
        made = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), _listed(heads), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(PARITIES)))]
        return pa.StructArray.from_arrays(made, names=["node", "n", "head", *PARITIES])

    def whole(batch: pa.Array) -> pa.Array:
        return _listed([shingles_of(t.as_py(), shingle) for t in batch])

    sketch.__annotations__ = whole.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    said = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), row_key(docs).alias("o"), F.col(text).alias("t"))
    kinds = "node long, n long, head array<long>, " + ", ".join(f"{p} long" for p in PARITIES)
    wide = settled(with_fingerprint(said, "t", "fp").select("doc_id", "th", "o", "fp", F.monotonically_increasing_id().alias("r"), F.arrow_udf(sketch, kinds)("t").alias("s")).select("doc_id", "th", "o", "fp", "r", "s.*"))
    rows = settled(wide.select("doc_id", "th", "o", "node", "fp"))
    linked = settled(led_by_class(rows, radius))
    nodes = first_of_node(wide.select("node", "th", "r", "n", "head", *PARITIES))
    odd_bits = nodes.select("node", *PARITIES)
    # One row a head shingle is the largest table here, so it holds no more than the place; parities join what several share.
    first = nodes.select("node", "n", F.posexplode("head").alias("at", "g"))
    several = first.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("g")
    grouped = settled(first.join(spread(several), "g").join(odd_bits, "node"))
    kept = ("node", "n", "at", *PARITIES)
    lead = grouped.groupBy("g").agg(F.min(F.struct(F.xxhash64("node", "g").alias("o"), *kept)).alias("lead"))
    members = grouped.join(spread(lead), "g")

    def differ() -> Column:
        return sum((F.bit_count(F.col(f"{p}_u").bitwiseXOR(F.col(f"{p}_v"))) for p in PARITIES), F.lit(0))

    def possible(both: DataFrame, first_shared: bool) -> DataFrame:
        # A pair may rest on the first shingle that its heads share; nothing before it is shared then.
        shared = F.least(F.col("n_u") - F.col("at_u"), F.col("n_v") - F.col("at_v")) + (F.lit(0) if first_shared else F.least("at_u", "at_v"))
        fits = ((up + down) * differ() <= (down - up) * (F.col("n_u") + F.col("n_v"))) & (down * F.least("n_u", "n_v") >= up * F.greatest("n_u", "n_v")) & ((up + down) * shared >= up * (F.col("n_u") + F.col("n_v")))
        return both.filter(fits).select(F.least("node_u", "node_v").alias("node_u"), F.greatest("node_u", "node_v").alias("node_v")).distinct()

    def near(pairs: DataFrame) -> DataFrame:
        # What two sets share beyond their heads lies past the end of the head that ends first.
        met = settled(pairs.select(F.col("node_u").alias("node")).union(pairs.select("node_v")).distinct())
        few = nodes.join(F.broadcast(met), "node") if met.count() <= BROADCAST_TEXTS else nodes
        a, b = (few.select(F.col("node").alias(f"node_{s}"), F.col("n").alias(f"n_{s}"), F.col("head").alias(f"h_{s}")) for s in "uv")
        bound = F.size(F.array_intersect("h_u", "h_v")) + F.greatest(F.col("n_u") - F.size("h_u"), F.col("n_v") - F.size("h_v"))
        pairs = settled(pairs.join(a, "node_u").join(b, "node_v").filter((up + down) * bound >= up * (F.col("n_u") + F.col("n_v"))).select("node_u", "node_v"))
        met = pairs.select(F.col("node_u").alias("node")).union(pairs.select("node_v")).distinct()
        asked = settled(met.join(nodes.select("node", "th"), "node"))
        small = asked.count() <= BROADCAST_TEXTS
        texts = said.select("th", "t").join(F.broadcast(asked) if small else spread(asked), "th").dropDuplicates(["node"])
        sets = settled(texts.select("node", F.arrow_udf(whole, "array<long>")("t").alias("g")))
        a, b = (sets.select(F.col("node").alias(f"node_{s}"), F.col("g").alias(f"g_{s}")) for s in "uv")
        both = F.size(F.array_intersect("g_u", "g_v"))
        found = pairs.join(a, "node_u").join(b, "node_v").filter((up + down) * both >= up * (F.size("g_u") + F.size("g_v")))
        return settled(found.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")))

    # Fingerprint classes and groups of a shingle: members meet the leader first; of what that leaves apart in a group, every
    # pair meets. Pairs of one class need no look.
    led = members.select(*(F.col(c).alias(f"{c}_u") for c in kept), *(F.col(f"lead.{c}").alias(f"{c}_v") for c in kept))
    pairs = settled(linked.union(possible(led.filter("node_u <> node_v"), False)).distinct())
    sure = near(pairs)
    joined = components(sure).select(F.col("u").alias("node"), F.col("root").alias("c"))
    apart = settled(grouped.join(spread(joined), "node", "left").withColumn("c", F.coalesce("c", "node")))
    # The bounds of possible, as far as they hold for all members of two classes; most classes are one text, whose parities count.
    alone = F.count(F.lit(1)) == 1
    classes = apart.groupBy("g", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("at")).alias("tail"), *(F.when(alone, F.min(p)).alias(p) for p in PARITIES))
    x, y = (classes.select("g", *(F.col(c).alias(f"{c}_{s}") for c in ("c", "lo", "hi", "tail", *PARITIES))) for s in "uv")
    meet = (down * F.col("hi_u") >= up * F.col("lo_v")) & (down * F.col("hi_v") >= up * F.col("lo_u"))
    meet = meet & ((up + down) * F.least("tail_u", "tail_v") >= up * (F.col("lo_u") + F.col("lo_v")))
    meet = meet & ((up + down) * F.coalesce(differ(), F.lit(0)) <= (down - up) * (F.col("hi_u") + F.col("hi_v")))
    met = settled(x.join(y, "g").filter((F.col("c_u") < F.col("c_v")) & meet).select("g", "c_u", "c_v"))
    u, v = (apart.select("g", *(F.col(c).alias(f"{c}_{s}") for c in ("c", *kept))) for s in "uv")
    rest = possible(met.join(u, ["g", "c_u"]).join(v, ["g", "c_v"]), True).join(pairs, ["node_u", "node_v"], "left_anti")
    roots = components(sure.union(near(settled(rest))))
    return rows.drop("fp").join(spread(roots.withColumnRenamed("u", "node")), "node", "left").select("doc_id", "th", "o", F.coalesce("root", "node").alias("root"))


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """One row of docs per class of :func:`similar_classes`: the smallest id (null last), then text hash, then row hash. Columns as in docs.

    Whole rows are shuffled once, to meet the keys that stay. Only rows equal in every column share a key, so what stays
    of a class of one row is done; what stays of the others is reduced to one row a key.
    """
    classes = similar_classes(docs, id_col, text, shingle)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "o")).alias("m"), (F.count(F.lit(1)) > 1).alias("several"))
    first = first.select("m.doc_id", "m.th", "m.o", "several")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), row_key(docs).alias("k"))
    kept = rows.join(spread(first), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th")) & (F.col("k") == F.col("o")))
    equal = kept.filter("several").groupBy("id", "h", "k").agg(F.first("row").alias("row"))
    return kept.filter("not several").select("row.*").unionByName(equal.select("row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
