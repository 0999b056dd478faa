"""Operator 4, benchmark decontamination as a prefix-filtered set join; DataFrame expressions only.

An item's windows are sets of words that must occur whole, so one necessary prefix token each is enough: words are
ordered by their count over all documents and the rarest word of a window is its prefix. Document words join the
prefixes; the window's place follows from the offset of its prefix (positional bound: not before the text, length bound:
not beyond its end), and the words there are compared exactly. Words are exploded inside one code-generated stage with
the prefix table as its build side; only matches are shuffled.

Defined results: null or wordless text has zero words and no hits; a null or wordless item has no window, and an item
with a null id is skipped; an item of fewer than eight words is one window; ties in rarity go to the smaller word;
repeated documents give repeated rows, repeated items count once; empty tables give no rows, or rows without hits.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.llm.common import ascii_lower, fresh, pinned, spread, table

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of windows is broadcast up to so many bytes, items and words counted; a larger one is joined by shuffle, with the words around each candidate.
BROADCAST_BYTES = 32 << 20


def small(windows: DataFrame) -> bool:
    """Whether windows(win, items, ...) may be broadcast; what is made of their words alone is smaller."""
    ids = F.aggregate("items", F.lit(0).cast("long"), lambda n, i: n + 24 + F.length(i.cast("string")))
    size = F.lit(200) + ids + F.aggregate("win", F.lit(0).cast("long"), lambda n, w: n + 24 + F.octet_length(w))
    return (windows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _words(text: Column) -> Column:
    """Words between breaks, with an empty string first or last where text starts or ends with a break."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK)


def _ends(raw: str) -> tuple[Column, Column]:
    """1 if raw starts with an empty string, else 0; and how many words it has."""
    lead = (F.get(raw, F.lit(0)) == "").cast("int")
    trail = ((F.size(raw) > 1) & (F.get(raw, F.size(raw) - 1) == "")).cast("int")
    return lead, F.size(raw) - lead - trail


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 8) -> DataFrame:
    """Distinct windows: win (words), m (their number), items (ids that have it)."""
    raw = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), _words(F.col(text)).alias("raw"))
    words = raw.select("item", F.filter("raw", lambda w: w != "").alias("w")).filter("size(w) > 0")
    last = F.greatest(F.size("w") - window, F.lit(0))
    wins = words.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item", F.slice("w", F.col("at") + 1, window).alias("win"))
    return wins.groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("m", F.size("win"))


def prefixes(windows: DataFrame, doc_words: DataFrame) -> DataFrame:
    """windows with their rarest word over doc_words(raw): token, and k, its place in the window."""
    spots = windows.select("win", "m", "items", F.posexplode("win").alias("k", "token"))
    few = small(windows)
    asked = spots.select("token").distinct()
    counted = doc_words.select(F.explode("raw").alias("token")).join(F.broadcast(asked) if few else asked, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # A word may be in very many windows: its count is sent to them, or dealt so that the join may split it.
    ranked = spots.join(F.broadcast(counted) if few else spread(counted), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = ranked.groupBy("win").agg(F.min(F.struct("n", "token", "k")).alias("best"), F.first("m").alias("m"), F.first("items").alias("items"))
    return best.filter("best.n > 0").select(F.col("best.token").alias("token"), F.col("best.k").alias("k"), "win", "m", "items")


def window_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8) -> DataFrame:
    """(id, h, starts, items): for each distinct (id, text hash) with a hit, the places and lengths of windows and the item ids."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), _words(F.col(text)).alias("raw"))
    lead, n = _ends("raw")
    windows = pinned(item_windows(items, item_id, item_text, window))
    table_ = pinned(prefixes(windows, keyed))
    # Exploding the split itself is fast, a slice of it is not; so q counts from an empty first string, if there is one.
    spots = keyed.select("id", "h", "raw", lead.alias("lead"), n.alias("n"), F.posexplode("raw").alias("q", "token")).withColumn("p", F.col("q") - F.col("lead"))
    bounds = (F.col("p") >= F.col("k")) & (F.col("p") - F.col("k") + F.col("m") <= F.col("n"))
    if small(table_):
        found = spots.join(F.broadcast(table_), "token").filter(bounds & (F.slice("raw", F.col("q") - F.col("k") + 1, F.col("m")) == F.col("win")))
    else:
        near = spots.select("id", "h", "n", "p", "token", F.least("q", F.lit(window - 1)).alias("back"), F.slice("raw", F.greatest(F.col("q") - window + 2, F.lit(1)), 2 * window - 1).alias("near"))
        found = near.join(spread(table_), "token").filter(bounds & (F.slice("near", F.col("back") - F.col("k") + 1, F.col("m")) == F.col("win")))
    return found.groupBy("id", "h").agg(
        F.collect_set(F.struct((F.col("p") - F.col("k")).alias("at"), "m")).alias("starts"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, min_items: int = 2) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items (sorted strings), contaminated."""
    hits = window_hits(docs, items, id_col, text, item_id, item_text, window).select(
        F.col("id").alias("hit_id"), F.col("h").alias("hit_h"),
        F.size(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + s["m"] - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.transform("items", lambda i: i.cast("string"))).alias("items"),
    )
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), _words(F.col(text)).alias("raw")).select("id", "h", _ends("raw")[1].cast("long").alias("n_words"))
    both = base.join(spread(hits), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left")
    n_items = F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long")
    return both.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_items >= min_items).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", min_items: int = 2) -> DataFrame:
    """The rows of docs that are not contaminated, columns as they were; the rows to drop join by (id, text hash)."""
    drop = window_hits(docs, items, id_col, text).filter(F.size("items") >= min_items).select(F.col("id").alias("drop_id"), F.col("h").alias("drop_h"))
    mark = fresh(docs, "text_hash")
    marked = docs.withColumn(mark, F.xxhash64(text))
    return marked.join(spread(drop), marked[id_col].eqNullSafe(F.col("drop_id")) & (marked[mark] == F.col("drop_h")), "left_anti").drop(mark)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS m, array_to_string(w[s:s + least(len(w), 8) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT dw.rid, dw.s, dw.m, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS p FROM hit) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN found USING (rid)
"""
