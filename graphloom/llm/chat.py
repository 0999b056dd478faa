"""Operator 7, chat formatting with cumulative-snapshot collapse; DataFrame expressions only.

Logs often hold a conversation again and again as it grows. A rolling hash over (place, role, text) of the turns gives
every prefix of every conversation a key in one windowed pass: two running sums of 64-bit hashes, kept as decimals. Of
equal conversations the smallest id stays; an anti-join drops those whose whole key is a proper prefix of another; the
rest is rendered. Keys are aggregated before they are joined, so a first turn shared by a third of the log is one row.

Defined results: turns are ordered by turn, role, text (nulls first), repeated rows stay repeated turns; a null role is
rendered as ``unknown`` and a null text as empty, and neither equals an empty one; a null conv_id is one conversation;
an empty table gives no rows. Extra columns are not read. A conversation is rendered into one row, so it must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphloom.llm.common import pinned, spread, table


def _turn_hash(salt: int) -> Column:
    h = F.xxhash64(F.lit(salt), "pos", F.col("t.role").isNull(), "t.role", F.col("t.text").isNull(), "t.text")
    return h.cast("decimal(20,0)")


def maximal_conversations(log: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations that no other prolongs: conv_id, n_turns, n_same (equal conversations, itself included), turns."""
    rows = log.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    steps = whole.select("conv_id", F.size("turns").alias("n"), F.posexplode("turns").alias("pos", "t"))
    run = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    keys = pinned(
        steps.select("conv_id", "n", (F.col("pos") + 1).alias("k"), _turn_hash(1).alias("a"), _turn_hash(2).alias("b"), "pos")
        .select("conv_id", "n", "k", F.sum("a").over(run).alias("a"), F.sum("b").over(run).alias("b"))
    )
    ends = keys.filter("k = n").groupBy("k", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNull().alias("z"), "conv_id")).alias("first"), F.count(F.lit(1)).alias("n_same"))
    inner = keys.filter("k < n").select("k", "a", "b").distinct()
    kept = ends.join(inner, ["k", "a", "b"], "left_anti").select(F.col("first.conv_id").alias("kept_id"), "n_same")
    return whole.join(spread(kept), F.col("conv_id").eqNullSafe(F.col("kept_id"))).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_same", "turns")


def render(turns: Column) -> Column:
    """``<|role|>`` on a line of its own, the text below, ``<|end|>`` after each turn; what a log says cannot open a marker, ``<|`` in it becomes ``< |``."""

    def plain(c: Column) -> Column:
        return F.replace(c, F.lit("<|"), F.lit("< |"))

    return F.concat_ws("\n", F.transform(turns, lambda t: F.concat(F.lit("<|"), plain(F.coalesce(t["role"], F.lit("unknown"))), F.lit("|>\n"), plain(F.coalesce(t["text"], F.lit(""))), F.lit("\n<|end|>"))))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", "n_same", render(F.col("turns")).alias("rendered"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n, role, text,
    coalesce('r' || length(role) || ':' || role, 'n') || coalesce('t' || length(text) || ':' || text, 'n') AS piece
  FROM conversations),
p AS (
  SELECT conv_id, k, n, sha256(string_agg(piece, '' ORDER BY k) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)) AS h FROM t),
ends AS (SELECT k, h, min(conv_id) AS conv_id, count(*) AS n_same FROM p WHERE k = n GROUP BY k, h),
kept AS (SELECT * FROM ends e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = e.k AND p.h = e.h))
SELECT kept.conv_id, CAST(any_value(kept.k) AS BIGINT) AS n_turns, CAST(any_value(n_same) AS BIGINT) AS n_same,
  string_agg('<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || chr(10) || '<|end|>', chr(10) ORDER BY t.k) AS rendered
FROM kept JOIN t ON t.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY kept.conv_id
"""
