"""Bounded traversals, closures, walks and components, all as joins per round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from graphloom.functions.exprs import walked, weight
from graphloom.operators.frames import by_id, handed, pinned, spread
from graphloom.schema import allowed


def steps_of(edges: DataFrame, direction: str = "both", structural: bool = False) -> DataFrame:
    """Steps (a, b) in the direction asked for, one per edge; anything but outbound or inbound means both."""
    kept = edges.filter(F.col("type").isin(*allowed(structural)))
    out, back = kept.select(F.col("src").alias("a"), F.col("dst").alias("b")), kept.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"outbound": out, "inbound": back}.get(direction, out.unionByName(back))


def adjacency(edges: DataFrame, direction: str = "both", structural: bool = False) -> DataFrame:
    """steps_of, each once."""
    return steps_of(edges, direction, structural).distinct()


def reached(seeds: DataFrame, steps: DataFrame, depth: int, cap: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """(id, hop): nodes within depth steps of seeds(id), smallest hop first found; steps (a, b) may repeat.

    Levels are sets of new nodes, checkpointed, so each is one join and one distinct whatever the number of walks; a level of
    few nodes is broadcast to the steps. With a cap the nodes first in (hop, id) order stay. Steps start and end at ids of
    within(id), if given.
    """
    level = found = pinned(seeds.select("id").distinct())
    every = level.withColumn("hop", F.lit(0))
    if within is not None:
        level = pinned(handed(level).join(within, "id").distinct())
    for k in range(1, depth + 1):
        ahead = handed(level).join(steps, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        ahead = ahead.join(found.withColumnRenamed("id", "seen"), F.col("id").eqNullSafe(F.col("seen")), "left_anti")
        level = pinned(ahead)
        if within is not None:
            level = pinned(handed(level).join(within, "id").distinct())
        every = every.unionByName(level.withColumn("hop", F.lit(k)))
        found = found.unionByName(level)
    return every if cap is None else pinned(every.orderBy("hop", by_id()).limit(cap))


def walk_scores(seeds: DataFrame, edges: DataFrame, depth: int, structural: bool = False) -> DataFrame:
    """seeds(id, score) -> (id, proximity): the best decayed product over walks of 1 to depth undirected edges, rounded at every step."""
    kept = edges.filter(F.col("type").isin(*allowed(structural))).select("src", "dst", weight(F.col("type")).alias("w"))
    steps = kept.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionByName(kept.select(F.col("dst").alias("a"), F.col("src").alias("b"), "w"))
    level, rounds = pinned(seeds.select("id", "score")), []
    for _ in range(depth):
        level = pinned(handed(level).join(steps, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id"), "w").agg(F.max("score").alias("score")).groupBy("id").agg(F.max(walked(F.col("score"), F.col("w"))).alias("score")).filter("score > 0"))
        rounds.append(level)
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    return every.groupBy("id").agg(F.max("score").alias("proximity"))


def closure(seeds: DataFrame, pairs: DataFrame, kept: Callable[[DataFrame], DataFrame] = lambda led: led) -> DataFrame:
    """seeds(id) and whatever pairs (a, b: if a then b) lead to, round by round from the newly found alone; it ends with the last new id.

    kept drops those of a round's pairs that do not count, so that only they are judged.
    """
    found = fresh = pinned(seeds.select("id").distinct())
    while True:
        led = kept(handed(fresh).join(pairs, F.col("id") == F.col("a")).select("a", "b").distinct())
        fresh = pinned(led.select(F.col("b").alias("id")).distinct().join(found, "id", "left_anti"))
        if fresh.isEmpty():
            return found
        found = pinned(found.unionByName(fresh))


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root): nodes(id) and the smallest id of their undirected component over links (a, b), by large and small stars until no edge moves."""

    def sum_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    def down(e: DataFrame) -> DataFrame:
        return e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = pinned(down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    before = sum_of(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pinned(down(both.filter("v > u").join(spread(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = pinned(down(large.join(spread(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))))
        after = sum_of(edges)
        if after == before:
            return nodes.select("id").distinct().join(edges.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        before = after
