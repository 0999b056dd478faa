"""Aggregations, dedupe rules and the viewer's rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphloom.functions.exprs import module_key, weight
from graphloom.operators.frames import dealt, handed, pinned
from graphloom.schema import allowed


def first_edges(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """One edge per (type, src, dst, file_path, line): the first by seq; null and empty path, null and no line are one."""
    # dealt by src and a 16th of dst, equal edges meet, neighbours stay together and hubs are split; no sort before that
    key = ["type", "src", "share", "dst", F.coalesce("file_path", F.lit("")), F.coalesce("line", F.lit(0))]
    met = dealt(edges.withColumn("share", F.pmod(F.xxhash64("dst"), F.lit(16))), "src", "share")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(seq))).filter("rank = 1").drop("rank", "share")


def merged_nodes(nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """One node per id: of every column the last value by seq that is not null; metadata maps are laid over one another, later ones on top."""
    plain = [c for c in nodes.columns if c not in ("id", "metadata", seq)]
    out = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in plain]
    if "metadata" in nodes.columns:
        entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.map_entries("metadata").alias("m")))), lambda x: x["m"]))
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        out.append(F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))).alias("metadata"))
    return nodes.groupBy("id").agg(*out)


def degrees(edges: DataFrame, structural: bool = False, weighted: bool = False) -> DataFrame:
    """(id, degree) over both ends; a loop counts twice."""
    one = weight(F.col("type")) if weighted else F.lit(1)
    e = edges.filter(F.col("type").isin(*allowed(structural)))
    both = e.select(F.explode(F.array("src", "dst")).alias("id"), one.alias("w"))
    return both.groupBy("id").agg(F.sum("w").alias("degree"))


def module_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_module, dst_module, type, weight): edges between first path segments."""
    at = nodes.select("id", module_key(F.col("file_path")).alias("m"))
    s, t = at.select(F.col("id").alias("src"), F.col("m").alias("src_module")), at.select(F.col("id").alias("dst"), F.col("m").alias("dst_module"))
    return edges.join(s, "src").join(t, "dst").filter("src_module <> dst_module").groupBy("src_module", "dst_module", "type").agg(F.count(F.lit(1)).alias("weight"))


def upserted(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, changed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The graph after an update: what lay in changed(file_path) files goes, with edges at either end of a node that went;
    then nodes are replaced by id and edges by their five-part key, and edges without a stored end fall. None or an empty
    list of files removes nothing."""
    cols, ecols = nodes.columns, edges.columns
    if changed is not None:
        gone = nodes.join(changed, "file_path", "left_semi").select("id")
        gone = handed(pinned(gone))
        nodes = nodes.join(changed, "file_path", "left_anti").select(cols)
        edges = edges.join(changed, "file_path", "left_anti").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(ecols)
    all_nodes = nodes.withColumn("seq", F.lit(0)).unionByName(new_nodes.select(cols).withColumn("seq", F.lit(1)))
    top = Window.partitionBy("id").orderBy(F.desc("seq"))
    all_nodes = all_nodes.withColumn("rank", F.row_number().over(top)).filter("rank = 1").select(cols)
    every = new_edges.select(ecols).withColumn("seq", F.lit(0)).unionByName(edges.withColumn("seq", F.lit(1))).filter("src is not null and dst is not null")
    missing = handed(pinned(every.select("src").unionByName(every.select(F.col("dst").alias("src"))).distinct().join(all_nodes.select(F.col("id").alias("src")), "src", "left_anti")))
    all_edges = first_edges(every.join(missing, "src", "left_anti").join(missing.withColumnRenamed("src", "dst"), "dst", "left_anti"))
    return all_nodes, all_edges.select(ecols)
