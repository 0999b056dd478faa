"""Helpers shared by the graph operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.exprs import collated


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster must name it."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
    if not held.isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this session wrote."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def pinned(df: DataFrame) -> DataFrame:
    """df, computed and cut from its lineage in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df with its partitioning forgotten and its rows left where they are, so that a join after it shuffles this side anew and adaptive execution may split a skewed key."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Most rows of ids that are broadcast.
FEW = 500_000


def handed(df: DataFrame) -> DataFrame:
    """A pinned or small frame of ids for a join: broadcast if it has few rows, so that the other side stays where it is, else spread."""
    return F.broadcast(df) if df.count() <= FEW else spread(df)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns into as many partitions as it reads files, at least the session's number."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(df.inputFiles())), *by)


def ids(spark: SparkSession, values: list[str]) -> DataFrame:
    """A literal table of ids; made by SQL, so no Python worker is needed."""
    return spark.range(1).select(F.explode(F.array(*(F.lit(v) for v in values)).cast("array<string>")).alias("id"))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page in a total order; Spark plans it as a distributed top-k."""
    return df.orderBy(*order).offset(offset).limit(limit)


def by_id(c: str = "id"):
    return collated(F.col(c))
