"""A property graph over the star-schema tables; one SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators.frames import FEW, shared_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

CTES = """
geo AS (
  SELECT n_nationkey AS k, r_name, concat(r_name, '/', n_name) AS path, concat('file:', r_name, '/', n_name) AS fid
  FROM nation JOIN region ON n_regionkey = r_regionkey),
sup AS (
  SELECT s_suppkey AS k, concat('symbol:', path, '#', s_name, '@', CAST(s_suppkey AS VARCHAR(20))) AS id, s_name AS name, path, fid
  FROM supplier JOIN geo ON s_nationkey = geo.k),
cus AS (
  SELECT c_custkey AS k, concat('symbol:', path, '#', c_name, '@', CAST(c_custkey AS VARCHAR(20))) AS id, c_name AS name, path, fid, c_mktsegment AS seg
  FROM customer JOIN geo ON c_nationkey = geo.k),
nodes AS (
  SELECT concat('repo:', r_name) AS id, 'repository' AS kind, r_name AS name, CAST(NULL AS VARCHAR(255)) AS language, CAST(NULL AS VARCHAR(255)) AS file_path FROM region
  UNION ALL SELECT fid, 'file', path, 'csharp', path FROM geo
  UNION ALL SELECT id, 'symbol', name, 'csharp', path FROM sup
  UNION ALL SELECT id, 'symbol', name, 'csharp', path FROM cus
  UNION ALL SELECT DISTINCT concat('external:', p_brand), 'external', p_brand, CAST(NULL AS VARCHAR(255)), CAST(NULL AS VARCHAR(255)) FROM part
  UNION ALL SELECT DISTINCT concat('module:', c_mktsegment), 'module', c_mktsegment, CAST(NULL AS VARCHAR(255)), CAST(NULL AS VARCHAR(255)) FROM customer),
edges AS (
  SELECT 'contains' AS type, concat('repo:', r_name) AS src, fid AS dst, path AS file_path, CAST(NULL AS INT) AS line FROM geo
  UNION ALL SELECT 'defines', fid, id, path, CAST(k % 400 + 1 AS INT) FROM sup
  UNION ALL SELECT 'defines', fid, id, path, CAST(k % 400 + 1 AS INT) FROM cus
  UNION ALL SELECT DISTINCT 'imports', fid, concat('module:', seg), path, CAST(NULL AS INT) FROM cus
  UNION ALL SELECT DISTINCT 'calls', cus.id, sup.id, cus.path, CAST(o_orderkey % 500 + 1 AS INT)
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN cus ON cus.k = o_custkey JOIN sup ON sup.k = l_suppkey
  UNION ALL SELECT DISTINCT 'depends_on', sup.id, concat('external:', p_brand), sup.path, CAST(p_partkey % 300 + 1 AS INT)
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN sup ON sup.k = l_suppkey)
"""


def graph(spark: SparkSession, sf_dir: str, outs: tuple[str, ...] = ("nodes", "edges")) -> tuple[DataFrame, ...]:
    """(nodes, edges) of the tables below sf_dir, or other parts of the text, each a lazy plan over pruned scans."""
    body = CTES
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    named = ", ".join(f"{t} AS (SELECT * FROM {{{t}}})" for t in TABLES)
    return tuple(spark.sql(f"WITH {named}, {body} SELECT * FROM {out}", **views) for out in outs)


#: Rows of a file of edges, and of edges read as one scan, so that a task of a scan meets few rows however well they compress.
FILE_ROWS, SCAN_ROWS = 1_000_000, 24_000_000


def edge_parts(spark: SparkSession, sf_dir: str, parts: int) -> list[DataFrame]:
    """The edges, laid out to be written. Calls and depends_on are made distinct by their keys, before these become text:
    an id ends with its key, so equal rows have equal keys. Without an id that does not hold, and the text is run as it is."""
    edges, cus, sup = graph(spark, sf_dir, ("edges", "cus", "sup"))
    if not cus.select("id").unionByName(sup.select("id")).filter("id IS NULL").isEmpty():
        return [edges.repartitionByRange(parts, "type", "src", "dst").sortWithinPartitions("type", "src")]
    few = edges.filter("type NOT IN ('calls', 'depends_on')").repartitionByRange(parts, "type", "src", "dst").sortWithinPartitions("type", "src")
    item, orders, part, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part", "supplier"))
    cus = cus.select(F.col("k").alias("ck"), F.col("id").alias("src"), F.col("path").alias("file_path")).distinct()
    sup = sup.select("k", "id", "path").distinct()
    sup = F.broadcast(sup) if supplier.count() <= FEW else sup
    sold = item.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("ck"), F.col("l_suppkey").alias("k"), F.expr("CAST(o_orderkey % 500 + 1 AS INT)").alias("line"))
    calls = sold.repartition(parts, "ck").distinct().join(cus, "ck").join(sup.select("k", F.col("id").alias("dst")).distinct(), "k").select(F.lit("calls").alias("type"), "src", "dst", "file_path", "line")
    made = item.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("k"), "p_brand", F.expr("CAST(p_partkey % 300 + 1 AS INT)").alias("line"))
    depends = made.repartition(parts, "k", "line").distinct().join(sup, "k").select(F.lit("depends_on").alias("type"), F.col("id").alias("src"), F.concat(F.lit("external:"), "p_brand").alias("dst"), F.col("path").alias("file_path"), "line")
    return [few, *(e.sortWithinPartitions("src", "dst") for e in (calls, depends))]


_STORED: dict[tuple, tuple[str, list[list[str]]]] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """(path, length, time of change) of the files of a table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """graph(), written once per session and state of the tables and read lazily: edges lie in a folder per type, sorted by
    src within files of bounded rows, nodes in ranges of name, so filters on them prune files and row groups."""
    key = (spark.sparkContext.applicationId, *(_state(spark, f"{sf_dir}/{t}.parquet") for t in TABLES))
    if key not in _STORED:
        base = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
        (nodes,) = graph(spark, sf_dir, ("nodes",))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
        nodes.repartitionByRange(parts, "name", "id").sortWithinPartitions("name").write.parquet(f"{base}/nodes")
        for edges in edge_parts(spark, sf_dir, max(parts, rows // FILE_ROWS)):
            edges.write.partitionBy("type").mode("append").parquet(f"{base}/edges")
        files = [f for folder, *_ in _state(spark, f"{base}/edges") if "/type=" in folder for f, *_ in _state(spark, folder) if f.endswith(".parquet")]
        scans = 1 + 2 * rows // SCAN_ROWS
        _STORED[key] = base, [files[k::scans] for k in range(scans)] if scans > 1 else []
    base, groups = _STORED[key]
    found = [spark.read.option("basePath", f"{base}/edges").parquet(*g) for g in groups if g] or [spark.read.parquet(f"{base}/edges")]
    return spark.read.parquet(f"{base}/nodes"), reduce(DataFrame.unionByName, found).select("type", "src", "dst", "file_path", "line")
