"""Versioned snapshots of the graph: Parquet per version and a numbered pointer file that appears last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators.queries import Graph
from graphloom.operators.rollup import upserted


class Store:
    """A graph below a path on any file system that Spark reaches.

    A version becomes visible by one rename to a pointer file with the next number; pointers are never removed or
    overwritten, and readers take the highest one, so they see a whole version or the one before at any moment.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        top, fs = self._fs("versions")
        return sorted(f.getPath().getName() for f in fs.listStatus(top) if f.getPath().getName().isdigit()) if fs.exists(top) else []

    def version(self) -> str | None:
        found = self._pointers()
        return json.loads(self.spark.read.text(f"{self.path}/versions/{found[-1]}").first()[0])["version"] if found else None

    def _point(self, version: str) -> None:
        new, fs = self._fs(f"versions/.{version}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"version": version}).encode()))
        out.close()
        found = self._pointers()
        to, _ = self._fs(f"versions/{int(found[-1]) + 1 if found else 1:012d}")
        if fs.exists(to) or not fs.rename(new, to):
            raise RuntimeError("another writer took this version's number; write again")

    def read(self) -> tuple[DataFrame, DataFrame]:
        v = self.version()
        if v is None:
            raise FileNotFoundError(self.path)
        return tuple(self.spark.read.parquet(f"{self.path}/{v}/{t}") for t in ("nodes", "edges"))  # type: ignore[return-value]

    def write(self, nodes: DataFrame, edges: DataFrame, changed: list[str] | None = None) -> str:
        """Replaces the graph, or with changed files updates it; nodes, edges and clusters appear under one version."""
        if changed is not None and self.version() is not None:
            old_nodes, old_edges = self.read()
            paths = self.spark.range(1).select(F.explode(F.array(*(F.lit(c) for c in changed)).cast("array<string>")).alias("file_path")) if changed else None
            nodes, edges = upserted(old_nodes, old_edges, nodes, edges, paths)
        v = uuid.uuid4().hex
        nodes.write.parquet(f"{self.path}/{v}/nodes")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        edges.repartitionByRange(parts, "type", "src", "dst").write.parquet(f"{self.path}/{v}/edges")
        found, members = Graph(*(self.spark.read.parquet(f"{self.path}/{v}/{t}") for t in ("nodes", "edges"))).clusters()
        found.write.parquet(f"{self.path}/{v}/clusters")
        members.write.parquet(f"{self.path}/{v}/members")
        self._point(v)
        return v
