"""Source-tree scans and changed-path handling."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.schema import slashed

#: Folders that a full scan skips anywhere, those it skips at the root, and languages by extension.
IGNORED, IGNORED_ROOT = ("node_modules", "dist", ".git", "coverage"), ("worktrees", ".worktrees")
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "cs": "csharp"}


def language_of(path):
    """Column: language by extension, else unknown."""
    ext, out = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)), F.lit("unknown")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def scan(spark: SparkSession, repo: str, languages: list[str] | None = None, changed: list[str] | None = None) -> DataFrame:
    """(relative_path, language, content_hash, content); with changed only those files that exist, none for an empty list."""
    root = repo.rstrip("/")
    schema = "relative_path string, language string, content_hash string, content string"
    if changed is not None:
        paths = [p for c in normal_changes(root, changed) if os.path.isfile(p := f"{root}/{c}")]
        if not paths:
            return spark.createDataFrame([], schema)
        files = spark.read.format("binaryFile").load(paths)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ts,tsx,js,jsx,cs}").load(root)
    # Spark gives a URI with a scheme; what follows the root's own path is the relative one.
    rel = F.url_decode(F.regexp_replace(F.substring_index(F.col("path"), root.split(":", 1)[-1].rstrip("/") + "/", -1), r"\+", "%2B"))
    rows = files.select(rel.alias("relative_path"), F.decode("content", "UTF-8").alias("content"))
    if changed is None:
        parts = F.split("relative_path", "/")
        rows = rows.filter(~F.arrays_overlap(parts, F.array(*(F.lit(i) for i in IGNORED))) & ~parts[0].isin(*IGNORED_ROOT) & ~F.exists(parts, lambda p: p.startswith(".")))
    rows = rows.withColumn("language", language_of(F.col("relative_path"))).withColumn("content_hash", F.sha2("content", 256))
    return rows.filter(F.col("language").isin(list(languages or dict.fromkeys(LANGUAGES.values())))).select("relative_path", "language", "content_hash", "content")


def normal_changes(repo: str, paths: list[str]) -> list[str]:
    """Relative paths inside the repository, first seen first; blank, outside and ignored ones fall."""
    root, out = posixpath.normpath(slashed(repo)), []
    for p in paths:
        p = slashed(p.strip())
        if not p:
            continue
        full = posixpath.normpath(p if p.startswith("/") else f"{root}/{p}")
        if not full.startswith(f"{root}/"):
            continue
        rel = full[len(root) + 1 :]
        if rel.split("/")[0] not in (*IGNORED, *IGNORED_ROOT) and rel not in out:
            out.append(rel)
    return out
