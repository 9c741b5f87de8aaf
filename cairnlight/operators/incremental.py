"""Incremental scans and merges as joins of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """path, status: new, unchanged, touched (another stamp, equal content), changed or vanished."""
    c = candidates.select("path", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.col("hash").alias("h1"))
    k = known.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.col("hash").alias("h0"))
    status = (
        F.when(F.col("h0").isNull(), "new")
        .when(F.col("h1").isNull(), "vanished")
        .when((F.col("m0") == F.col("m1")) & (F.col("s0") == F.col("s1")), "unchanged")
        .when(F.col("h0") == F.col("h1"), "touched")
        .otherwise("changed")
    )
    return c.join(k, "path", "full_outer").select("path", status.alias("status"))


def merged(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of the base whose key the fresh rows don't bring, and the fresh rows."""
    return base.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def pruned(rows: DataFrame, vanished: DataFrame, key: str) -> DataFrame:
    return rows.join(vanished.select(key).distinct(), key, "left_anti")


def of_generation(known: DataFrame, stored: int, current: int) -> DataFrame:
    """Fingerprints of an older generation count for nothing."""
    return known if stored == current else known.limit(0)


def compile_plan(stamps: DataFrame, existing: DataFrame) -> DataFrame:
    """source, action: rebuild, removed or skip. stamps, existing: source, mtime."""
    both = stamps.select("source", F.col("mtime").alias("now")).join(existing.select("source", F.col("mtime").alias("then")), "source", "full_outer")
    return both.select("source", F.when(F.col("now").isNull(), "removed").when(F.col("then").isNull() | (F.col("now") != F.col("then")), "rebuild").otherwise("skip").alias("action"))


def first_library(candidates: DataFrame) -> DataFrame:
    """name, tier: the existing candidate of smallest priority. candidates: name, tier, priority, present."""
    return candidates.where("present").groupBy("name").agg(F.min_by("tier", "priority").alias("tier"))
