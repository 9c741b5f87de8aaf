"""Graph queries over an edge table, by bounded rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def distances(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, distance up to ``depth`` - 1. edges: source, target; starts: start.

    A round joins the frontier with the edges and leaves out what is known; the frontier is distinct, so a node is
    expanded once for each start.
    """
    known = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance"))
    frontier = known
    for k in range(1, depth):
        step = frontier.join(edges.select(F.col("source").alias("node"), F.col("target").alias("next")), "node").select("start", F.col("next").alias("node")).distinct()
        frontier = step.join(known, ["start", "node"], "left_anti").withColumn("distance", F.lit(k))
        known = known.unionByName(frontier)
    return known


def callees(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """start, source, target, depth: the edges that leave nodes nearer than ``depth``."""
    return distances(edges, starts, depth).join(edges, F.col("node") == F.col("source")).select("start", "source", "target", (F.col("distance") + 1).alias("depth")).distinct()


def callers(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return callees(back, starts, depth).select("start", F.col("target").alias("source"), F.col("source").alias("target"), "depth")


def references(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges that come in to symbols. edges: source_file, source_symbol, target_symbol, relation, line; symbols: symbol."""
    wanted = ("call", "inherits", "uses_type", "reads", "writes")
    return edges.where(F.col("relation").isin(*wanted)).join(symbols, edges["target_symbol"] == symbols["symbol"]).select("symbol", "relation", "source_file", "source_symbol", "line")


def deps(edges: DataFrame, files: DataFrame) -> DataFrame:
    """What files import or include."""
    return edges.where("relation in ('import', 'include')").join(files, edges["source_file"] == files["file"]).select("file", "relation", F.col("target_symbol").alias("needs"))


def dependents(edges: DataFrame, files: DataFrame, by_name: bool = True) -> DataFrame:
    """Files that include a file: by base name, or (``by_name`` false) where the stem is all that the edge says."""
    key = tx.basename(F.col("target_symbol")) if by_name else F.col("target_symbol")
    own = tx.basename(F.col("file")) if by_name else tx.stem(F.col("file"))
    return edges.where("relation in ('import', 'include')").withColumn("k", key).join(files.withColumn("k", own), "k").select("file", "relation", F.col("source_file").alias("needed_by")).distinct()


def impact(edges: DataFrame, calls: DataFrame, starts: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """Direct callees, callers, needs and dependents of every start, numbered and cut at ``limit`` for each.

    starts: start (a symbol); files: start, file (where it is defined).
    """
    own = files.select("start", "file")
    parts = [
        callees(calls, starts, 1).select("start", F.lit(0).alias("part"), F.col("target").alias("item")),
        callers(calls, starts, 1).select("start", F.lit(1).alias("part"), F.col("source").alias("item")),
        deps(edges, own.select("file").distinct()).join(own, "file").select("start", F.lit(2).alias("part"), F.col("needs").alias("item")),
        dependents(edges, own.select("file").distinct()).join(own, "file").select("start", F.lit(3).alias("part"), F.col("needed_by").alias("item")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    from .retrieval import ranked

    return ranked(rows.distinct(), ["start"], ["part", "item"], limit)
