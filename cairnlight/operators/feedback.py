"""Verdicts of agents on units, and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEMOTE_STREAK, GRADUATION_STREAK, DEAD_BAND = 2, 3, 0.005
WARNING_VERDICTS = ("partial", "wrong", "stale")


def streaks(feedback: DataFrame) -> DataFrame:
    """node_id, outcome, streak: the latest verdict and how many of it stand in a row. feedback: id, node_id, verdict.

    A null verdict is an outcome like any other. Two aggregates with map-side combine instead of a window, so a node with most of the rows costs no task its memory.
    """
    last = feedback.groupBy("node_id").agg(F.max_by("verdict", "id").alias("outcome"))
    rows = feedback.join(last, "node_id")
    broken = rows.groupBy("node_id").agg(F.coalesce(F.max(F.when(~F.col("verdict").eqNullSafe(F.col("outcome")), F.col("id"))), F.lit(-1)).alias("since"))
    return rows.join(broken, "node_id").where("id > since").groupBy("node_id", "outcome").agg(F.count("*").alias("streak"))


def latest(feedback: DataFrame, library: str | None = None) -> DataFrame:
    """The latest row of every node; a row without library fits any."""
    rows = feedback if library is None else feedback.where((F.col("library") == library) | F.col("library").isNull())
    return rows.groupBy("node_id").agg(F.max("id").alias("id"), F.max_by("verdict", "id").alias("verdict"))


def histogram(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("verdict").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "verdict")


def demoted(hits: DataFrame, feedback: DataFrame, failed: str = "applied-failed") -> DataFrame:
    """Scores of hits, halved where a node's latest verdicts are failures in a row."""
    bad = streaks(feedback).where((F.col("outcome") == failed) & (F.col("streak") >= DEMOTE_STREAK)).select("node_id", F.lit(0.5).alias("factor"))
    return hits.join(bad, "node_id", "left").withColumn("final", F.round(F.col("score") * F.coalesce("factor", F.lit(1.0)), 6)).drop("factor")


def metrics(outcomes: DataFrame, k: int) -> DataFrame:
    """n, hit_at_1, hit_at_k, mrr. outcomes: query, rank (null where nothing was found)."""
    n = F.greatest(F.count("*"), F.lit(1))
    within = F.col("rank") <= k
    return outcomes.agg(
        F.count("*").alias("n"),
        F.round(F.count_if(F.col("rank") == 1) / n, 6).alias("hit_at_1"),
        F.round(F.count_if(within) / n, 6).alias("hit_at_k"),
        F.round(F.coalesce(F.sum(F.when(within, 1.0 / F.col("rank"))), F.lit(0.0)) / n, 6).alias("mrr"),
    )


def first_ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """query, rank of the first result whose file ends in an expected one. results: query, rank, file; expected: query, suffix.

    The base name is an equal key of both sides; the whole suffix is tested after the join.
    """
    base = lambda c: F.element_at(F.split(c, "/", -1), -1)
    hit = results.withColumn("base", base(F.col("file"))).join(expected.withColumn("base", base(F.col("suffix"))), ["query", "base"]).where("endswith(file, suffix)")
    first = hit.groupBy("query").agg(F.min("rank").alias("rank"))
    return expected.select("query").distinct().join(first, "query", "left")


def mrr_deltas(runs: DataFrame) -> DataFrame:
    """run, mrr, delta, verdict against the run before. There is a row for each run, so one ordered window is small."""
    before = F.lag("mrr").over(Window.orderBy("run"))
    delta = F.round(F.col("mrr") - F.col("before"), 6)
    return runs.withColumn("before", before).select("run", "mrr", delta.alias("delta"), F.when(delta.isNull(), "first").when(delta > DEAD_BAND, "improved").when(delta < -DEAD_BAND, "regressed").otherwise("steady").alias("verdict"))


def curated(capture: DataFrame, known: DataFrame, verdicts: DataFrame) -> DataFrame:
    """query, action: the latest capture of each query; refuted ones are skipped first, then known ones, else promoted.

    capture: ts, query, file, line (its place in the log: of captures of one time the first counts); known: query;
    verdicts: query, refuted.
    """
    last = capture.groupBy("query").agg(F.max_by("file", F.struct("ts", -F.col("line"))).alias("file"))
    refuted = verdicts.where("refuted").select("query", F.lit(True).alias("r")).distinct()
    rows = last.join(refuted, "query", "left").join(known.select("query", F.lit(True).alias("k")).distinct(), "query", "left")
    action = F.when(F.col("r"), "skipped-refuted").when(F.col("k"), "skipped-known").when(F.col("file").isNull(), "skipped-empty").otherwise("promoted")
    return rows.select("query", F.when(action == "promoted", F.col("file")).alias("file"), action.alias("action"))
