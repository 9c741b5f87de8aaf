"""Evidence packets: verification against the current code, grading and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SUBSTANTIAL, RESOLVED_REFS = 200, 3
ACTIONS = {"sufficient": "proceed_with_evidence", "partial": "proceed_with_caveats", "insufficient": "fallback_to_source"}


def verified(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """Claims with their verification. resolved: symbol, resolved_file."""
    rows = claims.join(resolved.select("symbol", "resolved_file").distinct(), "symbol", "left")
    verdict = F.when(F.col("file").isNull() | F.col("symbol").isNull(), "unverifiable").when(F.col("resolved_file").isNull(), "unresolved").when(F.col("resolved_file") == F.col("file"), "verified").otherwise("drift")
    return rows.withColumn("verification", verdict)


def counters(nodes: DataFrame, refs: DataFrame, claims: DataFrame) -> DataFrame:
    """One pass over references and one over claims for the counts that grading reads."""
    r = refs.groupBy("id").agg(F.count_if((F.col("ref_kind") == "evidence") & F.col("resolved")).alias("primary_resolved"), F.count_if("resolved").alias("resolved_refs"), F.count_if(~F.col("resolved")).alias("unresolved_refs"))
    extracted = F.col("source") == "extracted"
    c = claims.groupBy("id").agg(
        F.count("*").alias("claim_count"),
        F.count_if(extracted & (F.col("verification") == "verified")).alias("verified_claims"),
        F.count_if(F.col("verification").isin("drift", "unresolved")).alias("drifted_claims"),
        F.count_if(extracted & (F.col("verification") == "unverifiable")).alias("unverifiable_extracted"),
    )
    out = nodes.join(r, "id", "left").join(c, "id", "left")
    return out.fillna(0, ["primary_resolved", "resolved_refs", "unresolved_refs", "claim_count", "verified_claims", "drifted_claims", "unverifiable_extracted"])


def answerability() -> Column:
    """Level from columns status, mechanical, primary_resolved, resolved_refs, claim_count, verified_claims, content_chars."""
    grounded = (F.col("primary_resolved") >= 1) | (F.col("resolved_refs") >= RESOLVED_REFS) | (F.col("verified_claims") >= 1)
    substantial = F.col("content_chars") >= SUBSTANTIAL
    return (
        F.when(F.col("status") == "degraded", "insufficient")
        .when(grounded & ((F.col("claim_count") >= 1) | substantial | F.col("mechanical")), "sufficient")
        .when(substantial | (F.col("claim_count") >= 1) | (F.col("resolved_refs") >= 1), "partial")
        .otherwise("insufficient")
    )


def action(level: Column) -> Column:
    out = None
    for k, v in ACTIONS.items():
        out = F.when(level == k, v) if out is None else out.when(level == k, v)
    return out


def warning_codes() -> Column:
    """Codes of the conditions that hold, in order."""
    tests = (
        ("degraded", F.col("status") == "degraded"),
        ("unresolved-refs", F.col("unresolved_refs") > 0),
        ("no-primary-evidence", F.col("primary_resolved") == 0),
        ("no-claims", (F.col("claim_count") == 0) & ~F.col("mechanical")),
        ("drifted-claims", F.col("drifted_claims") > 0),
        ("unverifiable-claims", F.col("unverifiable_extracted") > 0),
    )
    return F.array_join(F.filter(F.array(*[F.when(t, c) for c, t in tests]), lambda x: x.isNotNull()), ",")


def ancestors(tree: DataFrame, depth: int = 8) -> DataFrame:
    """node, ancestor, distance for every node; the tree is no deeper than ``depth`` (headings have six levels)."""
    step = tree.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    up = tree.where("parent is not null").select(F.col("node").alias("ancestor"), F.col("parent").alias("above"))
    out, now = step, step
    for k in range(2, depth + 1):
        now = now.join(up, "ancestor").select("node", F.col("above").alias("ancestor"), F.lit(k).alias("distance"))
        out = out.unionByName(now)
    return out


def subtree(tree: DataFrame, depth: int = 8) -> DataFrame:
    """root, node: every node is in its own subtree."""
    own = tree.select(F.col("node").alias("root"), "node")
    return own.unionByName(ancestors(tree, depth).select(F.col("ancestor").alias("root"), "node"))
