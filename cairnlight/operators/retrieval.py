"""Recall routes, their fusion and what follows it. Queries come as rows, so a batch of them is one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import products

# Fixed values of ranking.
RRF_K = 60
WEIGHTS = {"bm25": 1.0, "symbol": 2.0, "graph": 0.6, "vector": 0.8}
MIN_COSINE = 0.18
NEIGHBOURS, PER_FILE = 40, 60


def ranked(rows: DataFrame, by: list[str], order: list, limit: int | None = None) -> DataFrame:
    """``rank`` from 1 within each key; with a limit Spark drops rows before the shuffle (window group limit)."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col("rank") <= limit) if limit else out


def visible(nodes: DataFrame) -> DataFrame:
    """library, node_id of what a search may show."""
    return nodes.where("status in ('accepted', 'degraded')").select("library", "node_id")


def merged(parts: list[DataFrame], by: list[str], limit: int) -> DataFrame:
    """The best of all tasks' best rows."""
    return ranked(reduce(DataFrame.unionByName, parts), by, [F.desc("score"), F.asc_nulls_last("node_id")], limit)


def text_routes(docs: DataFrame, queries: DataFrame, limit: int, nodes: DataFrame | None = None, hits: bool = True) -> dict[str, DataFrame]:
    """Two routes by terms: "bm25", and "symbol", which counts distinct shared words, as units cite symbols.

    query_id, library, node_id, score, rank. docs: library, node_id, text; queries: query_id, query. Statistics cover
    every row, also where ``nodes`` says which are ranked. A term that a query says twice counts twice in bm25.
    """
    blocks = [products.Postings(docs, block) for block in products.in_blocks(queries)]
    out = {"bm25": merged([p.bm25(limit, nodes) for p in blocks], ["query_id", "library"], limit)}
    if hits:
        out["symbol"] = merged([p.hits(limit, nodes) for p in blocks], ["query_id", "library"], limit)
    return out


def bm25(docs: DataFrame, queries: DataFrame, limit: int, nodes: DataFrame | None = None) -> DataFrame:
    """The route by BM25: query_id, library, node_id, score, rank."""
    return text_routes(docs, queries, limit, nodes, hits=False)["bm25"]


def by_count(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, node_id, hits, rank: every row counts."""
    return ranked(hits.groupBy("query_id", "node_id").agg(F.count("*").alias("hits")), ["query_id"], [F.desc("hits"), "node_id"], limit)


def symbol_route(refs: DataFrame, asked: DataFrame, limit: int | None = None) -> DataFrame:
    """Units that cite a query's symbols. refs: node_id, symbol; asked: query_id, symbol."""
    return by_count(refs.join(asked, "symbol"), limit)


def query_symbols(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Terms of the queries (as written) that are symbols."""
    known = symbols.select(F.explode(F.array("name", "qualified_name")).alias("symbol")).distinct()
    words = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split("query", r"[^\p{L}\p{N}_]+", -1), lambda t: t != ""))).alias("symbol"))
    return words.join(known, "symbol", "left_semi")


def graph_route(refs: DataFrame, edges: DataFrame, symbols: DataFrame, asked: DataFrame, limit: int | None = None) -> DataFrame:
    """Units that cite neighbours of a query's symbols: over one edge, and in files that include or are included by theirs."""
    out = asked.join(edges.select(F.col("source_symbol").alias("symbol"), F.col("target_symbol").alias("near")), "symbol")
    into = asked.join(edges.select(F.col("target_symbol").alias("symbol"), F.col("source_symbol").alias("near")), "symbol")
    one = ranked(out.union(into).where("near <> ''").distinct(), ["query_id", "symbol"], ["near"], NEIGHBOURS).select("query_id", "near")
    homes = asked.join(symbols.where("role = 'definition'").select(F.col("name").alias("symbol"), "file"), "symbol").select("query_id", "file").distinct()
    links = edges.where("relation in ('include', 'import')").select("source_file", tx.basename(F.col("target_symbol")).alias("base"))
    keyed = homes.withColumn("base", tx.basename(F.col("file")))
    users = keyed.join(links, "base").select("query_id", F.col("source_file").alias("file"))
    used = homes.join(links, homes["file"] == links["source_file"]).select("query_id", links["base"])
    at = symbols.select("file", F.col("name").alias("near"), "line").withColumn("base", tx.basename(F.col("file")))
    in_users = users.distinct().join(at.drop("base"), "file")
    in_used = used.distinct().join(at, "base").drop("base")
    two = ranked(in_users.select("query_id", "file", "near", "line").unionByName(in_used.select("query_id", "file", "near", "line")).distinct(), ["query_id", "file"], ["line", "near"], PER_FILE).select("query_id", "near")
    near = one.union(two).distinct().withColumnRenamed("near", "symbol").join(asked, ["query_id", "symbol"], "left_anti")
    return by_count(refs.join(near, "symbol"), limit)


def vector_route(vectors: DataFrame, queries: DataFrame, limit: int, least: float = MIN_COSINE) -> DataFrame:
    """query_id, node_id, score, rank by cosine. vectors: node_id, vector; queries: query_id, vector.

    A set of queries against all vectors, as products of blocks; only the best of a task are rows.
    """
    return merged([products.nearest(vectors, block, limit, least) for block in products.in_blocks(queries)], ["query_id"], limit)


def fused(routes: dict[str, DataFrame], weights: dict[str, float] = WEIGHTS, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: query_id, library, node_id, score, routes (names, sorted), rank."""
    rows = reduce(DataFrame.unionByName, [r.select("query_id", "library", "node_id", "rank").withColumn("route", F.lit(name)).withColumn("part", F.lit(weights[name]) / (RRF_K + F.col("rank"))) for name, r in routes.items()])
    scored = rows.groupBy("query_id", "library", "node_id").agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("route")), ",").alias("routes"))
    return ranked(scored, ["query_id"], [F.desc("score"), F.asc_nulls_last("library"), F.asc_nulls_last("node_id")], limit)


def context_graded(applies: Column, excludes: Column, context: Column) -> Column:
    """Multiplier and badge of a lesson for a declared context."""
    said = lambda m, b: F.struct(F.lit(m).alias("multiplier"), F.lit(b).cast("string").alias("badge"))
    return (
        F.when(F.size(context) == 0, said(1.0, None))
        .when(F.arrays_overlap(excludes, context), said(0.5, "excluded"))
        .when(F.arrays_overlap(applies, context), said(1.25, "match"))
        .when(F.size(applies) > 0, said(0.85, "mismatch"))
        .otherwise(said(1.0, None))
    )


def hash_features(docs: DataFrame, dim: int = 1024) -> DataFrame:
    """node_id, bucket, value of the signed, normalised n-gram vector: words, word pairs and 4-grams of characters.

    Buckets and signs come from md5, so that any engine can make the same vector.
    """
    base = docs.select("node_id", tx.query_terms(F.col("text")).alias("w"))
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 3), lambda i: F.concat(F.lit("c:"), F.substr(t, i, F.lit(4))))
    words = base.select("node_id", F.explode(F.transform("w", lambda t: F.concat(F.lit("w:"), t))).alias("f"), F.lit(1.0).alias("weight"))
    pairs = base.where("size(w) > 1").select("node_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.lit("b:"), F.get("w", i), F.lit(" "), F.get("w", i + 1)))).alias("f"), F.lit(0.7).alias("weight"))
    chars = base.select("node_id", F.explode(F.flatten(F.transform(F.filter("w", lambda t: F.length(t) >= 4), grams))).alias("f"), F.lit(0.35).alias("weight"))
    rows = words.unionByName(pairs).unionByName(chars).withColumn("h", F.md5("f"))
    bucket = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dim).alias("bucket")
    sign = F.when(F.conv(F.substring("h", 9, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    sums = rows.select("node_id", bucket, (sign * F.col("weight")).alias("v")).groupBy("node_id", "bucket").agg(F.sum("v").alias("v"))
    norm = sums.groupBy("node_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norm, "node_id").where("norm > 0").select("node_id", "bucket", F.round(F.col("v") / F.col("norm"), 6).alias("value"))


def refresh_plan(current: DataFrame, stored: DataFrame, model: str, dim: int) -> DataFrame:
    """node_id, action: embed what is new or changed, prune what is gone or of another model; unchanged rows are left out."""
    want = current.select("node_id", F.col("content_hash").alias("want"))
    have = stored.select("node_id", F.col("content_hash").alias("have"), ((F.col("model") == model) & (F.col("dim") == dim)).alias("fits"))
    both = want.join(have, "node_id", "full_outer")
    action = F.when(F.col("want").isNull(), "prune").when(F.col("have").isNull(), "embed").when(~F.col("fits") | (F.col("want") != F.col("have")), "re-embed")
    return both.select("node_id", action.alias("action")).where("action is not null")


def located(symbols: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Symbols whose name or qualified name is, or holds, the text; exact ones first."""
    like = f"%{text}%"
    exact = (F.col("name") == text) | (F.col("qualified_name") == text)
    order = [F.when(exact, 0).otherwise(1), F.when(F.col("role") == "definition", 0).otherwise(1), F.when(F.col("kind") == "class", 0).when(F.col("kind") == "struct", 1).otherwise(2), "file", "line"]
    return symbols.where(exact | F.col("name").ilike(like) | F.col("qualified_name").ilike(like)).orderBy(*order).limit(limit)


# What a granularity asks for.
SCOPES = {"overview": ("project", "domain", "module"), "unit": ("module", "feature", "file", "lesson"), "section": ("section",), "detail": ("subsection",)}


def searched(fusion: DataFrame, nodes: DataFrame, scope: str | None, limit: int) -> DataFrame:
    """Fused hits that are visible, in scope, re-scored (``multiplier`` of the nodes) and stably sorted.

    Routes must have left out invisible rows (``nodes``) before they were cut, or these use up the places.
    """
    rows = fusion.join(nodes.where("status in ('accepted', 'degraded')"), ["library", "node_id"])
    if scope:
        rows = rows.where(F.col("scope").isin(*SCOPES[scope]))
    rows = rows.withColumn("final", F.round(F.col("score") * F.col("multiplier"), 9)).withColumnRenamed("rank", "fused_rank")
    return ranked(rows, ["query_id"], [F.desc("final"), "fused_rank"], limit)
