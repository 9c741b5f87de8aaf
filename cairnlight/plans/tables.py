"""Queries over the driver's tables, and the SQL that checks them. Every query runs over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import feedback as fb
from ..operators import graph, incremental, packets, reconcile, retrieval
from ..sources.readers import table


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("lang", F.col("lang").alias("library"), F.col("doc_id").alias("node_id"), F.coalesce("text", F.lit("")).alias("text"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(_nodes(spark, sf), _queries(spark, sf), 10).select("query_id", "library", "node_id", "score", "rank")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.explode(F.array_distinct(tx.query_terms(F.col("p_name")))).alias("symbol"))
    return words


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("node_id"), F.explode(tx.query_terms(F.col("p_name"))).alias("symbol"))


def symbol_route(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "part").select(F.col("p_brand").alias("query_id"), F.explode(tx.query_terms(F.col("p_name"))).alias("symbol")).distinct()
    return retrieval.symbol_route(_refs(spark, sf), asked, 10)


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))
    queries = vectors.where("node_id % 100 = 0").withColumnRenamed("node_id", "query_id")
    return retrieval.vector_route(vectors, queries, 10)


def _routes(spark: SparkSession, sf: str, visible: DataFrame | None = None) -> dict[str, DataFrame]:
    return retrieval.text_routes(_nodes(spark, sf), _queries(spark, sf), 40, visible)


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.fused(_routes(spark, sf), limit=40).select("query_id", "library", "node_id", "score", "routes", "rank")


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Routes over what is visible by its quality label, their fusion, scope by size, re-scoring by toxicity, the ten best."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.col("lang").alias("library")).join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 0, "quarantined").when(F.col("quality").isNull(), "degraded").otherwise("accepted")
    scope = F.when(F.col("n_chars") < 1000, "section").when(F.col("n_chars") < 4000, "feature").otherwise("module")
    nodes = docs.select("library", F.col("doc_id").alias("node_id"), status.alias("status"), scope.alias("scope"), F.when(F.col("toxic") == 1, 0.5).otherwise(1.0).alias("multiplier"))
    out = retrieval.searched(retrieval.fused(_routes(spark, sf, retrieval.visible(nodes)), limit=40), nodes, "unit", 10)
    return out.select("query_id", "library", "node_id", "status", "scope", "final", "rank")


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hash_features(table(spark, sf, "benchmark").select(F.col("item_id").alias("node_id"), "text"))


def embedding_refresh(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    now = docs.where("lang <> 'es'").select(F.col("doc_id").alias("node_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    then = docs.where("lang <> 'de'").select(F.col("doc_id").alias("node_id"), F.sha2(F.when(F.col("source") == "src1", F.concat("text", F.lit("!"))).otherwise(F.coalesce("text", F.lit(""))), 256).alias("content_hash"), F.when(F.col("source") == "src2", "old").otherwise("hash").alias("model"), F.lit(1024).alias("dim"))
    return retrieval.refresh_plan(now, then, "hash", 1024)


def context_grading(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") >= 50, F.col("event_type"))).alias("applies"), F.collect_set(F.when(F.col("value") < 5, F.col("event_type"))).alias("excludes"))
    g = retrieval.context_graded(F.col("applies"), F.col("excludes"), F.array(F.lit("purchase"), F.lit("error")))
    return per.select("user_id", g.alias("g")).select("user_id", "g.multiplier", "g.badge")


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_name").alias("name"), F.concat_ws("::", "p_brand", "p_name").alias("qualified_name"), F.when(F.col("p_size") < 15, "class").when(F.col("p_size") < 30, "struct").otherwise("function").alias("kind"), F.col("p_type").alias("language"), F.concat_ws("/", "p_brand", "p_type").alias("file"), F.col("p_partkey").alias("line"), F.when(F.col("p_retailprice") > 950, "definition").otherwise("declaration").alias("role"))


def resolve_symbol_top1(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.code import symbol_keys

    return symbol_keys(_symbols(spark, sf))


def locate_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.located(_symbols(spark, sf), "an").select("name", "qualified_name", "kind", "file", "line", "role")


def file_histograms(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.code import file_nodes

    return file_nodes(_symbols(spark, sf))


def _key_edges(spark: SparkSession, sf: str) -> DataFrame:
    """customer -> nation -> region, supplier -> nation: string keys."""
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        table(spark, sf, "customer").select(named("c", "c_custkey").alias("source"), named("n", "c_nationkey").alias("target")),
        table(spark, sf, "supplier").select(named("s", "s_suppkey").alias("source"), named("n", "s_nationkey").alias("target")),
        table(spark, sf, "nation").select(named("n", "n_nationkey").alias("source"), named("r", "n_regionkey").alias("target")),
        table(spark, sf, "orders").select(named("o", "o_orderkey").alias("source"), named("c", "o_custkey").alias("target")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def callees_bfs(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("start"))
    return graph.callees(_key_edges(spark, sf), starts, 3)


def callers_bfs(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start"))
    return graph.callers(_key_edges(spark, sf), starts, 3).groupBy("start", "depth").agg(F.count("*").alias("edges"))


def hierarchy_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    tree = _key_edges(spark, sf).select(F.col("source").alias("node"), F.col("target").alias("parent"))
    return packets.ancestors(tree, 3).groupBy("ancestor", "distance").agg(F.count("*").alias("nodes"))


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "purchase", "applied-resolved").when(F.col("event_type") == "error", "applied-failed").when(F.col("event_type") == "click", "useful").otherwise("partial")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("node_id"), verdict.alias("verdict"), F.col("event_type").alias("library"))


def feedback_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return fb.streaks(_feedback(spark, sf))


def latest_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return fb.latest(_feedback(spark, sf))


def verdict_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return fb.histogram(_feedback(spark, sf))


def guard_demotion(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "events").groupBy(F.col("user_id").alias("node_id")).agg(F.round(F.avg("value"), 4).alias("score"))
    return fb.demoted(hits, _feedback(spark, sf)).select("node_id", "score", "final")


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Do the items' own documents come back? Expected are documents that hold an item's whole text."""
    found = retrieval.bm25(_nodes(spark, sf).withColumn("library", F.lit("all")), _queries(spark, sf), 5)
    asked = found.join(_queries(spark, sf), "query_id")
    # five rows a query: the texts stay where they are
    texts = _nodes(spark, sf).select("node_id", "text").join(F.broadcast(asked), "node_id")
    first = texts.where("contains(text, query)").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return fb.metrics(_queries(spark, sf).select(F.col("query_id").alias("query")).join(first.withColumnRenamed("query_id", "query"), "query", "left"), 5)


def mrr_deltas(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 6).alias("mrr"))
    return fb.mrr_deltas(runs)


def eval_curate(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    capture = orders.select(F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("query"), F.col("o_orderkey").cast("string").alias("file"), F.col("o_orderkey").alias("line"))
    known = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("query"))
    verdicts = table(spark, sf, "customer").select(F.col("c_custkey").alias("query"), (F.col("c_acctbal") < 0).alias("refuted"))
    return fb.curated(capture, known, verdicts)


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.length("o_orderpriority").alias("size"), F.md5(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("hash"), "o_orderstatus")
    now = orders.where("o_orderstatus <> 'F'").drop("o_orderstatus")
    then = orders.where("o_orderstatus <> 'O'").select("path", F.when(F.col("size") > 6, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"), "size", F.when(F.col("size") > 8, F.lit("other")).otherwise(F.col("hash")).alias("hash"))
    return now, then


def fingerprint_status(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.fingerprints(*_snapshots(spark, sf))


def incremental_merge(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    fresh = orders.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0))
    return incremental.merged(orders, fresh, "o_orderkey")


def prune_missing(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return incremental.pruned(table(spark, sf, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


def compile_plan(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("mtime"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("mtime"))
    return incremental.compile_plan(s, c)


def library_precedence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("tier"), F.col("p_partkey").alias("priority"), (F.col("p_size") > 10).alias("present"))
    return incremental.first_library(rows)


def tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("name"))
    tags = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.split(F.col("p_type"), " ").alias("tags"))
    return reconcile.tag_included(items, tags, ["STANDARD", "PROMO"])


def tag_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.tag_stats(table(spark, sf, "part").select(F.when(F.col("p_size") > 25, "skill").otherwise("rule").alias("type"), F.array("p_brand", "p_type").alias("tags")))


def store_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("type"), F.col("c_mktsegment").alias("name")).where("name <> 'MACHINERY'")
    s = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("type"), F.col("c_mktsegment").alias("name"))
    return reconcile.store_diff(c, s)


def three_way_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    h = lambda c: F.md5(c.cast("string"))
    name = F.col("s_suppkey").alias("name")
    reasons = reconcile.skip_reason({"excluded": F.col("s_nationkey") == 3, "policy": F.col("s_acctbal") < 0})
    desired = s.where("s_nationkey < 18").select(name, h(F.col("s_nationkey")).alias("hash"), reasons.alias("reason"))
    existing = s.where("s_nationkey > 5").select(name, h(F.col("s_nationkey")).alias("hash"))
    owned = s.where("s_nationkey > 9").select(name, h(F.when(F.col("s_acctbal") > 5000, F.col("s_nationkey")).otherwise(F.lit(-1))).alias("hash"))
    return reconcile.three_way(desired, existing, owned)


def hook_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("event"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("command"))
    managed = n.where("pos > 12").select("event", "command")
    desired = n.where("pos > 18")
    return reconcile.hooks_after(n, managed, desired)


def fan_out_plan(spark: SparkSession, sf: str) -> DataFrame:
    tools = table(spark, sf, "nation").select(F.col("n_name").alias("tool"), (F.col("n_regionkey") != 2).alias("configured"), (F.col("n_nationkey") > 4).alias("installed"))
    return reconcile.fan_out(table(spark, sf, "region").select(F.col("r_name").alias("name")), tools, ["CHINA", "N7"])


def uninstall_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("tool"), F.col("p_name").alias("name"), F.col("p_name").like("%a%").alias("shared")).distinct()
    first = table(spark, sf, "part").agg(F.min("p_brand")).first()[0]
    return reconcile.uninstall_plan(rows, first)


def latest_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.latest_candidates(table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("path"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime")))


def folder_relation(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("root"), F.md5(F.coalesce("text", F.lit(""))).alias("rel"), F.col("lang").alias("hash"), "n_chars")
    left = d.where("n_chars < 3000").groupBy("root", "rel").agg(F.min("hash").alias("hash"))
    right = d.groupBy("root", "rel").agg(F.max("hash").alias("hash"))
    return reconcile.folder_relation(left, right)


def provenance_classify(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("name"), "source")
    return reconcile.provenance(d.select("name").distinct(), d.where("source = 'src0'"), d.where("source = 'src1'"), d.where("source in ('src2', 'src3')"))


def merge_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.merge_conflicts(table(spark, sf, "conversations").select(F.col("conv_id").alias("agent"), F.col("role").alias("field"), F.length("text").alias("value")))


def hook_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("event"), (F.col("user_id") > 75).cast("string").alias("matcher"))
    handlers = spark.createDataFrame([("click", "true", 2, "second"), ("click", "true", 1, "first"), ("error", "false", 1, None), ("error", "false", 3, "late"), ("view", "*", 1, "never")], "event string, matcher string, ordinal int, output string")
    return reconcile.dispatched(events, handlers)


def page_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", reconcile.host_of(F.col("url")).alias("host"), reconcile.host_allowed(F.col("url"), ["*.example.org", "m.ththth.example.net"]).alias("allowed"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages as import edges, with how often each target is linked."""
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


def thin_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The gate's thin-content and pronoun rules over documents, by language."""
    dense = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))
    opens = tx.trimmed(F.coalesce("text", F.lit(""))).rlike(tx.PRONOUN)
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(dense < 30).alias("thin"), F.count_if(opens).alias("pronoun"), F.sum(dense).alias("dense_chars"))


def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row of counts from five tables, each a partial aggregate."""
    counts = [table(spark, sf, n).agg(F.count("*").alias(n)) for n in ("documents", "embeddings", "pages", "conversations", "events")]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c)
    return out


def entry_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered entries as JSON and their short hashes."""
    entry = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("name"), entry.alias("entry"), reconcile.rendered_hash(entry).alias("hash16"))




QUERIES = {f.__name__: f for f in (hybrid_search, bm25_batch, symbol_route, vector_topk, rrf_fusion, hash_embed, embedding_refresh, context_grading, resolve_symbol_top1, locate_symbol, file_histograms, callees_bfs, callers_bfs, hierarchy_ancestors, feedback_streaks, latest_verdict, verdict_histogram, guard_demotion, eval_metrics, mrr_deltas, eval_curate, fingerprint_status, incremental_merge, prune_missing, compile_plan, library_precedence, tag_filter, tag_stats, store_diff, three_way_reconcile, hook_reconcile, fan_out_plan, uninstall_plan, latest_candidate, folder_relation, provenance_classify, merge_conflicts, hook_dispatch, page_hosts, page_links, thin_documents, status_summary, entry_hashes)}

_TERMS = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _bm25(library: str, limit: int, where: str = "") -> str:
    return f"""tok AS (SELECT {library} AS library, doc_id AS node_id, {_TERMS("coalesce(text, '')")} AS w FROM documents),
sz AS (SELECT library, node_id, len(w) AS dl FROM tok),
st AS (SELECT library, count(*) AS n, avg(dl) AS avgdl FROM sz GROUP BY library),
po AS (SELECT library, node_id, term, count(*) AS tf FROM (SELECT library, node_id, unnest(w) AS term FROM tok) q GROUP BY library, node_id, term),
df AS (SELECT library, term, count(*) AS df FROM po GROUP BY library, term),
qt AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_TERMS("text")}) AS term FROM benchmark) q GROUP BY item_id, term),
bs AS (SELECT query_id, po.library, po.node_id, round(sum(CASE WHEN ln((n - df + 0.5e0) / (df + 0.5e0)) > 0 THEN ln((n - df + 0.5e0) / (df + 0.5e0)) ELSE 1e-6 END * qf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
  FROM qt JOIN po USING (term) JOIN df ON df.library = po.library AND df.term = po.term JOIN st ON st.library = po.library JOIN sz ON sz.library = po.library AND sz.node_id = po.node_id {where} GROUP BY query_id, po.library, po.node_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, library ORDER BY score DESC, node_id) AS rank FROM bs) q WHERE rank <= {limit})"""


def _fused(visible: str | None = None) -> str:
    """Both routes and their fusion; ``visible``: a condition on po.node_id, for postings that count in no statistics."""
    where = f"WHERE {visible}" if visible else ""
    return _bm25("lang", 40, where) + f""",
sy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, library ORDER BY hits DESC, node_id) AS rank FROM (SELECT query_id, library, node_id, count(*) AS hits FROM po JOIN (SELECT DISTINCT query_id, term FROM qt) a USING (term) {where} GROUP BY query_id, library, node_id) q) z WHERE rank <= 40),
al AS (SELECT query_id, library, node_id, rank, 'bm25' AS route, 1e0 / (60 + rank) AS part FROM bm UNION ALL SELECT query_id, library, node_id, rank, 'symbol', 2e0 / (60 + rank) FROM sy),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, library, node_id) AS rank FROM (SELECT query_id, library, node_id, round(sum(part), 9) AS score, string_agg(route, ',' ORDER BY route) AS routes FROM al GROUP BY query_id, library, node_id) q) z WHERE rank <= 40)"""

_SYM = "sym AS (SELECT p_name AS name, p_brand || '::' || p_name AS qualified_name, CASE WHEN p_size < 15 THEN 'class' WHEN p_size < 30 THEN 'struct' ELSE 'function' END AS kind, p_brand || '/' || p_type AS file, p_partkey AS line, CASE WHEN p_retailprice > 950 THEN 'definition' ELSE 'declaration' END AS role FROM part)"
_EDGE = "e AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"
_FB = "fb AS (SELECT event_id AS id, user_id AS node_id, CASE event_type WHEN 'purchase' THEN 'applied-resolved' WHEN 'error' THEN 'applied-failed' WHEN 'click' THEN 'useful' ELSE 'partial' END AS verdict FROM events)"
_STREAK = _FB + ", la AS (SELECT node_id, arg_max(verdict, id) AS outcome FROM fb GROUP BY node_id), br AS (SELECT la.node_id, outcome, max(CASE WHEN verdict <> outcome THEN id END) AS since FROM la JOIN fb USING (node_id) GROUP BY la.node_id, outcome), sk AS (SELECT br.node_id, outcome, count(*) AS streak FROM br JOIN fb ON fb.node_id = br.node_id AND (since IS NULL OR id > since) GROUP BY br.node_id, outcome)"

ORACLES = {
    "bm25_batch": f"WITH {_bm25('lang', 10)} SELECT query_id, library, node_id, score, rank FROM bm",
    "rrf_fusion": f"WITH {_fused()} SELECT query_id, library, node_id, score, routes, rank FROM fu",
    "hybrid_search": f"""WITH {_fused("po.node_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 0)")}, lb AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
      nd AS (SELECT lang AS library, d.doc_id AS node_id, CASE WHEN quality = 0 THEN 'quarantined' WHEN quality IS NULL THEN 'degraded' ELSE 'accepted' END AS status, CASE WHEN n_chars < 1000 THEN 'section' WHEN n_chars < 4000 THEN 'feature' ELSE 'module' END AS scope, CASE WHEN toxic = 1 THEN 0.5e0 ELSE 1e0 END AS mul FROM documents d LEFT JOIN lb ON d.doc_id = lb.doc_id)
      SELECT query_id, library, node_id, status, scope, final, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, fr) AS rank FROM (SELECT query_id, fu.library, fu.node_id, status, scope, round(score * mul, 9) AS final, fu.rank AS fr FROM fu JOIN nd ON fu.library = nd.library AND fu.node_id = nd.node_id WHERE status <> 'quarantined' AND scope IN ('module', 'feature', 'file', 'lesson')) q) z WHERE rank <= 10""",
    "symbol_route": f"WITH r AS (SELECT p_brand || '/' || p_type AS node_id, unnest({_TERMS('p_name')}) AS symbol FROM part), a AS (SELECT DISTINCT p_brand AS query_id, unnest({_TERMS('p_name')}) AS symbol FROM part) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, node_id) AS rank FROM (SELECT query_id, node_id, count(*) AS hits FROM r JOIN a USING (symbol) GROUP BY query_id, node_id) q) z WHERE rank <= 10",
    "vector_topk": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS node_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s WHERE score >= 0.18e0) z WHERE rank <= 10",
    "hash_embed": f"""WITH t AS (SELECT item_id AS node_id, {_TERMS("text")} AS w FROM benchmark), o AS (SELECT node_id, w, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM t),
      c AS (SELECT node_id, x, unnest(generate_series(1, length(x) - 3)) AS j FROM o WHERE length(x) >= 4),
      f AS (SELECT node_id, 'w:' || x AS f, 1e0 AS wt FROM o UNION ALL SELECT node_id, 'b:' || x || ' ' || w[k + 1], 0.7e0 FROM o WHERE k < len(w) UNION ALL SELECT node_id, 'c:' || substr(x, j, 4), 0.35e0 FROM c),
      s AS (SELECT node_id, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) % 1024 AS bucket, sum(CASE WHEN substr(md5(f), 9, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN wt ELSE -wt END) AS v FROM f GROUP BY 1, 2),
      n AS (SELECT node_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY node_id)
      SELECT s.node_id, bucket, round(v / norm, 6) AS value FROM s JOIN n ON s.node_id = n.node_id WHERE norm > 0""",
    "embedding_refresh": """WITH a AS (SELECT doc_id AS node_id, sha256(coalesce(text, '')) AS want FROM documents WHERE lang <> 'es'), b AS (SELECT doc_id AS node_id, sha256(CASE WHEN source = 'src1' THEN text || '!' ELSE coalesce(text, '') END) AS have, source <> 'src2' AS fits FROM documents WHERE lang <> 'de')
      SELECT * FROM (SELECT coalesce(a.node_id, b.node_id) AS node_id, CASE WHEN want IS NULL THEN 'prune' WHEN have IS NULL THEN 'embed' WHEN NOT fits OR want <> have THEN 're-embed' END AS action FROM a FULL OUTER JOIN b ON a.node_id = b.node_id) q WHERE action IS NOT NULL""",
    "context_grading": """WITH p AS (SELECT user_id, bool_or(value >= 50) AS has_some, bool_or(value >= 50 AND event_type IN ('purchase', 'error')) AS hit, bool_or(value < 5 AND event_type IN ('purchase', 'error')) AS ex FROM events GROUP BY user_id)
      SELECT user_id, CASE WHEN ex THEN 0.5e0 WHEN hit THEN 1.25e0 WHEN has_some THEN 0.85e0 ELSE 1e0 END AS multiplier, CASE WHEN ex THEN 'excluded' WHEN hit THEN 'match' WHEN has_some THEN 'mismatch' END AS badge FROM p""",
    "resolve_symbol_top1": f"WITH {_SYM}, k AS (SELECT name AS key, role, kind, file, line FROM sym UNION SELECT qualified_name, role, kind, file, line FROM sym) SELECT key, file AS resolved_file, line AS resolved_line FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE role WHEN 'definition' THEN 0 ELSE 1 END, CASE kind WHEN 'class' THEN 0 WHEN 'struct' THEN 1 ELSE 2 END, file, line) AS rn FROM k) q WHERE rn = 1",
    "locate_symbol": f"WITH {_SYM} SELECT name, qualified_name, kind, file, line, role FROM sym WHERE name ILIKE '%an%' OR qualified_name ILIKE '%an%' ORDER BY CASE WHEN name = 'an' OR qualified_name = 'an' THEN 0 ELSE 1 END, CASE role WHEN 'definition' THEN 0 ELSE 1 END, CASE kind WHEN 'class' THEN 0 WHEN 'struct' THEN 1 ELSE 2 END, file, line LIMIT 50",
    "file_histograms": f"WITH {_SYM}, h AS (SELECT file, string_agg(n || ' ' || kind, ', ' ORDER BY kind) AS histogram, least(sum(n), 40) AS n_refs FROM (SELECT file, kind, count(*) AS n FROM sym GROUP BY file, kind) q GROUP BY file), t AS (SELECT file, string_agg(name, ', ' ORDER BY line, name) AS headline FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, name) AS k FROM sym WHERE kind IN ('class', 'struct')) q WHERE k <= 4 GROUP BY file) SELECT 'file:' || h.file AS id, regexp_extract(h.file, '([^/]*)$', 1) AS title, histogram, coalesce(headline, '') AS headline, CAST(n_refs AS BIGINT) AS n_refs FROM h LEFT JOIN t ON h.file = t.file",
    "callees_bfs": f"WITH RECURSIVE {_EDGE}, b(start, node, d) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey, 0 FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT b.start, e.target, b.d + 1 FROM b JOIN e ON b.node = e.source WHERE b.d < 2) SELECT DISTINCT start, source, target, CAST(d + 1 AS INTEGER) AS depth FROM (SELECT start, node, min(d) AS d FROM b GROUP BY start, node) q JOIN e ON q.node = e.source",
    "callers_bfs": f"WITH RECURSIVE {_EDGE}, b(start, node, d) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT b.start, e.source, b.d + 1 FROM b JOIN e ON b.node = e.target WHERE b.d < 2) SELECT start, depth, count(*) AS edges FROM (SELECT DISTINCT start, source, target, CAST(d + 1 AS INTEGER) AS depth FROM (SELECT start, node, min(d) AS d FROM b GROUP BY start, node) q JOIN e ON q.node = e.target) z GROUP BY start, depth",
    "hierarchy_ancestors": f"WITH RECURSIVE {_EDGE}, a(node, ancestor, distance) AS (SELECT source, target, 1 FROM e UNION ALL SELECT a.node, e.target, a.distance + 1 FROM a JOIN e ON a.ancestor = e.source WHERE a.distance < 3) SELECT ancestor, CAST(distance AS INTEGER) AS distance, count(*) AS nodes FROM a GROUP BY ancestor, distance",
    "feedback_streaks": f"WITH {_STREAK} SELECT * FROM sk",
    "latest_verdict": f"WITH {_FB} SELECT node_id, max(id) AS id, arg_max(verdict, id) AS verdict FROM fb GROUP BY node_id",
    "verdict_histogram": f"WITH {_FB} SELECT verdict, count(*) AS n FROM fb GROUP BY verdict",
    "guard_demotion": f"WITH {_STREAK}, h AS (SELECT user_id AS node_id, round(avg(value), 4) AS score FROM events GROUP BY user_id) SELECT h.node_id, score, round(score * CASE WHEN outcome = 'applied-failed' AND streak >= 2 THEN 0.5e0 ELSE 1e0 END, 6) AS final FROM h LEFT JOIN sk ON h.node_id = sk.node_id",
    "eval_metrics": f"""WITH {_bm25("'all'", 5)}, f AS (SELECT query_id, min(rank) AS rank FROM bm JOIN documents d ON d.doc_id = bm.node_id JOIN benchmark b ON b.item_id = bm.query_id WHERE contains(d.text, b.text) GROUP BY query_id)
      SELECT count(*) AS n, round(sum(CASE WHEN rank = 1 THEN 1e0 ELSE 0 END) / greatest(count(*), 1), 6) AS hit_at_1, round(sum(CASE WHEN rank <= 5 THEN 1e0 ELSE 0 END) / greatest(count(*), 1), 6) AS hit_at_k, round(sum(CASE WHEN rank <= 5 THEN 1e0 / rank ELSE 0 END) / greatest(count(*), 1), 6) AS mrr FROM benchmark LEFT JOIN f ON f.query_id = item_id""",
    "mrr_deltas": """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS run, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END), 6) AS mrr FROM orders GROUP BY 1), d AS (SELECT run, mrr, round(mrr - lag(mrr) OVER (ORDER BY run), 6) AS delta FROM r)
      SELECT run, mrr, delta, CASE WHEN delta IS NULL THEN 'first' WHEN delta > 0.005e0 THEN 'improved' WHEN delta < -0.005e0 THEN 'regressed' ELSE 'steady' END AS verdict FROM d""",
    "eval_curate": """WITH l AS (SELECT o_custkey AS query, CAST(o_orderkey AS VARCHAR) AS file FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) q WHERE rn = 1)
      SELECT query, CASE WHEN NOT (c_acctbal < 0) AND c_mktsegment <> 'BUILDING' OR c_custkey IS NULL THEN file END AS file, CASE WHEN c_acctbal < 0 THEN 'skipped-refuted' WHEN c_mktsegment = 'BUILDING' THEN 'skipped-known' ELSE 'promoted' END AS action FROM l LEFT JOIN customer ON c_custkey = query""",
    "fingerprint_status": """SELECT o_orderkey AS path, CASE WHEN o_orderstatus = 'F' THEN 'vanished' WHEN o_orderstatus = 'O' THEN 'new' WHEN length(o_orderpriority) <= 6 THEN 'unchanged' WHEN length(o_orderpriority) <= 8 THEN 'touched' ELSE 'changed' END AS status FROM orders""",
    "incremental_merge": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 0e0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders",
    "prune_missing": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')",
    "compile_plan": "SELECT coalesce(s_suppkey, c_custkey) AS source, CASE WHEN s_suppkey IS NULL THEN 'removed' WHEN c_custkey IS NULL OR s_nationkey <> c_nationkey THEN 'rebuild' ELSE 'skip' END AS action FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey",
    "library_precedence": "SELECT p_name AS name, arg_min(p_brand || '-' || p_partkey, p_partkey) AS tier FROM part WHERE p_size > 10 GROUP BY p_name",
    "tag_filter": "SELECT p_partkey AS name, list_has_any(string_split(p_type, ' '), ['STANDARD', 'PROMO']) AS included FROM part",
    "tag_stats": "SELECT tag, count(*) FILTER (WHERE type = 'skill') AS skills, count(*) FILTER (WHERE type = 'rule') AS rules FROM (SELECT CASE WHEN p_size > 25 THEN 'skill' ELSE 'rule' END AS type, p_brand AS tag FROM part UNION ALL SELECT CASE WHEN p_size > 25 THEN 'skill' ELSE 'rule' END, p_type FROM part) q GROUP BY tag",
    "store_diff": """WITH l AS (SELECT DISTINCT c_nationkey AS type, c_mktsegment AS name FROM customer WHERE c_mktsegment <> 'MACHINERY'), s AS (SELECT DISTINCT c_nationkey AS type, c_mktsegment AS name FROM customer WHERE c_acctbal > 5000)
      SELECT *, 'added' AS change FROM (SELECT * FROM l EXCEPT SELECT * FROM s) a UNION ALL SELECT *, 'removed' FROM (SELECT * FROM s EXCEPT SELECT * FROM l) b""",
    "three_way_reconcile": """WITH d AS (SELECT *, CASE WHEN s_nationkey < 18 THEN CASE WHEN s_nationkey = 3 THEN 'excluded' WHEN s_acctbal < 0 THEN 'policy' END END AS skip FROM supplier)
      SELECT * FROM (SELECT s_suppkey AS name, CASE WHEN s_nationkey < 18 AND skip IS NOT NULL THEN 'skipped' WHEN s_nationkey < 18 AND s_nationkey > 5 AND s_nationkey <= 9 THEN 'skipped' WHEN s_nationkey < 18 AND s_nationkey <= 5 THEN 'added' WHEN s_nationkey < 18 AND NOT (s_acctbal > 5000) THEN 'updated' WHEN s_nationkey < 18 THEN 'unchanged' WHEN s_nationkey > 9 THEN 'removed' END AS action,
        CASE WHEN s_nationkey < 18 AND skip IS NOT NULL THEN skip WHEN s_nationkey < 18 AND s_nationkey > 5 AND s_nationkey <= 9 THEN 'user-owned' END AS reason FROM d) q WHERE action IS NOT NULL""",
    "hook_reconcile": """WITH a AS (SELECT n_regionkey AS event, 0 AS part, n_nationkey AS pos, n_name AS command FROM nation WHERE n_nationkey <= 12 UNION ALL SELECT n_regionkey, 1, n_nationkey, n_name FROM nation WHERE n_nationkey > 18),
      n AS (SELECT event, string_agg(command, '|' ORDER BY part, pos) AS hooks FROM a GROUP BY event), o AS (SELECT n_regionkey AS event, string_agg(n_name, '|' ORDER BY n_nationkey) AS before FROM nation GROUP BY n_regionkey)
      SELECT o.event, coalesce(hooks, '') AS hooks, coalesce(hooks, '') <> before AS write FROM o LEFT JOIN n ON o.event = n.event""",
    "fan_out_plan": "SELECT r_name AS name, n_name AS tool FROM region, nation WHERE n_regionkey <> 2 AND n_nationkey > 4 AND n_name NOT IN ('CHINA', 'N7')",
    "uninstall_plan": "SELECT name, CASE WHEN shared AND others THEN 'kept-shared' ELSE 'removed' END AS action FROM (SELECT p_name AS name, p_name LIKE '%a%' AS shared, bool_or(p_brand = (SELECT min(p_brand) FROM part)) AS mine, bool_or(p_brand <> (SELECT min(p_brand) FROM part)) AS others FROM part GROUP BY p_name) q WHERE mine",
    "latest_candidate": "SELECT name, mtime, path FROM (SELECT o_custkey AS name, epoch_ms(o_orderdate) AS mtime, o_orderkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) q WHERE rn = 1",
    "folder_relation": """WITH d AS (SELECT source AS root, md5(coalesce(text, '')) AS rel, lang, n_chars FROM documents), l AS (SELECT root, rel, min(lang) AS l FROM d WHERE n_chars < 3000 GROUP BY root, rel), r AS (SELECT root, rel, max(lang) AS r FROM d GROUP BY root, rel)
      SELECT root, count(*) FILTER (WHERE l IS NOT NULL AND (r IS NULL OR l <> r)) = 0 AS subset, count(*) FILTER (WHERE l IS DISTINCT FROM r) = 0 AS equal FROM l FULL OUTER JOIN r USING (root, rel) GROUP BY root""",
    "provenance_classify": "SELECT name, CASE WHEN bool_or(source = 'src0') THEN 'builtin' WHEN bool_or(source = 'src1') THEN 'team' WHEN bool_or(source IN ('src2', 'src3')) THEN 'source' ELSE 'local-only' END AS origin FROM (SELECT md5(coalesce(text, '')) AS name, source FROM documents) q GROUP BY name",
    "merge_conflicts": "SELECT conv_id AS agent, role AS field, count(DISTINCT length(text)) AS n_values FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, role HAVING count(DISTINCT length(text)) > 1",
    "hook_dispatch": "SELECT event_id, CASE WHEN event_type = 'click' THEN 'first' ELSE 'late' END AS output FROM events WHERE event_type = 'click' AND user_id > 75 OR event_type = 'error' AND NOT (user_id > 75)",
    "page_hosts": "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '\\.example\\.org$') OR lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) = 'm.ththth.example.net' AS allowed FROM pages",
    "page_links": "SELECT target, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) q GROUP BY target",
    "thin_documents": f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE d < 30) AS thin, count(*) FILTER (WHERE regexp_matches(t, '{tx.PRONOUN}')) AS pronoun, CAST(sum(d) AS BIGINT) AS dense_chars FROM (SELECT lang, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS d, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents) q GROUP BY lang",
    "status_summary": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM conversations) AS conversations, (SELECT count(*) FROM events) AS events",
    "entry_hashes": """SELECT s_suppkey AS name, '{"id":' || s_suppkey || ',"name":"' || s_name || '"}' AS entry, substr(sha1('{"id":' || s_suppkey || ',"name":"' || s_name || '"}'), 1, 16) AS hash16 FROM supplier""",
}
