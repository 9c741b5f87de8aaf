"""Queries over managed resources, on the driver's tables; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import managed
from ..sources.readers import table


def server_entries(spark: SparkSession, sf: str) -> DataFrame:
    name, args = F.regexp_replace("s_name", "[^A-Za-z0-9]+", "-"), F.when(F.col("s_acctbal") > 0, F.array(F.lit('say "hi"'), F.col("s_nationkey").cast("string"))).otherwise(F.expr("cast(array() as array<string>)"))
    return table(spark, sf, "supplier").select("s_suppkey", managed.rendered_json(name, F.lit("run"), args, F.expr("cast(map() as map<string,string>)")).alias("json"), managed.rendered_toml(name, F.lit("run"), args).alias("toml"))


def skill_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.concat(F.when(F.col("lang") == "en", F.concat(F.lit("---\nname: x\ndescription: a text from "), "source", F.lit("\n---\n"))).otherwise(F.lit("# Head\n")), F.coalesce("text", F.lit(""))).alias("content"))
    return managed.described(rows)


def check_rollup(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("n_chars") < 100, "error").when(F.col("n_chars") < 500, "warn").otherwise("ok")
    return managed.rolled_up(table(spark, sf, "documents").select(level.alias("level")))


def resource_counts(spark: SparkSession, sf: str) -> DataFrame:
    return managed.counted_by_type(table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("type")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("type")))


def hook_status(spark: SparkSession, sf: str) -> DataFrame:
    desired = table(spark, sf, "customer").select(F.col("c_nationkey").alias("tool"), F.col("c_mktsegment").alias("command")).distinct()
    existing = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("tool"), F.col("c_mktsegment").alias("command"))
    return managed.hooks_present(desired, existing)


def uninstall_sets(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_set(F.when(F.col("n_nationkey") > 6, F.col("n_name"))).alias("e"), F.collect_set(F.when(F.col("n_nationkey") <= 6, F.col("n_name"))).alias("d"), F.max("n_name").alias("tool"))
    out = managed.after_uninstall(F.when(F.size("e") > 0, F.col("e")), F.col("d"), F.col("tool")).alias("s")
    return per.select("n_regionkey", out).select("n_regionkey", F.array_join("s.enabled", ",").alias("enabled"), F.array_join("s.disabled", ",").alias("disabled"))


def store_collect(spark: SparkSession, sf: str) -> DataFrame:
    row = lambda t, k, by: t.select(F.col("s_suppkey").alias("name"), F.concat(F.lit(k), F.col("s_nationkey").cast("string")).alias("content"), F.array(*map(F.lit, by)).alias("by"))
    s = table(spark, sf, "supplier")
    out = managed.collected(row(s.where("s_nationkey < 15"), "old", ["ann"]), row(s.where("s_nationkey > 10"), "new", ["ann", "bob"]))
    return out.select("name", "content", F.array_join("by", ",").alias("by"))


def store_remove(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("name"), "s_nationkey", "s_acctbal")
    left, graves = managed.removed(s.select("name"), s.where("s_acctbal < 0").select("name"), s.where("s_nationkey = 1"))
    return left.select("name", F.lit("stays").alias("state")).unionByName(graves.select("name", F.lit("buried").alias("state")))


QUERIES = {f.__name__: f for f in (server_entries, skill_descriptions, check_rollup, resource_counts, hook_status, uninstall_sets, store_collect, store_remove)}

_NAME = "regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g')"
ORACLES = {
    "server_entries": f"""SELECT s_suppkey, '{{"name":"' || {_NAME} || '","command":"run"' || CASE WHEN s_acctbal > 0 THEN ',"args":["say \\"hi\\"","' || s_nationkey || '"]' ELSE '' END || '}}' AS json,
      '[servers.' || {_NAME} || ']' || chr(10) || 'command = "run"' || CASE WHEN s_acctbal > 0 THEN chr(10) || 'args = ["say \\"hi\\"", "' || s_nationkey || '"]' ELSE '' END || chr(10) AS toml FROM supplier""",
    "skill_descriptions": """WITH l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE lang <> 'en') q),
      t AS (SELECT doc_id, k, regexp_replace(regexp_replace(x, '^#+\\s*', ''), '^\\s+|\\s+$', '', 'g') AS x FROM l), f AS (SELECT doc_id, arg_min(x, k) AS x FROM t WHERE length(x) > 10 GROUP BY doc_id),
      d AS (SELECT d.doc_id AS name, CASE WHEN lang = 'en' THEN 'a text from ' || source ELSE coalesce(f.x, '') END AS x FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id)
      SELECT name, CASE WHEN length(x) > 80 THEN substr(x, 1, 77) || '...' ELSE x END AS description FROM d""",
    "check_rollup": "WITH c AS (SELECT count(*) FILTER (WHERE n_chars >= 500) AS ok, count(*) FILTER (WHERE n_chars >= 100 AND n_chars < 500) AS warn, count(*) FILTER (WHERE n_chars < 100) AS error FROM documents) SELECT ok, warn, error, CASE WHEN error > 0 THEN 'error' WHEN warn > 0 THEN 'warn' ELSE 'ok' END AS worst FROM c",
    "resource_counts": "SELECT n_nationkey AS type, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_nationkey",
    "hook_status": "SELECT tool, bool_and(there) AS complete FROM (SELECT c_nationkey AS tool, c_mktsegment, max(c_acctbal) > 0 AS there FROM customer GROUP BY c_nationkey, c_mktsegment) q GROUP BY tool",
    "uninstall_sets": """WITH t AS (SELECT n_regionkey, max(n_name) AS tool FROM nation GROUP BY n_regionkey), e AS (SELECT n.n_regionkey, n.n_name FROM nation n JOIN t ON t.n_regionkey = n.n_regionkey WHERE n_nationkey > 6 AND n_name <> tool),
      d AS (SELECT n_regionkey, n_name FROM nation WHERE n_nationkey <= 6 UNION SELECT n_regionkey, tool FROM t)
      SELECT t.n_regionkey, CASE WHEN EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = t.n_regionkey AND n_nationkey > 6) THEN coalesce((SELECT string_agg(n_name, ',' ORDER BY n_name) FROM e WHERE e.n_regionkey = t.n_regionkey), '') END AS enabled,
        (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM d WHERE d.n_regionkey = t.n_regionkey) AS disabled FROM t""",
    "store_collect": "SELECT s_suppkey AS name, CASE WHEN s_nationkey > 10 THEN 'new' ELSE 'old' END || s_nationkey AS content, CASE WHEN s_nationkey > 10 THEN 'ann,bob' ELSE 'ann' END AS by FROM supplier",
    "store_remove": "SELECT s_suppkey AS name, 'stays' AS state FROM supplier WHERE NOT s_acctbal < 0 UNION ALL SELECT s_suppkey, 'buried' FROM supplier WHERE s_acctbal < 0 OR s_nationkey = 1",
}
