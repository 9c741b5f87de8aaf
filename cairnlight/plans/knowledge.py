"""Queries over the small knowledge project: units, claims, references, grading, code layer; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import code, graph, packets, reconcile, units
from ..operators.retrieval import context_graded
from .corpus import frame, values


def _docs(spark: SparkSession) -> DataFrame:
    return frame(spark, "kdocs")


def _units(spark: SparkSession) -> DataFrame:
    """Units of the small project; one plan, kept while several operators of a query read it."""
    return units.split_units(_docs(spark)).persist()


def split_units(spark: SparkSession, _: str) -> DataFrame:
    return _units(spark).select("library", "relative", "id", "parent_id", "title", "kind", "scope", "heading_path", "level", "body", "source_line", "ord", "has_children")


def frontmatter_fields(spark: SparkSession, _: str) -> DataFrame:
    join = lambda c: F.array_join(c, ",").alias(c)
    return units.front_matter(_docs(spark)).select("library", "relative", "module", "domain", "feature", "architecture", "lesson", join("applies_when"), join("excludes"), "guard_strength")


def document_identity(spark: SparkSession, _: str) -> DataFrame:
    return units.identities(_docs(spark), "default").select("library", "relative", "module", "system", "root_scope", "tier")


def first_paragraphs(spark: SparkSession, _: str) -> DataFrame:
    return _units(spark).select("id", "library", F.coalesce(tx.first_paragraph(F.col("body")), F.col("title")).alias("summary"))


def claim_bullets(spark: SparkSession, _: str) -> DataFrame:
    return units.claims(_units(spark)).select("library", "id", "kind", F.col("ord").cast("int").alias("ord"), "text", "source")


def symbol_mentions(spark: SparkSession, _: str) -> DataFrame:
    return _units(spark).select("library", "id", F.array_join(tx.backtick_symbols(F.col("body")), ",").alias("quoted"), F.array_join(tx.plain_symbols(F.col("body")), ",").alias("plain"))


def _broken(spark: SparkSession) -> DataFrame:
    u = _units(spark)
    return units.violations(u).unionByName(units.boundary_gaps(u, _docs(spark)))


def contract_audit(spark: SparkSession, _: str) -> DataFrame:
    return _broken(spark).groupBy("library", "id", "rule", "severity").agg(F.count("*").alias("n"))


def contract_gate(spark: SparkSession, _: str) -> DataFrame:
    return units.statuses(_units(spark), _broken(spark)).select("library", "id", "status")


def schema_gaps(spark: SparkSession, _: str) -> DataFrame:
    return units.schema_gaps(_units(spark), _docs(spark)).select("library", "relative", "tier", "kind")


def lint_findings(spark: SparkSession, _: str) -> DataFrame:
    return units.lint(_docs(spark)).select("library", "relative", F.col("line").cast("int").alias("line"), "rule", "level")


def _verified(spark: SparkSession) -> DataFrame:
    keys = code.symbol_keys(frame(spark, "ksymbols")).select(F.col("key").alias("symbol"), "resolved_file")
    return packets.verified(units.claims(_units(spark)), keys)


def claim_verification(spark: SparkSession, _: str) -> DataFrame:
    return _verified(spark).select("library", "id", F.col("ord").cast("int").alias("ord"), "source", "verification")


def claim_grade_counts(spark: SparkSession, _: str) -> DataFrame:
    v = _verified(spark)
    return v.agg(F.count("*").alias("claims"), F.count_if(F.col("source") == "extracted").alias("extracted"), F.count_if(F.col("verification") == "verified").alias("verified"), F.count_if(F.col("verification") == "drift").alias("drifted"))


def _references(spark: SparkSession) -> DataFrame:
    rows = code.resolved(units.references(_units(spark)), frame(spark, "ksymbols"))
    return rows.where((F.col("ref_kind") == "evidence") | F.col("quoted") | F.col("resolved"))


def reference_rows(spark: SparkSession, _: str) -> DataFrame:
    drift = (F.col("ref_kind") == "evidence") & F.col("resolved") & F.col("claimed_file").isNotNull() & (F.col("claimed_file") != F.col("resolved_file"))
    return _references(spark).select("library", "id", "symbol", "ref_kind", F.coalesce("resolved_file", "claimed_file").alias("shown_file"), "resolved", drift.alias("drift"))


def _graded(spark: SparkSession) -> DataFrame:
    u = _units(spark)
    nodes = u.join(units.statuses(u, _broken(spark)), ["library", "relative", "id"]).select("library", "id", "status", F.length("body").alias("content_chars"), F.lit(False).alias("mechanical"))
    own = lambda df: df.withColumn("id", F.concat_ws("|", "library", "id"))
    return packets.counters(own(nodes), own(_references(spark)), own(_verified(spark)))


def answerability(spark: SparkSession, _: str) -> DataFrame:
    level = packets.answerability()
    return _graded(spark).select("id", "status", level.alias("level"), packets.action(level).alias("action"))


def packet_warnings(spark: SparkSession, _: str) -> DataFrame:
    return _graded(spark).select("id", packets.warning_codes().alias("warnings"))


def unit_ancestors(spark: SparkSession, _: str) -> DataFrame:
    own = lambda c: F.concat_ws("|", "library", c)
    tree = _units(spark).select(own("id").alias("node"), F.when(F.col("parent_id").isNotNull(), own("parent_id")).alias("parent"))
    return packets.ancestors(tree)


def subtree_claims(spark: SparkSession, _: str) -> DataFrame:
    own = lambda c: F.concat_ws("|", "library", c)
    tree = _units(spark).select(own("id").alias("node"), F.when(F.col("parent_id").isNotNull(), own("parent_id")).alias("parent"))
    claims = units.claims(_units(spark)).select(own("id").alias("node"))
    return packets.subtree(tree).join(claims, "node").groupBy("root").agg(F.count("*").alias("claims"))


def tagged_output(spark: SparkSession, _: str) -> DataFrame:
    tag = F.concat(F.lit('<unit id="'), tx.xml_escaped(F.col("id")), F.lit('">'), tx.cdata(F.col("body")), F.lit("</unit>"))
    return _units(spark).select("library", "id", tag.alias("tagged"), tx.truncated(F.col("body"), 40).alias("brief"))


def evidence_migration(spark: SparkSession, _: str) -> DataFrame:
    return _docs(spark).select("library", "relative", tx.evidence_without_lines(F.col("content")).alias("content"))


def lesson_context(spark: SparkSession, _: str) -> DataFrame:
    graded = context_graded(F.col("applies_when"), F.col("excludes"), F.array(F.lit("winter")))
    return units.front_matter(_docs(spark)).select("library", "relative", graded.alias("g")).select("library", "relative", "g.multiplier", "g.badge")


def resolve_symbols(spark: SparkSession, _: str) -> DataFrame:
    return code.symbol_keys(frame(spark, "ksymbols"))


def reference_resolution(spark: SparkSession, _: str) -> DataFrame:
    return code.resolve_edges(frame(spark, "kedges"), frame(spark, "ksymbols"), frame(spark, "kpaths")).select("id", "relation", "target_file")


def edge_dedup(spark: SparkSession, _: str) -> DataFrame:
    return code.distinct_edges(frame(spark, "kedges")).select("id", "relation", "line")


def code_symbols(spark: SparkSession, _: str) -> DataFrame:
    return code.scanned(frame(spark, "kfiles"))[0]


def code_edges(spark: SparkSession, _: str) -> DataFrame:
    return code.scanned(frame(spark, "kfiles"))[1]


def file_nodes(spark: SparkSession, _: str) -> DataFrame:
    return code.file_nodes(frame(spark, "ksymbols"))


def language_dispatch(spark: SparkSession, _: str) -> DataFrame:
    return frame(spark, "kfiles").select("path", tx.language(F.col("path")).alias("language"), tx.excluded(F.col("path"), ["src/b*.py", "yard.ts"]).alias("excluded"))


def graph_references(spark: SparkSession, _: str) -> DataFrame:
    return graph.references(frame(spark, "kedges"), spark.createDataFrame([("Strike",), ("Tool",), ("heat",)], "symbol string"))


def graph_deps(spark: SparkSession, _: str) -> DataFrame:
    files = frame(spark, "kpaths").select(F.col("path").alias("file"))
    return graph.deps(frame(spark, "kedges"), files).select("file", F.lit("deps").alias("side"), F.col("needs").alias("other")).unionByName(graph.dependents(frame(spark, "kedges"), files).select("file", F.lit("dependents").alias("side"), F.col("needed_by").alias("other")))


def placeholder_resolution(spark: SparkSession, _: str) -> DataFrame:
    return reconcile.substituted(frame(spark, "ktemplates"), frame(spark, "kvariables"))


QUERIES = {f.__name__: f for f in (split_units, frontmatter_fields, document_identity, first_paragraphs, claim_bullets, symbol_mentions, contract_audit, contract_gate, schema_gaps, lint_findings, claim_verification, claim_grade_counts, reference_rows, answerability, packet_warnings, unit_ancestors, subtree_claims, tagged_output, evidence_migration, lesson_context, resolve_symbols, reference_resolution, edge_dedup, code_symbols, code_edges, file_nodes, language_dispatch, graph_references, graph_deps, placeholder_resolution)}

# written out, so that a wrong rule of classify_kind shows
_HAS = lambda *keys: " OR ".join(f"contains(lower(title), '{k}')" for k in keys)
_WORD = lambda w: f"list_contains(regexp_split_to_array(lower(title), '[^\\pL\\pN]+'), '{w}')"
_KINDS = f"""CASE WHEN {_HAS("flow")} THEN 'data_flow' WHEN {_HAS("architect")} THEN 'architecture' WHEN {_HAS("responsib")} THEN 'responsibility'
  WHEN {_HAS("struct")} THEN 'data_structure' WHEN {_HAS("claim")} THEN 'design_decision' WHEN {_HAS("boundar")} THEN 'boundary' WHEN {_HAS("depend")} THEN 'dependency'
  WHEN {_HAS("evidence")} THEN 'evidence' WHEN {_HAS("context")} THEN 'context' WHEN {_HAS("risk", "impact")} THEN 'impact' WHEN {_HAS("edge case", "edgecase")} THEN 'edge_case'
  WHEN {_HAS("symptom")} THEN 'symptom' WHEN {_HAS("root cause")} OR {_WORD("cause")} THEN 'root_cause' WHEN {_WORD("fix")} OR {_HAS("resolution")} THEN 'fix'
  WHEN {_HAS("guard", "prevention")} THEN 'guard' ELSE 'section' END"""
_TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"

#: Units of kdocs: lines, front matter, fences, headings, parents and paths (recursive).
UNITS = f"""{values("kdocs")},
ln AS (SELECT library, relative, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT library, relative, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls FROM kdocs) q),
f0 AS (SELECT *, {_TRIM("line")} AS t FROM ln),
f1 AS (SELECT *, min(CASE WHEN t <> '' THEN i END) OVER (PARTITION BY library, relative) AS first_i FROM f0),
f2 AS (SELECT *, max(CASE WHEN i = first_i AND t = '---' THEN 1 ELSE 0 END) OVER (PARTITION BY library, relative) AS opens FROM f1),
f3 AS (SELECT *, min(CASE WHEN opens = 1 AND i > first_i AND t = '---' THEN i END) OVER (PARTITION BY library, relative) AS matter_end FROM f2),
f4 AS (SELECT *, coalesce(matter_end + 1, 0) AS start_i, CASE WHEN regexp_matches(line, '^\\s*#{{1,6}}[ \\t]+\\S') THEN length(regexp_extract(line, '^\\s*(#+)', 1)) ELSE 0 END AS level, regexp_extract(line, '^\\s*#+[ \\t]+(\\S.*?)\\s*$', 1) AS title FROM f3),
f5 AS (SELECT *, min(CASE WHEN i >= start_i AND t <> '' THEN i END) OVER (PARTITION BY library, relative) AS body_at FROM f4),
f6 AS (SELECT *, i = body_at AND level = 1 AS lead_line FROM f5),
x1 AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY library, relative ORDER BY i) % 2 AS fenced FROM f6 WHERE i >= start_i AND NOT lead_line),
x2 AS (SELECT *, fenced = 0 AND level > 0 AS heads FROM x1),
x3 AS (SELECT *, sum(CASE WHEN heads THEN 1 ELSE 0 END) OVER (PARTITION BY library, relative ORDER BY i) AS ord FROM x2),
rt AS (SELECT library, relative, coalesce(max(CASE WHEN lead_line THEN title END), regexp_extract(relative, '([^/]+)\\.[^./]*$', 1)) AS title, coalesce(max(CASE WHEN lead_line THEN i + 1 END), max(start_i) + 1) AS source_line FROM f6 GROUP BY library, relative),
pt AS (SELECT library, relative, ord, max(CASE WHEN heads THEN title END) AS title, coalesce(max(CASE WHEN heads THEN level END), 0) AS level, max(CASE WHEN heads THEN i + 1 END) AS source_line, coalesce(string_agg(CASE WHEN NOT heads THEN line || chr(10) END, '' ORDER BY i), '') AS body FROM x3 GROUP BY library, relative, ord),
u0 AS (SELECT rt.library, rt.relative, 0 AS ord, rt.title, 0 AS level, rt.source_line, coalesce(pt.body, '') AS body FROM rt LEFT JOIN pt ON pt.library = rt.library AND pt.relative = rt.relative AND pt.ord = 0
  UNION ALL SELECT library, relative, CAST(ord AS INTEGER), title, CAST(level AS INTEGER), source_line, body FROM pt WHERE ord > 0),
u1 AS (SELECT a.library, a.relative, a.ord, max(b.ord) AS parent_ord FROM u0 a LEFT JOIN u0 b ON a.library = b.library AND a.relative = b.relative AND b.ord < a.ord AND b.level < a.level GROUP BY a.library, a.relative, a.ord),
u2 AS (SELECT u0.*, u1.parent_ord FROM u0 JOIN u1 USING (library, relative, ord)),
up(library, relative, ord, path, depth) AS (SELECT library, relative, ord, title, 0 FROM u2 WHERE ord = 0 UNION ALL SELECT c.library, c.relative, c.ord, up.path || ' > ' || c.title, up.depth + 1 FROM u2 c JOIN up ON c.library = up.library AND c.relative = up.relative AND c.parent_ord = up.ord),
u AS (SELECT u2.library, u2.relative, 'doc:' || u2.relative || CASE WHEN u2.ord > 0 THEN '#s' || u2.ord ELSE '' END AS id,
  CASE WHEN u2.parent_ord IS NOT NULL THEN 'doc:' || u2.relative || CASE WHEN u2.parent_ord > 0 THEN '#s' || u2.parent_ord ELSE '' END END AS parent_id,
  u2.title, CASE WHEN u2.ord = 0 THEN 'overview' ELSE {_KINDS} END AS kind,
  CASE WHEN u2.ord = 0 THEN 'module' WHEN up.depth <= 1 THEN 'section' ELSE 'subsection' END AS scope, up.path AS heading_path, CAST(u2.level AS INTEGER) AS level, u2.body,
  CAST(u2.source_line AS INTEGER) AS source_line, CAST(u2.ord AS INTEGER) AS ord,
  EXISTS (SELECT 1 FROM u2 k WHERE k.library = u2.library AND k.relative = u2.relative AND k.parent_ord = u2.ord) AS has_children
  FROM u2 JOIN up USING (library, relative, ord))"""

_MATTER = f""",
m0 AS (SELECT library, relative, i, lower({_TRIM("split_part(line, ':', 1)")}) AS k, {_TRIM("regexp_replace(" + _TRIM("substr(line, strpos(line, ':') + 1)") + ", '^\"+|\"+$', '', 'g')")} AS v FROM f3 WHERE matter_end IS NOT NULL AND i > first_i AND i < matter_end AND strpos(line, ':') > 0),
m1 AS (SELECT library, relative, i, CASE k WHEN 'system' THEN 'domain' WHEN 'project' THEN 'architecture' ELSE k END AS k, v FROM m0 WHERE v <> ''),
m2 AS (SELECT library, relative, k, arg_max(v, i) AS v FROM m1 GROUP BY library, relative, k),
m AS (SELECT d.library, d.relative, {", ".join(f"max(CASE WHEN k = '{n}' THEN v END) AS {n.replace('-', '_')}" for n in ("module", "domain", "feature", "architecture", "lesson", "applies-when", "excludes", "guard-strength"))} FROM kdocs d LEFT JOIN m2 ON d.library = m2.library AND d.relative = m2.relative GROUP BY d.library, d.relative)"""

_LIST = lambda c: f"coalesce((SELECT string_agg(e, ',' ORDER BY n) FROM (SELECT lower(regexp_replace({_TRIM('p')}, '^[\"'']+|[\"'']+$', '', 'g')) AS e, n FROM (SELECT unnest(string_split(regexp_replace(coalesce({c}, ''), '^\\[+|\\]+$', '', 'g'), ',')) AS p, generate_subscripts(string_split(coalesce({c}, ''), ','), 1) AS n) z) y WHERE e <> ''), '')"

_BUCKET = "CASE WHEN lower(title) LIKE '%claim%' THEN 'claim' WHEN lower(title) LIKE '%boundar%' THEN 'boundary' END"

#: Items of lists: numbered by their markers.
_ITEMS = f""",
b0 AS (SELECT library, relative, id, title, unnest(ls) AS raw, generate_subscripts(ls, 1) AS k FROM (SELECT *, string_split(regexp_replace(body, '\\n$', ''), chr(10)) AS ls FROM u) q),
b1 AS (SELECT *, {_TRIM("raw")} AS t FROM b0),
b2 AS (SELECT *, regexp_matches(t, '^[-*]\\s') OR t IN ('-', '*') AS marked FROM b1),
b3 AS (SELECT *, sum(CASE WHEN marked THEN 1 ELSE 0 END) OVER (PARTITION BY library, relative, id ORDER BY k) AS item FROM b2),
b4 AS (SELECT library, relative, id, title, item, max(CASE WHEN marked THEN {_TRIM("substr(t, 2)")} END) AS head, string_agg(CASE WHEN marked THEN {_TRIM("substr(t, 2)")} WHEN t <> '' THEN t END, ' ' ORDER BY k) AS txt FROM b3 WHERE item > 0 GROUP BY library, relative, id, title, item),
bullets AS (SELECT library, relative, id, title, txt, row_number() OVER (PARTITION BY library, relative, id ORDER BY item) - 1 AS ord FROM b4 WHERE head <> '')"""

#: Symbol, file of evidence in ``txt``.
_BOUND = f"""
  SELECT *, regexp_extract_all(txt, '`([^`]+)`', 1) AS toks FROM {{source}}"""
_NORMAL = lambda c: _TRIM(f"regexp_replace({_TRIM(c)}, '\\(\\)$', '')")
_ISSYM = lambda c: f"(regexp_matches({c}, '^[\\p{{L}}\\p{{N}}_:]+$') AND NOT regexp_matches({c}, '^\\p{{N}}+$'))"
_EVIDENCE = f"""
ev_t AS (SELECT q.library, q.relative, q.id, q.title, q.ord, q.txt, unnest(toks) AS tok, generate_subscripts(toks, 1) AS n FROM ({_BOUND.format(source="cl")}) q),
ev_k AS (SELECT *, CASE WHEN regexp_matches(tok, ':\\s*-?\\d+\\s*$') THEN 'line' WHEN tok LIKE '%/%' THEN 'path' ELSE 'symbol' END AS what FROM ev_t),
ev AS (SELECT library, relative, id, ord, arg_min(CASE WHEN what = 'symbol' AND {_ISSYM(_NORMAL("tok"))} THEN {_NORMAL("tok")} END, CASE WHEN what = 'symbol' AND {_ISSYM(_NORMAL("tok"))} THEN n END) AS symbol,
  arg_max(CASE WHEN what = 'line' THEN {_TRIM("regexp_replace(tok, ':\\s*-?\\d+\\s*$', '')")} WHEN what = 'path' THEN tok END, CASE WHEN what <> 'symbol' THEN n END) AS file FROM ev_k GROUP BY library, relative, id, ord)"""

_KEYS = f""",
{values("ksymbols")},
sk AS (SELECT name AS k, role, kind, file, line FROM ksymbols UNION SELECT qualified_name, role, kind, file, line FROM ksymbols),
keys AS (SELECT k, file AS resolved_file, line AS resolved_line FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN role = 'definition' THEN 0 ELSE 1 END, CASE kind WHEN 'class' THEN 0 WHEN 'struct' THEN 1 ELSE 2 END, file, line) AS rn FROM sk) q WHERE rn = 1)"""

_CLAIMS = _ITEMS + f""",
cl AS (SELECT library, relative, id, title, ord, regexp_replace(txt, '(?i)^\\s*\\[(extracted|inferred)\\]\\s*', '') AS txt, lower(nullif(regexp_extract(txt, '(?i)^\\s*\\[(extracted|inferred)\\]', 1), '')) AS marked, {_BUCKET} AS kind FROM bullets WHERE {_BUCKET} IS NOT NULL),
{_EVIDENCE},
claims AS (SELECT cl.library, cl.relative, cl.id, cl.kind, CAST(cl.ord AS INTEGER) AS ord, cl.txt AS text, coalesce(cl.marked, CASE WHEN ev.symbol IS NOT NULL AND ev.file IS NOT NULL THEN 'extracted' ELSE 'inferred' END) AS source, ev.symbol, CASE WHEN ev.symbol IS NOT NULL THEN ev.file END AS file
  FROM cl LEFT JOIN ev ON cl.library = ev.library AND cl.relative = ev.relative AND cl.id = ev.id AND cl.ord = ev.ord)"""

_VERIFIED = _CLAIMS + _KEYS + """,
ver AS (SELECT c.*, CASE WHEN c.file IS NULL OR c.symbol IS NULL THEN 'unverifiable' WHEN k.resolved_file IS NULL THEN 'unresolved' WHEN k.resolved_file = c.file THEN 'verified' ELSE 'drift' END AS verification FROM claims c LEFT JOIN keys k ON c.symbol = k.k)"""

_BROKEN = _MATTER + _ITEMS + f""",
identity AS (SELECT library, relative, CASE WHEN architecture IS NOT NULL THEN 'project' WHEN feature IS NOT NULL THEN 'feature' WHEN lesson IS NOT NULL THEN 'lesson' WHEN domain IS NOT NULL THEN 'domain' ELSE 'module' END AS root_scope FROM m),
un AS (SELECT library, relative, id FROM bullets WHERE {_BUCKET} IS NOT NULL AND txt NOT LIKE '%`%' AND regexp_matches(txt, '{tx.PRONOUN}')
  AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(txt, '[\\p{{L}}\\p{{N}}_]+')) AS w) z WHERE length(w) >= 4 AND (w LIKE '%\\_%' ESCAPE '\\' AND regexp_matches(w, '[A-Za-z]') OR length(regexp_replace(w, '[^A-Z]', '', 'g')) >= 2 AND regexp_matches(w, '[a-z]')))),
broken AS (
  SELECT library, relative, id, 'empty-leaf' AS rule, 'quarantine' AS severity FROM u WHERE {_TRIM("body")} = '' AND NOT has_children
  UNION ALL SELECT library, relative, id, 'thin-content', 'degrade' FROM u WHERE {_TRIM("body")} <> '' AND length(regexp_replace(body, '\\s', '', 'g')) < 30
  UNION ALL SELECT library, relative, id, 'missing-envelope', 'degrade' FROM u WHERE {_TRIM("heading_path")} = ''
  UNION ALL SELECT library, relative, id, 'unclear-reference', 'degrade' FROM un
  UNION ALL SELECT u.library, u.relative, u.id, 'missing-boundaries', 'degrade' FROM u JOIN identity USING (library, relative) WHERE parent_id IS NULL AND root_scope NOT IN ('project', 'lesson') AND NOT EXISTS (SELECT 1 FROM u k WHERE k.library = u.library AND k.relative = u.relative AND lower(k.title) LIKE '%boundar%' AND lower(k.title) NOT LIKE '%claim%'))"""

_STATUS = """SELECT u.library, u.id, CASE WHEN bool_or(severity = 'quarantine') THEN 'quarantined' WHEN bool_or(severity = 'degrade') THEN 'degraded' ELSE 'accepted' END AS status FROM u LEFT JOIN broken USING (library, relative, id) GROUP BY u.library, u.id"""

_REQUIRED = "required(tier, kind) AS (VALUES " + ", ".join(f"('{t}', '{k}')" for t, ks in units.REQUIRED.items() for k in ks) + ")"

_MENTIONS = f""",
qt AS (SELECT library, relative, id, title, unnest(regexp_extract_all(body, '`([^`]+)`', 1)) AS tok, generate_subscripts(regexp_extract_all(body, '`([^`]+)`', 1), 1) AS n FROM u),
qs AS (SELECT library, relative, id, title, {_NORMAL("tok")} AS symbol, min(n) AS n FROM qt WHERE {_ISSYM(_NORMAL("tok"))} GROUP BY library, relative, id, title, {_NORMAL("tok")}),
pt2 AS (SELECT library, relative, id, title, unnest(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]{{{{3,}}}}')) AS symbol, generate_subscripts(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]{{{{3,}}}}'), 1) AS n FROM u),
ps AS (SELECT library, relative, id, title, symbol, min(n) AS n FROM pt2 WHERE symbol LIKE '%\\_%' ESCAPE '\\' AND regexp_matches(symbol, '[A-Za-z]') OR length(regexp_replace(symbol, '[^A-Z]', '', 'g')) >= 2 AND regexp_matches(symbol, '[a-z]') GROUP BY library, relative, id, title, symbol)""".replace("{{", "{").replace("}}", "}")

#: References with where they resolve; ``claims`` and ``cl`` of _CLAIMS are other lists, so these have names of their own.
_REFS = _MENTIONS + f""",
ce AS (SELECT library, relative, id, title, ord, txt FROM bullets WHERE lower(title) = 'evidence'),
{_EVIDENCE.replace("FROM cl)", "FROM ce)").replace("ev_t", "re_t").replace("ev_k", "re_k").replace("ev AS", "re AS")},
rr AS (SELECT library, relative, id, symbol, 'evidence' AS ref_kind, file AS claimed_file, true AS quoted FROM re WHERE symbol IS NOT NULL
  UNION ALL SELECT library, relative, id, symbol, 'mention', NULL, true FROM qs WHERE lower(title) <> 'evidence'
  UNION ALL SELECT library, relative, id, symbol, 'mention', NULL, false FROM ps WHERE lower(title) <> 'evidence' AND NOT EXISTS (SELECT 1 FROM qs WHERE qs.library = ps.library AND qs.relative = ps.relative AND qs.id = ps.id AND qs.symbol = ps.symbol)),
refs AS (SELECT rr.*, k.resolved_file FROM rr LEFT JOIN keys k ON rr.symbol = k.k WHERE ref_kind = 'evidence' OR quoted OR k.resolved_file IS NOT NULL)"""

_GRADED = _VERIFIED + _BROKEN.replace(_ITEMS, "") + _REFS + f""",
stat AS ({_STATUS}),
rc AS (SELECT library, id, count(*) FILTER (WHERE ref_kind = 'evidence' AND resolved_file IS NOT NULL) AS prim, count(*) FILTER (WHERE resolved_file IS NOT NULL) AS res, count(*) FILTER (WHERE resolved_file IS NULL) AS unres FROM refs GROUP BY library, id),
cc AS (SELECT library, id, count(*) AS n, count(*) FILTER (WHERE source = 'extracted' AND verification = 'verified') AS good, count(*) FILTER (WHERE verification IN ('drift', 'unresolved')) AS drift, count(*) FILTER (WHERE source = 'extracted' AND verification = 'unverifiable') AS unver FROM ver GROUP BY library, id),
gr AS (SELECT u.library || '|' || u.id AS id, stat.status, length(u.body) AS chars, coalesce(prim, 0) AS prim, coalesce(res, 0) AS res, coalesce(unres, 0) AS unres, coalesce(cc.n, 0) AS n, coalesce(good, 0) AS good, coalesce(cc.drift, 0) AS drift, coalesce(unver, 0) AS unver
  FROM u JOIN stat ON stat.library = u.library AND stat.id = u.id LEFT JOIN rc ON rc.library = u.library AND rc.id = u.id LEFT JOIN cc ON cc.library = u.library AND cc.id = u.id),
lv AS (SELECT *, CASE WHEN status = 'degraded' THEN 'insufficient' WHEN (prim >= 1 OR res >= 3 OR good >= 1) AND (n >= 1 OR chars >= 200) THEN 'sufficient' WHEN chars >= 200 OR n >= 1 OR res >= 1 THEN 'partial' ELSE 'insufficient' END AS level FROM gr)"""

_W = "WITH RECURSIVE "
ORACLES = {
    "split_units": _W + UNITS + " SELECT * FROM u",
    "frontmatter_fields": _W + UNITS + _MATTER + f" SELECT library, relative, module, domain, feature, architecture, lesson, {_LIST('applies_when')} AS applies_when, {_LIST('excludes')} AS excludes, lower(guard_strength) AS guard_strength FROM m",
    "document_identity": _W + UNITS + _MATTER + """ SELECT library, relative, coalesce(regexp_extract(module, '([^/]*)$', 1), regexp_extract(relative, '([^/]+)\\.[^./]*$', 1)) AS module, coalesce(domain, architecture, 'default') AS system,
      CASE WHEN architecture IS NOT NULL THEN 'project' WHEN feature IS NOT NULL THEN 'feature' WHEN lesson IS NOT NULL THEN 'lesson' WHEN domain IS NOT NULL THEN 'domain' ELSE 'module' END AS root_scope,
      CASE WHEN architecture IS NOT NULL THEN 'architecture' WHEN feature IS NOT NULL THEN 'feature' WHEN lesson IS NOT NULL THEN 'lesson' WHEN domain IS NOT NULL THEN 'domain' WHEN module IS NOT NULL THEN 'module' END AS tier FROM m""",
    "first_paragraphs": _W + UNITS + f""", p0 AS (SELECT library, id, title, unnest(ls) AS raw, generate_subscripts(ls, 1) AS k FROM (SELECT *, string_split(body, chr(10)) AS ls FROM u) q),
      p1 AS (SELECT *, {_TRIM("raw")} AS t FROM p0), p2 AS (SELECT *, min(CASE WHEN t <> '' THEN k END) OVER (PARTITION BY library, id) AS k0 FROM p1),
      p3 AS (SELECT *, min(CASE WHEN t = '' AND k > k0 THEN k END) OVER (PARTITION BY library, id) AS k1 FROM p2)
      SELECT id, library, coalesce(substr(string_agg(CASE WHEN k >= k0 AND k < coalesce(k1, 1000000) THEN t END, ' ' ORDER BY k), 1, 300), max(title)) AS summary FROM p3 GROUP BY id, library""",
    "claim_bullets": _W + UNITS + _CLAIMS + " SELECT library, id, kind, ord, text, source FROM claims",
    "contract_audit": _W + UNITS + _BROKEN + " SELECT library, id, rule, severity, count(*) AS n FROM broken GROUP BY library, id, rule, severity",
    "contract_gate": _W + UNITS + _BROKEN + " " + _STATUS,
    "schema_gaps": _W + UNITS + _MATTER + f""", {_REQUIRED}, tiers AS (SELECT library, relative, CASE WHEN architecture IS NOT NULL THEN 'architecture' WHEN feature IS NOT NULL THEN 'feature' WHEN lesson IS NOT NULL THEN 'lesson' WHEN domain IS NOT NULL THEN 'domain' WHEN module IS NOT NULL THEN 'module' END AS tier FROM m)
      SELECT t.library, t.relative, t.tier, r.kind FROM tiers t JOIN required r ON t.tier = r.tier WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.library = t.library AND u.relative = t.relative AND u.kind = r.kind)""",
    "claim_verification": _W + UNITS + _VERIFIED + " SELECT library, id, ord, source, verification FROM ver",
    "claim_grade_counts": _W + UNITS + _VERIFIED + " SELECT count(*) AS claims, count(*) FILTER (WHERE source = 'extracted') AS extracted, count(*) FILTER (WHERE verification = 'verified') AS verified, count(*) FILTER (WHERE verification = 'drift') AS drifted FROM ver",
    "unit_ancestors": _W + UNITS + """, anc(node, ancestor, distance) AS (SELECT library || '|' || id, library || '|' || parent_id, 1 FROM u WHERE parent_id IS NOT NULL
      UNION ALL SELECT a.node, u.library || '|' || u.parent_id, a.distance + 1 FROM anc a JOIN u ON a.ancestor = u.library || '|' || u.id WHERE u.parent_id IS NOT NULL) SELECT node, ancestor, CAST(distance AS INTEGER) AS distance FROM anc""",
    "subtree_claims": _W + UNITS + _CLAIMS + """, anc(node, root) AS (SELECT library || '|' || id, library || '|' || id FROM u UNION ALL SELECT a.node, u.library || '|' || u.parent_id FROM anc a JOIN u ON a.root = u.library || '|' || u.id WHERE u.parent_id IS NOT NULL)
      SELECT root, count(*) AS claims FROM anc JOIN claims c ON anc.node = c.library || '|' || c.id GROUP BY root""",
    "evidence_migration": "WITH " + values("kdocs") + ", l AS (SELECT library, relative, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT *, string_split(content, chr(10)) AS ls FROM kdocs) q) SELECT library, relative, string_agg(CASE WHEN line LIKE '%defined at%' THEN regexp_replace(line, ':\\d+`', '`', 'g') ELSE line END, chr(10) ORDER BY k) AS content FROM l GROUP BY library, relative",
    "resolve_symbols": "WITH " + values("kpaths") + _KEYS + " SELECT k AS key, resolved_file, resolved_line FROM keys",
    "reference_resolution": "WITH " + values("kedges") + ", " + values("ksymbols") + ", " + values("kpaths") + """,
      d AS (SELECT *, CASE WHEN kind IN ('function', 'field') THEN kind ELSE 'type' END AS grp FROM ksymbols WHERE role = 'definition'),
      e AS (SELECT k.*, p.language AS lang, CASE WHEN relation = 'call' THEN 'function' WHEN relation IN ('reads', 'writes') THEN 'field' WHEN relation IN ('inherits', 'uses_type') THEN 'type' END AS grp FROM kedges k LEFT JOIN kpaths p ON k.source_file = p.path)
      SELECT id, relation, coalesce(CASE WHEN relation IN ('import', 'include') THEN target_symbol END,
        CASE WHEN grp IN ('function', 'field') THEN (SELECT min(d.file) FROM d WHERE d.grp = e.grp AND d.qualified_name = (SELECT min(substr(c.qualified_name, 1, length(c.qualified_name) - length(c.name))) FROM ksymbols c WHERE c.file = e.source_file AND c.name = e.source_symbol AND c.kind = 'function' AND c.qualified_name <> c.name) || e.target_symbol) END,
        (SELECT min(d.file) FROM d WHERE d.grp = e.grp AND d.file = e.source_file AND d.name = e.target_symbol HAVING count(*) = 1),
        (SELECT min(d.file) FROM d WHERE d.grp = e.grp AND d.language = e.lang AND d.name = e.target_symbol HAVING count(*) = 1), '') AS target_file FROM e""",
    "edge_dedup": "WITH " + values("kedges") + """ SELECT id, relation, line FROM (SELECT *, row_number() OVER (PARTITION BY source_file, source_symbol, target_symbol, relation, CASE WHEN relation IN ('reads', 'writes') THEN line END ORDER BY line, id) AS rn FROM kedges) q WHERE rn = 1 OR relation IN ('call', 'include', 'import')""",
    "file_nodes": "WITH " + values("ksymbols") + """, h AS (SELECT file, string_agg(n || ' ' || kind, ', ' ORDER BY kind) AS histogram, least(sum(n), 40) AS n_refs FROM (SELECT file, kind, count(*) AS n FROM ksymbols GROUP BY file, kind) q GROUP BY file),
      t AS (SELECT file, string_agg(name, ', ' ORDER BY line, name) AS headline FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, name) AS k FROM ksymbols WHERE kind IN ('class', 'struct')) q WHERE k <= 4 GROUP BY file)
      SELECT 'file:' || h.file AS id, regexp_extract(h.file, '([^/]*)$', 1) AS title, histogram, coalesce(headline, '') AS headline, CAST(n_refs AS BIGINT) AS n_refs FROM h LEFT JOIN t ON h.file = t.file""",
    "graph_references": "WITH " + values("kedges") + " SELECT target_symbol AS symbol, relation, source_file, source_symbol, line FROM kedges WHERE relation IN ('call', 'inherits', 'uses_type', 'reads', 'writes') AND target_symbol IN ('Strike', 'Tool', 'heat')",
    "graph_deps": "WITH " + values("kedges") + ", " + values("kpaths") + """ SELECT source_file AS file, 'deps' AS side, target_symbol AS other FROM kedges WHERE relation IN ('import', 'include') AND source_file IN (SELECT path FROM kpaths)
      UNION ALL SELECT * FROM (SELECT DISTINCT p.path, 'dependents', e.source_file FROM kedges e JOIN kpaths p ON regexp_extract(e.target_symbol, '([^/]*)$', 1) = regexp_extract(p.path, '([^/]*)$', 1) WHERE relation IN ('import', 'include')) q""",
    "language_dispatch": "WITH " + values("kfiles") + " SELECT path, CASE regexp_extract(path, '\\.([^.]+)$', 1) WHEN 'h' THEN 'cpp' WHEN 'cpp' THEN 'cpp' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' ELSE 'typescript' END AS language, path IN ('src/bellows.py', 'src/yard.ts') AS excluded FROM kfiles",
    "placeholder_resolution": "WITH " + values("ktemplates") + " SELECT id, replace(replace(text, '${HOME_DIR}', '/home/smith'), '${API_KEY}', 'k-1') AS text, CASE WHEN text LIKE '%${NOPE}%' THEN 'NOPE' ELSE '' END AS missing FROM ktemplates",
    "symbol_mentions": _W + UNITS + _MENTIONS + """ SELECT u.library, u.id, coalesce((SELECT string_agg(symbol, ',' ORDER BY n) FROM qs WHERE qs.library = u.library AND qs.id = u.id), '') AS quoted,
      coalesce((SELECT string_agg(symbol, ',' ORDER BY n) FROM ps WHERE ps.library = u.library AND ps.id = u.id), '') AS plain FROM u""",
    "reference_rows": _W + UNITS + _ITEMS + _KEYS + _REFS + """ SELECT library, id, symbol, ref_kind, coalesce(resolved_file, claimed_file) AS shown_file, resolved_file IS NOT NULL AS resolved,
      ref_kind = 'evidence' AND resolved_file IS NOT NULL AND claimed_file IS NOT NULL AND claimed_file <> resolved_file AS drift FROM refs""",
    "answerability": _W + UNITS + _GRADED + " SELECT id, status, level, CASE level WHEN 'sufficient' THEN 'proceed_with_evidence' WHEN 'partial' THEN 'proceed_with_caveats' ELSE 'fallback_to_source' END AS action FROM lv",
    "packet_warnings": _W + UNITS + _GRADED + """ SELECT id, concat_ws(',', CASE WHEN status = 'degraded' THEN 'degraded' END, CASE WHEN unres > 0 THEN 'unresolved-refs' END, CASE WHEN prim = 0 THEN 'no-primary-evidence' END, CASE WHEN n = 0 THEN 'no-claims' END, CASE WHEN drift > 0 THEN 'drifted-claims' END, CASE WHEN unver > 0 THEN 'unverifiable-claims' END) AS warnings FROM lv""",
    "tagged_output": _W + UNITS + """ SELECT library, id, '<unit id="' || replace(replace(replace(replace(id, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '"><![CDATA[' || replace(body, ']]>', ']]]]><![CDATA[>') || ']]></unit>' AS tagged,
      CASE WHEN length(body) > 40 THEN substr(replace(body, chr(10), ' '), 1, 40) || '…' ELSE replace(body, chr(10), ' ') END AS brief FROM u""",
    "lesson_context": _W + UNITS + _MATTER + f""", li AS (SELECT library, relative, ',' || {_LIST('applies_when')} || ',' AS a, ',' || {_LIST('excludes')} || ',' AS x FROM m)
      SELECT library, relative, CASE WHEN x LIKE '%,winter,%' THEN 0.5e0 WHEN a LIKE '%,winter,%' THEN 1.25e0 WHEN a <> ',,' THEN 0.85e0 ELSE 1e0 END AS multiplier, CASE WHEN x LIKE '%,winter,%' THEN 'excluded' WHEN a LIKE '%,winter,%' THEN 'match' WHEN a <> ',,' THEN 'mismatch' END AS badge FROM li""",
}
