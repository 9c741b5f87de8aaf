"""Knowledge units: documents split at headings, graded by named rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Section kinds that a tier's document must have.
REQUIRED = {
    "architecture": ("context", "architecture", "data_flow", "design_decision", "boundary", "evidence"),
    "domain": ("context", "architecture", "data_flow", "design_decision", "boundary", "evidence"),
    "module": ("context", "architecture", "data_flow", "design_decision", "edge_case", "boundary", "evidence"),
    "feature": ("context", "architecture", "data_flow", "design_decision", "edge_case", "boundary", "evidence"),
    "lesson": ("symptom", "root_cause", "fix", "guard", "evidence"),
}
GUARD_STRENGTHS = ("directive", "scope", "hint", "reference")
THIN_CHARS = 30

DOC = ("library", "relative")


def numbered_lines(docs: DataFrame) -> DataFrame:
    """A row for each line, from 0, with where the front matter ends and the text begins."""
    doc = Window.partitionBy(*DOC)
    rows = docs.select(*DOC, F.posexplode(tx.lines_of(F.col("content"))).alias("i", "line")).withColumn("t", tx.trimmed(F.col("line")))
    rows = rows.withColumn("first", F.min(F.when(F.col("t") != "", F.col("i"))).over(doc))
    rows = rows.withColumn("opens", F.max((F.col("i") == F.col("first")) & (F.col("t") == "---")).over(doc))
    rows = rows.withColumn("matter_end", F.min(F.when(F.col("opens") & (F.col("i") > F.col("first")) & (F.col("t") == "---"), F.col("i"))).over(doc))
    return rows.withColumn("start", F.coalesce(F.col("matter_end") + 1, F.lit(0)))


def front_matter(docs: DataFrame) -> DataFrame:
    """Identity and applicability fields of every document; the last of a repeated key counts."""
    rows = numbered_lines(docs).where("matter_end is not null and i > first and i < matter_end and instr(line, ':') > 0")
    key = F.lower(tx.trimmed(F.substring_index("line", ":", 1)))
    key = F.when(key == "system", "domain").when(key == "project", "architecture").otherwise(key)
    value = tx.trimmed(F.regexp_replace(tx.trimmed(F.regexp_replace("line", "^[^:]*:", "")), '^"+|"+$', ""))
    pairs = rows.select(*DOC, "i", key.alias("key"), value.alias("value")).where("value <> ''")
    names = ("module", "domain", "feature", "architecture", "lesson", "applies-when", "excludes", "guard-strength", "depends-on")
    found = pairs.groupBy(*DOC).agg(*[F.max_by(F.when(F.col("key") == n, F.col("value")), F.when(F.col("key") == n, F.col("i"))).alias(n.replace("-", "_")) for n in names])
    out = docs.select(*DOC).join(found, list(DOC), "left")

    def listed(c: str) -> Column:
        bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\[+|\]+$", "")
        return F.filter(F.transform(F.split(bare, ",", -1), lambda x: F.lower(F.regexp_replace(tx.trimmed(x), "^[\"']+|[\"']+$", ""))), lambda x: x != "")

    return out.withColumn("applies_when", listed("applies_when")).withColumn("excludes", listed("excludes")).withColumn("guard_strength", F.lower("guard_strength"))


def tier() -> Column:
    return F.coalesce(*[F.when(F.col(t).isNotNull(), t) for t in ("architecture", "feature", "lesson", "domain", "module")])


def identities(docs: DataFrame, default_system: str | None = None) -> DataFrame:
    """Module, system and root scope of every document."""
    scope = F.when(F.col("architecture").isNotNull(), "project").when(F.col("feature").isNotNull(), "feature").when(F.col("lesson").isNotNull(), "lesson").when(F.col("domain").isNotNull(), "domain").otherwise("module")
    module = F.coalesce(F.substring_index("module", "/", -1), tx.stem(F.col("relative")))
    return front_matter(docs).select(*DOC, module.alias("module"), F.coalesce("domain", "architecture", F.lit(default_system)).alias("system"), scope.alias("root_scope"), tier().alias("tier"), "applies_when", "excludes", "guard_strength")


def split_units(docs: DataFrame) -> DataFrame:
    """Units of every document by its ATX headings; fenced lines are no headings, line numbers count from 1.

    Everything is windows over a document's lines and units; a document is one row, so its lines are bounded by it.
    """
    doc = Window.partitionBy(*DOC)
    rows = numbered_lines(docs)
    rows = rows.withColumn("body_at", F.min(F.when((F.col("i") >= F.col("start")) & (F.col("t") != ""), F.col("i"))).over(doc))
    rows = rows.withColumn("level", tx.heading_level(F.col("line"))).withColumn("title", tx.heading_title(F.col("line")))
    rows = rows.withColumn("lead", (F.col("i") == F.col("body_at")) & (F.col("level") == 1))
    root = rows.groupBy(*DOC).agg(
        F.max(F.when(F.col("lead"), F.col("title"))).alias("lead_title"),
        F.coalesce(F.max(F.when(F.col("lead"), F.col("i") + 1)), F.max("start") + 1).alias("source_line"),
    )
    text = rows.where("i >= start and not lead")
    upto = Window.partitionBy(*DOC).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    text = text.withColumn("fenced", F.sum(tx.is_fence(F.col("line")).cast("int")).over(upto) % 2 == 1)
    text = text.withColumn("heads", ~F.col("fenced") & (F.col("level") > 0))
    text = text.withColumn("ord", F.sum(F.col("heads").cast("int")).over(upto))
    joined = lambda keep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("i", "line")))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    parts = text.groupBy(*DOC, "ord").agg(
        F.max(F.when(F.col("heads"), F.col("title"))).alias("title"),
        F.coalesce(F.max(F.when(F.col("heads"), F.col("level"))), F.lit(0)).alias("level"),
        F.max(F.when(F.col("heads"), F.col("i") + 1)).alias("line"),
        joined(~F.col("heads")).alias("body"),
        joined(F.lit(True)).alias("chunk"),
    )
    roots = root.select(*DOC, F.lit(0).cast("long").alias("ord"), F.coalesce("lead_title", tx.stem(F.col("relative"))).alias("title"), "source_line")
    zero = parts.where("ord = 0").select(*DOC, "body", "chunk")
    head = roots.join(zero, list(DOC), "left").select(*DOC, "ord", "title", F.lit(0).alias("level"), "source_line", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("chunk", F.lit("")).alias("chunk"))
    units = head.unionByName(parts.where("ord > 0").withColumnRenamed("line", "source_line"))
    before = Window.partitionBy(*DOC).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(7):
        units = units.withColumn(f"l{k}", F.max(F.when(F.col("level") == k, F.struct("ord", "title"))).over(before))
    # the last heading of level k is still open if no later one is of a smaller level
    open_ = []
    for k in range(7):
        later = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"l{j}.ord") < F.col(f"l{k}.ord"), F.lit(True)) for j in range(k)], F.lit(True))
        open_.append(F.when((F.col("level") > k) & F.col(f"l{k}").isNotNull() & later, F.col(f"l{k}")))
    stack = F.filter(F.array(*open_), lambda x: x.isNotNull())
    units = units.withColumn("stack", stack).drop(*[f"l{k}" for k in range(7)])
    parent = F.element_at(F.transform("stack", lambda s: s["ord"]), -1)
    units = units.withColumn("parent_ord", F.when(F.col("ord") > 0, parent))
    path = F.concat_ws(" > ", F.array_join(F.transform("stack", lambda s: s["title"]), " > "), "title")
    units = units.withColumn("heading_path", F.when(F.col("ord") > 0, path).otherwise(F.col("title")))
    units = units.withColumn("depth", F.size("stack")).drop("stack")
    kids = units.where("parent_ord is not null").select(*DOC, F.col("parent_ord").alias("ord"), F.lit(True).alias("has")).distinct()
    node = lambda o: F.concat(F.lit("doc:"), "relative", F.when(o > 0, F.concat(F.lit("#s"), o.cast("string"))).otherwise(F.lit("")))
    return units.join(kids, [*DOC, "ord"], "left").select(
        *DOC,
        node(F.col("ord")).alias("id"),
        F.when(F.col("parent_ord").isNotNull(), node(F.col("parent_ord"))).alias("parent_id"),
        "title",
        F.when(F.col("ord") == 0, "overview").otherwise(tx.classify_kind(F.col("title"))).alias("kind"),
        F.when(F.col("ord") == 0, "module").when(F.col("depth") <= 1, "section").otherwise("subsection").alias("scope"),
        "heading_path",
        F.col("level").cast("int").alias("level"),
        "body",
        "chunk",
        F.col("source_line").cast("int").alias("source_line"),
        F.col("ord").cast("int").alias("ord"),
        F.coalesce("has", F.lit(False)).alias("has_children"),
    )


def _violation(rule: str, severity: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))


def violations(units: DataFrame) -> DataFrame:
    """A row for each rule that a unit breaks (a rule per bullet for unclear references)."""
    body = tx.trimmed(F.col("body"))
    dense = F.length(F.regexp_replace(body, r"\s", ""))
    unclear = F.filter(tx.bullets(F.col("body")), lambda b: b.rlike(tx.PRONOUN) & ~b.contains("`") & ~F.exists(F.split(b, r"[^\p{L}\p{N}_]+", -1), tx.looks_like_symbol))
    rules = F.array(
        _violation("empty-leaf", "quarantine", (body == "") & ~F.col("has_children")),
        _violation("thin-content", "degrade", (body != "") & (dense < THIN_CHARS)),
        _violation("missing-envelope", "degrade", tx.trimmed(F.col("heading_path")) == ""),
    )
    claims = F.when(tx.claim_bucket(F.col("title")).isNotNull(), F.transform(unclear, lambda _: F.struct(F.lit("unclear-reference").alias("rule"), F.lit("degrade").alias("severity")))).otherwise(F.expr("cast(array() as array<struct<rule:string,severity:string>>)"))
    return units.select(*DOC, "id", "source_line", F.explode(F.filter(F.concat(rules, claims), lambda v: v.isNotNull())).alias("v")).select(*DOC, "id", "source_line", "v.rule", "v.severity")


def statuses(units: DataFrame, broken: DataFrame) -> DataFrame:
    """id and status: the worst severity folded."""
    rank = F.when(F.col("severity") == "quarantine", 2).when(F.col("severity") == "degrade", 1).otherwise(0)
    worst = broken.groupBy(*DOC, "id").agg(F.max(rank).alias("worst"))
    status = F.when(F.col("worst") == 2, "quarantined").when(F.col("worst") == 1, "degraded").otherwise("accepted")
    return units.join(worst, [*DOC, "id"], "left").select(*DOC, "id", status.alias("status"))


def boundary_gaps(units: DataFrame, docs: DataFrame) -> DataFrame:
    """Root units of documents other than projects and lessons that state no boundaries."""
    have = units.groupBy(*DOC).agg(F.max(F.coalesce(tx.claim_bucket(F.col("title")) == "boundary", F.lit(False))).alias("has"))
    roots = units.where("parent_id is null").join(identities(docs), list(DOC)).join(have, list(DOC))
    return roots.where("root_scope not in ('project', 'lesson') and not has").select(*DOC, "id", "source_line", F.lit("missing-boundaries").alias("rule"), F.lit("degrade").alias("severity"))


def schema_gaps(units: DataFrame, docs: DataFrame, overrides: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Section kinds that a document's tier requires and the document has nowhere."""
    required = REQUIRED | (overrides or {})
    need = F.create_map(*[x for t, kinds in required.items() for x in (F.lit(t), F.array(*map(F.lit, kinds)) if kinds else F.expr("cast(array() as array<string>)"))])
    have = units.groupBy(*DOC).agg(F.collect_set("kind").alias("kinds"))
    rows = front_matter(docs).select(*DOC, tier().alias("tier")).where("tier is not null").join(have, list(DOC))
    return rows.select(*DOC, "tier", F.explode(F.array_except(F.coalesce(F.element_at(need, F.col("tier")), F.expr("cast(array() as array<string>)")), "kinds")).alias("kind"))


def lint(docs: DataFrame) -> DataFrame:
    """rule, level, line of every finding of the document rules."""
    matter = front_matter(docs)
    lines = numbered_lines(docs)
    opens = lines.groupBy(*DOC).agg(F.coalesce(F.max("opens"), F.lit(False)).alias("matter"))
    m = matter.join(opens, list(DOC))
    has = {t: F.col(t).isNotNull() for t in ("architecture", "domain", "module", "feature", "lesson")}
    conflict = has["architecture"] & (has["domain"] | has["module"] | has["feature"] | has["lesson"]) | has["domain"] & (has["module"] | has["feature"] | has["lesson"]) | has["feature"] & has["lesson"]
    fields = (F.size("applies_when") > 0) | (F.size("excludes") > 0) | F.col("guard_strength").isNotNull() | F.col("depends_on").isNotNull()
    bad_slugs = F.filter(F.concat("applies_when", "excludes"), lambda s: ~tx.is_slug(s))
    finding = lambda rule, level, when: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level")))
    by_doc = m.select(
        *DOC,
        F.lit(1).alias("line"),
        F.explode(
            F.filter(
                F.concat(
                    F.array(
                        finding("frontmatter-missing", "error", ~F.col("matter")),
                        finding("tier-conflict", "error", F.col("matter") & conflict),
                        finding("feature-needs-module", "error", F.col("matter") & has["feature"] & ~has["module"]),
                        finding("frontmatter-no-tier", "error", F.col("matter") & tier().isNull()),
                        finding("lesson-guard-strength-invalid", "error", ~F.col("guard_strength").isin(*GUARD_STRENGTHS)),
                        finding("lesson-field-misplaced", "warning", fields & ~has["lesson"]),
                    ),
                    F.transform(bad_slugs, lambda _: F.struct(F.lit("lesson-slug-invalid").alias("rule"), F.lit("error").alias("level"))),
                ),
                lambda f: f.isNotNull(),
            )
        ).alias("f"),
    ).select(*DOC, "line", "f.*")
    upto = Window.partitionBy(*DOC).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    fenced = lines.withColumn("fenced", (F.sum(tx.is_fence(F.col("line")).cast("int")).over(upto) % 2 == 1) | tx.is_fence(F.col("line")))
    level = tx.heading_level(F.col("line"))
    by_line = fenced.where("not fenced").select(
        *DOC,
        (F.col("i") + 1).alias("line"),
        F.when((level > 0) & F.col("line").rlike(r"^\s+#"), "heading-indent").when(F.col("line").rlike(r"^\s*#{1,6}[^#\s]"), "heading-no-space").alias("rule"),
        F.lit("error").alias("level"),
    ).where("rule is not null")
    units = split_units(docs)
    gaps = schema_gaps(units, docs).select(*DOC, F.lit(1).alias("line"), F.lit("schema-missing-section").alias("rule"), F.lit("warning").alias("level"))
    generic = units.where("level = 2 and kind = 'section'").select(*DOC, F.col("source_line").alias("line"), F.lit("section-kind-generic").alias("rule"), F.lit("warning").alias("level"))
    body = units.select(*DOC, "id", "title", "source_line", F.posexplode(tx.lines_of(F.col("body"))).alias("k", "raw")).withColumn("t", tx.trimmed(F.col("raw")))
    bullet = F.col("t").rlike(r"^[-*] ")
    so_far = Window.partitionBy(*DOC, "id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    prose = body.where(tx.claim_bucket(F.col("title")).isNotNull()).withColumn("seen", F.max(bullet).over(so_far)).where("t <> '' and not seen")
    prose = prose.select(*DOC, (F.col("source_line") + F.col("k") + 1).alias("line"), F.lit("claims-not-bulleted").alias("rule"), F.lit("error").alias("level"))
    cited = body.where("lower(title) = 'evidence' and t <> ''").join(matter.where("lesson is null").select(*DOC), list(DOC), "left_semi")
    malformed = ~bullet | F.coalesce(tx.evidence(F.regexp_replace("t", r"^[-*] ", ""))["file"].isNull(), F.lit(True))
    wrong = cited.where(malformed).select(*DOC, (F.col("source_line") + F.col("k") + 1).alias("line"), F.lit("evidence-malformed").alias("rule"), F.lit("error").alias("level"))
    contract = violations(units).select(*DOC, F.col("source_line").alias("line"), "rule", F.lit("warning").alias("level"))
    roots = docs.groupBy("library").agg(F.max((F.col("relative") == "Architecture.md")).alias("has"), F.max(F.col("relative").startswith("docs/")).alias("nested"))
    layout = roots.where("not has").select("library", F.lit(".").alias("relative"), F.lit(None).cast("int").alias("line"), F.lit("missing-architecture").alias("rule"), F.lit("warning").alias("level"))
    layout = layout.unionByName(roots.where("nested").select("library", F.lit("docs").alias("relative"), F.lit(None).cast("int").alias("line"), F.lit("nested-docs-dir").alias("rule"), F.lit("warning").alias("level")))
    return reduce(DataFrame.unionByName, [by_doc, by_line, gaps, generic, prose, wrong, contract, layout])


def claims(units: DataFrame) -> DataFrame:
    """Claims and boundaries with their source and the place they are bound to."""
    rows = units.where(tx.claim_bucket(F.col("title")).isNotNull()).select(*DOC, "id", tx.claim_bucket(F.col("title")).alias("kind"), F.posexplode(tx.bullets(F.col("body"))).alias("ord", "raw"))
    rows = rows.withColumn("marked", tx.claim_source(F.col("raw"))).withColumn("text", tx.claim_text(F.col("raw"))).withColumn("bound", tx.evidence(F.col("text")))
    source = F.coalesce("marked", F.when(F.col("bound.file").isNotNull(), "extracted"), F.lit("inferred"))
    return rows.select(*DOC, "id", "kind", "ord", "text", source.alias("source"), F.col("bound.symbol").alias("symbol"), F.when(F.col("bound.file").isNotNull(), F.col("bound.file")).alias("file"))


def references(units: DataFrame) -> DataFrame:
    """Evidence (bound by the author) and mentions (backticked, then plain) of every unit."""
    cited = units.where("lower(title) = 'evidence'").select(*DOC, "id", F.explode(tx.bullets(F.col("body"))).alias("b")).withColumn("e", tx.evidence(F.col("b"))).where("e is not null")
    cited = cited.select(*DOC, "id", "e.symbol", F.lit("evidence").alias("ref_kind"), F.col("e.file").alias("claimed_file"), F.col("e.line").alias("claimed_line"), F.lit(True).alias("quoted"))
    other = units.where("lower(title) <> 'evidence'")
    quoted = tx.backtick_symbols(F.col("body"))
    said = other.select(*DOC, "id", F.explode(F.concat(F.transform(quoted, lambda s: F.struct(s.alias("symbol"), F.lit(True).alias("quoted"))), F.transform(F.array_except(tx.plain_symbols(F.col("body")), quoted), lambda s: F.struct(s.alias("symbol"), F.lit(False).alias("quoted"))))).alias("m"))
    said = said.select(*DOC, "id", "m.symbol", F.lit("mention").alias("ref_kind"), F.lit(None).cast("string").alias("claimed_file"), F.lit(None).cast("long").alias("claimed_line"), "m.quoted")
    return cited.unionByName(said)
