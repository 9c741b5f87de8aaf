"""Code layer: symbols and edges of source files, lookups and reference resolution."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text as tx

# Call targets that name nothing of interest.
CALL_NOISE = ("if", "for", "while", "switch", "return", "sizeof", "catch", "defined", "assert", "print", "len", "range", "str", "int", "super")

#: Pattern sets for languages without a parser here: (symbol kind or relation, pattern with the name in group 1).
PATTERNS: dict[str, tuple[tuple[str, str], ...]] = {
    "cpp": (("class", r"^\s*class\s+(?:[A-Z_]+_API\s+)?(\w+)[^;{]*\{?$"), ("struct", r"^\s*struct\s+(?:[A-Z_]+_API\s+)?(\w+)[^;]*$"), ("include", r'^\s*#include\s+["<]([^">]+)[">]'), ("inherits", r"^\s*(?:class|struct)\s+[\w ]+:\s*(?:public|protected|private)?\s*(\w+)")),
    "rust": (("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("function", r"^\s*(?:pub(?:\(\w+\))?\s+)?fn\s+(\w+)"), ("import", r"^\s*use\s+([\w:]+)")),
    "go": (("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("import", r'^\s*(?:import\s+)?"([\w./-]+)"$')),
    "java": (("class", r"^\s*(?:public\s+|abstract\s+|final\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("function", r"^\s+(?:public|protected|private)\s+[\w<>\[\], ]+\s(\w+)\("), ("import", r"^import\s+([\w.]+);")),
    "csharp": (("class", r"^\s*(?:public\s+|internal\s+|sealed\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("function", r"^\s+(?:public|protected|private)\s+[\w<>\[\], ]+\s(\w+)\("), ("import", r"^using\s+([\w.]+);")),
    "typescript": (("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*="), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("import", r"""^import\s.*from\s+['"]([^'"]+)['"]"""), ("inherits", r"class\s+\w+\s+extends\s+(\w+)")),
}
PATTERNS["tsx"] = PATTERNS["javascript"] = PATTERNS["typescript"]
RELATIONS = ("include", "import", "inherits")


def _python(content: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return
    def walk(node: ast.AST, scope: str, function: str) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                yield "symbol", child.name, f"{scope}{child.name}", "class", "", child.lineno
                for base in child.bases:
                    if isinstance(base, ast.Name):
                        yield "edge", child.name, "", "inherits", base.id, child.lineno
                yield from walk(child, f"{scope}{child.name}::", function)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                yield "symbol", child.name, f"{scope}{child.name}", "function", "", child.lineno
                yield from walk(child, scope, child.name)
            else:
                if isinstance(child, ast.Import | ast.ImportFrom):
                    for name in [child.module] if isinstance(child, ast.ImportFrom) and child.module else [a.name for a in child.names]:
                        yield "edge", function, "", "import", name, child.lineno
                elif isinstance(child, ast.Call):
                    target = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else ""
                    if target and target not in CALL_NOISE and function:
                        yield "edge", function, "", "call", target, child.lineno
                yield from walk(child, scope, function)

    yield from walk(tree, "", "")


def _patterns(language: str, content: str) -> Iterator[tuple]:
    compiled = [(k, re.compile(p)) for k, p in PATTERNS.get(language, PATTERNS["typescript"])]
    call = re.compile(r"(?<![\w.])(?:\w+(?:\.|->|::))*(\w+)\s*\(")
    method = re.compile(r"^[\w:<>*&\s]*?\b(\w+)::(\w+)\s*\([^;]*$")
    owner, function = "", ""
    for n, line in enumerate(content.splitlines(), 1):
        named = False
        if language == "cpp" and (m := method.match(line)):
            function, named = m[2], True
            yield "symbol", m[2], f"{m[1]}::{m[2]}", "function", "", n
        for kind, p in compiled:
            if m := p.search(line):
                if kind in RELATIONS:
                    yield "edge", owner if kind == "inherits" else "", "", kind, m[1], n
                else:
                    named = True
                    if kind == "function":
                        function = m[1]
                    else:
                        owner = m[1]
                    yield "symbol", m[1], m[1], kind, "", n
        if not named and function:
            for m in call.finditer(line):
                if m[1] not in CALL_NOISE:
                    yield "edge", function, "", "call", m[1], n


@udtf(returnType="entry string, name string, qualified_name string, kind string, target string, line int")
class ScanSource:
    """Symbols and edges of one file: the stdlib parser for Python, line patterns for the other languages."""

    def eval(self, language: str, content: str):
        found = _python(content or "") if language == "python" else _patterns(language, content or "")
        for entry, name, qualified, kind, target, line in found:
            yield entry, name, qualified, kind, target, line


def scanned(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of files with path, language and content."""
    spark = files.sparkSession
    spark.udtf.register("cairnlight_scan", ScanSource)
    files.createOrReplaceTempView("cairnlight_files")
    rows = spark.sql("SELECT f.path AS file, f.language, s.* FROM cairnlight_files f, LATERAL cairnlight_scan(f.language, f.content) s")
    symbols = rows.where("entry = 'symbol'").select("file", "language", "name", "qualified_name", "kind", "line", F.lit("definition").alias("role"))
    edges = rows.where("entry = 'edge'").select(F.col("file").alias("source_file"), F.col("name").alias("source_symbol"), F.col("target").alias("target_symbol"), F.col("kind").alias("relation"), "line")
    return symbols, edges


def distinct_edges(edges: DataFrame) -> DataFrame:
    """inherits and uses_type once for each (source, target), reads and writes once a line too; others stay as they are."""
    key = F.when(F.col("relation").isin("inherits", "uses_type"), F.lit("")).when(F.col("relation").isin("reads", "writes"), F.col("line").cast("string"))
    keyed = edges.withColumn("_key", key)
    one = Window.partitionBy("source_file", "source_symbol", "target_symbol", "relation", "_key").orderBy("line", "id")
    first = keyed.where("_key is not null").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n", "_key")
    return first.unionByName(keyed.where("_key is null").drop("_key"))


def symbol_keys(symbols: DataFrame) -> DataFrame:
    """A row for each key (name or qualified name) with its best definition. An equi-join on the key replaces an OR."""
    kind = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "struct", 1).otherwise(2)
    best = F.struct((F.col("role") != "definition").alias("declared"), kind.alias("kind_rank"), "file", "line")
    keys = symbols.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"), best.alias("best"))
    return keys.groupBy("key").agg(F.min("best").alias("best")).select("key", F.col("best.file").alias("resolved_file"), F.col("best.line").alias("resolved_line"))


def resolved(rows: DataFrame, symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """``rows`` with resolved_file, resolved_line, resolved."""
    return rows.join(symbol_keys(symbols).withColumnRenamed("key", column), column, "left").withColumn("resolved", F.col("resolved_file").isNotNull())


def domain(relation: Column, kind: Column) -> Column:
    return F.when(relation == "call", kind == "function").when(relation.isin("inherits", "uses_type"), ~kind.isin("function", "field")).when(relation.isin("reads", "writes"), kind == "field").otherwise(False)


def _group(kind: Column) -> Column:
    return F.when(kind == "function", "function").when(kind == "field", "field").otherwise("type")


def resolve_edges(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """id and target_file: class scope, then the same file's only definition, then the language's only one, else ''.

    Imports and includes keep what they say. Every tier is an equi-join against one pre-aggregated row for each key.
    """
    group = F.when(F.col("relation") == "call", "function").when(F.col("relation").isin("reads", "writes"), "field").when(F.col("relation").isin("inherits", "uses_type"), "type")
    e = edges.withColumn("grp", group).join(files.select(F.col("path").alias("source_file"), F.col("language").alias("source_language")), "source_file", "left")
    prefix = F.expr("substring(qualified_name, 1, length(qualified_name) - length(name))")
    callers = symbols.where("kind = 'function' and qualified_name <> name and endswith(qualified_name, name)").groupBy(F.col("file").alias("source_file"), F.col("name").alias("source_symbol")).agg(F.min(prefix).alias("prefix"))
    definitions = symbols.where("role = 'definition'").withColumn("grp", _group(F.col("kind")))
    members = definitions.where("kind in ('function', 'field')").groupBy("grp", F.col("qualified_name").alias("member")).agg(F.min("file").alias("t1"))
    local = definitions.groupBy("grp", F.col("file").alias("source_file"), F.col("name").alias("target_symbol")).agg(F.count("*").alias("n")).where("n = 1").select("grp", "source_file", "target_symbol", F.col("source_file").alias("t2"))
    whole = definitions.groupBy("grp", F.col("name").alias("target_symbol"), F.col("language").alias("source_language")).agg(F.count("*").alias("n"), F.min("file").alias("t3")).where("n = 1").drop("n")
    e = e.join(callers, ["source_file", "source_symbol"], "left").withColumn("member", F.when(F.col("grp").isin("function", "field"), F.concat("prefix", "target_symbol")))
    e = e.join(members, ["grp", "member"], "left").join(local, ["grp", "source_file", "target_symbol"], "left").join(whole, ["grp", "target_symbol", "source_language"], "left")
    keeps = F.when(F.col("relation").isin("import", "include"), F.col("target_symbol"))
    return e.select("id", "source_file", "source_symbol", "target_symbol", "relation", F.coalesce(keeps, "t1", "t2", "t3", F.lit("")).alias("target_file"))


def file_nodes(symbols: DataFrame) -> DataFrame:
    """A mechanical unit for each file: a histogram of kinds, the first four types, how many symbols it cites (at most 40)."""
    kinds = symbols.groupBy("file", "kind").agg(F.count("*").alias("n"))
    histogram = kinds.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["kind"])), ", ").alias("histogram"), F.sum("n").alias("n_symbols"))
    order = Window.partitionBy("file").orderBy("line", "name")
    heads = symbols.where("kind in ('class', 'struct')").withColumn("k", F.row_number().over(order)).where("k <= 4").groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ", ").alias("headline"))
    return histogram.join(heads, "file", "left").select(F.concat(F.lit("file:"), "file").alias("id"), tx.basename(F.col("file")).alias("title"), "histogram", F.coalesce("headline", F.lit("")).alias("headline"), F.least("n_symbols", F.lit(40)).alias("n_refs"))
