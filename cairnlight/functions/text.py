"""Column functions that turn text into structure."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword of a section title -> kind, first match wins. \b marks a whole word: neither a letter nor a digit
# stands beside it, so that an underscore ends a word.
KINDS = (
    ("flow", "data_flow"),
    ("architect", "architecture"),
    ("responsib", "responsibility"),
    ("struct", "data_structure"),
    ("claim", "design_decision"),
    ("boundar", "boundary"),
    ("depend", "dependency"),
    ("evidence", "evidence"),
    ("context", "context"),
    ("risk|impact", "impact"),
    ("edge ?case", "edge_case"),
    ("symptom", "symptom"),
    (r"root cause|\bcause\b", "root_cause"),
    (r"\bfix\b|resolution", "fix"),
    ("guard|prevention", "guard"),
)

# File extension -> language.
LANGUAGES = {
    "h": "cpp", "hpp": "cpp", "hh": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "cpp", "inl": "cpp",
    "cs": "csharp", "go": "go", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "py": "python", "rs": "rust", "ts": "typescript", "tsx": "tsx",
}

# A bullet that opens with one of these names no subject.
PRONOUN = r"(?i)^(it|this|that|they|these|those|he|she|the (module|system|feature|document|doc)|this (module|system|feature|document))\b|^(它|它们|该|上述|此)"

SUMMARY_CHARS = 300

HEADING = r"^\s*(#{1,6})[ \t]+(\S.*?)\s*$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once per row for use inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final end makes no further line."""
    return F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n", -1)


def heading_level(line: Column) -> Column:
    """1 to 6, or 0 for a line that is no heading."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_title(line: Column) -> Column:
    return F.regexp_extract(line, HEADING, 2)


def is_fence(line: Column) -> Column:
    return line.rlike(r"^\s*(```|~~~)")


def classify_kind(title: Column) -> Column:
    low = F.lower(title)
    out = F
    for pattern, kind in KINDS:
        out = out.when(low.rlike(re.sub(r"\\b(\w+)\\b", r"(?<![\\p{L}\\p{N}])\1(?![\\p{L}\\p{N}])", pattern)), kind)
    return out.otherwise("section")


def claim_bucket(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.contains("claim"), "claim").when(low.contains("boundar"), "boundary")


def first_paragraph(body: Column) -> Column:
    """The first run of lines with text, joined by spaces; null where there is none."""
    lines = F.transform(lines_of(body), trimmed)
    whole = F.array_join(F.transform(lines, lambda x: F.when(x == "", F.lit("\u0001")).otherwise(x)), "\n")
    first = F.regexp_extract(whole, "[^\u0001\n][^\u0001]*", 0)
    text = F.substring(trimmed(F.regexp_replace(first, "\n", " ")), 1, SUMMARY_CHARS)
    return F.when(text != "", text)


def bullets(body: Column) -> Column:
    """Items of a list: a marker begins one, further lines with text join the last that has any."""
    start = F.expr("named_struct('items', cast(array() as array<string>), 'open', false)")

    def step(acc: Column, raw: Column) -> Column:
        line = trimmed(raw)
        marked = line.rlike(r"^[-*]\s") | line.isin("-", "*")
        text = F.when(marked, trimmed(F.substr(line, F.lit(2)))).otherwise(line)
        items = acc["items"]
        joined = F.concat(F.slice(items, 1, F.size(items) - 1), F.array(F.concat_ws(" ", F.element_at(items, -1), text)))
        grown = F.when(marked & (text != ""), F.concat(items, F.array(text))).when(~marked & (text != "") & acc["open"] & (F.size(items) > 0), joined).otherwise(items)
        return F.struct(grown.alias("items"), F.when(marked, text != "").otherwise(acc["open"]).alias("open"))

    return F.aggregate(lines_of(body), start, step, lambda acc: acc["items"])


def normal_symbol(token: Column) -> Column:
    """A backticked token as an identifier, or null."""
    bare = trimmed(F.regexp_replace(trimmed(token), r"\(\)$", ""))
    return F.when(bare.rlike(r"^[\p{L}\p{N}_:]+$") & ~bare.rlike(r"^\p{N}+$"), bare)


def looks_like_symbol(token: Column) -> Column:
    snake = token.contains("_") & token.rlike("[A-Za-z]")
    humps = (F.length(F.regexp_replace(token, "[^A-Z]", "")) >= 2) & token.rlike("[a-z]")
    return (F.length(token) >= 4) & (snake | humps)


def backticked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))


def backtick_symbols(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(backticked(text), normal_symbol), lambda s: s.isNotNull()))


def plain_symbols(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0)), looks_like_symbol))


def mentioned_symbols(text: Column) -> Column:
    return F.array_distinct(F.concat(backtick_symbols(text), plain_symbols(text)))


MARKER = r"(?i)^\s*\[(extracted|inferred)\]\s*"


def claim_source(text: Column) -> Column:
    found = F.lower(F.regexp_extract(text, MARKER, 1))
    return F.when(found != "", found)


def claim_text(text: Column) -> Column:
    return F.regexp_replace(text, MARKER, "")


FILE_LINE = r"^\s*(.*\S)\s*:\s*(-?\d+)\s*$"


def evidence(bullet: Column) -> Column:
    """symbol, file, line of an evidence bullet; null without a symbol. The last path counts."""

    def of(tokens: Column) -> Column:
        located = F.filter(tokens, lambda t: t.rlike(FILE_LINE) | t.contains("/"))
        symbols = F.filter(F.transform(F.filter(tokens, lambda t: ~(t.rlike(FILE_LINE) | t.contains("/"))), normal_symbol), lambda s: s.isNotNull())
        numbered = F.filter(tokens, lambda t: t.rlike(FILE_LINE))
        last = F.get(located, F.size(located) - 1)
        file = F.when(last.rlike(FILE_LINE), F.regexp_extract(last, FILE_LINE, 1)).otherwise(last)
        line = F.regexp_extract(F.get(numbered, F.size(numbered) - 1), FILE_LINE, 2).cast("long")
        return F.when(F.size(symbols) > 0, F.struct(F.get(symbols, F.lit(0)).alias("symbol"), file.alias("file"), line.alias("line")))

    return let(backticked(bullet), of)


def query_terms(query: Column) -> Column:
    """Lower-case terms; a repeated term stays."""
    return F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]", -1), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = None
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name) if out is None else out.when(ext == e, name)
    return out.otherwise("typescript")


def excluded(path: Column, patterns: list[str]) -> Column:
    """Name, path or ``*`` segment patterns."""
    out = F.lit(False)
    for p in patterns:
        if "*" in p:
            parts = ["[^/]*".join(map(_quoted, seg.split("*"))) for seg in p.split("/")]
            out = out | path.rlike(f"(^|/){'/'.join(parts)}(/|$)")
        else:
            out = out | (path == p) | path.startswith(p + "/") | path.contains(f"/{p}/") | path.endswith("/" + p)
    return out


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def slugs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ",", -1), trimmed), lambda s: s != "")


def is_slug(text: Column) -> Column:
    return text.rlike("^[a-z0-9][a-z0-9-]*$")


def truncated(text: Column, limit: int) -> Column:
    one = F.regexp_replace(text, "\n", " ")
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit), F.lit("…"))).otherwise(one)


def xml_escaped(text: Column) -> Column:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def cdata(text: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def evidence_without_lines(text: Column) -> Column:
    """On lines that say ``defined at``, line numbers before a closing backtick go."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(x.contains("defined at"), F.regexp_replace(x, r":\d+`", "`")).otherwise(x)), "\n")


def placeholders(text: Column) -> Column:
    """Names in ``${NAME}``, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}"), F.lit(1)))
