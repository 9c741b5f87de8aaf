r"""Quality rules as a short-circuit cascade, with Spark expressions only.

Each rule is a predicate that rejects a text. A sample of the documents, written once, gives every rule's rejection
rate by counts and its cost by timing; rules then run by rejection per cost, greedily on what the rules before have
left, and a text leaves at the first rule that rejects it (CASE WHEN evaluates no later branch). The order changes the
time, never the verdict: a text is kept when no rule rejects it.

Defined results: a null text counts as no words; repeated rows each get their own row; an empty table gives no rows;
columns other than doc_id and text are ignored. Counts cover whole texts, however long.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, dropped, let, read, written

WORD = f"[^{SPACE}]+"

#: Words of abuse: the word list of one rule, a choice of ours.
ABUSE = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")


@dataclass(frozen=True)
class Rule:
    """``rejects`` reads columns text, n_words, word_chars, n_symbols, n_dup_lines, n_lines."""

    name: str
    rejects: Callable[[], Column]


def _count(pattern: str) -> Column:
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


RULES = (
    Rule("symbols", lambda: F.col("n_symbols") * 5 > F.col("n_words")),
    Rule("duplicate_lines", lambda: (F.col("n_dup_lines") * 2 > F.col("n_lines")) & (F.col("n_lines") > 3)),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("shouting", lambda: F.length(F.regexp_replace("text", r"[^!]+", "")) * 3 > F.col("n_words")),
    Rule("capitals", lambda: _count(r"\p{Lu}+") * 2 > F.col("word_chars")),
    Rule("abuse", lambda: F.size(F.regexp_extract_all("text", F.lit(rf"(?i)\b(?:{'|'.join(ABUSE)})\b"), F.lit(0))) >= 2),
)


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that stand in a window of ``width`` words found twice or more in the same text.

    Windows are compared by a chained 64-bit hash of their words; only texts with a repeated hash are sorted.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def starts(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.coalesce(F.least(F.lit(width), F.get(at, j + 1) - x), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(starts(h), covered))

    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(let(hashes(words), counted))


def features(documents: DataFrame) -> DataFrame:
    """doc_id, text and the counts that rules read."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    return docs.select(
        "doc_id",
        "text",
        let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        _count(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
    ).select("doc_id", "text", "w.*", "l.*", "n_symbols")


def costs(sample: DataFrame, rules: tuple[Rule, ...] = RULES, repeats: int = 2) -> dict[str, float]:
    """Seconds that each rule takes on the sample: the best of some runs, less those of a run that only reads the rows."""

    def seconds(flag: Column) -> float:
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            sample.agg(F.count_if(flag), F.sum(F.length("text"))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    bare = seconds(F.col("n_words") < 0)
    # what the clock can't tell from nothing costs a ten-thousandth of a second
    return {r.name: max(1e-4, seconds(r.rejects()) - bare) for r in rules}


def ordered(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[Rule]:
    """Rules by rejection per cost, greedily: each next rule is judged on the sampled rows that the earlier ones left.

    The sample is about ``sample_rows`` rows, drawn row by row, so that a frequent doc_id weighs as much as its rows do.
    It decides an order of evaluation and nothing else. The driver gets a count for each set of rules that reject.
    """
    share = min(1.0, sample_rows / max(1, documents.count()))
    sample = written(features(documents.sample(share, seed=7)).hint("rebalance"), "sample")
    flags = [F.coalesce(r.rejects(), F.lit(False)).alias(r.name) for r in rules]
    left = sample.select(*flags).groupBy(*[r.name for r in rules]).agg(F.count("*").alias("_n")).collect()
    cost = costs(sample, rules) if left else {r.name: 1.0 for r in rules}
    dropped(sample)
    rest, out = list(rules), []
    while rest:
        best = max(rest, key=lambda r: (sum(f["_n"] for f in left if f[r.name]) / cost[r.name], -cost[r.name]))
        out.append(best)
        rest.remove(best)
        left = [f for f in left if not f[best.name]]
    return out


def judged(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """Features of every document, with ``rejected_by``: the first rule of the cascade that rejects it, else null."""
    verdict = None
    for rule in ordered(documents, rules, sample_rows):
        verdict = (F.when if verdict is None else verdict.when)(rule.rejects(), F.lit(rule.name))
    return features(documents).withColumn("rejected_by", verdict if verdict is not None else F.lit(None).cast("string"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(read(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & F.col("rejected_by").isNull()).alias("kept"),
    )


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)
), g AS (
  SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), n AS (
  SELECT doc_id, i, CASE WHEN c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, b, c) > 1 THEN 1 ELSE 0 END AS twice FROM g
), k AS (
  SELECT doc_id, CASE WHEN twice = 1 OR lag(twice, 1) OVER o = 1 OR lag(twice, 2) OVER o = 1 THEN 1 ELSE 0 END AS hit
  FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, sum(hit) AS n_repeat_words FROM k GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id
), f AS (
  SELECT d.doc_id, d.text,
    CAST(coalesce(s.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(s.word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 5 > n_words OR (n_dup_lines * 2 > n_lines AND n_lines > 3)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR length(regexp_replace(text, '[^!]', '', 'g')) * 3 > n_words
    OR (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g'))) * 2 > word_chars
    OR len(regexp_extract_all(text, '(?i)\b(?:{"|".join(ABUSE)})\b')) >= 2) AS kept
FROM b
"""

QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": ORACLE_SQL}
