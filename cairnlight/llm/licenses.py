r"""License scan by a positional rare-token index, with Spark expressions only.

Templates are short licence texts or phrases. For every template, the corpus's document frequencies say which of its
words are rarest; those are its anchors, kept with their places in the template (the index's postings). A file's words
are looked up in the index; an anchor at word p of the file that stands at word a of the template votes for a template
start p - a. Starts that all anchors of a template agree on are candidates, and a candidate counts when the template's
mandatory key phrase stands at its place there, word by word. A phrase without further text is its own key phrase, so
its candidates are exactly the places where its words stand consecutively: every place holds the rarest word.

The score of a text is the best share of a template's words that stand in their places around a verified start.

Defined results: a null text counts as empty (no words, no labels, score 0); repeated rows each get their own row; an
empty table gives no rows; columns other than doc_id and text are ignored. Texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``key``: words (first, last) of the template that must stand at their places; by default all of them."""

    label: str
    text: str
    key: tuple[int, int] | None = None
    base: bool = False
    words: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        import re

        words = tuple(re.findall("[0-9a-z]+", self.text.lower()))
        object.__setattr__(self, "words", words)
        if self.key is None:
            object.__setattr__(self, "key", (0, len(words) - 1))

    @property
    def key_words(self) -> tuple[str, ...]:
        return self.words[self.key[0] : self.key[1] + 1]


#: Base phrases and labels (fixed by the query's contract), then the method's own templates.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0", (3, 7)),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", (0, 6)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", (0, 7)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", (12, 14)),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc0", "cc0 1 0 universal"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", (0, 3)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", (3, 5)),
    Template("all-rights-reserved", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def frequencies(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each word of the templates stands. The result has at most as many rows as they have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = documents.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def anchors(template: Template, df: dict[str, int], how_many: int = 2) -> list[tuple[int, str]]:
    """The template's rarest words of its key phrase with their places; the earliest place of a word counts."""
    first: dict[str, int] = {}
    for at, w in enumerate(template.words):
        if template.key[0] <= at <= template.key[1]:
            first.setdefault(w, at)
    rare = sorted(first.items(), key=lambda x: (df.get(x[0], 0), x[1]))[:how_many]
    return [(at, w) for w, at in rare]


def starts(words: Column, template: Template, df: dict[str, int]) -> Column:
    """Places where the template starts: votes of the rarest anchor, joined by the other anchors and the key phrase."""
    (place, rarest), *others = anchors(template, df)
    votes = F.filter(F.transform(words, lambda w, p: F.when(w == rarest, p - place)), lambda s: s.isNotNull())

    def stands(at: int, word: str, s: Column) -> Column:
        return F.coalesce(F.get(words, s + at) == word, F.lit(False))

    def agreed(s: Column) -> Column:
        tests = [stands(at, w, s) for at, w in others]
        tests += [stands(template.key[0] + k, w, s) for k, w in enumerate(template.key_words)]
        return reduce(lambda a, b: a & b, tests)

    return F.filter(votes, agreed)


def share(words: Column, template: Template, found: Column) -> Column:
    """The best share of the template's words that stand in their places, over its starts."""
    n = len(template.words)

    def of(s: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce((F.get(words, s + k) == w).cast("int"), F.lit(0)) for k, w in enumerate(template.words)]) / F.lit(float(n))

    return F.coalesce(F.array_max(F.transform(found, of)), F.lit(0.0))


def scanned(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, hits: an array of (label, base, places, first, last, share), one for each template that is found.

    Places are of the key phrase's first word. ``first`` and ``last`` are the smallest and the largest of them.
    """
    df = frequencies(documents, templates)
    vocabulary = {anchors(t, df)[0][1] for t in templates}

    def hits(words: Column) -> Column:
        def of(t: Template) -> Column:
            return let(
                starts(words, t, df),
                lambda s: F.when(
                    F.size(s) > 0,
                    F.struct(
                        F.lit(t.label).alias("label"),
                        F.lit(t.base).alias("base"),
                        F.size(s).cast("long").alias("places"),
                        (F.array_min(s) + t.key[0]).cast("long").alias("first"),
                        (F.array_max(s) + t.key[0]).cast("long").alias("last"),
                        share(words, t, s).alias("share"),
                    ),
                ),
            )

        # files without any template's rarest word have no posting to look at
        some = F.arrays_overlap(words, F.array(*map(F.lit, sorted(vocabulary))))
        return F.when(some, F.filter(F.array(*map(of, templates)), lambda h: h.isNotNull()))

    return documents.select("doc_id", let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), hits(w).alias("hits"))).alias("s")).select("doc_id", "s.n_words", "s.hits")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(read(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["base"])

    def labels(hits: Column) -> Column:
        return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ","), F.lit(""))

    return found.select("doc_id", "n_words", "hits", base.alias("base")).select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("base", F.lit(0).cast("long"), lambda a, h: a + h["places"]), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda h: h["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda h: h["last"])).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES: dict[str, str] = {}
