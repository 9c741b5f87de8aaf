"""Benchmark decontamination by spaced-seed hashing.

A mask such as 11101001 takes the words at its ones and ignores those between. The words under every mask at every place
of the benchmark's items and of the documents are hashed; equal hashes are hits. A hit aligns a document with an item;
around it the two are compared word by word, and they overlap where a window of ``WINDOW`` words (the whole item, if it
is shorter) agrees in at least ``SHARE`` of its places. Any window that agrees so far has a hit under one of the masks,
whichever words are substituted: the masks were chosen so, and a test tries every case.

Items are taken in blocks of a bounded number of words, each compared with all documents; a block is what a task holds.

Defined results: words are runs of letters and digits in lower case (A-Z; other letters as they stand); texts that are
null or without words match nothing; items of fewer than ``LEAST`` words match nothing, as such phrases are common
speech; repeated items and documents each get their own rows; of an item's several places in a document the one with
most agreeing words counts, the earliest of equals; empty tables give no rows; other columns of the documents pass
through ``clean_documents`` unchanged. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import tokens as tk
from .common import read
from .tokens import U

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW, SHARE, LEAST = 20, 0.8, 5

#: For items of at least WINDOW words, and for shorter ones.
MASKS = ("11101001", "1101000011")
SHORT_MASKS = ("111", "1101")

BLOCK_WORDS = 1_000_000
FILTER_BITS = 22


def words(text: bytes) -> np.ndarray:
    return tk.hashed(WORD.findall(text.lower()))


def under(mask: str, h: np.ndarray) -> np.ndarray:
    """A hash of the words under the mask for every place that it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.full(n, hash_of(mask), U)
    for k, c in enumerate(mask):
        if c == "1":
            out = tk.mixed(out * tk.GOLD + h[k : k + n])
    return out


def hash_of(mask: str) -> int:
    return int(mask, 2) + (len(mask) << 32)


class Block:
    """Items' words and the places that each seed hash stands at."""

    def __init__(self, items: list[Row]) -> None:
        self.ids = [r["item_id"] for r in items]
        self.words = [words((r["text"] or "").encode()) for r in items]
        self.parts: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for masks, fits in ((MASKS, lambda n: n >= WINDOW), (SHORT_MASKS, lambda n: LEAST <= n < WINDOW)):
            for mask in masks:
                found = [(under(mask, w), k) for k, w in enumerate(self.words) if fits(len(w))]
                if not found:
                    continue
                keys = np.concatenate([x for x, _ in found])
                item = np.repeat([k for _, k in found], [len(x) for x, _ in found])
                place = np.concatenate([np.arange(len(x)) for x, _ in found])
                by = np.argsort(keys, kind="stable")
                some = np.zeros(1 << FILTER_BITS, bool)
                some[keys >> U(64 - FILTER_BITS)] = True
                self.parts.append((mask, keys[by], item[by], place[by], some))

    def alignments(self, h: np.ndarray) -> np.ndarray:
        """(item, shift) pairs: the item's word p may stand at word p + shift of the text."""
        got = []
        for mask, keys, item, place, some in self.parts:
            seeds = under(mask, h)
            at = np.flatnonzero(some[seeds >> U(64 - FILTER_BITS)])
            low, high = (np.searchsorted(keys, seeds[at], side) for side in ("left", "right"))
            n = high - low
            if n.sum():
                post = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                got.append(np.stack([item[post], np.repeat(at, n) - place[post]], 1))
        return np.unique(np.concatenate(got), axis=0) if got else np.empty((0, 2), np.int64)

    def overlaps(self, text: bytes) -> list[tuple[int, int, int, int, int]]:
        """(item, first word, last word, agreeing words, words) of each item that the text overlaps."""
        h = words(text)
        best: dict[int, tuple[int, int, int, int]] = {}
        for item, shift in self.alignments(h).tolist():
            w = self.words[item]
            size = min(WINDOW, len(w))
            begin, end = max(0, shift), min(len(h), shift + len(w))
            if end - begin < size:
                continue
            same = np.r_[0, np.cumsum(h[begin:end] == w[begin - shift : end - shift])]
            good = np.flatnonzero(same[size:] - same[:-size] >= SHARE * size - 1e-9)
            if len(good):
                first, last = int(good[0]), int(good[-1]) + size
                found = (int(same[last] - same[first]), -(begin + first), begin + last - 1, last - first)
                best[item] = max(best.get(item, found), found)
        return [(k, -b[1], b[2], b[0], b[3]) for k, b in sorted(best.items())]


def blocks(benchmark: DataFrame, size: int = BLOCK_WORDS) -> Iterator[Block]:
    """All items, in blocks of about ``size`` words (one item may have more)."""
    held: list[Row] = []
    n = 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        held.append(row)
        n += len(row["text"] or "") // 4
        if n >= size:
            yield Block(held)
            held, n = [], 0
    if held:
        yield Block(held)


def contaminations(documents: DataFrame, benchmark: DataFrame, size: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, last_word, n_agreeing, n_words: a row for each document and item that overlap."""
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, first_word long, last_word long, n_agreeing long, n_words long"
    out = None
    for block in blocks(benchmark, size):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in tk.slices(batches, size=1_000_000):
                rows = [(doc, shared.value.ids[item], *rest) for doc, t in zip(batch.column(0).to_pylist(), tk.texts(batch), strict=True) for item, *rest in shared.value.overlaps(t)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)], ["doc_id", "item_id", "first_word", "last_word", "n_agreeing", "n_words"])
            tk.give_back()

        found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean_documents(documents: DataFrame, benchmark: DataFrame, size: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``documents`` that overlap no item, all columns."""
    for block in blocks(benchmark, size):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in tk.slices(batches, size=1_000_000):
                yield batch.filter(pa.array([not shared.value.overlaps(t) for t in tk.texts(batch)], pa.bool_()))
            tk.give_back()

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES: dict[str, str] = {}
