r"""Language-model scoring with a log-bilinear neural model.

Tokens are words and one end a text. Every token belongs to a unit: the end, each of the most frequent words, and hash
classes for the other words, seen or not. The model gives log10 P(unit | the two units before) + log10 P(token | unit):

* the first part is log-bilinear: the context's vectors, each through a matrix of its own place, are added up, and a
  unit's score is the dot product with its vector plus a bias. It is trained in numpy with noise-contrastive estimation
  against the units' frequencies, on counts of unit trigrams over all training texts. A batched matrix product gives the
  scores of every context, normalised over the units, once for all texts.
* the second part is the token's share in its unit, (c + 0.5) / (sum over the unit's words and its unknown one of
  (c + 0.5)), so that the whole is a distribution over words and an unknown word for every class.

Counts of words are joined to texts by chunks: a chunk is a run of rows of an input file; each sends its distinct words
to their counts and gets them back, so a frequent word costs a row a chunk, and a task holds one chunk's words.

Training texts are those whose crc32(doc_id as text) mod 5 is not 1. What is gathered grows with the corpus: all
distinct words with their counts, and trigram counts over all training texts.

Defined results: a null text counts as empty: it is one token, the end; a null doc_id as the text ''; repeated rows each
get their own row and train as often; without training texts N is 0 and every token has the same share; an empty table
gives no rows; other columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens as tk
from .common import let_go, read, written

END = b""  # no word is empty
FREQUENT, CLASSES = 95, 31
UNITS = FREQUENT + CLASSES + 1  # the end comes first, then frequent words, then classes
START = UNITS  # only ever before a text
WIDTH, EPOCHS, BATCH, NOISE, RATE = 24, 20, 1024, 16, 0.02
CHUNK_BYTES = 16_000_000


def words(text: bytes) -> list[bytes]:
    """Lower case for A-Z only, and ASCII white space only: what the methods of bytes do."""
    return text.lower().split()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def unit_of(word: bytes, frequent: dict[bytes, int]) -> int:
    at = frequent.get(word)
    return 1 + FREQUENT + zlib.crc32(word) % CLASSES if at is None else 1 + at


class LogBilinear:
    """log P(unit | before, last) = vectors[unit] . (far[before] + near[last]) + bias[unit] - log Z."""

    def __init__(self, seed: int = 8) -> None:
        g = np.random.default_rng(seed)
        self.context = g.normal(0, 0.1, (UNITS + 1, WIDTH))
        self.place = np.stack([np.eye(WIDTH), np.eye(WIDTH)]) + g.normal(0, 0.01, (2, WIDTH, WIDTH))
        self.vectors = g.normal(0, 0.1, (UNITS, WIDTH))
        self.bias = np.zeros(UNITS)
        self.g = g

    def train(self, counts: np.ndarray) -> LogBilinear:
        """``counts``: of (before, last, unit). Tells trigrams from noise, ``NOISE`` noise units for each.

        A batch is a set of contexts with all that follows them. The noise has few units, so its part of the loss is
        its expectation over them, which is what any number of drawn units tends to.
        """
        n = counts.reshape(-1, UNITS)
        seen = np.flatnonzero(n.sum(1))
        if not len(seen):
            return self
        noise = n.sum(0) + 0.5
        noise = noise / noise.sum()
        self.bias = np.log(noise)
        log_noise = np.log(NOISE * noise)
        held = (self.context, self.place, self.vectors, self.bias)
        first, second = [np.zeros_like(x) for x in held], [np.zeros_like(x) for x in held]
        steps, step = EPOCHS * math.ceil(len(seen) / BATCH), 0
        for _ in range(EPOCHS):
            order = self.g.permutation(seen)
            for k in range(0, len(order), BATCH):
                step += 1
                at = order[k : k + BATCH]
                before, last = np.divmod(at, UNITS + 1)
                cb, cl = self.context[before], self.context[last]
                made = cb @ self.place[0] + cl @ self.place[1]
                real = n[at]
                size = real.sum(1, keepdims=True)
                delta = made @ self.vectors.T + self.bias - log_noise
                true = 1 / (1 + np.exp(-np.clip(delta, -30, 30)))
                wrong = (real * (true - 1) + size * (NOISE * noise) * true) / size.sum()
                g_made = wrong @ self.vectors
                g_context = np.zeros_like(self.context)
                np.add.at(g_context, before, g_made @ self.place[0].T)
                np.add.at(g_context, last, g_made @ self.place[1].T)
                grads = (g_context, np.stack([cb.T @ g_made, cl.T @ g_made]), wrong.T @ made, wrong.sum(0))
                rate = RATE * (1 - step / steps) + 1e-4
                for x, g, m, v in zip(held, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def table(self) -> np.ndarray:
        """log10 P(unit | before, last) for every context: one batched product, normalised over the units."""
        far, near = self.context @ self.place[0], self.context @ self.place[1]
        scores = (far[:, None, :] + near[None, :, :]).reshape(-1, WIDTH) @ self.vectors.T + self.bias
        scores -= scores.max(1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(1, keepdims=True))
        return (scores / math.log(10)).astype(np.float32).reshape(UNITS + 1, UNITS + 1, UNITS)


def trigrams(units: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two units before each token; ``ends``: places of the ends, one a text."""
    last, before = np.r_[START, units[:-1]], np.r_[START, START, units[:-2]][: len(units)]
    begin = np.r_[0, ends[:-1] + 1]
    last[begin] = START
    before[begin] = START
    second = begin[begin < ends] + 1
    before[second] = START
    return before, last


def _prepared(documents: DataFrame, chunk_bytes: int) -> DataFrame:
    """doc_id, text, held_out, chunk. Chunks are alike in every job, as files and rows in them have fixed places."""
    try:
        placed = documents.select("doc_id", "text", "_metadata.file_path", "_metadata.row_index")
    except AnalysisException:  # no file stands behind these rows yet
        placed = written(documents.select("doc_id", "text"), "documents").select("doc_id", "text", "_metadata.file_path", "_metadata.row_index")
    n, size = placed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rows = max(1, int(chunk_bytes * n / max(size, 1)))
    doc = F.col("doc_id")
    chunk = F.xxhash64("file_path", F.floor(F.col("row_index") / rows))
    return placed.select(doc.cast("long").alias("doc_id"), "text", held_out(doc).alias("held_out"), chunk.alias("chunk"))


def word_rows(prepared: DataFrame) -> DataFrame:
    """chunk, word, n (in training texts; 0 where only other texts have it) for a chunk's distinct words."""

    def told(chunk: int, train: Counter, other: set[bytes]) -> pa.RecordBatch:
        rest = other.difference(train)
        columns = [np.full(len(train) + len(rest), chunk, np.int64), pa.array([*train, *rest], pa.binary()), pa.array([*train.values(), *[0] * len(rest)], pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), *columns[1:]], ["chunk", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, train, other = None, Counter(), set()
        for batch in tk.slices(batches):
            for t, h, c in zip(tk.texts(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if c != now:
                    if now is not None:
                        yield told(now, train, other)
                    now, train, other = c, Counter(), set()
                got = words(t)
                got.append(END)
                (other if h else train).update(got)
        if now is not None:
            yield told(now, train, other)

    return prepared.mapInArrow(run, "chunk long, word binary, n long")


def unit_counts(prepared: DataFrame, frequent: dict[bytes, int]) -> np.ndarray:
    """Trigram counts of units over all training texts; a task sends those it has seen, at most a fixed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((UNITS + 1) ** 2 * UNITS, np.int64)
        memory: dict[bytes, int] = {END: 0}
        for batch in tk.slices(batches):
            got: list[bytes] = []
            ends: list[int] = []
            for t, h in zip(tk.texts(batch), batch.column(2).to_pylist(), strict=True):
                if not h:
                    got += words(t)
                    ends.append(len(got))
                    got.append(END)
            if not got:
                continue
            for w in set(got).difference(memory):
                memory[w] = unit_of(w, frequent)
            units = np.fromiter(map(memory.__getitem__, got), np.int64, len(got))
            before, last = trigrams(units, np.array(ends))
            total += np.bincount((before * (UNITS + 1) + last) * UNITS + units, minlength=len(total))
            if len(memory) > 500_000:
                memory = {END: 0}
        yield from tk.blocks(total[None])

    out = tk.summed(prepared.mapInArrow(run, tk.BLOCK), (1, (UNITS + 1) ** 2 * UNITS))
    return out.astype(np.float64).reshape(UNITS + 1, UNITS + 1, UNITS)


def scored(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    prepared = _prepared(documents, chunk_bytes)
    # a word's rows, one for each chunk that has it, come to one place; the window puts the sum beside each of them
    word = Window.partitionBy("word").orderBy("chunk")
    whole = word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = written(word_rows(prepared).withColumn("c", F.sum("n").over(whole)).withColumn("lead", F.row_number().over(word) == 1), "words")
    let_go(spark)
    words_once = known.where("lead and c > 0")
    total, distinct = words_once.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = words_once.where(F.col("word") != F.lit(bytearray(END))).orderBy(F.desc("c"), "word").limit(FREQUENT).select("word").collect()
    frequent = {bytes(r[0]): k for k, r in enumerate(top)}
    # mass of each unit: its words' c + 0.5, and 0.5 for a class's unknown word
    sizes = words_once.select("c", _unit_column(frequent).alias("unit")).groupBy("unit").agg((F.sum("c") + 0.5 * F.count("*")).alias("mass")).collect()
    mass = np.zeros(UNITS)
    mass[1 + FREQUENT :] = 0.5
    mass[0] = 0.0
    for r in sizes:
        mass[r["unit"]] += r["mass"]
    log_mass = np.log10(np.maximum(mass, 0.5))
    table = LogBilinear().train(unit_counts(prepared, frequent)).table()
    shared = spark.sparkContext.broadcast((table.ravel(), log_mass, frequent))
    base_norm = math.log10(total + 0.5 * (distinct + 1))

    def score(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        flat, unit_mass, often = shared.value
        vocabulary = counts.column("word").to_pylist()
        c = np.asarray(counts.column("c"))
        place = {w: k for k, w in enumerate(vocabulary)}
        unit = np.fromiter((0 if w == END else unit_of(w, often) for w in vocabulary), np.int64, len(vocabulary))
        own = np.log10(c + 0.5)
        inside = own - unit_mass[unit]
        out: list[tuple] = []
        for batch in tk.slices(iter(docs.to_batches())):
            got: list[bytes] = []
            ends: list[int] = []
            for t in tk.texts(batch):
                got += words(t)
                ends.append(len(got))
                got.append(END)
            at = np.fromiter(map(place.__getitem__, got), np.int64, len(got))
            stop = np.array(ends)
            begin = np.r_[0, stop[:-1] + 1]
            units = unit[at]
            before, last = trigrams(units, stop)
            token = flat[(before * (UNITS + 1) + last) * UNITS + units].astype(np.float64) + inside[at]
            n = stop - begin + 1
            sums = [np.add.reduceat(x, begin) for x in (own[at], (c[at] > 0).astype(np.int64), token)]
            out.append((batch.column(0), batch.column(2), n, sums[1], sums[0] - n * base_norm, sums[2]))
        return pa.table(
            {
                "doc_id": pa.concat_arrays([x[0] for x in out]).cast(pa.int64()),
                "held_out": pa.concat_arrays([x[1] for x in out]),
                "n_tokens": np.concatenate([x[2] for x in out]).astype(np.int64),
                "n_known": np.concatenate([x[3] for x in out]).astype(np.int64),
                "train_tokens": np.full(sum(len(x[2]) for x in out), total, np.int64),
                "base_score": np.concatenate([x[4] for x in out]),
                "score": np.concatenate([x[5] for x in out]),
            }
        ) if out else None

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return prepared.groupBy("chunk").cogroup(known.select("chunk", "word", "c").groupBy("chunk")).applyInArrow(score, schema)


def _unit_column(frequent: dict[bytes, int]) -> Column:
    word = F.col("word")
    out = F.when(word == F.lit(bytearray(END)), F.lit(0))
    for w, k in frequent.items():
        out = out.when(word == F.lit(bytearray(w)), F.lit(1 + k))
    return out.otherwise((F.crc32(word) % CLASSES + 1 + FREQUENT).cast("int"))


def op8_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))


QUERIES = {"op8_neural_lm": op8_neural_lm}
ORACLES: dict[str, str] = {}
