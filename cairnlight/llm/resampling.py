"""Quality classifier by importance resampling.

Two generative models of hashed n-grams of three kinds (words and marks, pairs of them, and runs of six bytes, which see
families of rare words): one of the target texts, which are the labelled documents of good quality and without abuse,
and one of the raw text, which is every document. Both count a text once, however many rows hold it; a text is a target if a
label of one of its rows is good and none is bad. A document's log ratio is, for each kind, the mean over its n-grams of
min(0, log(target / raw)), smoothed by a prior count, without what the document itself adds to either model, so that
labelled and other documents are on the same footing. An n-gram's ratio is the larger of two independent hash rows, so
that a collision with a bad one does not condemn it. Its weight is the sum over the kinds of that mean in standard
deviations of the labelled good documents, whose variance is fitted as a constant plus a share that falls with the
number of n-grams: a text's length alone does not move its weight.
Documents are then drawn without replacement in proportion to their weights by Gumbel top-k: the k largest of
log weight + temperature x Gumbel noise (1 by default), with noise that is a function of doc_id. k is a parameter; by
default it is the number of documents whose weight is at least that of all but ``spare`` of the labelled good ones.

Labels are used as a bounded sample: at most about ``max_labels`` of them, by hash of doc_id. Counts of the raw model,
weights, k and the k-th largest key cover every document. Models have a fixed size.

Defined results: a text without any n-gram (null, empty, white space) has a null weight and isn't kept; repeated rows
each get their own row and the same verdict; labels may repeat or contradict (one bad label makes the document bad) or
be null (bad); without any good label every text with an n-gram is kept; empty tables give no rows; other columns pass
through ``kept_documents`` unchanged. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk
from .common import dropped, let_go, read, written
from .tokens import U

TOKEN = re.compile(rb"[0-9a-z_\x80-\xff]+|[^\s0-9a-z_\x80-\xff]+")
BITS = 18
SIZE = 1 << BITS
KINDS, RUN, KIND_AT = 3, 6, 20
#: What is added to the counts of both models, by kind: a kind that is seen less often for what it tells needs more.
PRIOR = (2.0, 5.0, 20.0)
SMOOTHING = np.array(PRIOR, np.float32)
STATS = [f"{what}{k}" for what in ("mean", "n") for k in range(KINDS)]
ID = "_text_hash"
#: doc_id, weight, key, text, text hash beside the columns of documents.
NAMES = [f"_resampling_{n}" for n in ("doc_id", "weight", "key", "text", "hash")]
COPY_BITS, BITMAP = 1 << 24, 1 << 15


def n_grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams, which hold their kind in two bits, and how many there are of each kind.

    A text without words has no runs of bytes.
    """
    text = text.lower()
    h = tk.hashed(TOKEN.findall(text))
    run = np.zeros(0, U)
    if len(h) and len(text) >= RUN:
        b = np.frombuffer(text, np.uint8).astype(U)
        n = len(b) - RUN + 1
        run = b[:n].copy()
        for k in range(1, RUN):
            run = run << U(8) | b[k : k + n]
        run = tk.mixed(run * tk.GOLD + U(RUN))
    kinds = (h, tk.mixed(h[:-1] * tk.GOLD + h[1:]), run)
    n = np.array([len(x) for x in kinds])
    x = np.concatenate(kinds) & ~(U(3) << U(KIND_AT))
    return x | np.repeat(np.arange(KINDS, dtype=U) << U(KIND_AT), n), n


def kind_of(x: np.ndarray) -> np.ndarray:
    return (x >> U(KIND_AT) & U(3)).astype(np.int64)


def places(x: np.ndarray) -> np.ndarray:
    """Places of n-grams in the two hash rows of their kind, as an array of shape (2, n-grams)."""
    return np.stack([x >> U(64 - BITS), (x & U(SIZE - 1)) + U(SIZE)]).astype(np.int64) + 2 * SIZE * kind_of(x)


def labelled(labels: DataFrame, max_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids, sorted, and whether they are good, of a bounded sample."""
    per = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good"))
    n = per.count()
    share = min(1.0, max_labels / max(n, 1))
    rows = per.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).toPandas().sort_values("doc_id")
    return rows["doc_id"].to_numpy(np.int64), rows["good"].to_numpy(bool)


def hashes(documents: DataFrame) -> DataFrame:
    """doc_id, text, and a 64-bit hash of the text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias(ID))


def targets(documents: DataFrame, ids: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Hashes, sorted, of the texts with a good label and no bad one."""
    if not good.any():
        return np.zeros(0, np.int64)
    told = documents.sparkSession.createDataFrame([(int(i), bool(g)) for i, g in zip(ids, good, strict=True)], "doc_id long, good boolean")
    per = hashes(documents).select("doc_id", ID).join(F.broadcast(told), "doc_id").groupBy(ID).agg(F.min("good").alias("good"))
    return np.sort(per.where("good").toPandas()[ID].to_numpy(np.int64))


def copied(texts: DataFrame) -> np.ndarray:
    """A bit for each of ``COPY_BITS`` residues of hashes: some text with it has several rows. Of fixed size."""
    residue = F.pmod(F.col(ID), F.lit(COPY_BITS))
    many = texts.groupBy(ID).count().where("count > 1").select(residue.alias("r"))
    per = many.groupBy(F.bitmap_bucket_number("r").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("r")).alias("bits"))
    out = np.zeros(COPY_BITS + 2 * BITMAP, bool)
    for bucket, bits in per.collect():
        # bucket k > 0 holds residues (k - 1) * BITMAP + 1 to k * BITMAP, and its bit i is the residue before it + i
        own = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")
        start = (bucket - 1) * BITMAP + 1 if bucket > 0 else 0
        out[start : start + BITMAP] |= own.astype(bool)[: len(out) - start]
    return np.packbits(out[:COPY_BITS], bitorder="little")


def counts(documents: DataFrame, target: np.ndarray) -> np.ndarray:
    """N-gram counts of all texts and of the target ones, each text once, of shape (2, places).

    A text whose hash's residue no copied text has is counted where it is read; only the others are sent to be told apart.
    """
    texts = hashes(documents)
    shared = documents.sparkSession.sparkContext.broadcast(copied(texts))

    def open_(batch: pa.RecordBatch) -> np.ndarray:
        r = np.mod(np.asarray(batch.column(batch.schema.get_field_index(ID))), COPY_BITS)
        return (shared.value[r >> 3] >> (r & 7).astype(np.uint8) & 1).astype(bool)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(open_(batch)))

    def added(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, KINDS * 2 * SIZE), np.int64)
        for batch in tk.slices(batches, size=500_000):
            mine = batch.filter(pa.array(~open_(batch))) if single else batch
            wanted = np.isin(np.asarray(mine.column(mine.schema.get_field_index(ID))), target)
            for row, texts_ in enumerate((tk.texts(mine), [t for t, w in zip(tk.texts(mine), wanted, strict=True) if w])):
                if texts_:
                    both[row] += np.bincount(np.concatenate([places(n_grams(t)[0]).ravel() for t in texts_]), minlength=both.shape[1])
        yield from tk.blocks(both)
        del both
        tk.give_back()

    pairs = texts.select("text", ID)
    alike = pairs.mapInArrow(some, pairs.schema).groupBy(ID, F.md5("text").alias("md5")).agg(F.first("text").alias("text")).select("text", ID)
    sent = [df.mapInArrow(lambda batches, single=single: added(batches, single), tk.BLOCK) for df, single in ((pairs, True), (alike, False))]
    return tk.summed(sent[0].unionAll(sent[1]), (2, KINDS * 2 * SIZE))


class Ratio:
    """log(target / raw) of n-grams, from the counts of both models."""

    def __init__(self, both: np.ndarray) -> None:
        self.raw, self.target = both.astype(np.float32)
        sums = both.reshape(2, KINDS, -1).sum(2)
        self.share = (sums[1] / np.maximum(sums[0], 1)).astype(np.float32)
        self.known = bool(sums[1].any())

    def means(self, text: bytes, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Mean of the negative log ratios of a text, and the number of n-grams, by kind; ``own``: it is a target."""
        x, n = n_grams(text)
        if not len(x) or not self.known:
            return np.zeros(KINDS), n.astype(np.float64)
        x, c = np.unique(x, return_counts=True)
        c = c.astype(np.float32)
        kind, at = kind_of(x), places(x)
        prior = SMOOTHING[kind]
        target = np.maximum(self.target[at] - c, 0) if own else self.target[at]
        expected = np.maximum(self.raw[at] - c, 0) * self.share[kind]
        ratio = ((target + prior) / (expected + prior)).max(0)
        return np.bincount(kind, np.log(np.minimum(ratio, 1)) * c, KINDS) / np.maximum(n, 1), n.astype(np.float64)


def gumbel(doc_ids: np.ndarray, seed: int) -> np.ndarray:
    x = tk.mixed(doc_ids.astype(U) * tk.GOLD + U(seed))
    u = (x >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    return -np.log(-np.log(u))


def means(batch: pa.RecordBatch, ratio: Ratio, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log ratio of each text's n-grams, and their number, of shape (texts, kinds)."""
    own = np.isin(np.asarray(batch.column(batch.schema.get_field_index(ID))), target)
    found = [ratio.means(t, o) for t, o in zip(tk.texts(batch), own, strict=True)]
    return tuple(np.array([f[k] for f in found]).reshape(-1, KINDS) for k in (0, 1))


def spread(mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Centre of ``mean``, and the two parts of its variance, a + b / n (least squares)."""
    mean, n = mean[n > 0], n[n > 0]
    if not len(mean):
        return np.array([0.0, 1.0, 0.0])
    centre = mean.mean()
    root = np.sqrt(n)
    a, b = np.linalg.lstsq(np.stack([root, 1 / root], 1), (mean - centre) ** 2 * root, rcond=None)[0]
    return np.array([centre, max(a, 1e-6), max(b, 1e-4)])


def standard(mean: np.ndarray, n: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Weights; a kind that a text has none of adds nothing, and a text without words has NaN."""
    z = (mean - fit[:, 0]) / np.sqrt(fit[:, 1] + fit[:, 2] / np.maximum(n, 1))
    return np.where(n[:, 0] > 0, np.where(n > 0, z, 0).sum(1), np.nan)


def weights(batch: pa.RecordBatch, model: tuple[Ratio, np.ndarray], fit: np.ndarray, temperature: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and keys of a batch with columns doc_id, text and its hash; NaN without n-grams."""
    ids = np.asarray(batch.column(batch.schema.get_field_index("doc_id")).fill_null(-1), np.int64)
    w = standard(*means(batch, *model), fit)
    return w, w + temperature * gumbel(ids, seed)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 2048) -> float:
    """The k-th largest value, by histograms that narrow down; only counts come to the driver, and one bin's values."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return math.inf
    if k >= n:
        return low
    above = 0
    while True:
        width = (high - low) / bins
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
        if not width or width < 1e-12:
            return low
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")
        found = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(bin_).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(found, reverse=True):
            if above + found[b][0] >= k:
                size, low, high = found[b]
                break
            above += found[b][0]
        if size <= 4096:
            rest = sorted((r[0] for r in df.where((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()), reverse=True)
            return rest[k - above - 1]


def drawn(documents: DataFrame, labels: DataFrame, k: int | None = None, max_labels: int = 20_000, spare: float = 0.02, temperature: float = 1.0, seed: int = 6, columns: tuple[str, ...] = ()) -> tuple[DataFrame, float]:
    """A written table of every row, in the order it was read in: ``columns`` of ``documents``, then doc_id, weight, key
    under names that ``documents`` has not (``NAMES``); and the key that a document has at least to be drawn.

    Without ``k``, it is the number of documents whose weight is at least that of all but ``spare`` of the good ones.
    """
    spark = documents.sparkSession
    ids, good = labelled(labels, max_labels)
    target = targets(documents, ids, good)
    model = Ratio(counts(documents, target)), target
    shared = spark.sparkContext.broadcast(model)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, size=500_000):
            mine = batch.filter(pa.array(np.isin(np.asarray(batch.column(2)), shared.value[1])))
            mean, n = means(mine, *shared.value)
            yield pa.RecordBatch.from_arrays([mine.column(2), *map(pa.array, np.c_[mean, n].T)], ["id", *STATS])

    texts = hashes(documents)
    per = texts.mapInArrow(known, f"id long, {', '.join(f'{c} double' for c in STATS)}").groupBy("id").agg(*[F.min(c).alias(c) for c in STATS])
    mean, n = np.hsplit(per.toPandas()[STATS].to_numpy(), 2)
    fit = np.stack([spread(mean[:, c], n[:, c]) for c in range(KINDS)])
    mine = np.sort(standard(mean, n, fit)[n[:, 0] > 0])
    rows = documents.select(*columns, F.col("doc_id").cast("long").alias(NAMES[0]), F.col("text").alias(NAMES[3]), F.xxhash64("text").alias(NAMES[4]))
    schema = T.StructType([*rows.schema.fields[: len(columns) + 1], T.StructField(NAMES[1], T.DoubleType()), T.StructField(NAMES[2], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, NAMES[3], 500_000):
            held = batch.select(range(len(columns), len(columns) + 3)).rename_columns(["doc_id", "text", ID])
            w, key = weights(held, shared.value, fit, temperature, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns) + 1], pa.array(w, from_pandas=True), pa.array(key, from_pandas=True)], schema.names)
        tk.give_back()

    let_go(spark)
    scored = written(rows.mapInArrow(run, schema), "weights")
    if k is None:
        least = mine[max(0, math.ceil(spare * len(mine)) - 1)] if len(mine) else -math.inf
        k = scored.where(F.col(NAMES[1]) >= float(least)).count()
    out = kth_largest(scored, NAMES[2], k)
    shared.destroy()
    return scored, out


def kept_documents(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that were drawn, all columns.

    A key is that of a doc_id and a text, so doc_ids and hashes of texts are all that stays on disk, not the texts.
    """
    doc, text = NAMES[0], "_resampling_text_hash"
    scored, least = drawn(documents.withColumn(text, F.xxhash64("text")), labels, columns=(text,), **options)
    kept = written(scored.where(F.col(NAMES[2]) >= least).select(doc, text).distinct(), "kept")
    dropped(scored)
    let_go(documents.sparkSession)
    same = documents["doc_id"].cast("long").eqNullSafe(kept[doc]) & (F.xxhash64(documents["text"]) == kept[text])
    return documents.join(kept.hint("merge"), same, "left_semi")


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, least = drawn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.toDF("doc_id", "weight", "key").withColumn("kept", F.coalesce(F.col("key") >= least, F.lit(False)))


QUERIES = {"op6_importance_resampling": op6_importance_resampling}
ORACLES: dict[str, str] = {}
