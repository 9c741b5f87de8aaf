r"""N-gram Jaccard self-join by universe partition and pigeonhole.

Two texts link when the Jaccard similarity of their sets of word n-grams is at least num / den, that is, when
den * |intersection| >= num * |union|. For sets of s elements together that means at most s * (den - num) / (den + num)
elements in one of them only.

Sizes fall into bands, each den / num wide, so that the larger set of a link lies in the smaller one's band or the next.
For a band of sets of up to U elements a link's sets differ in at most H = 2U * (den - num) / (den + num) elements.
The universe is hashed into m = H + 1 + c segments: a link's sets then agree in at least c + 1 segments, of which at
most c can be empty in a set with no more than c empty segments. A set sends the hashes of its non-empty segments to an
index, for its own band and the next one; a set with more than c empty segments also sends the one-deletion
neighbourhood of its segments (the hash of each segment without each of its elements), which makes a segment agree up to
one element and so gives back more than the empty ones took. c is allocated to each band by cost: a segment more for
every set against the neighbourhoods of those that have too many empty ones.

Sets that share a hash are candidates. A set's sketch holds the parities of its elements, hashed to about 1.5 bits an
element: two sketches differ in no more bits than the sets differ in elements, so a pair whose sketches differ in more
than the bound allows is left out before any text is sent, and no link is lost by that.

Each hash's smallest set is compared with the others: by sketch, then exactly. Groups (the sets of one hash) that still
hold several components are compared by sketch in tiles, pairs within one component left out; what comes of a tile is a
spanning forest of the pairs that pass, at most an edge a set. A group of more than ``BIG`` sets is first split by the
hashes of a second partition, which a link's sets share as surely. Components of the forests are blocks, which are
compared exactly in tiles; pairs of tiles whose sets are all in one component are left out, all others are compared, so
no link between different components is lost. No pairs are listed, only links that join components.

Equal texts are one class, represented by its smallest doc_id; classes, not documents, are compared. A batch sends one
row a class, so that the copies of a hot text do not meet in one task; index hashes travel in blocks, one a bucket.

Defined results: words are lower-cased for A-Z only; a text of fewer than ``width`` words is one n-gram, its whole
sequence; a text without words (null, empty) has an empty set, links with nothing and is its own component; rows that
repeat a doc_id count as one node and each get their own row; a row with a null doc_id links with nothing and has a
null component; an empty table gives no rows; other columns are ignored. N-grams are compared by 64-bit hashes, texts
by MD5. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens as tk
from .common import dropped, let_go, read, shuffle_partitions, written
from .graph import components
from .tokens import U

TILE = 512
MEMBERS = 2000  # of a hash's smallest set, in one group of comparisons
BUCKETS, HELD = 8, 1 << 18  # ranges of hashes in a partition; rows of a range that are held besides one a hash
PAIRS = 1 << 17  # of hashes that two sets share, made distinct at a time
ROWS = 2048  # of small tiles, compared at a time
SKETCHES = 1024  # in a tile of sketches
BIG, LEVELS = 4096, 3  # sets of a group that is compared as it is; further partitions that split larger ones
FEW = 1 << 19  # doc_ids that are sent to every executor, so that only their rows are shuffled; more go by a merge join


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def n_grams(text: bytes, width: int) -> np.ndarray:
    """Hashes of the distinct n-grams, sorted."""
    h = tk.hashed(words(text))
    if not len(h):
        return h
    if len(h) < width:
        out = np.full(1, len(h) + 1, U)
        for k in range(len(h)):
            out = tk.mixed(out * tk.GOLD + h[k : k + 1])
        return out
    out = h[: len(h) - width + 1]
    for k in range(1, width):
        out = tk.mixed(out * tk.GOLD + h[k : len(h) - width + 1 + k])
    return np.unique(out)


@dataclass(frozen=True)
class Bands:
    num: int
    den: int

    def __hash__(self) -> int:
        return hash((self.num, self.den))

    @lru_cache(maxsize=4096)  # noqa: B019
    def upper(self, k: int) -> int:
        """Largest size of band k; band 0 holds size 1."""
        low = 1 if k == 0 else self.upper(k - 1) + 1
        return max(low, low * self.den // self.num)

    def of(self, size: int) -> int:
        k = max(0, int(math.log(max(size, 1)) / math.log(self.den / self.num)) - 30) if size > 100 else 0
        while k and self.upper(k) >= size:
            k = max(0, k - 30)
        while self.upper(k) < size:
            k += 1
        return k

    @lru_cache(maxsize=4096)  # noqa: B019
    def segments(self, k: int) -> tuple[int, int]:
        """m and c of band k."""
        largest = self.upper(k)
        least = 2 * largest * (self.den - self.num) // (self.den + self.num) + 1

        def cost(c: int) -> float:
            m = least + c
            mean = m * math.exp(-largest / m)
            tail = 1 - sum(math.exp(-mean + i * math.log(max(mean, 1e-300)) - math.lgamma(i + 1)) for i in range(c + 1))
            return m + max(tail, 0.0) * (largest + m)

        c = min(range(64), key=cost)
        return least + c, c


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the elements' hashes: a power of two of bits, at least 64 and at least as many as the elements."""
    bits = max(64, 1 << (len(elements) - 1).bit_length()) if len(elements) else 64
    at = (tk.mixed(elements * tk.GOLD + U(11)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(U)


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """The sketch with ``size`` words: that of the same set with fewer bits."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(x: np.ndarray, y: np.ndarray, n: int, m: int, bands: Bands) -> bool:
    """Whether sets of n and m elements may link by their sizes and sketches: (n + m) (den - num) / (den + num) differ at most."""
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64))
    return max(n, m) * bands.num <= min(n, m) * bands.den and apart * (bands.den + bands.num) <= (n + m) * (bands.den - bands.num)


def signatures(sets: list[np.ndarray], bands: Bands, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index hashes of sets, and which set each is of; another ``level`` is another partition of the universe."""
    jobs: list[tuple[int, int]] = []  # set, band
    for k, s in enumerate(sets):
        b = bands.of(len(s))
        jobs += [(k, b), (k, b + 1)]
    if not jobs:
        return np.empty(0, U), np.empty(0, np.int64)
    sizes = np.array([len(sets[k]) for k, _ in jobs])
    m = np.array([bands.segments(b)[0] for _, b in jobs])
    c = np.array([bands.segments(b)[1] for _, b in jobs])
    base = np.r_[0, np.cumsum(m)]
    elements = np.concatenate([sets[k] for k, _ in jobs])
    job = np.repeat(np.arange(len(jobs)), sizes)
    salt = tk.mixed(np.array([b for _, b in jobs], U) + U(77 + (level << 20)))
    # the element's segment and what it adds to the segment's hash, both by band
    x = tk.mixed(elements ^ salt[job])
    segment = base[job] + ((x >> U(32)).astype(np.int64) * m[job] >> 32)
    part = tk.mixed(x * tk.GOLD)
    filled = np.bincount(segment, minlength=base[-1])
    # sums of 32-bit halves are exact in doubles
    low = np.bincount(segment, (part & U(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(U)
    high = np.bincount(segment, (part >> U(32)).astype(np.float64), base[-1]).astype(U)
    total = low + (high << U(32))
    of = np.repeat(np.arange(len(jobs)), m)
    place = tk.mixed((np.arange(base[-1]) - base[of]).astype(U) * tk.GOLD ^ salt[of])
    empty = np.add.reduceat((filled == 0).astype(np.int64), base[:-1])
    more = empty > c  # these need neighbourhoods
    keys, owners = [tk.mixed(total[filled > 0] ^ place[filled > 0])], [of[filled > 0]]
    if more.any():
        e = more[job]
        keys.append(tk.mixed((total[segment[e]] - part[e]) ^ place[segment[e]]))
        owners.append(job[e])
        # and where even those can't make up for the empty segments, the empty ones count as any other
        rest = np.repeat(2 * (m - empty) < m - c, m) & (filled == 0)
        keys.append(tk.mixed(total[rest] ^ place[rest]))
        owners.append(of[rest])
    owner = np.array([k for k, _ in jobs])[np.concatenate(owners)]
    return np.concatenate(keys), owner


def linked(shared: int, a: int, b: int, bands: Bands) -> bool:
    return bands.den * shared >= bands.num * (a + b - shared)


INDEX = "doc_id long, n int, key long, first long, second long, docs array<long>, sketch binary"
BLOCK = "bucket int, keys binary, docs binary"
KEY_BYTES = 5  # of a hash that are sent; its topmost bits choose its bucket, so 40 bits and the bucket tell it
SENT = 1 << 19  # hashes that a task gathers before it sends blocks: a block's own cost counts little, however many buckets


def _told(doc: int | None, n: int, text: bytes, docs: list, own: np.ndarray) -> bytes:
    """What is told of a class of a batch: its smallest doc_id, size, the text's hash, its doc_ids, its sketch."""
    head = np.array([doc is not None, doc or 0, n, len(docs)], np.int64).tobytes() + hashlib.md5(text, usedforsecurity=False).digest()
    return head + np.array([d if d is not None else 0 for d in docs], np.int64).tobytes() + own.tobytes()


def _heard(told: list[bytes]) -> pa.RecordBatch:
    """INDEX rows of classes."""
    rows = []
    for t in told:
        known, doc, n, size, first, second = np.frombuffer(t, np.int64, 6).tolist()
        docs = np.frombuffer(t, np.int64, size, 48).tolist()
        rows.append((doc if known else None, n, None, first, second, docs if known else [None] * size, t[48 + 8 * size :]))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in INDEX.split(", ")])


def index_blocks(documents: DataFrame, width: int, bands: Bands, buckets: int) -> DataFrame:
    """For each batch, its classes (equal texts; a row each, keys null), and for about ``SENT`` hashes of a task the index
    hashes of each class's smallest doc_id, a row for each of ``buckets`` ranges of hashes; of the doc_ids, differences
    and how often each comes. Texts without words, and rows without doc_id, send none.
    """

    names = [f.split()[0] for f in BLOCK.split(", ")]

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, docs = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        part = ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        by = np.lexsort((docs, part))
        keys, docs, part = keys[by], docs[by], part[by]
        short = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
        bucket, told, packed = [], [], []
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            new = np.flatnonzero(np.r_[y > x, docs[x + 1 : y] != docs[x : y - 1]])
            counts = np.stack([np.diff(docs[x:y][new], prepend=0), np.diff(np.r_[new, y - x])])
            bucket.append(int(part[x]))
            told.append(short[x:y].tobytes())
            packed.append(zlib.compress(counts.view(np.uint8).reshape(-1, 8).T.tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(told, pa.binary()), pa.array(packed, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in tk.slices(batches, size=500_000):
            texts, ids = tk.texts(batch), batch.column(0).to_pylist()
            classes: dict[tuple[bool, bytes], list[int]] = {}
            for k, (doc, t) in enumerate(zip(ids, texts, strict=True)):
                classes.setdefault((doc is None, t), []).append(k)
            firsts = [min(of, key=lambda k: ids[k] or 0) for of in classes.values()]
            sets = [n_grams(texts[k], width) for k in firsts]
            told = [_told(ids[k], len(s), texts[k], [ids[j] for j in of], sketch(s)) for k, s, of in zip(firsts, sets, classes.values(), strict=True)]
            bucket = [zlib.crc32(t[:48]) % buckets for t in told]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.nulls(len(told), pa.binary()), pa.array(told, pa.binary())], names)
            own = [k for k, s in enumerate(sets) if len(s) and ids[firsts[k]] is not None]
            keys, owner = signatures([sets[k] for k in own], bands)
            if len(keys):
                held.append((keys, np.array([ids[firsts[k]] for k in own], np.int64)[owner]))
            del sets, keys, owner
            if sum(len(h[0]) for h in held) >= SENT:
                yield sent(held)
                held = []
        if held:
            yield sent(held)
        del held
        tk.give_back()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


class Held:
    """Rows (hash, doc_id) of one bucket, in a bounded space however often a hash comes: once many rows are held, hashes
    that came twice are told, and marked, so that later rows of theirs are told at once; what stays is one row a hash.
    """

    def __init__(self) -> None:
        self.key, self.doc, self.marked = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.more.append((key, doc))
        self.size += len(key)
        if self.size > HELD + 2 * len(self.key):
            yield self.rows(2)[0]

    def rows(self, least: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Rows of hashes that ``least`` rows or more have, or that are marked; pairs of doc_ids of those that two have."""
        key, doc = (np.concatenate([h, *[m[k] for m in self.more]]) for k, h in enumerate((self.key, self.doc)))
        by = np.argsort(key, kind="stable")
        key, doc = key[by], doc[by]
        start = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        out = (size >= least) | np.isin(key[start], self.marked)
        told = np.repeat(out, size)
        two = ~out & (size == 2)
        pairs = np.stack([doc[start[two]], doc[start[two] + 1]], 1)
        self.marked = np.union1d(self.marked, key[start[out]])
        self.key, self.doc, self.more, self.size = key[~told], doc[~told], [], 0
        return (key[told], doc[told]), pairs


def index_rows(documents: DataFrame, width: int, bands: Bands) -> DataFrame:
    """A row for each class of a batch (key null): its smallest doc_id, its hash, all its doc_ids, its sketch; and rows
    (doc_id, key) of the index hashes that three sets or more share; of those that two share, the two: (doc_id, first).
    Blocks are sorted by bucket, and a task holds one bucket's hashes, each at most once or twice.
    """
    parts = shuffle_partitions(documents.sparkSession)
    blocks = index_blocks(documents, width, bands, BUCKETS * parts)
    dealt = blocks.repartitionById(parts, F.floor(F.col("bucket") / BUCKETS).cast("int")).sortWithinPartitions("bucket")
    names = [f.split()[0] for f in INDEX.split(", ")]

    def rows(doc: np.ndarray, key: np.ndarray | None, other: np.ndarray | None) -> pa.RecordBatch:
        n = len(doc)
        none = pa.nulls(n, pa.int64())
        columns = [pa.array(doc), pa.nulls(n, pa.int32()), none if key is None else pa.array(key), none if other is None else pa.array(other), none, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []

        def distinct() -> pa.RecordBatch:
            two = np.unique(np.sort(np.concatenate(pairs), 1), axis=0)
            two = two[two[:, 0] < two[:, 1]]
            pairs.clear()
            return rows(two[:, 0].copy(), None, two[:, 1].copy())

        def ended(held: Held) -> Iterator[pa.RecordBatch]:
            (key, doc), two = held.rows(3)
            yield rows(doc, key, None)
            pairs.append(two)
            if sum(map(len, pairs)) > PAIRS:
                yield distinct()

        now, held = None, Held()
        for batch in batches:
            for bucket, keys, docs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != now:
                    yield from ended(held)
                    now, held = bucket, Held()
                if keys is None:
                    yield _heard([docs])
                    continue
                key = np.zeros((len(keys) // KEY_BYTES, 8), np.uint8)
                key[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
                key[:, KEY_BYTES:] = np.frombuffer((bucket & 0xFFFFFF).to_bytes(3, "little"), np.uint8)
                step, n = np.frombuffer(zlib.decompress(docs), np.uint8).reshape(8, -1).T.copy().view(np.int64).reshape(2, -1)
                for again, of in held.add(key.view(np.int64).ravel(), np.repeat(np.cumsum(step), n)):
                    yield rows(of, again, None)
        yield from ended(held)
        if pairs:
            yield distinct()
        tk.give_back()

    return dealt.mapInArrow(shared, INDEX)


def passing(pairs: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pass_ = [may_link(np.frombuffer(x, U), np.frombuffer(y, U), n, m, bands) for n, x, m, y in zip(*[batch.column(c).to_pylist() for c in range(2, 6)], strict=True)]
            yield batch.select([0, 1]).filter(pa.array(pass_, pa.bool_()))

    left, right = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    held = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "na", "sa", "nb", "sb")
    return held.mapInArrow(run, "a long, b long")


def texts_of(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id and text of the documents whose doc_id is among ``ids`` (a column doc_id) or, where those are many, of all.

    A join with them then shuffles the texts that it needs, not the whole corpus.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = ids.distinct()
    return texts.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= FEW else texts


def by_class(rows: DataFrame, column: str, of: DataFrame, moved: DataFrame | None) -> DataFrame:
    """``rows`` with the class of each doc_id in ``column``. ``moved``: all classes of the doc_ids that have another one
    than themselves, where these are few: others then stay where they are.
    """
    classes = (of if moved is None else F.broadcast(moved)).select(F.col("doc_id").alias(column), "class_id")
    return rows.join(classes, column, "inner" if moved is None else "left").withColumn(column, F.coalesce("class_id", column)).drop("class_id")


def split(big: DataFrame, documents: DataFrame, width: int, bands: Bands, level: int) -> DataFrame:
    """Groups (key, node) by the hashes of another partition as well: key then stands for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, size=500_000):
            keys, owner = signatures([n_grams(t, width) for t in tk.texts(batch)], bands, level)
            key, node = (np.asarray(batch.column(c), np.int64)[owner] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(tk.mixed(key.view(U) * tk.GOLD + keys).view(np.int64)), pa.array(node)], ["key", "node"])

    texts = texts_of(big.select(F.col("node").alias("doc_id")), documents).withColumnRenamed("doc_id", "node")
    return big.join(texts.hint("merge"), "node").select("key", "node", "text").mapInArrow(run, "key long, node long").distinct()


def _forest(table: pa.Table, ends: np.ndarray, bands: Bands) -> pa.RecordBatch:
    """Forest edges of tiles that stand one after another; ``ends``: where each ends. All their pairs are tried at once."""
    node, component, n, right = (np.asarray(table.column(c)) for c in ("node", "component", "n", "right"))
    n = n.astype(np.int64)
    held = [np.frombuffer(x, U) for x in table.column("sketch").to_pylist()]
    size = np.array([len(h) for h in held])
    tile = np.searchsorted(ends, np.arange(len(n)), "right")
    two_sided = np.isin(tile, tile[right])
    hits: list[np.ndarray] = []
    left, step = np.arange(len(n)), 0
    while len(left):  # the pairs of places that are ``step`` apart
        step += 1
        left = left[left + step < len(n)]
        left = left[tile[left] == tile[left + step]]
        other = left + step
        fit = (component[left] != component[other]) & (np.maximum(n[left], n[other]) * bands.num <= np.minimum(n[left], n[other]) * bands.den) & (~two_sided[left] | (right[left] != right[other]))
        if fit.any():
            hits.append(np.stack([left[fit], other[fit]]))
    out: list[tuple[int, int]] = []
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = root.get(up, up)
            k = root[k]
        return k

    pairs = np.concatenate(hits, 1) if hits else np.empty((2, 0), np.int64)
    words = np.minimum(size[pairs[0]], size[pairs[1]])
    for w in np.unique(words).tolist():
        mine = pairs[:, words == w]
        rows, at = np.unique(mine, return_inverse=True)
        x, at = np.stack([folded(held[r], w) for r in rows.tolist()]), at.reshape(2, -1)
        for k in range(0, mine.shape[1], chunk := max(1, 250_000 // w)):
            a, b = at[:, k : k + chunk]
            i, j = mine[:, k : k + chunk]
            apart = np.bitwise_count(x[a] ^ x[b]).sum(1, dtype=np.int64)
            for p in np.flatnonzero(apart * (bands.den + bands.num) <= (n[i] + n[j]) * (bands.den - bands.num)).tolist():
                low, high = find(int(i[p])), find(int(j[p]))
                if low != high:
                    root[max(low, high)] = min(low, high)
                    out.append((int(node[i[p]]), int(node[j[p]])))
    return pa.RecordBatch.from_arrays([pa.array([e[c] for e in out], pa.int64()) for c in (0, 1)], ["a", "b"])


def forests(groups: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """Edges (a, b) of a spanning forest, in each tile of each group, of the pairs of different components that may link.

    ``groups``: key, node, component, size. A group of more than SKETCHES is dealt out to pairs of parts of about that size.
    """
    parts = F.ceil(F.col("size") / SKETCHES).cast("int")
    dealt = groups.join(sketches.hint("merge"), "node").withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # a set meets each part: as the left one up to its own number, as the right one from there on
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("p", q).alias("i"), F.greatest("p", q).alias("j")))
    rows = dealt.select("key", F.explode(tiles).alias("t"), "p", "node", "component", "n", "sketch").select("key", "t.i", "t.j", (F.col("p") != F.col("t.i")).alias("right"), "node", "component", "n", "sketch")
    rows = rows.repartition(shuffle_partitions(groups.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            at = [np.asarray(held.column(c)) for c in ("key", "i", "j")]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in at])) + 1
            begin = 0
            while begin < (new[-1] if len(new) else 0):  # whole tiles, of about ROWS rows
                end = new[max(np.searchsorted(new, begin + ROWS, "right") - 1, np.searchsorted(new, begin, "right"))]
                yield _forest(held.slice(begin, end - begin), new[(new > begin) & (new <= end)] - begin, bands)
                begin = int(end)
            held = held.slice(begin)
        if held is not None:
            yield _forest(held, np.array([held.num_rows]), bands)
        tk.give_back()

    return rows.mapInArrow(run, "a long, b long").distinct()


def star_links(stars: DataFrame, documents: DataFrame, width: int, bands: Bands) -> DataFrame:
    """The links (a, b) among candidate pairs (a, b): each ``a`` with all its ``b``, in groups of a bounded number."""
    groups = stars.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("groups"))
    members = stars.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"), F.col("b").alias("doc_id"))
    centres = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("a").alias("doc_id"))
    texts = texts_of(stars.select(F.explode(F.array("a", "b")).alias("doc_id")), documents)
    rows = members.unionByName(centres).join(texts.hint("merge"), "doc_id").select("a", "part", "doc_id", (F.col("a") != F.col("doc_id")).alias("member"), "text")
    rows = rows.repartition(shuffle_partitions(documents.sparkSession), "a", "part").sortWithinPartitions("a", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in tk.slices(batches, size=1_000_000):
            found = []
            for a, doc, member, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), tk.texts(batch), strict=True):
                s = n_grams(t, width)
                if not member:
                    centre, own = a, s
                elif a == centre:
                    shared = len(s) + len(own) - len(np.union1d(s, own))
                    if linked(shared, len(s), len(own), bands):
                        found.append((a, doc))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def tile_links(blocks: DataFrame, documents: DataFrame, width: int, bands: Bands) -> DataFrame:
    """Links between different components of a block. ``blocks``: block, node, component.

    Nodes of a block stand in order of component, in tiles of TILE; two tiles meet in a task of their own unless both
    lie in one component. A task gives at most as many links as it joins components.
    """
    order = Window.partitionBy("block").orderBy("component", "node")
    tiled = blocks.withColumn("tile", F.floor((F.row_number().over(order) - 1) / TILE).cast("int"))
    tiles = tiled.groupBy("block", "tile").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    right = tiles.select("block", F.col("tile").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    pairs = tiles.join(right, "block").where("tile <= j and not (low = high and low_j = high_j and low = low_j)").select("block", F.col("tile").alias("i"), "j")
    texts = texts_of(blocks.select(F.col("node").alias("doc_id")), documents).withColumnRenamed("doc_id", "node")
    held = tiled.join(texts.hint("merge"), "node")
    left_rows = pairs.join(held.withColumnRenamed("tile", "i"), ["block", "i"]).select("block", "i", "j", F.lit(0).alias("side"), "node", "component", "text")
    right_rows = pairs.where("i < j").join(held.withColumnRenamed("tile", "j"), ["block", "j"]).select("block", "i", "j", F.lit(1).alias("side"), "node", "component", "text")

    def run(table: pa.Table) -> pa.Table:
        node, side = np.asarray(table.column("node")), np.asarray(table.column("side"))
        component = np.asarray(table.column("component"))
        sets = [n_grams(t.encode() if t else b"", width) for t in table.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        one_tile = not side.any()
        index = np.flatnonzero(side == 0)
        elements = np.concatenate([sets[k] for k in index])
        owners = np.repeat(index, sizes[index])
        by = np.argsort(elements, kind="stable")
        elements, owners = elements[by], owners[by]
        group = {int(c): int(c) for c in component}

        def root(c: int) -> int:
            while group[c] != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        out = []
        for y in range(len(sets)) if one_tile else np.flatnonzero(side == 1):
            low, high = (np.searchsorted(elements, sets[y], s) for s in ("left", "right"))
            n = high - low
            post = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if n.sum() else np.empty(0, np.int64)
            shared = np.bincount(owners[post], minlength=len(sets))
            hit = bands.den * shared >= bands.num * (sizes + sizes[y] - shared)
            hit[y] = False
            for x in np.flatnonzero(hit & (shared > 0)):
                a, b = root(int(component[x])), root(int(component[y]))
                if a != b:
                    group[max(a, b)] = min(a, b)
                    out.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return left_rows.unionByName(right_rows).groupBy("block", "i", "j").applyInArrow(run, "a long, b long")


def joined(documents: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = documents.sparkSession
    bands = Bands(num // math.gcd(num, den), den // math.gcd(num, den))
    index = written(index_rows(documents, width, bands), "index")
    let_go(spark)
    rows = index.where("docs is not null")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "first", "second").agg(F.min("doc_id").alias("class_id"))
    own = rows.join(classes, ["n", "first", "second"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "docs", "sketch")
    own = written(own, "classes")
    classed = own.where("class_id is not null")
    of = classed.select("doc_id", "class_id").distinct()
    sketches = classed.where("class_id = doc_id").groupBy(F.col("doc_id").alias("node"), "n").agg(F.first("sketch").alias("sketch"))
    shared = index.where("key is not null").select("key", "doc_id")
    # copies count as their class; each hash's smallest class meets the others
    others = written(of.join(of.where("doc_id <> class_id").select("doc_id").distinct(), "doc_id", "left_semi"), "moved")
    moved = others if others.count() <= FEW else None
    # dealt by the hash once: what is the same by it, and the smallest of it, are then found where they are
    dealt = by_class(shared, "doc_id", of, moved).select("key", F.col("doc_id").alias("node")).repartition(shuffle_partitions(spark), "key").distinct()
    nodes = written(dealt.withColumn("a", F.min("node").over(Window.partitionBy("key"))), "nodes")
    let_go(spark)
    stars = nodes.where("a < node").select("a", F.col("node").alias("b"))
    twos = index.where("key is null and docs is null").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    for c in "ab":
        twos = by_class(twos, c, of, moved)
    stars = stars.unionByName(twos.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    candidates = written(passing(stars, sketches, bands), "candidates")
    dropped(index)
    links = written(star_links(candidates, documents, width, bands), "links")
    dropped(candidates)
    let_go(spark)
    found = components(links)
    groups = _open(nodes, found)
    for level in range(1, LEVELS + 1):
        big = groups.where(F.col("size") > BIG)
        if big.limit(1).count() == 0:
            break
        finer = _open(split(big.select("key", "node"), documents, width, bands, level), found)
        new = written(groups.where(F.col("size") <= BIG).unionByName(finer), "groups")
        dropped(groups)
        groups = new
    edges = written(forests(groups, sketches, bands), "forest")
    dropped(nodes, groups, others)
    let_go(spark)
    blocks = components(edges).select("node", F.col("component").alias("block"))
    placed = written(blocks.join(found, "node", "left").select("block", "node", F.coalesce("component", "node").alias("component")), "blocks")
    more = written(tile_links(placed, documents, width, bands), "links")
    dropped(edges, placed)
    let_go(spark)
    # several texts of one doc_id are one node
    per_row = own.where("class_id is not null").select(F.explode("docs").alias("doc_id"), "class_id")
    twins = per_row.join(per_row.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a < b").select("doc_id", "a"), "doc_id").where("a < class_id").select("a", F.col("class_id").alias("b")).distinct()
    final = components(written(links.unionByName(more).unionByName(twins), "all")).select(F.col("node").alias("class_id"), "component")
    dropped(links, more, found)
    placed_rows = own.join(final, "class_id", "left").select(F.explode("docs").alias("doc_id"), "n", F.coalesce("component", "class_id").alias("component"))
    return placed_rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _open(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """key, node, component, size: the groups (a written table) of several components; groups of two are settled before."""
    placed = nodes.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    of_key = Window.partitionBy("key")  # one exchange; a join with the groups' sizes would send the rows twice
    sized = placed.withColumns({"size": F.count("*").over(of_key), "low": F.min("component").over(of_key), "high": F.max("component").over(of_key)})
    return written(sized.where("low < high and size > 2").select("key", "node", "component", "size"), "groups")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(read(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLES: dict[str, str] = {}
