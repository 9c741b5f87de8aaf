r"""Removal of repeated substrings by prefix doubling.

Removed is each byte that lies in a string of ``length`` bytes which also starts in a document of smaller doc_id.

A position's rank at offset h is a name of its first h bytes. Ranks double: the name at 2h is that of the pair (name at
p, name at p + h). Spark sorts rows of (rank, next rank, doc_id, place) at growing offsets; the sorted rows are read in
one pass that remembers one rank only, positions that are alone with their rank drop out, those whose pair a smaller
document has are settled, and the rest are reranked at a larger offset, until they are unique or past ``length``. Sorts
spill, so neither a hot rank nor a large table has to fit in memory. What keeps the rows near the size of the input:

* Names are 64-bit hashes of pairs instead of places in a sorted list, so a task doubles all its positions by itself.
* Of the positions, only one in about (length - KEY) / 2 is sorted: the one whose KEY bytes have the smallest name in a
  window of ``length`` bytes. Equal windows choose equal positions, so a repeated string always meets its other copies
  there. Windows in a row that choose one position form a run.
* Round 1 sorts pairs (name of KEY bytes, name of the whole run). Runs that a smaller document has too are
  settled as a whole; positions whose KEY bytes stand in one kind of run only are unique.
* Round 2 ranks what stays by pairs (name of KEY bytes, 8 bits of the name of the ``half`` bytes before or after them):
  a common window has one of the two whole, so runs that share neither pair with another document are unique.
* Round 3 sorts each single window of the runs that stay by its pair of names at the largest power of two.

Copies are settled within a batch before anything is sent, so that a hot string is sent once by each batch. Rows travel
packed, a block for each partition of ranks and batch, with the low 6 bytes of a name, so that a pair that is settled
agrees in 96 bits or more; they are unpacked where they are sorted.

Defined results: a null text counts as empty and keeps nothing; a text shorter than ``length`` is kept whole; a row with
a null doc_id is kept whole and compared with nothing; rows that repeat a doc_id are no smaller than each other and each
get their own row; an empty table gives no rows; other columns are ignored (``trimmed_documents`` passes them through).
Texts are read whole, in pieces that overlap by length - 1 bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as tk
from .common import dropped, let_go, read, shuffle_partitions, written
from .tokens import U

LENGTH = 50
KEY = 24
PIECE = 1 << 17
PLACE_BITS = 18  # of a position within a piece
NAME_BYTES = 6  # of a name that are sent
COUNT_BITS = 16

_A, _B = U(0x9FB21C651E98DF25), U(0xD1342543DE82EF95)
_BYTE = tk.mixed(np.arange(1, 257, dtype=U) * tk.GOLD)


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A name for each pair of names."""
    out = left * _A
    out += right
    out ^= out >> U(29)
    out *= _B
    out ^= out >> U(32)
    return out


class Names:
    """Names of the strings that start at each place of ``data``, by doubling."""

    def __init__(self, data: np.ndarray) -> None:
        self.at = {1: _BYTE[data]}

    def of(self, h: int) -> np.ndarray:
        if h not in self.at:
            big = 1 << (h - 1).bit_length() - 1  # the largest power of two below h
            whole = self.of(big)
            rest = self.of(h - big) if h - big < big and (h - big) & (h - big - 1) == 0 or h - big == big else None
            if rest is None:  # the two halves may overlap
                self.at[h] = paired(whole[: len(whole) - (h - big)], whole[h - big :])
            else:
                n = len(rest) - big
                self.at[h] = paired(whole[:n], rest[big : big + n]) if n > 0 else np.empty(0, U)
        return self.at[h]


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    h = 1
    while 2 * h <= width:
        x = np.minimum(x[:-h], x[h:])
        h *= 2
    return np.minimum(x[: len(x) - (width - h)], x[width - h :]) if width > h else x


def top(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For pieces of the texts: (text, offset, windows, name of KEY bytes, name of the run, left side, right side) of each run.

    A side is 1 to 255 from the name of ``half`` bytes beside the key, or 0 where the run doesn't reach so far.
    """
    half = (length - KEY + 1) // 2
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def ranked() -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join([p for _, _, p in held]), np.uint8)
        names = Names(data)
        key, big = names.of(KEY), names.of(top(length))
        whole = paired(big[: len(big) - (length - top(length))], big[length - top(length) :])
        n = len(whole)
        lengths = np.array([len(p) for _, _, p in held])
        begin = np.r_[0, np.cumsum(lengths)[:-1]]
        valid = np.zeros(n + 1, bool)
        steps = np.zeros(len(data) + 2, np.int32)
        np.add.at(steps, begin, 1)
        np.add.at(steps, begin + lengths - length + 1, -1)
        valid[:n] = np.cumsum(steps)[:n] > 0
        order = (key & ~U((1 << PLACE_BITS) - 1)) | np.arange(len(key), dtype=U)
        chosen = (smallest(order, length - KEY + 1)[:n] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
        edge = np.ones(n + 1, bool)
        edge[1:n] = chosen[1:] != chosen[:-1]
        piece = np.zeros(n + 1, bool)
        piece[begin[begin <= n]] = True
        first = np.flatnonzero(valid & (edge | ~np.r_[False, valid[:-1]] | piece))
        last = np.flatnonzero(valid & np.r_[(edge | ~valid | piece)[1:], True])
        count = last - first + 1
        k = np.searchsorted(begin, first, "right") - 1
        text = np.array([t for t, _, _ in held])[k]
        offset = np.array([o for _, o, _ in held])[k] + first - begin[k]
        at, beside = chosen[first], names.of(half)
        side = lambda p, there: np.where(there, (beside[np.clip(p, 0, len(beside) - 1)] % U(255)).astype(np.int64) + 1, 0)
        left, right = side(at - half, at - half >= first), side(at + KEY, at + KEY + half <= last + length)
        return text, offset, count, key[at], paired(whole[first], whole[last] + count.astype(U)), left, right

    for t, data in enumerate(texts):
        for at in range(0, len(data) - length + 1, PIECE):
            part = data[at : at + PIECE + length - 1]
            if size + len(part) >= 1 << PLACE_BITS:
                yield ranked()
                held, size = [], 0
            held.append((t, at, part))
            size += len(part)
    if held:
        yield ranked()


ENTRY = "key long, name long, doc_id long, meta long, place long"
MARK = "doc_id long, tag long, mark long, key long, sides long, open boolean"


def later_here(key: np.ndarray, name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have a pair that an entry of a smaller document has."""
    by = np.argsort(key, kind="stable")
    k = key[by]
    same = np.flatnonzero(k[1:] == k[:-1])
    by = by[np.union1d(same, same + 1)]
    out = np.zeros(len(key), bool)
    if len(by):
        by = by[np.lexsort((doc[by], name[by], key[by]))]
        k, r, d = key[by], name[by], doc[by]
        new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]
        out[by] = d > d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
    return out


BLOCK = "bucket int, n int, keys binary, names binary, sides binary, docs binary, places binary, settled boolean"


def in_part(key: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges a key's hash is in; keys themselves are the smallest of their windows."""
    return ((tk.mixed(key) >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def short(x: np.ndarray) -> bytes:
    """The low NAME_BYTES of each name."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]).tobytes()


def long(data: bytes) -> np.ndarray:
    n = len(data) // NAME_BYTES
    out = np.zeros((n, 8), np.uint8)
    out[:, :NAME_BYTES] = np.frombuffer(data, np.uint8).reshape(n, NAME_BYTES)
    return out.reshape(-1).view(U)


def by_byte(x: np.ndarray) -> bytes:
    """All first bytes, all second bytes, and so on: what repeats then stands together."""
    return zlib.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)


def bytewise(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packed(key: np.ndarray, name: np.ndarray, doc: np.ndarray, tag: np.ndarray, sides: np.ndarray, offset: np.ndarray, count: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """A batch's entries, a row for each of ``parts`` ranges of hashed keys; those that the batch itself settles in rows of their own.

    Entries stand in order of their documents: a document is named once, places are differences.
    """
    later = later_here(key, name, doc)
    bucket = in_part(key, parts)
    out: list[list] = [[] for _ in range(8)]
    for settled in (True, False):
        mine = np.flatnonzero(later == settled)
        if not settled:
            mine = mine[np.argsort(bucket[mine], kind="stable")]
        cuts = [0, *([] if settled else (np.flatnonzero(np.diff(bucket[mine])) + 1).tolist()), len(mine)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p = mine[a:b]
            if not len(p):
                continue
            new = np.flatnonzero(np.r_[True, (doc[p][1:] != doc[p][:-1]) | (tag[p][1:] != tag[p][:-1])])
            docs = np.concatenate([doc[p][new], tag[p][new], np.diff(np.r_[new, len(p)])]).astype(np.int64)
            places = np.stack([np.diff(offset[p], prepend=0), count[p]], 1).astype(np.int32)
            names = [b"", b"", b""] if settled else [short(key[p]), short(name[p]), sides[p].astype(np.uint16).tobytes()]
            where = int(in_part(tk.mixed(doc[p[:1]].astype(U)), parts)[0]) if settled else int(bucket[p[0]])
            for column, value in zip(out, (where, len(p), *names, by_byte(docs), by_byte(places.view(np.int64).ravel()), settled), strict=True):
                column.append(value)
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [f.split()[0] for f in BLOCK.split(", ")])


def unpacked(batches: Iterator[pa.RecordBatch], size: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The entries as rows to sort, about ``size`` at a time; settled ones have a negative place."""
    held: list[tuple[np.ndarray, ...]] = []

    def rows() -> pa.RecordBatch:
        columns = [np.concatenate([h[c] for h in held]).view(np.int64) for c in range(5)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), [f.split()[0] for f in ENTRY.split(", ")])

    for batch in batches:
        for _, n, keys, names, sides, docs, places, settled in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            d = bytewise(docs, np.int64).reshape(3, -1)
            p = bytewise(places, np.int64).view(np.int32).reshape(-1, 2).astype(np.int64)
            place = np.cumsum(p[:, 0]) << COUNT_BITS | p[:, 1]
            none = np.zeros(n, U)
            key, name = (none, none) if settled else (long(keys), long(names))
            meta = np.repeat(d[1].astype(U) << U(32), d[2]) | (none if settled else np.frombuffer(sides, np.uint16).astype(U))
            held.append((key, name, np.repeat(d[0], d[2]), meta, ~place if settled else place))
            if sum(len(h[0]) for h in held) >= size:
                yield rows()
                held = []
    if held:
        yield rows()


def _prepared(documents: DataFrame) -> DataFrame:
    """doc_id, tag, text: the tag tells apart rows that repeat a doc_id with other texts."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), _tag_of(documents).alias("tag"), "text")


def run_entries(prepared: DataFrame, length: int, parts: int) -> DataFrame:
    """An entry for each run of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, size=500_000):
            ids, tags = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64)
            got = list(runs(tk.texts(batch), length))
            if got:
                text, offset, count, key, name, left, right = (np.concatenate([g[k] for g in got]) for k in range(7))
                yield from packed(key, name, ids[text], tags[text], left << 8 | right, offset, count, parts)
        tk.give_back()

    return prepared.where("doc_id is not null").mapInArrow(run, BLOCK)


def reranked(blocks: DataFrame, parts: int, others: bool) -> DataFrame:
    """Marks of packed entries, in sorted order: settled ones, and with ``others`` those (open) whose rank other pairs have too.

    One pass; it remembers the last pair, its first document, and entries of one document that wait for a second pair.
    """
    order = blocks.repartitionById(parts, "bucket").mapInArrow(unpacked, ENTRY).sortWithinPartitions("key", "name", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # key, name, first document, pairs of the key
        waiting: list[pa.RecordBatch] = []

        def told(batch: pa.RecordBatch, open_: bool) -> pa.RecordBatch:
            key, _, doc, meta, place = (np.asarray(c) for c in batch.columns)
            meta, place = meta.view(U), np.where(place < 0, ~place, place)
            n = len(doc)
            columns = (doc, (meta >> U(32)).astype(np.int64), place, key if open_ else np.zeros(n, np.int64), (meta & U(0xFFFFFFFF)).astype(np.int64) if open_ else np.zeros(n, np.int64), np.full(n, open_))
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), [f.split()[0] for f in MARK.split(", ")])

        for batch in batches:
            done = np.asarray(batch.column(4)) < 0
            if done.any():
                yield told(batch.filter(pa.array(done)), False)
                batch = batch.filter(pa.array(~done))
            if not batch.num_rows:
                continue
            key, name, doc = (np.asarray(batch.column(c)) for c in range(3))
            goes_on = last is not None and last[0] == key[0]
            new_key = np.r_[not goes_on, key[1:] != key[:-1]]
            new_pair = new_key | np.r_[not (goes_on and last[1] == name[0]), name[1:] != name[:-1]]
            at = np.maximum.accumulate(np.where(new_pair, np.arange(len(key)), -1))
            first = np.where(at < 0, last[2] if last else 0, doc[at])
            later = doc > first
            if later.any():
                yield told(batch.filter(pa.array(later)), False)
            group = np.cumsum(new_key) - (0 if goes_on else 1)
            pairs = np.bincount(group, new_pair, group[-1] + 1)
            if goes_on:
                pairs[0] += last[3]
            last = (key[-1], name[-1], first[-1], pairs[-1])
            if others:
                several = pairs >= 2
                if not goes_on:
                    waiting = []
                elif several[0]:
                    for held in waiting:
                        yield told(held, True)
                    waiting = []
                elif group[-1]:
                    waiting = []
                mine = ~later & several[group]
                if mine.any():
                    yield told(batch.filter(pa.array(mine)), True)
                if not several[-1]:
                    waiting.append(batch.filter(pa.array(~later & (group == group[-1]))))

    return order.mapInArrow(run, MARK)


def still_open(open_: DataFrame) -> DataFrame:
    """The open runs that share a pair of KEY bytes and a side with another document's."""
    side = {"left": F.shiftright("sides", 8), "right": F.col("sides").bitwiseAND(0xFF)}
    sided = open_.select("doc_id", "tag", "mark", "key", *[c.alias(n) for n, c in side.items()])
    found = []
    for name in side:
        pairs = sided.where(F.col(name) > 0).groupBy("key", name).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", name)
        found.append(sided.join(pairs.hint("merge"), ["key", name], "left_semi").select("doc_id", "tag", "mark"))
    return found[0].unionByName(found[1]).distinct()


def window_entries(joined: DataFrame, length: int, parts: int) -> DataFrame:
    """An entry for each window of the open runs."""
    big = top(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, size=500_000):
            ids, tags, texts = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64), tk.texts(batch)
            begin = np.r_[0, np.cumsum([len(t) for t in texts])]
            marks = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), np.asarray(batch.column(3).value_lengths()))
            offset, count = begin[row] + (marks >> COUNT_BITS), marks & ((1 << COUNT_BITS) - 1)
            by = np.argsort(offset, kind="stable")
            row, offset, count = row[by], offset[by], count[by]
            # the bytes of the runs alone, one after another, are named together
            steps = np.zeros(begin[-1] + 1, np.int64)
            np.add.at(steps, offset, 1)
            np.add.at(steps, offset + count + length - 1, -1)
            used = np.cumsum(steps)[:-1] > 0
            new_place = np.cumsum(used) - 1
            name = Names(np.frombuffer(b"".join(texts), np.uint8)[used]).of(big)
            at = np.repeat(offset - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            row = np.repeat(row, count)
            left, right = name[new_place[at]], name[new_place[at] + length - big]
            yield from packed(left, right, ids[row], tags[row], np.zeros(len(at), np.int64), at - begin[row], np.ones(len(at), np.int64), parts)
        tk.give_back()

    return joined.select("doc_id", "tag", "text", "marks").mapInArrow(run, BLOCK)


def _gathered(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc_id", "tag").agg(F.collect_list("mark").alias("marks"))


def repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, tag, mark: each run of windows to remove (written tables)."""
    if length < KEY + 2:
        raise ValueError(f"length is at least {KEY + 2}")
    spark = documents.sparkSession
    prepared = _prepared(documents)
    parts = shuffle_partitions(spark)
    let_go(spark)
    marks = written(reranked(run_entries(prepared, length, parts), parts, True), "marks")
    let_go(spark)
    open_ = written(still_open(marks.where("open")), "open")
    let_go(spark)
    windows = window_entries(prepared.where("doc_id is not null").join(_gathered(open_), ["doc_id", "tag"]), length, parts)
    more = written(reranked(windows, parts, False), "windows")
    dropped(open_)
    let_go(spark)
    return marks.where("not open").select("doc_id", "tag", "mark").unionByName(more.select("doc_id", "tag", "mark"))


def spans(marks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of bytes."""
    marks = np.sort(marks)
    begin = marks >> COUNT_BITS
    end = np.maximum.accumulate(begin + (marks & ((1 << COUNT_BITS) - 1)) + length - 1)
    new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]]) if len(begin) else np.empty(0, np.int64)
    return begin[new], end[np.r_[new[1:], len(end)] - 1] if len(new) else end


def cut(text: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    if not len(begin):
        return text
    return b"".join([text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)])


def _fresh(documents: DataFrame, name: str) -> str:
    """A column name that ``documents`` has not (names of columns are compared without case)."""
    have = {c.lower() for c in documents.columns}
    while name in have:
        name += "_"
    return name


def _marked(documents: DataFrame, length: int) -> tuple[DataFrame, str]:
    """``documents`` with the marks of each row's text in a further column, and the column's name."""
    doc, tag, marks = (_fresh(documents, f"found_{n}") for n in ("doc", "tag", "marks"))
    found = _gathered(repeats(documents.select("doc_id", "text"), length)).toDF(doc, tag, marks)
    joined = documents.join(found.hint("merge"), (documents["doc_id"].cast("long") == found[doc]) & (_tag_of(documents) == found[tag]), "left")
    return joined.drop(doc, tag), marks


def _tag_of(documents: DataFrame) -> Column:
    return F.crc32(F.coalesce(documents["text"], F.lit("")).cast("binary"))


def _pieces(batch: pa.RecordBatch, name: str) -> Iterator[tuple[bytes, np.ndarray]]:
    marks = batch.column(batch.schema.get_field_index(name))
    for t, m in zip(tk.texts(batch), marks, strict=True):
        yield t, np.asarray(m.values, np.int64) if m.is_valid else np.empty(0, np.int64)


def digests(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, size=1_000_000):
            rows = []
            for t, m in _pieces(batch, name):
                begin, end = spans(m, length)
                rows.append((len(t), int((end - begin).sum()), len(begin), hashlib.sha256(cut(t, begin, end)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked, name = _marked(rows, length)
    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def trimmed_documents(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``documents`` with the repeated bytes gone from text, and n_chars as it then is; other columns as they are.

    A character of which some bytes go goes as a whole.
    """
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, size=1_000_000):
            kept, valid = [], batch.column(batch.schema.get_field_index("text")).is_valid().to_pylist()
            for (t, m), ok in zip(_pieces(batch, marks), valid, strict=True):
                kept.append(cut(t, *spans(m, length)).decode("utf-8", "ignore") if ok else None)
            out = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            out["text"] = pa.array(kept, pa.string())
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(t) if t is not None else None for t in kept], pa.int64()).cast(out["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    marked, marks = _marked(documents, length)
    return marked.mapInArrow(run, documents.schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLES: dict[str, str] = {}
