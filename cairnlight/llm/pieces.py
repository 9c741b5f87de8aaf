"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with identity normalization.

Encoding keeps an agenda of adjacent symbol pairs, ordered by the score of the piece that a pair makes and then by
position, and merges until no pair makes a piece. Blocks of text that no piece can cross are encoded on their own: a
block ends where a character other than the space mark meets a space mark. Many short blocks go through the agenda
together: each round takes the best pair of every block (numpy), the order in which a block's own agenda would pop them.
Long blocks have a heap of their own.

Every block that a task meets for the first time is checked against the sentencepiece library within the Arrow batch;
where the two differ the library's ids rule and ``n_differ`` counts it. Encoded blocks stay in a cache of bounded size.

Defined results: a null text counts as empty and gives no ids; repeated rows each get their own row; an empty table
gives no rows; columns other than doc_id and text are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as tk
from .common import read

MARK = "▁"

#: A block: space marks, then other characters; a text without any at its end is a block too.
BLOCK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

CACHE_BLOCKS = 300_000  # in each of two generations
CACHE_CHARS = 64  # longer blocks are rare and not kept


FAR = np.iinfo(np.int64).max


class Vocabulary:
    """Pieces of a model and the pairs of pieces that make another one."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        sp = self.sp
        self.unknown = sp.unk_id()
        plain: dict[str, int] = {}
        self.bytes: list[int] = [self.unknown] * 256
        self.text: list[bytes] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unused(i):
                self.text.append(b"")
            elif sp.is_unknown(i):
                self.text.append(" ⁇ ".encode())
            else:
                plain[piece] = i
                self.text.append(piece.replace(MARK, " ").encode())
        # symbols: pieces have their own ids; single characters that are no piece come behind, as they turn up
        self.symbol = dict(plain)
        self.size = sp.vocab_size()
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in plain)
        order = sorted(plain, key=lambda p: (-sp.get_score(plain[p]), plain[p]))
        rank = {p: r for r, p in enumerate(order)}
        if len({sp.get_score(plain[p]) for p in order if len(p) > 1}) < sum(len(p) > 1 for p in order):
            scores = sorted({sp.get_score(i) for i in plain.values()}, reverse=True)
            level = {s: r for r, s in enumerate(scores)}
            rank = {p: level[sp.get_score(i)] for p, i in plain.items()}  # equal scores: the leftmost pair first
        keys, made, ranks = [], [], []
        for p, i in plain.items():
            for cut in range(1, len(p)):
                left, right = self._known(p[:cut], plain), self._known(p[cut:], plain)
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(i)
                    ranks.append(rank[p])
        by = np.argsort(np.array(keys, np.int64))
        self.keys, self.made, self.ranks = (np.array(x, np.int64)[by] for x in (keys, made, ranks))
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}
        self.differ = 0
        self._pairs: dict[int, tuple[int, int]] | None = None

    def _known(self, part: str, plain: dict[str, int]) -> int | None:
        if part in plain:
            return plain[part]
        return self._character(part) if len(part) == 1 else None

    def _character(self, c: str) -> int:
        got = self.symbol.get(c)
        if got is None:
            got = self.symbol[c] = self.size + ord(c)
        return got

    def pairs(self) -> dict[int, tuple[int, int]]:
        """Pair -> rank and piece; for blocks that are encoded one by one."""
        if self._pairs is None:
            self._pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        return self._pairs

    def one_by_one(self, block: str) -> list[int]:
        """Symbols of a long block: its agenda as a heap, in O(n log n)."""
        pairs, symbol, character = self.pairs(), self.symbol.get, self._character
        ids = [symbol(c) or character(c) for c in block]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def add(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (got := pairs.get(ids[left] << 32 | ids[right])):
                heapq.heappush(heap, (got[0], left, ids[left] << 32 | ids[right], right))

        for k in range(n - 1):
            add(k, k + 1)
        while heap:
            _, left, key, right = heapq.heappop(heap)
            if ids[left] < 0 or ids[right] < 0 or after[left] != right or ids[left] << 32 | ids[right] != key:
                continue  # one of the two has been merged meanwhile
            ids[left], ids[right] = pairs[key][1], -1
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            add(before[left], left)
            add(left, after[left])
        return [i for i in ids if i >= 0]

    def ids_of(self, symbols: list[int]) -> list[int]:
        """A character outside the vocabulary falls back to its bytes."""
        size, of_byte = self.size, self.bytes
        if max(symbols, default=0) < size:
            return symbols
        return [j for i in symbols for j in ([i] if i < size else [of_byte[b] for b in chr(i - size).encode()])]

    def agenda(self, blocks: list[str]) -> list[list[int]]:
        """Ids of each block."""
        short = [k for k, b in enumerate(blocks) if len(b) <= CACHE_CHARS]
        if len(short) < len(blocks):
            out: list[list[int]] = [[] for _ in blocks]
            for k, ids in zip(short, self.together([blocks[k] for k in short]), strict=True):
                out[k] = ids
            for k, b in enumerate(blocks):
                if len(b) > CACHE_CHARS:
                    out[k] = self.ids_of(self.one_by_one(b))
            return out
        return self.together(blocks)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of the pair in ``keys`` by rank order, or FAR; -1 as a symbol makes no pair."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[at] == pair) & (left >= 0) & (right >= 0), self.ranks[at] << 32 | self.made[at], FAR)

    def together(self, blocks: list[str]) -> list[list[int]]:
        """Agendas of blocks of one length at a time, as rows of a matrix: a round merges every row's best pair."""
        out: list[list[int]] = [[] for _ in blocks]
        by_length: dict[int, list[int]] = {}
        for k, b in enumerate(blocks):
            by_length.setdefault(len(b), []).append(k)
        symbol, character = self.symbol.get, self._character
        for length, rows in by_length.items():
            where = np.array(rows)
            ids = np.array([symbol(c) or character(c) for c in "".join([blocks[k] for k in rows])], np.int64).reshape(-1, length)
            rank = self.ranked(ids[:, :-1], ids[:, 1:])
            while True:
                if ids.shape[1] > 1:
                    best = rank.argmin(1)
                    found = rank[np.arange(len(ids)), best]
                    over = found == FAR
                else:
                    over = np.ones(len(ids), bool)
                for k, row in zip(where[over].tolist(), ids[over].tolist(), strict=True):
                    out[k] = self.ids_of(row)
                if over.all():
                    break
                keep = ~over
                where, ids, rank, best, found = where[keep], ids[keep], rank[keep], best[keep], found[keep]
                n, width = ids.shape
                at = np.arange(n)
                ids[at, best] = found & 0xFFFFFFFF
                right = np.arange(width - 1) > best[:, None]
                ids = np.where(right, ids[:, 1:], ids[:, :-1])
                if width == 2:
                    rank = np.empty((n, 0), np.int64)
                    continue
                rank = np.where(right[:, :-1], rank[:, 1:], rank[:, :-1])
                mine = ids[at, best]
                has = best > 0
                rank[at[has], best[has] - 1] = self.ranked(ids[at[has], best[has] - 1], mine[has])
                has = best < width - 2
                rank[at[has], best[has]] = self.ranked(mine[has], ids[at[has], best[has] + 1])
        return out

    def checked(self, blocks: list[str]) -> list[list[int]]:
        """The agenda's ids, held against the library's for the same blocks.

        Every block begins with a space mark; the library puts one before a text, so the first goes without it.
        """
        ours = self.agenda(blocks)
        step = 200
        for k in range(0, len(blocks), step):
            part, mine = blocks[k : k + step], ours[k : k + step]
            if self.sp.encode("".join(part)[1:].replace(MARK, " "), num_threads=1) == [i for ids in mine for i in ids]:
                continue
            for j, b in enumerate(part):
                ids = self.sp.encode(b[1:].replace(MARK, " "), num_threads=1)
                if len(b) > 1 and ids != mine[j]:
                    self.differ += 1
                    ours[k + j] = ids
        return ours

    def entry(self, ids: list[int]) -> tuple[str, int, bytes]:
        return ",".join(map(str, ids)), len(ids), b"".join([self.text[i] for i in ids])

    def blocks(self, text: str) -> list[str]:
        """A text's blocks; one that is a space mark and a word stands as the word."""
        if not text:
            return []
        if self.crossing:
            return [MARK + text.replace(" ", MARK)]
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [b[1:] if len(b) > 1 and b[1] != MARK else b for b in BLOCK.findall(MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """For every text its blocks' entries: ids joined by commas, their number, the decoded bytes."""
        out = []
        fresh: dict[str, tuple[str, int, bytes] | None] = {}
        waiting: list[tuple[int, list[str]]] = []
        for t in texts:
            blocks = self.blocks(t)
            entries = list(map(self.cache.get, blocks))
            if None in entries:
                missing = [b for b, e in zip(blocks, entries, strict=True) if e is None]
                for b in missing:
                    e = self.older.get(b)
                    if e is None:
                        fresh[b] = None
                    else:
                        self.cache[b] = e
                waiting.append((len(out), blocks))
            out.append(entries)
        todo = list(fresh)
        for k in range(0, len(todo), 20_000):
            part = todo[k : k + 20_000]
            marked = [b if b[0] == MARK else MARK + b for b in part]
            for b, ids in zip(part, self.checked(marked), strict=True):
                fresh[b] = self.entry(ids)
        if waiting:
            cache, older = self.cache, self.older
            for at, blocks in waiting:
                out[at] = [cache.get(b) or fresh.get(b) or older[b] for b in blocks]
            cache.update((b, e) for b, e in fresh.items() if len(b) <= CACHE_CHARS)
            if len(cache) > CACHE_BLOCKS:  # blocks that are not asked for again go with the older half
                self.cache, self.older = {}, cache
        return out

    def forget(self) -> None:
        """Empty the cache at a task's end: a worker's next stage would otherwise add its own memory to it."""
        self.cache, self.older = {}, {}
        tk.give_back()


def decoded(parts: list[bytes]) -> str:
    """The library's decode: bytes that are no UTF-8 become U+FFFD each, and the first space goes."""
    text = b"".join(parts).decode("utf-8", "replace")
    return text.removeprefix(" ")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(model_file: str) -> Vocabulary:
    if model_file not in _vocabularies:
        _vocabularies[model_file] = Vocabulary(model_file)
    return _vocabularies[model_file]


def _texts(batch: pa.RecordBatch) -> tuple[list, list[str]]:
    return batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]


def encoded(documents: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array<int>), n_differ: blocks of the batch for which the library's ids had to be taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for batch in tk.slices(batches, size=1_000_000):
            keys, texts = _texts(batch)
            before = v.differ
            ids = [[int(i) for e in entries if e[0] for i in e[0].split(",")] for entries in v.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([v.differ - before] * len(keys), pa.int64())], ["doc_id", "ids", "n_differ"])
        v.forget()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_differ long")


def decoded_texts(ids: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text: what the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for batch in batches:
            texts = [decoded([v.text[i] for i in row or ()]) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(documents: DataFrame, model_file: str) -> DataFrame:
    """Per document the number of ids and digests of the ids and of the decoded text, without shipping either; n_differ:
    blocks of its batch for which the agenda's ids were not the library's, which then count (0 unless the agenda errs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for batch in tk.slices(batches, size=1_000_000):
            keys, texts = _texts(batch)
            n, ids, back, before = [], [], [], v.differ
            for entries in v.encode(texts):
                n.append(sum(e[1] for e in entries))
                ids.append(hashlib.sha256(",".join([e[0] for e in entries if e[1]]).encode()).hexdigest())
                back.append(hashlib.sha256(decoded([e[2] for e in entries]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(back), pa.array([v.differ - before] * len(keys), pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_differ"])
        v.forget()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_differ long")


def encoded_texts(documents: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids and text, which is decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for batch in tk.slices(batches, size=1_000_000):
            keys, texts = _texts(batch)
            ids, back = [], []
            for entries in v.encode(texts):
                ids.append(np.array([i for e in entries for i in e[0].split(",")], np.int32))
                back.append(decoded([e[2] for e in entries]))
            n = [len(x) for x in ids]
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), lists, pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "text"])
        v.forget()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(read(spark, sf_dir, "documents"), model_path())


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLES: dict[str, str] = {}
