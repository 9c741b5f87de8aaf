"""Arrow batches of texts as bytes, and 64-bit hashes of their tokens (numpy)."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U = np.uint64
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices with at most ``size`` bytes of text, or one row: very long texts don't add up in memory."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + size, "right")))
            yield batch.slice(start, end - start)
            start = end


def texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 of each row; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(text))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system: a worker's next stage would otherwise add its own to it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * MIX1
    x ^= x >> U(27)
    x *= MIX2
    x ^= x >> U(31)
    return x


def hashed(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each token: two checksums of unlike polynomials, mixed."""
    n = len(tokens)
    low = np.fromiter(map(zlib.crc32, tokens), U, n)
    high = np.fromiter(map(zlib.adler32, tokens), U, n)
    return mixed(low | high << U(32))


#: Counts of places travel as blocks of places, added up before they come to the driver.
BLOCK, WIDE = "block int, data binary", 1024


def blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of ``counts``, of shape (rows, places): places that have any, and their counts row by row."""
    block: list[int] = []
    data: list[bytes] = []
    for start in range(0, counts.shape[1], WIDE):
        part = counts[:, start : start + WIDE]
        at = np.flatnonzero(part.any(0))
        if len(at):
            block.append(start // WIDE)
            data.append(at.astype(np.uint16).tobytes() + part[:, at].astype(np.int64).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])


def _added(data: list[bytes], rows: int) -> np.ndarray:
    out = np.zeros((rows, WIDE), np.int64)
    for d in data:
        n = len(d) // (2 + 8 * rows)
        out[:, np.frombuffer(d, np.uint16, n)] += np.frombuffer(d, np.int64, n * rows, 2 * n).reshape(rows, n)
    return out


def summed(sent: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all tasks' ``blocks``, added up by block on the executors."""

    def add(group: pa.Table) -> pa.Table:
        [whole] = blocks(_added(group.column("data").to_pylist(), shape[0]))
        return pa.table({"block": group.column("block")[:1], "data": whole.column(1)})

    out = np.zeros((shape[0], -(-shape[1] // WIDE) * WIDE), np.int64)
    for block, data in sent.groupBy("block").applyInArrow(add, BLOCK).collect():
        out[:, block * WIDE : (block + 1) * WIDE] = _added([bytes(data)], shape[0])
    return out[:, : shape[1]]
