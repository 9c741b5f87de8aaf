r"""WARC archives and their capture index.

``archived`` writes a record for each capture into gzipped WARC files through Spark's own writer, whose commit protocol
survives lost executors and works on any file system that Spark knows; a record ends with the line separator. Of
captures with equal payloads of at least ``LEAST`` bytes, that with the smallest page_id is the response and the others
are revisits that refer to it. ``records`` reads archives back by their Content-Length.

The index is merged externally: every archive is a locally sorted run of entries (URL key, timestamp, page_id); ranges
of keys are dealt out, and within a range a loser tree merges the runs, so that the index is ordered as a whole and
every URL's capture history is in order. A task holds the entries of one range, which is cut to size; payloads stay behind.

URL keys reverse the host's labels and drop the scheme, ``www.``, the fragment and a default port.

Defined results: a null html counts as empty; a null url as an empty one; rows that repeat a page_id with the same
payload refer to that page_id; an empty table gives no rows; other columns are ignored. Payloads are kept whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, shuffle_partitions, work_path

LEAST = 100
EPOCH = 1_700_000_000  # captures have no time of their own: page_id seconds after it

END = "\r\n\r\n"


def url_key(url: Column) -> Column:
    """com,example,host)/path?query in lower-case host order."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(www\.)?", ""), "#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r":(80|443)$", ""))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), F.regexp_replace(bare, r"^[^/?]*", ""))


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, key, at (timestamp), html, payload_bytes, payload_digest, refers_to (null for responses)."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    # digests alone are grouped; a hot payload is one row per task after the partial aggregate
    first = rows.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first_id")
    joined = rows.join(first, "payload_digest", "left")  # a skewed digest is split by the adaptive join
    refers = F.when((F.col("payload_bytes") >= LEAST) & (F.col("first_id") < F.col("page_id")), F.col("first_id"))
    return joined.select("page_id", "url", url_key(F.col("url")).alias("key"), (F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))).alias("at"), "html", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def record() -> Column:
    """The text of a WARC record without its end. Header values come from columns that hold no line break."""
    safe = lambda c: F.regexp_replace(c, r"[\r\n\x00-\x1f]", " ")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        F.concat(F.lit("WARC-Target-URI: "), safe(F.col("url"))),
        F.concat(F.lit("X-URL-Key: "), safe(F.col("key"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("X-Seconds: "), F.col("at").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)


def archived(pages: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Write the archives; each file is a run sorted by URL key, timestamp and page_id."""
    rows = captures(pages).sortWithinPartitions("key", "at", "page_id")
    rows.select(record().alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parsed(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, payload, offset and length (uncompressed) of each record of an archive."""
    held, offset = b"", 0
    end = END.encode()

    def more(n: int) -> bool:
        nonlocal held
        parts, have = [held], len(held)
        while have < n:
            part = next(data, None)
            if part is None:
                break
            parts.append(part)
            have += len(part)
        held = b"".join(parts)
        return have >= n

    while more(1):
        size = 4096
        while (stop := held.find(end)) < 0:
            if not more(size := size * 2):
                if held.find(end) < 0:
                    raise ValueError("an archive ends within a record's headers")
        lines = held[:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {offset}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size, total = int(headers["Content-Length"]), stop + len(end)
        if not more(total + size + len(end)):
            raise ValueError("an archive ends within a record")
        yield headers, held[total : total + size], offset, total + size
        held = held[total + size + len(end) :]
        offset += total + size + len(end)


def unzipped(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """A gzip file of one or more members, piece by piece."""
    while data:
        z = zlib.decompressobj(31)
        part = z.decompress(data, step)
        while part or z.unconsumed_tail:
            yield part
            part = z.decompress(z.unconsumed_tail, step) if z.unconsumed_tail else b""
        data = z.unused_data


FIELDS = "run string, offset long, length long, page_id long, url string, key string, at long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _id(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def records(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of the archives under ``path``, as read back from the records; response payloads are digested anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        kinds = [pa.int64() if f.split()[1] == "long" else pa.string() for f in FIELDS.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                name, rows = batch.column(0)[k].as_py(), []
                for h, payload, offset, length in parsed(unzipped(batch.column(1)[k].as_py())):
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response":
                        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    rows.append((name, offset, length, _id(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["X-URL-Key"], int(h["X-Seconds"]), h["WARC-Type"], size, digest, _id(h.get("WARC-Refers-To"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, FIELDS)


class LoserTree:
    """K-way merge of sorted runs: the tree's inner nodes hold the losers, so that a step costs log2(k) comparisons."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads: list[tuple | None] = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for r in range(self.k - 1, -1, -1):
            self._play(r)

    def _before(self, a: int, b: int) -> bool:
        """Whether run ``a`` comes first; -1 stands for a run that precedes all, for building the tree."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _play(self, run: int) -> None:
        winner, node = run, (run + self.k) // 2
        while node > 0:
            if self._before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[run := self.losers[0]]) is not None:
            yield head
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


def merged(index: DataFrame) -> DataFrame:
    """The index in order of (key, at, page_id), with ``history``: the capture's number within its URL key, from 0.

    Ranges of keys go to tasks; the shuffle brings a task the runs' pieces, sorted by run, and the tree merges them.
    ``history`` counts within ``part``, the range; ``numbered`` carries it over where a URL's captures fill several.
    """
    spark = index.sparkSession
    order = ["key", "at", "page_id", "run", "offset"]
    ranges = index.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("run", *order)
    at = [ranges.columns.index(c) for c in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        names = np.asarray(table.column("run").to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), table.num_rows]

        def entries(begin: int, end: int, step: int = 1024) -> Iterator[tuple]:
            for k in range(begin, end, step):
                part = table.slice(k, min(step, end - k))
                yield from zip(*[[(v is not None, v) if v is not None else (False, 0) for v in part.column(c).to_pylist()] for c in at], range(k, k + part.num_rows), strict=True)

        took = np.fromiter((e[-1] for e in LoserTree([entries(a, b) for a, b in zip(cuts, cuts[1:], strict=False)])), np.int64, table.num_rows)
        table = table.take(took)
        keys = table.column("key").to_numpy(zero_copy_only=False)
        new = np.r_[True, keys[1:] != keys[:-1]]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        yield from table.append_column("history", pa.array(np.arange(len(keys)) - begin, pa.int64())).to_batches(max_chunksize=10_000)

    return ranges.mapInArrow(run, FIELDS + ", part int, history long")


def numbered(index: DataFrame) -> DataFrame:
    """A written ``merged`` table with ``history`` counted over all ranges. Only a key at a range's end can go on in the
    next one, so the keys to carry over are fewer than the ranges and can be broadcast."""
    per = index.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = per.withColumn("before", before).where("before > 0").select("key", "part", "before")
    return index.join(F.broadcast(carried), ["key", "part"], "left").withColumn("history", F.col("history") + F.coalesce("before", F.lit(0))).drop("before")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    archived(read(spark, sf_dir, "pages"), path)
    index = merged(records(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST} AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""

QUERIES = {"op5_warc": op5_warc}
ORACLES = {"op5_warc": ORACLE_SQL}
