"""Sources and sinks: tables, source trees, append-only logs, datasets and configuration."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once into the folder that executors share (``spark.checkpoint.dir``) and read from there."""
    spark = rows.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='cairnlight-')}"
    path, schema = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", rows.schema
    rows.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def source_files(spark: SparkSession, roots: list[str], extensions: tuple[str, ...], exclude: list[str] = (), max_bytes: int = 1024 * 1024) -> DataFrame:
    """path, mtime, size, hash, language, content of the source files under the roots; sizes are tested before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kept = files.where(ext.isin(*extensions) & (F.col("length") <= max_bytes) & ~tx.excluded(F.col("path"), list(exclude)))
    return kept.select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), tx.language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("content"))


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """relative path and content of the Markdown files under a root; hidden folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + root.rstrip("/").removeprefix("file://") + "/", "")
    return files.select(relative.alias("relative"), F.unix_millis("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content")).where(~F.col("relative").rlike(r"(^|/)\."))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def eval_dataset(spark: SparkSession, documents: list[list[dict]]) -> DataFrame:
    """Parsed evaluation files as rows; a query that stands twice is an error."""
    rows = [(d["query"], d.get("expect", {}).get("files", []), d.get("expect", {}).get("heading_contains"), d.get("note")) for doc in documents for d in doc]
    names = [r[0] for r in rows]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"queries stand twice: {', '.join(twice)}")
    return spark.createDataFrame(rows, "query string, files array<string>, heading_contains string, note string")


@dataclass
class Config:
    """Settings and their defaults; a TOML text may give any of them."""

    docs_dirs: list[str] = field(default_factory=lambda: ["docs"])
    enabled_packs: list[str] = field(default_factory=list)
    max_results: int = 10
    max_graph_depth: int = 3
    max_graph_nodes: int = 2000
    vector_weight: float = 0.8
    capture: bool = True

    @classmethod
    def parsed(cls, text: str) -> Config:
        import tomllib

        flat = {k: v for section in tomllib.loads(text).values() if isinstance(section, dict) for k, v in section.items()}
        return cls(**{k: v for k, v in flat.items() if k in cls.__dataclass_fields__})


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def manifest_rows(text: str) -> list[tuple[str, str, str]]:
    """(tool, name, hash) of an ownership manifest."""
    return [(tool, e["name"], e["hash"]) for tool, entries in json.loads(text).items() for e in entries]
