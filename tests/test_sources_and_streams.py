import json

from pyspark.sql import functions as F

from cairnlight.sources import readers
from cairnlight.streaming import live


def test_source_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_text("x = 1\n")
    (tmp_path / "a/y.txt").write_text("no")
    (tmp_path / "a/big.py").write_text("#" * 3000)
    rows = readers.source_files(spark, [f"file://{tmp_path}"], ("py",), max_bytes=1000).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["language"], r["content"]) for r in rows] == [("x.py", "python", "x = 1\n")]


def test_logs_skip_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    readers.append_log(spark.createDataFrame([(1, "q")], "ts long, query string"), path)
    (tmp_path / "log/part-x.json").write_text('{"ts": 2, "query": "r"}\n{"ts": oops\n')
    assert sorted(r["ts"] for r in readers.read_log(spark, path, "ts long, query string").collect()) == [1, 2]


def test_config_defaults():
    c = readers.Config.parsed('[index]\nmax_results = 5\nunknown = 1\n')
    assert c.max_results == 5 and c.max_graph_depth == 3


def test_manifest_rows():
    assert readers.manifest_rows(json.dumps({"t:project": [{"name": "n", "hash": "h"}]})) == [("t:project", "n", "h")]


def test_live_streaks(spark, tmp_path):
    spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 7, "b"), (4, 8, "a")], "id long, node_id long, verdict string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, node_id long, verdict string").parquet(str(tmp_path / "in"))
    q = live.live_streaks(stream).writeStream.outputMode("update").format("memory").queryName("streaks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {(r["node_id"], r["outcome"], r["streak"]) for r in spark.table("streaks").collect()} == {(7, "b", 2), (8, "a", 1)}


def test_latest_captures(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q", "a"), (2, "q", "b"), (3, "r", "c")], "s long, query string, file string").select(F.timestamp_seconds("s").alias("ts"), "query", "file")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.latest_captures(stream).writeStream.format("memory").queryName("captures").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r["query"] for r in spark.table("captures").collect()) == ["q", "r"]
