import random

from hypothesis import given
from hypothesis import strategies as st
from oracle import compare

from cairnlight.llm import warc
from cairnlight.llm.common import work_path, written


def test_query_equals_its_sql(spark, sf):
    compare(spark, warc.op5_warc, warc.ORACLE_SQL, sf)


@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree_merges(runs):
    runs = [[(x,) for x in sorted(r)] for r in runs]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_odd_pages(spark):
    big = "é" * 60
    rows = [(1, "http://a.b/x#f", big, "k"), (2, None, big, "k"), (3, "http://A.B/x", None, "k"), (4, "u\r\nv", "WARC/1.1\r\n\r\n" * 20, "k"), (1, "http://www.a.b:80/x", big, "k"), (5, "", "", "k"), (6, "q", "x" * 99, "k"), (7, "q", "x" * 99, "k"), (8, "q", "y" * 300_000, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    path = work_path(spark, "warc-test")
    warc.archived(pages, path, per_file=2)
    index = warc.numbered(written(warc.merged(warc.records(spark, path)), "index")).orderBy("part", "key", "at", "page_id").collect()
    assert len(index) == len(rows)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in index}
    assert got[2] == ("revisit", 1, 120) and got[1][0] == "response" and got[3] == ("response", None, 0) and got[7] == ("response", None, 99) and got[4][2] == 240
    assert [(r["key"], r["at"], r["page_id"]) for r in index] == sorted((r["key"], r["at"], r["page_id"]) for r in index)
    assert {r["key"] for r in index if r["page_id"] in (1, 3)} == {"b,a)/x"}
    assert sorted(r["history"] for r in index if r["key"] == "b,a)/x") == [0, 1, 2]
    warc.archived(pages.limit(0), path + "-none")
    assert warc.merged(warc.records(spark, path + "-none")).count() == 0


def test_offsets_point_at_records(spark):
    g = random.Random(4)
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/{k}", "p" * g.randint(0, 500)) for k in range(30)], "page_id long, url string, html string")
    path = work_path(spark, "warc-offsets")
    warc.archived(pages.coalesce(1), path)
    rows = warc.records(spark, path).collect()
    data = b"".join(warc.unzipped(open(rows[0]["run"].removeprefix("file:"), "rb").read()))
    for r in rows:
        h, _, _, _ = next(warc.parsed(iter([data[r["offset"] : r["offset"] + r["length"] + 4]])))
        assert h["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>"
