"""Single operators on small tables of input and expected output."""

import random

import pytest
from pyspark.sql import functions as F

from cairnlight.functions import text as tx
from cairnlight.operators import code, feedback, graph, packets, reconcile, retrieval, units


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "title, kind",
    [("Data Flow", "data_flow"), ("Prefix notes", "section"), ("Because", "section"), ("The Fix", "fix"), ("quick_fix_notes", "fix"), ("fix2", "section"), ("cause_of_it", "root_cause"), ("Root cause", "root_cause"), ("Key Claims", "design_decision"), ("Edgecase", "edge_case"), ("Structure", "data_structure")],
)
def test_kinds(spark, title, kind):
    assert one(spark, tx.classify_kind(F.col("t")), t=title) == kind


@pytest.mark.parametrize("token, ok", [("abc", False), ("Player", False), ("GameplayEffect", True), ("my_sym", True), ("____", False), ("ALLCAPS", False), ("camelCaseX", True)])
def test_symbols(spark, token, ok):
    assert one(spark, tx.looks_like_symbol(F.col("t")), t=token) is ok


def test_bullets(spark):
    body = "- first\n* second\nnot a bullet\n- \n- third\n"
    assert one(spark, tx.bullets(F.col("b")), b=body) == ["first", "second not a bullet", "third"]
    assert one(spark, tx.bullets(F.col("b")), b="- one\n\nstill one\n-\nlost\n") == ["one still one"]


@pytest.mark.parametrize(
    "bullet, expected",
    [
        ("`Sym` defined at `a/b.h:24`", ("Sym", "a/b.h", 24)),
        ("`Sym()` at `a/b.h`", ("Sym", "a/b.h", None)),
        ("`Sym` alone", ("Sym", None, None)),
        ("no ticks", None),
        ("`a/b.h:3` only", None),
    ],
)
def test_evidence(spark, bullet, expected):
    got = one(spark, tx.evidence(F.col("b")), b=bullet)
    assert (tuple(got) if got else None) == expected


def test_claim_markers(spark):
    assert one(spark, F.struct(tx.claim_source(F.col("t")), tx.claim_text(F.col("t"))), t="  [Extracted]  says so") == ("extracted", "says so")
    assert one(spark, tx.claim_source(F.col("t")), t="plain [inferred]") is None


def test_query_terms(spark):
    assert one(spark, tx.query_terms(F.col("q")), q="IronAnvilInstance.h") == ["ironanvilinstance", "h"]
    assert one(spark, tx.query_terms(F.col("q")), q="...") == []


def test_first_paragraph(spark):
    assert one(spark, tx.first_paragraph(F.col("b")), b="\n\n one \ntwo\n\nthree\n") == "one two"
    assert one(spark, tx.first_paragraph(F.col("b")), b=" \n\t\n") is None
    assert len(one(spark, tx.first_paragraph(F.col("b")), b="x" * 999)) == 300


def test_splitter_keeps_fences_and_lines(spark):
    text = "---\nmodule: m\n---\n\n# Top\nintro\n```\n## no\n```\n## A\n### B\nb\n## C\n"
    rows = {r["id"]: r for r in units.split_units(spark.createDataFrame([(0, "x.md", text)], "library int, relative string, content string")).collect()}
    assert [rows[k]["title"] for k in sorted(rows)] == ["Top", "A", "B", "C"]
    assert rows["doc:x.md#s2"]["parent_id"] == "doc:x.md#s1" and rows["doc:x.md#s2"]["heading_path"] == "Top > A > B"
    assert rows["doc:x.md"]["source_line"] == 5 and rows["doc:x.md#s3"]["source_line"] == 13
    assert rows["doc:x.md#s1"]["has_children"] and "## no" in rows["doc:x.md"]["body"]


def test_heading_parents_equal_a_stack(spark):
    g = random.Random(3)
    docs, expected = [], {}
    for d in range(40):
        levels = [g.randint(1, 6) for _ in range(g.randint(1, 12))]
        docs.append((0, f"{d}.md", "text\n" + "".join(f"{'#' * k} h{i}\n" for i, k in enumerate(levels))))
        stack = [(0, 0)]
        for i, k in enumerate(levels, 1):
            while stack[-1][1] >= k:
                stack.pop()
            expected[d, i] = stack[-1][0]
            stack.append((i, k))
    rows = units.split_units(spark.createDataFrame(docs, "library int, relative string, content string")).where("ord > 0").collect()
    got = {(int(r["relative"][:-3]), r["ord"]): int(r["parent_id"].partition("#s")[2] or 0) for r in rows}
    assert got == expected


@pytest.mark.parametrize(
    "row, level",
    [
        (("accepted", False, 1, 1, 1, 0, 10), "sufficient"),
        (("accepted", False, 0, 3, 0, 0, 250), "sufficient"),
        (("accepted", True, 1, 1, 0, 0, 10), "sufficient"),
        (("accepted", False, 0, 0, 0, 1, 10), "insufficient"),
        (("accepted", False, 0, 0, 0, 0, 250), "partial"),
        (("accepted", False, 0, 1, 0, 0, 10), "partial"),
        (("accepted", False, 0, 0, 0, 0, 10), "insufficient"),
        (("degraded", False, 5, 5, 5, 5, 999), "insufficient"),
    ],
)
def test_answerability(spark, row, level):
    df = spark.createDataFrame([row], "status string, mechanical boolean, primary_resolved int, resolved_refs int, claim_count int, verified_claims int, content_chars int")
    assert df.select(packets.answerability().alias("x")).first()["x"] == level


@pytest.mark.parametrize(
    "applies, excludes, context, expected",
    [([], [], ["a"], (1.0, None)), (["a"], [], ["a"], (1.25, "match")), (["b"], [], ["a"], (0.85, "mismatch")), (["a"], ["a"], ["a"], (0.5, "excluded")), (["a"], ["a"], [], (1.0, None))],
)
def test_context_grading(spark, applies, excludes, context, expected):
    df = spark.createDataFrame([(applies, excludes, context)], "a array<string>, e array<string>, c array<string>")
    assert tuple(df.select(retrieval.context_graded(F.col("a"), F.col("e"), F.col("c")).alias("x")).first()["x"]) == expected


def test_fusion_credits_routes(spark):
    schema = "query_id int, library string, node_id string, rank int"
    a = spark.createDataFrame([(1, "p", "x", 1), (1, "p", "y", 2)], schema)
    b = spark.createDataFrame([(1, "p", "y", 1)], schema)
    rows = retrieval.fused({"bm25": a, "symbol": b}).collect()
    assert [(r["node_id"], r["routes"]) for r in rows] == [("y", "bm25,symbol"), ("x", "bm25")]
    assert rows[0]["score"] == pytest.approx(1 / 62 + 2 / 61, abs=1e-8)


def test_streaks_that_end_in_a_null_verdict(spark):
    rows = [(1, 5, "ok"), (2, 5, None), (3, 5, None), (4, 6, None), (5, 6, "ok")]
    got = {r["node_id"]: (r["outcome"], r["streak"]) for r in feedback.streaks(spark.createDataFrame(rows, "id long, node_id long, verdict string")).collect()}
    assert got == {5: (None, 2), 6: ("ok", 1)}


def test_streaks(spark):
    rows = [(1, 7, "a"), (2, 7, "b"), (3, 7, "b"), (4, 8, "a"), (5, 9, "a"), (6, 9, "a")]
    got = {r["node_id"]: (r["outcome"], r["streak"]) for r in feedback.streaks(spark.createDataFrame(rows, "id long, node_id long, verdict string")).collect()}
    assert got == {7: ("b", 2), 8: ("a", 1), 9: ("a", 2)}


def test_bfs_equals_a_queue(spark):
    g = random.Random(5)
    pairs = sorted({(f"n{g.randint(0, 9)}", f"n{g.randint(0, 9)}") for _ in range(25)})
    edges = spark.createDataFrame(pairs, "source string, target string")
    got = {(r["source"], r["target"], r["depth"]) for r in graph.callees(edges, spark.createDataFrame([("n0",)], "start string"), 3).collect()}
    dist, queue = {"n0": 0}, ["n0"]
    for n in queue:
        for s, t in pairs:
            if s == n and t not in dist:
                dist[t] = dist[n] + 1
                queue.append(t)
    assert got == {(s, t, dist[s] + 1) for s, t in pairs if dist.get(s, 9) < 3}


def test_three_way(spark):
    d = spark.createDataFrame([("new", "h", None), ("same", "h", None), ("drift", "h2", None), ("mine", "h", None), ("off", "h", "policy")], "name string, hash string, reason string")
    e = spark.createDataFrame([("same", "h"), ("drift", "h"), ("mine", "x"), ("old", "h")], "name string, hash string")
    o = spark.createDataFrame([("same", "h"), ("drift", "h"), ("old", "h")], "name string, hash string")
    got = {r["name"]: (r["action"], r["reason"]) for r in reconcile.three_way(d, e, o).collect()}
    assert got == {"new": ("added", None), "same": ("unchanged", None), "drift": ("updated", None), "mine": ("skipped", "user-owned"), "off": ("skipped", "policy"), "old": ("removed", None)}


def test_python_scan(spark):
    files = spark.createDataFrame([("a.py", "python", "class A(B):\n    def f(self):\n        g()\n"), ("bad.py", "python", "def ("), ("n.py", "python", None)], "path string, language string, content string")
    symbols, edges = code.scanned(files)
    assert {(r["qualified_name"], r["kind"]) for r in symbols.collect()} == {("A", "class"), ("A::f", "function")}
    assert {(r["relation"], r["target_symbol"]) for r in edges.collect()} == {("inherits", "B"), ("call", "g")}


def test_marked_section(spark):
    assert one(spark, reconcile.marked_section_removed(F.col("t"), "<!-- a -->", "<!-- /a -->"), t="x\n\n<!-- a -->\nold\n<!-- /a -->\n\ny") == "x\ny"
    assert one(spark, reconcile.marked_section_removed(F.col("t"), "<a>", "</a>"), t="<a>only</a>") is None
