"""Routes by products of blocks: against SQL on odd tables, against plain sorting, and that no plan lists pairs."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare

from cairnlight.operators import products, retrieval
from cairnlight.plans import tables

SF = "/root/testdata/sf0.001"
ROUTES = ("bm25_batch", "rrf_fusion", "eval_metrics", "vector_topk")


@pytest.fixture(scope="module")
def odd_tables(tmp_path_factory):
    """Copies, ids that come twice or not at all, no text, no library, queries that come twice, equal vectors."""
    path, rng = tmp_path_factory.mktemp("odd"), random.Random(5)
    text = lambda n: " ".join(rng.choice("ab cd Ef gh_ij kl-mn ñop 12 x² qr st".split()) for _ in range(n))
    docs = [(k, text(rng.randrange(0, 60)), rng.choice(["en", "de", None])) for k in range(120)]
    docs += [(200 + k, docs[3][1], "en") for k in range(50)] + [(k, text(9), "en") for k in (1, 1, 2, 300, 300)] + [(None, text(12), x) for x in ("en", "de", None, "en")] + [(400, None, "en"), (401, "", "de")]
    pq.write_table(pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": [d[1] for d in docs], "lang": [d[2] for d in docs], "source": ["s"] * len(docs), "n_chars": pa.array([len(d[1] or "") for d in docs], pa.int64())}), f"{path}/documents.parquet")
    asked = [(k, text(5)) for k in range(20)] + [(3, text(4)), (None, "ab ab cd"), (30, None), (31, "none of these"), (32, docs[3][1])]
    pq.write_table(pa.table({"item_id": pa.array([a[0] for a in asked], pa.int64()), "text": [a[1] for a in asked]}), f"{path}/benchmark.parquet")
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(260)] + [[1.0] * 6] * 60
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}), f"{path}/embeddings.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([0, 0, 3, 210, None], pa.int64()), "quality": pa.array([0, 1, 1, 0, 0], pa.int32()), "toxic": pa.array([0, 1, 1, 0, 0], pa.int32())}), f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name", ROUTES)
def test_odd_tables_equal_sql(spark, odd_tables, name):
    compare(spark, tables.QUERIES[name], tables.ORACLES[name], odd_tables)


def test_blocks_of_queries_make_no_difference(spark, monkeypatch):
    monkeypatch.setattr(products, "BLOCK", 13)
    for name in ("rrf_fusion", "vector_topk"):
        compare(spark, tables.QUERIES[name], tables.ORACLES[name], SF)


def test_no_plan_lists_pairs(spark):
    for name in (*ROUTES, "hybrid_search"):
        plan = tables.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "explode(qs" not in plan and "explode(terms" not in plan


@pytest.mark.parametrize("step", [1, 7, 500])
def test_best_is_the_head_of_a_stable_sort(step):
    rng = np.random.default_rng(step)
    scores = rng.integers(0, 9, (5, 40_000 if step > 1 else 900)) / 10.0
    scores[rng.random(scores.shape) < 0.3] = -np.inf
    scores[4] = -np.inf
    scores[3, 3:] = -np.inf
    held = products.Best(5, 6, pa.int64())
    for k in range(0, scores.shape[1], step):
        held.add(scores[:, k : k + step], pa.array(range(k, min(k + step, scores.shape[1])), pa.int64()))
    q, nodes, score = held.rows()
    got = sorted(zip(q.tolist(), nodes.to_pylist(), score.tolist(), strict=True))
    want = [(k, int(c), float(row[c])) for k, row in enumerate(scores) for c in np.argsort(-row, kind="stable")[:6] if row[c] > -np.inf]
    assert got == sorted(want)
    assert len(held.nodes) <= 4 * 30 + 4096 + step


def test_pairs_without_a_cosine(spark):
    nan = float("nan")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, 0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, 1.0])], "node_id long, vector array<float>")
    queries = spark.createDataFrame([(9, [2.0, 0.0]), (8, [3.0, 0.0, 0.0]), (0, None)], "query_id long, vector array<float>")
    got = [(r["query_id"], r["node_id"], repr(r["score"]), r["rank"]) for r in retrieval.vector_route(vectors, queries, 10).orderBy("query_id", "rank").collect()]
    assert got == [(8, 5, "1.0", 1), (9, 6, "nan", 1), (9, 1, "1.0", 2), (9, 7, "0.707107", 3)]
