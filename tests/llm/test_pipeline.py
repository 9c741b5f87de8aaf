from pathlib import Path

import corpus_pipeline
from cairnlight.llm.common import let_go, read, shared_dir, written
from cairnlight.llm.jaccard_join import joined


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, sf), "stage")
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k == 1:
            comps = joined(before, 5, 80, 100)
            assert sizes[-1] == comps.select("component_id").distinct().count()
            assert {r["doc_id"] for r in docs.collect()} == {r["component_id"] for r in comps.collect()}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() == sizes[-1] and set(whole.columns) == {"doc_id", "n_tokens", "ids", "text"}


def test_quality_leaves_no_texts_on_disk(spark, sf):
    folder = Path(shared_dir(spark).removeprefix("file:")) / "cairnlight"
    before = set(folder.iterdir()) if folder.exists() else set()
    docs = read(spark, sf, "documents")
    kept = corpus_pipeline.quality(spark, docs, sf)
    left = [spark.read.parquet(f"file://{p}") for p in set(folder.iterdir()) - before]
    assert left and not any(c == "text" and kind == "string" for t in left for c, kind in t.dtypes)
    assert 0 < kept.count() < docs.count() and kept.columns == docs.columns and kept.exceptAll(docs).count() == 0


def test_letting_go_collects_the_executors_heaps(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    runs = lambda: sum(b.getCollectionCount() for b in beans)
    before = runs()
    let_go(spark)
    assert runs() - before >= 3  # two of the driver, one or more of the tasks, which share its heap here
