import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cairnlight.llm import neural_lm as lm
from cairnlight.llm import resampling as rs
from cairnlight.llm.common import read


def test_base_scores_equal_brute_force_and_the_model_is_better(spark, sf):
    docs = read(spark, sf, "documents")
    rows = {r["doc_id"]: r for r in lm.scored(docs, chunk_bytes=60_000).collect()}
    texts = {r["doc_id"]: lm.words((r["text"] or "").encode()) + [lm.END] for r in docs.collect()}
    test = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, t in texts.items() if not test[i] for w in t)
    n, v = sum(c.values()), len(c)
    assert rows.keys() == texts.keys()
    sums = [0.0, 0.0]
    for i, t in texts.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (test[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        if test[i]:
            sums[0] += r["base_score"]
            sums[1] += r["score"]
    assert sums[1] > sums[0]


def test_distribution_sums_to_one():
    counts = np.random.default_rng(1).poisson(0.05, (lm.UNITS + 1, lm.UNITS + 1, lm.UNITS)).astype(float)
    table = lm.LogBilinear().train(counts).table()
    assert np.allclose((10.0 ** table).sum(2), 1, atol=1e-4)


def test_scores_of_odd_rows(odd, none):
    rows = lm.scored(odd).collect()
    assert len(rows) == odd.count() and lm.scored(none).count() == 0
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}


def test_no_training_text(spark):
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.scored(spark.createDataFrame([(only, "some words")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"]) == (0, 0, 3) and math.isfinite(r["score"])


def test_resampling_drops_what_the_target_lacks(spark):
    good = "the quick brown fox jumps over the lazy dog and the river runs down to the sea"
    docs = [(k, f"{good} n{k % 7} {good}") for k in range(300)] + [(1000 + k, f"{good} vile{k % 3} slur scum %%% {good} slur scum %%%") for k in range(150)] + [(5000, None), (5001, " ")]
    labels = [(i, int(i < 1000), 0) for i, _ in docs[::2]] + [(4, None, None), (0, 1, 0)]
    df, lb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored, least = rs.drawn(df, lb)
    kept = {r[0] for r in scored.where(scored[rs.NAMES[2]] >= least).collect()}
    assert not {i for i in kept if i >= 1000} and len(kept) >= 290
    out = rs.kept_documents(df, lb)
    assert {r["doc_id"] for r in out.collect()} == kept and out.columns == df.columns


def test_kth_largest(spark):
    values = [float(x % 97) + (x % 3) / 7 for x in range(5000)] + [1e6]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 500, 4999, 5001):
        assert rs.kth_largest(df, "v", k, bins=16) == sorted(values, reverse=True)[k - 1]
    assert rs.kth_largest(df, "v", 0) == math.inf and rs.kth_largest(df, "v", 9999) == min(values)


def test_resampling_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored, _ = rs.drawn(odd, labels)
    kept = rs.kept_documents(odd, labels)
    assert scored.count() == odd.count() and kept.count() == odd.count() - 3 and kept.schema == odd.schema
    assert rs.drawn(none, labels)[0].count() == 0 and rs.kept_documents(none, labels).count() == 0
    assert rs.kept_documents(odd, labels, k=4).count() >= 4


def test_whole_draw_equals_brute_force(spark, sf):
    """Counts, means, spread, weights, noise and the k-th key over all of sf0.001, by dictionaries and loops."""
    docs, labels = (read(spark, sf, x) for x in ("documents", "labels"))
    rows, told = docs.select("doc_id", "text").collect(), {}
    for r in labels.collect():
        told[r["doc_id"]] = told.get(r["doc_id"], True) and r["quality"] == 1 and r["toxic"] == 0
    verdict: dict[str, bool] = {}
    for r in rows:
        if r["doc_id"] in told:
            verdict[r["text"]] = verdict.get(r["text"], True) and told[r["doc_id"]]
    target = {t for t, good in verdict.items() if good}
    grams = {t: [[(k, *p) for p, k in zip(rs.places(x).T.tolist(), rs.kind_of(x).tolist())] for x in [rs.n_grams((t or "").encode())[0]]][0] for t in {r["text"] for r in rows}}
    raw, good = Counter(), Counter()
    for t, g in grams.items():
        for k, a, b in g:
            for c in (raw, good)[: 1 + (t in target)]:
                c[k, a] += 1
                c[k, b] += 1
    share = [sum(n for (k, _), n in good.items() if k == kind) / sum(n for (k, _), n in raw.items() if k == kind) for kind in range(rs.KINDS)]
    stats = {}
    for t, g in grams.items():
        own, sums, n = Counter(g), [0.0] * rs.KINDS, [0] * rs.KINDS
        for (k, a, b), c in own.items():
            ratio = max((max(good[k, p] - c * (t in target), 0) + rs.PRIOR[k]) / (max(raw[k, p] - c, 0) * share[k] + rs.PRIOR[k]) for p in (a, b))
            sums[k] += min(0.0, math.log(ratio)) * c
            n[k] += c
        stats[t] = ([x / max(m, 1) for x, m in zip(sums, n)], n)
    fit = []
    for k in range(rs.KINDS):
        mean, n = (np.array([stats[t][at][k] for t in target if stats[t][1][k]]) for at in (0, 1))
        centre = mean.mean()
        a, b = np.linalg.lstsq(np.stack([np.sqrt(n), 1 / np.sqrt(n)], 1), (mean - centre) ** 2 * np.sqrt(n), rcond=None)[0]
        fit.append((centre, max(a, 1e-6), max(b, 1e-4)))
    weight = {t: sum((m - c) / math.sqrt(a + b / n) for m, n, (c, a, b) in zip(*stats[t], fit) if n) for t in grams if stats[t][1][0]}
    mine = sorted(weight[t] for t in target)
    least = mine[max(0, math.ceil(0.02 * len(mine)) - 1)]
    k = sum(weight.get(r["text"], -math.inf) >= least for r in rows)
    keys = {r["doc_id"]: weight[r["text"]] + float(rs.gumbel(np.array([r["doc_id"]]), 6)[0]) for r in rows if r["text"] in weight}
    kept = set(sorted(keys, key=keys.get, reverse=True)[:k])
    found, cut = rs.drawn(docs, labels)
    got = {r[0]: (r[1], r[2]) for r in found.collect()}
    assert all(got[r["doc_id"]][0] == pytest.approx(weight[r["text"]], rel=1e-3, abs=1e-3) for r in rows if r["text"] in weight)
    assert all(got[i][1] == pytest.approx(key, rel=1e-3, abs=1e-3) for i, key in keys.items())
    assert {i for i, (_, key) in got.items() if key is not None and key >= cut} == kept


@pytest.fixture(scope="module")
def judged(spark):
    """Labelled documents of sf0.1: doc_id, text, lang, quality, toxic, kept, words."""
    docs, labels = (read(spark, "/root/testdata/sf0.1", x) for x in ("documents", "labels"))
    scored, least = rs.drawn(docs, labels)
    out = scored.toDF("doc_id", "weight", "key").selectExpr("*", f"key >= {least!r}D as kept").join(docs, "doc_id").join(labels, "doc_id").toPandas()
    out["words"] = out["text"].str.split().str.len()
    return out


def test_long_good_documents_are_not_rejected_in_bulk(judged):
    good = judged[(judged["quality"] == 1) & (judged["toxic"] == 0)]
    for low, high in ((0, 100), (100, 500), (500, 1000), (1000, 2000), (2000, 5000)):
        band = good[(good["words"] >= low) & (good["words"] < high)]
        assert (~band["kept"]).mean() < 0.06, (low, high)


def test_toxic_documents_are_found_in_every_language(judged):
    toxic = judged[judged["toxic"] == 1]
    assert (~toxic["kept"]).mean() > 0.85
    for lang, rows in toxic.groupby("lang"):
        assert (~rows["kept"]).mean() > 0.5, lang


def test_copies_of_a_text_count_once(spark):
    rows = [(k, f"a text of its own {k} with words") for k in range(20)]
    copies = [(100 + k, rows[3 + k % 2][1]) for k in range(50)] + [(None, rows[5][1]), (5, rows[5][1])]
    labels = [(3, 1, 0), (100, 1, 0), (7, 1, 0), (4, 1, 0), (101, 0, 0)]
    plain, more = (spark.createDataFrame(r, "doc_id long, text string").repartition(3) for r in (rows, rows + copies))
    ids, good = rs.labelled(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 100)
    target = rs.targets(more, ids, good)
    own = {r["doc_id"]: r[rs.ID] for r in rs.hashes(plain).collect()}
    assert sorted(target) == sorted([own[3], own[7]])
    both = rs.counts(more, target)
    assert (both == rs.counts(plain, target)).all()
    assert both[0, : 2 * rs.SIZE].sum() == 2 * sum(len(t.split()) for _, t in rows)


def test_trigrams_tell_95_words_apart(spark):
    names = [f"w{k}" for k in range(95)]
    frequent = {w.encode(): k for k, w in enumerate(names)}
    docs = spark.createDataFrame([(k, f"{a} {b} rare{k}") for k, (a, b) in enumerate(zip(names, names[1:]))], "doc_id long, text string")
    found = lm.unit_counts(lm._prepared(docs, 60_000), frequent)
    want = Counter()
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            before, last = lm.START, lm.START
            for w in lm.words(r["text"].encode()) + [lm.END]:
                unit = lm.unit_of(w, frequent) if w else 0
                want[before, last, unit] += 1
                before, last = last, unit
    assert found.sum() == sum(want.values()) and all(found[k] == n for k, n in want.items())
