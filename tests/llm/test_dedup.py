import hashlib
import random

import pytest

from cairnlight.llm import jaccard_join as jj
from cairnlight.llm import suffix_dedup as sd
from cairnlight.llm.graph import components, in_rounds


def plain_removed(docs, length):
    """{(doc_id, text): kept bytes}: every string against every string."""
    out = {}
    for d, t in docs:
        t = (t or "").encode()
        earlier = {u[i : i + length] for e, u in ((e, (u or "").encode()) for e, u in docs if e is not None and d is not None and e < d) for i in range(len(u) - length + 1)}
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if t[i : i + length] in earlier:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d, t] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length", [26, 50, 64, 150])
def test_substrings_equal_brute_force(spark, length):
    g = random.Random(length)
    words = ["alpha", "be", "gamma ray", "délta", "of the", "aaaaaaaaaa"]
    base = [" ".join(g.choices(words, k=60)) for _ in range(4)]
    docs = []
    for k in range(40):
        b = g.choice(base)
        i, n = g.randint(0, 200), g.randint(0, 200)
        docs.append((k, " ".join(g.choices(words, k=g.randint(0, 20))) + b[i : i + n] + " ".join(g.choices(words, k=5))))
    docs += [(50, docs[3][1]), (50, docs[3][1]), (50, docs[4][1]), (51, None), (52, ""), (53, "a" * 700), (54, "a" * 400), (None, docs[3][1]), (55, "é" * 100), (56, "é" * 99)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, tag long").repartition(5)
    expected = plain_removed(docs, length)
    rows = sd.digests(df, length).collect()
    assert len(rows) == len(docs)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == sorted((str(d), *expected[d, (t or "").encode()]) for d, t in docs)


def test_pieces_of_long_texts_overlap(spark):
    g = random.Random(9)
    long = "".join(g.choices("abcdefghij ", k=sd.PIECE + 5000))
    docs = [(1, long), (2, long[sd.PIECE - 300 : sd.PIECE + 300]), (3, "x" + long[4000:])]
    rows = {r["doc_id"]: r["n_removed"] for r in sd.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {1: 0, 2: 600, 3: len(docs[2][1]) - 1}


def test_trimmed_documents(spark, odd, none):
    out = sd.trimmed_documents(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and sd.digests(none).count() == 0
    docs = spark.createDataFrame([(1, "é" * 40, 40), (2, "x" + "é" * 39 + "€y", 42)], "doc_id long, text string, n_chars long")
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in sd.trimmed_documents(docs).collect()} == {1: ("é" * 40, 40), 2: ("x€y", 3)}


def plain_components(docs, width, num, den):
    sets = {}
    for d, t in docs:
        w = tuple((t or "").encode().lower().split())
        sets[d] = frozenset(w[i : i + width] for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([w]) if w else frozenset()
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {d: (len(sets[d]), comp[d]) for d in sets}


@pytest.mark.parametrize("width, num, den, seed", [(3, 90, 100, 1), (5, 80, 100, 2), (1, 50, 100, 3), (2, 70, 100, 4)])
def test_join_equals_brute_force(spark, width, num, den, seed):
    g = random.Random(seed)
    base = [[f"w{g.randint(0, 400)}" for _ in range(g.choice([1, 2, 4, 9, 11, 20, 60, 150]))] for _ in range(14)]
    docs = []
    for k in range(110):
        w = list(g.choice(base))
        for _ in range(g.choice([0, 0, 1, 2, 5, 9])):
            at = g.randrange(len(w) + 1)
            w[at : at + g.randint(0, 1)] = [f"n{g.randint(0, 50)}"] * g.randint(0, 1)
        docs.append((k, " ".join(w)))
    docs += [(200, None), (201, ""), (202, docs[5][1].upper())]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.joined(spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, key string").repartition(4), width, num, den).collect()}
    assert got == plain_components(docs, width, num, den)


def test_tiles_find_what_stars_miss(spark, monkeypatch):
    """A path of texts, each near the next only; tiles of two."""
    monkeypatch.setattr(jj, "TILE", 2)
    monkeypatch.setattr(jj, "MEMBERS", 2)
    words = [f"t{k}" for k in range(90)]
    docs = [(k, " ".join(words[k : k + 40])) for k in (7, 3, 9, 1, 5, 0, 8, 2, 6, 4, *range(39, 9, -1))]
    docs += [(60 + k, " ".join(words[:30] + [f"u{k}{j}" for j in range(12)])) for k in range(6)]
    got = {r["doc_id"]: r["component_id"] for r in jj.joined(spark.createDataFrame(docs, "doc_id long, text string"), 1, 90, 100).collect()}
    assert got == {d: c for d, (_, c) in plain_components(docs, 1, 90, 100).items()}


@pytest.mark.parametrize("big, sketches", [(4096, 3), (3, 4)])
def test_large_groups_are_dealt_out_and_split(spark, monkeypatch, big, sketches):
    """Texts that share a passage, some of them near each other: tiles of few sketches, and groups split by partitions."""
    monkeypatch.setattr(jj, "SKETCHES", sketches)
    monkeypatch.setattr(jj, "BIG", big)
    g = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = []
    for k in range(45):
        own = docs[g.randrange(len(docs))][1].split()[60:] if docs and g.random() < 0.5 else [f"o{g.randint(0, 500)}" for _ in range(14)]
        own[g.randrange(len(own))] = f"x{g.randint(0, 30)}"
        docs.append((k, passage + " " + " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in jj.joined(spark.createDataFrame(docs, "doc_id long, text string"), 1, 90, 100).collect()}
    assert got == {d: c for d, (_, c) in plain_components(docs, 1, 90, 100).items()}


def test_held_rows_of_a_bucket(monkeypatch):
    """However soon rows are told: every hash that three or more have, none that one has, and two of two."""
    for limit in (0, 5, 40, 1 << 20):
        monkeypatch.setattr(jj, "HELD", limit)
        g = random.Random(limit)
        rows = [(g.randint(0, 60), k) for k in range(120)]
        held, told = jj.Held(), []
        for k in range(0, 120, 7):
            part = jj.np.array(rows[k : k + 7], jj.np.int64)
            for key, doc in held.add(part[:, 0], part[:, 1]):
                told += zip(key.tolist(), doc.tolist())
        (key, doc), pairs = held.rows(3)
        told += zip(key.tolist(), doc.tolist())
        per = {}
        for k, d in rows:
            per.setdefault(k, set()).add(d)
        got = {}
        for k, d in told:
            got.setdefault(k, []).append(d)
        assert all(sorted(got.get(k, [])) == sorted(d) for k, d in per.items() if len(d) > 2) and not any(k in got for k, d in per.items() if len(d) == 1)
        assert all(k in got or set(d) in map(set, pairs.tolist()) for k, d in per.items() if len(d) == 2)


def test_sketches_bound_the_difference():
    g = random.Random(5)
    import numpy as np

    for _ in range(300):
        x = set(g.sample(range(3000), g.randint(1, 700)))
        y = {e for e in x if g.random() < 0.9} | set(g.sample(range(3000), g.randint(0, 90)))
        a, b = (jj.sketch(np.sort(np.array(list(s), np.uint64))) for s in (x, y))
        size = min(len(a), len(b))
        assert np.bitwise_count(jj.folded(a, size) ^ jj.folded(b, size)).sum() <= len(x ^ y)


def test_texts_of_one_doc_id_are_one_node(spark):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = [(1, one), (2, two), (7, one), (7, two), (8, "else"), (None, one)]
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jj.joined(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    assert got == [("1", "1"), ("2", "1"), ("7", "1"), ("7", "1"), ("8", "8"), ("None", "None")]


def test_neighbourhoods_stand_in_for_empty_segments():
    """Whatever differs within the bound, two sets share a hash: also with c forced to 0, where empty segments abound."""
    g = random.Random(6)
    bands = jj.Bands(4, 5)
    import numpy as np

    for trial in range(300):
        n = g.choice([1, 2, 3, 5, 9, 10, 14, 30, 80])
        x = set(g.sample(range(10**9), n))
        y = set(x)
        for _ in range(g.randint(0, max(1, n // 5))):
            if y and g.random() < 0.5:
                y.remove(next(iter(y)))
            else:
                y.add(g.randrange(10**9))
        if not y or 5 * len(x & y) < 4 * len(x | y):
            continue
        sets = [np.sort(np.array(list(s), np.uint64)) for s in (x, y)]
        keys, owner = jj.signatures(sets, bands)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), (trial, n)


def test_odd_rows(odd, none):
    rows = jj.joined(odd).collect()
    assert len(rows) == odd.count() and jj.joined(none).count() == 0
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert by[1] == (0, 1) and by[4] == (1, 4) and by[None][1] is None and by[6] == (1, 6)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300), (301, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {r["node"]: r["component"] for r in in_rounds(df).collect()}
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 140)} | {300: 300, 301: 300}


@pytest.mark.parametrize("batch", [1, 3, 7, 100])
def test_reranking_in_one_pass(spark, batch):
    """Sorted entries read in batches of any length: settled, and open where a key has several names."""
    g = random.Random(batch)
    rows = [(g.randint(0, 12), g.choice([1, 1, 1, 2, 3]), g.randint(0, 5), k) for k in range(150)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        arrays = [sd.np.array(c, sd.np.int64) for c in zip(*rows, strict=True)]
        zero = arrays[0] * 0
        blocks = []
        for k in range(0, 150, 10):
            part = [a[k : k + 10] for a in (arrays[0].view(sd.U), arrays[1].view(sd.U), arrays[2], zero, zero, arrays[3], zero + 1)]
            blocks += [b for b in sd.packed(*part, 4)]
        table = sd.pa.Table.from_batches(blocks).to_pandas()
        got = sd.reranked(spark.createDataFrame(table, sd.BLOCK), 4, True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first, names = {}, {}
    for k, n, d, _ in rows:
        first[k, n] = min(d, first.get((k, n), d))
        names.setdefault(k, set()).add(n)
    settled = {p for k, n, d, p in rows if d > first[k, n]}
    open_ = {p for k, n, d, p in rows if d == first[k, n] and len(names[k]) > 1}
    marks = [(r["mark"] >> sd.COUNT_BITS, r["open"]) for r in got]
    assert {p for p, o in marks if not o} == settled and {p for p, o in marks if o} == open_ and len(marks) == len(set(marks))


def test_columns_named_like_inner_ones(spark):
    docs = spark.createDataFrame([(1, "x" * 80, 1, 2, 3), (2, "y" + "x" * 80, 4, 5, 6)], "doc_id long, text string, found_marks int, tag int, marks int")
    assert sorted(map(tuple, sd.trimmed_documents(docs).collect())) == [(1, "x" * 80, 1, 2, 3), (2, "y", 4, 5, 6)]


def test_a_task_gathers_hashes_before_it_sends_blocks(spark):
    g = random.Random(5)
    texts = [" ".join(f"w{g.randrange(9999)}" for _ in range(1000)) for _ in range(250)]  # about 1.5 MB, three slices
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bands, buckets = jj.Bands(4, 5), 64
    blocks = jj.index_blocks(docs, 5, bands, buckets).collect()
    sent = [b for b in blocks if b["keys"] is not None]
    assert len(blocks) - len(sent) == len(texts)
    assert len(sent) == len({b["bucket"] for b in sent}) <= buckets
    assert sum(len(b["keys"]) for b in sent) == jj.KEY_BYTES * sum(len(jj.signatures([jj.n_grams(t.encode(), 5)], bands)[0]) for t in texts)


def test_only_texts_that_a_comparison_needs_are_sent(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(50)] + [(3, "again"), (None, "none")], "doc_id long, text string")
    ids = spark.createDataFrame([(3,), (7,), (7,), (None,)], "doc_id long")
    got = sorted(tuple(r) for r in jj.texts_of(ids, docs).collect())
    assert got == [(3, "again"), (3, "t3"), (7, "t7")]
    monkeypatch.setattr(jj, "FEW", 1)  # too many ids to send: all rows, for the join to choose from
    assert jj.texts_of(ids, docs).count() == 52


def test_join_is_the_same_when_ids_are_too_many_to_send(spark, monkeypatch):
    near = [(k, " ".join(f"w{j}" for j in range(40) if j != k)) for k in range(8)]
    rows = near + [(20 + k, t) for k, t in near[:3]] + [(1, "another text of one"), (30, "another text of one"), (40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    few = sorted(tuple(r) for r in jj.joined(docs, 2, 80, 100).collect())
    monkeypatch.setattr(jj, "FEW", -1)
    assert sorted(tuple(r) for r in jj.joined(docs, 2, 80, 100).collect()) == few
    assert {r[2] for r in few if r[0] in range(8) and r[1] > 5} == {0}
