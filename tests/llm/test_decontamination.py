import itertools
import random

from cairnlight.llm import decontamination as dc


def test_masks_hit_whatever_is_substituted():
    for masks, sizes in ((dc.MASKS, [dc.WINDOW]), (dc.SHORT_MASKS, range(dc.LEAST, dc.WINDOW))):
        for n in sizes:
            wrong = n - -(-n * 4 // 5)
            for sub in itertools.combinations(range(n), wrong):
                assert any(all(o + i not in sub for i, c in enumerate(m) if c == "1") for m in masks for o in range(n - len(m) + 1)), (n, sub)


def plain(text, item):
    a, b = (dc.WORD.findall(x.encode().lower()) for x in (text, item))
    size = min(dc.WINDOW, len(b))
    if len(b) < dc.LEAST:
        return False
    return any(sum(x == y for x, y in zip(a[i : i + size], b[j : j + size])) >= dc.SHARE * size and len(a[i : i + size]) == size for i in range(len(a)) for j in range(len(b) - size + 1))


def test_equals_brute_force(spark):
    g = random.Random(2)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [" ".join(g.choices(vocabulary, k=g.choice([3, 6, 9, 15, 25, 40]))) for _ in range(12)] + ["", None]
    docs = []
    for k in range(60):
        words = g.choices(vocabulary, k=g.randint(0, 40))
        item = g.choice(items[:12]).split()
        words[5:5] = [w if g.random() > 0.15 else "zzz" for w in item]
        docs.append((k, " ".join(words)))
    docs.append((99, None))
    found = dc.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), size=40)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {(i, j) for i, t in docs for j, b in enumerate(items) if plain(t or "", b or "")} and got


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three one two three"), (1, "one two three one two three"), (2, None)], "item_id long, text string")
    assert {r["doc_id"] for r in dc.contaminations(odd, items).collect()} == {9}
    clean = dc.clean_documents(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 1
    assert dc.contaminations(none, items).count() == 0 and dc.contaminations(odd, items.limit(0)).count() == 0
    assert dc.clean_documents(odd, items.limit(0)).count() == odd.count()
