import re

from oracle import compare
from pyspark.sql import functions as F

from cairnlight.llm import licenses, quality_rules


def test_rules_equal_their_sql(spark, sf):
    compare(spark, quality_rules.op7_quality_rules, quality_rules.ORACLE_SQL, sf)


def test_rules_on_odd_rows(odd, none):
    rows = quality_rules.judged(odd).collect()
    assert len(rows) == odd.count() and quality_rules.judged(none).count() == 0
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        grams = list(zip(words, words[1:], words[2:]))
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 5000 else set(grams)
        covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
        lines = [x for x in r["text"].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))


def test_order_never_changes_a_verdict(odd):
    rules = quality_rules.RULES
    a = {(r["doc_id"], r["rejected_by"] is None) for r in quality_rules.judged(odd, rules, 1).collect()}
    b = {(r["doc_id"], r["rejected_by"] is None) for r in quality_rules.judged(odd, rules[::-1], 10**6).collect()}
    assert a == b


def test_cheap_and_strict_rules_come_first(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "### !!!" if i % 2 else "plain words here") for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(quality_rules, "costs", lambda sample, rules: {r.name: 9.0 if r.name == "symbols" else 1.0 for r in rules})
    assert quality_rules.ordered(docs, sample_rows=1000)[0].name == "shouting"
    monkeypatch.setattr(quality_rules, "costs", lambda sample, rules: {r.name: 9.0 if r.name == "shouting" else 1.0 for r in rules})
    assert quality_rules.ordered(docs, sample_rows=1000)[0].name == "symbols"


def test_costs_are_measured(spark):
    docs = spark.createDataFrame([(i, "some words of a text, " * 4000) for i in range(60)], "doc_id long, text string")
    sample = quality_rules.features(docs).persist()
    cost = quality_rules.costs(sample)
    sample.unpersist()
    assert set(cost) == {r.name for r in quality_rules.RULES} and min(cost.values()) > 0
    assert cost["abuse"] > cost["word_length"]  # a pattern over 5 MB against two comparisons a row


def test_license_places(spark, odd, none):
    docs = spark.createDataFrame([(20, "MIT license, mit-license; the MIT License"), (21, "GNU General Public License"), (22, "mITKicense cc by CC BY-SA"), (23, "permission is hereby granted free of charge to any person obtaining a copy of this software"), (24, "gnu general license public")], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    rows = licenses.scanned(docs.withColumn("hits", F.lit("clash"))).collect()
    assert len(rows) == docs.count() and licenses.scanned(none).count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        words = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or ""))
        found = {h["label"]: (h["places"], h["first"], h["last"]) for h in r["hits"] or []}
        for t in licenses.TEMPLATES:
            key = list(t.key_words)
            at = [k for k in range(len(words)) if words[k : k + len(key)] == key]
            if t.base:
                assert found.get(t.label) == ((len(at), at[0], at[-1]) if at else None)
    by = {r["doc_id"]: {h["label"] for h in r["hits"] or []} for r in rows}
    assert by[23] == {"mit-grant"} and by[24] == set()


def test_license_query_equals_plain_code(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = licenses.op4_license_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or ""))
        base, labels, every, score = [], set(), set(), 0.0
        for t in licenses.TEMPLATES:
            key, first = list(t.key_words), t.key[0]
            at = [k for k in range(len(words)) if words[k] == key[0] and words[k : k + len(key)] == key]
            if not at:
                continue
            every.add(t.label)
            for k in at:
                stand = sum(0 <= k - first + n < len(words) and words[k - first + n] == w for n, w in enumerate(t.words))
                score = max(score, stand / len(t.words))
            if t.base:
                labels.add(t.label)
                base += at
        assert (r["n_words"], r["n_base"]) == (len(words), len(base))
        assert (r["first_word"], r["last_word"]) == ((min(base), max(base)) if base else (None, None))
        assert (r["base_labels"], r["labels"]) == (",".join(sorted(labels)), ",".join(sorted(every)))
        assert abs(r["score"] - score) < 1e-9
