import random

from cairnlight.llm import pieces


def texts(odd):
    return [(r["doc_id"], r["text"]) for r in odd.collect()]


def test_same_ids_and_text_as_the_library():
    v = pieces.Vocabulary(pieces.model_path())
    g = random.Random(1)
    some = ["", " ", "  a  b ", "▁▁a ▁", "a</s><0x41>\x00▁b", "日本語" * 100, "x" * 3000, " " * 90, "\r\n\t;\r", "😀 é ﬁ ①", "<s> </s> <unk>"]
    some += ["".join(g.choice("ab ▁\n\r;é日😀{}() ") for _ in range(g.randint(0, 60))) for _ in range(500)]
    for part in (some, some[::-1]):  # the second time from the cache
        got = v.encode(part)
        ids = [[int(i) for e in x if e[0] for i in e[0].split(",")] for x in got]
        assert ids == v.sp.encode(part)
        assert [pieces.decoded([e[2] for e in x]) for x in got] == v.sp.decode(v.sp.encode(part))
    assert v.differ == 0


def test_long_and_short_agendas_agree():
    v = pieces.Vocabulary(pieces.model_path())
    for b in ("▁internationalization", "▁" * 9, "▁aaaaabbbbb", "▁é日😀x"):
        assert v.ids_of(v.one_by_one(b)) == v.together([b])[0]


def test_query_on_odd_rows(odd, none):
    import hashlib

    v = pieces.vocabulary(pieces.model_path())
    rows = pieces.round_trips(odd, pieces.model_path()).collect()
    assert len(rows) == odd.count()
    expected = sorted((str(i), len(ids := v.sp.encode(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t in texts(odd))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in rows) == expected
    assert pieces.round_trips(none, pieces.model_path()).count() == 0


def test_encode_then_decode(odd):
    m = pieces.model_path()
    enc = pieces.encoded(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), m)
    assert enc.agg({"n_differ": "max"}).first()[0] == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decoded_texts(enc, m).collect()}
    assert back == {i: (t or "") for i, t in texts(odd) if i is not None}
    assert {r["doc_id"]: r["text"] for r in pieces.encoded_texts(odd.where("doc_id is not null"), m).collect()} == back
