from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

from cairnlight.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_query_equals_its_sql(spark, sf):
    compare(spark, chat.op2_chat_format, chat.ORACLE_SQL, sf)


def back(df):
    out = chat.formatted(df).select("conv_id", chat.turns_of(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l"))
    return {r["conv_id"]: ([(x["role"], x["text"]) for x in r["t"]], r["l"]) for r in out.collect()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.text(alphabet=r"\#/<>turne:hxc ###\n", max_size=25), min_size=1, max_size=6), min_size=1, max_size=12))
def test_any_text_round_trips(spark, convs):
    rows = [(c, k, ("user", "assistant")[k * k % 3 % 2], t, "x") for c, texts in enumerate(convs) for k, t in enumerate(texts)]
    expected = {}
    for c, _, role, t, _ in rows:
        turns, loss = expected.get(c, ([], ""))
        expected[c] = (turns + [(role, t)], loss + (t if role == "assistant" else ""))
    assert back(spark.createDataFrame(rows, SCHEMA)) == expected


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None, None), (1, 0, "user", None, None), (1, None, None, "first", None), (1, 1, "a:b\\c###", "x</turn>", None), (None, 0, "assistant", "y", None)]
    got = back(spark.createDataFrame(rows, SCHEMA))
    assert got[1][0] == [("", "first"), ("user", ""), ("user", ""), ("a:b\\c###", "x</turn>")]
    assert got[None] == ([("assistant", "y")], "y")
    assert back(spark.createDataFrame([], SCHEMA)) == {}


def test_same_roles_merge(spark):
    rows = [(1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (1, 2, "assistant", "c", "")]
    assert chat.formatted(spark.createDataFrame(rows, SCHEMA)).first()["formatted"] == "### user: a<next>b</turn>### assistant: c</turn>"
