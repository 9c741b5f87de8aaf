r"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, merged where the role stays the same, and concatenated::

    ### user: first text<next>second text</turn>### assistant: answer</turn>

``###``, ``</turn>`` and ``<next>`` are control strings; ``escaped`` removes them from texts reversibly, so that
``turns_of`` reads exactly the turns that went in. The loss mask is a list of (start, length) over the formatted
text, one for each assistant text, and covers no control string.

Defined results: a null text or role counts as empty; rows of equal turn are ordered by role, then text, and repeated
rows stay; a null turn comes first; rows of a null conv_id form one conversation; an empty table gives no rows; columns
other than conv_id, turn, role and text are ignored. A conversation is one value of one row in the end, so its size is
bounded by what a row can hold (2 GB); that is the only group that is brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

HEAD, NEXT, END = "### ", "<next>", "</turn>"

#: Control string -> what stands for it inside a text. Each begins with one backslash; a text's own are doubled.
ESCAPES = {"###": r"\h", "</turn>": r"\e", "<next>": r"\n"}


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, code in ESCAPES.items():
        out = F.replace(out, F.lit(control), F.lit(code))
    return out


def unescaped(text: Column) -> Column:
    """Between doubled backslashes, a backslash can only begin a code."""

    def codes(part: Column) -> Column:
        for control, code in ESCAPES.items():
            part = F.replace(part, F.lit(code), F.lit(control))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), codes), "\\")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit(r"\c"))


def unescaped_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), lambda p: unescaped_codes(F.replace(p, F.lit(r"\c"), F.lit(":")))), "\\")


def unescaped_codes(part: Column) -> Column:
    for control, code in ESCAPES.items():
        part = F.replace(part, F.lit(code), F.lit(control))
    return part


def formatted(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and length, code points from 0) per conversation."""
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(turns: Column) -> Column:
        """Each turn's control strings and escaped text; a turn of its predecessor's role joins that one's block."""

        def piece(t: Column, i: Column) -> Column:
            before = F.get(turns, i - 1)
            mark = (
                F.when(i == 0, F.concat(F.lit(HEAD), escaped_role(t["role"]), F.lit(": ")))
                .when(before["role"] == t["role"], F.lit(NEXT))
                .otherwise(F.concat(F.lit(END + HEAD), escaped_role(t["role"]), F.lit(": ")))
            )
            return F.struct(mark.alias("mark"), escaped(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss"))

        return F.transform(turns, piece)

    def spans(pieces: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

        def step(acc: Column, p: Column) -> Column:
            begin = acc["at"] + F.length(p["mark"])
            size = F.length(p["text"]).cast("long")
            span = F.struct(begin.alias("start"), size.alias("length"))
            return F.struct((begin + size).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(pieces, start, step, lambda acc: acc["spans"])

    def whole(pieces: Column) -> Column:
        return F.concat(F.array_join(F.transform(pieces, lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(END))

    made = turns.select("conv_id", let(F.col("turns"), lambda t: let(pieces(t), lambda p: F.struct(whole(p).alias("formatted"), spans(p).alias("loss_spans")))).alias("m"))
    return made.select("conv_id", "m.formatted", "m.loss_spans")


def turns_of(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""

    def block(b: Column) -> Column:
        body = F.substr(b, F.lit(len(HEAD) + 1))
        role = F.substring_index(body, ":", 1)
        texts = F.split(F.substr(body, F.length(role) + 3), NEXT, -1)
        return let(unescaped_role(role), lambda r: F.transform(texts, lambda t: F.struct(r.alias("role"), unescaped(t).alias("text"))))

    blocks = F.split(text, END, -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), block))


def loss_text(text: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], table.schema)
    out = formatted(table.unionByName(extra))
    back = out.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(text: str) -> str:
    out = rf"replace({text}, '\', '\\')"
    for control, code in ESCAPES.items():
        out = f"replace({out}, '{control}', '{code}')"
    return out


ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length({_sql_escaped('text')}) + CASE WHEN before = role THEN {len(NEXT)}
    ELSE {len(HEAD) + 2 + len(END)} + length(replace({_sql_escaped('role')}, ':', '\c')) END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

QUERIES = {"op2_chat_format": op2_chat_format}
ORACLES = {"op2_chat_format": ORACLE_SQL}
