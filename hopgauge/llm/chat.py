"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are merged into one block by array
functions, and the blocks are joined to one string:

    <|im_start|>ROLE<|im_sep|>TEXT[<|im_sep|>TEXT ...]<|im_end|> ...

A merged block keeps the limits of its turns as further ``<|im_sep|>``, so the turns can be read back one by one. Control
strings start with ``<|``; inside texts and roles ``<|`` is written as ``<\\|`` and ``<\\`` as ``<\\\\``, which one regular
expression reverts.

Defined results: null texts and null roles are empty strings; rows with a null conv_id form one conversation; turns with a null
number come first; rows of the same turn number are ordered by role, then text, and repeated rows are kept; columns other than
conv_id, turn, role and text are ignored; an empty table gives an empty table. A conversation is one training sample and hence
one row: its turns meet in one task by the format's definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgauge.llm.common import let, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\([\\|])", "<$1")


def format_conversations(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted string (the segments' texts in a row), one row a conversation.

    loss marks the segments that a model is trained on: the escaped text of each turn of loss_roles, nothing else.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turns(turns: Column) -> Column:
        def of_turn(t: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(turns, i - 1)["role"])
            head = F.when(before.isNull(), F.concat(F.lit(START), escape(t["role"]))).when(before != t["role"], F.concat(F.lit(END + START), escape(t["role"]))).otherwise("")
            return F.array(segment(F.concat(head, F.lit(SEP)), F.lit(False)), segment(escape(t["text"]), t["role"].isin(*loss_roles)))

        return F.concat(F.flatten(F.transform(turns, of_turn)), F.array(segment(F.lit(END), F.lit(False))))

    out = turns.select("conv_id", let(F.col("turns"), of_turns).alias("segments"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    def rest(parts: Column) -> Column:
        return F.slice(parts, F.lit(2), F.size(parts) - 1)

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, F.lit(1), F.length(block) - len(END)), r"<\|im_sep\|>", -1)
        return let(parts, lambda p: F.transform(rest(p), lambda x: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(x).alias("text"))))

    return F.flatten(F.transform(let(F.split(formatted, r"<\|im_start\|>", -1), rest), turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    out = format_conversations(rows).select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(replace(replace(text, '<\', '<\\'), '<|', '<\|')) AS text_chars,
    length(replace(replace(role, '<\', '<\\'), '<|', '<\|')) AS role_chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(10 + text_chars + CASE WHEN before IS NULL OR before <> role THEN 12 + 10 + role_chars ELSE 0 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
