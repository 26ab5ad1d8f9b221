import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopgauge.llm import chat

TEXT = st.text(alphabet="ab<|\\>im_sependstar\n[/INST]é", max_size=40) | st.sampled_from([chat.START, chat.SEP, chat.END, "<\\|", "<\\\\|im_sep|>", "", "<"])


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    return out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), TEXT), min_size=1, max_size=6), min_size=8, max_size=16))
def test_round_trip(spark, conversations):
    rows = [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    for r in formatted(spark, rows[::-1]).collect():
        assert [tuple(t) for t in r.turns] == conversations[r.conv_id]
        assert r.loss == "".join(text for role, text in conversations[r.conv_id] if role == "assistant")
        blocks = sum(1 for k, t in enumerate(conversations[r.conv_id]) if k == 0 or conversations[r.conv_id][k - 1][0] != t[0])
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == blocks
        assert r.formatted.count(chat.SEP) == len(r.turns)


def test_nulls_ties_and_empty(spark):
    rows = [(None, 1, "user", "x"), (1, None, "user", None), (1, 0, None, "a"), (1, 0, None, "a"), (1, 0, "assistant", "b")]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in formatted(spark, rows).collect()}
    assert got == {None: [("user", "x")], 1: [("user", ""), ("", "a"), ("", "a"), ("assistant", "b")]}
    assert formatted(spark, []).count() == 0


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "y", "z")], "conv_id long, turn long, role string, text string, turns string, segments string")
    assert chat.format_conversations(df).columns == ["conv_id", "segments", "formatted"]


def test_query_over_the_fixed_conversation(spark):
    got = {r.conv_id: r for r in chat.query(spark, "/root/testdata/sf0.001").collect()}[-7]
    text = "</s>[INST] ok [/INST]"
    assert (got.n_turns, got.loss_chars) == (2, len(text))
    assert got.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_very_long_texts(spark):
    """A million characters, and a thousand turns of one conversation."""
    rows = [(1, 0, "user", "<|\\ x" * 200_000), (1, 1, "assistant", "y" * 300_000 + chat.END)] + [(2, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(1000)]
    got = {r.conv_id: r for r in formatted(spark, rows).collect()}
    assert [tuple(t) for t in got[1].turns] == [r[2:] for r in rows[:2]] and got[1].loss == rows[1][3]
    assert [tuple(t) for t in got[2].turns] == [r[2:] for r in rows[2:]]
