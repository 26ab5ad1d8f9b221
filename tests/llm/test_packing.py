import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopgauge.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1, max_size=20))
def test_plan_places_every_rank_once_without_gaps(counts):
    plan = packing.plan(counts, 64)
    rows = []
    for length, n in counts.items():
        mine = plan[plan[:, 0] == length]
        assert mine[0, 1] == 0
        at = np.searchsorted(mine[:, 1], np.arange(n), "right") - 1
        rows += [(int(mine[a, 2] + k - mine[a, 1]), int(mine[a, 3]), length) for k, a in enumerate(at)]
    used = packing.check_plan(rows, 64)
    assert used == best_fit(counts, 64)


def best_fit(counts, capacity):
    """Best-fit decreasing, item by item."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(best := min(fits))
                rooms.append(best - length)
            else:
                rooms.append(capacity - length)
    return len(rooms)


def test_plan_size_does_not_grow_with_counts():
    counts = {k: 1000 + 7 * k for k in range(1, 2049)}
    assert abs(len(packing.plan({k: 1000 * n for k, n in counts.items()}, 2048)) - len(packing.plan(counts, 2048))) < len(packing.plan(counts, 2048))


ODD = ["a'b's 'll <|endoftext|>x< |endof", "É é ﬁ Σας ΑΣ x²½ 一二", "\x1ca\x1cb c d \x85e", "ÀÈß's İ I", "a.b,c--d ''s don't\tc\x0bd", "🙂x🙂‍z", "l'é!!a", "", "   ", "Å é", "word " * 3000]


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    encode = packing.Encoder(packing.default_tokenizer())
    for t in texts:
        assert np.frombuffer(encode.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pieces_and_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    texts = [*ODD, None, "same", "same"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "n", "y"), (0, "again", "z")], "doc_id long, text string, length string")
    got = packing.pack_documents(df, capacity=256).collect()
    packing.check_plan([(r.sequence_id, r.offset, r.length) for r in got], 256)
    for doc in range(len(texts)):
        parts = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc)
        if doc == 0:
            continue
        ids = np.array(whole.encode(texts[doc] or "", add_special_tokens=False).ids + [0], "<u4")
        assert parts == [(k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    assert sum(r.doc_id is None for r in got) == 1


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("copies", [5000])
def test_one_hot_length(spark, copies):
    df = spark.range(copies).selectExpr("id AS doc_id", "'' AS text")
    got = packing.pack_documents(df).collect()
    assert packing.check_plan([(r.sequence_id, r.offset, r.length) for r in got], 2048) == -(-copies // 2048)


def test_very_long_text(spark):
    """1.6 million characters are encoded as a whole, as the library does, and cut into full pieces."""
    from tokenizers import Tokenizer

    text = " ".join(f"w{k % 977}x{k % 13}" for k in range(200_000))
    ids = Tokenizer.from_file(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, text), (2, "short"), (None, None)], "doc_id long, text string")
    rows = sorted((r for r in packing.pack_documents(df).collect() if r.doc_id == 1), key=lambda r: r.piece)
    assert sum(r.length for r in rows) == len(ids) + 1 and [r.start for r in rows] == [2048 * k for k in range(len(rows))]
    assert all(r.length == 2048 for r in rows[:-1]) and rows[3].ids_crc32 == zlib.crc32(np.array(ids[3 * 2048 : 4 * 2048], "<u4").tobytes())
