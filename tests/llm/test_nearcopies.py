import random

import pytest

import corpus_pipeline
from hopgauge.llm import nearcopies


def test_stage_drops_edited_copies(spark):
    """Copies with edited words go, whatever their ids; texts that overlap by less than 0.8 and unlike ones stay."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, edited, less = [], set(), set()
    for k in range(60):
        words = fresh(300)
        rows.append((k, " ".join(words)))
        copy = list(words)
        for at in (50, 150, 250):  # 15 of 296 shingles differ
            copy[at] = "edit"
        rows.append((100 + k, " ".join(copy)))
        edited.add(100 + k)
        rows.append((200 + k, " ".join(words[:200] + fresh(100))))
        less.add(200 + k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert not left & edited and less <= left and set(range(60)) <= left


def test_large_groups_equal_sets_and_missing_values(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "ROWS", 16)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[:k] + ["x"] + words[k + 1 :])) for k in range(1, 120)] + [(500, None), (501, " "), (None, "a b"), (None, "a b"), (600, "a b"), (700, "q r"), (700, "q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(r.doc_id or -1 for r in nearcopies.drop_near_copies(docs).collect())
    assert left == [-1, -1, 1, 500, 600, 700]
    assert nearcopies.near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("most", "weight"), [(1 << 15, 1 << 22), (8, 1 << 22), (1 << 15, 500), (8, 500)])
def test_no_candidate_is_left_out(spark, monkeypatch, most, weight):
    """Many rows that are nearer by bits than the one true copy, also at anchors and in groups that are divided."""
    monkeypatch.setattr(nearcopies, "MOST", most)
    monkeypatch.setattr(nearcopies, "WEIGHT", weight)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        text = list(words)
        for at in rng.sample(range(0, 120, 6), 4):  # about 20 of 116 shingles differ: some pairs overlap by 0.8, some by less
            text[at] = f"x{k}_{at}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, similarity=0.7).collect()}
    sets = {k: set(nearcopies.shingles(t).tolist()) for k, t in rows}
    label = dict.fromkeys(sets)
    for k in sets:
        label[k] = k
    for _ in range(40):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label
