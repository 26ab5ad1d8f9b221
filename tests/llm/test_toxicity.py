import random
import zlib

import numpy as np
import pytest

from hopgauge.llm import toxicity as tx

BAD = ["blorgen", "blorgish", "blorgat", "zuntik", "zuntika"]


def corpus(n=1200, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioukltrs") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    rows = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(BAD) + rng.choice(["", ",", "!!"])
        rows.append((k, " ".join(text), rng.choice(["en", "xx"]), toxic))
    return rows


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    return rows, docs, labels, tx.classify(docs, labels).collect()


def test_held_out_accuracy(scored):
    rows, _, _, got = scored
    label = {r[0]: r[3] for r in rows}
    test = [r for r in got if held(r.doc_id)]
    assert len(test) > 150 and np.mean([(r.score >= 0.5) == label[r.doc_id] for r in test]) > 0.97
    assert np.mean([r.toxic == label[r.doc_id] for r in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_score_depends_on_text_alone_and_not_on_batches(spark, scored):
    rows, docs, labels, _ = scored
    model = tx.train_on(docs, labels)
    one = tx.Scorer(model)
    texts = [r[1] for r in rows[:50]] + ["", None, "!!!", "blorgen " * 5000]
    apart = np.concatenate([one.scores([t]) for t in texts])
    assert np.allclose(apart, tx.Scorer(model).scores(texts), atol=1e-6)


def test_unseen_form_of_a_known_stem(scored, spark):
    _, docs, labels, _ = scored
    score = tx.Scorer(tx.train_on(docs, labels)).scores(["kil ates blorgodu, lira", "kil ates, lira"])
    assert score[0] > 0.5 > score[1]


def test_training_learns_from_random_numbers_and_not_by_chance(spark):
    """What is held out is known after training, and not before it."""
    rows = corpus()
    documents = [np.array([tx.rows_of(w) for w in tx._words(r[1])], np.int32).reshape(-1, 2) for r in rows]
    labels = np.array([r[3] for r in rows], np.float32)
    texts, real = [r[1] for r in rows[900:]], labels[900:]
    for sharpness, least, most in ((tx.SHARPNESS, 0.9, 1.0), ((), 0.0, 0.3)):
        tx.SHARPNESS, before = sharpness, tx.SHARPNESS
        try:
            model = tx.train(documents[:900], labels[:900])
        finally:
            tx.SHARPNESS = before
        recall = np.mean(tx.Scorer(model).scores(texts)[real > 0] >= 0.5)
        assert least <= recall <= most


def test_slices_of_long_texts_give_the_same_score(monkeypatch):
    rng = np.random.default_rng(8)
    model = tx.Model(rng.normal(size=(tx.ROWS, tx.DIM)).astype(np.float32), rng.normal(size=(tx.DIM, sum(tx.WIDTHS), tx.FILTERS)).astype(np.float32), np.zeros(24), rng.normal(size=24), 0.1)
    model.embeddings[0] = 0
    text = " ".join(f"w{k}" for k in rng.integers(0, 900, 3000)) + "\n end"
    whole = tx.Scorer(model)
    want = whole.pooled([tx._words(text)])
    for long, size in ((1000, 100), (37, 7), (10**6, 2999)):
        monkeypatch.setattr(tx, "LONG", long)
        monkeypatch.setattr(tx, "SLICE", size)
        parts = [whole.pooled([words], [counted]) for words, counted in tx.slices(text)]
        assert np.allclose(np.max(parts, axis=0), want) and sum(c for _, c in tx.slices(text)) == 3001
        assert whole.long_score(text) == pytest.approx(whole.scores([text]))


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(tx, "LONGEST", 50)
    monkeypatch.setattr(tx, "CHARACTERS", 300)
    docs = spark.createDataFrame([(k, "a" * (k % 80)) for k in range(200)] + [(7, "abc")] * 50 + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = tx.sampled(docs, labels, 60).collect()
    assert 0 < len(got) == len({r.doc_id for r in got}) and sum(r.doc_id % 80 for r in got) <= 300


def test_convolution_equals_plain_version():
    rng = np.random.default_rng(3)
    model = tx.Model(rng.normal(size=(tx.ROWS, tx.DIM)).astype(np.float32), rng.normal(size=(tx.DIM, sum(tx.WIDTHS), tx.FILTERS)).astype(np.float32), rng.normal(size=tx.FILTERS * len(tx.WIDTHS)), rng.normal(size=tx.FILTERS * len(tx.WIDTHS)), 0.1)
    text = "a bc def ghij a klm"
    v = np.array([model.embeddings[list(tx.rows_of(w))].sum(0) for w in text.encode().split()] + [np.zeros(tx.DIM)] * 2)
    pooled, k = [], 0
    for width in tx.WIDTHS:
        pooled.append(np.max([sum(v[i + j] @ model.kernels[:, k + j] for j in range(width)) for i in range(len(v) - 2)], axis=0))
        k += width
    want = 1 / (1 + np.exp(-(np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.weights + model.offset)))
    assert tx.Scorer(model).scores([text, "zz"])[0] == pytest.approx(want, abs=1e-5)


def test_drop_toxic_and_cases(spark, scored):
    rows, docs, labels, _ = scored
    odd = docs.selectExpr("doc_id", "text", "lang", "doc_id AS _score", "text AS toxic").unionByName(
        spark.createDataFrame([(None, None, None, None, None), (5000, "", "en", 1, "x"), (5000, "", "en", 1, "x")], "doc_id long, text string, lang string, _score long, toxic string")
    )
    kept = tx.drop_toxic(odd, labels)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    label = {r[0]: r[3] for r in rows}
    assert ids.count(5000) == 2 and ids.count(None) == 1
    assert np.mean([label[i] for i in ids if i in label]) < 0.01 and sum(label[i] == 0 for i in ids if i in label) > 0.98 * sum(1 - v for v in label.values())
    assert tx.classify(docs.limit(0), labels).count() == 0
    none = {r.score for r in tx.classify(docs.limit(5), labels.limit(0)).collect()}
    assert all(s < 1e-5 for s in none)


def test_query_on_the_tables(spark):
    got = tx.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in got)
