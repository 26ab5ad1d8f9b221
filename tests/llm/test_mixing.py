import random

import numpy as np
import pytest

from hopgauge.llm import mixing


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    words = {"a": ["red", "green", "blue", "black", "white"], "b": ["uno", "dos", "tres", "cuatro", "cinco"], "c": ["Haus", "Baum", "Hof", "Tor", "Dach"]}
    rows = [(k, " ".join(rng.choice(words[d]) for _ in range(rng.randrange(3, 80))), d) for k in range(n) for d in [rng.choice("aaaabbc")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    return rows, docs, docs.where("doc_id % 3 = 0").select("doc_id", "domain")


def test_classifier_and_fit(spark):
    rows, docs, labelled = corpus(spark)
    weights = {"a": 0.2, "b": 0.5, "c": 0.3}
    rated, model, fit = mixing.mix(docs, labelled, weights)
    got = {r.doc_id: r for r in rated.collect()}
    assert model.domains == ["a", "b", "c"] and len(got) == len(rows)
    assert np.mean([model.domains[int(np.argmax(got[k].posteriors))] == d for k, _, d in rows]) > 0.99
    assert all(r.rate >= 0 and abs(sum(r.posteriors) - 1) < 1e-9 for r in got.values())
    totals = sum(np.array(r.posteriors) * r.rate * r.n_tokens for r in got.values())
    assert totals / totals.sum() == pytest.approx([0.2, 0.5, 0.3], abs=1e-3)
    assert totals.sum() == pytest.approx(sum(r.n_tokens for r in got.values()), rel=1e-3)


def plain_fit(n, p, goal, least, pull, rounds=200_000):
    """Accelerated projected gradient on the same objective, one row after the other in memory."""
    w = n / n.sum()
    step = 1 / (np.linalg.eigvalsh((p * w[:, None]).T @ p)[-1] + pull)
    r = y = np.full(len(n), max(1.0, least))
    t = 1.0
    for _ in range(rounds):
        g = p @ ((w * y) @ p - goal) + pull * (y - 1)
        new = np.maximum(least, y - step * g)
        if ((y - new) * (new - r)).sum() > 0:
            t = 1.0  # restart
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, r, t = new + (t - 1) / after * (new - r), new, after
    return (w * r) @ p


CASES = {
    "skewed": ([5, 3, 1], [0.05, 0.05, 0.9], 1.0, 0.0),
    "zero target": ([1, 1, 1], [0.5, 0.5, 0.0], 1.0, 0.0),
    "two zero targets": ([1, 1, 1], [1.0, 0.0, 0.0], 0.8, 0.0),
    "least 1": ([2, 1, 1], [0.7, 0.2, 0.1], 1.5, 1.0),
    "least 1, out of reach": ([2, 1, 1], [0.05, 0.05, 0.9], 1.0, 1.0),
    "within reach": ([0.3, 0.3, 0.3], [0.7, 0.2, 0.1], 1.5, 0.0),
}


@pytest.mark.parametrize("case", CASES)
def test_fit_equals_plain_projected_least_squares(spark, case):
    alpha, target, budget, least = CASES[case]
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet(alpha, 300), rng.integers(1, 100, 300)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posteriors array<double>")
    fit = mixing.fit_rates(members, np.array(target), budget=budget, least=least)
    rates = fit.of(p)
    share = (n * rates) @ p / n.sum()
    assert fit.converged and (rates >= least).all() and share == pytest.approx(fit.fitted, abs=1e-9)
    want = plain_fit(n, p, budget * np.array(target), least, 1e-8, 20_000)
    assert share == pytest.approx(want, abs=1e-3)
    lost = lambda s: ((s - budget * np.array(target)) ** 2).sum()
    assert lost(share) <= lost(want) + 1e-6
    if case == "within reach":
        assert share == pytest.approx(budget * np.array(target), abs=1e-4)
    if case in ("zero target", "two zero targets", "least 1", "least 1, out of reach"):
        assert (rates == least).sum() > 10  # the bound holds some rates


def test_skewed_target_of_overlapping_domains_is_reached(spark):
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet([1, 1, 1], 2000), rng.integers(1, 100, 2000)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posteriors array<double>")
    fit = mixing.fit_rates(members, np.array([0.05, 0.05, 0.9]))
    assert fit.converged and fit.fitted == pytest.approx([0.05, 0.05, 0.9], abs=1e-4)


def test_batched_posteriors_equal_single_ones(spark):
    _, docs, labelled = corpus(spark)
    model = mixing.fit_classifier(docs, labelled)
    texts = [mixing._split(t) for t in ("red uno", "", "Haus!! %%% " * 70, "unseen", "x")]
    got = mixing.Remembering(model).posteriors(texts)
    assert np.allclose(got, [model.posterior(w) for w in texts], atol=1e-5)


def test_resample_follows_rates(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text", "id AS rate", "id AS _copy")
    rated = docs.selectExpr("doc_id", "CASE WHEN doc_id < 2000 THEN 1.3D ELSE 2D END AS rate")
    out = mixing.resample(docs, rated)
    assert out.columns == docs.columns
    n = out.groupBy("doc_id").count().collect()
    low = [r["count"] for r in n if r.doc_id < 2000]
    assert len(n) == 4000 and set(low) == {1, 2} and abs(np.mean(low) - 1.3) < 0.05
    assert {r["count"] for r in n if r.doc_id >= 2000} == {2}


def test_cases(spark):
    rows = [(1, "a b", "x"), (2, None, "y"), (2, "", "y"), (None, "a", None), (3, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    labelled = spark.createDataFrame([(1, "p"), (3, "q"), (3, "r"), (9, "s"), (1, None), (None, "t")], "doc_id long, domain string")
    rated, model, _ = mixing.mix(docs, labelled)
    got = rated.collect()
    assert model.domains == ["p", "q"] and sorted(r.n_tokens for r in got) == [0, 0, 1, 1, 2] and all(r.rate == 1 for r in got if not r.n_tokens)
    assert mixing.mix(docs, labelled.limit(0))[1].domains == ["all"]
    assert mixing.mix(docs.limit(0), labelled)[0].count() == 0
    assert sorted(r.doc_id or 0 for r in mixing.resample(docs, spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 0.0)], "doc_id long, rate double")).collect()) == [0, 1, 1, 2, 2]


def test_clashing_names_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 5, 6, 7.0, 8, 9), (2, "long " * 200_000, None, 5, 6, 7.0, 8, 9), (None, "c", "de", 5, 6, 7.0, 8, 9)], "doc_id long, text string, lang string, quality int, _copies int, rate double, _of int, label int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, lang int")
    rated, model, fit = mixing.mix(docs, mixing.quality_domains(docs, labels), budget=None, least=1.0)
    assert model.domains == ["?/poor", "en/good"] and {r.n_tokens for r in rated.collect()} == {1, 2, 200_000}
    out = mixing.resample(docs, rated)
    assert out.columns == docs.columns and out.count() >= 3
    told = {r.domain: r for r in mixing.report(spark, model, fit).collect()}
    assert set(told) == set(model.domains) and all(abs(r.reached - r.target - r.residual) < 1e-12 for r in told.values())
    with pytest.raises(ValueError):
        mixing.mix(docs, mixing.quality_domains(docs, labels), {"en/good": -1.0})


def test_query_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = mixing.query(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert len(got) == 1000 and np.mean([r.domain[:2] == r.lang for r in got]) > 0.97 and all(r.rate >= 0 for r in got)
    assert all(r.converged for r in got) and sum(r.rate == 0 for r in got) > 10  # rates at the bound
    assert all(abs(r.domain_reached - r.domain_target) < 0.01 for r in got)
