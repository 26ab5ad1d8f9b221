from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopgauge.llm import simhash
from hopgauge.llm.graph import components


def groups_of(values, bits):
    """Brute force: groups of equal or linked fingerprints, by position."""
    x = np.array(values, np.uint64)
    label = np.arange(len(x))
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= bits)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            return label
        label = new


def parts(labels):
    out = defaultdict(set)
    for k, v in enumerate(labels):
        out[v].add(k)
    return sorted(map(sorted, out.values()))


def test_anchors_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for bit in rng.choice(64, rng.integers(1, 3), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)
    (i, a, home, _), (j, b, _, _) = simhash.anchors(x, 2), simhash.anchors(y, 2)
    assert np.bincount(i, weights=home).tolist() == [1] * len(x)
    replicas = set(zip(j.tolist(), b.tolist()))
    assert all((k, anchor) in replicas for k, anchor in zip(i[home].tolist(), a[home].tolist()))


@pytest.mark.parametrize("most", [3, 2048])
def test_links_in_dense_and_crowded_groups(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    rng, values = np.random.default_rng(2), set()
    for base in rng.integers(0, 2**63, 5).tolist():
        for _ in range(60):
            v = base
            for bit in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                v ^= 1 << bit
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))).collect()}
    assert parts([found.get(v, v) for v in signed]) == parts(groups_of(values, 2))


def test_divided_anchors_cover():
    """Two fingerprints within 2 bits meet at the divided home of either."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for bit in rng.choice(64, rng.integers(1, 3), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)

    def divided(z):
        index, anchor, home, left = simhash.anchors(z, 2)
        i, sub, at_home, _ = simhash.anchors(z[index], 2, simhash.SECOND, left)
        return index[i], anchor[i] << 14 | sub, home[i] & at_home

    (i, a, home), (j, b, _) = divided(x), divided(y)
    assert np.bincount(i, weights=home).tolist() == [1] * len(x)
    replicas = set(zip(j.tolist(), b.tolist()))
    assert all((k, anchor) in replicas for k, anchor in zip(i[home].tolist(), a[home].tolist()))


def test_crowded_anchors_that_follow_each_other_over_batches():
    """Anchor A's last rows come in one batch with the first of B, both crowded; all of A's rows must go to its divisions."""
    values = np.array([a << 40 | 1 << k for a in (1, 2) for k in range(6)], np.int64)
    anchor = np.array([a for a in (1, 2) for _ in range(6)], np.int64)
    n = lambda k: len(values[k : k + 5])
    batches = [pa.RecordBatch.from_arrays([pa.array(anchor[k : k + 5]), pa.array(values[k : k + 5]), pa.array([True] * n(k)), pa.array([2] * n(k), pa.int32())], ["key", "x", "home", "slack"]) for k in (0, 5, 10)]
    got = [r for b in simhash._compare(2, 3, iter(batches)) for r in b.to_pylist()]
    assert {r["a"] for r in got if r["b"] is None} == set(values.tolist())
    assert {(r["a"], r["key"]) for r in got if r["b"] is None} == set(zip(values.tolist(), anchor.tolist()))


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(3, 3), (None, 4), (50, 51), (51, 50), (50, 51)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in range(7, 40)} | {50: 50, 51: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_equal_spark_hashes(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30)
    words = F.array_remove(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), "")
    hashed = rows.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))))).where(F.size(words) >= 3)
    want = defaultdict(list)
    for r in hashed.collect():
        want[r.doc_id].append(r["col"] & (2**64 - 1))
    texts = {r.doc_id: r.text for r in rows.collect()}
    for doc, hashes in want.items():
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(texts[doc]) == bits
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_query_equals_brute_force(spark):
    got = simhash.query(spark, "/root/testdata/sf0.01").collect()
    ids, values = [r.doc_id for r in got], [int(r.fingerprint, 16) for r in got]
    label = groups_of(values, 2)
    least = {}
    for doc, g in zip(ids, label):
        least[g] = min(doc, least.get(g, doc))
    assert all(r.component_id == least[g] for r, g in zip(got, label))


def test_cases(spark):
    df = spark.createDataFrame([(5, None, 1), (3, "", 2), (9, "a b c d", 3), (8, "A B c d", 4), (None, "x", 5), (9, "a b c d", 3)], "doc_id long, text string, fingerprint int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, None), (3, 3), (5, 3), (8, 8), (9, 8), (9, 8)]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_doc_id_and_long_texts(spark):
    """Unlike texts under one doc_id stay, equal ones are one."""
    long = " ".join(f"w{k % 7000}" for k in range(150_000))
    df = spark.createDataFrame([(1, "a b c d e f", 1), (1, "p q r s t u", 2), (1, "p q r s t u", 3), (2, "a b c d e f", 4), (3, long, 5), (4, long, 6)], "doc_id long, text string, _d int")
    kept = simhash.drop_near_duplicates(df).collect()
    assert sorted((r.doc_id, r.text[:3]) for r in kept) == [(1, "a b"), (1, "p q"), (3, "w0 ")]


def test_all_divided_at_once(spark, monkeypatch):
    monkeypatch.setattr(simhash, "REPLICATION", 1 << 40)
    values = [0, 1, 3, 7, 1 << 40, (1 << 40) | (1 << 50), 255 << 20]
    found = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long"))).collect()}
    assert parts([found.get(v, v) for v in values]) == parts(groups_of(values, 2))
