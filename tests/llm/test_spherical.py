import numpy as np
import pytest

from hopgauge.llm import spherical


def brute(x, cosine=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    a, b = np.nonzero(near)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            return near, label
        label = new


def clustered(n, dim, seed):
    """Random vectors, pairs just over and under the cosine of 0.9, and a dense cluster."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n // 2, 2):
        u = x[k] / np.linalg.norm(x[k])
        y = rng.normal(size=dim)
        y -= (y @ u) * u
        c = 0.905 if k % 4 else 0.895
        x[k + 1] = c * u + np.sqrt(1 - c * c) * y / np.linalg.norm(y)
    x[-60:] = x[-1] + rng.normal(size=(60, dim)) * 0.02 * np.linalg.norm(x[-1]) / np.sqrt(dim)
    return x


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in rows], "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("block", [16, 1024])
def test_recall_and_no_false_links(spark, monkeypatch, block):
    monkeypatch.setattr(spherical, "BLOCK", block)
    x = clustered(1500, 64, 1)
    near, label = brute(x)
    got = {r.vec_id: r for r in spherical.near_vectors(frame(spark, enumerate(x)), crowd=16).collect()}
    links = np.array([got[k].n_links for k in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.98 * near.sum()
    assert all(got[k].component_id >= label[k] and got[k].kept == (got[k].component_id == k) for k in got)
    assert np.mean([got[k].component_id == label[k] for k in got]) > 0.98
    assert links[-60:].min() == 59


@pytest.mark.parametrize("size, z", [(5, 1.0), (40, 2.5)])
def test_list_decoding_equals_trying_each_direction(size, z):
    code = spherical.Code(24, size, z)
    for seed in range(20):
        v = np.random.default_rng(seed).normal(size=24)
        v /= np.linalg.norm(v)
        sums = np.add.outer(code.words[0] @ v[:12], code.words[1] @ v[12:]).ravel()
        level = z
        while (sums >= level * code.unit).sum() < min(spherical.LEAST, size * size):
            level -= spherical.STEP
        assert code.decode(v).tolist() == np.flatnonzero(sums >= level * code.unit).tolist()


def test_first_common_direction():
    lists = [np.array([1, 5, 9]), np.array([5, 7]), np.array([2]), np.array([9, 2])]
    want = [[bool(set(a.tolist()) & set(b.tolist())) for b in lists] for a in lists]
    for columns in (1, 2, 4096):
        got = spherical.met_before(lists, columns)
        assert all(got[i, j] == want[i][j] for i in range(4) for j in range(4) if i != j)


def test_cases(spark):
    v = np.random.default_rng(1).normal(size=16)
    rows = [(1, v), (2, v), (5, 2 * v), (3, None), (4, []), (6, [0.0] * 16), (7, [None, *v[1:]]), (8, [float("nan"), *v[1:]]), (9, [float("inf"), *v[1:]]), (10, v[:8]), (None, v), (11, 1e200 * v), (12, 1e-200 * v), (2, v)]
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in spherical.near_vectors(frame(spark, rows)).collect())
    alone = [(k, 0, k, True) for k in (3, 4, 6, 7, 8, 9, 10)]
    assert got == sorted([(0, 0, 0, True), (1, 5, 1, True), (2, 5, 1, False), (2, 5, 1, False), (5, 5, 1, False), (11, 5, 1, False), (12, 5, 1, False), *alone])
    assert spherical.near_vectors(frame(spark, [])).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    got, want = spherical.query(spark, "/root/testdata/sf0.001").toPandas(), con.execute(spherical.ORACLE).df()
    assert got.sort_values("vec_id").reset_index(drop=True).equals(want[got.columns].sort_values("vec_id").reset_index(drop=True))
