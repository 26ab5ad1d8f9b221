import math
import random
import re
from collections import Counter

import duckdb
import pytest

from hopgauge.llm import lexical

LOW = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring every document."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, c.total()) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        wanted, found = Counter(terms(text)), []
        for d, c, n in counts:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(times * w[t] * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in wanted.items() if t in c)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def check(spark, docs, items, k=20):
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
    got = sorted(map(tuple, got.collect()), key=key)
    assert got == sorted(plain(docs, items, k), key=key)
    return got


def test_terms():
    for text in ("", "A-b c\x00d\x7fe", "Ünï Ü_x y{z}~ 12.5", "ÀÉ" + chr(0x2028) + "x y", "ſK"):
        assert [t.decode() for t in lexical.terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize("seed", range(3))
def test_random_tables(spark, monkeypatch, seed):
    if seed == 1:
        monkeypatch.setattr(lexical, "DEMANDS", 60)  # several blocks of items
    if seed == 2:
        real = lexical.resolved
        monkeypatch.setattr(lexical, "resolved", lambda *a: real(*a[:-1], False))  # too large to be broadcast
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(40)))) for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 25)))) for k in range(12)]
    check(spark, docs, items, k=rng.choice([1, 5, 20]))


def test_many_ties_and_copies(spark):
    docs = [(k, "alpha beta") for k in range(300, 0, -1)] + [(k, "alpha gamma delta") for k in range(400, 430)] + [(500, "beta beta")] + [(k, f"other{k}") for k in range(600, 1200)]
    got = check(spark, docs, [(1, "alpha"), (2, "alpha beta"), (3, "beta gamma"), (4, "nothing here"), (5, "alpha alpha beta")])
    assert [r[2] for r in got if r[0] == 1] == list(range(1, 21))


def test_nulls_repeats_and_empty(spark):
    docs = [(None, "one two"), (None, "one two"), (3, None), (4, ""), (4, "--"), (5, "ONE one One"), (5, "ONE one One"), (6, "é É one"), (7, "nothing"), (8, "else"), (9, "at all")]
    items = [(1, "One! one"), (1, "two"), (None, "é"), (2, None), (3, ""), (4, "absent")]
    check(spark, docs, items)
    check(spark, docs, items, k=1)
    assert check(spark, [], items) == [] and check(spark, docs, []) == [] and check(spark, [(1, None)], items) == []
    assert check(spark, [(k, "same") for k in range(1200)], [(1, "same")]) == []  # the weight is zero


def test_long_texts_extra_columns_and_full_filter(spark, monkeypatch):
    monkeypatch.setattr(lexical, "FILTER", 4)  # nearly every term of a document passes it
    rng = random.Random(2)
    docs = [(k, " ".join(f"t{rng.randrange(3000)}" for _ in range(200_000 if k == 7 else 50))) for k in range(60)]
    items = [(1, " ".join(f"t{k}" for k in range(2500))), (2, "t1 t2 t3")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS term", "1 AS item", "2 AS key", "3 AS lower")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS rank")
    assert sorted(map(tuple, lexical.ranked(frame, asked).collect())) == sorted(plain(docs, items))


def test_rounds_stop_early_and_bounds_hold(spark, monkeypatch):
    """An item whose k best are clear is done before its common term's list is read; the result is the same."""
    docs = [(k, "rare common " + "x " * k) for k in range(30)] + [(k, "common") for k in range(100, 900)] + [(k, "filler") for k in range(1000, 3000)]
    opened = []
    real = lexical.written

    def watched(df, name):
        out = real(df, name)
        opened.append(name)
        return out

    monkeypatch.setattr(lexical, "written", watched)
    check(spark, docs, [(1, "rare")], k=3)
    assert len([n for n in opened if n.startswith("candidates")]) < len(lexical.cuts(lexical.lists(lexical.counted(spark.createDataFrame(docs, "id long, text string"), "x"), spark.createDataFrame([("rare",)], "term string")))) + 1


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = sorted(map(tuple, lexical.query(spark, folder).collect()))
    assert got == sorted(con.execute(lexical.ORACLE).fetchall())
    assert got == sorted(plain([tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()], [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]))
