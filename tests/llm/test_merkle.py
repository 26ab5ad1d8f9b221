import hashlib
import random
import zlib

import duckdb
import pytest

from hopgauge.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows in the table's columns, by plain lists."""

    def leaf(values):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(leaves):
        """The last hash, and for each leaf its levels of (before, after)."""
        ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
        while len(level) > 1:
            for k in range(len(leaves)):
                run = level[at[k] // 8 * 8 : at[k] // 8 * 8 + 8]
                ways[k].append(("".join(run[: at[k] % 8]), "".join(run[at[k] % 8 + 1 :])))
                at[k] //= 8
            level = [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        return level[0], ways

    langs = {}
    for d, source, lang, n, text in rows:
        low = text
        if text is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        langs.setdefault(lang, []).append((d, leaf((d, source, lang, n, text)), leaf((d, source, lang, n, low))))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        langs[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [climb([x[1] for x in langs[lang]]) for lang in order]
    root, upper = climb([t[0] for t in trees]) if trees else (None, [])
    out = []
    for lang, (subroot, ways), up in zip(order, trees, upper, strict=True):
        for (d, leaf_, fold), way in zip(langs[lang], ways, strict=True):
            for a, b in way + up:
                fold = h(a + fold + b)
            out.append((d, leaf_, subroot, root, h("".join(a + b for a, b in way + up)), fold, fold == root))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def check(spark, rows):
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(merkle.ORACLE).fetchall(), key=key) == sorted(got, key=key)


def test_nulls_repeats_odd_ids_and_many_langs(spark):
    rng = random.Random(3)
    rows = [(d, None, lang, None, text) for d in (None, 5, -1, -64, 2**62, -(2**63), 2**63 - 1, 0, 63, 64) for lang in (None, "") for text in ("A b", None, "")]
    rows += [(7, "s", "en", 3, "same Text")] * 30 + [(8, "s", "en", 3, f"Other {k}") for k in range(20)] + [(None, "s", "en", k, "x") for k in range(15)]
    rows += [(d, "s", "é" if d % 2 else "z", d, "Ünï" + "X" * (d % 5)) for d in rng.sample(range(10**9), 90)]
    rows += [(k, "s", f"lang{k}", 1, "T") for k in range(70)]
    rng.shuffle(rows)
    check(spark, rows)


def test_one_lang_and_one_row(spark):
    check(spark, [(1, "s", "en", 1, "A")])
    check(spark, [(k, "s", "en", k, "Ab") for k in range(65)])


def test_copies_are_cut_at_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 3)
    check(spark, [(1, "s", "en", 1, "A")] * 3 + [(2, "s", "en", 1, "B")] * 50 + [(3, "s", "en", 1, "c")] * 2)


def test_empty_table_long_text_and_own_tampering(spark):
    empty = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.dtypes == [("doc_id", "bigint"), ("leaf", "string"), ("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean")]
    docs = spark.createDataFrame([(k, "s", "en", k, "Word " * (200_000 if k == 3 else 2)) for k in range(20)], SCHEMA).selectExpr("*", "1 AS key", "2 AS slot", "text AS leaf", "3 AS n")
    from pyspark.sql import functions as F

    got = {r.doc_id: r.verified for r in merkle.manifest(docs, F.col("doc_id").isin(3, 5)).collect()}
    assert got == {k: k not in (3, 5) for k in range(20)}


@pytest.mark.parametrize("sf", ["0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, merkle.query(spark, folder).collect())) == sorted(plain(rows))
