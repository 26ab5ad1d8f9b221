import random

import pytest

from hopgauge.llm import substring
from hopgauge.llm.substring import LAST


def brute(rows, window):
    """n_removed and kept words by position of the row."""
    words = [(t or "").encode().split() for _, t in rows]
    d = [LAST if i is None else i for i, _ in rows]
    early = {}
    for i, w in enumerate(words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            early[key] = min(d[i], early.get(key, LAST))
    out = []
    for i, w in enumerate(words):
        gone = {k + j for k in range(len(w) - window + 1) if early[tuple(w[k : k + window])] < d[i] for j in range(window)}
        out.append((rows[i][0], len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def check(spark, rows, window, phrase):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, gone string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df, window, phrase).collect()), key=str)
    assert got == brute(rows, window)
    return sum(r[2] for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_spliced_texts(spark, seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    shared = [fresh(n) for n in (12, 15, 20, 30)]
    rows = []
    for k in range(120):
        text = fresh(rng.randrange(25))
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) - 5)
            text += s[a : a + rng.randrange(5, 30)] + fresh(rng.randrange(6))
        if rows and rng.random() < 0.2:
            text = rng.choice(rows)[1].split()
            if text and rng.random() < 0.5:
                text[rng.randrange(len(text))] = "edit"
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(text)))
    rng.shuffle(rows)
    assert check(spark, rows, 10, 3) > 200


@pytest.mark.parametrize("patterns", [1 << 15, 20])
def test_repeating_words_and_shards(spark, monkeypatch, patterns):
    """Phrases of many passages are dealt over shards, their recurring windows over blocks."""
    monkeypatch.setattr(substring, "SHARD", 3)
    monkeypatch.setattr(substring, "PATTERNS", patterns)
    rows = [(k, " ".join(["a"] * (8 + k % 5) + [f"x{k}"] + ["a", "b"] * 6)) for k in range(40)]
    rows += [(100 + k, " ".join([f"y{k // 2}", "p", "q", "r"] + [f"z{k // 2}_{j}" for j in range(9)])) for k in range(40)]
    assert check(spark, rows, 10, 3) > 100


def test_located_runs():
    a, b = " ".join("abcdefgh"), " ".join("xbcdefgy")
    assert list(substring.locate_all([(1, 1, 5, a)], 3)) == [(0, 0, 8, 1)]  # a copied passage as a whole
    assert list(substring.locate_all([(1, 1, 1, a)], 3)) == []
    assert list(substring.locate_all([(2, 1, 1, a), (2, 4, 4, b)], 3)) == [(0, 1, 7, 1), (1, 1, 7, 1)]
    assert list(substring.locate([(3, "b c d e"), (2, "c d e")], ["a b c d e", "q"], 3)) == [(0, 1, 4, 3), (0, 2, 5, 2)]


def test_long_text_and_largest_id(spark):
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(120_000))
    rows = [(LAST, "m " + long[:900]), (1, long), (2, "x " + long + " y"), (None, long[:700])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].kept) == (0, 120_000, "x y")
    assert set(got) == {1, 2, LAST, None} and got[None].n_words - got[None].n_removed <= 1 and got[LAST].kept.startswith("m ") or got[LAST].kept == "m"


def test_passages_repeated_within_their_earliest_document(spark):
    """Document 1 holds a line amid other text; document 2 repeats it, so its passages have other ends and recur within 2."""
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    line, section, half = words("l", 60), words("s", 30), words("t", 70)
    rows = [(1, " ".join(words("a", 40) + line + words("b", 40))), (2, " ".join(line * 20))]
    assert check(spark, rows, 50, 8) == 1200
    rows = [(1, " ".join(words("a", 40) + half + words("b", 40))), (2, " ".join((section + half) * 2 + words("c", 5)))]
    assert check(spark, rows, 50, 8) == 140
    # the same in other rows of one doc_id and in documents without an id
    rows = [(1, " ".join(words("a", 40) + half + words("b", 40)))] + [(i, " ".join(section + half + words(f"c{k}x", 9))) for i in (2, None) for k in range(3)]
    assert check(spark, rows, 50, 8) > 420


def test_cases(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "z a b c d e"), (None, "a b c d e"), (None, "a b c d e"), (7, None), (8, ""), (9, "a b"), (3, "q a b c d e f")]
    assert check(spark, rows, 4, 2) > 0
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    got, want = substring.query(spark, "/root/testdata/sf0.001").toPandas(), con.execute(substring.ORACLE).df()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(want[got.columns].sort_values("doc_id").reset_index(drop=True))


def test_more_different_words_than_there_are_characters(spark):
    """Two copies of 2.4 million different words: an automaton takes a bounded number of words."""
    text = " ".join(f"{k:x}" for k in range(2_400_000))
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame([(1, text), (2, "a " + text)], "doc_id long, text string")).select("doc_id", "n_words", "n_removed").collect()}
    assert (got[1].n_words, got[1].n_removed, got[2].n_words, got[2].n_removed) == (2_400_000, 0, 2_400_001, 2_400_000)


def test_crowded_phrases_are_divided(spark, monkeypatch):
    """Near copies of one text: a crowded phrase's passages make a few parts each, not a row for each of their windows; where parts are crowded, windows are told apart."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(160)]
    rows = []
    for k in range(150):
        text = list(base)
        for _ in range(2):
            text[rng.randrange(len(text))] = f"e{k if k % 3 else k // 10}"
        rows.append((k, " ".join(text)))
    made = {}
    monkeypatch.setattr(substring, "written", lambda df, name, real=substring.written: made.setdefault(name, []).append(real(df, name)) or made[name][-1])
    for shard, steps in ((40, 1), (2, 2)):
        made.clear()
        monkeypatch.setattr(substring, "SHARD", shard)
        assert check(spark, rows, 50, 8) > 150 * 100
        parts = made["parts"]
        assert len(parts) == steps
        first = parts[0].count()
        windows = parts[0].select("of_phrase", "of_passage", "at", "words").rdd.map(lambda r: r.words.count(" ") - 48).sum()
        assert 3 * first < windows
        if steps == 2:
            assert parts[1].select("words").rdd.map(lambda r: r.words.count(" ")).distinct().collect() == [49]
