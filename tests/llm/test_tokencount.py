import random

import pytest

from hopgauge.llm import tokencount as tc


@pytest.fixture(scope="module")
def machine():
    return tc.transducer(tc.default_tokenizer())


@pytest.fixture(scope="module")
def want():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tc.default_tokenizer())
    return lambda texts: [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]


ODD = ["", "a", " ", "  ", "\n", " \n x", "a'b's 'll <|endoftext|>x< |endof", "<|endoftext|><|endoftext|>", "a <|endoftext", "x  <|endoftext|>  y", "<<|endoftext|>", "I'm you're they'll 'rx 're 'r 'v '", "''s !'s 's'", "É é ﬁ Σας x²½ 一二三", "\x1ca\x1cb \x85e", "🙂x🙂‍z  🙂", "don't\t\tc\x0bd　　x y", "a" * 3000, "ab1!" * 1000, "  " * 700 + "x", "'" * 400, "x'll'll'rere", "\r\n\r\n \r\n  a", "<|endoftext|" * 300]


def test_odd_texts(machine, want):
    assert machine.counts(ODD).tolist() == want(ODD)


@pytest.mark.parametrize("alphabet", [list("aeist'rvlmd  \n\t<|>endoftx!é一1 "), ["<|endoftext|>", " ", "'re", "ing", "  ", "the", "\n"], [chr(c) for c in range(32, 0x3000, 7)]])
def test_random_texts(machine, want, alphabet):
    rng = random.Random(5)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(900))) for _ in range(150)]
    assert machine.counts(texts).tolist() == want(texts)


def test_chunks_compose(machine, want, monkeypatch):
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(tc, "CHUNK", size)
        assert machine.counts(ODD[:16]).tolist() == want(ODD[:16])


def test_small_tables(want, monkeypatch):
    monkeypatch.setattr(tc, "STATES", 50)
    monkeypatch.setattr(tc, "DENSE", 20)
    small = tc.Transducer(tc.default_tokenizer())
    assert small.counts(ODD).tolist() == want(ODD) == small.counts(ODD).tolist()


def test_query_and_cases(spark, want):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in tc.query(spark, "/root/testdata/sf0.001").collect()}
    assert [got[r.doc_id].n_tokens for r in rows] == want([r.text for r in rows])
    assert all(got[r.doc_id].n_bytes == len(r.text.encode()) and got[r.doc_id].over_limit == (got[r.doc_id].n_tokens > 512) for r in rows)
    odd = spark.createDataFrame([(1, None, 0), (None, "a b", 0), (1, "", 0), (1, None, 0)], "doc_id long, text string, n_tokens int")
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tc.token_counts(odd).collect()) == [(0, 3, 2), (1, 0, 0), (1, 0, 0), (1, 0, 0)]
    assert tc.token_counts(odd.limit(0)).count() == 0
