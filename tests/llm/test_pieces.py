import hashlib
import random

import pytest

from hopgauge.llm import pieces as ps


@pytest.fixture(scope="module")
def machine():
    return ps.pieces(ps.default_model())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=ps.default_model())


ODD = ["", " ", "a", "  a  b ", " x\tz\nq", "ｆull ﬁ", "a▁b", "</s> <unk> <s>[INST]<0x0A>", "\x00a", "é é", "▁", "▁▁ x", "\n\n  \n", "🙂x🙂‍z", "͸͹", "一二三 丁丂", " " * 15 + "x", " " * 16, " " * 17 + "the", " " * 100, "�", "\r\n", "the" * 400, "<0x41>"]


def test_odd_texts(machine, library):
    for text in ODD:
        assert machine.encode(text) == library.encode(text), text
        assert machine.decode(machine.encode(text)) == library.decode(library.encode(text)), text


@pytest.mark.parametrize("alphabet", [list("aeinrst h  \n"), list("abc▁ "), ["the", " ", "  ", "ing", "tion", "s", "▁", "\n"], [chr(c) for c in range(32, 0x2600, 5)], [" ", "a", "͸"], list("0123456789.,-= ")])
def test_random_texts(machine, library, alphabet):
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))
        assert machine.encode(text) == library.encode(text), text
        assert machine.decode(machine.encode(text)) == library.decode(library.encode(text)), text


def test_random_pieces_joined(machine, library):
    rng, names = random.Random(8), [n for n in machine.rank]
    for _ in range(3000):
        text = "".join(rng.choice(names) for _ in range(rng.randrange(1, 6)))
        assert machine.encode(text) == library.encode(text), text


def test_random_ids_decode(machine, library):
    rng = random.Random(9)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 259, 28705]) for _ in range(rng.randrange(8))]
        assert machine.decode(ids) == library.decode(ids), ids


def test_long_texts_take_linear_time(machine, library):
    for text in ("ab" * 200_000, " " * 200_000 + "x", "x" * 200_000, "the quick\n" * 30_000):
        assert machine.encode(text) == library.encode(text)


def test_full_memories_are_emptied(library, monkeypatch):
    monkeypatch.setattr(ps, "WORDS", 3)
    monkeypatch.setattr(ps, "PAIRS", 5)
    machine = ps.Pieces(ps.default_model())
    text = "one two three four five six seven one two"
    ids = library.encode(text)
    assert machine.summary(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_query_and_cases(spark, library):
    def want(text):
        ids = library.encode(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    got = {r.doc_id: tuple(r)[1:] for r in ps.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.doc_id: want(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    odd = spark.createDataFrame([(1, None, "x"), (None, "a b", None), (1, "", None), (1, None, "x")], "doc_id long, text string, n_tokens string")
    assert sorted(((r.doc_id or 0), r.n_tokens, r.decoded_sha256) for r in ps.round_trip(odd).collect()) == sorted((d, *want(t)[::2]) for d, t in ((1, ""), (0, "a b"), (1, ""), (1, "")))
    assert ps.round_trip(odd.limit(0)).count() == 0
    back = ps.decoded(ps.encoded(odd))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == [(0, "a b"), (1, ""), (1, ""), (1, "")]
    assert [r.text for r in ps.decoded(spark.createDataFrame([(1, None), (2, [None, 264])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()] == ["", "a"]
