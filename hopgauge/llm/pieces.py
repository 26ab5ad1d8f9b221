"""Encoding and decoding with a SentencePiece BPE model by a prefix table over token types, and the query on ids and decoded texts.

BPE merges neighbours whose concatenation is a piece, the best score first and the leftmost of equals. Two facts turn that into a
table over prefixes (both hold where a piece's merges come in the order of their ranks, which ``Pieces.spines`` makes sure of):

* a sequence of pieces is the encoding of its text exactly if each two neighbours are the encoding of theirs;
* hence each prefix of a text has just one last token: of the pieces that end there it is the one that is compatible with the
  last token of the prefix before it.

So one pass of an Aho-Corasick automaton over the text yields the pieces that end at each character, the table keeps the one
compatible piece, and ids are read backwards from the end. The time is linear in the text, however long its words are.

Compatibility of u and v: while u and v are merged from their characters, the symbols at u's right edge and at v's left edge change
(their spines). u and v stay apart unless some two symbols that meet at the edge join, that is, rank better than the merges that
would take them up otherwise. Of equal ranks the merge in u comes first and the one in v last, as leftmost goes first.

A space is a piece character of its own that only begins pieces (or fills whole ones), so texts are cut before runs of spaces
and the encodings of short words are remembered. Characters that no piece has never merge; their ids are those of their
UTF-8 bytes, or the unknown id for a model without byte pieces. Models with user-defined or unused pieces or with a normalizer of
their own are refused.

Decoding strings the pieces together, turns runs of byte pieces into characters (bytes that are no UTF-8 become U+FFFD each), skips
control ids and drops the one space that encoding puts in front.

Defined results: a null text counts as empty; an empty text has no ids, its ids_sha256 and decoded_sha256 are those of the empty
string; rows are taken one by one, so null and repeated doc_ids and repeated rows keep their rows; other columns are ignored; an empty table
gives an empty table. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgauge.llm.common import table

SPACE = "▁"
#: Remembered words (twice as many) of at most LONGEST characters, and remembered pairs of pieces, which are forgotten when full.
WORDS, LONGEST, PAIRS = 1 << 18, 48, 1 << 20
NEVER = 1 << 60


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown = model.unk_id()
        self.names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.control = {i for i in range(len(self.names)) if model.is_control(i)}
        self.bytes = {i: int(self.names[i][3:5], 16) for i in range(len(self.names)) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        if any(model.is_unused(i) for i in range(len(self.names))) or model.normalize(f"ﬁ  Ａ{SPACE}") != f"{SPACE}ﬁ{SPACE * 2}Ａ{SPACE}":
            raise ValueError("the model has unused pieces or changes texts before it encodes them")
        plain = [i for i in range(len(self.names)) if i not in self.control and i not in self.bytes and i != self.unknown]
        scores = sorted({-model.get_score(i) for i in plain})
        self.rank = {self.names[i]: bisect_left(scores, -model.get_score(i)) for i in plain}  # better first, equal scores share one
        self.ids = {self.names[i]: i for i in plain}
        if any(SPACE in n.lstrip(SPACE) for n in self.rank):
            raise ValueError("a piece has a space behind another character")
        self.letters = {c for n in self.rank for c in n}
        # symbols by number: pieces, and characters that are no piece themselves but take part in merges; the last number stands for the text's begin
        self.symbols = [*self.rank, *sorted(self.letters - self.rank.keys())]
        self.sizes = [len(n) for n in self.symbols]
        self.begin = len(self.symbols)
        self.written = [[self.ids[n]] if n in self.ids else self.fallback(n) for n in self.symbols]
        self.automaton = ahocorasick.Automaton()
        for k, name in enumerate(self.symbols):
            self.automaton.add_word(name, k)
        self.automaton.make_automaton()
        self.edges: dict[str, tuple[list[tuple[str, int]], list[tuple[str, int]]] | None] = {}
        self.apart: dict[int, bool] = {}
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.utf8 = {str(i): b"" if i in self.control else bytes([self.bytes[i]]) if i in self.bytes else " ⁇ ".encode() if i == self.unknown else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)}
        own = "".join(re.escape(c) for c in "\n\t\r" if c not in self.letters)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{own}]*|[^{SPACE}{own}]+" + (f"|[{own}]" if own else ""))

    def spines(self, piece: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]] | None:
        """(symbol, rank of the merge that takes it up) at the left and at the right edge while the piece is merged; None if merging its characters gives something else."""
        if piece not in self.edges:
            parts, left, right, last = list(piece), [], [], -1
            while len(parts) > 1:
                rank, at = min((self.rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == NEVER:
                    break
                if rank < last:
                    raise ValueError(f"the merges of {piece!r} do not come in the order of their ranks")
                last = rank
                if at == 0:
                    left.append((parts[0], rank))
                if at == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.edges[piece] = (left + [(piece, NEVER)], right + [(piece, NEVER)]) if len(parts) == 1 else None
        return self.edges[piece]

    def compatible(self, one: int, two: int) -> bool:
        """Whether the encoding of symbol one (or the text's begin) and symbol two is these two."""
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        found = self.spines(self.symbols[two]) is not None if one == self.begin else self.stays_apart(self.symbols[one], self.symbols[two])
        self.apart[one * (self.begin + 1) + two] = found
        return found

    def stays_apart(self, one: str, two: str) -> bool:
        ours, theirs = self.spines(one), self.spines(two)
        if ours is None or theirs is None:
            return False
        xs, ys, i, j = ours[1], theirs[0], 0, 0
        while True:
            (x, taken), (y, gone) = xs[i], ys[j]
            joint = self.rank.get(x + y, NEVER)
            if joint < taken and joint <= gone:
                return False
            if taken == gone == NEVER:
                return True
            if taken <= gone:
                i += 1
            else:
                j += 1

    def chain(self, text: str) -> list[int]:
        """The symbols of a text whose characters all occur in pieces."""
        last = [self.begin, *[-1] * len(text)]  # by prefix
        sizes, known, row = self.sizes, self.apart.get, self.begin + 1
        for end, symbol in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - sizes[symbol]]
                if (apart := known(before * row + symbol)) is None:
                    apart = self.compatible(before, symbol)
                if apart:
                    last[end] = symbol
        found, end = [], len(text)
        while end:
            symbol = last[end]
            found.append(symbol)
            end -= sizes[symbol]
        return found[::-1]

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a text without a space behind another character; spaces are piece characters already."""
        ids: list[int] = []
        start = 0
        for k, char in enumerate(word):
            if char not in self.letters:
                ids += self.known(word[start:k])
                ids += self.fallback(char)
                start = k + 1
        return ids + self.known(word[start:])

    def known(self, text: str) -> list[int]:
        return [i for symbol in self.chain(text) for i in self.written[symbol]] if text else []

    def entry(self, word: str) -> str:
        """Ids joined by commas. Words that were met lately are remembered in two generations, so that memory is bounded and frequent words stay."""
        if (found := self.older.get(word)) is None:
            found = ",".join(map(str, self.encode_word(word)))
        if len(word) <= LONGEST:
            if len(self.words) >= WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found

    def parts(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for w in self.parts(text) for i in self.encode_word(w)]

    def surface(self, ids: Iterable[int]) -> str:
        """Decoded ids, with the space in front."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(characters(held))
                held.clear()
            if i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.names[i])
        return "".join([*out, characters(held)]).replace(SPACE, " ")

    def decode(self, ids: Iterable[int]) -> str:
        return self.surface(ids).removeprefix(" ")

    def summary(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids joined by commas, digest of the decoded text."""
        words, entry = self.words.get, self.entry
        found = []
        for word in self.parts(text):
            if (ids := words(word)) is None:
                ids = entry(word)
                words = self.words.get
            found.append(ids)
        joined = ",".join(found)
        ids = joined.split(",") if joined else []
        decoded = b"".join(map(self.utf8.__getitem__, ids)).removeprefix(b" ")
        try:
            decoded.decode()
        except UnicodeDecodeError:
            decoded = self.decode(map(int, ids)).encode()
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def characters(held: bytes) -> str:
    """UTF-8 characters of the bytes; each byte that belongs to none becomes U+FFFD."""
    out, k = [], 0
    while k < len(held):
        b = held[k]
        size = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        try:
            out.append(bytes(held[k : k + size]).decode() if size else "�")
        except UnicodeDecodeError:
            out.append("�")
            size = 1
        k += max(size, 1)
    return "".join(out)


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each Python worker and model file."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array of ints) of every text."""
    path = model or default_model()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pieces(path)
        for batch in batches:
            for k in range(batch.num_rows):  # a row a batch: ids of long texts are large
                ids = pa.array([machine.encode(batch.column(1)[k].as_py() or "")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids). Null ids and null elements decode to nothing; ids that the model does not have are an error."""
    path = model or default_model()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pieces(path)
        for batch in batches:
            texts = [machine.decode(i for i in ids or () if i is not None) for ids in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids in decimal, joined by commas), decoded_sha256 (the text that they decode to)."""
    path = model or default_model()

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pieces(path)
        for batch in batches:
            n, ids, texts = zip(*[machine.summary(x.as_py() or "") for x in batch.column(1)], strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(summarize, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
