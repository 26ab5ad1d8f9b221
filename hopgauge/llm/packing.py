"""Best-fit packing of token sequences, planned on the histogram of lengths.

1. Every document is tokenized (ids, then one closing id 0) and cut into pieces of at most ``capacity`` tokens.
2. The pieces are counted by length. Best-fit decreasing then runs over these at most ``capacity`` counts on the driver, not
   over documents: sequences that are filled alike are kept as runs of consecutive numbers. Its result is a plan of slots: "the
   pieces of length l with ranks a..b stand at offset o of the sequences s..s+b-a".
3. Pieces get their rank within their length and find their slot by length and rank.

A length may hold any share of all pieces, so ranks are counted in salted groups and shifted by the sums of the groups before.

Defined results: a null text is an empty one, whose single token is the closing id; null or repeated doc_ids are packed row by
row; other columns are ignored; an empty table gives an empty table. Texts are never cut short: long ones become several pieces.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopgauge.llm.common import frugal, partitions, remembered, table, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Most entries of a worker's memory of tokenized words; it is emptied when full.
MEMORY = 1 << 19
#: Letters that neither normalization nor context changes but to lower case, then signs that start no contraction or special token.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*%$&|>()\"-]*)")


class _Words(dict):
    """ids of a word (bytes), found on first use."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if plain := PLAIN.fullmatch(text):
            letters, signs = plain.groups()
            ids = self._part(letters.lower())
            if signs:
                ids += self._part(signs)
        elif any(s in text for s in self.special):
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            ids = self._ids(self.whole.normalizer.normalize_str(text))
        if len(self) >= MEMORY:
            self.clear()
        self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            if len(self.parts) >= MEMORY:
                self.parts.clear()
            ids = self.parts[part] = self._ids(part)
        return ids

    def _ids(self, text: str) -> bytes:
        merge = self.whole.model.tokenize
        return pack_ids([t.id for part, _ in self.whole.pre_tokenizer.pre_tokenize_str(text) for t in merge(part)])


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """The ids that a tokenizer of the ``tokenizers`` library gives a text, with a memory of words.

    For a tokenizer that drops white space: ASCII white space always ends a token there, so words between are encoded one by one,
    by the library's own steps (normalize, split, merge). Words that are letters, then signs, fall into just these two parts.
    """

    def __init__(self, path: str) -> None:
        self.words = _Words(path)

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.words.__getitem__, (text or "").encode("utf-8", "surrogatepass").split()))


def encoder(path: str) -> Encoder:
    """One for each Python worker and tokenizer file."""
    return remembered(("packing", path), lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the documents' ids, each document closed by id 0, cut at every capacity tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode.ids(text.as_py()) + b"\0\0\0\0"
                rows += [(doc, k, k * capacity, len(part) // 4, zlib.crc32(part)) for k in range(-(-len(ids) // (4 * capacity))) for part in [ids[4 * capacity * k : 4 * capacity * (k + 1)]]]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(cut), PIECES)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts: rows (length, first rank, first sequence, offset), sorted; a row holds to the next one.

    The work and the result depend on the number of lengths, not on how many pieces there are.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, number)
    rooms: list[int] = []  # the keys of free that have runs, sorted
    opened, rows = 0, []

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in free:
                insort(rooms, room)
            free.setdefault(room, []).append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, first, number = capacity, opened, -(-left // (capacity // length))
                opened += number
            each = room // length  # best fit puts this many into one sequence before it turns to the next
            full, rest = min(number, left // each), 0
            for layer in range(each if full else 0):
                rows.append((length, rank, first, capacity - room + layer * length))
                rank += full
            left -= full * each
            if full < number and left:
                rest, left = left, 0
                for layer in range(rest):
                    rows.append((length, rank, first + full, capacity - room + layer * length))
                    rank += 1
            put(room - each * length, first, full)
            put(room - rest * length, first + full, 1 if rest else 0)
            put(room, first + full + bool(rest), number - full - bool(rest))
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """cut (PIECES, read several times: a written table) with sequence_id and offset."""
    slots = plan({r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}, capacity)  # at most capacity rows
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(cut.sparkSession))))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(shift, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("shift"))
    key = (slots[:, 0] << 48) + slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slots[at, 2] + rank - slots[at, 1]), pa.array(slots[at, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    """All documents as pieces in as few sequences of at most capacity tokens as best fit decreasing needs."""
    return pack(written(pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_plan(rows: Iterable[tuple[int, int, int]], capacity: int) -> int:
    """Number of sequences of a packing (sequence, offset, length), after a check that each is gapless and not too long."""
    by: dict[int, list[tuple[int, int]]] = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end, "gap or overlap"
            end += length
        assert end <= capacity, "too long"
    return len(by)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
