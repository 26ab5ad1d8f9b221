"""Removal of passages that an earlier document holds, by repeated-phrase automata.

A window is ``window`` consecutive words; a word goes if a window over it also starts in a document with a smaller doc_id.

1. Passages. Every window is assigned to the phrase of ``phrase`` words in it whose hash is least (the leftmost of equals): equal
   windows have the same phrase at the same place. Neighbouring windows with the same phrase form a passage, from the first
   word of the first window to the last word of the last. Passages are few (about 2 windows in ``window``), and every window is in one.
2. Recurring phrases are confirmed by counting: a phrase that only one document holds has no window that recurs, and its passages
   need no search. The others' passages stream through automata; equal passages (by two hashes of 64 bits) do so once, for all documents that hold them.
3. Automata are sharded by phrase: all passages of a phrase meet in one task, which compiles the windows that two or more documents
   hold into an Aho-Corasick automaton (pyahocorasick, over words), each with its earliest document, and streams the passages through it. A task takes
   one phrase after the other and starts a new automaton every PATTERNS windows or BLOCK_WORDS words.
4. A phrase with more than SHARD different passages is divided: its windows by the words before the phrase, about the square root of ``window``
   numbers at a time. The words that all windows of such a part share are its phrase (here 44 words), with which 2 and 3 begin anew: parts that only one document
   holds go, equal ones are one. Where even these are crowded, each window is a part of its own and its phrase, so there is one passage a phrase.
   Equal windows meet in one automaton at each step; rows grow with the passages, at most ``window`` parts each.
5. What an automaton locates (first word, end, earliest document) is relative to the passage and is joined back to every occurrence
   of it; an occurrence loses what an earlier document than its own holds.

No step holds all occurrences of a phrase or window in one task.

Defined results: null text: no words; null doc_ids stand after all others (with the id 2^63 - 1, if there is one) and are never earlier than each other; rows
with the same doc_id are told apart by their text; documents shorter than a window keep everything; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopgauge.llm.common import frugal, partitions, spent, table, written

WINDOW, PHRASE = 50, 8
#: Different passages of one phrase that one automaton takes, and windows and words in one automaton, about.
SHARD, PATTERNS, BLOCK_WORDS = 1024, 1 << 13, 1 << 19
#: Entries of a worker's memory of word hashes; it is emptied when full.
MEMORY = 1 << 19
LAST = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15


class _Hashes(dict):
    """XXH64 of words (bytes)."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = xxh64_intdigest(word)
        return out


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """A mixed polynomial hash of every run of width words, from the hashes of single words."""
    out, done, part, size, power = None, 0, h, 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                # the runs of ``size`` words after the ``done`` words so far
                out = part if out is None else out[: len(part) - done] * power + part[done:] if len(part) > done else part[:0]
                done += size
            if 2 * size > width:
                break
            part = part[: len(part) - size] * power + part[size:] if len(part) > size else part[:0]
            size, power = 2 * size, power * power
        out = out[: max(0, len(h) - width + 1)].copy()
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def passages_of(words: list[bytes], window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hash, first and last window start of each passage of a document."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = window_hashes(word_hashes(words), phrase)
    span = window - phrase + 1
    least = np.argmin(np.lib.stride_tricks.sliding_window_view(h, span), axis=1) + np.arange(len(words) - window + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return h[least[first]], first, np.r_[first[1:], len(least)] - 1


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, d (its rank: null last), k (tells apart rows of one doc_id), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))


def _passages(keyed: DataFrame, window: int, phrase: int) -> DataFrame:
    """phrase, passage (hashes), d, k, first, last."""
    schema = "phrase long, passage long, d long, k long, first int, last int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            found: list[list] = [[], [], [], [], [], []]
            for d, k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = _split(text.as_py())
                least, first, last = passages_of(words, window, phrase)
                if not len(first):
                    continue
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                starts = np.r_[0, ends[:-1]]
                hashes = [xxh3_64_intdigest(joined[a:b]) for a, b in zip(starts[first].tolist(), (ends[last + window - 1] - 1).tolist(), strict=True)]
                n = len(first)
                for column, values in zip(found, (least, np.array(hashes, np.uint64), np.full(n, d), np.full(n, k), first, last), strict=True):
                    column.append(values)
            if found[0]:
                p, h, d, k, first, last = (np.concatenate(c) for c in found)
                columns = [p.view(np.int64), h.view(np.int64), d, k, first.astype(np.int32), last.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["phrase", "passage", "d", "k", "first", "last"])

    return keyed.select("d", "k", "text").mapInArrow(frugal(cut), schema)


def _spans(keyed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of wanted passages (phrase, n, passage, most, d, k, first, last) as text: phrase, n, passage, d, most, words."""
    lists = wanted.groupBy("d", "k").agg(F.collect_list(F.struct("phrase", "n", "passage", "most", "first", "last")).alias("of"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], [], [], []]
            for d, text, of in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = _split(text.as_py())
                for x in of:
                    row = (x["phrase"], x["n"], x["passage"], d, x["most"], b" ".join(words[x["first"] : x["last"] + window]).decode("utf-8", "surrogatepass"))
                    for column, value in zip(found, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, SPANS.types, strict=True)], SPANS.names)

    # rows of one doc_id with the same text are one row here: the text is cut once
    texts = keyed.select("d", "k", "text").dropDuplicates(["d", "k"])
    return texts.join(lists, ["d", "k"]).select("d", "text", "of").mapInArrow(cut, "phrase long, n long, passage long, d long, most long, words string")


SPANS = pa.schema([("phrase", pa.int64()), ("n", pa.int64()), ("passage", pa.int64()), ("d", pa.int64()), ("most", pa.int64()), ("words", pa.string())])
FOUND = pa.schema([("phrase", pa.int64()), ("passage", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("owner", pa.int64())])
FOUND_TYPES = "phrase long, passage long, start int, end int, owner long"


class Coder:
    """Words as characters, so that an automaton's steps are words. There are 1,112,063 of them: a block holds BLOCK_WORDS words and the passages of one phrase (SHARD times less than 2 windows) more at most."""

    def __init__(self) -> None:
        self.codes: dict[bytes, str] = {}

    def coded(self, words: list[bytes]) -> str:
        codes = self.codes
        return "".join([codes.get(w) or codes.setdefault(w, chr(len(codes) + 1 + (0x800 if len(codes) + 1 >= 0xD800 else 0))) for w in words])

    def known(self, words: list[bytes]) -> str:
        return "".join([self.codes.get(w, "\0") for w in words])


def runs(owners: dict[str, int], lines: Iterable[str]) -> Iterator[tuple[int, int, int, int]]:
    """Number of the line, first word, end and owner of every run of one owner's patterns that the automaton of owners locates in lines."""
    from ahocorasick import Automaton

    if not owners:
        return
    automaton = Automaton()
    for w, d in owners.items():
        automaton.add_word(w, (len(w), d))
    automaton.make_automaton()
    for number, line in enumerate(lines):
        start = end = whose = None
        for last, (size, owner) in automaton.iter(line):
            first = last - size + 1
            if owner == whose and start <= first <= end:
                end = last + 1
                continue
            if whose is not None:
                yield number, start, end, whose
            start, end, whose = first, last + 1, owner
        if whose is not None:
            yield number, start, end, whose


def locate_all(spans: list[tuple[int, int, int, str]], window: int) -> Iterator[tuple[int, int, int, int]]:
    """``runs`` in the spans (n, d, most, words) of their own recurring windows: those that documents of two or more ids hold.

    A span that is its phrase's only one (n = 1) recurs as a whole and is one pattern.
    """
    coder = Coder()
    lines = [coder.coded(_split(words)) for *_, words in spans]
    least: dict[str, int] = {}
    latest: dict[str, int] = {}
    for (n, d, most, _), line in zip(spans, lines, strict=True):
        size = len(line) if n == 1 else window
        for k in range(len(line) - size + 1):
            w = line[k : k + size]
            if w in least:
                least[w], latest[w] = min(d, least[w]), max(most, latest[w])
            else:
                least[w], latest[w] = d, most
    yield from runs({w: d for w, d in least.items() if d < latest[w]}, lines)


def locate(patterns: Iterable[tuple[int, str]], texts: Iterable[str], window: int) -> Iterator[tuple[int, int, int, int]]:
    """``runs`` in texts of the windows of patterns (owner, words)."""
    coder = Coder()
    owners: dict[str, int] = {}
    for d, words in patterns:
        line = coder.coded(_split(words))
        for k in range(len(line) - window + 1):
            w = line[k : k + window]
            owners[w] = min(d, owners.get(w, d))
    yield from runs(owners, (coder.known(_split(t)) for t in texts))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, FOUND.types, strict=True)], FOUND.names)


def _meetings(spans: DataFrame, window: int) -> DataFrame:
    """phrase, passage, start, end, owner: located in the spans of phrases that one task takes."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows, words, phrase = 0, 0, None

        def found() -> pa.RecordBatch:
            return _batch([(*held[i][:2], start, end, owner) for i, start, end, owner in locate_all([h[2:] for h in held], window)])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != phrase:
                    if windows > PATTERNS or words > BLOCK_WORDS:
                        yield found()
                        held, windows, words = [], 0, 0
                    phrase = row[0]
                held.append(row)
                size = row[5].count(" ") + 1
                windows += 1 if row[2] == 1 else size + 1 - window
                words += size
        yield found()

    n = partitions(spans.sparkSession)
    return spans.select("phrase", "passage", "n", "d", "most", "words").repartition(n, "phrase").sortWithinPartitions("phrase").mapInArrow(frugal(stream), FOUND_TYPES)


def _parts(spans: DataFrame, window: int, phrase: int, offsets: int) -> DataFrame:
    """The spans' windows, divided by the words before their phrase, ``offsets`` numbers of them at a time: phrase and passage of the part, of_phrase and of_passage of its span, at (words before it there), d, most, words.

    A part's phrase are the words that all windows with these numbers share, so equal windows are in parts of one phrase.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("phrase", "passage", "of_phrase", "of_passage")] + [("at", pa.int32()), ("d", pa.int64()), ("most", pa.int64()), ("words", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        signed = lambda words, seed: xxh3_64_intdigest(b" ".join(words), seed) - (1 << 63)
        for batch in batches:
            rows = []
            for of_phrase, of_passage, d, most, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                words = _split(text)
                last = len(words) - window  # the last window's start
                place = int(np.argmin(window_hashes(word_hashes(words[:window]), phrase)))  # of the phrase, in every window
                for k in range((place - last) // offsets, place // offsets + 1):
                    fewest, most_before = max(k * offsets, place - last), min(k * offsets + offsets - 1, place)
                    part = words[place - most_before : place - fewest + window]
                    shared = words[place - k * offsets : place - k * offsets - offsets + 1 + window]
                    rows.append((signed(shared, k + 1), signed(part, 0), of_phrase, of_passage, place - most_before, d, most, b" ".join(part).decode("utf-8", "surrogatepass")))
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema.names)

    return spans.select("phrase", "passage", "d", "most", "words").mapInArrow(cut, "phrase long, passage long, of_phrase long, of_passage long, at int, d long, most long, words string")


def _merged(found: DataFrame) -> DataFrame:
    """found with runs of one passage and owner that overlap as one."""
    by = Window.partitionBy("phrase", "passage", "owner").orderBy("start")
    apart = F.coalesce(F.col("start") > F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    runs = found.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("phrase", "passage", "owner", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("phrase", "passage", "start", "end", "owner")


def _recurring(distinct: DataFrame) -> DataFrame:
    """phrase, n (its passages) of the phrases that documents of two or more ids hold. distinct: phrase, passage, d, most."""
    return distinct.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d0"), F.max("most").alias("d1")).where("d0 < d1").select("phrase", "n")


def _located(spans: DataFrame, window: int, phrase: int, offsets: int) -> DataFrame:
    """phrase, passage, start, end, owner: located in the spans; what crowded phrases have is divided first, ``offsets`` numbers at a time."""
    if not offsets:
        return _meetings(spans, window)
    found = _meetings(spans.where(F.col("n") <= SHARD), window)
    crowd = spans.where(F.col("n") > SHARD)
    if crowd.isEmpty():
        return found
    parts = written(_parts(crowd, window, phrase, offsets), "parts")
    distinct = parts.groupBy("phrase", "passage").agg(F.min("d").alias("d"), F.max("most").alias("most"), F.first("words").alias("words"))
    below = written(distinct.join(_recurring(distinct), "phrase").select("phrase", "n", "passage", "d", "most", "words"), "spans")
    # windows one by one are the last step: then a phrase is a window and has one passage
    inner = _located(below, window, phrase, 1 if offsets > 1 else 0)
    back = inner.join(parts.select("phrase", "passage", "of_phrase", "of_passage", "at"), ["phrase", "passage"])
    back = back.select(F.col("of_phrase").alias("phrase"), F.col("of_passage").alias("passage"), (F.col("start") + F.col("at")).alias("start"), (F.col("end") + F.col("at")).alias("end"), "owner")
    return found.unionByName(_merged(back))


def repeated_spans(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """d, k, start, end: runs of words that windows of earlier documents cover; they may overlap."""
    keyed = _keyed(docs)
    passages = written(_passages(keyed, window, phrase), "passages")
    distinct = written(passages.groupBy("phrase", "passage").agg(F.min(F.struct("d", "k", "first", "last")).alias("of"), F.max("d").alias("most")), "distinct")
    phrases = _recurring(distinct.select("phrase", "passage", "of.d", "most"))
    spans = written(_spans(keyed, distinct.join(phrases, "phrase").select("phrase", "n", "passage", "most", "of.*"), window), "spans")
    spent(distinct)
    found = written(_located(spans, window, phrase, math.isqrt(window - phrase) + 1), "found")
    spent(spans)
    lost = passages.join(found, ["phrase", "passage"]).where("owner < d")
    return lost.select("d", "k", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    gone = repeated_spans(docs, window, phrase).groupBy("d", "k").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = _split(text.as_py())
                stays = np.ones(len(words), bool)
                for x in spans or ():
                    stays[x["start"] : x["end"]] = False
                n_words.append(len(words))
                n_removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays)] if n_removed[-1] else words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return _keyed(docs).join(gone, ["d", "k"], "left").select("doc_id", "text", "gone").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), early AS (
  SELECT v, min(doc_id) AS d FROM windows GROUP BY v
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS g FROM windows JOIN early USING (v) WHERE doc_id > d GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n, CASE WHEN g IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i))), lambda i: w[i]) END AS kept
  FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
"""
