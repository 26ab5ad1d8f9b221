"""Toxicity scores of a convolutional text classifier that is trained here in numpy.

A word's embedding is the sum of two rows of a hashed table, one for the word and one for its beginning, so that unseen forms of
a known stem are recognised. Filters of widths 1, 2 and 3 slide over the embeddings, each is pooled to its maximum over the whole
text, and a logistic output weighs the pooled values. Embeddings, filters and output start at random and are learned together. In the first
epochs of training the gradient reaches the words of a text by a softmax of the filter's values that gets sharper from epoch to epoch, afterwards
the word of the maximum alone; a share of the words, another one each time and a half on average, is hidden, so that no text is known by a single one.

Training reads at most ``sample`` labelled documents outside the held-out fold (crc32 of the doc_id as text modulo 5 is 0), chosen
by hash, of at most LONGEST characters each and CHARACTERS together, which bounds the driver's memory; everything else covers all rows. The score
depends on the text alone. Thresholds are calibrated by language on the labels
of one fold (remainder 1), which training leaves out: the threshold with the best F1 over all labelled rows of a language, counted in
score bins; languages with fewer than ``least`` toxic labels keep 0.5.

Defined results: null and empty texts get a score like any other (that of no words); very long texts are scored in slices that overlap by the
widest filter; null or repeated doc_ids are scored row by
row (a null one is never held out, as it has no remainder) and one of the texts of a doc_id, that with the least length and hash, is learned from; a doc_id
with several labels counts as toxic if any is; null labels count as missing; with no
labels of both classes all scores are the share of toxic labels (0 without labels); other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopgauge.llm.common import frugal, give_back, remembered, table, written

#: Rows of the table of embeddings, their length, filters of each width, widths.
ROWS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
#: Characters of a word's beginning.
STEM = 5
#: Words that are scored at once, and different words that a worker remembers.
SLICE, MEMORY = 1 << 15, 1 << 17
#: Characters of a text that is cut into slices, of a text that is learned from, and of all that are.
LONG, LONGEST, CHARACTERS = 1 << 20, 1 << 18, 1 << 25
BINS = 200
#: How sharp the softmax over a text's words is in each epoch; None: the maximum.
SHARPNESS = (1.0, 2.0, 4.0, 8.0, None, None, None, None)
_SPACE = re.compile(rb"[\x09-\x0d\x20]")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def rows_of(word: bytes) -> tuple[int, int]:
    """The two rows of a word's embedding, from 1 on: row 0 is no word. Case and signs around a word don't matter."""
    plain = _EDGES.sub("", word.decode("utf-8", "surrogatepass")).lower()
    if not plain:
        return 0, 0
    return 1 + zlib.crc32(plain.encode("utf-8", "surrogatepass")) % (ROWS - 1), 1 + zlib.crc32(b"\0" + plain[:STEM].encode("utf-8", "surrogatepass")) % (ROWS - 1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


@dataclass
class Model:
    """embeddings (ROWS, DIM), kernels (DIM, all offsets of all widths, FILTERS), bias of each filter, output weights and bias."""

    embeddings: np.ndarray
    kernels: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.weights + self.offset


def convolve(answers: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Values (position, filter) of every width from the kernels' answers (position, offset, filter); -inf between documents."""
    out, k = [], 0
    for width in WIDTHS:
        conv = answers[:, k].copy()
        for j in range(1, width):
            conv[:-j] += answers[j:, k + j]
        out.append(conv)
        k += width
    conv = np.concatenate(out, axis=1)
    conv[~inside] = -np.inf
    return conv


def laid_out(documents: list[np.ndarray], counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One array of all documents' entries, two zeros after each (no window reaches the next), starts, and what is inside (the first counted entries)."""
    gap = np.zeros((2, *documents[0].shape[1:]), documents[0].dtype)
    parts = [p for d in documents for p in (d if len(d) else gap[:1], gap)]
    lengths = np.array([max(len(d), 1) for d in documents])
    starts = np.r_[0, np.cumsum(lengths + 2)[:-1]]
    inside = np.zeros(int((lengths + 2).sum()), bool)
    for s, n in zip(starts.tolist(), counted or lengths.tolist(), strict=True):
        inside[s : s + max(n, 1)] = True
    return np.concatenate(parts), starts, inside


def train(documents: list[np.ndarray], labels: np.ndarray, batch: int = 32, rate: float = 0.02, hidden: float = 0.5, seed: int = 0) -> Model:
    """documents: arrays (words, 2) of embedding rows. Adagrad on the logistic loss, from random numbers on."""
    rng = np.random.default_rng(seed)
    n_kernels, n_filters = sum(WIDTHS), FILTERS * len(WIDTHS)
    share = float(labels.mean()) if len(labels) else 0.0
    model = Model(
        rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, n_kernels, FILTERS)).astype(np.float32),
        np.zeros(n_filters, np.float32), rng.normal(0, 0.3, n_filters).astype(np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))),
    )
    model.embeddings[0] = 0
    if not 0 < share < 1:
        model.weights[:] = 0
        return model
    first = np.cumsum((0, *WIDTHS))[:-1]
    squares = [np.full_like(x, 1e-6) for x in (model.embeddings, model.kernels, model.bias, model.weights)] + [np.array(1e-6)]
    for sharpness in SHARPNESS:
        for chosen in np.array_split(rng.permutation(len(documents)), -(-len(documents) // batch)):
            rows, starts, inside = laid_out([documents[i] for i in chosen])
            text = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
            rows = np.where((rng.random(len(rows)) < 2 * hidden * rng.random(len(starts))[text])[:, None], 0, rows)
            vectors = model.embeddings[rows[:, 0]] + model.embeddings[rows[:, 1]]
            conv = convolve(np.einsum("nd,dkf->nkf", vectors, model.kernels, optimize=True), starts, inside)
            most = np.maximum.reduceat(conv, starts, axis=0)
            part = (conv == most[text]).astype(np.float32) if sharpness is None else np.exp(sharpness * (conv - most[text])).astype(np.float32)
            part /= np.add.reduceat(part, starts, axis=0)[text]
            pooled = most if sharpness is None else np.add.reduceat(np.where(inside[:, None], conv, 0) * part, starts, axis=0)
            active = np.maximum(pooled + model.bias, 0)
            error = (1 / (1 + np.exp(-(active @ model.weights + model.offset))) - labels[chosen]).astype(np.float32) / len(chosen)
            back = error[:, None] * model.weights * (active > 0)
            where = back[text] * part
            reached = np.flatnonzero(where.any(1))  # few once the maximum counts
            g_kernels, touched, moved = np.zeros_like(model.kernels), [], []
            for w, width in enumerate(WIDTHS):
                g = where[reached, w * FILTERS : (w + 1) * FILTERS]
                for j in range(width):
                    at = np.minimum(reached + j, len(rows) - 1)
                    g_kernels[:, first[w] + j] += vectors[at].T @ g
                    touched.append(at)
                    moved.append(g @ model.kernels[:, first[w] + j].T)
            at, g = np.concatenate(touched), np.concatenate(moved)
            which, row = np.unique(rows[at].T.ravel(), return_inverse=True)
            g = np.concatenate([g, g])
            g_rows = np.stack([np.bincount(row, g[:, c], len(which)) for c in range(DIM)], axis=1).astype(np.float32)
            g_rows[which == 0] = 0
            squares[0][which] += g_rows**2
            model.embeddings[which] -= rate * g_rows / np.sqrt(squares[0][which])
            for k, (x, g) in enumerate(((model.kernels, g_kernels), (model.bias, back.sum(0)), (model.weights, active.T @ error)), 1):
                squares[k] += g**2
                x -= rate * g / np.sqrt(squares[k])
            squares[4] += error.sum() ** 2
            model.offset -= rate * float(error.sum() / np.sqrt(squares[4]))
    return model


def slices(text: str) -> Iterator[tuple[list[bytes], int]]:
    """A long text's words in overlapping slices, and how many of a slice count: windows over the last ones belong to the next slice."""
    data, begin, held, more = text.encode("utf-8", "surrogatepass"), 0, [], max(WIDTHS) - 1
    while begin < len(data):
        space = _SPACE.search(data, min(begin + LONG, len(data)))
        end = space.start() if space else len(data)
        held += data[begin:end].split()
        begin = end
        while len(held) > SLICE + more:
            yield held[: SLICE + more], SLICE
            held = held[SLICE:]
    yield held, len(held)


class Scorer:
    """Scores texts; remembers the kernels' answers to words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.numbers: dict[bytes, int] = {}
        self.answers = np.zeros((1, sum(WIDTHS), FILTERS), np.float32)  # number 0: no word

    def pooled(self, words: list[list[bytes]], counted: list[int] | None = None) -> np.ndarray:
        if len(self.numbers) > MEMORY:
            self.numbers, self.answers = {}, self.answers[:1].copy()
        known, new = self.numbers, []
        for ws in words:
            for w in ws:
                if w not in known:
                    known[w] = len(known) + 1
                    new.append(w)
        if new:
            rows = np.array([rows_of(w) for w in new])
            vectors = self.model.embeddings[rows[:, 0]] + self.model.embeddings[rows[:, 1]]
            first, end = len(known) + 1 - len(new), len(known) + 1
            if end > len(self.answers):
                more = np.zeros((max(end, 2 * len(self.answers)), *self.answers.shape[1:]), np.float32)
                more[:first] = self.answers[:first]
                self.answers = more
            self.answers[first:end] = np.einsum("nd,dkf->nkf", vectors, self.model.kernels, optimize=True)
        numbers, starts, inside = laid_out([np.fromiter(map(known.__getitem__, ws), np.int32, len(ws)) for ws in words], counted)
        return np.maximum.reduceat(convolve(self.answers[numbers], starts, inside), starts, axis=0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.of(self.pooled([_words(t) for t in texts]))

    def of(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.model.logits(pooled).astype(np.float64)))

    def long_score(self, text: str) -> np.ndarray:
        most = None
        for words, counted in slices(text):
            found = self.pooled([words], [counted])
            most = found if most is None else np.maximum(most, found)
        return self.of(most)


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _by_document(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 or 1) of what has a label."""
    return labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, h (hash of the text to learn from), toxic: at most sample labelled doc_ids of the folds 2 to 4 within LONGEST and CHARACTERS."""
    by = _by_document(labels).where(_fold(F.col("doc_id")) > 1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # at most sample rows of two numbers, hence the broadcast: no text is shuffled
    chosen = F.broadcast(by.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.length(text).alias("n"), F.xxhash64(text).alias("h")).alias("of")).join(chosen, "doc_id")
    one = sizes.groupBy("doc_id").agg(F.min("of").alias("of"), F.max("toxic").alias("toxic")).where(F.col("of.n") <= LONGEST)
    # the window is over at most sample rows
    total = F.sum("of.n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return one.withColumn("total", total).where(F.col("total") <= CHARACTERS).select("doc_id", "of.h", "toxic")


def train_on(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model:
    """docs: doc_id, text. The classifier, from what ``sampled`` chooses."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.join(F.broadcast(sampled(docs, labels, sample)), ["doc_id", "h"]).select("doc_id", "text", "toxic")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array([rows_of(w) for w in _words(t.as_py())], np.int32).reshape(-1, 2).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "rows", "toxic"])

    # one row a doc_id: equal ones are dropped before they reach the driver
    got = rows.mapInArrow(frugal(hashed), "doc_id long, rows binary, toxic int").dropDuplicates(["doc_id"]).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("rows", "ascending")])  # training depends on the order
    documents = [np.frombuffer(x.as_py(), np.int32).reshape(-1, 2) for x in got.column("rows")]
    return train(documents, got.column("toxic").to_numpy().astype(np.float32))


def _sent(spark: SparkSession, model: Model) -> tuple[str, Broadcast]:
    """The model on its way to the workers (its size is fixed by ROWS, DIM and FILTERS), under a name."""
    return str(zlib.crc32(model.embeddings.tobytes())), spark.sparkContext.broadcast(model)


def _in_slices(sent: tuple[str, Broadcast], texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Scores of texts, of some at a time."""
    name, model = sent
    scorer = remembered(("toxicity", name), lambda: Scorer(model.value))
    held: list[str | None] = []
    size = 0
    for text in texts:
        if len(text or "") > LONG:
            if held:
                yield scorer.scores(held)
                held, size = [], 0
            yield scorer.long_score(text)
            continue
        held.append(text)
        size += len(text or "") // 6 + 3
        if size >= SLICE:
            yield scorer.scores(held)
            held, size = [], 0
    if held:
        yield scorer.scores(held)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, score of every row."""
    sent = _sent(docs.sparkSession, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for found in _in_slices(sent, (t.as_py() for t in batch.column(2))):
                part = batch.slice(row, len(found))
                row += len(found)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], ["doc_id", "lang", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(frugal(scored), "doc_id long, lang string, score double")


def thresholds(scored: DataFrame, labels: DataFrame, least: int = 30) -> DataFrame:
    """lang, threshold: the lower edge of the score bin with the best F1 on the labels of fold 1, near 0.5 among equals."""
    rows = scored.join(_by_document(labels), "doc_id").where(_fold(F.col("doc_id")) == 1)
    bins = rows.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("lang")
    above = by.orderBy(F.desc("bin"))
    f1 = bins.select("lang", (F.col("bin") / BINS).alias("threshold"), F.sum("toxic").over(above).alias("hit"), F.sum("n").over(above).alias("chosen"), F.sum("toxic").over(by).alias("all"))
    f1 = f1.where(F.col("all") >= least).withColumn("f1", 2 * F.col("hit") / (F.col("chosen") + F.col("all")))
    return f1.groupBy("lang").agg(F.max(F.struct("f1", -F.abs(F.col("threshold") - 0.5), "threshold"))["threshold"].alias("threshold"))


def _with_threshold(scored: DataFrame, measured: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """scored with its language's threshold as column name; measured: doc_id, lang, score. One row a language is joined, by whatever Spark finds best."""
    of = f"{name}_of"
    edges = thresholds(measured, labels).select(F.col("lang").alias(of), F.col("threshold").alias(name))
    joined = scored.join(edges, F.coalesce(scored["lang"].cast("string"), F.lit("")) == F.col(of), "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0.5))).drop(of)


def classify(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> DataFrame:
    """doc_id, lang, score, threshold (of the language), toxic (score >= threshold) of every row."""
    scored = written(score(docs, train_on(docs, labels, sample)), "scores")
    out = _with_threshold(scored, scored, labels, "threshold")
    return out.withColumn("toxic", F.col("score") >= F.col("threshold"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> DataFrame:
    """docs without those over their language's threshold, row by row. Texts are scored once and not shuffled."""
    sent = _sent(docs.sparkSession, train_on(docs, labels, sample))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([np.zeros(0), *_in_slices(sent, (None if pd.isna(t) else t for t in texts))]))
            give_back()

    name = "_score" + "_" * max(len(c) for c in docs.columns)
    scored = written(docs.withColumn(name, of(F.col("text").cast("string"))), "scored")
    measured = scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col(name).alias("score"))
    edge = name + "edge"
    return _with_threshold(scored, measured, labels, edge).where(F.col(name) < F.col(edge)).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")
