"""SimHash near-duplicates by anchor points.

Two 64-bit fingerprints link if at most ``bits`` bits differ. The anchors are the code words of a covering code: the product of
two binary Golay codes on bits 0-22 and 23-45, each of which covers its 2^23 points with radius 3 and without overlap. A
fingerprint's home is the anchor within radius 3 in both parts; it is replicated to every anchor that a fingerprint within
``bits`` of it may have as its home: those within radius 3 + e and 3 + f of its parts with e + f <= bits. So any two linked
fingerprints meet at the home of either, and only fingerprints at one anchor are compared.

Equal fingerprints are one row before that. An anchor with more than ``MOST`` fingerprints is divided by the rest of the covering
code: the Hamming code of length 15 (radius 1) on bits 46-60 and bits 61-63 themselves make 2^14 anchors of each crowded one, under
the same rule, with what is left of ``bits`` at the first two parts. If so many fingerprints are expected everywhere, all go there at once. What leaves an
anchor is a star for each local component, never all its pairs; no fingerprint leaves the comparison by anchors.

Defined results: a text without words (empty, null) has fingerprint zero and links like any other; a row with a null doc_id gets
a fingerprint and never names a component unless all its group is null; rows with one doc_id are told apart by their text; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgauge.llm.common import table, written
from hopgauge.llm.graph import components

#: Fingerprints at an anchor from which on it is divided.
MOST = 2048
#: Replicas of a fingerprint at the anchors of the first two parts within 2 bits, on average.
REPLICATION = 61
#: Generator polynomial of the binary Golay code of length 23, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GOLAY = 0b101011100011
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned; a bit is 1 if it is set in more than half of the XXH64 (seed 42) of the text's word shingles, repeats included."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle:
        digests = [xxh64_digest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - shingle].tolist()]
        digests = [xxh64_digest(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(digests), BLOCK):
        ones += np.unpackbits(np.frombuffer(b"".join(digests[k : k + BLOCK]), np.uint8).reshape(-1, 8), axis=1).sum(0, np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, k (xxhash64 of the text), fingerprint (signed long)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "k", "fingerprint"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), text.alias("text")).mapInArrow(of, "doc_id long, k long, fingerprint long")


@dataclass(frozen=True)
class Code:
    """A perfect cyclic code on some bits of a fingerprint."""

    shift: int
    length: int
    generator: int
    radius: int

    @property
    def checks(self) -> int:
        return self.generator.bit_length() - 1

    def part(self, x: np.ndarray) -> np.ndarray:
        return ((x >> np.uint64(self.shift)) & np.uint64((1 << self.length) - 1)).astype(np.int64)


#: The parts of a fingerprint: anchors, and what divides crowded ones. x^4 + x + 1 generates the Hamming code (fixed value).
FIRST = (Code(0, 23, GOLAY, 3), Code(23, 23, GOLAY, 3))
SECOND = (Code(46, 15, 0b10011, 1), Code(61, 3, 1, 0))


def _syndrome(x: np.ndarray, code: Code = FIRST[0]) -> np.ndarray:
    """Remainder of words by the generator: 0 for code words."""
    x = x.copy()
    for k in range(code.length - 1, code.checks - 1, -1):
        x ^= ((x >> k) & 1) * (code.generator << (k - code.checks))
    return x


@cache
def _patterns(bits: int, code: Code = FIRST[0]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For e = 0..bits, the error patterns of weight radius + e (e = 0: up to the radius) by syndrome: patterns, first of each syndrome, number."""
    out = []
    for e in range(bits + 1):
        weights = range(code.radius + 1) if e == 0 else [code.radius + e]
        found = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(code.length), w)], np.int64)
        syndrome = _syndrome(found, code) if len(found) else found
        order = np.argsort(syndrome, kind="stable")
        number = np.bincount(syndrome, minlength=1 << code.checks)
        out.append((found[order], np.concatenate(([0], np.cumsum(number)[:-1])), number))
    return out


def anchors(x: np.ndarray, bits: int, codes: tuple[Code, Code] = FIRST, slack: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: index, anchor, whether it is the home, bits that are left, a row for each replica. slack: bits that are left to each, at most bits."""
    parts = [c.part(x) for c in codes]
    syndromes, rows = [_syndrome(p, c) for p, c in zip(parts, codes, strict=True)], []
    for e in range(bits + 1):
        for f in range(bits + 1 - e):
            (p, p0, pn), (q, q0, qn) = _patterns(bits, codes[0])[e], _patterns(bits, codes[1])[f]
            n, m = pn[syndromes[0]], qn[syndromes[1]]
            if slack is not None:
                n = np.where(e + f <= slack, n, 0)
            index = np.repeat(np.arange(len(x)), n * m)
            k = np.arange(len(index)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            one = parts[0][index] ^ p[p0[syndromes[0][index]] + k // m[index]]
            two = parts[1][index] ^ q[q0[syndromes[1][index]] + k % m[index]]
            anchor = (one >> codes[0].checks) << (codes[1].length - codes[1].checks) | two >> codes[1].checks
            left = np.full(len(index), bits) if slack is None else slack[index]
            rows.append((index, anchor, np.full(len(index), e == f == 0), left - e - f))
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True))


def _stars(anchor: np.ndarray, x: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the local components of each anchor's rows (sorted by anchor): member, its component's first member."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    end = np.repeat(np.r_[starts[1:], len(anchor)], np.diff(np.r_[starts, len(anchor)]))
    left, right, k = [], [], 1
    i = np.flatnonzero(np.arange(len(anchor)) + k < end)
    while len(i):
        near = i[(np.bitwise_count(x[i] ^ x[i + k]) <= bits) & (home[i] | home[i + k]) & (x[i] != x[i + k])]
        left.append(near)
        right.append(near + k)
        k += 1
        i = i[i + k < end[i]]
    if not left or not (a := np.concatenate(left)).size:
        return x[:0], x[:0]
    b, label = np.concatenate(right), np.arange(len(x))
    while True:  # the smallest label spreads over links; labels follow labels, so the rounds are few
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(x)))
    return x[member], x[label[member]]


REPLICAS = "key long, x long, home boolean, slack int"
COMPARED = "a long, b long, key long, home boolean, slack int"


def _replicate(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column(0).to_numpy()
        for k in range(0, len(every), 4096):
            index, anchor, home, left = anchors(every[k : k + 4096].view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(every[k : k + 4096][index]), pa.array(home), pa.array(left.astype(np.int32))], ["key", "x", "home", "slack"])


def _divide(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replicas at an anchor as replicas at its divisions."""
    for batch in batches:
        key, x, home, slack = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        for k in range(0, len(x), 4096):
            part = slice(k, k + 4096)
            index, anchor, at_home, left = anchors(x[part].view(np.uint64), bits, SECOND, slack[part].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key[part][index] << 14 | anchor), pa.array(x[part][index]), pa.array(home[part][index] & at_home), pa.array(left.astype(np.int32))], ["key", "x", "home", "slack"])


def _compare(bits: int, most: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of each anchor's rows (sorted by anchor); the rows of anchors with more than most, if it is given, as they are (b is null)."""

    def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray, home: np.ndarray, slack: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        rest = [pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.int32())] if b is not None else [pa.array(key), pa.array(home), pa.array(slack)]
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.nulls(n, pa.int64()) if b is None else pa.array(b.view(np.int64)), *rest], ["a", "b", "key", "home", "slack"])

    rest: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int32))
    crowded = None  # the anchor whose rows are on their way to its divisions
    last = False
    while not last:
        batch = next(batches, None)
        last = batch is None
        if not last:
            new = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy())
            rest = tuple(np.concatenate(c) for c in zip(rest, new, strict=True))
        if not len(rest[0]):
            continue
        anchor = rest[0]
        before = crowded  # its last rows may be at hand together with the first of the next crowded anchor
        cut = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
        if most is not None and (len(anchor) - cut > most or anchor[-1] == crowded):
            crowded, cut = anchor[-1], len(anchor)
        now, rest = tuple(c[:cut] for c in rest), tuple(c[cut:] for c in rest)
        anchor, x, home, slack = now
        starts, number = np.unique(anchor, return_index=True, return_counts=True)[1:]
        many = np.repeat((number > most) | (anchor[starts] == before) | (anchor[starts] == crowded), number) if most is not None else np.zeros(len(anchor), bool)
        if many.any():
            yield out(x[many], None, anchor[many], home[many], slack[many])
        if not many.all():
            yield out(*_stars(anchor[~many], x[~many], home[~many], bits), anchor[:0], home[:0], slack[:0])


def links(classes: DataFrame, bits: int = 2) -> DataFrame:
    """a, b: links (fingerprints as signed longs) that connect what is within bits; classes: distinct fingerprints (a written table)."""
    most = MOST

    def met(replicas: DataFrame, limit: int | None) -> DataFrame:
        return replicas.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_compare, bits, limit), COMPARED)

    replicas = classes.select("fingerprint").mapInArrow(partial(_replicate, bits), REPLICAS)
    if classes.count() * REPLICATION > most << 23:  # crowded on average
        return met(replicas.mapInArrow(partial(_divide, bits), REPLICAS), None).select("a", "b").distinct()
    found = written(met(replicas, most), "near")
    crowd = found.where("b IS NULL").select("key", F.col("a").alias("x"), "home", "slack").mapInArrow(partial(_divide, bits), REPLICAS)
    return found.where("b IS NOT NULL").select("a", "b").unionByName(met(crowd, None).select("a", "b")).distinct()


def _named(docs: DataFrame, shingle: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, k (tells apart rows of one doc_id), fingerprint of every row; fingerprint, component, component_id of every fingerprint."""
    found = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "classes")
    groups = components(links(classes, bits)).withColumnRenamed("node", "fingerprint")
    named = classes.join(groups, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    return found, named.join(named.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("fingerprint", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (signed long), component_id (the smallest doc_id reachable)."""
    found, named = _named(docs, shingle, bits)
    return found.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def first_rows(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id (of those the one with the least text hash, once); rows without a doc_id stay.

    members: doc_id, k (xxhash64 of the text), component.
    """
    first = members.where("doc_id IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "k")).alias("of")).select("of.*").distinct()
    long = "_" * max(len(c) for c in docs.columns)
    d, k = "_d" + long, "_k" + long
    keyed = docs.withColumns({d: F.col("doc_id").cast("long"), k: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    kept = keyed.hint("merge").join(first.select(F.col("doc_id").alias(d), F.col("k").alias(k)), [d, k], "left_semi").dropDuplicates([d, k])
    return kept.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """docs without those that are not the first of their component; see ``first_rows``."""
    found, named = _named(docs, shingle, bits)
    return first_rows(docs, found.join(named, "fingerprint").select("doc_id", "k", "component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
