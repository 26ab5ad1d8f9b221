"""Near copies by SimHash anchors: texts whose sets of word shingles overlap (Jaccard) by ``similarity`` or more.

``simhash.near_duplicates`` links what differs in 2 of 64 bits; an overlap of 0.8 turns about 15 % of all bits. So here the
fingerprint of the set of shingles has BLOCKS blocks of 23 bits, the anchors are the code words of the binary Golay code of
each block, and a row is sent to its home in every block. Rows that meet are candidates if SKETCH further bits differ in no more than ``near_bits``
and their sets' sizes allow the overlap; candidates link if the exact overlap of their sets says so.

Links are exact, finding them is not: at an overlap of 0.8 two rows share a block's home with probability 0.12 (0.14 at 0.83, 0.18 at
0.87). Two passes over the anchors: the first compares bits and leaves the rows that have candidates, in groups that candidates connect; the second sends a group
the sets of its rows, once for each row and not for each pair, and checks every candidate that the links found there do not already connect.
What leaves a group is a star for each of its components. Anchors with more than MOST rows, and groups with more than WEIGHT shingles, are divided
into parts, and each pair of parts meets in a task of its own, so memory is bounded. Rows at an anchor are about the number of different texts / 4096.

Defined results: rows with the same set are one node; texts without words have the same (empty) set; texts of fewer words than a shingle
are one shingle; null and repeated doc_ids are treated as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgauge.llm.common import forget, frugal, spent, written
from hopgauge.llm.graph import components
from hopgauge.llm.simhash import _patterns, _syndrome, first_rows

BLOCKS = 24
#: Bits for the comparison at an anchor, and the deviations from their mean number at the wanted overlap that candidates may have.
SKETCH, DEVIATIONS = 256, 3.2
#: Rows of an anchor, and shingles of a group, that meet in one task.
MOST, WEIGHT = 1 << 15, 1 << 22
#: Words of 64 bits: the blocks' and those for the comparison.
WORDS = -(-BLOCKS * 23 // 64) + SKETCH // 64
_ODD = np.random.default_rng(5).integers(0, 2**63, WORDS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles whose bits are counted at once, and rows that are compared with their anchor's at once.
PART, ROWS = 4096, 256


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted hashes (XXH64, seed 42) of the text's distinct word shingles, words as in ``simhash.fingerprint``."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = {xxh64_intdigest(b" ".join(words[k : k + shingle]), 42) for k in range(max(1, len(words) - shingle + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def node_of(hashes: np.ndarray) -> int:
    """Signed hash of a set of shingles."""
    from xxhash import xxh3_64_intdigest

    return int(np.array(xxh3_64_intdigest(hashes.tobytes()), np.uint64).view(np.int64))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks (23-bit numbers) and the words for the comparison; a bit is 1 if it is set in more than half of the hashes."""
    ones = np.zeros(WORDS * 64, np.int64)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), PART):
            mixed = hashes[k : k + PART, None] * _ODD
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, np.int32)
    bits = 2 * ones > len(hashes)
    return bits[: BLOCKS * 23].reshape(BLOCKS, 23) @ (1 << np.arange(23)), np.packbits(bits[-SKETCH:]).view(np.uint64)


def homes(blocks: np.ndarray) -> np.ndarray:
    """Home of each block: the 12 message bits of the code word within radius 3."""
    patterns, first, _ = _patterns(0)[0]
    return (blocks ^ patterns[first[_syndrome(blocks)]]) >> 11


def near_bits(similarity: float) -> int:
    """Bits of SKETCH that candidates may differ in; sets of equal size differ most at a given overlap."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(SKETCH * share + DEVIATIONS * np.sqrt(SKETCH * share * (1 - share)))


def _nodes(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, k (tells apart rows of one doc_id), node (the text's set), n (its size), sketch (words for the comparison), at (anchors)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # nothing is remembered here
        for batch in batches:
            nodes, sizes, sketches, at = [], [], [], []
            for text in batch.column(2):
                hashes = shingles(text.as_py(), shingle)
                blocks, sketch = signature(hashes)
                nodes.append(node_of(hashes))
                sizes.append(len(hashes))
                sketches.append(sketch.tobytes())
                at.append((homes(blocks) | np.arange(BLOCKS) << 12).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BLOCKS), pa.array(np.concatenate(at or [np.zeros(0, np.int32)])))
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k", "node", "n", "sketch", "at"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), text.alias("text")).mapInArrow(frugal(of), "doc_id long, k long, node long, n int, sketch binary, at array<int>")


def _met(part: Column, parts: Column) -> Column:
    """Where a row of a part meets those of all parts: a struct (low, high) for each pair of parts."""
    return F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(F.least(part, q).alias("low"), F.greatest(part, q).alias("high"))))


def _by_key(batches: Iterator[pa.RecordBatch], of: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """of(the rows of a key), for batches sorted by their first column."""
    held: list[pa.RecordBatch] = []  # rows of the last key so far

    def done() -> Iterator[pa.RecordBatch]:
        if held and (out := of(pa.concat_batches(held))) is not None:
            yield out
        held.clear()

    for batch in batches:
        key = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist() if len(key) else []
        for s, e in zip(starts, [*starts[1:], len(key)], strict=False):
            if held and held[0].column(0)[0].as_py() != key[s]:
                yield from done()
            held.append(batch.slice(s, e - s))
    yield from done()


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def _near(sketch: np.ndarray, n: np.ndarray, part: np.ndarray, s: int, e: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows s to e and each before e: bits that differ; whether the one before is a candidate. part: -1, or only rows of different parts count."""
    apart = np.zeros((e - s, e), np.uint16)
    for w in range(sketch.shape[1]):
        apart += np.bitwise_count(sketch[s:e, w, None] ^ sketch[None, :e, w])
    near = (apart <= near_bits(similarity)) & (np.arange(e)[None, :] < np.arange(s, e)[:, None])
    near &= np.minimum(n[s:e, None], n[None, :e]) >= similarity * np.maximum(n[s:e, None], n[None, :e])
    return apart, near & ((part[s:e, None] != part[None, :e]) | (part[s:e, None] < 0))


def _join(label: np.ndarray, rows: np.ndarray) -> None:
    """Gives the rows and all that share a label with one of them the smallest of their labels."""
    labels = np.unique(label[rows])
    if len(labels) > 1:
        label[np.isin(label, labels)] = labels[0]


def groups_at(node: np.ndarray, n: np.ndarray, sketch: np.ndarray, part: np.ndarray, similarity: float, weight: int) -> tuple[np.ndarray, ...]:
    """Of the rows of one anchor those with candidates: position, the first node of the group that candidates connect, part of it (about weight shingles each), number of parts."""
    label, met = np.arange(len(node)), np.zeros(len(node), bool)
    for s in range(0, len(node), ROWS):
        near = _near(sketch, n, part, s, min(s + ROWS, len(node)), similarity)[1]
        met[: near.shape[1]] |= near.any(0)
        for i in np.flatnonzero(near.any(1)):
            met[s + i] = True
            j = np.flatnonzero(near[i])
            if (label[j] != label[s + i]).any():
                _join(label, np.r_[j, s + i])
    rows = np.flatnonzero(met)
    rows = rows[np.argsort(label[rows], kind="stable")]
    own = label[rows]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(rows) else rows
    length = np.diff(np.r_[starts, len(rows)])
    total = np.cumsum(n[rows])
    before = np.repeat(total[starts] - n[rows[starts]], length) if len(rows) else total
    parts = (total - before - 1).clip(0) // weight
    total = np.repeat(np.maximum.reduceat(parts, starts) + 1, length) if len(rows) else parts
    return rows, node[own], parts, total


def meetings(classes: DataFrame, similarity: float) -> DataFrame:
    """meet (key of a group at an anchor), node, n, sketch, part (-1 where all pairs count): the rows that have candidates.

    classes: node, n, sketch, at, a row for each node.
    """
    weight = WEIGHT

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        if rows.num_rows == 1:
            return None
        node, n, part = (rows.column(i).to_numpy() for i in (1, 2, 4))
        at, first, parts, total = groups_at(node, n.astype(np.int64), _sketches(rows.column(3)), part, similarity, weight)
        if not len(at):
            return None
        left = rows.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*left.columns[:4], pa.array(first), pa.array(parts.astype(np.int32)), pa.array(total.astype(np.int32))], ["cell", "node", "n", "sketch", "first", "part", "parts"])

    sent = classes.select(F.explode("at").alias("anchor"), "node", "n", "sketch")
    # at most BLOCKS x 4096 rows, whatever the input
    crowds = sent.groupBy("anchor").count().where(F.col("count") > MOST).select("anchor", F.ceil(F.col("count") / MOST).cast("int").alias("parts"))
    sent = sent.join(F.broadcast(crowds), "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    sent = sent.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).withColumn("pair", _met(F.col("part"), F.col("parts")))
    cell = F.shiftleft(F.col("anchor").cast("long"), 40) + F.shiftleft(F.col("pair.low").cast("long"), 20) + F.col("pair.high")
    lone = F.when(F.col("pair.low") == F.col("pair.high"), -1).otherwise(F.col("part")).alias("part")
    sent = sent.select(cell.alias("cell"), "node", "n", "sketch", lone).repartition("cell").sortWithinPartitions("cell", "node")
    found = sent.mapInArrow(frugal(lambda batches: _by_key(batches, compare)), "cell long, node long, n int, sketch binary, first long, part int, parts int")
    found = found.withColumn("pair", _met(F.col("part"), F.col("parts")))
    return found.select(F.xxhash64("cell", "first", "pair").alias("meet"), "node", "n", "sketch", lone)


def stars_at(n: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], part: np.ndarray, similarity: float) -> np.ndarray:
    """For each row of one group the first row that links reach. Candidates are checked from the closest on, save those already connected."""
    label = np.arange(len(sets))
    for s in range(0, len(sets), ROWS):
        apart, near = _near(sketch, n, part, s, min(s + ROWS, len(sets)), similarity)
        for i in np.flatnonzero(near.any(1)):
            j, own, number = np.flatnonzero(near[i]), sets[s + i], 1
            j = j[np.argsort(apart[i, j], kind="stable")]
            while len(j := j[label[j] != label[s + i]]):
                now, j = j[:number], j[number:]
                every = np.concatenate([sets[k] for k in now])
                hits = np.r_[0, np.cumsum(own[np.searchsorted(own, every).clip(max=len(own) - 1)] == every)]
                both = np.diff(hits[np.r_[0, np.cumsum(n[now])]])
                linked = now[both >= similarity * (n[now] + n[s + i] - both)]
                _join(label, np.r_[linked, s + i])
                number = min(4 * number, ROWS)
    return label


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node, shingles of each row of docs (node, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(frugal(of), "node long, shingles array<long>")


def _links(docs: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: stars that connect what overlaps enough. classes: node, doc_id, k of a row with that set, n, sketch, at."""

    def check(rows: pa.RecordBatch) -> pa.RecordBatch:
        node, n, part = (rows.column(i).to_numpy() for i in (1, 2, 4))
        values, ends = rows.column(5).values.to_numpy().view(np.uint64), rows.column(5).offsets.to_numpy()
        label = stars_at(n.astype(np.int64), _sketches(rows.column(3)), [values[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)], part, similarity)
        member = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[member]), pa.array(node[label[member]])], ["a", "b"])

    met = written(meetings(classes, similarity), "meetings")
    needed = classes.join(met.select("node").distinct(), "node", "left_semi").select(F.col("doc_id").alias("d"), "k", "node")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("d0"), F.xxhash64(text).alias("k0"), text.alias("text"))
    texts = keyed.join(needed, F.col("d0").eqNullSafe(F.col("d")) & (F.col("k0") == F.col("k"))).select("node", "text").dropDuplicates(["node"])
    sent = met.join(_sets(texts, shingle), "node").select("meet", "node", "n", "sketch", "part", "shingles").repartition("meet").sortWithinPartitions("meet", "node")
    links = written(sent.mapInArrow(frugal(lambda batches: _by_key(batches, check)), "a long, b long").distinct(), "stars")
    spent(met)
    return links


def _members(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, k, node of every row; node, component, component_id of every node."""
    found = written(_nodes(docs, shingle), "nodes")
    classes = found.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "k", "n", "sketch", "at")).alias("of"))
    classes = written(classes.select("node", "first", "of.*"), "classes")
    groups = components(_links(docs, classes, shingle, similarity))
    named = classes.select("node", "first").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return found, named.join(named.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("node", "component", "component_id")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable by links of at least similarity)."""
    found, named = _members(docs, shingle, similarity)
    return found.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without those that are not the first of their component; see ``simhash.first_rows``."""
    found, named = _members(docs, shingle, similarity)
    return first_rows(docs, found.select("doc_id", "k", "node").join(named, "node").select("doc_id", "k", "component"))
