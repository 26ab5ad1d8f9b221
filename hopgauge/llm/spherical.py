"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are the code words of a structured random product code: the vector's components fall into two blocks, each
block has its own random unit vectors, and a direction is any choice of one from each block. A vector belongs to every direction
whose inner product with it exceeds a threshold; list decoding finds them all without trying each direction: one block's products are
sorted, and for each of the other's only those that reach the threshold are read. A vector that few directions point near to
(fewer than LEAST) gets a lower threshold, in fixed steps, as do the vectors around it. Vectors join on directions, and every pair
that meets is verified by its cosine in double precision.

Size of the code and threshold follow the number of vectors, so that about ``crowd`` random vectors share a direction and a vector
has about ``filters`` of them; what a vector does is then constant while the table grows. A pair counts at its first common
direction only. Equal vectors are one before that. A direction with many vectors (a cluster) is cut into blocks of about
BLOCK by hash, and every pair of blocks is compared in its own group, so no group is large and no vector is left out.
What leaves a group is a row for each vector that links there: how many links, and the first vector of its local component.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths never
link; a null vec_id links with nothing and has a null component; rows of one vec_id are different vectors with one component; labels and other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgauge.llm.common import table, written
from hopgauge.llm.graph import components

PARTS, BLOCK, SEED = 2, 1024, 20240229
#: Directions that a vector has at least, and by how many standard deviations the threshold goes down at a time until then.
LEAST, STEP = 16, 0.25


class Code:
    """A product code for vectors of dim components; size unit vectors in each block."""

    def __init__(self, dim: int, size: int, z: float) -> None:
        rng = np.random.default_rng((SEED, dim, size))
        self.cuts = [dim * k // PARTS for k in range(PARTS + 1)]
        self.words = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            w = rng.normal(size=(size, b - a))
            self.words.append(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300))
        self.unit = np.sqrt(PARTS / dim)  # standard deviation of a random vector's sum over blocks
        self.z, self.size = z, size

    def decode(self, vector: np.ndarray) -> np.ndarray:
        """Sorted numbers of all directions whose sum with a unit vector reaches the threshold."""
        left, right = (w @ vector[s:e] for w, s, e in zip(self.words, self.cuts, self.cuts[1:], strict=False))
        order, z = np.argsort(right), self.z
        while True:
            at = np.searchsorted(right[order], z * self.unit - left)
            n = self.size - at
            if (total := n.sum()) >= min(LEAST, self.size**2):
                break
            z -= STEP
        inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
        return np.sort(np.repeat(np.arange(self.size), n) * self.size + order[inner])


@cache
def code(dim: int, size: int, z: float) -> Code:
    return Code(dim, size, z)


def plan(n: int, crowd: int, filters: int) -> tuple[int, float]:
    """Unit vectors in a block, and threshold in standard deviations, for n vectors."""
    share = min(0.5, crowd / max(n, 1))
    return max(2, int(np.ceil((filters / share) ** (1 / PARTS)))), NormalDist().inv_cdf(1 - share)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    out = []
    for v in column:
        x = v.as_py()
        x = None if not x or any(c is None for c in x) else np.array(x, np.float64)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def met_before(lists: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Matrix of which lists of directions have any in common."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, which, number = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = np.cumsum(number > 1) - 1
    row, which = row[number[which] > 1], shared[which[number[which] > 1]]
    out = np.zeros((len(lists), len(lists)), bool)
    for k in range(0, int((number > 1).sum()), columns):
        part = (which >= k) & (which < k + columns)
        has = np.zeros((len(lists), columns), np.float32)
        has[row[part], which[part] - k] = 1
        out |= has @ has.T > 0
    return out


def _classes(embeddings: DataFrame, kind: str) -> DataFrame:
    """vec_id, key (of equal vectors; null: links with nothing), vector (binary, of the numpy type kind)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            raw = [None if i is None or x is None else x.astype(kind).tobytes() for i, x in zip(batch.column(0).to_pylist(), _vectors(batch.column(1)), strict=True)]
            keys = [None if x is None else blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "vector"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(read, "vec_id long, key binary, vector binary")


def _found(first: DataFrame, kind: str, size: int, z: float, cosine: float) -> DataFrame:
    """node, links, root of every vector (id, copies, vector) that links in a group; a pair of vectors counts in one group only."""

    width = np.dtype(kind).itemsize

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("vector").to_pylist()
            for k in range(0, len(every), 256):  # a batch of replicas stays small
                raw = every[k : k + 256]
                dims = np.array([len(x) // width for x in raw], np.int32)
                lists = [code(d, size, z).decode(_units([x], kind)[0]) for d, x in zip(dims.tolist(), raw, strict=True)]
                row = np.repeat(np.arange(len(raw)), [len(x) for x in lists])
                rest = batch.slice(k, len(raw)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(dims[row]), pa.array(np.concatenate(lists)), *rest.columns], ["dim", "direction", *rest.schema.names])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def links() -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
            if len(held) < 2:
                return None
            ids, copies, raw, side = (list(c) for c in zip(*held, strict=True))
            ids, copies, side, unit = np.array(ids), np.array(copies), np.array(side), _units(raw, kind)
            near = np.triu(unit @ unit.T >= cosine, 1)
            if group[2] != group[3]:
                near &= side[:, None] != side[None, :]
            a, b = np.nonzero(near)
            if not len(a):
                return None
            machine = code(len(raw[0]) // width, size, z)
            some = np.unique(np.r_[a, b])
            lists = [x[x < group[1]] for x in (machine.decode(_units([raw[i]], kind)[0]) for i in some.tolist())]
            met = met_before(lists)[np.searchsorted(some, a), np.searchsorted(some, b)]
            a, b = a[~met], b[~met]
            n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
            np.add.at(n, a, copies[b])
            np.add.at(n, b, copies[a])
            while True:
                new = label.copy()
                np.minimum.at(new, a, label[b])
                np.minimum.at(new, b, label[a])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            linked = np.flatnonzero(n)
            return ids[linked], n[linked], ids[label[linked]]

        def out(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in x], ["node", "links", "root"])

        for batch in batches:
            for *key, i, n, raw, side in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if tuple(key) != group:
                    if group and (x := links()):
                        yield out(x)
                    held, group = [], tuple(key)
                held.append((i, n, raw, side))
        if group and (x := links()):
            yield out(x)

    # sizes first, by a pass over the directions alone: the vectors' replicas are then shuffled once and never stored
    sizes = first.select("vector").mapInArrow(decoded, "dim int, direction long, vector binary").select("dim", "direction")
    members = first.mapInArrow(decoded, "dim int, direction long, id long, copies long, vector binary")
    crowded = sizes.groupBy("dim", "direction").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    crowded = written(crowded, "crowded")
    dealt = members.join(crowded, ["dim", "direction"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("dim", "direction", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "id", "copies", "vector", "side")
    group = ["dim", "direction", "one", "two"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "node long, links long, root long")


def near_vectors(embeddings: DataFrame, cosine: float = 0.9, crowd: int = 128, filters: int = 64) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    kind = "<f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = written(_classes(embeddings, kind), "vectors")
    groups = written(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "distinct")
    size, z = plan(groups.count(), crowd, filters)
    found = written(_found(groups.select("id", "copies", "vector"), kind, size, z, cosine), "caps-links")
    named = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), "component")
    links = found.groupBy(F.col("node").alias("id")).agg(F.sum("links").alias("links"))
    of = groups.select("key", "id", "copies").join(links, "id", "left").join(named, "id", "left")
    of = of.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", "key").join(of, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(node, to_) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT node, b FROM reach JOIN links ON to_ = a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(to_) AS component_id, vec_id = min(to_) AS kept FROM v JOIN reach ON node = vec_id GROUP BY vec_id
"""
