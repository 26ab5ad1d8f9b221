"""Ranked lexical search: the best documents of each item, found by sequential reads of impact-sorted lists with score intervals (NRA).

Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. A list holds, for one term, every document
with it and the term's impact there, the part that one occurrence in an item adds to the document's score.

Reading. All lists are read in step from the highest impacts down: round r reads what lies between two cuts in files that are sorted
by impact, so that Parquet skips the rest. Cuts come from a histogram of the impacts; rounds grow by GROWTH. Nothing is looked up by document.

Intervals. A document's lower bound for an item is the sum of what was read. No unread entry exceeds the cut, so its upper bound adds, for
each of the item's lists in which it was not met and that is not read to its end, the cut less one or the list's highest impact
if that is lower. The lists where it was met all have the same bound there, the cut less one, until they end; so a candidate needs no set of
lists, only the sum of the item's term counts over the lists where it was met, by the round in which they end.

Candidates whose upper bound is below the k-th lower bound of their item, or equals it with a higher doc_id, go. So does every document met from then on
that can't reach it any more: once what an unmet one could reach is too low, none comes in. (One that went and is met again counts from nothing; its
lower bound stays below the k-th.) An item is done when no unmet document can come in and all its candidates have an interval of one value, that is,
when membership, ties and final scores are known; its lists are not read for it in further rounds.

Sizes. Documents are read once, each becomes one row of counts; terms of no item are left out by a bit table of fixed size (FILTER) before
anything is shuffled, and exactly afterwards. A round has one exchange, of the entries read and the candidates, by document; pairs of
documents and items exist only behind it, summed up in place, and those that can't win are not written. Items are taken in blocks of about DEMANDS terms,
which are broadcast; a block that is larger, as one item's text may be, is joined by Spark's choice. The driver holds the bit table, the
histogram (at most a few hundred rows), totals, and the sizes of blocks. The k best of an item are found with Spark's limit before the exchange.

Defined results: null and empty texts hold no terms and count for nothing; null doc_ids are documents and come first among equals;
repeated rows are documents of their own; each row of items is an item of its own, so repeated item_ids give repeated rankings; items without terms
or without a document that scores above 0 have no rows; empty tables give an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopgauge.llm.common import partitions, spent, table, written

#: Separators become blanks and A-Z lower case; all bytes beyond ASCII belong to terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bits of the table that tells terms of items from most others.
FILTER = 1 << 20
#: The first round reads this share of all entries, each further one so many times as much.
FIRST, GROWTH = 1 / 256, 4
SLICE = 1 << 16
#: Terms of the items of a block, about; blocks of up to twice as many (of some 60 bytes) are broadcast.
DEMANDS = 1 << 16
RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(FOLD).split() if text else []


def counted(rows: DataFrame, name: str, wanted: bytes | None = None) -> DataFrame:
    """key (of the row), id, n (terms), terms and counts (arrays), of rows (id, text) that have terms; with ``wanted`` only terms whose bit is set there."""
    shipped = rows.sparkSession.sparkContext.broadcast(wanted)  # FILTER bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = shipped.value, FILTER - 1
        for batch in batches:
            texts, first = batch.column(1).cast(pa.binary()), 0
            lengths, sizes, terms, counts = [], [], [], []
            for k, text in enumerate(texts):
                words = terms_of(text.as_py())
                found = Counter(words)
                if bits is not None:
                    found = {t: n for t, n in found.items() if bits[zlib.crc32(t) & mask]}
                lengths.append(len(words))
                sizes.append(len(found))
                terms += found.keys()
                counts += found.values()
                if len(terms) >= SLICE or k + 1 == batch.num_rows:
                    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                    arrays = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lengths)), pa.array(lengths, pa.int64()), *arrays], ["id", "n", "terms", "counts"])
                    first, lengths, sizes, terms, counts = k + 1, [], [], [], []

    out = rows.mapInArrow(count, "id long, n long, terms array<string>, counts array<long>").where("n > 0")
    return written(out.select(F.monotonically_increasing_id().alias("key"), "*"), name)


def bit_table(terms: DataFrame) -> bytes:
    """A byte for each value that crc32 of a term has modulo FILTER: at most FILTER numbers come to the driver."""
    bits = bytearray(FILTER)
    for (k,) in terms.select((F.crc32("term") % FILTER).alias("bit")).distinct().collect():
        bits[k] = 1
    return bytes(bits)


def entries(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each term of a counted row: columns, term, count."""
    return rows.select(*columns, F.explode(F.arrays_zip("terms", "counts")).alias("e")).select(*columns, F.col("e.terms").alias("term"), F.col("e.counts").alias("count"))


def cuts(impacts: DataFrame) -> list[int]:
    """Falling cuts, the last is 1: rounds read entries from a cut up to the one before."""
    level = F.floor(F.log2("impact") * 4).cast("int").alias("level")
    sizes = sorted(impacts.groupBy(level).count().collect(), reverse=True)  # at most 4 x 63 levels
    total = sum(n for _, n in sizes)
    found, seen, goal = [], 0, total * FIRST
    for at, n in sizes:
        seen += n
        if seen >= goal and at > 0:
            found.append(math.ceil(2 ** (at / 4)))
            goal = max(goal * GROWTH, seen * 2)
    return [c for c in found if c > 1] + [1] if total else []


def lists(documents: DataFrame, words: DataFrame) -> DataFrame:
    """term, key, doc_id, impact of all entries with an impact above 0, each file sorted by falling impact. documents: counted; words: term (distinct)."""
    n_docs, n_terms = documents.agg(F.count("*"), F.sum("n")).first()
    found = entries(documents, "key", "id", "n").withColumnRenamed("id", "doc_id")
    df = found.groupBy("term").agg(F.count("*").alias("df")).join(words, "term")
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = written(df.select("term", weight.alias("w")).where("w > 0"), "weights")
    m = F.lit(75) + F.expr(f"(25L * n * {n_docs or 0}L) div {n_terms or 1}L")
    scored = found.withColumn("m", m).join(weights, "term")
    scored = scored.select("term", "key", "doc_id", F.expr("w * ((1000000000L * count) div (1000L * count + 12L * m))").alias("impact")).where("impact > 0")
    return written(scored.sortWithinPartitions(F.desc("impact")), "lists")


def best_first() -> list[Column]:
    return [F.desc("lower"), F.col("doc_id").asc_nulls_first(), F.col("key")]


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k rows of each item with the highest lower bounds, with their rank."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(*best_first()))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def resolved(hits: DataFrame, demands: DataFrame, edges: list[int], k: int, small: bool) -> list[DataFrame]:
    """Written tables (item, key, doc_id, lower) that hold the k best of each item with their scores, and perhaps some that tie. small: demands may be broadcast."""
    sums = [f"met{e}" for e in range(1, len(edges) + 1)]
    columns = ["item", "key", "doc_id", "lower", *sums]
    deal = F.broadcast if small else (lambda df: df)
    n = partitions(hits.sparkSession)
    gain = [(F.col("times") * F.col("impact")).alias("lower"), *[F.when(F.col("last") == e, F.col("times")).otherwise(0).alias(s) for e, s in enumerate(sums, 1)]]
    no_bar = [F.lit(None).cast("long").alias(c) for c in ("bar", "bar_id", "bar_key")]
    open_ = written(demands.select("item").distinct().select("item", *no_bar), "open")
    candidates = state = None
    done: list[DataFrame] = []
    for r, cut in enumerate(edges, 1):
        read = hits.where(F.col("impact") >= cut)
        read = read.where(F.col("impact") < edges[r - 2]) if r > 1 else read
        # entries and candidates meet by document; they are few beside the pairs of documents and items, which are made and summed up behind the exchange
        read = read.select("key", "doc_id", "term", "impact")
        read = read.withColumn("known", F.lit(None).cast(f"struct<{', '.join(f'{c}:bigint' for c in ('item', *columns[3:]))}>"))
        if r > 1:
            read = read.union(candidates.select("key", "doc_id", F.lit(None).cast("string"), F.lit(None).cast("long"), F.struct("item", *columns[3:])))
        wanted = demands.join(F.broadcast(open_) if small else open_, "item")
        met_now = read.repartition(n, "key").join(deal(wanted.select(demands.columns)), "term", "left").where("known IS NOT NULL OR item IS NOT NULL")
        gained = met_now.select(F.coalesce("known.item", "item").alias("item"), "key", "doc_id", *[F.coalesce(F.col(f"known.{c}"), g).alias(c) for c, g in zip(columns[3:], gain, strict=True)])
        summed = gained.groupBy("key", "item").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in columns[3:]])
        # what an unmet document could still reach; where one was met, an unended list reaches the cut less one
        unread = F.when(F.col("last") > r, F.col("times") * F.least(F.lit(cut - 1), "most")).otherwise(0)
        limits = written(wanted.groupBy("item", "bar", "bar_id", "bar_key").agg(F.sum(unread).alias("rest")), f"limits-{r}")
        met = reduce(lambda a, b: a + b, [F.col(s) for s in sums[r:]], F.lit(0))
        upper = F.col("lower") + F.col("rest") - (cut - 1) * met
        behind = F.struct(F.col("doc_id").isNotNull(), "doc_id", "key") > F.struct(F.col("bar_id").isNotNull(), "bar_id", "bar_key")
        # against the k-th candidate of the round before first, so that less is written
        possible = F.col("bar").isNull() | (F.col("upper") > F.col("bar")) | ((F.col("upper") == F.col("bar")) & ~behind)
        bounds = lambda rows, bars: rows.join(deal(bars), "item").withColumn("upper", upper).where(possible)  # noqa: E731, B023
        before, state = state, written(bounds(summed, limits).select(columns), f"candidates-{r}")
        kth = top(state, k).where(F.col("rank") == k).select("item", F.col("lower").alias("bar"), F.col("doc_id").alias("bar_id"), F.col("key").alias("bar_key"))
        bars = written(limits.select("item", "rest").join(kth, "item", "left"), f"bars-{r}")
        left = bounds(state, bars)
        unsettled = left.groupBy("item").agg((F.max(F.col("upper") - F.col("lower")) > 0).alias("unsettled"))
        taking = (F.col("rest") > 0) & (F.col("bar").isNull() | (F.col("rest") >= F.col("bar")))
        still = bars.join(unsettled, "item", "left").where(taking | F.coalesce("unsettled", F.lit(False)))
        old, open_ = open_, written(still.select("item", "bar", "bar_id", "bar_key"), f"open-{r}")
        done.append(written(left.join(open_.select("item"), "item", "left_anti").select("item", "key", "doc_id", "lower"), f"done-{r}"))
        spent(old, limits, *([before] if before is not None else []))
        candidates = left.join(open_.select("item"), "item", "left_semi")
        if r == len(edges) or open_.isEmpty():
            break
    spent(state, open_)
    return done


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    asked = counted(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")), "items")
    demands = entries(asked, "key").withColumnsRenamed({"key": "item", "count": "times"})
    words = written(demands.select("term").distinct(), "terms")
    documents = counted(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "counts", bit_table(words))
    hits = lists(documents, words)
    spent(documents)
    edges = cuts(hits)
    if not edges:
        return spark.createDataFrame([], RESULT)
    # by item and list: the highest impact, and the round (from 1) that reads the list's last entry
    ends = hits.groupBy("term").agg(F.max("impact").alias("most"), F.min("impact").alias("least"))
    last = reduce(lambda a, b: a + b, [F.when(F.col("least") < cut, 1).otherwise(0) for cut in edges]) + 1
    demands = written(demands.join(ends, "term").select("item", "term", "times", "most", last.alias("last")), "demands")
    # items in blocks whose terms may be broadcast, about
    n = -(-demands.count() // DEMANDS)
    block = F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")
    sizes = dict(demands.groupBy(block).count().collect())  # a row for each block
    done = [d for b, size in sizes.items() for d in resolved(hits, demands.where(block == b), edges, k, size <= 2 * DEMANDS)]
    final = top(reduce(DataFrame.union, done), k).join(asked.select(F.col("key").alias("item"), F.col("id").alias("item_id")), "item")
    out = written(final.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("lower").alias("score")), "ranking")
    spent(asked, words, hits, demands, *done)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS times FROM b GROUP BY ALL),
t AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
e AS (SELECT k, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
p AS (SELECT k, doc_id, n, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, t GROUP BY term),
s AS (SELECT i, item_id, k, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score FROM p JOIN w USING (term) JOIN q USING (term), t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST, k) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
