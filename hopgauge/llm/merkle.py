"""A Merkle tree over a table of documents, with the proof of every row and the check of tampered rows.

Leaf: H (hex digest of SHA-256) of doc_id, source, lang, n_chars and text. Within each lang leaves stand in the order of doc_id; each FANOUT
neighbours become their H until one node, the lang's subroot, is left. Subroots stand in the order of lang (null first, then by
UTF-8 bytes) and are reduced to the root in the same way.

Coordinates come from bitmaps, no leaf is sorted. The doc_ids of a lang are a sparse bitmap: one word of 64 bits for each run of 64 ids
that occur (bit_or merges what the tasks have seen). A directory holds the leaves before each word: counts are summed
up for ids that share their higher bits (SHIFTS), and within each such prefix the counts of its at most 65,536 (words: 1,024) parts are
accumulated, so no window grows with the table, however ids are spread. A leaf's place is its word's count plus the set bits below its own.

Levels come from keyed slots: a node with slot s goes to slot s / FANOUT of the next level, where the at most FANOUT nodes of a slot are an array in
order. Going down again, each node hands its siblings and its own way up to its children; a row's proof, and what its changed leaf folds to, are computed
from these ways. Each level is a written table of the shared folder (the first has N / FANOUT rows), so a lost executor costs a step at most.

Defined results: null fields are `-` in the leaf. Null doc_ids come first in their lang and are never tampered with. Rows of equal
doc_id and lang stand in the order of their leaves; wholly equal rows are counted, take neighbouring slots and each get the proof of
their own. A null lang is a lang of its own, before the empty one. An empty table gives an empty table. Columns other than the five are
ignored. Hot langs, ids and copies are counted before they are shuffled, and slots are dealt by blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopgauge.llm.common import partitions, table, written

FANOUT = 8
#: Shifts of the directory's levels: ids that agree above them share a count. The first is the bitmap's word.
SHIFTS = (6, 16, 32, 48)
#: The word of null ids: below all others at every level of the directory.
NO_ID = -(1 << 58)
#: Slots are dealt in blocks of 2^BLOCK.
BLOCK = 12
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """H of the five fields, each with its length in bytes, or `-`."""
    strings = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in strings]))


def every_third(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


def before(part: str, whole: list[str]) -> Column:
    """Sum of n over the parts of the same whole that come before."""
    window = Window.partitionBy(*whole).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(window), F.lit(0))


def numbered(values: DataFrame, by: str) -> DataFrame:
    """Rows with their number in the order of ``by`` (nulls first), from the sizes of range partitions."""
    order = F.col(by).asc_nulls_first()
    dealt = written(values.repartitionByRange(partitions(values.sparkSession), order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id()), "numbered")
    dealt = dealt.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range partition
    first = sizes.select("part", before("part", []).alias("first"))
    return dealt.join(first, "part").select(*values.columns, (F.col("first") + F.col("place")).alias("number"))


def bitmaps(entries: DataFrame) -> DataFrame:
    """key, word, bits (ids of the word that occur), n (leaves), extras (bit, further leaves) of repeated ids; entries: key, word, bit, copies."""
    merged = entries.groupBy("key", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("copies").alias("n"))
    merged = written(merged, "bitmaps")
    uneven = merged.where(F.col("n") != F.bit_count("bits")).select("key", "word")
    repeated = entries.join(uneven, ["key", "word"]).groupBy("key", "word", "bit").agg((F.sum("copies") - 1).alias("more")).where("more > 0")
    extras = repeated.groupBy("key", "word").agg(F.collect_list(F.struct("bit", "more")).alias("extras"))  # at most 64 a word
    return written(merged.join(extras, ["key", "word"], "left"), "bitmaps")


def directory(words: DataFrame) -> DataFrame:
    """words with ``base``: the key's leaves before each word."""
    counts = [words.select("key", F.col("word").alias("part"), "n", "bits", "extras")]
    for low, high in zip(SHIFTS, SHIFTS[1:], strict=False):
        counts.append(counts[-1].groupBy("key", F.shiftright("part", high - low).alias("part")).agg(F.sum("n").alias("n")))
    based = counts[-1].withColumn("base", before("part", ["key"]))
    for k in range(len(SHIFTS) - 2, -1, -1):
        above = based.select("key", F.col("part").alias("whole"), F.col("base").alias("offset"))
        inner = counts[k].withColumn("whole", F.shiftright("part", SHIFTS[k + 1] - SHIFTS[k])).join(above, ["key", "whole"])
        based = inner.withColumn("base", F.col("offset") + before("part", ["key", "whole"])).drop("whole", "offset")
    return based.withColumnRenamed("part", "word")


def among_equals(entries: DataFrame, words: DataFrame) -> DataFrame:
    """key, word, bit, leaf, inner: how many leaves of the same id come before, for ids with several different leaves. An id may have any number: parts by the leaf's first 16 bits."""
    uneven = words.where(F.col("extras").isNotNull()).select("key", "word")
    rows = entries.join(uneven, ["key", "word"]).select("key", "word", "bit", "leaf", F.col("copies").alias("n"), F.substring("leaf", 1, 4).alias("part"))
    of = ["key", "word", "bit"]
    parts = rows.groupBy(*of, "part").agg(F.sum("n").alias("n"))
    first = parts.select(*of, "part", before("part", of).alias("first"))
    return rows.join(first, [*of, "part"]).select(*of, "leaf", (F.col("first") + before("leaf", [*of, "part"])).alias("inner")).where("inner > 0")


def placed(entries: DataFrame, words: DataFrame) -> DataFrame:
    """entries with ``slot``, the place of their first copy in the key."""
    inner = written(among_equals(entries, words), "equals")
    smaller = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, bit)"))))
    further = F.aggregate(F.coalesce("extras", F.array().cast("array<struct<bit:int,more:bigint>>")), F.lit(0).cast("long"), lambda s, e: s + F.when(e["bit"] < F.col("bit"), e["more"]).otherwise(0))
    ranked = entries.join(directory(words).select("key", "word", "bits", "extras", "base"), ["key", "word"])
    ranked = ranked.join(inner, ["key", "word", "bit", "leaf"], "left")
    return ranked.withColumn("slot", F.col("base") + smaller + further + F.coalesce("inner", F.lit(0)))


def spread(placed_: DataFrame) -> DataFrame:
    """A row for each slot, dealt by blocks of slots; copies are cut at blocks first, so that no task makes all of them."""
    block = F.explode(F.expr(f"sequence(shiftright(slot, {BLOCK}), shiftright(slot + copies - 1, {BLOCK}))"))
    cut = placed_.select("key", "n", "doc_id", "leaf", "changed", "slot", (F.col("slot") + F.col("copies")).alias("end"), block.alias("block"))
    cut = cut.withColumn("slot", F.greatest("slot", F.expr(f"shiftleft(block, {BLOCK})"))).withColumn("end", F.least("end", F.expr(f"shiftleft(block + 1, {BLOCK})")))
    cut = cut.repartition(partitions(placed_.sparkSession), "key", "block")
    return cut.select("key", "block", "n", "doc_id", "leaf", "changed", F.explode(F.expr("sequence(slot, end - 1)")).alias("slot"))


def runs_of(nodes: DataFrame, kept: list[str], within: list[str]) -> DataFrame:
    """key, slot, n (nodes of the key in this level), kids (in order), hash; nodes: key, slot, n, hash and what the kids keep. A lone node is handed on as it is."""
    kids = F.array_sort(F.collect_list(F.struct(F.col("slot").alias("at"), "hash", *kept)))
    runs = nodes.groupBy("key", *within, F.expr(f"slot div {FANOUT}").alias("parent"), "n").agg(kids.alias("kids"))
    joined = digest(F.array_join(F.transform("kids", lambda x: x["hash"]), ""))
    return runs.select("key", F.col("parent").alias("slot"), F.col("n").alias("below"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "kids", F.when(F.col("n") == 1, F.col("kids")[0]["hash"]).otherwise(joined).alias("hash"))


def reduced(nodes: DataFrame, kept: list[str], most: int, name: str, within: tuple[str, ...] = ()) -> list[DataFrame]:
    """The written runs of all levels, the lowest first; most: nodes of the largest key. A key whose one node is reached stays out of higher levels."""
    levels = [written(runs_of(nodes, kept, list(within)), f"{name}-1")]
    while (most := -(-most // FANOUT)) > 1:
        rest = levels[-1].where("n > 1").select("key", "slot", "n", "hash")
        levels.append(written(runs_of(rest, [], []), f"{name}-{len(levels) + 1}"))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """key, level (from 1), hash of the node that is left of each key."""
    found = [runs.where("n = 1").select("key", F.lit(k).alias("level"), "hash") for k, runs in enumerate(levels, 1)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def ways(levels: list[DataFrame], heads: DataFrame) -> DataFrame:
    """For every lowest node: what its kids entry keeps, and ``way``: of each level up to the key's top and then of the head's own way, the siblings before and after. heads: key, level, way and more columns, which are handed down."""
    more = [c for c in heads.columns if c not in ("key", "level", "way")]
    nodes = None
    for k in range(len(levels), 0, -1):
        here = heads.where(F.col("level") == k).select("key", F.lit(0).cast("long").alias("slot"), "way", *more)
        nodes = here if nodes is None else nodes.union(here)
        kids = levels[k - 1].select("key", "slot", "below", "kids").join(nodes, ["key", "slot"])
        kids = kids.select("key", "below", "kids", "way", *more, F.posexplode("kids").alias("at", "kid"))
        hashes = F.transform("kids", lambda x: x["hash"])
        siblings = F.struct(F.array_join(F.slice(hashes, F.lit(1), F.col("at")), "").alias("before"), F.array_join(F.slice(hashes, F.col("at") + 2, F.lit(FANOUT)), "").alias("after"))
        way = F.when(F.col("below") == 1, F.col("way")).otherwise(F.concat(F.array(siblings), F.col("way")))
        nodes = kids.select("key", F.col("kid.at").alias("slot"), way.alias("way"), *more, *(["kid"] if k == 1 else []))
    return nodes


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The columns of RESULT for each row. tampered: condition on doc_id and the other columns; there the text's A-Z are lower-cased before the fold (default: a third of the ids)."""
    spark = docs.sparkSession
    columns = [F.col("source"), F.col("lang").cast("string"), F.col("n_chars")]
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    odd = every_third(doc_id) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaf, lowered = leaf_of(doc_id, *columns, text), leaf_of(doc_id, *columns, F.translate(text, UPPER, UPPER.lower()))
    rows = docs.select(columns[1].alias("lang"), doc_id.alias("doc_id"), leaf.alias("leaf"), F.when(odd, lowered).otherwise(leaf).alias("changed"))
    entries = written(rows.groupBy("lang", "doc_id", "leaf", "changed").agg(F.count("*").alias("copies")), "leaves")
    langs = written(numbered(entries.groupBy("lang").agg(F.sum("copies").alias("n")), "lang").withColumnRenamed("number", "key"), "langs")
    n_langs, most = langs.agg(F.count("*"), F.max("n")).first()
    if not n_langs:
        return spark.createDataFrame([], RESULT)
    word = F.coalesce(F.shiftright("doc_id", SHIFTS[0]), F.lit(NO_ID).cast("long"))
    bit = F.coalesce(F.col("doc_id").bitwiseAND((1 << SHIFTS[0]) - 1), F.lit(0)).cast("int")
    keyed = entries.withColumnRenamed("lang", "own").join(langs, F.col("own").eqNullSafe(F.col("lang"))).select("key", F.col("n").alias("total"), "doc_id", "leaf", "changed", "copies", word.alias("word"), bit.alias("bit"))
    words = bitmaps(keyed)
    slots = spread(placed(keyed, words).withColumn("n", F.col("total")))
    levels = reduced(slots.withColumnRenamed("leaf", "hash"), ["changed", "doc_id"], most, "runs", ("block",))
    subroots = tops(levels).withColumnsRenamed({"key": "slot", "hash": "subroot"})
    subroots = written(subroots.select(F.lit(0).cast("long").alias("key"), "slot", F.lit(n_langs).cast("long").alias("n"), F.col("subroot").alias("hash"), "level"), "subroots")
    upper = reduced(subroots, ["level"], n_langs, "langs")
    root = tops(upper).first()["hash"]
    none = F.array().cast("array<struct<before:string,after:string>>")
    heads = ways(upper, tops(upper).select("key", "level", none.alias("way")))
    heads = heads.select(F.col("slot").alias("key"), F.col("kid.level").alias("level"), "way", F.col("kid.hash").alias("subroot"))
    found = ways(levels, heads)
    proof = digest(F.array_join(F.transform("way", lambda w: F.concat(w["before"], w["after"])), ""))
    folded = F.aggregate("way", F.col("kid.changed"), lambda h, w: digest(F.concat(w["before"], h, w["after"])))
    out = found.select(F.col("kid.doc_id").alias("doc_id"), F.col("kid.hash").alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def oracle(levels: int = 8, lang_levels: int = 4) -> str:
    """The same in SQL for at most 8^levels rows of a lang and 8^lang_levels langs."""
    fields = lambda text: " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    byte = "list_reduce(list_prepend(xor(c, d), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, d: {byte}), 4294967295)"
    sql = [
        f"d AS (SELECT doc_id, lang, sha256({fields('text')}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN sha256({fields('low')}) ELSE sha256({fields('text')}) END AS changed "
        "FROM (SELECT doc_id, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents))",
        "l0 AS (SELECT *, lang AS key, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS n, leaf AS hash, changed AS fold, '' AS proof FROM d)",
    ]

    def climb(source: str, target: str, part: str) -> None:
        run = f"PARTITION BY {part}, node // {FANOUT} ORDER BY node ROWS BETWEEN"
        sql.append(f"{target}n AS (SELECT DISTINCT {part}, slot AS node, hash AS h, n AS nodes FROM {source})")
        sql.append(
            f"{target}s AS (SELECT {part}, node, nodes, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post, h FROM {target}n)"
        )
        keep = ["doc_id", "leaf", "key", *(["subroot", "one"] if part == "one" else [])]
        sql.append(
            f"{target} AS (SELECT {', '.join(f'a.{c}' for c in keep)}, slot // {FANOUT} AS slot, (n + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN n = 1 THEN hash ELSE sha256(pre || h || post) END AS hash, "
            f"CASE WHEN n = 1 THEN fold ELSE sha256(pre || fold || post) END AS fold, CASE WHEN n = 1 THEN proof ELSE proof || pre || post END AS proof FROM {source} a JOIN {target}s b ON a.{part} IS NOT DISTINCT FROM b.{part} AND a.slot = b.node)"
        )

    for k in range(levels):
        climb(f"l{k}", f"l{k + 1}", "key")
    sql.append(f"m0 AS (SELECT doc_id, leaf, key, hash AS subroot, 1 AS one, dense_rank() OVER (ORDER BY encode(key) NULLS FIRST) - 1 AS slot, (SELECT count(*) FROM (SELECT DISTINCT key FROM l0)) AS n, hash, fold, proof FROM l{levels})")
    for k in range(lang_levels):
        climb(f"m{k}", f"m{k + 1}", "one")
    return "WITH " + ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = hash AS verified FROM m{lang_levels}"


ORACLE = oracle()
