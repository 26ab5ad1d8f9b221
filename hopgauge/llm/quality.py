"""Quality rules whose cutoffs are chosen under a guaranteed risk, with DataFrame and SQL functions only.

Base rules count words, characters, symbols, repeated lines and repeated phrases and fail a document outright. Beyond them, a
document is rejected if one of its ratios (RULES) exceeds that rule's cutoff in its stratum (language). Cutoffs come from a fixed
grid and are certified on labelled good documents, the holdout: for every stratum, rule and cutoff the exact binomial tail
P(Bin(n, risk / rules) <= k) is computed, n the stratum's good documents that pass the base rules and k those that the rule would
reject. A cutoff counts as safe if this is at most ``level`` divided by the number of all tests (strata x rules x cutoffs), and
each rule takes the strictest safe cutoff. So with probability 1 - level, in no stratum more than ``risk`` of the good documents
are rejected. A stratum with too few labels gets no cutoff and rejects nothing. Labels of documents that a hash keeps out
(HELD) are never used to choose; they serve to check the promise.

Defined results: null text: no words; null language: a stratum of its own; documents without labels, or labels without documents
or with null quality, take no part in the choice; repeated label rows of one doc_id count once, as good only if all agree; other
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgauge.llm.common import let, table, words_of, written

#: Cutoffs on trial by rule, from strict to lax.
GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio")
#: Labelled documents with this remainder of crc32(doc_id as text) modulo 5 are not used to choose cutoffs.
HELD = 0
#: Up to so many different repeated windows, positions are found by looking them up; beyond, by sorting.
FEW = 16


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that are found twice or more in the array (the first one included)."""

    def covered(at: Column) -> Column:
        """at: sorted starts of repeated windows."""
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    def looked_up(windows: Column, twice: Column) -> Column:
        return F.filter(F.transform(windows, lambda w, i: F.when(F.array_contains(twice, w), i)), lambda i: i.isNotNull())

    def sorted_out(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return let(
            pairs,
            lambda p: F.sort_array(
                F.filter(
                    F.transform(p, lambda x, k: F.when((x["w"] == F.get(p, k - 1)["w"]) | (x["w"] == F.get(p, k + 1)["w"]), x["i"])),
                    lambda i: i.isNotNull(),
                )
            ),
        )

    def count(windows: Column) -> Column:
        twice = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda w, i: w == F.get(s, i - 1))))
        return let(
            twice,
            lambda t: F.when(F.size(t) == 0, 0).when(F.size(t) <= FEW, let(looked_up(windows, t), covered)).otherwise(let(sorted_out(windows), covered)),
        )

    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 4, 0).otherwise(let(windows, count)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = docs.select(
        F.col("doc_id").cast("long"),
        F.col("lang").cast("string"),
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("x"),
    )
    out = counted.select("doc_id", "lang", "w.n_words", "w.word_chars", "n_symbols", "x.n_lines", "x.n_dup_lines", "w.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ratios(counts: DataFrame) -> DataFrame:
    """counts with stratum and the RULES' ratios (0 where there is nothing to divide by)."""

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    return counts.select("*", F.coalesce("lang", F.lit("")).alias("stratum"), ratio("n_symbols", "word_chars").alias("symbol_ratio"), ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"), ratio("n_repeat_words", "n_words").alias("repeat_ratio"))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series at x + 8, brought back; to some 1e-13."""
    y = x + 8
    shift = reduce(lambda a, b: a + b, [F.log(x + k) for k in range(8)])
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5.0)) - 1 / (1680 * F.pow(y, 7.0)) - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), the p-value of "the rate is over p" after k of n; 1 from the mean on.

    Terms are added from k downwards; beyond 12 standard deviations they no longer change a double.
    """
    last = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p)) + 50)).cast("int")
    first = F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * (k - i + 1) / (n - k + i) * ((1 - p) / p)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    terms = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), first * F.aggregate(terms, zero, add)["sum"]))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff: the strictest safe cutoff of each rule, where there is one. measured: rows of ratios()."""
    good = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    good = good.where((F.col("quality") == 1) & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != HELD)).select("doc_id")
    holdout = measured.where("NOT base_failed").join(good, "doc_id", "left_semi")
    counts = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(GRID)]
    by = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    tests = by.select("stratum", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("k")) for r in RULES for i, c in enumerate(GRID)])).alias("t")).select("stratum", "n", "t.*")
    strata = by.agg((F.count(F.lit(1)) * len(RULES) * len(GRID)).alias("tests"))
    # the sum over strata is one row
    safe = tests.crossJoin(F.broadcast(strata)).where(binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= level / F.col("tests"))
    return safe.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """Every document's counts, ratios, base_failed and kept."""
    measured = written(ratios(base_counts(docs)), "quality")
    cut = certified_cutoffs(measured, labels, risk, level).groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    cut = cut.select("stratum", *[F.col(r).alias(f"{r}_cutoff") for r in RULES])
    broken = reduce(lambda a, b: a | b, [F.coalesce(F.col(r) > F.col(f"{r}_cutoff"), F.lit(False)) for r in RULES])
    return measured.join(cut, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~broken)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_GRID_SQL = ", ".join(map(str, GRID))
ORACLE = rf"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(3) AS t(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, coalesce(lang, '') AS stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM documents d JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)
), measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(n_symbols / nullif(word_chars, 0), 0.0::DOUBLE) AS symbol_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0::DOUBLE) AS dup_line_ratio,
    coalesce(n_repeat_words / nullif(n_words, 0), 0.0::DOUBLE) AS repeat_ratio
  FROM counted
), rules AS (
  UNPIVOT (SELECT doc_id, stratum, base_failed, symbol_ratio, dup_line_ratio, repeat_ratio FROM measured) ON symbol_ratio, dup_line_ratio, repeat_ratio INTO NAME rule VALUE ratio
), zlib(k, c) AS (
  SELECT k, list_reduce(list_concat([k::BIGINT], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM range(256) AS t(k)
), zlibs AS (
  SELECT list(c ORDER BY k) AS z FROM zlib
), good AS (
  SELECT doc_id FROM (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1), zlibs
  WHERE xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, z[(xor(c, x) & 255) + 1])), 4294967295) % 5 <> {HELD}
), tests AS (
  SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (ratio > cutoff) AS k
  FROM rules JOIN good USING (doc_id), (SELECT unnest([{_GRID_SQL}])::DOUBLE AS cutoff) WHERE NOT base_failed GROUP BY ALL
), tails AS (
  SELECT *, CASE WHEN k >= n * {0.05 / 3!r} THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda j:
    exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({0.05 / 3!r}) + (n - j) * ln({1 - 0.05 / 3!r})))) END AS tail, count(*) OVER () AS m
  FROM tests
), cutoffs AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM tails WHERE tail <= 0.05 / m GROUP BY ALL
), broken AS (
  SELECT DISTINCT doc_id FROM rules JOIN cutoffs USING (stratum, rule) WHERE ratio > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept
FROM measured
"""
