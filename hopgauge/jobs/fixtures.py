"""Link, grid and scene tables derived from the general tables, with the same derivation in SQL for the comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"click": (-64.8, 0.3), "error": (-50.0, 15.0), "purchase": (-50.0, 3.0), "signup": (-60.0, 1.0), "view": (-84.7, 0.5)}
#: Users whose events make one link: the number of links grows with the users, and the days with the events' times.
USERS = 75


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _extent(e: DataFrame) -> DataFrame:
    """One row: first_slot (half hours since 1970, at a day's begin), slots (whole days), n_cml."""
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    return e.agg((F.min(day) * 48).alias("first_slot"), ((F.max(day) - F.min(day) + 1) * 48).alias("slots"), (F.max(F.floor(F.col("user_id") / USERS)) + 1).alias("n_cml"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cml_id, sublink_id, time, tsl, rsl: dense half-hourly signals of links (USERS users each) by event type; tsl varies with the number of events."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*KINDS))
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 1800)
    bins = e.groupBy(F.floor(F.col("user_id") / USERS).alias("cml_id"), F.col("event_type").alias("sublink_id"), slot.alias("slot"))
    bins = bins.agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    kinds = F.array(*[F.struct(F.lit(k).alias("sublink_id"), F.lit(b).alias("base"), F.lit(a).alias("amp")) for k, (b, a) in KINDS.items()])
    # the axis is dense by definition: every series has every slot
    links = _extent(e).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cml") - 1)).alias("cml_id"), "first_slot", "slots")
    # from one row: a number of partitions that adaptive execution keeps, else one task makes all slots
    links = links.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cml_id")
    series = links.select("cml_id", F.explode(kinds).alias("kind"), "first_slot", "slots").select("cml_id", "kind.*", F.explode(F.sequence(F.col("first_slot"), F.col("first_slot") + F.col("slots") - 1)).alias("slot"))
    dense = series.join(bins, ["cml_id", "sublink_id", "slot"], "left")
    value = F.col("s") / F.col("n") / F.lit(100.0)
    rsl = F.round(F.col("base") - F.col("amp") * F.ln(1 + value / F.lit(20.0)), 2)
    return dense.select("cml_id", "sublink_id", F.timestamp_seconds(1800 * F.col("slot")).alias("time"), (20 + F.coalesce("n", F.lit(0)) % 3).cast("float").alias("tsl"), rsl.cast("float").alias("rsl"))


SAMPLES = f"""kinds(sublink_id, base, amp) AS (VALUES {", ".join(f"('{k}', {b}::DOUBLE, {a}::DOUBLE)" for k, (b, a) in KINDS.items())}),
extent AS (
  SELECT CAST(min(floor(epoch(ts) / 86400)) * 48 AS BIGINT) AS first_slot, CAST((max(floor(epoch(ts) / 86400)) - min(floor(epoch(ts) / 86400)) + 1) * 48 AS BIGINT) AS slots, max(user_id // {USERS}) + 1 AS n_cml
  FROM events WHERE event_type IN (SELECT sublink_id FROM kinds)
), bins AS (
  SELECT user_id // {USERS} AS cml_id, event_type AS sublink_id, CAST(floor(epoch(ts) / 1800) AS BIGINT) AS slot,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS s, count(*) AS n
  FROM events WHERE event_type IN (SELECT sublink_id FROM kinds) GROUP BY ALL
), axis AS (
  SELECT cml_id, first_slot, unnest(range(slots)) AS idx FROM (SELECT first_slot, slots, unnest(range(n_cml)) AS cml_id FROM extent)
), samples AS (
  SELECT c.cml_id, k.sublink_id, c.idx, make_timestamp(1800 * (c.first_slot + c.idx) * 1000000) AS time, CAST(20 + coalesce(n, 0) % 3 AS FLOAT) AS tsl,
    CAST(round(base - amp * ln(1 + s::DOUBLE / n / 100.0::DOUBLE / 20.0::DOUBLE), 2) AS FLOAT) AS rsl
  FROM axis c, kinds k
  LEFT JOIN bins b ON b.cml_id = c.cml_id AND b.sublink_id = k.sublink_id AND b.slot = c.first_slot + c.idx
)"""


def statics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos (part key), length_km, frequency (GHz for odd, Hz for even keys)."""
    ghz = (10 + F.col("p_partkey") % 30).cast("double")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("pos"), F.col("p_size").cast("double").alias("length_km"), F.when(F.col("p_partkey") % 2 == 1, ghz).otherwise(ghz * 1e9).alias("frequency"))


STATICS = """statics AS (
  SELECT CAST(p_partkey AS BIGINT) AS pos, CAST(p_size AS DOUBLE) AS length_km,
    CASE WHEN p_partkey % 2 = 1 THEN (10 + p_partkey % 30)::DOUBLE ELSE (10 + p_partkey % 30)::DOUBLE * 1e9 END AS frequency
  FROM part
)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statics with n_cml (one row is joined)."""
    return statics(spark, sf_dir).crossJoin(F.broadcast(_extent(table(spark, sf_dir, "events").where(F.col("event_type").isin(*KINDS))).select("n_cml")))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cml_id, length_km: the mean size of the parts that fall to a link, in tenths."""
    s = _placed(spark, sf_dir)
    return s.groupBy((F.col("pos") % F.col("n_cml")).alias("cml_id")).agg((F.floor(F.sum("length_km") / F.count(F.lit(1))) / 10).alias("length_km"))


def sublinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cml_id, sublink_id, frequency, polarization: the largest frequency (Hz) of the parts that fall to a sublink, less 5 GHz per kind."""
    s, n = _placed(spark, sf_dir), len(KINDS)
    by = s.groupBy((F.col("pos") % F.col("n_cml")).alias("cml_id"), (F.floor(F.col("pos") / F.col("n_cml")) % n).alias("k")).agg((F.count(F.lit(1)) % 7).alias("c"))
    names = F.array(*[F.lit(k) for k in KINDS])
    polarized = F.when((F.col("cml_id") + F.col("k")) % 2 == 0, "V").otherwise("H")
    return by.select("cml_id", F.get(names, F.col("k").cast("int")).alias("sublink_id"), ((20 + F.col("c") + 5 * F.col("k")) * F.lit(1e9)).alias("frequency"), polarized.alias("polarization"))


LINKS = f"""placed AS (
  SELECT s.*, n_cml FROM statics s, extent
), links AS (
  SELECT pos % n_cml AS cml_id, floor(sum(length_km) / count(*)) / 10 AS length_km FROM placed GROUP BY 1
), sublinks AS (
  SELECT cml_id, (['{"', '".join(KINDS)}'])[CAST(k AS INT) + 1] AS sublink_id, (20 + c + 5 * k) * 1e9::DOUBLE AS frequency, CASE WHEN (cml_id + k) % 2 = 0 THEN 'V' ELSE 'H' END AS polarization
  FROM (SELECT pos % n_cml AS cml_id, (pos // n_cml) % {len(KINDS)} AS k, count(*) % 7 AS c FROM placed GROUP BY ALL)
)"""


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cml_id, x0, y0, x1, y1 of links around an 8 x 8 grid: inside, across its border, outside, and of no length."""
    k = F.col("s_suppkey")
    at = lambda m: ((k * m) % 100) / F.lit(10.0) - 1
    return table(spark, sf_dir, "supplier").select(k.cast("long").alias("cml_id"), at(37).alias("x0"), at(53).alias("y0"), at(71).alias("x1"), at(89).alias("y1"))


ENDPOINTS = """endpoints AS (
  SELECT CAST(s_suppkey AS BIGINT) AS cml_id, (s_suppkey * 37 % 100) / 10.0::DOUBLE - 1 AS x0, (s_suppkey * 53 % 100) / 10.0::DOUBLE - 1 AS y0,
    (s_suppkey * 71 % 100) / 10.0::DOUBLE - 1 AS x1, (s_suppkey * 89 % 100) / 10.0::DOUBLE - 1 AS y1
  FROM supplier
)"""


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_time (number), channel, values: embeddings as 8 x 8 rasters, every seventh pixel missing."""
    missing = lambda v, i: F.when(i % 7 != F.col("vec_id") % 7, v)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene_time"), F.col("label").alias("channel"), F.transform("embedding", missing).alias("values"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, scene_time, channels, error: the rasters as scenes of one channel; some are bad."""
    r = rasters(spark, sf_dir)
    error = F.when(F.col("scene_time") % 50 == 7, "unreadable")
    return r.select(F.concat(F.lit("scene"), F.col("scene_time").cast("string")).alias("path"), "scene_time", F.create_map(F.col("channel").cast("string"), F.col("values")).alias("channels"), error.alias("error"))


RASTERS = """rasters AS (
  SELECT vec_id AS scene_time, label AS channel, CAST(i AS BIGINT) AS pix, CASE WHEN i % 7 <> vec_id % 7 THEN embedding[i + 1] END AS value
  FROM embeddings, range(64) AS t(i)
)"""

#: A grid of 100 x 80 scan angles, and links all over what the satellite sees.
GRID = {"x": tuple(-0.05 + 0.1 * k / 99 for k in range(100)), "y": tuple(0.01 + 0.1 * k / 79 for k in range(80)), "height": 35785831.0, "lon_0": 0.0, "a": 6378169.0, "b": 6356583.8}


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cml_id and the sites' coordinates, of links about the grid."""
    k = F.col("s_suppkey")
    at = lambda m, n, low, step: (k * m) % n * F.lit(step) + low
    return table(spark, sf_dir, "supplier").select(
        k.cast("long").alias("cml_id"), at(37, 301, -15.0, 0.1).alias("site_a_longitude"), at(53, 403, 1.0, 0.1).alias("site_a_latitude"),
        at(71, 307, -15.0, 0.1).alias("site_b_longitude"), at(89, 401, 1.0, 0.1).alias("site_b_latitude"),
    )
