import pytest
from pyspark.sql import functions as F

from hopgauge.jobs import cli


def test_qc_and_pathmean(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    samples = spark.range(400).select((F.col("id") % 2).alias("cml_id"), F.lit("a").alias("sublink_id"), F.timestamp_seconds(F.col("id") * 60).alias("time"), F.lit(20.0).alias("tx"), F.lit(-50.0).alias("rx"))
    samples.write.parquet(at("samples"))
    spark.createDataFrame([(0, 5.0, 1), (1, 5.0, 2)], "cml_id long, length_km double, pos int").write.parquet(at("links"))
    spark.createDataFrame([(0, "a", 18.0), (1, "a", 7.0)], "cml_id long, sublink_id string, frequency double").write.parquet(at("sublinks"))
    args = ["qc", "--samples", at("samples"), "--links", at("links"), "--sublinks", at("sublinks"), "--out", at("out")]
    cli.main(args)
    assert {r.cml_id: r.isSane for r in spark.read.parquet(at("out/links")).collect()} == {0: True, 1: False}
    with pytest.raises(Exception, match="(?i)exist"):
        cli.main(args)
    cli.main([*args, "--overwrite", "--first-links", "1", "--proc-line", "no_filter"])
    assert spark.read.parquet(at("out/links")).count() == 1
    spark.createDataFrame([("2021-01-01 00:00:00", 1, 0, 2.0), ("2022-01-01 00:00:00", 1, 0, 3.0)], "scene_time string, channel int, pix long, value float").withColumn("scene_time", F.col("scene_time").cast("timestamp")).write.parquet(at("pixels"))
    spark.createDataFrame([(7, 0, 1.0)], "cml_id long, pix long, wt float").write.parquet(at("weights"))
    cli.main(["pathmean", "--pixels", at("pixels"), "--weights", at("weights"), "--start", "2021-01-01", "--end", "2021-09-07", "--out", at("means")])
    assert [r.path_mean for r in spark.read.parquet(at("means")).collect()] == [2.0]
