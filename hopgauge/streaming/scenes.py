"""Path means of scenes as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hopgauge.operators.geo import path_means


def stream_path_means(spark: SparkSession, folder: str, schema: StructType, weights: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the path means of pixel files (Parquet: scene_time, channel, pix, value) in a folder, each file's scenes being whole.

    A scene's mean needs no other scene, so every micro-batch is a batch job of its own and no state is kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        path_means(batch, weights).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
