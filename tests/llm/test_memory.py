import re

import pyarrow as pa
from pyspark.sql import functions as F

from hopgauge.llm import mixing, nearcopies, toxicity


def anonymous(batches):
    """MB that the Python worker of each task holds."""
    for _ in batches:
        with open("/proc/self/smaps_rollup") as f:
            kb = sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read())))
        yield pa.RecordBatch.from_arrays([pa.array([kb / 1024])], ["mb"])


def test_workers_hold_nothing_of_stages_that_are_done(spark):
    """Texts of ever new words fill what toxicity and mixing remember; a stage without a memory of its own begins with small workers."""
    docs = spark.range(0, 24_000, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(150)), lambda k: F.sha1((F.col("id") * 151 + k).cast("string").cast("binary"))), " ").alias("text"), F.lit("en").alias("lang"))
    labels = docs.where("doc_id < 200").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit("d").alias("domain"))
    toxicity.drop_toxic(docs, labels, 40).count()
    mixing.memberships(docs, mixing.fit_classifier(docs, labels.select("doc_id", "domain"), 40)).agg(F.max("n_tokens")).collect()
    nearcopies._nodes(docs.limit(400).repartition(4), 5).agg(F.max("n")).collect()
    held = [r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(anonymous, "mb double").collect()]
    assert len(held) == 4 and max(held) < 130, held
