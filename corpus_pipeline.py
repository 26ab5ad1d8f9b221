"""From raw documents to packed sequences: five stages, each of which works on all that its predecessor kept.

toxicity     documents over their language's calibrated threshold go
simhash      of each group of near copies (five-word shingles that overlap by 0.8 or more) the document with the smallest doc_id stays
pii          personal data in texts get surrogates under the key of spark.hopgauge.surrogate.key (a fresh one if not set); n_chars follows the new text
mixing       documents are repeated to bring the domains' token totals nearer to each other; none goes (rates are at least 1)
packing      documents become pieces in sequences of at most 2048 tokens

Every stage but the last returns the columns of documents; between stages rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgauge.llm import mixing, nearcopies, packing, pii, toxicity
from hopgauge.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.drop_near_copies(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new = pii.replace_entities(docs, pii.key_of(spark)).select(*docs.columns)
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rated, _, _ = mixing.mix(docs, mixing.quality_domains(docs, table(spark, sf_dir, "labels")), power=0.8, budget=None, least=1.0)
    return mixing.resample(docs, rated)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("pii", replace_personal_data), ("mixing", mix_domains), ("packing", pack)]
#: Training, fingerprints and tokenizers can't be expressed in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
