import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from hopgauge.llm import mixing, nearcopies, packing, pii, toxicity

DIR = "/root/testdata/sf0.001"
ROOT = Path(corpus_pipeline.__file__).resolve().parent


def linked(docs):
    """Brute force: the smallest doc_id that near copies reach, by doc_id."""
    sets = {r.doc_id: set(nearcopies.shingles(r.text).tolist()) for r in docs.collect()}
    label = {d: d for d in sets}
    of = {}
    for d, s in sets.items():
        for h in s:
            of.setdefault(h, []).append(d)
    links = set()
    for d, s in sets.items():
        counts = Counter(o for h in s for o in of[h] if o < d)
        links |= {(o, d) for o, n in counts.items() if n >= 0.8 * (len(s) + len(sets[o]) - n)}
    empty = [d for d, s in sets.items() if not s]
    links |= {(empty[0], d) for d in empty[1:]}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_stages_do_what_their_operators_say(spark, tmp_path):
    spark.conf.set("spark.hopgauge.surrogate.key", "of the tests")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == columns
        before, after = ({r.doc_id: r for r in d.collect()} for d in (docs, out))
        if name == "toxicity":
            judged = {r.doc_id: r.toxic for r in toxicity.classify(docs, labels).collect()}
            assert set(after) == {k for k in before if not judged[k]}
        elif name == "simhash":
            want = set(linked(docs).values())
            assert want <= set(after) and len(set(after) - want) <= 2  # links are exact, finding them is not
        elif name == "pii":
            want = {r.doc_id: r.text for r in pii.replace_entities(docs, "of the tests").collect()}
            assert {k: r.text for k, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "mixing":
            rated, _, _ = mixing.mix(docs, mixing.quality_domains(docs, labels), power=0.8, budget=None, least=1.0)
            copies = Counter(r.doc_id for r in out.select("doc_id").collect())
            assert set(copies) == set(before) and all(int(r.rate) <= copies[r.doc_id] <= int(r.rate) + 1 for r in rated.collect())
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    packing.check_plan([(r.sequence_id, r.offset, r.length) for r in packed], 2048)
    assert sum(r.piece == 0 for r in packed) == docs.count()


def test_stages_take_nulls_repeated_rows_clashing_names_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(6)
    odd = docs.selectExpr("*", "doc_id AS _copies", "text AS quality", "1 AS toxic", "2 AS n_entities_", "doc_id AS node", "doc_id AS rate")
    some = odd.unionByName(odd.limit(2)).unionByName(odd.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS lang", "source", "n_chars", "_copies", "quality", "toxic", "n_entities_", "node", "rate"))
    some = some.unionByName(odd.limit(1).withColumn("text", F.repeat(F.lit("long text of words "), 50_000)).withColumn("doc_id", F.lit(-5).cast("long")))
    for given, least in ((some, 3), (odd.limit(0), 0)):
        now = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = str(tmp_path / f"{name}{least}")
            stage(spark, now, DIR).write.parquet(path)
            now = spark.read.parquet(path)
            assert now.columns == given.columns
        assert now.count() >= least and corpus_pipeline.STAGES[-1][1](spark, now, DIR).count() >= least


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0


def test_the_rest_works_without_this_subpackage(tmp_path):
    shutil.copytree(ROOT / "hopgauge", tmp_path / "hopgauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not [k for k in q if k[:2] == 'op' or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
