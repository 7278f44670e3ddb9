"""The corpus pipeline: every stage works on what its predecessor kept."""

import os
import subprocess
import sys

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"

#: The stages one by one, as a driver calls them whose workers lack the package.
APART = """
import sys
sys.path.insert(0, sys.argv[1])
import corpus_pipeline
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.read.parquet(sys.argv[2] + "/documents.parquet")
for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
    stage(spark, docs, sys.argv[2]).write.parquet(f"out/{k}")
    docs = spark.read.parquet(f"out/{k}")
print("pieces", docs.count())
"""


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(columns)
        rows = {r.doc_id: r.text for r in out.collect()}
        assert rows and set(rows) <= set(before)
        if name == "rules":
            from lodegraph.llm import quality_rules

            assert set(rows) == {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
        if name == "near_duplicates":
            from lodegraph.llm import simhash

            groups = {}
            for r in simhash.near_duplicates(spark, docs).collect():
                groups.setdefault(r.component_id, []).append(r.doc_id)
            assert set(rows) == {min(g) for g in groups.values()}
        if name == "personal_data":
            from lodegraph.llm import pii

            assert set(rows) == set(before) and rows == {d: pii.masked(t) for d, t in before.items()}
        before, docs = rows, spark.createDataFrame(out.collect(), out.schema)
    pieces = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(before)


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


def test_edges(spark, edge, empty):
    labelled = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for docs in (edge, empty):
        rows = docs
        for name, stage in pipeline.STAGES:
            if name == "classifier":
                from lodegraph.llm import quality_classifier
                from lodegraph.llm.common import columns

                rows = quality_classifier.keep_good(columns(rows, *pipeline.COLUMNS), quality_classifier.fit(rows, labelled))
            else:
                rows = stage(spark, rows, SF)
            rows = spark.createDataFrame(rows.collect(), rows.schema)
        assert rows.count() >= 0


def test_classifier_judges_what_rules_keep(spark):
    """The rules leave one labelled bad document at sf0.01, too few to fit on."""
    sf = "/root/testdata/sf0.01"
    docs = pipeline.rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    bad = {r.doc_id for r in docs.join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0"), "doc_id").collect()}
    kept = {r.doc_id for r in pipeline.classifier(spark, docs, sf).collect()}
    assert bad and kept and not bad & kept


def test_stages_send_the_package(spark, tmp_path):
    """Stages called by themselves, where the workers' Python path lacks it."""
    root = os.path.dirname(os.path.abspath(pipeline.__file__))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", APART, root, SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.strip() == f"pieces {pipeline.run(spark, SF).count()}"
