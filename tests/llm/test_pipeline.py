"""The corpus pipeline: every stage takes effect, works on what its predecessor kept, and keeps the columns."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as p
from stormrail.llm import decontaminate, mixing, near_dup, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data missing")


def test_registered():
    names = entry.queries()
    assert names["pipeline"] is p.run
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = {}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF).checkpoint()
        if k < 4:
            assert out.columns == columns and out.schema["n_chars"].dataType.typeName() == "long", name
        kept[name] = docs, out
        docs = out
    given, out = kept["quality classifier"]
    model = quality.train(given, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in out.collect()} == {r.doc for r in quality.scored(given, model).collect() if r.score >= 0.5}
    given, out = kept["line dedup"]
    assert out.count() == given.count()
    given, out = kept["near-duplicates"]
    assert {r.doc_id for r in out.collect()} == {r.doc for r in near_dup.near_duplicates(given).collect() if r.kept}
    given, out = kept["benchmark decontamination"]
    hits = {r.doc for r in decontaminate.contaminated(given, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert hits and {r.doc_id for r in out.collect()} == {r.doc_id for r in given.collect()} - hits
    given, out = kept["source mix"]
    assert sorted(map(str, out.drop("doc_id").collect())) == sorted(map(str, mixing.mix(given).drop("doc").collect()))
    assert 0 < out.count() < before
    again = p.run(spark, SF)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
