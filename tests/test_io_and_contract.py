"""Readers/writers details and the driver contract."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from stormrail.operators import filters as FL
from stormrail.sources import readers as RD
from stormrail.sources import sinks as SK

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract_imports_without_session():
    code = "import __spark_entry__ as E; q = E.queries(); o = E.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def test_read_parameters(spark, tmp_path):
    p = tmp_path / "params.txt"
    p.write_text("time;time\nplace;place\nmax(t2m);max_temperature\nmin(t2m);min_temperature\n")
    params, names = RD.read_parameters(spark, str(p), drop=2)
    assert params == ["max(t2m)", "min(t2m)"] and names == ["max_temperature", "min_temperature"]


def test_codes_include_without_list_raises(spark):
    df = spark.createDataFrame([("a",)], "code string")
    with pytest.raises(ValueError):
        FL.codes_include(df, [])


def test_serving_files_at_most_100_rows(spark):
    df = spark.range(250).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b"))
    path = SK.scratch_path(spark, "serving-test")
    SK.write_serving_files(df.repartition(1), ["a", "b"], path, rows_per_file=100)
    local = path.removeprefix("file:")
    sizes = sorted(sum(1 for _ in open(os.path.join(local, f))) for f in os.listdir(local) if f.startswith("part-"))
    assert sizes == [50, 100, 100]
    first = spark.read.text(path).select(F.from_json("value", "X array<double>")["X"].alias("X")).first().X
    assert len(first) == 2


def test_append_counted_no_off_by_one(spark):
    path = SK.scratch_path(spark, "count-test")
    assert SK.append_counted(spark.range(7), path) == 7
    assert spark.read.parquet(path).count() == 7


def test_names_to_codes_raises_on_unknown(spark):
    from stormrail.operators.joins import names_to_codes
    df = spark.createDataFrame([("Nowhere",)], "name string")
    dim = spark.createDataFrame([("Helsinki", "HKI")], "name string, code string")
    with pytest.raises(Exception):
        names_to_codes(df, dim, "name", "name", "code").collect()


def test_committed_append_counts_a_batch_once(spark, monkeypatch):
    """A batch repeated, a job that dies between rows and manifest and is run again, and a batch without rows."""
    path = SK.scratch_path(spark, "commits")
    one, two = spark.range(5), spark.range(5, 9)
    assert SK.committed_append(one, path, "a") == 5
    assert SK.committed_append(one, path, "a") == 5

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(SK, "_commit", dies)
        with pytest.raises(RuntimeError):
            SK.committed_append(two, path, "b")
    assert sorted(r.id for r in SK.read_committed(spark, path).collect()) == [0, 1, 2, 3, 4]
    SK.committed_append(two, path, "b")
    SK.committed_append(two.limit(0), path, "c")
    got = SK.read_committed(spark, path, "batch").collect()
    assert sorted((r.batch, r.id) for r in got) == [("a", i) for i in range(5)] + [("b", i) for i in range(5, 9)]
    assert sorted((r.batch, r.n_rows) for r in SK.manifest(spark, path).collect()) == [("a", 5), ("b", 4), ("c", 0)]
    # the first folder of a batch counts, whatever a later one holds
    SK.committed_append(spark.range(100), path, "a")
    assert SK.read_committed(spark, path).count() == 9


def test_adjacency_matrix_in_several_files(spark):
    from stormrail.sources import readers as RD
    edges = [(0, 3), (0, 0), (7, 1), (9, 9), (4, 8), (4, 2)]
    path = SK.scratch_path(spark, "matrix-test")
    SK.write_adjacency_matrix(spark.createDataFrame(edges, "i int, j int"), 10, path, block=3)
    assert spark.read.text(path).count() == 10
    assert sorted(map(tuple, RD.read_adjacency_matrix(spark, path).collect())) == sorted(edges)
