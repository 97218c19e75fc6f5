import os

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    """name -> list of rows of the smallest test data."""
    if not os.path.exists(SF):
        pytest.skip("test data missing")
    return {t: pq.read_table(f"{SF}/{t}.parquet").to_pylist()
            for t in ("documents", "pages", "benchmark", "labels")}


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns of clashing names beside the usual ones, from (id, text[, source]) tuples."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "a", 7, "x") for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, source string, n int, node string")
        return df.repartition(parts)
    return make
