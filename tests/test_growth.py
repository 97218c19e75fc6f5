"""What grows with a table, and how: joins that keep classes spread, files of a partitioned write, wide rows."""

import os

import pytest
from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_station_csv_files_do_not_multiply_with_tasks(spark, tmp_path):
    from stormrail.sources.sinks import write_station_csv
    d = spark.range(0, 4000, 1, 16).select(F.concat(F.lit("S"), (F.col("id") % 50).cast("string")).alias("station"),
                                           F.col("id").alias("v"))
    path = str(tmp_path / "csv")
    write_station_csv(d, path)
    files = sum(f.endswith(".csv") for _, _, names in os.walk(path) for f in names)
    assert files <= 50 + 16
    back = spark.read.option("sep", ";").option("header", True).csv(path).agg(F.count("v"), F.count_distinct("v")).first()
    assert tuple(back) == (4000, 4000)


def test_heat_map_row_is_sorted_not_looked_up(spark):
    from stormrail.plans.heatmap import heatmap_wide
    stations = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 2.0)], "station string, lat double")
    long = spark.createDataFrame([("a", 1, 5.0), ("b", 1, None), ("c", 2, 7.0), ("x", 2, 9.0)],
                                 "station string, dayofyear int, scaled double")
    _, m = heatmap_wide(long, stations)
    assert {r["dayofyear"]: r["values"] for r in m.collect()} == {1: [None, None, 5.0], 2: [None, 7.0, None]}
    assert "map_from_entries" not in _plan(m)


@pytest.fixture()
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_downsampling_does_not_shuffle_rows_by_class(spark, no_auto_broadcast):
    from stormrail.operators.sampling import downsample_to_smallest, ratio_downsample
    d = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, 1).when(F.col("id") < 900, 0)
                                 .alias("class"))
    for out in (downsample_to_smallest(d, ["k"], "class"), ratio_downsample(d, ["k"], 2.0, "class")):
        assert "BroadcastHashJoin" in _plan(out)
    got = {r["class"]: r["count"] for r in downsample_to_smallest(d, ["k"], "class").groupBy("class").count().collect()}
    assert got == {0: 90, 1: 90, None: 90}


def test_sample_of_sites_is_drawn_before_it_is_sorted(spark):
    from stormrail.operators.neighbours import _low
    s = spark.range(100_000).select(F.col("id").alias("sid"))
    assert 1000 <= _low(s, 100_000, 2000).count() <= 3000
    assert _low(s, 100_000, 100_000).count() == 100_000


def test_link_counts_in_blocks(spark, monkeypatch):
    from stormrail.operators import joins as J
    rows = spark.range(600).select(F.when(F.col("id") % 97 > 0, F.concat(F.lit("S"), (F.col("id") % 13).cast("string"))).alias("station"),
                                   F.when(F.col("id") % 89 > 0, F.col("id") % 7).alias("time"), F.col("id").alias("row_id"))
    edges = spark.range(40).select(F.concat(F.lit("S"), (F.col("id") % 11).cast("string")).alias("src"),
                                   F.concat(F.lit("S"), (F.col("id") * 3 % 17).cast("string")).alias("dst"))
    for time in ("time", None):
        want = {r[0]: r[1] for r in J.row_links(rows, edges, same_time=time).groupBy("row_a").count().collect()}
        for links, step in ((4_000_000, 4_000_000), (8, 50), (8, 1)):
            monkeypatch.setattr(J, "BLOCK_LINKS", links)
            monkeypatch.setattr(J, "STEP", step)
            got = J.link_counts(rows, edges, same_time=time)
            assert {r["row_id"]: r["n_links"] for r in got.collect()} == want
            assert len(want) == got.count()


def test_link_counts_travel_in_packs(spark, monkeypatch):
    from stormrail.operators import joins as J
    rows = spark.range(3000).select(F.concat(F.lit("S"), (F.col("id") % 50).cast("string")).alias("station"),
                                    (F.col("id") % 61).alias("time"), F.col("id").alias("row_id"))
    edges = spark.range(400).select(F.concat(F.lit("S"), (F.col("id") % 50).cast("string")).alias("src"),
                                    F.concat(F.lit("S"), (F.col("id") * 7 % 53).cast("string")).alias("dst"))
    want = {r[0]: r[1] for r in J.row_links(rows, edges).groupBy("row_a").count().collect()}
    monkeypatch.setattr(J, "BLOCK_ENTRIES", 3000)
    monkeypatch.setattr(J, "STEP", 100)
    got = J.link_counts(rows, edges)
    assert {r["row_id"]: r["n_links"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # a block's rows come as lists and batch by batch, not as a table of one row for each link and count
    assert "FlatMapGroupsInArrow" in plan and "CoGroups" not in plan


def test_nested_predictions_stay_with_their_station(spark, tmp_path):
    """Suppliers 7 and 10247 lie at the same latitude and longitude."""
    from stormrail.catalog import QUERIES, load_all
    load_all()
    spark.createDataFrame([(7,), (10247,), (8,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(7, 1, "R"), (10247, 2, "N"), (10247, 2, "N"), (8, 3, "A")], "l_suppkey long, l_orderkey long, l_returnflag string") \
        .withColumns({"l_quantity": F.lit(1.0), "l_extendedprice": F.lit(1.0)}).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["join12_nested_by_station"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("Station 10247", "2024-01-01", "02@50"), ("Station 7", "2024-01-01", "01@25"),
                                       ("Station 8", "2024-01-01", "03@25")]


def test_adjacency_matrix_files_are_small(spark, tmp_path):
    from stormrail.sources import readers as RD
    from stormrail.sources import sinks as SK
    path, n = str(tmp_path / "matrix"), 1500
    edges = [(0, 0), (3, 1499), (1499, 2), (700, 700), (3, 4)]
    SK.write_adjacency_matrix(spark.createDataFrame(edges, "i int, j int"), n, path, block=500)
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)) < n * n / 20
    lines = [r["value"] for r in spark.read.text(path).where("value like '%1%'").collect()]
    assert len(lines) == 4 and all(len(x) == 2 * n - 1 for x in lines)
    assert sorted(map(tuple, RD.read_adjacency_matrix(spark, path).collect())) == sorted(edges)


def test_adjacency_matrix_is_cut_at_its_ones(spark, tmp_path):
    """Lines of single 0 and 1 are not cut into cells; any other is, with the same places."""
    from stormrail.sources import readers as RD
    from stormrail.sources import sinks as SK
    lines = ["0,1,1,0", "1,0,0,1", "0,0,0,0", "1,1,1,1", "0, 1,0,0.5", "00,1,-1,1", "0;1,1,1", "01,x,,NaN", "", "1", "0,0,0,1 "]
    (tmp_path / "m.txt").write_text("\n".join(lines) + "\n")
    got = sorted(map(tuple, RD.read_adjacency_matrix(spark, str(tmp_path / "m.txt")).collect()))
    places = [(1, 2), (0, 3), (), (0, 1, 2, 3), (1, 3), (1, 3), (1, 2), (0, 3), (), (0,), (3,)]
    assert got == [(i, j) for i, js in enumerate(places) for j in js]
    n, path = 40_000, str(tmp_path / "matrix")
    lines = spark.createDataFrame([([n],), ([0, n - 1],), ([n - 1, 0],), ([2, 0, n - 4],)], "gaps array<long>").select(
        SK.matrix_line(F.col("gaps"), ",").alias("value"))
    assert all(len(r["value"]) == 2 * n - 1 for r in lines.collect())
    lines.write.text(path)
    back = RD.read_adjacency_matrix(spark, path)
    assert sorted(r["j"] for r in back.collect()) == [0, 2, 3, n - 1]


def _source(spark, n=300):
    """Rows whose plan shows where they are built again: it has a Range."""
    return spark.range(n).select(
        F.concat(F.lit("S"), (F.col("id") % 5).cast("string")).alias("station"),
        F.timestamp_add("HOUR", F.col("id") % 11, F.lit("2024-01-01").cast("timestamp_ntz")).alias("time"),
        F.col("id").cast("string").alias("train_type"), (F.lit(59.5) + F.col("id") % 5).alias("lat"),
        (F.col("id") % 100).cast("double").alias("delay"), (F.col("id") % 100).cast("double").alias("y"),
        F.pmod(F.xxhash64("id"), F.lit(90)).cast("double").alias("y_pred"),
        *[F.pmod(F.xxhash64("id", F.lit(c)), F.lit(9)).cast("double").alias(c) for c in
          ("train_count", "prec", "gust", "vis", "n", "prec_3h", "prec_6h", "flashcount")])


def test_band_evaluation_reads_its_input_once(spark):
    from stormrail.plans.evaluation import band_evaluation
    out = band_evaluation(_source(spark))
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.station: r.n for r in out.collect()} == {"all": 300, **{f"S{i}": 60 for i in range(5)}}


@pytest.mark.parametrize("name", ["mod1_rf_classifier", "mod3_linear_elastic", "mod5_linear_svc"])
def test_models_do_not_build_the_features_again(spark, monkeypatch, name):
    from stormrail.catalog import q_models
    monkeypatch.setattr(q_models, "features", lambda *_: _source(spark))
    out = getattr(q_models, name)(spark, None)
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < out.count() < 300


def test_search_does_not_build_the_folds_again(spark, monkeypatch):
    from stormrail.catalog import q_models
    seen, search = [], q_models.SR.random_search
    monkeypatch.setattr(q_models, "features", lambda *_: _source(spark))
    monkeypatch.setattr(q_models.SR, "random_search", lambda folds, *a, **k: seen.append(folds) or search(folds, *a, **k))
    out = q_models.mod7_random_search(spark, None).collect()
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Range (" not in plan
    assert len(out) == 4 and [r.refit_rows for r in out if r["rank"] == 1][0] == 300
