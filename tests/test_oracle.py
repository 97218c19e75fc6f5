"""Every registered query against its DuckDB oracle on sf0.001 (the driver
uses sf0.01), or against what its result has to show where it has none. The
training-data queries are tested in tests/llm."""

import os

import pytest

import __spark_entry__ as E
from scripts.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def _near(a, b, part):
    return abs(a - b) <= part * max(abs(b), 1e-12)


def _beats_mean(df, truth="y"):
    """A regressor's squared error against that of the constant mean of what it was tested on."""
    return ((df[truth] - df["prediction"]) ** 2).mean() < ((df[truth] - df[truth].mean()) ** 2).mean()


def _at_least_majority(df):
    share = df["y"].mean()
    return (df["y"] == df["prediction"]).mean() >= max(share, 1 - share) - 0.05


#: What the result of a query without SQL has to show, beyond columns.
BOUNDS = {
    "mod1_rf_regressor": _beats_mean,
    "mod2_gbt_regressor": _beats_mean,
    "mod3_linear_elastic": _beats_mean,
    "mod1_rf_classifier": _at_least_majority,
    "mod2_gbt_classifier": _at_least_majority,
    "mod5_linear_svc": _at_least_majority,
    "mod6_mixture": lambda df: df["vec_id"].is_unique and set(df["prediction"]) <= {0, 1, 2, 3} and df["prediction"].nunique() > 1,
    "mod3_partial_fit": lambda df: all(_near(w, c, 0.02) or abs(w - c) < 0.05 for w, c in zip(df["weight"], df["closed_form"])),
    "mod7_random_search": lambda df: len(df) == 4 and df["mean_score"].is_monotonic_increasing and list(df["rank"]) == [1, 2, 3, 4]
    and df["refit_rows"].iloc[0] > 0,
    "mod9_flagged_regressor": lambda df: (df["prediction"] > 0).all(),
    "met16_learning_curve": lambda df: list(df["train_percent"]) == [10.0, 32.5, 55.0, 77.5, 100.0] and (df["test_mean"] > 0).all()
    and df["train_mean"].iloc[-1] <= 1.1 * df["test_mean"].iloc[-1],
    "ftr3_pca_whiten": lambda df: all(abs(df[c].mean()) < 1e-6 and _near(df[c].var(), 1.0, 1e-6) for c in ("pc0", "pc1", "pc2")),
    "ftr4_select_important": lambda df: _near(df["importance"].sum(), 1.0, 1e-6)
    and ((df["importance"] >= df["importance"].mean()) == df["selected"]).all(),
    "ftr5_feature_subsets": lambda df: set(df["subset"]) == {"counts", "weather", "all"}
    and df.set_index("subset")["rmse"]["all"] <= 1.05 * df["rmse"].min(),
    "met14_explained_variance": lambda df: df["ratio"].between(0, 1).all() and df["ratio"].is_monotonic_decreasing
    and all(_near(r * df["eigenvalue"].iloc[0], e * df["ratio"].iloc[0], 1e-9) for r, e in zip(df["ratio"], df["eigenvalue"])),
    "met17_pca_reconstruction": lambda df: (df["err"] >= 0).all() and ((df["err"] > 5) == df["above_5"]).all(),
    "pred3_forecast_scoring": lambda df: not df.duplicated(["place", "time", "analysistime"]).any()
    and df["analysistime"].nunique() == 2 and (df.groupby(["place", "time"])["value"].nunique(dropna=False) == 1).all(),
}


@pytest.mark.skipif(not os.path.exists(SF), reason="test data missing")
@pytest.mark.parametrize("name", sorted(n for n in E.queries() if not n.startswith("op") and n != "pipeline"))
def test_query(spark, con, name):
    sp = E.queries()[name](spark, SF).toPandas()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(sp) and len(sp.columns), "no rows"
        assert BOUNDS[name](sp), sp.head(20).to_string()
        return
    ok, msg = compare(sp, con.sql(sql).df())
    assert ok, msg


def test_every_query_has_sql_or_a_bound():
    plain = {n for n in E.queries() if not n.startswith("op") and n != "pipeline"} - set(E.oracle_sql())
    assert plain == set(BOUNDS)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["station", "class", "count", "mean_avg_delay"]


ZONE_SENSITIVE = ["prj3_event_hour", "prj4_local_to_utc", "src3_delays_csv", "src7_forecast_text",
                  "win7_session_window", "agg1_hourly_count", "win5_running_mean", "fn21_parse_time"]


@pytest.mark.parametrize("name", ZONE_SENSITIVE)
def test_session_zone_independent(spark, con, name):
    """Results must not depend on the session time zone (the driver's
    session may not be UTC): rerun under a zone with DST."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        sp = E.queries()[name](spark, SF).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    ok, msg = compare(sp, con.sql(E.oracle_sql()[name]).df())
    assert ok, msg
