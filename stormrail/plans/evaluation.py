"""Evaluation plans: station evaluation (EVAL1), classification evaluation
per period (EVAL2), ensemble band evaluation (FRAC1), metrics per name
(AGG25) and per chunk (WIN13).

Each is one aggregation over one DataFrame with ``GROUPING SETS`` instead of
a loop over stations, periods and the "all" rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.functions.constants import CLIMATOLOGY_RMSE_SUM, PERIOD_GAP_SECONDS
from stormrail.functions.scalar import lat_band
from stormrail.operators.metrics import binary_metrics, regression_aggs, regression_metrics
from stormrail.operators.quantiles import exact_quantiles
from stormrail.operators.sequences import gap_periods
from stormrail.session import stored


def station_evaluation(pred: DataFrame, station: str = "station", time: str = "time", y: str = "y",
                       yhat: str = "y_pred", gap_seconds: int = PERIOD_GAP_SECONDS,
                       climatology: float = CLIMATOLOGY_RMSE_SUM, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Per station x period (periods split where the time step exceeds the
    gap), per station, per period and overall: n, RMSE, MAE, R^2, median AE,
    skill. ``station``/``period`` are 'all' / -1 on the summary rows.

    The moment-type metrics come from one ``GROUPING SETS`` aggregation. For
    the medians equal errors of a (station, period) are counted once, and the
    counts, not the rows, are rolled up to the other sets."""
    p = gap_periods(pred, station, time, gap_seconds, tiebreak=tiebreak)
    # two passes read the periods (moments, error counts): written once, with the four columns they need
    p = stored(p.select(station, "period", y, yhat), "periods")
    g = p.groupingSets([[station, "period"], [station], ["period"], []], station, "period") \
         .agg(*regression_aggs(y, yhat, climatology))
    g = g.select(F.coalesce(F.col(station), F.lit("all")).alias(station),
                 F.coalesce(F.col("period"), F.lit(-1)).cast("long").alias("period"),
                 "n", "rmse", "mae", "r2", "skill")
    st, pe = F.col(station), F.col("period").cast("long")
    keys = F.array(F.struct(st.alias("s"), pe.alias("p")), F.struct(st.alias("s"), F.lit(-1).cast("long").alias("p")),
                   F.struct(F.lit("all").alias("s"), pe.alias("p")),
                   F.struct(F.lit("all").alias("s"), F.lit(-1).cast("long").alias("p")))
    errors = p.groupBy(station, "period", F.abs(F.col(yhat) - F.col(y)).alias("_ae")).agg(F.count(F.lit(1)).alias("_n"))
    tagged = errors.select(F.explode(keys).alias("k"), "_ae", "_n") \
                   .select(F.col("k.s").alias(station), F.col("k.p").alias("period"), "_ae", "_n")
    med = exact_quantiles(tagged, "_ae", [0.5], [station, "period"], prefix="_m", weight="_n") \
        .withColumnRenamed("_m_0_5", "median_ae")
    out = g.join(med, [station, "period"], "left")
    return out.select(station, "period", "n", "rmse", "mae", "r2", "median_ae", "skill")


def classification_evaluation(pred: DataFrame, period: str = "period", y: str = "y", p: str = "pred") -> DataFrame:
    """MET5 per period plus the overall row (period -1)."""
    per = binary_metrics(pred, y, p, [period])
    overall = binary_metrics(pred, y, p).withColumn(period, F.lit(-1))
    return per.unionByName(overall.select(*per.columns))


def band_evaluation(pred: DataFrame, station: str = "station", time: str = "time", lat: str = "lat",
                    y: str = "y", yhat: str = "y_pred") -> DataFrame:
    """FRAC1: per station RMSE / median AE / R^2 of the prediction and of the
    band's 0.1 and 0.9 quantiles (joined back by time and latitude band),
    plus the overall row. All quantiles are selected by radix, and all passes
    (bands, moments, errors) read the columns they need from one written table."""
    b = stored(pred.select(station, time, y, yhat, lat_band(lat).alias("band")), "bands")
    q = exact_quantiles(b, yhat, [0.1, 0.9], [time, "band"], prefix="_q")
    j = b.join(q, [time, "band"]).withColumnsRenamed({"_q_0_1": "q_low", "_q_0_9": "q_high"})
    aggs = []
    for col in (yhat, "q_low", "q_high"):
        e = F.col(col) - F.col(y)
        tag = "pred" if col == yhat else col
        aggs.append(F.sqrt(F.avg(e * e)).alias(f"rmse_{tag}"))
    aggs.append((F.lit(1.0) - F.when(F.var_pop(y) > 0, F.sum(F.pow(F.col(yhat) - F.col(y), 2))
                                     / (F.count(y) * F.var_pop(y)))).alias("r2"))
    g = j.groupingSets([[station], []], station).agg(F.count(F.lit(1)).cast("long").alias("n"), *aggs)
    g = g.withColumn(station, F.coalesce(F.col(station), F.lit("all")))
    errs = F.array(*[F.struct(F.lit("pred" if c == yhat else c).alias("m"), F.abs(F.col(c) - F.col(y)).alias("ae"))
                     for c in (yhat, "q_low", "q_high")])
    keys = F.array(F.col(station), F.lit("all"))
    tagged = j.select(F.explode(keys).alias("_s"), errs.alias("_errs")).select("_s", F.explode("_errs").alias("_e"))
    tagged = tagged.select(F.col("_s").alias(station), F.col("_e.m").alias("_metric"), F.col("_e.ae").alias("_ae"))
    med = exact_quantiles(tagged, "_ae", [0.5], [station, "_metric"], prefix="_m")
    wide = med.groupBy(station).pivot("_metric", ["pred", "q_low", "q_high"]).agg(F.first("_m_0_5"))
    wide = wide.select(station, *[F.col(m).alias(f"median_ae_{m}") for m in ("pred", "q_low", "q_high")])
    out = g.join(wide, station, "left")
    return out.select(station, "n", "rmse_pred", "median_ae_pred", "rmse_q_low", "median_ae_q_low",
                      "rmse_q_high", "median_ae_q_high", "r2")


def metrics_by_name(pred: DataFrame, name: str = "name", y: str = "y", yhat: str = "y_pred") -> DataFrame:
    """AGG25: prediction sets kept as rows with a name column; metrics per name."""
    return regression_metrics(pred, y, yhat, [name], climatology=None, median=True)
