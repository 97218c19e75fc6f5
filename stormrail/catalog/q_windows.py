"""Registered queries: per-station windows (WIN1-WIN6)."""

from pyspark.sql import functions as F

from stormrail.catalog import query
from stormrail.catalog.util import R, r6, sql_r6, with_roles
from stormrail.functions.scalar import no_rain_to_zero
from stormrail.operators import windows as W

_OBS_CLEAN = "select station, time, case when prec = -1 then 0.0 else prec end as prec from r_obs"


@query("win1_prec3h", with_roles(f"""
select station, time, {sql_r6('sum(prec) over (partition by station order by time rows between 2 preceding and current row)')} as prec_3h
from ({_OBS_CLEAN})"""))
def win1_prec3h(spark, sf):
    o = R.observations(spark, sf).select("station", "time", no_rain_to_zero("prec").alias("prec"))
    return W.precip_sums(o, "prec", sizes=(3,), names=["prec_3h"]).select("station", "time", r6("prec_3h").alias("prec_3h"))


@query("win2_prec6h", with_roles(f"""
select station, time, {sql_r6('sum(prec) over (partition by station order by time rows between 5 preceding and current row)')} as prec_6h
from ({_OBS_CLEAN})"""))
def win2_prec6h(spark, sf):
    o = R.observations(spark, sf).select("station", "time", no_rain_to_zero("prec").alias("prec"))
    return W.precip_sums(o, "prec", sizes=(6,), names=["prec_6h"]).select("station", "time", r6("prec_6h").alias("prec_6h"))


def _sentinel_sql(n: int) -> str:
    frame = f"over (partition by station order by time rows between {n - 1} preceding and current row)"
    return f"""case when row_number() over (partition by station order by time) <= {n} then -99.0
        when count(p) {frame} < {n} then null
        when sum(p) {frame} < 0 then -99.0 else {sql_r6(f'sum(p) {frame}')} end"""


@query("win3_prec_sums_sentinel", with_roles(f"""
select station, time, {_sentinel_sql(3)} as prec_3h, {_sentinel_sql(6)} as prec_6h
from (select station, time, case when prec < 0 then 0.0 else prec end as p from r_obs)"""))
def win3_prec_sums_sentinel(spark, sf):
    o = R.observations(spark, sf).select("station", "time", "prec")
    out = W.precip_sums_sentinel(o, "prec", names=["prec_3h", "prec_6h"])
    return out.select("station", "time", r6("prec_3h").alias("prec_3h"), r6("prec_6h").alias("prec_6h"))


@query("win4_drop_first6", with_roles("""
select station, time, n from (
  select station, time, n, row_number() over (partition by station order by time) as rn from r_obs)
where rn > 6"""))
def win4_drop_first6(spark, sf):
    o = R.observations(spark, sf).select("station", "time", "n")
    return W.drop_first_rows(o, 6)


@query("win5_running_mean", with_roles(f"""
select station, time, {sql_r6("avg(delay) over (partition by station order by time range between interval 5 hours preceding and current row)")} as delay_mean6h
from (select station, time, sum(delay) as delay from r_delays group by all)"""))
def win5_running_mean(spark, sf):
    d = R.delays(spark, sf).groupBy("station", "time").agg(F.sum("delay").alias("delay"))
    out = W.running_mean(d, "delay", hours=6)
    return out.select("station", "time", r6("delay_mean6h").alias("delay_mean6h"))


@query("win6_zero_below_mean", with_roles(f"""
select station, time, train_type,
  {sql_r6('case when avg(delay) over (partition by time) >= 20 then delay else 0.0 end')} as delay
from r_delays"""))
def win6_zero_below_mean(spark, sf):
    d = R.delays(spark, sf).select("station", "time", "train_type", "delay")
    return W.zero_below_step_mean(d, "delay", 20.0).select("station", "time", "train_type", r6("delay").alias("delay"))
