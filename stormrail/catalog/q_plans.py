"""Registered queries: compound plans (ING1, BAL1, HEAT1, EVAL*, FRAC1, PRED*)."""

from pyspark.sql import functions as F

from stormrail.catalog import query
from stormrail.catalog.util import R, r6, sql_r6, with_roles
from stormrail.plans.ingest import build_features
from stormrail.sources.sinks import committed_append, read_committed, scratch_path

WEATHER = ["prec", "gust", "vis", "n", "prec_3h", "prec_6h"]

ING1_BODY = (f"""
select d.station, d.time, d.train_type, d.train_count, {sql_r6('d.delay')} as delay,
  {sql_r6('d.total_delay')} as total_delay,
  {", ".join(f"{sql_r6(f'coalesce(cast(ws.{c} as double), -99.0)')} as {c}" for c in WEATHER)},
  coalesce(f.flashcount, 0) as flashcount
from r_delays d
join (select station, time, prec, gust, vis, n,
        sum(prec) over (partition by station order by time rows between 2 preceding and current row) as prec_3h,
        sum(prec) over (partition by station order by time rows between 5 preceding and current row) as prec_6h
      from (select station, time, case when prec = -1 then 0.0 else prec end as prec, gust, vis, n from r_obs)) ws
  using (station, time)
left join (select station, date_trunc('hour', time) as time, count(*) as flashcount from r_strikes group by all) f
  using (station, time)""")
ING1_SQL = with_roles(ING1_BODY)


def features(spark, sf):
    return build_features(R.delays(spark, sf), R.observations(spark, sf), R.strikes(spark, sf))


@query("ing1_features", ING1_SQL)
def ing1_features(spark, sf):
    f = features(spark, sf)
    return f.select("station", "time", "train_type", "train_count", r6("delay").alias("delay"),
                    r6("total_delay").alias("total_delay"), *[r6(c).alias(c) for c in WEATHER], "flashcount")


from stormrail.operators.sets import concat_all, difference, union_times  # noqa: E402
from stormrail.plans.heatmap import heatmap_long, heatmap_wide  # noqa: E402

_HEAT_SQL = f"""
with l1 as (select station, time, avg(y) as m, min(lat) as lat from r_reg {{where}} group by station, time),
mm as (select min(m) as lo, max(m) as hi from l1),
l2 as (select station, cast({{part}}(time) as integer) as {{by}}, avg(m) as mean from l1 group by all),
o as (select station, row_number() over (order by lat, t, station) as "order" from
      (select station, min(lat) as lat, min(time) as t from l1 group by station))
select l2.station, l2.{{by}}, {sql_r6('mean')} as mean,
  {sql_r6('case when hi - lo <> 0 then 255 * (mean - lo) / (hi - lo) end')} as scaled, cast(o."order" as bigint) as "order"
from l2 join o using (station), mm"""


@query("heat1_long", with_roles(_HEAT_SQL.format(where="", part="dayofyear", by="dayofyear")))
def heat1_long(spark, sf):
    h = heatmap_long(R.regression_eval(spark, sf).withColumnRenamed("y", "delay"))
    return h.select("station", "dayofyear", r6("mean").alias("mean"), r6("scaled").alias("scaled"),
                    F.col("order").cast("long").alias("order"))


@query("heat1_passenger_hour", with_roles(_HEAT_SQL.format(where="where train_type in ('K', 'L')", part="hour", by="hour")))
def heat1_passenger_hour(spark, sf):
    h = heatmap_long(R.regression_eval(spark, sf).withColumnRenamed("y", "delay"), by="hour", train_types=["K", "L"])
    return h.select("station", "hour", r6("mean").alias("mean"), r6("scaled").alias("scaled"),
                    F.col("order").cast("long").alias("order"))


@query("heat1_wide", with_roles("""
select dayofyear, array_to_string(list(coalesce(cast(cast(floor(h.scaled * 1000 + 0.5) as bigint) as varchar), '') order by s.lat, s.station), ';') as "values"
from (select dayofyear, station, lat from (select distinct dayofyear from h), r_stations) s left join h using (station, dayofyear)
group by dayofyear""",
                                 ("h", _HEAT_SQL.format(where="", part="dayofyear", by="dayofyear")
                                  .replace("with l1 as", "select * from (with l1 as") + ")")))
def heat1_wide(spark, sf):
    h = heatmap_long(R.regression_eval(spark, sf).withColumnRenamed("y", "delay"))
    _, matrix = heatmap_wide(h.withColumn("scaled", r6("scaled")), R.stations(spark, sf))
    cell = F.transform("values", lambda v: F.coalesce(F.floor(v * 1000 + 0.5).cast("string"), F.lit("")))
    return matrix.select("dayofyear", F.array_join(cell, ";").alias("values"))


@query("set1_union_by_name", with_roles("""
select station, time, 'delay' as source, cast(null as double) as gust from r_delays
union all select station, time, null as source, gust from r_obs"""))
def set1_union_by_name(spark, sf):
    d = R.delays(spark, sf).select("station", "time", F.lit("delay").alias("source"))
    o = R.observations(spark, sf).select("station", "time", "gust")
    return concat_all([d, o])


@query("set2_union_times", with_roles("""select time from r_delays union select time from r_obs"""))
def set2_union_times(spark, sf):
    return union_times([R.delays(spark, sf), R.observations(spark, sf)])


@query("set3_difference", with_roles("""
select station, time, train_type from r_delays d where not exists
  (select 1 from r_obs o where o.station = d.station and o.time = d.time)"""))
def set3_difference(spark, sf):
    return difference(R.delays(spark, sf).select("station", "time", "train_type"), R.observations(spark, sf),
                      ["station", "time"])


@query("set4_all_stations", with_roles(f"""
select station, count(*) as n, {sql_r6('avg(y)')} as mean_y from r_reg group by station"""))
def set4_all_stations(spark, sf):
    r = R.regression_eval(spark, sf)
    return r.groupBy("station").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("mean_y"))


@query("srt1_order_by", with_roles("""select station, time, train_type from r_delays order by station, time, train_type"""))
def srt1_order_by(spark, sf):
    return R.delays(spark, sf).select("station", "time", "train_type").orderBy("station", "time", "train_type")


@query("prj4_local_to_utc", """
select l_orderkey, l_linenumber,
  cast(timezone('UTC', case when timezone('Europe/Helsinki', t - interval 1 hour) = loc then t - interval 1 hour else t end)
       as timestamp) as utc
from (select l_orderkey, l_linenumber, loc, timezone('Europe/Helsinki', loc) as t
      from (select *, l_shipdate + to_hours(l_linenumber) as loc from lineitem))""")
def prj4_local_to_utc(spark, sf):
    from stormrail.functions.scalar import local_to_utc
    li = R.read_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     local_to_utc(F.timestamp_add("HOUR", F.col("l_linenumber"), F.col("l_shipdate")),
                                  "Europe/Helsinki").alias("utc"))


def _forecast_inputs(spark, sf):
    from stormrail.operators.models import per_group_linear
    st = R.stations(spark, sf)
    places = st.select(F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("place"),
                       "station_name", "station")
    hist = features(spark, sf).join(st.select("station", "station_name"), "station")
    coefs = per_group_linear(hist, "station_name", ["prec_3h", "gust"], "delay")
    fc = R.observations(spark, sf).join(places, "station").select("place", "time", "prec", "gust")
    return fc, coefs, places


@query("pred3_forecast_scoring")
def pred3_forecast_scoring(spark, sf):
    """Predicted values, inserted as one committed batch for each analysis (and once again, which changes nothing)."""
    from stormrail.plans.forecast import insert_predictions, score_forecasts
    fc, coefs, places = _forecast_inputs(spark, sf)
    scored = score_forecasts(fc, coefs, places, ["prec_3h", "gust"]).select("place", "time", "value")
    path = scratch_path(spark, "predictions")
    for analysis in ("2024-01-01 00:00:00", "2024-01-01 06:00:00", "2024-01-01 00:00:00"):
        insert_predictions(scored, path, analysis)
    return read_committed(spark, path).select("place", "time", "value", "analysistime")


@query("snk9_insert_new", with_roles("""
select station, time, cast(time + interval 6 hours as timestamp) as analysistime from r_obs where day(time) >= 10
except select station, time, cast(time + interval 6 hours as timestamp) from r_obs where day(time) < 20"""))
def snk9_insert_new(spark, sf):
    from stormrail.plans.forecast import rows_to_insert
    o = R.observations(spark, sf).select("station", "time",
                                         F.timestamp_add("HOUR", F.lit(6), F.col("time")).alias("analysistime"))
    path = scratch_path(spark, "forecasts")
    committed_append(o.where(F.dayofmonth("time") < 20), path, "stored")
    new = rows_to_insert(o.where(F.dayofmonth("time") >= 10), read_committed(spark, path), ["station", "time", "analysistime"])
    for _ in range(2):  # the second time changes nothing
        committed_append(new, path, "new")
    return read_committed(spark, path, "batch").where("batch = 'new'").drop("batch")


@query("snk10_retention", with_roles("""
select station, time, analysistime from (select station, time, cast(time + interval 6 hours as timestamp) as analysistime from r_obs)
where not (analysistime < timestamp '2024-01-15' and time < timestamp '2024-01-15')"""))
def snk10_retention(spark, sf):
    from stormrail.plans.forecast import retention
    o = R.observations(spark, sf).select("station", "time",
                                         F.timestamp_add("HOUR", F.lit(6), F.col("time")).alias("analysistime"))
    return retention(o, "2024-01-15 00:00:00")
