"""Registered queries: aggregations (AGG*)."""

from pyspark.sql import functions as F

from stormrail.catalog import query
from stormrail.catalog.util import R, r6, read_table, sql_r6, with_roles
from stormrail.functions.scalar import avg_delay, class_by_limits
from stormrail.catalog.q_plans import ING1_BODY
from stormrail.operators import aggregates as A

_CLASS_SQL = "cast(case when delay <= 10 then 0 when delay <= 50 then 1 when delay <= 100 then 2 else 3 end as integer)"


@query("agg1_hourly_count", with_roles("""
select station, date_trunc('hour', time) as time, count(*) as count from r_strikes group by all"""))
def agg1_hourly_count(spark, sf):
    return A.hourly_counts(R.strikes(spark, sf))


def _obs_with_group(spark, sf):
    o = R.observations(spark, sf)
    return o.withColumn("train_station", F.concat(F.lit("T"), (F.substring("station", 2, 10).cast("int") % 5).cast("string")))


@query("agg2_best_station", with_roles("""
select train_station, station, time from (
  select *, first_value(station) over (partition by train_station order by nn, time, station) as best from (
    select 'T' || (cast(substr(station, 2) as integer) % 5) as train_station, station, time,
      (prec is null)::int + (vis is null)::int + (gust is null)::int as nn from r_obs))
where station = best"""))
def agg2_best_station(spark, sf):
    o = _obs_with_group(spark, sf)
    return A.best_station(o, "train_station", "station", ["prec", "vis", "gust"], ["time", "station"]) \
            .select("train_station", "station", "time")


@query("agg3_aggs_by_name", with_roles(f"""
select station, cast(time as date)::varchar as day, {sql_r6('max(gust)')} as max_gust, {sql_r6('min(vis)')} as min_vis,
  {sql_r6('avg(prec)')} as mean_prec, {sql_r6('avg(n)')} as n_obs from r_obs group by all"""))
def agg3_aggs_by_name(spark, sf):
    o = R.observations(spark, sf).select("station", F.to_date("time").cast("string").alias("day"),
                                         F.col("gust").alias("max_gust"), F.col("vis").alias("min_vis"),
                                         F.col("prec").alias("mean_prec"), F.col("n").alias("n_obs"))
    g = A.aggregate_by_names(o, ["station", "day"], ["max_gust", "min_vis", "mean_prec", "n_obs"])
    return g.select("station", "day", *[r6(c).alias(c) for c in ["max_gust", "min_vis", "mean_prec", "n_obs"]])


@query("agg4_sum_types", with_roles(f"""
select station, time, cast(sum(train_count) as bigint) as train_count, {sql_r6('sum(y)')} as delay,
  max(lat) as lat, max(lon) as lon from (select r.*, d.train_count from r_reg r join r_delays d using (station, time, train_type))
group by all"""))
def agg4_sum_types(spark, sf):
    d = R.delays(spark, sf).join(R.stations(spark, sf).select("station", "lat", "lon"), "station")
    g = A.sum_train_types(d, sum_cols=("train_count", "delay"))
    return g.select("station", "time", F.col("train_count").cast("long").alias("train_count"),
                    r6("delay").alias("delay"), "lat", "lon")


_ROLL = ["max_value", "min_value", "mean_value", "sum_value", "sdev_value", "median_value"]


@query("agg5_hourly_rollup", f"""
select 'S' || user_id as station, date_trunc('hour', ts - interval 1 microsecond) + interval 1 hour as time,
  {sql_r6('max(value)')} as max_value, {sql_r6('min(value)')} as min_value, {sql_r6('avg(value)')} as mean_value,
  {sql_r6('sum(value)')} as sum_value, {sql_r6('stddev_pop(value)')} as sdev_value, {sql_r6('median(value)')} as median_value
from (select user_id, ts, floor(value * 4) / 4.0 as value from events) group by all""")
def agg5_hourly_rollup(spark, sf):
    e = read_table(spark, sf, "events")
    e = e.select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("station"),
                 F.col("ts").alias("time"), *[(F.floor(F.col("value") * 4) / 4.0).alias(c) for c in _ROLL])
    g = A.hourly_rollup(e, _ROLL)
    return g.select("station", "time", *[r6(c).alias(c) for c in _ROLL])


@query("agg6_two_level_mean", with_roles(f"""
select station, cast(dayofyear(time) as integer) as dayofyear, {sql_r6('avg(m)')} as mean_delay
from (select station, time, avg(delay) as m from r_delays group by all) group by all"""))
def agg6_two_level_mean(spark, sf):
    g = A.two_level_mean(R.delays(spark, sf), "delay", by="dayofyear")
    return g.select("station", "dayofyear", r6("mean_delay").alias("mean_delay"))


@query("agg6_two_level_hour", with_roles(f"""
select station, cast(hour(time) as integer) as hour, {sql_r6('avg(m)', 5)} as mean_total_delay
from (select station, time, avg(total_delay) as m from r_delays group by all) group by all"""))
def agg6_two_level_hour(spark, sf):
    g = A.two_level_mean(R.delays(spark, sf), "total_delay", by="hour")
    return g.select("station", "hour", r6("mean_total_delay", 5).alias("mean_total_delay"))


_MM = ", ".join(f"{sql_r6(f'avg({v})')} as mean_{v}, {sql_r6(f'median({v})')} as median_{v}" for v in ("delay", "total_delay"))


@query("agg7_mean_median", with_roles(f"""
select time, 'all' as "group", {_MM} from r_delays group by time
union all select time, train_type as "group", {_MM} from r_delays group by time, train_type
union all select time, 'passenger' as "group", {_MM} from r_delays where train_type in ('K', 'L') group by time"""))
def agg7_mean_median(spark, sf):
    g = A.mean_median_by_group(R.delays(spark, sf))
    cols = ["mean_delay", "median_delay", "mean_total_delay", "median_total_delay"]
    return g.select("time", "group", *[r6(c).alias(c) for c in cols])


@query("agg8_step_means", with_roles(f"""
select time, {sql_r6('avg(y)')} as mean_y, {sql_r6('avg(y_pred)')} as mean_y_pred from r_reg group by time"""))
def agg8_step_means(spark, sf):
    g = A.step_means(R.regression_eval(spark, sf), ["y", "y_pred"])
    return g.select("time", r6("mean_y").alias("mean_y"), r6("mean_y_pred").alias("mean_y_pred"))


@query("agg9_band_quantiles", with_roles(f"""
select time, band, {sql_r6('avg(y)')} as avg_delay, {sql_r6('avg(y_pred)')} as avg_pred_delay,
  {sql_r6('quantile_cont(y_pred, 0.1)')} as pred_low, {sql_r6('quantile_cont(y_pred, 0.9)')} as pred_high,
  {sql_r6('quantile_cont(y_pred, 0.05)')} as pred_low_wide, {sql_r6('quantile_cont(y_pred, 0.95)')} as pred_high_wide
from (select *, cast(case when lat > 63.41 then 3 when lat > 61.55 then 2 when lat > 59 then 1 else 0 end as integer) as band
      from r_reg) where band > 0 group by time, band"""))
def agg9_band_quantiles(spark, sf):
    g = A.band_quantiles(R.regression_eval(spark, sf))
    cols = ["avg_delay", "avg_pred_delay", "pred_low", "pred_high", "pred_low_wide", "pred_high_wide"]
    return g.select("time", "band", *[r6(c).alias(c) for c in cols])


@query("agg10_class_dist", with_roles(f"""
select class, count(*) as count, {sql_r6('count(*) * 100.0 / sum(count(*)) over ()')} as share
from (select {_CLASS_SQL} as class from r_delays) group by class"""))
def agg10_class_dist(spark, sf):
    d = R.delays(spark, sf).withColumn("class", class_by_limits("delay"))
    return A.class_distribution(d).select("class", "count", r6("share").alias("share"))


@query("agg11_min_class", with_roles(f"""
select cast(min(n) as bigint) as min_count from (select {_CLASS_SQL} as class, count(*) as n from r_delays group by 1)"""))
def agg11_min_class(spark, sf):
    d = R.delays(spark, sf).withColumn("class", class_by_limits("delay"))
    return A.min_class_size(d)


@query("agg12_batch_sizes", with_roles("""
select cast(min(n) as bigint) as min_size, cast(max(n) as bigint) as max_size,
  cast(floor(quantile_cont(n, 0.3)) as bigint) as q_size from (select time, count(*) as n from r_delays group by time)"""))
def agg12_batch_sizes(spark, sf):
    return A.batch_sizes(R.delays(spark, sf), quantile=0.3)


@query("agg13_hist11", f"""
select b.bin, {sql_r6('b.bin * 0.9090909090909091')} as bin_start, cast(coalesce(c.n, 0) as bigint) as count,
  {sql_r6('coalesce(c.n, 0) / ((select count(*) from lineitem where l_discount * 100 >= 0 and l_discount * 100 <= 10) * 0.9090909090909091)')} as density
from (select cast(range as integer) as bin from range(11)) b
left join (select cast(least(floor(l_discount * 100 / 0.9090909090909091), 10) as integer) as bin, count(*) as n
           from lineitem where l_discount * 100 >= 0 and l_discount * 100 <= 10 group by 1) c using (bin)""")
def agg13_hist11(spark, sf):
    li = read_table(spark, sf, "lineitem").select((F.col("l_discount") * 100).alias("v"))
    h = A.fixed_histogram(li, "v", 0.0, 10.0, 11)
    return h.select("bin", r6("bin_start").alias("bin_start"), "count", r6("density").alias("density"))


_H_FEATS = ["prec", "gust", "vis"]


_H_DENSITY = sql_r6('case when (hi - lo) / 50 > 0 then count / (sum(count) over (partition by "set", feature) * ((hi - lo) / 50)) end')


@query("agg14_hist50", with_roles(f"""
select "set", feature, bin, count, {_H_DENSITY} as density from g""",
    ("f", ING1_BODY),
    ("long", """select 'A' as "set", feature, value from (unpivot (select prec, gust, vis from f) on prec, gust, vis into name feature value value)
      union all
      select 'B' as "set", feature, value from (unpivot (select prec, gust, vis from f where delay > 50) on prec, gust, vis into name feature value value)"""),
    ("rng", """select "set", feature, min(value) as lo, max(value) as hi from long group by all"""),
    ("binned", """select l."set", l.feature, cast(case when (r.hi - r.lo) / 50 = 0 then 0
              else least(floor((l.value - r.lo) / ((r.hi - r.lo) / 50)), 49) end as integer) as bin, r.lo, r.hi
           from long l join rng r using ("set", feature)"""),
    ("g", """select "set", feature, bin, count(*) as count, min(lo) as lo, min(hi) as hi from binned group by all""")))
def agg14_hist50(spark, sf):
    from stormrail.catalog.q_plans import features
    f = features(spark, sf)
    h = A.feature_histograms(f, _H_FEATS, 50, subset=F.col("delay") > 50)
    return h.select("set", "feature", "bin", "count", r6("density").alias("density"))


@query("agg15_label_hist", with_roles("""select y, count(*) as count from r_binary group by y"""))
def agg15_label_hist(spark, sf):
    return A.label_histogram(R.binary_eval(spark, sf), "y")


@query("agg16_daily_count", """
select cast(d.day as date)::varchar as day, cast(coalesce(c.n, 0) as bigint) as count
from (select unnest(generate_series(min(cast(o_orderdate as date)), max(cast(o_orderdate as date)), interval 1 day)) as day from orders) d
left join (select cast(o_orderdate as date) as day, count(*) as n from orders group by 1) c
  on cast(d.day as date) = c.day""")
def agg16_daily_count(spark, sf):
    o = read_table(spark, sf, "orders")
    return A.daily_counts(o, "o_orderdate").select(F.col("day").cast("string").alias("day"), "count")


@query("agg17_time_range", with_roles("""select station, min(time) as first_time, max(time) as last_time from r_obs group by station"""))
def agg17_time_range(spark, sf):
    o = R.observations(spark, sf)
    return o.groupBy("station").agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@query("agg18_distinct_times", with_roles("""select distinct time from r_obs"""))
def agg18_distinct_times(spark, sf):
    return A.distinct_values(R.observations(spark, sf), ["time"])


@query("agg18_station_union", with_roles("""select src as station from r_edges union select dst from r_edges"""))
def agg18_station_union(spark, sf):
    return A.station_union(R.edges(spark, sf))


@query("agg19_first_per_key", with_roles(f"""
select station, time, train_type, {sql_r6('delay')} as delay from (
  select *, row_number() over (partition by station, time order by train_type) as rn from r_delays) where rn = 1"""))
def agg19_first_per_key(spark, sf):
    d = A.first_per_key(R.delays(spark, sf), ["station", "time"], ["train_type"])
    return d.select("station", "time", "train_type", r6("delay").alias("delay"))


@query("agg20_adjacency", with_roles("""
select src, array_to_string(list_sort(list(distinct dst)), ',') as neighbours from r_edges group by src"""))
def agg20_adjacency(spark, sf):
    a = A.adjacency(R.edges(spark, sf))
    return a.select("src", F.concat_ws(",", "neighbours").alias("neighbours"))


@query("agg20_adjacency_picked", with_roles("""
select src, array_to_string(list_sort(list(distinct dst)), ',') as neighbours from r_edges
where src in (select station from r_stations where lat < 63) and dst in (select station from r_stations where lat < 63)
group by src"""))
def agg20_adjacency_picked(spark, sf):
    picked = R.stations(spark, sf).where(F.col("lat") < 63).select("station")
    a = A.adjacency(R.edges(spark, sf), stations=picked)
    return a.select("src", F.concat_ws(",", "neighbours").alias("neighbours"))


@query("agg21_class_weights", with_roles(f"""
select class, {sql_r6('(select count(*) from r_delays) / ((select count(distinct ' + _CLASS_SQL + ') from r_delays) * count(*))')} as weight
from (select {_CLASS_SQL} as class from r_delays) group by class"""))
def agg21_class_weights(spark, sf):
    d = R.delays(spark, sf).withColumn("class", class_by_limits("delay"))
    return A.class_weights(d).select("class", r6("weight").alias("weight"))


@query("agg22_class_stats", with_roles(f"""
select label, feature, {sql_r6('avg(value)')} as mean, {sql_r6('var_pop(value)')} as var, count(value) as n
from (unpivot r_vec on {", ".join(f"f{i}" for i in range(64))} into name feature value value) group by all"""))
def agg22_class_stats(spark, sf):
    v = R.vectors(spark, sf)
    g = A.class_feature_stats(v, [f"f{i}" for i in range(64)], "label")
    return g.select("label", "feature", r6("mean").alias("mean"), r6("var").alias("var"), "n")


def _describe_sql():
    parts = []
    for c in ("delay", "total_delay"):
        for n, e in (("count", f"cast(count({c}) as double)"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"),
                     ("min", f"cast(min({c}) as double)"), ("25%", f"quantile_cont({c}, 0.25)"),
                     ("50%", f"quantile_cont({c}, 0.5)"), ("75%", f"quantile_cont({c}, 0.75)"),
                     ("max", f"cast(max({c}) as double)")):
            parts.append(f"select '{c}' as \"column\", '{n}' as stat, {sql_r6(e)} as value from r_delays")
    return with_roles("\nunion all ".join(parts))


@query("agg23_describe", _describe_sql())
def agg23_describe(spark, sf):
    d = A.describe(R.delays(spark, sf), ["delay", "total_delay"])
    return d.select("column", "stat", r6("value").alias("value"))


@query("agg24_share_below", with_roles(f"""
select {', '.join(f"{sql_r6(f'avg(cast(a < {k} as double))')} as share_below_{k}" for k in (10, 5, 3, 1))}
from (select case when train_count >= 1 then delay / train_count else 0.0 end as a from r_delays)"""))
def agg24_share_below(spark, sf):
    d = R.delays(spark, sf).withColumn("a", avg_delay("delay", "train_count"))
    s = A.share_below(d, "a")
    return s.select(*[r6(c).alias(c) for c in s.columns])


@query("agg26_climatology", with_roles(f"""select {sql_r6('avg(delay)')} as climatology from r_delays"""))
def agg26_climatology(spark, sf):
    return A.climatology(R.delays(spark, sf)).select(r6("climatology").alias("climatology"))
