"""Registered queries: joins (JOIN*) and imputation (IMPU*)."""

from pyspark.sql import functions as F

from stormrail.catalog import query
from stormrail.catalog.util import R, r6, read_table, sql_r6, with_roles
from stormrail.operators import joins as J
from stormrail.operators.impute import impute_nearest

_RAD = "cast(0.017453292519943295 as double)"
_DIST = (f"6371 * sqrt(pow((b.lon * {_RAD} - a.lon * {_RAD}) * cos((a.lat * {_RAD} + b.lat * {_RAD}) / 2), 2)"
         f" + pow(b.lat * {_RAD} - a.lat * {_RAD}, 2))")


def _impute_sql(feats):
    parts = []
    for f in feats:
        parts.append(f"""imp_{f} as (select station, time, v as {f}_imp from (
      select a.station, a.time, b.{f} as v, row_number() over (partition by a.station, a.time
        order by {_DIST}, b.lat, b.lon, b.station) as rn
      from p a join p b on a.time = b.time and b.pos between a.pos - 2 and a.pos + 2 and b.station <> a.station
      where a.{f} is null and b.{f} is not null and {_DIST} <= 150) where rn = 1)""")
    joins = " ".join(f"left join imp_{f} using (station, time)" for f in feats)
    sel = ", ".join(f"{sql_r6(f'coalesce(p.{f}, {f}_imp)')} as {f}" for f in feats)
    notnull = " and ".join(f"coalesce(p.{f}, {f}_imp) is not null" for f in feats)
    return with_roles(f"""select station, time, {sel}, {sql_r6('gust')} as gust from p {joins} where {notnull}""",
                      ("o", "select o.station, o.time, s.lat, s.lon, o.prec, o.vis, o.gust from r_obs o join r_stations s using (station)"),
                      ("p", "select *, row_number() over (partition by time order by lat, lon, station) as pos from o"),
                      *[(f"imp_{f}", x.split(" as (", 1)[1][:-1]) for f, x in zip(feats, parts)])


@query("impu1_nearest", _impute_sql(["prec", "vis"]))
def impu1_nearest(spark, sf):
    # the station role has at most 20 rows by construction
    o = R.observations(spark, sf).join(F.broadcast(R.stations(spark, sf).select("station", "lat", "lon")), "station")
    o = o.select("station", "time", "lat", "lon", "prec", "vis", "gust")
    out = impute_nearest(o, ["prec", "vis"])
    return out.select("station", "time", r6("prec").alias("prec"), r6("vis").alias("vis"), r6("gust").alias("gust"))


@query("join1_outer_default", with_roles("""
select o.station, o.time, coalesce(f.flashcount, 0) as flashcount from r_obs o
left join (select station, date_trunc('hour', time) as time, count(*) as flashcount from r_strikes group by all) f
using (station, time)"""))
def join1_outer_default(spark, sf):
    from stormrail.operators.aggregates import hourly_counts
    w = R.observations(spark, sf).select("station", "time")
    f = hourly_counts(R.strikes(spark, sf), out="flashcount")
    return J.weather_with_flashes(w, f)


@query("join2_delay_weather", with_roles(f"""
select station, time, train_type, {sql_r6('gust')} as gust from r_delays join r_obs using (station, time)"""))
def join2_delay_weather(spark, sf):
    j = J.delays_with_weather(R.delays(spark, sf), R.observations(spark, sf))
    return j.select("station", "time", "train_type", r6("gust").alias("gust"))


@query("join3_labels_with", with_roles(f"""
select station, time, train_type, {sql_r6('vis')} as vis from r_delays join r_obs using (station, time)
where vis is not null"""))
def join3_labels_with(spark, sf):
    feats = R.observations(spark, sf).where(F.col("vis").isNotNull()).select("station", "time", "vis")
    with_f, _ = J.labels_with_features(R.delays(spark, sf).select("station", "time", "train_type"), feats)
    return with_f.select("station", "time", "train_type", r6("vis").alias("vis"))


@query("join4_labels_without", with_roles("""
select station, time, train_type from r_delays d
where not exists (select 1 from r_obs o where o.station = d.station and o.time = d.time and o.vis is not null)"""))
def join4_labels_without(spark, sf):
    feats = R.observations(spark, sf).where(F.col("vis").isNotNull()).select("station", "time", "vis")
    _, without = J.labels_with_features(R.delays(spark, sf).select("station", "time", "train_type"), feats)
    return without


@query("join6_common_times", with_roles("""
select 'obs' as side, station, time from r_obs where time in (select time from r_delays)
union all
select 'labels' as side, station, time from r_delays where time in (select time from r_obs)"""))
def join6_common_times(spark, sf):
    o1, l2 = J.common_times(R.observations(spark, sf).select("station", "time"), R.delays(spark, sf).select("station", "time"))
    return o1.select(F.lit("obs").alias("side"), "station", "time").unionByName(
        l2.select(F.lit("labels").alias("side"), "station", "time"))


@query("join7_interval_count", with_roles("""
select d.station, d.time, d.train_type,
  cast(case when d.rn = 1 then coalesce(c.n, 0) else 0 end as bigint) as flashcount
from (select station, time, train_type, row_number() over (partition by station, time order by train_type) as rn from r_delays) d
left join (select station, target, count(*) as n from (
    select s.station, (select min(x.time) from r_delays x where x.station = s.station and x.time >= s.time) as target
    from r_strikes s) where target is not null group by all) c
  on c.station = d.station and c.target = d.time"""))
def join7_interval_count(spark, sf):
    rows = R.delays(spark, sf).select("station", "time", "train_type")
    return J.interval_counts(rows, R.strikes(spark, sf), tiebreak=["train_type"]).select(
        "station", "time", "train_type", "flashcount")


@query("join9_unknown_default", with_roles("""
select e.src, e.dst, coalesce(s.station_name, 'unkown') as name from r_edges e
left join (select * from r_stations where lat < 64) s on s.station = e.dst"""))
def join9_unknown_default(spark, sf):
    dim = R.stations(spark, sf).where(F.col("lat") < 64)
    return J.ids_to_names(R.edges(spark, sf), dim, "dst", "station", "station_name").select("src", "dst", "name")


@query("join10_name_to_code", with_roles("""
select d.station_name, s.station as code from (select distinct 'Station ' || substr(station, 2) as station_name from r_delays) d
join r_stations s using (station_name)"""))
def join10_name_to_code(spark, sf):
    d = R.delays(spark, sf).select(F.concat(F.lit("Station "), F.substring("station", 2, 10)).alias("station_name")).distinct()
    return J.names_to_codes(d, R.stations(spark, sf), "station_name", "station_name", "station").select("station_name", "code")


@query("join11_rejects", with_roles("""
select distinct station from r_delays where station not in (select station from r_stations where lat < 62)"""))
def join11_rejects(spark, sf):
    dim = R.stations(spark, sf).where(F.col("lat") < 62)
    _, rejects = J.lookup_with_rejects(R.delays(spark, sf).select("station"), dim, "station", "station")
    return rejects


@query("join12_nested_by_station", with_roles("""
select station_name, cast(cast(time as date) as varchar) as day,
  string_agg(strftime(time, '%H') || '@' || cast(cast(y_pred as bigint) as varchar), ';' order by time, train_type) as predictions
from r_reg join r_stations using (station) group by all"""))
def join12_nested_by_station(spark, sf):
    # a place is named by its station: with many stations, several lie at the same latitude and longitude
    r = R.regression_eval(spark, sf).select("station", "time", "train_type", "y_pred")
    nested = J.predictions_by_station(r, R.stations(spark, sf), "station", "station_name",
                                      fields=("time", "train_type", "y_pred"), day="time")
    item = lambda x: F.concat(F.date_format(x["time"], "HH"), F.lit("@"), x["y_pred"].cast("long").cast("string"))
    return nested.select("station_name", F.col("day").cast("string").alias("day"),
                         F.concat_ws(";", F.transform("predictions", item)).alias("predictions"))


@query("join13_join_back_quantiles", with_roles(f"""
select r.station, r.time, r.train_type, {sql_r6('q.lo')} as pred_low from
(select *, cast(case when lat > 63.41 then 3 when lat > 61.55 then 2 when lat > 59 then 1 else 0 end as integer) as band from r_reg) r
join (select time, cast(case when lat > 63.41 then 3 when lat > 61.55 then 2 when lat > 59 then 1 else 0 end as integer) as band,
        quantile_cont(y_pred, 0.1) as lo from r_reg group by all) q using (time, band)"""))
def join13_join_back_quantiles(spark, sf):
    from stormrail.functions.scalar import lat_band
    from stormrail.operators.quantiles import exact_quantiles
    r = R.regression_eval(spark, sf).withColumn("band", lat_band("lat"))
    q = exact_quantiles(r, "y_pred", [0.1], ["time", "band"], prefix="_q").withColumnRenamed("_q_0_1", "lo")
    return J.join_back(r, q, ["time", "band"]).select("station", "time", "train_type", r6("lo").alias("pred_low"))


_SITES_SQL = """select distinct 'C' || c_custkey as site, 59.0 + (c_custkey % 100) / 10.0 as lat,
  20.0 + (c_custkey % 73) / 10.0 as lon from customer"""


def _sites(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).distinct()
    return c.select(F.concat(F.lit("C"), F.col("k").cast("string")).alias("site"),
                    (F.lit(59.0) + (F.col("k") % 100) / 10.0).alias("lat"),
                    (F.lit(20.0) + (F.col("k") % 73) / 10.0).alias("lon"))


_HAV = ("2 * 6371 * asin(least(1.0, sqrt(pow(sin((radians(s.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * "
        "cos(radians(s.lat)) * pow(sin((radians(s.lon) - radians(p.lon)) / 2), 2))))")


@query("join15_nearest5", with_roles(f"""
select station, site, {sql_r6('d', 3)} as dist_km, cast(rank as integer) as rank from (
  select p.station, s.site, {_HAV} as d, row_number() over (partition by p.station order by {_HAV}, s.site) as rank
  from r_stations p, sites s where {_HAV} <= 100) where rank <= 5""", ("sites", _SITES_SQL)))
def join15_nearest5(spark, sf):
    out = J.nearest_within(R.stations(spark, sf), _sites(spark, sf), 5, 100.0)
    return out.select("station", "site", r6("dist_km", 3).alias("dist_km"), F.col("rank").cast("int").alias("rank"))


@query("join16_row_links", with_roles("""
select a.station, a.time, cast(count(*) as bigint) as n_links from r_obs a
join (select src, dst from r_edges union select dst, src from r_edges) e on e.src = a.station
join r_obs b on b.station = e.dst and b.time = a.time group by all"""))
def join16_row_links(spark, sf):
    rows = R.observations(spark, sf).select("station", "time")
    return J.link_counts(rows, R.edges(spark, sf)).select("station", "time", "n_links")
