"""Registered queries: filters, scans, reason codes, limits, orders (FLT*, SRC10/16, LIM*, TOP1, SRT*)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stormrail.catalog import query
from stormrail.catalog.q_plans import ING1_BODY, features
from stormrail.catalog.util import R, r6, read_table, sql_r6, with_roles
from stormrail.operators import filters as FL
from stormrail.operators.aggregates import station_order
from stormrail.operators.joins import with_reason_codes
from stormrail.operators.ordered import global_row_number

LI_KEYS = ["l_orderkey", "l_linenumber"]


@query("flt1_time_range", """
select l_orderkey, l_linenumber, l_shipdate from lineitem
where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01'""")
def flt1_time_range(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumnRenamed("l_shipdate", "time")
    return FL.time_range(li, "1996-01-01", "1997-01-01").select(*LI_KEYS, F.col("time").alias("l_shipdate"))


@query("flt2_stations_in", with_roles(f"""
select station, time, train_type, {sql_r6('delay')} as delay from r_delays where station in ('S1', 'S3', 'S5', 'S8')"""))
def flt2_stations_in(spark, sf):
    d = FL.stations_in(R.delays(spark, sf), ["S1", "S3", "S5", "S8"])
    return d.select("station", "time", "train_type", r6("delay").alias("delay"))


@query("flt2_stations_semi", with_roles(f"""
select station, time, train_type, {sql_r6('delay')} as delay from r_delays
where station in (select station from r_stations where lat > 63)"""))
def flt2_stations_semi(spark, sf):
    north = R.stations(spark, sf).where(F.col("lat") > 63).select("station")
    d = FL.stations_in(R.delays(spark, sf), north)
    return d.select("station", "time", "train_type", r6("delay").alias("delay"))


@query("flt3_winter", """
select l_orderkey, l_linenumber, l_shipdate from lineitem where month(l_shipdate) in (11, 12, 1, 2, 3, 4)""")
def flt3_winter(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return FL.winter_only(li, "l_shipdate").select(*LI_KEYS, "l_shipdate")


@query("flt4_equal_month", with_roles("""
select station, time, train_type, train_count from r_delays where train_type = 'K' and month(time) = 1"""))
def flt4_equal_month(spark, sf):
    d = FL.month_is(FL.where_equal(R.delays(spark, sf), train_type="K"), 1)
    return d.select("station", "time", "train_type", "train_count")


_CODES_JOIN = "from r_code_facts f left join r_codes c using (key)"


def _codes_joined(spark, sf):
    return with_reason_codes(R.code_facts(spark, sf), R.reason_codes(spark, sf), ["key"])


@query("join5_codes_exclude", with_roles(f"""
select key, code, cast(count as double) as count {_CODES_JOIN} where code is null or code not in ('R')"""))
def join5_codes_exclude(spark, sf):
    return FL.codes_exclude(_codes_joined(spark, sf), ["R"]).select("key", "code", F.col("count").cast("double").alias("count"))


@query("join5_codes_include", with_roles(f"""
select key, code, count {_CODES_JOIN} where code in ('R')"""))
def join5_codes_include(spark, sf):
    return FL.codes_include(_codes_joined(spark, sf), ["R"]).select("key", "code", "count")


@query("join5_fanout", with_roles(f"""select key, code, cast(count as double) as count {_CODES_JOIN}"""))
def join5_fanout(spark, sf):
    return _codes_joined(spark, sf).select("key", "code", F.col("count").cast("double").alias("count"))


@query("flt6_codes_labelled", with_roles(f"""
select key, code, label from (select *, cast(case when delay > 200000 then 1 else 0 end as integer) as label
{_CODES_JOIN}) where label = 0 or code in ('R')"""))
def flt6_codes_labelled(spark, sf):
    j = _codes_joined(spark, sf).withColumn("label", (F.col("delay") > 200000).cast("int"))
    return FL.codes_include_labelled(j, ["R"]).select("key", "code", "label")


@query("flt8_train_types", with_roles("""
select station, time, train_type from r_delays where train_type in ('K', 'L', '-99')"""))
def flt8_train_types(spark, sf):
    return FL.train_types_in(R.delays(spark, sf), ["K", "L"]).select("station", "time", "train_type")


@query("flt9_train_types_plain", with_roles("""
select station, time, train_type from r_delays where train_type in ('T')"""))
def flt9_train_types_plain(spark, sf):
    return FL.train_types_in(R.delays(spark, sf), ["T"], keep_sentinel=False).select("station", "time", "train_type")


@query("flt10_latlon", with_roles("""select station, time, train_type from r_reg where lat = 60.5 and lon = 23.4"""))
def flt10_latlon(spark, sf):
    return FL.at_latlon(R.regression_eval(spark, sf), "60.5,23.4").select("station", "time", "train_type")


@query("flt11_flt12_counts", with_roles("""
select station, time, train_type, train_count, cast(delay > 50 as integer) as delayed from r_delays where train_count > 2"""))
def flt11_flt12_counts(spark, sf):
    d = FL.min_train_count(R.delays(spark, sf), 2)
    return d.select("station", "time", "train_type", "train_count", (F.col("delay") > 50).cast("int").alias("delayed"))


@query("flt12_delayed", with_roles(f"""select station, time, train_type, {sql_r6('delay')} as delay from r_delays where delay > 50"""))
def flt12_delayed(spark, sf):
    return FL.delayed(R.delays(spark, sf), 50).select("station", "time", "train_type", r6("delay").alias("delay"))


@query("flt13_class_split", with_roles("""
select station, time, train_type, 'normal' as part from r_delays where (case when delay <= 10 then 0 when delay <= 50 then 1 when delay <= 100 then 2 else 3 end) < 2
union all
select station, time, train_type, 'delayed' as part from r_delays where (case when delay <= 10 then 0 when delay <= 50 then 1 when delay <= 100 then 2 else 3 end) >= 2"""))
def flt13_class_split(spark, sf):
    from stormrail.functions.scalar import class_by_limits
    d = R.delays(spark, sf).withColumn("class", class_by_limits("delay"))
    normal, late = FL.split_by_class(d, 2)
    cols = ["station", "time", "train_type"]
    return normal.select(*cols, F.lit("normal").alias("part")).unionByName(late.select(*cols, F.lit("delayed").alias("part")))


PERIODS = [("1996-01-01", "1996-02-29"), ("1996-02-01", "1996-03-31"), ("1998-06-01", "1998-06-30")]


@query("flt14_periods", """
select l_orderkey, l_linenumber, p.period from lineitem join (values
  ('1996-01-01-1996-02-29', timestamp '1996-01-01', timestamp '1996-03-01'),
  ('1996-02-01-1996-03-31', timestamp '1996-02-01', timestamp '1996-04-01'),
  ('1998-06-01-1998-06-30', timestamp '1998-06-01', timestamp '1998-07-01'),
  ('1996-01-01-1998-06-30', timestamp '1996-01-01', timestamp '1998-07-01')) p(period, s, e)
on l_shipdate >= p.s and l_shipdate < p.e""")
def flt14_periods(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return FL.tag_periods(li, PERIODS, "l_shipdate").select(*LI_KEYS, "period")


@query("flt15_dropna", with_roles(f"""
select station, time, {sql_r6('prec')} as prec, {sql_r6('vis')} as vis from r_obs where prec is not null and vis is not null"""))
def flt15_dropna(spark, sf):
    o = FL.drop_missing(R.observations(spark, sf), ["prec", "vis"])
    return o.select("station", "time", r6("prec").alias("prec"), r6("vis").alias("vis"))


@query("flt16_summer", """
select l_orderkey, l_linenumber from lineitem where l_shipdate >= timestamp '1996-03-15'
and l_shipdate < timestamp '1998-07-11' and month(l_shipdate) in (6, 7, 8)""")
def flt16_summer(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return FL.summer_between(li, "1996-03-15", "1998-07-10", "l_shipdate").select(*LI_KEYS)


@query("flt17_chunks", with_roles("""
select station, time, chunk from (
  select station, time, cast(ceil(date_diff('second', timestamp '2024-01-01', time) / 259200.0) - 1 as bigint) as chunk,
         date_diff('second', timestamp '2024-01-01', time) as secs from r_obs)
where secs > 0 and chunk < 9"""))
def flt17_chunks(spark, sf):
    o = R.observations(spark, sf).select("station", "time")
    return FL.assign_chunks(o, "2024-01-01", "2024-01-29", days=3).select("station", "time", "chunk")


@query("flt18_backfill_counts", """
select cast(floor(date_diff('day', timestamp '1995-01-01', l_shipdate) / 90) as bigint) as chunk,
  cast(count(*) as bigint) as n, {r} as qty
from lineitem where l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '2000-01-01' group by all""".format(
    r=sql_r6("sum(l_quantity)")))
def flt18_backfill_counts(spark, sf):
    li = FL.time_range(read_table(spark, sf, "lineitem"), "1995-01-01", "2000-01-01", "l_shipdate")
    ch = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")) / 90).cast("long")
    return li.groupBy(ch.alias("chunk")).agg(F.count(F.lit(1)).cast("long").alias("n"), r6(F.sum("l_quantity")).alias("qty"))


@query("src10_scan_features", with_roles(f"""
select station, time, train_type, {sql_r6('delay')} as delay, flashcount from ({ING1_BODY})
where time >= timestamp '2024-01-05' and time < timestamp '2024-01-20' and station in ('S2', 'S4', 'S6')
  and month(time) in (11, 12, 1, 2, 3, 4) and train_type = 'K'"""))
def src10_scan_features(spark, sf):
    f = features(spark, sf)
    out = FL.scan_features(f, "2024-01-05", "2024-01-20", cols=["station", "time", "train_type", "delay", "flashcount"],
                           stations=["S2", "S4", "S6"], winter=True, where={"train_type": "K"})
    return out.select("station", "time", "train_type", r6("delay").alias("delay"), "flashcount")


@query("lim1_page", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice limit 100 offset 200""")
def lim1_page(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return FL.scan_features(li, order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                       "l_extendedprice"], limit=100, offset=200) \
             .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("lim2_first_stations", with_roles("""select station from r_stations order by lat desc, station limit 5"""))
def lim2_first_stations(spark, sf):
    return R.stations(spark, sf).orderBy(F.col("lat").desc(), "station").limit(5).select("station")


_LI_ALL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("lim3_chunks_of_n", f"""
select l_orderkey, l_linenumber, l_partkey, cast((row_number() over (order by {', '.join(_LI_ALL)}) - 1) / 1000 as bigint) as chunk
from lineitem""".replace("/ 1000 as bigint", "// 1000 as bigint"))
def lim3_chunks_of_n(spark, sf):
    li = read_table(spark, sf, "lineitem")
    rn = global_row_number(li, _LI_ALL, "rn")
    return rn.select("l_orderkey", "l_linenumber", "l_partkey", F.floor((F.col("rn") - 1) / 1000).cast("long").alias("chunk"))


@query("top1_rank_report", with_roles(f"""
select train_type, station, mean_delay, rnk from (
  select train_type, station, {sql_r6('avg(delay)')} as mean_delay,
    cast(rank() over (partition by train_type order by avg(delay) desc) as integer) as rnk
  from r_delays group by train_type, station) where rnk <= 3"""))
def top1_rank_report(spark, sf):
    g = R.delays(spark, sf).groupBy("train_type", "station").agg(F.avg("delay").alias("m"))
    w = Window.partitionBy("train_type").orderBy(F.col("m").desc())
    return g.withColumn("rnk", F.rank().over(w).cast("int")).where(F.col("rnk") <= 3) \
            .select("train_type", "station", r6("m").alias("mean_delay"), "rnk")


@query("srt3_latlon_order", with_roles("""
select station, time, train_type, row_number() over (order by lat + lon, time, station, train_type) as pos from r_reg"""))
def srt3_latlon_order(spark, sf):
    r = R.regression_eval(spark, sf).withColumn("_k", F.col("lat") + F.col("lon"))
    return global_row_number(r, ["_k", "time", "station", "train_type"], "pos").select("station", "time", "train_type", "pos")


@query("srt4_station_order", with_roles("""
select station, row_number() over (order by lat, t, station) as "order" from (
  select station, min(lat) as lat, min(time) as t from r_reg group by station)"""))
def srt4_station_order(spark, sf):
    r = R.regression_eval(spark, sf)
    return station_order(r, "station", "lat", "time").select("station", F.col("order").cast("long").alias("order"))


@query("src16_dataset_window", f"""
select o_orderkey, o_orderdate, {sql_r6('o_totalprice')} as o_totalprice from orders
where o_orderdate >= timestamp '1996-06-01' and o_orderdate < timestamp '1996-09-01'""")
def src16_dataset_window(spark, sf):
    o = read_table(spark, sf, "orders")
    return FL.time_range(o, "1996-06-01", "1996-09-01", "o_orderdate").select(
        "o_orderkey", "o_orderdate", r6("o_totalprice").alias("o_totalprice"))
