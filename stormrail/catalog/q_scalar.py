"""Registered queries: scalar functions (FN*) and projections (PRJ*)."""

from pyspark.sql import functions as F

from stormrail.catalog import query
from stormrail.catalog.util import R, r6, read_table, sql_r6, with_roles
from stormrail.functions import scalar as S

HEL_LAT, HEL_LON = 60.17, 24.94


@query("fn1_class4", with_roles("""
select station, time, train_type, cast(case when delay <= 10 then 0 when delay <= 50 then 1
  when delay <= 100 then 2 else 3 end as integer) as class from r_delays"""))
def fn1_class4(spark, sf):
    d = R.delays(spark, sf)
    return d.select("station", "time", "train_type", S.class_by_limits("delay").alias("class"))


@query("fn1_class4_avg", with_roles("""
select station, time, train_type, cast(case when a <= 10 then 0 when a <= 50 then 1
  when a <= 100 then 2 else 3 end as integer) as class
from (select *, case when train_count >= 1 then delay / train_count else 0.0 end as a from r_delays)"""))
def fn1_class4_avg(spark, sf):
    d = R.delays(spark, sf)
    return d.select("station", "time", "train_type",
                    S.class_by_limits(S.avg_delay("delay", "train_count")).alias("class"))


@query("fn2_threshold_class", with_roles("""
select key, line, cast(case when proba <= 0 then 0 when proba <= 0.2 then 1 when proba <= 0.4 then 2
  when proba <= 0.6 then 3 else 3 end as integer) as class from r_binary"""))
def fn2_threshold_class(spark, sf):
    b = R.binary_eval(spark, sf)
    return b.select("key", "line", S.threshold_class("proba").alias("class"))


@query("fn3_binary", with_roles("""
select station, time, train_type, cast(case when delay > 50 then 1 else 0 end as integer) as label
from r_delays"""))
def fn3_binary(spark, sf):
    d = R.delays(spark, sf)
    return d.select("station", "time", "train_type", S.binary_class("delay", 50).alias("label"))


@query("fn4_three_way", with_roles("""
select station, time, train_type, cast(case when delay > 20 then 1 when delay < 20 then 0 end as double) as label
from r_delays"""))
def fn4_three_way(spark, sf):
    d = R.delays(spark, sf)
    # nullable result: compared as double so that NULL stays NULL on both sides
    return d.select("station", "time", "train_type", S.three_way("delay", 20).cast("double").alias("label"))


@query("fn5_avg_delay", with_roles(f"""
select station, time, train_type,
  {sql_r6('case when train_count >= 1 then delay / train_count else 0.0 end')} as avg_delay from r_delays"""))
def fn5_avg_delay(spark, sf):
    d = R.delays(spark, sf)
    return d.select("station", "time", "train_type", r6(S.avg_delay("delay", "train_count")).alias("avg_delay"))


@query("fn6_no_rain", with_roles(f"""
select station, time, {sql_r6('case when prec = -1 then 0.0 else prec end')} as prec,
  {sql_r6('case when prec < 0 then 0.0 else prec end')} as prec_nonneg from r_obs"""))
def fn6_no_rain(spark, sf):
    o = R.observations(spark, sf)
    return o.select("station", "time", r6(S.no_rain_to_zero("prec")).alias("prec"),
                    r6(S.negative_to_zero("prec")).alias("prec_nonneg"))


@query("fn7_fn8_sentinel", with_roles(f"""
select station, time, {sql_r6('coalesce(vis, -99.0)')} as vis_edge, {sql_r6('coalesce(prec, -99.0)')} as prec_edge,
  {sql_r6('nullif(coalesce(vis, -99.0), -99.0)')} as vis_back from r_obs"""))
def fn7_fn8_sentinel(spark, sf):
    o = R.observations(spark, sf)
    return o.select("station", "time", r6(S.to_sentinel("vis")).alias("vis_edge"),
                    r6(S.to_sentinel("prec")).alias("prec_edge"),
                    r6(S.from_sentinel(S.to_sentinel("vis"))).alias("vis_back"))


@query("fn7_text_to_double", f"""
select o_orderkey, {sql_r6("try_cast(case when trim(t) in ('null','nan','NaN','NULL','') then null else trim(t) end as double)")} as v
from (select o_orderkey, case when o_orderstatus = 'F' then cast(o_totalprice as varchar)
      when o_orderstatus = 'O' then 'nan' else o_orderpriority end as t from orders)""")
def fn7_text_to_double(spark, sf):
    o = read_table(spark, sf, "orders")
    t = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string")) \
         .when(F.col("o_orderstatus") == "O", F.lit("nan")).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", r6(S.text_to_double(t)).alias("v"))


@query("fn9_fill_sentinel", with_roles(f"""
select station, time, {sql_r6('coalesce(vis, -99.0)')} as vis, {sql_r6('coalesce(prec, -99.0)')} as prec from r_obs"""))
def fn9_fill_sentinel(spark, sf):
    o = R.observations(spark, sf).select("station", "time", "vis", "prec").fillna(-99.0, ["vis", "prec"])
    return o.select("station", "time", r6("vis").alias("vis"), r6("prec").alias("prec"))


@query("fn10_distance", with_roles(f"""
select station, {sql_r6(f'6371 * sqrt(pow((radians({HEL_LON}) - radians(lon)) * cos((radians(lat) + radians({HEL_LAT})) / 2), 2) + pow(radians({HEL_LAT}) - radians(lat), 2))', 4)} as dist_km
from r_stations"""))
def fn10_distance(spark, sf):
    s = R.stations(spark, sf)
    return s.select("station", r6(S.equirect_km("lat", "lon", F.lit(HEL_LAT), F.lit(HEL_LON)), 4).alias("dist_km"))


@query("fn11_lat_band", with_roles("""
select station, time, train_type, cast(case when lat > 63.41 then 3 when lat > 61.55 then 2
  when lat > 59 then 1 else 0 end as integer) as band from r_reg"""))
def fn11_lat_band(spark, sf):
    r = R.regression_eval(spark, sf)
    return r.select("station", "time", "train_type", S.lat_band("lat").alias("band"))


@query("fn12_scale255", with_roles(f"""
select station, time, train_type,
  {sql_r6('255 * (delay - min(delay) over ()) / (max(delay) over () - min(delay) over ())')} as scaled
from r_delays"""))
def fn12_scale255(spark, sf):
    d = R.delays(spark, sf)
    lo, hi = d.agg(F.min("delay")).scalar(), d.agg(F.max("delay")).scalar()
    return d.select("station", "time", "train_type", r6(S.scale_0_255("delay", lo, hi)).alias("scaled"))


@query("fn13_keys", """
select l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') || 'T' || cast(hour(l_shipdate) as varchar) as date_hour,
  cast(l_quantity as varchar) || ',' || cast(l_discount as varchar) as latlon,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') as iso from lineitem""")
def fn13_keys(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     S.date_hour_key(F.to_date("l_shipdate"), F.hour("l_shipdate")).alias("date_hour"),
                     S.latlon_key("l_quantity", "l_discount").alias("latlon"),
                     S.iso_hour("l_shipdate").alias("iso"))


@query("fn14_strip_replace", """
select o_orderkey, replace(o_orderpriority, '-', '_') as priority,
  (select string_agg(x, '') from (select unnest(string_split(replace(e.props, '"', ''), '')) as x)) as props
from orders left join (select event_id, props from events) e on e.event_id = o_orderkey""")
def fn14_strip_replace(spark, sf):
    o = read_table(spark, sf, "orders")
    e = read_table(spark, sf, "events").select(F.col("event_id"), "props")
    j = o.join(e, o.o_orderkey == e.event_id, "left")
    return j.select("o_orderkey", S.dash_to_underscore("o_orderpriority").alias("priority"),
                    S.strip_chars("props", '"').alias("props"))


@query("fn15_split_words", """
select word, cast(count(*) as bigint) as n from (select unnest(string_split(p_type, ' ')) as word from part)
group by word""")
def fn15_split_words(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select(F.explode(S.split_list("p_type", " ")).alias("word")).groupBy("word") \
            .agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("fn16_date_parts", """
select l_orderkey, l_linenumber, cast(month(l_shipdate) as integer) as month,
  cast(dayofyear(l_shipdate) as integer) as doy, cast(hour(l_shipdate) as integer) as hour,
  cast(cast(l_shipdate as date) as varchar) as day from lineitem""")
def fn16_date_parts(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.month_of("l_shipdate").alias("month"),
                     S.dayofyear_of("l_shipdate").alias("doy"), S.hour_of("l_shipdate").alias("hour"),
                     S.date_of("l_shipdate").cast("string").alias("day"))


@query("fn17_epoch", """
select event_id, timestamp '1970-01-01' + to_seconds(cast(event_id * 3600 + 1700000000 as bigint)) as t from events""")
def fn17_epoch(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", S.epoch_to_ts(F.col("event_id") * 3600 + 1700000000).alias("t"))


@query("fn18_trunc_int", """
select o_orderkey, cast(trunc(o_totalprice / 1000 - 150) as integer) as v from orders""")
def fn18_trunc_int(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", S.trunc_int(F.col("o_totalprice") / 1000 - 150).alias("v"))


@query("fn19_proba_class", with_roles("""
select key, line, cast(proba >= 0.5 as integer) as c05, cast(proba >= 0.1 as integer) as c01 from r_binary"""))
def fn19_proba_class(spark, sf):
    b = R.binary_eval(spark, sf)
    return b.select("key", "line", S.proba_to_class("proba").alias("c05"), S.proba_to_class("proba", 0.1).alias("c01"))


@query("fn20_pad", """
select l_orderkey, array_to_string(list_concat(q, list_transform(range(greatest(0, 8 - len(q))), lambda x: -99)), ',') as padded
from (select l_orderkey, list_sort(list(cast(l_quantity as bigint))) as q from lineitem group by l_orderkey)""")
def fn20_pad(spark, sf):
    li = read_table(spark, sf, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("long"))).alias("q"))
    padded = S.pad_array("q", 8, -99)
    return g.select("l_orderkey", F.concat_ws(",", F.transform(padded, lambda x: x.cast("long").cast("string"))).alias("padded"))


@query("fn21_parse_time", """
select o_orderkey, try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') as d1,
  try_strptime(o_orderpriority, '%Y-%m-%d') as d2 from orders""")
def fn21_parse_time(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", S.parse_time(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d1"),
                    S.parse_time("o_orderpriority").alias("d2"))


@query("fn22_null_count", with_roles("""
select station, time, cast((prec is null)::int + (vis is null)::int + (gust is null)::int as integer) as n_null from r_obs"""))
def fn22_null_count(spark, sf):
    o = R.observations(spark, sf)
    return o.select("station", "time", S.null_count(["prec", "vis", "gust"]).alias("n_null"))


@query("fn23_json", """
select l_orderkey, l_linenumber, to_json({'key': l_orderkey, 'code': l_returnflag}) as js,
  cast(cast(json_extract(e.props, '$.k') as bigint) as double) as k
from lineitem left join events e on e.event_id = l_orderkey""")
def fn23_json(spark, sf):
    li = read_table(spark, sf, "lineitem")
    e = read_table(spark, sf, "events").select("event_id", "props")
    j = li.join(e, li.l_orderkey == e.event_id, "left")
    return j.select("l_orderkey", "l_linenumber",
                    F.to_json(F.struct(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("code"))).alias("js"),
                    F.from_json("props", "k long")["k"].cast("double").alias("k"))


_DIMENSIONS = range(64)


@query("fn24_soft_threshold", with_roles("select vec_id, " + ", ".join(
    sql_r6(f"sign(f{i}) * greatest(abs(f{i}) - 0.05, 0)") + f" as f{i}" for i in _DIMENSIONS) + " from r_vec"))
def fn24_soft_threshold(spark, sf):
    v = R.vectors(spark, sf)
    return v.select("vec_id", *[r6(S.soft_threshold(f"f{i}", 0.05)).alias(f"f{i}") for i in _DIMENSIONS])


_XY = "(" + " + ".join(f"f{i}*f{i + 32}" for i in range(32)) + ")"
_XX = "(" + " + ".join(f"f{i}*f{i}" for i in range(32)) + ")"
_YY = "(" + " + ".join(f"f{i}*f{i}" for i in range(32, 64)) + ")"


@query("fn25_tanimoto", with_roles(f"""
select vec_id, {sql_r6(f'{_XY} / nullif({_XX} + {_YY} - {_XY}, 0)')} as sim from r_vec"""))
def fn25_tanimoto(spark, sf):
    v = R.vectors(spark, sf)
    x = F.array(*[F.col(f"f{i}") for i in range(32)])
    y = F.array(*[F.col(f"f{i}") for i in range(32, 64)])
    return v.select("vec_id", r6(S.tanimoto(x, y)).alias("sim"))


@query("fn26_argmax", with_roles(f"""
select vec_id, cast(list_position(l, list_max(l)) - 1 as integer) as arg
from (select vec_id, [{", ".join(f"f{i}" for i in _DIMENSIONS)}] as l from r_vec)"""))
def fn26_argmax(spark, sf):
    v = R.vectors(spark, sf)
    return v.select("vec_id", S.argmax(F.array(*[F.col(f"f{i}") for i in _DIMENSIONS])).alias("arg"))


@query("prj3_event_hour", """
select l_orderkey, l_linenumber, cast(l_shipdate as date) + to_hours(l_linenumber + 1) as t from lineitem""")
def prj3_event_hour(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     S.event_hour(F.to_date("l_shipdate"), F.col("l_linenumber")).alias("t"))


@query("prj5_prj6_prj8", with_roles("""
select station, time, train_type, cast(month(time) as integer) as month,
  cast(case train_type when 'K' then 0 when 'L' then 1 when 'T' then 2 when 'M' then 3 end as integer) as type_code,
  train_count - 1 as shifted from r_delays"""))
def prj5_prj6_prj8(spark, sf):
    d = R.delays(spark, sf)
    return d.select("station", "time", "train_type", S.month_of("time").alias("month"),
                    S.train_type_code("train_type").alias("type_code"),
                    S.shift("train_count", -1).cast("long").alias("shifted"))
