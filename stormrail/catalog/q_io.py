"""Registered queries: readers and writers (SRC*, SNK*) as round trips.

Each query writes data derived from the driver tables into a fresh folder
under the session's shared checkpoint directory, reads it back with the
reader under test and returns what was read; the oracle computes the same
rows directly from the tables.
"""

from pyspark.sql import functions as F

from stormrail.catalog import query
from stormrail.catalog.util import R, r6, read_table, sql_r6, with_roles
from stormrail.sources import readers as RD
from stormrail.sources import sinks as SK

def _type():
    return F.when(F.col("l_returnflag") == "R", "K").when(F.col("l_returnflag") == "A", "L").otherwise("T")
_TYPE_SQL = "case l_returnflag when 'R' then 'K' when 'A' then 'L' else 'T' end"


@query("src1_stations_json", with_roles("select station, station_name, lat, lon from r_stations"))
def src1_stations_json(spark, sf):
    path = SK.scratch_path(spark, "stations")
    st = R.stations(spark, sf)
    SK.write_json(st.select(F.col("station").alias("stationShortCode"), F.col("station_name").alias("stationName"),
                            F.col("lat").alias("latitude"), F.col("lon").alias("longitude")), path)
    return RD.read_stations(spark, path)


@query("src3_delays_csv", f"""
select cast(l_shipdate as date) + to_hours(l_linenumber + 1) as time, 'S' || l_suppkey as station,
  {_TYPE_SQL} as train_type, cast(1 as bigint) as train_count, floor(l_extendedprice) / 1024.0 as total_delay,
  l_quantity as delay from lineitem""")
def src3_delays_csv(spark, sf):
    li = read_table(spark, sf, "lineitem")
    rows = li.select(F.to_date("l_shipdate").cast("string").alias("date"), F.col("l_linenumber").alias("start_hour"),
                     F.concat(F.lit("S"), F.expr("l_partkey div 20").cast("string")).alias("src"),
                     F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"),
                     _type().alias("train_type"), F.col("l_quantity").alias("sum_delay"), F.lit(0.0).alias("sum_ahead"),
                     (F.floor("l_extendedprice") / 1024.0).alias("add_delay"), F.lit(0.0).alias("add_ahead"),
                     F.lit(1).cast("long").alias("train_count"))
    path = SK.scratch_path(spark, "delays")
    rows.write.mode("overwrite").csv(path)
    return RD.read_delays_csv(spark, path)


@query("src4_delimited", """
select l_quantity as qty, l_discount as disc, l_tax as tax from lineitem""")
def src4_delimited(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"),
                                                  "l_quantity", "l_discount", "l_tax")
    path = SK.scratch_path(spark, "delimited")
    li.write.mode("overwrite").option("sep", ";").option("header", True).option("quoteAll", True).csv(path)
    return RD.read_delimited(spark, path, ["qty", "disc", "tax"], sep=";", skip_rows=1, skip_cols=1)


_OBS_NAMES = ["time", "place", "prec", "gust", "vis", "trainstation"]


@query("src5_observation_text", with_roles(f"""
select time, place, {sql_r6('prec')} as prec, {sql_r6('gust')} as gust, {sql_r6('vis')} as vis, trainstation from (
  select o.time, cast(s.lat as varchar) || ' ' || cast(s.lon as varchar) as place, o.prec, o.gust, o.vis, o.station as trainstation
  from r_obs o join r_stations s using (station))"""))
def src5_observation_text(spark, sf):
    o = R.observations(spark, sf).join(R.stations(spark, sf), "station")
    txt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    rows = o.select(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
                    F.concat_ws(" ", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("place"),
                    txt("prec").alias("prec"), txt("gust").alias("gust"),
                    F.coalesce(F.col("vis").cast("string"), F.lit("NULL")).alias("vis"), F.col("station").alias("trainstation"))
    path = SK.scratch_path(spark, "obs")
    rows.write.mode("overwrite").csv(path)
    back = RD.read_observation_text(spark, path, _OBS_NAMES)
    return back.select("time", "place", *[r6(c).alias(c) for c in ("prec", "gust", "vis")], "trainstation")


@query("src6_strike_text", with_roles("""select time, peak as peakcurrent, station as trainstation from r_strikes"""))
def src6_strike_text(spark, sf):
    s = R.strikes(spark, sf)
    rows = s.select(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"),
                    F.col("peak").cast("string").alias("peakcurrent"), F.col("station").alias("trainstation"))
    path = SK.scratch_path(spark, "strikes")
    rows.write.mode("overwrite").csv(path)
    return RD.read_strike_text(spark, path, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


_FC = ["time", "place", "gust", "n", "origintime"]


@query("src7_forecast_text", with_roles("""
select time, station as place, gust, cast(n as double) as n, time - interval 6 hours as origintime from r_obs"""))
def src7_forecast_text(spark, sf):
    o = R.observations(spark, sf)
    from stormrail.operators.ordered import epoch_seconds_ntz
    rows = o.select(epoch_seconds_ntz("time").cast("string").alias("time"), F.col("station").alias("place"),
                    F.col("gust").cast("string").alias("gust"), F.col("n").cast("string").alias("n"),
                    (epoch_seconds_ntz("time") - 6 * 3600).cast("string").alias("origintime"))
    path = SK.scratch_path(spark, "forecast")
    rows.write.mode("overwrite").option("sep", ";").csv(path)
    return RD.read_forecast_text(spark, path, _FC, sep=";")


@query("src8_renamed_csv", """select cast(o_orderkey as varchar) as order_id, o_orderpriority as priority from orders""")
def src8_renamed_csv(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    path = SK.scratch_path(spark, "renamed")
    o.write.mode("overwrite").csv(path)
    return RD.read_renamed_csv(spark, path, ["order_id", "priority"])


@query("src12_list_files", """select o_orderstatus as status, 1::bigint as files,
  cast(sum(length(cast(o_orderkey as varchar)) + 1) as bigint) as bytes from orders group by 1""")
def src12_list_files(spark, sf):
    path = SK.scratch_path(spark, "listing")
    # one folder for each status; the JSON copies beside them are not listed
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").repartition(1, "o_orderstatus")
    o.write.partitionBy("o_orderstatus").csv(f"{path}/text")
    o.write.json(f"{path}/json")
    found = RD.list_files(spark, path, "csv")
    return found.groupBy(F.regexp_extract("path", r"o_orderstatus=(\w+)/[^/]*[.]csv$", 1).alias("status")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").cast("long").alias("bytes"))


@query("src14_adjacency_list", with_roles("select src, dst from r_edges"))
def src14_adjacency_list(spark, sf):
    from stormrail.operators.aggregates import adjacency
    a = adjacency(R.edges(spark, sf)).select(F.concat("src", F.lit(":"), F.concat_ws(",", "neighbours")).alias("value"))
    path = SK.scratch_path(spark, "adjlist")
    a.write.mode("overwrite").text(path)
    return RD.read_adjacency_list(spark, path)


@query("src15_adjacency_matrix", with_roles("""
select distinct cast(substr(src, 2) as bigint) as i, cast(substr(dst, 2) as bigint) as j from r_edges"""))
def src15_adjacency_matrix(spark, sf):
    e = R.edges(spark, sf).select(F.substring("src", 2, 9).cast("int").alias("i"), F.substring("dst", 2, 9).cast("int").alias("j"))
    n = (e.agg(F.max(F.greatest("i", "j"))).first()[0] or 0) + 1  # stations are numbered from 0
    path = SK.scratch_path(spark, "matrix")
    SK.write_adjacency_matrix(e, n, path)
    return RD.read_adjacency_matrix(spark, path)


_ING_SEL = ["station", "time", "train_type", "train_count", "delay", "prec_3h", "flashcount"]


@query("snk1_json_roundtrip", with_roles(f"""
select station, time, train_type, train_count, {sql_r6('delay')} as delay, {sql_r6('prec_3h')} as prec_3h, flashcount
from ({{ING1}})""".replace("{ING1}", __import__("stormrail.catalog.q_plans", fromlist=["x"]).ING1_BODY)))
def snk1_json_roundtrip(spark, sf):
    from stormrail.catalog.q_plans import features
    f = features(spark, sf).select(*_ING_SEL)
    path = SK.scratch_path(spark, "features-json")
    SK.write_json(f, path)
    back = spark.read.schema(f.schema).json(path)
    return back.select("station", "time", "train_type", "train_count", r6("delay").alias("delay"),
                       r6("prec_3h").alias("prec_3h"), "flashcount")


@query("snk2_snk5_table", with_roles(f"""select station, time, train_type, {sql_r6('delay')} as delay from r_delays"""))
def snk2_snk5_table(spark, sf):
    import uuid
    name = f"stormrail_tmp_{uuid.uuid4().hex[:12]}"
    d = R.delays(spark, sf).select("station", "time", "train_type", "delay")
    path = SK.scratch_path(spark, "table")
    d.write.mode("overwrite").option("path", path).saveAsTable(name)
    n_table = RD.scan_table(spark, name).count()
    SK.drop_table(spark, name)
    rows = spark.read.parquet(path).select("station", "time", "train_type", r6("delay").alias("delay"))
    if n_table != rows.count():
        raise AssertionError("table and its files disagree")
    return rows


@query("snk4_glue_blocks", with_roles(f"""
select station, time, {sql_r6('prec')} as prec_obs, {sql_r6('gust')} as gust_obs from r_obs"""))
def snk4_glue_blocks(spark, sf):
    o = R.observations(spark, sf)
    a = o.select("station", "time", F.col("prec").alias("prec-obs"))
    b = o.select("station", "time", F.col("gust").alias("gust-obs"))
    g = SK.glue_blocks([a, b], ["station", "time"])
    return g.select("station", "time", r6("prec_obs").alias("prec_obs"), r6("gust_obs").alias("gust_obs"))


@query("snk6_station_csv", with_roles(f"""select station, time, {sql_r6('y')} as delay, {sql_r6('y_pred')} as pred_delay from r_reg"""))
def snk6_station_csv(spark, sf):
    r = R.regression_eval(spark, sf).select("station", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
                                            F.col("y").alias("delay"), F.col("y_pred").alias("pred_delay"))
    path = SK.scratch_path(spark, "station-csv")
    SK.write_station_csv(r, path)
    back = spark.read.option("sep", ";").option("header", True).schema(
        "time string, delay double, pred_delay double, station string").csv(path)
    return back.select("station", F.to_timestamp_ntz("time").alias("time"), r6("delay").alias("delay"),
                       r6("pred_delay").alias("pred_delay"))


@query("snk7_metrics_row", with_roles(f"""
select count(y) as n, {sql_r6('sqrt(avg(pow(y_pred - y, 2)))')} as rmse, {sql_r6('avg(abs(y_pred - y))')} as mae from r_reg"""))
def snk7_metrics_row(spark, sf):
    from stormrail.operators.metrics import regression_metrics
    m = regression_metrics(R.regression_eval(spark, sf), climatology=None).select("n", "rmse", "mae")
    path = SK.scratch_path(spark, "metrics")
    SK.write_metrics_row(m, path, "csv")
    back = spark.read.option("header", True).schema("n long, rmse double, mae double").csv(path)
    return back.select("n", r6("rmse").alias("rmse"), r6("mae").alias("mae"))


@query("snk8_serving_files", with_roles(f"""
select {sql_r6('gust')} as x0, cast(n as double) as x1, {sql_r6('coalesce(prec, -99.0)')} as x2 from r_obs"""))
def snk8_serving_files(spark, sf):
    o = R.observations(spark, sf).withColumn("prec", F.coalesce("prec", F.lit(-99.0)))
    path = SK.scratch_path(spark, "serving")
    SK.write_serving_files(o, ["gust", "n", "prec"], path, rows_per_file=100)
    back = spark.read.text(path).select(F.from_json("value", "X array<double>")["X"].alias("X"))
    return back.select(r6(F.col("X")[0]).alias("x0"), F.col("X")[1].alias("x1"), r6(F.col("X")[2]).alias("x2"))


@query("snk12_append_counted", with_roles("""
select station, time, train_type, train_count, case when train_type = 'K' then 'k' else 'rest' end as batch,
  cast(count(*) over () as bigint) as counted from r_delays"""))
def snk12_append_counted(spark, sf):
    """Two batches, one appended twice: every row once, and the counts of the appends."""
    path = SK.scratch_path(spark, "labels")
    d = R.delays(spark, sf).select("station", "time", "train_type", "train_count")
    k = d.where(F.col("train_type") == "K")
    n = SK.committed_append(k, path, "k")
    SK.committed_append(k, path, "k")
    n += SK.committed_append(d.where(F.col("train_type") != "K"), path, "rest")
    return SK.read_committed(spark, path, "batch").withColumn("counted", F.lit(n).cast("long"))


@query("snk13_overwrite_partition", with_roles(f"""
select station, time, train_type, {sql_r6('case when train_type = ' + "'K'" + ' then delay * 2 else delay end')} as delay from r_delays"""))
def snk13_overwrite_partition(spark, sf):
    d = R.delays(spark, sf).select("station", "time", "train_type", "delay")
    path = SK.scratch_path(spark, "partitioned")
    d.write.mode("overwrite").partitionBy("train_type").parquet(path)
    SK.overwrite_partitions(d.where(F.col("train_type") == "K").withColumn("delay", F.col("delay") * 2), path, ["train_type"])
    back = spark.read.parquet(path)
    return back.select("station", "time", "train_type", r6("delay").alias("delay"))


@query("snk14_splits", with_roles("""
select split, 'S-all' as location, count(*) as n from (select case when ('0x' || substr(md5(concat_ws('|', '42', station,
  cast(time as varchar), train_type)), 1, 8))::bigint % 100 < 30 then 'test' else 'train' end as split from r_delays) group by split"""))
def snk14_splits(spark, sf):
    from stormrail.operators.sampling import holdout
    d = holdout(R.delays(spark, sf).select("station", "time", "train_type"), ["station", "time", "train_type"], 30)
    path = SK.scratch_path(spark, "splits")
    SK.append_splits(d.where(F.col("split") == "train").drop("split"), d.where(F.col("split") == "test").drop("split"),
                     path, "S-all")
    back = spark.read.parquet(path)
    return back.groupBy("split", "location").agg(F.count(F.lit(1)).alias("n"))


@query("snk15_extract_period", """
select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1997-03-01'""")
def snk15_extract_period(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    path = SK.scratch_path(spark, "testset")
    SK.extract_period(o, "1997-01-01", "1997-03-01", path, "o_orderdate")
    return spark.read.parquet(path)


@query("snk11_insert_stations", with_roles("""select station, station_name, lat, lon from r_stations"""))
def snk11_insert_stations(spark, sf):
    path = SK.scratch_path(spark, "stations-sink")
    SK.append_stations(R.stations(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select("station", "station_name", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))


@query("snk17_model_roundtrip", with_roles(f"""
select station, time, train_type, {sql_r6('a + b * (y_pred / 25)', 3)} as prediction, true as missing_model_is_none
from r_reg, (select regr_intercept(y, y_pred / 25) as a, regr_slope(y, y_pred / 25) as b from r_reg)"""))
def snk17_model_roundtrip(spark, sf):
    from stormrail.operators.models import fit_model
    d = R.regression_eval(spark, sf).withColumn("tc", F.col("y_pred") / 25)
    m = fit_model(d, ["tc"], "y", "linear", regParam=0.0)
    path = SK.scratch_path(spark, "model")
    SK.save_model(m, path)
    loaded = SK.load_model(path)
    missing = SK.load_model(path + "-missing")
    out = loaded.transform(d).select("station", "time", "train_type", r6("prediction", 3).alias("prediction"))
    return out.withColumn("missing_model_is_none", F.lit(missing is None))


@query("str1_stream_hourly_count", with_roles("""
select station, date_trunc('hour', time) as time, count(*) as count from r_strikes group by all"""))
def str1_stream_hourly_count(spark, sf):
    from stormrail.streaming.strikes import run_hourly_counts
    s = R.strikes(spark, sf).select("station", "time")
    src = SK.scratch_path(spark, "strike-stream")
    # land the strikes as files in time order: one file per 5-day slice, as a feed would
    day = F.datediff(F.to_date("time"), F.lit("1970-01-01").cast("date"))
    s = s.withColumn("_slice", F.floor(day / 5))
    slices = [r[0] for r in s.select("_slice").distinct().orderBy("_slice").collect()]  # one row per slice
    for k in slices:
        s.where(F.col("_slice") == k).drop("_slice").coalesce(1).write.mode("append").parquet(src)
    out = SK.scratch_path(spark, "strike-stream-out")
    ckpt = SK.scratch_path(spark, "strike-stream-ckpt")
    return run_hourly_counts(spark, src, s.drop("_slice").schema, out, ckpt)



@query("snk8_serving_documents", with_roles(f"""
select cast((rn - 1) // 100 as bigint) as doc, count(*) as n, {sql_r6('sum(gust)')} as sum_x0 from (
  select gust, row_number() over (order by station, time) as rn from r_obs) group by 1"""))
def snk8_serving_documents(spark, sf):
    o = R.observations(spark, sf).withColumn("prec", F.coalesce("prec", F.lit(-99.0)))
    docs = SK.serving_documents(o, ["gust", "n", "prec"], ["station", "time"], 100)
    path = SK.scratch_path(spark, "serving-docs")
    docs.select("value").write.mode("overwrite").text(path)
    back = spark.read.text(path).select(F.from_json("value", "instances array<struct<X: array<double>>>")["instances"].alias("i"))
    # the document number is not in the text: recover it from the parsed rows via the same order
    parsed = back.select(F.size("i").alias("n"), F.aggregate("i", F.lit(0.0), lambda acc, x: acc + x["X"][0]).alias("s"))
    numbered = docs.select("doc", F.from_json("value", "instances array<struct<X: array<double>>>")["instances"].alias("i"))
    out = numbered.select("doc", F.size("i").cast("long").alias("n"),
                          r6(F.aggregate("i", F.lit(0.0), lambda acc, x: acc + x["X"][0])).alias("sum_x0"))
    # every written document parses back as valid JSON with the same content
    if parsed.where(F.col("n").isNull()).count() > 0 or parsed.count() != docs.count():
        raise AssertionError("serving documents did not parse back")
    return out



@query("src2_stations_by_name", with_roles("select station_name, station, lat, lon from r_stations"))
def src2_stations_by_name(spark, sf):
    path = SK.scratch_path(spark, "stations-by-name")
    st = R.stations(spark, sf)
    SK.write_json(st.select(F.col("station").alias("stationShortCode"), F.col("station_name").alias("stationName"),
                            F.col("lat").alias("latitude"), F.col("lon").alias("longitude")), path)
    return RD.read_stations(spark, path, key="name")


@query("src9_parameters", """
select 'max(value:' || event_type || ')' as param, 'max_' || event_type as name
from (select distinct event_type from events)""")
def src9_parameters(spark, sf):
    ev = read_table(spark, sf, "events").select("event_type").distinct()
    lines = ev.select(F.concat(F.lit("max(value:"), "event_type", F.lit(");max_"), "event_type").alias("value"))
    header = spark.createDataFrame([("time;time",), ("place;place",)], "value string")
    path = SK.scratch_path(spark, "params")
    header.unionByName(lines).coalesce(1).write.mode("overwrite").text(path)
    params, names = RD.read_parameters(spark, path, drop=0)  # a few lines: driver lists
    kept = [(p, n) for p, n in zip(params, names) if p not in ("time", "place")]
    return spark.createDataFrame(kept, "param string, name string")


@query("snk3_append_table", with_roles(f"""select station, time, train_type, {sql_r6('delay')} as delay from r_delays"""))
def snk3_append_table(spark, sf):
    import uuid
    name = f"stormrail_app_{uuid.uuid4().hex[:12]}"
    d = R.delays(spark, sf).select("station", "time", "train_type", "delay")
    path = SK.scratch_path(spark, "append-table")
    d.where(F.col("train_type") == "K").write.mode("overwrite").option("path", path).saveAsTable(name)
    d.where(F.col("train_type") != "K").write.mode("append").option("path", path).saveAsTable(name)
    n = RD.scan_table(spark, name).count()
    SK.drop_table(spark, name)
    rows = spark.read.parquet(path).select("station", "time", "train_type", r6("delay").alias("delay"))
    if rows.count() != n:
        raise AssertionError("appended table and its files disagree")
    return rows


@query("prj7_prj9_tag_drop", with_roles("""select station, time, 'S-all' as source, gust from r_obs"""))
def prj7_prj9_tag_drop(spark, sf):
    from stormrail.operators.filters import add_tag
    o = add_tag(R.observations(spark, sf), "S-all", "source")
    return o.drop("prec", "vis", "n")
