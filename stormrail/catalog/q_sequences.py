"""Registered queries: gap periods, time steps, sequences, batches (WIN7-WIN11, SEQ1)."""

from pyspark.sql import functions as F

from stormrail.catalog import query
from stormrail.catalog.util import R, read_table, with_roles
from stormrail.operators import sequences as SQ

_SERIES_SQL = "select distinct l_suppkey, l_shipdate as d from lineitem"


def _series(spark, sf):
    return read_table(spark, sf, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("d")).distinct()


@query("win7_gap_periods", f"""
select l_suppkey, d, cast(sum(flag) over (partition by l_suppkey order by d rows unbounded preceding) as bigint) as period
from (select l_suppkey, d, case when date_diff('second', lag(d) over (partition by l_suppkey order by d), d) > 2592000
      then 1 else 0 end as flag from ({_SERIES_SQL}))""")
def win7_gap_periods(spark, sf):
    return SQ.gap_periods(_series(spark, sf), "l_suppkey", "d").select("l_suppkey", "d", "period")


@query("win7_session_window", f"""
select l_suppkey, cast(count(distinct period) as bigint) as n_periods from (
  select l_suppkey, sum(flag) over (partition by l_suppkey order by d rows unbounded preceding) as period
  from (select l_suppkey, d, case when date_diff('second', lag(d) over (partition by l_suppkey order by d), d) > 2592000
        then 1 else 0 end as flag from ({_SERIES_SQL}))) group by l_suppkey""")
def win7_session_window(spark, sf):
    # batch session windows have the same boundary: a gap equal to the limit stays together
    s = _series(spark, sf)
    from stormrail.operators.ordered import epoch_seconds_ntz
    # the wall-clock time as an instant (zone-free), so DST never bends the gap
    t = F.timestamp_seconds(epoch_seconds_ntz("d"))
    g = s.groupBy("l_suppkey", F.session_window(t, "2592001 seconds").alias("w")).count()
    return g.groupBy("l_suppkey").agg(F.count(F.lit(1)).cast("long").alias("n_periods"))


@query("win8_mode_gap", f"""
with s as (select l_suppkey, d, date_diff('second', lag(d) over (partition by l_suppkey order by d), d) as step
           from ({_SERIES_SQL})),
c as (select l_suppkey, step, count(*) as n from s where step is not null group by l_suppkey, step),
m as (select l_suppkey, step as gap from (select l_suppkey, step, row_number() over
        (partition by l_suppkey order by n desc, step) as rn from c) where rn = 1)
select l_suppkey, d, cast(sum(case when step > gap then 1 else 0 end) over (partition by l_suppkey order by d
  rows unbounded preceding) as bigint) as period from s left join m using (l_suppkey)""")
def win8_mode_gap(spark, sf):
    return SQ.gap_periods(_series(spark, sf), "l_suppkey", "d", gap_seconds="mode").select("l_suppkey", "d", "period")


@query("win9_time_steps", with_roles("""
select station, time, train_type, step, cast((step - 1) // 24 as bigint) as batch from r_delays
join (select time, row_number() over (order by time) as step from (select distinct time from r_delays)) using (time)"""))
def win9_time_steps(spark, sf):
    d = R.delays(spark, sf).select("station", "time", "train_type")
    return SQ.time_steps(d, "time", 24).select("station", "time", "train_type", "step", "batch")


def _seq_str(col):
    return F.concat_ws(";", F.transform(col, lambda v: F.concat_ws(":", F.transform(v, lambda x: x.cast("string")))))


_SEQ_SQL = "array_to_string(list_transform(s, lambda v: array_to_string(list_transform(v, lambda x: cast(x as varchar)), ':')), ';')"


@query("win10_sequences", with_roles(f"""
select station, time, {_SEQ_SQL} as sequence, gust as target from (
  select station, time, gust, list([gust, cast(n as double)]) over (partition by station order by time
    rows between 3 preceding and 1 preceding) as s from r_obs) where len(s) = 3"""))
def win10_sequences(spark, sf):
    o = R.observations(spark, sf)
    out = SQ.sliding_sequences(o, ["gust", "n"], "gust", 3)
    return out.select("station", "time", _seq_str("sequence").alias("sequence"), F.col("gust").alias("target"))


@query("win10_global", with_roles(f"""
select station, time, {_SEQ_SQL} as sequence from (
  select station, time, list([gust, cast(n as double)]) over (order by time, station
    rows between 4 preceding and 1 preceding) as s from r_obs) where len(s) = 4"""))
def win10_global(spark, sf):
    o = R.observations(spark, sf)
    out = SQ.sliding_sequences(o, ["gust", "n"], "gust", 4, key=None, tiebreak=["station"])
    return out.select("station", "time", _seq_str("sequence").alias("sequence"))


@query("win11_skip_missing", with_roles(f"""
select station, time, {_SEQ_SQL} as sequence, vis as target from (
  select station, time, vis, list([gust, cast(n as double)]) over (partition by station order by time
    rows between 2 preceding and 1 preceding) as s,
    lead(time) over (partition by station order by time) as nxt from r_obs)
where len(s) = 2 and vis is not null and nxt is not null"""))
def win11_skip_missing(spark, sf):
    o = R.observations(spark, sf)
    out = SQ.sliding_sequences(o, ["gust", "n"], "vis", 2, skip_missing_target=True, drop_last=True)
    return out.select("station", "time", _seq_str("sequence").alias("sequence"), F.col("vis").alias("target"))


def _batch_sql(strategy):
    size = {"pad": "(select max(n) from sz)", "sample": "(select min(n) from sz)",
            "drop": "(select cast(floor(quantile_cont(n, 0.3)) as bigint) from sz)"}[strategy]
    where = "where n >= bs" if strategy == "drop" else ""
    pick = "where pick <= bs" if strategy in ("sample", "drop") else ""
    items = "list(x order by station)"
    pad_v = "list_concat(vals, list_transform(range(greatest(0, bs - len(vals))), lambda i: [-99.0, -99.0]))"
    pad_l = "list_concat(labs, list_transform(range(greatest(0, bs - len(labs))), lambda i: -99.0))"
    vals = pad_v if strategy == "pad" else "vals"
    labs = pad_l if strategy == "pad" else "labs"
    return with_roles(f"""
select time, {_SEQ_SQL.replace('(s,', f'({vals},')} as "values",
  array_to_string(list_transform({labs}, lambda x: cast(x as varchar)), ',') as labels, step,
  cast((step - 1) // 24 as bigint) as batch
from (select time, {items} as vals, list(y order by station) as labs, bs from (
        select o.station, o.time, [o.gust, cast(o.n as double)] as x, coalesce(o.prec, -99.0) as y, sz.n, {size} as bs,
          row_number() over (partition by o.time order by md5(o.station || '|' || cast(o.time as varchar)), o.station) as pick
        from r_obs o join sz using (time)) {where.replace('where', 'where') if where else ''} {('and ' + pick[6:]) if (pick and where) else pick}
      group by time, bs)
join (select time, row_number() over (order by time) as step from (select distinct time from r_obs {'' if strategy != 'drop' else 'join sz using (time) where sz.n >= ' + size})) using (time)""",
        ("sz", "select time, count(*) as n from r_obs group by time"))


def _batches(spark, sf, strategy):
    o = R.observations(spark, sf).withColumn("prec", F.coalesce("prec", F.lit(-99.0)))
    order = F.md5(F.concat_ws("|", "station", F.col("time").cast("string")))
    b = SQ.time_step_batches(o, ["gust", "n"], "prec", strategy, sample_order=order, quantile=0.3)
    return b.select("time", _seq_str("values").alias("values"),
                    F.concat_ws(",", F.transform("labels", lambda x: x.cast("string"))).alias("labels"),
                    "step", "batch")


@query("seq1_pad", _batch_sql("pad"))
def seq1_pad(spark, sf):
    return _batches(spark, sf, "pad")


@query("seq1_sample", _batch_sql("sample"))
def seq1_sample(spark, sf):
    return _batches(spark, sf, "sample")


@query("seq1_drop", _batch_sql("drop"))
def seq1_drop(spark, sf):
    return _batches(spark, sf, "drop")
