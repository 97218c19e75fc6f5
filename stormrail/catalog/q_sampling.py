"""Registered queries: sampling, balancing and splits (SMP*, SPL*, BAL1)."""

from pyspark.sql import functions as F

from stormrail.catalog import query
from stormrail.catalog.util import R, r6, sql_r6, with_roles
from stormrail.functions.scalar import class_by_limits
from stormrail.operators import sampling as SM
from stormrail.plans.balance import balance_dataset

_DKEYS = ["station", "time", "train_type"]
_H = "md5(concat_ws('|', '42', station, cast(time as varchar), train_type))"
_CLASS_SQL = "cast(case when delay <= 10 then 0 when delay <= 50 then 1 when delay <= 100 then 2 else 3 end as integer)"


@query("smp1_exact_sample", with_roles(f"""
select station, time, train_type from r_delays order by {_H}, station, time, train_type limit 1000"""))
def smp1_exact_sample(spark, sf):
    d = R.delays(spark, sf).select(*_DKEYS)
    return SM.exact_sample(d, 1000, _DKEYS)


@query("smp2_downsample", with_roles(f"""
select station, time, train_type, class from (
  select *, row_number() over (partition by class order by {_H}, station, time, train_type) as rk from (
    select *, {_CLASS_SQL} as class from r_delays))
where rk <= (select min(n) from (select {_CLASS_SQL} as class, count(*) as n from r_delays group by 1))"""))
def smp2_downsample(spark, sf):
    d = R.delays(spark, sf).withColumn("class", class_by_limits("delay"))
    return SM.downsample_to_smallest(d, _DKEYS, "class").select(*_DKEYS, "class")


def _smp3_sql(ratio, n_samples=None):
    return with_roles(f"""
with b as (select *, cast(delay > 50 as integer) as label from r_delays),
c as (select label, count(*) as n from b group by label),
p1 as (select {'least(min(n), ' + str(n_samples) + ' / ' + str(ratio + 1) + ')' if n_samples else 'min(n)'} as cnt from c),
p2 as (select cast(floor(cnt) as bigint) as cnt, cast(floor(least({ratio} * floor(cnt), (select n from c where label = 0))) as bigint) as cnt0 from p1),
p3 as (select case when cnt0 / {ratio} < cnt then cast(floor(cnt0 / {ratio}) as bigint) else cnt end as cnt, cnt0 from p2),
r as (select *, row_number() over (partition by label order by {_H}, station, time, train_type) as rk from b)
select station, time, train_type, label from r, p3
where (label = 0 and rk <= p3.cnt0) or (label = 1 and rk <= p3.cnt)""")


@query("smp3_ratio_downsample", _smp3_sql(2.0))
def smp3_ratio_downsample(spark, sf):
    d = R.delays(spark, sf).withColumn("label", (F.col("delay") > 50).cast("int"))
    return SM.ratio_downsample(d, _DKEYS, 2.0, "label").select(*_DKEYS, "label")


@query("smp3_ratio_capped", _smp3_sql(3.0, 4000))
def smp3_ratio_capped(spark, sf):
    d = R.delays(spark, sf).withColumn("label", (F.col("delay") > 50).cast("int"))
    return SM.ratio_downsample(d, _DKEYS, 3.0, "label", n_samples=4000).select(*_DKEYS, "label")


@query("smp6_pick_out", with_roles(f"""
select station, time, train_type, case when row_number() over (order by {_H}, station, time, train_type) <= 500
  then 'picked' else 'rest' end as part from r_delays"""))
def smp6_pick_out(spark, sf):
    d = R.delays(spark, sf).select(*_DKEYS)
    picked, rest = SM.pick_out(d, 500, _DKEYS)
    return picked.withColumn("part", F.lit("picked")).unionByName(rest.withColumn("part", F.lit("rest")))


@query("spl1_holdout", with_roles(f"""
select station, time, train_type, case when ('0x' || substr({_H}, 1, 8))::bigint % 100 < 30 then 'test' else 'train' end as split
from r_delays"""))
def spl1_holdout(spark, sf):
    d = R.delays(spark, sf).select(*_DKEYS)
    return SM.holdout(d, _DKEYS, 30)


@query("spl2_ordered", with_roles("""
select station, time, train_type, case when row_number() over (order by time, station, train_type)
  > count(*) over () - ceil(count(*) over () * 0.3) then 'test' else 'train' end as split from r_delays"""))
def spl2_ordered(spark, sf):
    d = R.delays(spark, sf).select(*_DKEYS)
    return SM.ordered_holdout(d, ["time", "station", "train_type"], 0.3)


@query("spl3_folds", with_roles("""
with r as (select station, time, train_type, row_number() over (order by time, station, train_type) as p,
             count(*) over () as n from r_delays),
s as (select *, n // 6 as s, n - 5 * (n // 6) as st from r)
select station, time, train_type,
  cast(case when p > st and s > 0 then (p - st - 1) // s + 1 end as double) as test_fold,
  cast(case when greatest(1, ceil((p - st) / s) + 1) <= 5 and s > 0 then greatest(1, ceil((p - st) / s) + 1) end as double) as first_train_fold
from s"""))
def spl3_folds(spark, sf):
    d = R.delays(spark, sf).select(*_DKEYS)
    f = SM.time_folds(d, ["time", "station", "train_type"], 5)
    # nullable fold numbers are compared as doubles (NULL stays NULL on both sides)
    return f.select(*_DKEYS, F.col("test_fold").cast("double").alias("test_fold"),
                    F.col("first_train_fold").cast("double").alias("first_train_fold"))


@query("spl4_enough_rows", with_roles("""
select station, time, train_type from r_delays where station in
  (select station from r_delays group by station having count(*) >= (select count(*) / count(distinct station) from r_delays))"""))
def spl4_enough_rows(spark, sf):
    d = R.delays(spark, sf).select(*_DKEYS)
    n, stations = d.agg(F.count(F.lit(1)), F.count_distinct("station")).first()
    return SM.enough_rows(d, n / max(stations, 1))


_BAL_CLASS = "cast(case when a <= 10 then 0 when a <= 50 then 1 when a <= 100 then 2 else 3 end as integer)"


@query("bal1_balance", with_roles(f"""
with b as (select station, time, train_type, {sql_r6('a')} as delay, {_BAL_CLASS} as class from (
  select *, case when train_count >= 1 then delay / train_count else 0.0 end as a from r_delays where train_type in ('K', 'L', '-99'))),
r as (select *, row_number() over (partition by class order by {_H}, station, time, train_type) as rk from b)
select station, time, train_type, delay, class from r where rk <= (select min(n) from (select class, count(*) as n from b group by class))"""))
def bal1_balance(spark, sf):
    out, _ = balance_dataset(R.delays(spark, sf), ["K", "L"])
    return out.select(*_DKEYS, r6("delay").alias("delay"), "class")


@query("bal1_class_dist", with_roles(f"""
select class, count(*) as count, {sql_r6('count(*) * 100.0 / sum(count(*)) over ()')} as share from (
  select {_BAL_CLASS} as class from (select case when train_count >= 1 then delay / train_count else 0.0 end as a
  from r_delays where train_type in ('K', 'L', '-99'))) group by class"""))
def bal1_class_dist(spark, sf):
    _, dist = balance_dataset(R.delays(spark, sf), ["K", "L"])
    return dist.select("class", "count", r6("share").alias("share"))


_SMOTE_H = "md5(concat_ws('|', '42', station, cast(time as varchar), train_type, cast(turn as varchar)))"


def _digits(first):
    return f"('0x' || substr({_SMOTE_H}, {first}, 8))::bigint"


@query("smp4_smote", with_roles(f"""
with b as (select *, cast(delay > 50 as integer) as label, cast(train_count as double) as cnt,
  concat_ws('|', station, cast(time as varchar), train_type) as id from r_delays),
m as (select *, row_number() over (order by {_H}, station, time, train_type) as rk, count(*) over () as n from b where label = 1),
want as (select cast(floor((select count(*) from b where label = 0) * 0.2) as bigint) - (select count(*) from m) as new),
near as (select p.id, q.delay, q.total_delay, q.cnt, row_number() over (partition by p.id order by
    (p.delay - q.delay) * (p.delay - q.delay) + (p.total_delay - q.total_delay) * (p.total_delay - q.total_delay)
    + (p.cnt - q.cnt) * (p.cnt - q.cnt), q.id) as rank from m p join m q on p.id <> q.id qualify rank <= 5),
turns as (select m.*, unnest(range(0, cast(new // n + cast(rk <= new % n as bigint) as bigint))) as turn from m, want),
drawn as (select t.*, 1 + {_digits(1)} % 5 as pick, {_digits(9)} / 4294967296.0 as at from turns t)
select station, time, train_type, label, {sql_r6('delay')} as delay, {sql_r6('total_delay')} as total_delay, {sql_r6('cnt')} as train_count from b
union all
select null, null, null, 1, {sql_r6('d.delay + d.at * (q.delay - d.delay)')}, {sql_r6('d.total_delay + d.at * (q.total_delay - d.total_delay)')},
  {sql_r6('d.cnt + d.at * (q.cnt - d.cnt)')} from drawn d join near q on q.id = d.id and q.rank = d.pick"""))
def smp4_smote(spark, sf):
    d = R.delays(spark, sf).withColumn("label", (F.col("delay") > 50).cast("int"))
    cols = ["delay", "total_delay", "train_count"]
    out = SM.smote(d.select(*_DKEYS, "label", *cols), _DKEYS, cols, "label", ratio=0.2)
    return out.select(*_DKEYS, "label", *[r6(c).alias(c) for c in cols])
