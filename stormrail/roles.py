"""Domain roles built from the driver's tables.

The engine's operators work on rail/weather tables (stations, hourly delays,
hourly observations, lightning strikes, reason codes). The test data are
TPC-H-like tables, so each role is a deterministic Spark derivation of them;
measures are made exactly representable in binary (integers or k/2^n) so
that sums do not depend on the summation order and both engines agree to the
last bit;
its DuckDB twin (``ROLE_SQL``) is used by the oracle queries. Both sides
compute the same thing; every role grows with the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormrail.functions.scalar import hour_floor

#: Hours of the month that the events cover; the hour of a delay falls into it, so both sides meet. The number of
#: stations grows with the tables: each supplier and each user is one.
HOURS_IN_GRID = 720


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _station_of(key_col: str):
    return F.concat(F.lit("S"), F.col(key_col).cast("string"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension (station, station_name, lat, lon) from ``supplier``."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).distinct()
    return s.select(
        F.concat(F.lit("S"), F.col("k").cast("string")).alias("station"),
        F.concat(F.lit("Station "), F.col("k").cast("string")).alias("station_name"),
        F.expr("59.5D + 0.5D * (k % 20) + (k div 20) % 512 / 1024.0D").alias("lat"),
        F.expr("cast(21.0 + ((k * 7) % 10) * 0.6 as double)").alias("lon"),
    )


def delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly delays: one row per (station, time, train_type)."""
    li = read_table(spark, sf_dir, "lineitem")
    base = li.select(
        _station_of("l_suppkey").alias("station"),
        F.timestamp_add("HOUR", F.col("l_orderkey") % HOURS_IN_GRID,
                        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("time"),
        F.when(F.col("l_returnflag") == "R", "K").when(F.col("l_returnflag") == "A", "L")
         .otherwise("T").alias("train_type"),
        "l_quantity", "l_extendedprice",
    )
    return base.groupBy("station", "time", "train_type").agg(
        F.count(F.lit(1)).cast("long").alias("train_count"),
        F.sum("l_quantity").alias("delay"),
        (F.sum(F.floor("l_extendedprice")) / F.lit(1024.0)).alias("total_delay"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather: unique (station, time); prec -1 = no rain, NULL = missing."""
    ev = read_table(spark, sf_dir, "events")
    return ev.groupBy(_station_of("user_id").alias("station"), hour_floor("ts").alias("time")).agg(
        F.avg(F.when(F.col("event_type") == "view", F.lit(-1.0))
               .when(F.col("event_type") == "error", F.lit(None).cast("double"))
               .otherwise(F.floor(F.col("value") * 4) / 256.0)).alias("prec"),
        F.max("value").alias("gust"),
        F.min(F.when(F.col("event_type") == "click", F.col("value"))).alias("vis"),
        F.count(F.lit(1)).cast("long").alias("n"),
    )


def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lightning strikes (station, time, peak)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.where(F.col("event_type") == "error").select(
        _station_of("user_id").alias("station"), F.col("ts").alias("time"), F.col("value").alias("peak"))


def code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows for the reason-code join: orders (key, time, type, station)."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("time"),
                    F.col("o_orderstatus").alias("train_type"), F.col("o_totalprice").alias("delay"))


def reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason codes (key, code, count) from lineitem's return flag."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("code"),
                     F.col("l_linenumber").cast("long").alias("count"))


def binary_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary classification results: y, proba, pred, period per lineitem row."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.floor(F.col("l_discount") * 100 + 0.5) / 16.0).alias("proba"),
        ((F.floor(F.col("l_discount") * 100 + 0.5) / 16.0) >= 0.5).cast("int").alias("pred"),
        F.year("l_shipdate").cast("int").alias("period"),
        F.col("l_shipdate").alias("time"),
    )


def regression_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression results: y = delay, y_pred = 25 * train_count per delay row,
    with the station's latitude."""
    d = delays(spark, sf_dir)
    st = stations(spark, sf_dir).select("station", "lat", "lon")
    return d.join(st, "station").select(
        "station", "time", "train_type", "lat", "lon",
        F.col("delay").alias("y"), (F.col("train_count") * 25).cast("double").alias("y_pred"))


def vectors(spark: SparkSession, sf_dir: str, k: int = 64) -> DataFrame:
    """Embeddings as (vec_id, label, f0..f{k-1}) doubles."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("int").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(k)])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station graph edges (src, dst), distinct, from lineitem supplier/part pairs."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(_station_of("l_suppkey").alias("src"), F.concat(F.lit("S"), F.expr("l_partkey div 20").cast("string")).alias("dst")).distinct()


# ---------------------------------------------------------------------------
# DuckDB twins of the roles, used as CTEs by the oracle SQL.
ROLE_SQL = {
    "r_stations": """select distinct 'S' || s_suppkey as station,
        'Station ' || s_suppkey as station_name,
        cast(59.5 + 0.5 * (s_suppkey % 20) + (s_suppkey // 20) % 512 / 1024.0 as double) as lat,
        cast(21.0 + ((s_suppkey * 7) % 10) * 0.6 as double) as lon
        from supplier""",
    "r_delays": """select 'S' || l_suppkey as station,
        timestamp '2024-01-01' + to_hours(cast(l_orderkey % 720 as bigint)) as time,
        case l_returnflag when 'R' then 'K' when 'A' then 'L' else 'T' end as train_type,
        cast(count(*) as bigint) as train_count, sum(l_quantity) as delay,
        sum(floor(l_extendedprice)) / 1024.0 as total_delay
        from lineitem group by all""",
    "r_obs": """select 'S' || user_id as station, date_trunc('hour', ts) as time,
        avg(case when event_type = 'view' then -1.0 when event_type = 'error' then null
                 else floor(value * 4) / 256.0 end) as prec,
        max(value) as gust, min(case when event_type = 'click' then value end) as vis,
        cast(count(*) as bigint) as n
        from events group by all""",
    "r_strikes": """select 'S' || user_id as station, ts as time, value as peak
        from events where event_type = 'error'""",
    "r_code_facts": """select o_orderkey as key, o_orderdate as time, o_orderstatus as train_type,
        o_totalprice as delay from orders""",
    "r_codes": """select l_orderkey as key, l_returnflag as code, cast(l_linenumber as bigint) as count
        from lineitem""",
    "r_binary": """select l_orderkey as key, l_linenumber as line,
        cast(l_returnflag = 'R' as integer) as y, floor(l_discount * 100 + 0.5) / 16.0 as proba,
        cast(floor(l_discount * 100 + 0.5) / 16.0 >= 0.5 as integer) as pred,
        cast(year(l_shipdate) as integer) as period, l_shipdate as time from lineitem""",
    "r_reg": """select d.station, d.time, d.train_type, s.lat, s.lon, d.delay as y,
        cast(d.train_count * 25 as double) as y_pred
        from r_delays d join r_stations s using (station)""",
    "r_vec": """select vec_id, cast(label as integer) as label, """ + ", ".join(
        f"cast(embedding[{i + 1}] as double) as f{i}" for i in range(64)) + " from embeddings",
    "r_edges": """select distinct 'S' || l_suppkey as src, 'S' || (l_partkey // 20) as dst
        from lineitem""",
}

# Dependencies between role CTEs (emitted in this order).
_ROLE_ORDER = ["r_stations", "r_delays", "r_obs", "r_strikes", "r_code_facts", "r_codes",
               "r_binary", "r_reg", "r_vec", "r_edges"]
_ROLE_DEPS = {"r_reg": ["r_delays", "r_stations"]}


def with_roles(sql: str, *extra_ctes: tuple[str, str]) -> str:
    """Prefix ``sql`` with the role CTEs it mentions (plus ``extra_ctes``)."""
    import re
    text = sql + " ".join(body for _, body in extra_ctes)
    needed = set()
    for name in _ROLE_ORDER:
        if re.search(r"\b" + name + r"\b", text):
            needed.add(name)
            needed.update(_ROLE_DEPS.get(name, []))
    ctes = [f"{n} as ({ROLE_SQL[n]})" for n in _ROLE_ORDER if n in needed]
    ctes += [f"{n} as ({body})" for n, body in extra_ctes]
    if not ctes:
        return sql
    body = sql.lstrip()
    if body[:5].lower() == "with ":
        # the query has its own WITH list: continue it after the role CTEs
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + sql
