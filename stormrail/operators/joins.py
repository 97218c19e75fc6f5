"""Joins (JOIN1-JOIN16)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormrail.functions.constants import EARTH_RADIUS_KM, NEAREST_OBS_MAX_KM, NEAREST_OBS_STATIONS
from stormrail.functions.scalar import haversine_km


# JOIN1 ------------------------------------------------------------------------
def weather_with_flashes(weather: DataFrame, flashes: DataFrame, keys: Sequence[str] = ("time", "station"),
                         count_col: str = "flashcount") -> DataFrame:
    """Weather rows with the hourly strike count; hours without strikes get 0.

    The ingest job writes a full outer join but keeps only the weather side's
    columns, and the following inner join with delays drops every row that
    has no weather time, so a left join is the same result with less work.
    """
    f = flashes.select(*keys, count_col)
    return weather.join(f, list(keys), "left").withColumn(
        count_col, F.coalesce(F.col(count_col), F.lit(0)).cast("long"))


# JOIN2 ------------------------------------------------------------------------
def delays_with_weather(delays: DataFrame, weather: DataFrame,
                        keys: Sequence[str] = ("time", "station")) -> DataFrame:
    """Inner equi-join on (time, station), keys once."""
    return delays.join(weather, list(keys), "inner")


# JOIN3 / JOIN4 ----------------------------------------------------------------
def labels_with_features(labels: DataFrame, features: DataFrame,
                         keys: Sequence[str] = ("time", "station")) -> tuple[DataFrame, DataFrame]:
    """(labels that have features joined with them, labels without features).
    Always two frames, also for empty inputs."""
    keys = list(keys)
    with_f = labels.join(features, keys, "inner")
    without = labels.join(features.select(*keys).distinct(), keys, "left_anti")
    return with_f, without


# JOIN5 ------------------------------------------------------------------------
def with_reason_codes(fact: DataFrame, codes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fact LEFT JOIN codes; fans out when several codes hit one fact row."""
    return fact.join(codes, list(keys), "left")


# JOIN6 ------------------------------------------------------------------------
def common_times(obs: DataFrame, labels: DataFrame, time: str = "time") -> tuple[DataFrame, DataFrame]:
    """Keep observation rows whose time has a label and label rows whose time
    has an observation (two semi joins on the distinct times)."""
    lt = labels.select(time).distinct()
    ot = obs.select(time).distinct()
    return obs.join(lt, time, "left_semi"), labels.join(ot, time, "left_semi")


# JOIN7 ------------------------------------------------------------------------
def interval_counts(rows: DataFrame, events: DataFrame, station: str = "station", time: str = "time",
                    out: str = "flashcount", tiebreak: Sequence[str] = (),
                    bucket_seconds: int = 28 * 86400) -> DataFrame:
    """Each event counts for the first row of its station with time >= the
    event's time; a row's value is the number of events in (previous row
    time, row time]. Equal row times: only the first such row gets the count.
    Events after a station's last row are dropped; no events -> 0.
    With ``tiebreak``, (station, time, tiebreak) must be unique. Rows with a
    NULL station or time are dropped.

    Plan: union rows and events into one time-ordered stream per station and
    attach each event to the next row with ``min(row time) over (following)``
    — no range join, so no nested loop and no per-pair blow-up. The next-row
    lookup is an unbounded-following frame, computed per (station, bucket) and
    fixed up across bucket edges by carrying each bucket's first row time.
    """
    # only the first of several rows with the same (station, time) gets the
    # count; the row keys for the stream come from the same ranked rows, so
    # both uses share one shuffle of ``rows``
    # rows without a station or time cannot sit on a series; filtering them
    # here (instead of letting the optimizer infer it in one branch only)
    # keeps both uses of ``rows`` identical, so they share one shuffle
    rows = rows.where(F.col(station).isNotNull() & F.col(time).isNotNull())
    if tiebreak:
        # (station, time, tiebreak) is unique: the first row is the one with
        # the smallest tiebreak; a min over the group (instead of
        # row_number() == 1, which the optimizer turns into a group limit)
        # lets both uses below share one shuffle of ``rows``
        tb = F.struct(*tiebreak)
        ranked = rows.withColumn("_sr_first", tb == F.min(tb).over(Window.partitionBy(station, time)))
    else:
        ranked = rows.withColumn("_sr_first", F.row_number().over(
            Window.partitionBy(station, time).orderBy(time)) == 1)
    r_keys = ranked.where(F.col("_sr_first")).select(F.col(station).alias("_st"), F.col(time).alias("_t")) \
                   .withColumn("_is_row", F.lit(1))
    ev = events.select(F.col(station).alias("_st"), F.col(time).alias("_t")).withColumn("_is_row", F.lit(0))
    both = ev.unionByName(r_keys)
    # next row time at or after each event: events sort before rows at equal
    # time so that the frame of an event includes a row of the same time
    from stormrail.operators.ordered import epoch_seconds_ntz
    # time buckets bound the work per (station, bucket); a station with
    # dense events takes a smaller ``bucket_seconds``
    b = F.floor(epoch_seconds_ntz("_t") / F.lit(bucket_seconds))
    both = both.withColumn("_b", b)
    row_t = F.when(F.col("_is_row") == 1, F.col("_t"))
    w = Window.partitionBy("_st", "_b").orderBy("_t", "_is_row").rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_next", F.min(row_t).over(w)) \
               .withColumn("_first", F.min(row_t).over(Window.partitionBy("_st", "_b")))
    # events whose bucket has no later row take the first row time of a later
    # bucket: one row per (station, bucket), bounded by the time span
    firsts = both.groupBy("_st", "_b").agg(F.min("_first").alias("_first"))
    wb = Window.partitionBy("_st").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.withColumn("_later", F.min("_first").over(wb)).select("_st", "_b", "_later")
    evs = both.where(F.col("_is_row") == 0).join(firsts, ["_st", "_b"], "left") \
              .select("_st", F.coalesce("_next", "_later").alias("_target")) \
              .where(F.col("_target").isNotNull())
    counts = evs.groupBy("_st", "_target").agg(F.count(F.lit(1)).cast("long").alias(out))
    j = ranked.join(counts.withColumnRenamed("_st", station).withColumnRenamed("_target", time),
                    [station, time], "left")
    return j.withColumn(out, F.when(F.col("_sr_first"), F.coalesce(F.col(out), F.lit(0)))
                        .otherwise(F.lit(0)).cast("long")).drop("_sr_first")


# JOIN9 / JOIN10 / JOIN11 ------------------------------------------------------------
def ids_to_names(df: DataFrame, dim: DataFrame, id_col: str, dim_id: str, dim_name: str,
                 out: str = "name", default: str = "unkown") -> DataFrame:
    """Lookup with a default for unmatched ids (the reference's spelling of
    the default is kept: ``unkown``). AQE broadcasts a small dimension."""
    d = dim.select(F.col(dim_id).alias("_sr_id"), F.col(dim_name).alias(out)).dropDuplicates(["_sr_id"])
    j = df.join(d, df[id_col] == F.col("_sr_id"), "left").drop("_sr_id")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def names_to_codes(df: DataFrame, dim: DataFrame, name_col: str, dim_name: str, dim_code: str,
                   out: str = "code") -> DataFrame:
    """Lookup that fails on an unmatched name (``raise_error``)."""
    d = dim.select(F.col(dim_name).alias("_sr_name"), F.col(dim_code).alias(out)).dropDuplicates(["_sr_name"])
    j = df.join(d, df[name_col] == F.col("_sr_name"), "left").drop("_sr_name")
    return j.withColumn(out, F.when(F.col(out).isNull(),
                                    F.raise_error(F.concat(F.lit("No code for "), F.col(name_col).cast("string"))))
                        .otherwise(F.col(out)))


def lookup_with_rejects(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> tuple[DataFrame, DataFrame]:
    """JOIN11: (matched rows with the dimension's columns, rejected keys)."""
    d = dim.withColumnRenamed(dim_key, key)
    return df.join(d, key, "inner"), df.select(key).distinct().join(d.select(key), key, "left_anti")


# JOIN12 ------------------------------------------------------------------------
def predictions_by_station(pred: DataFrame, places: DataFrame, place: str = "place", name: str = "station",
                           fields: Sequence[str] = ("time", "lat", "lon", "value", "origintime"),
                           day: str | None = "time") -> DataFrame:
    """Predictions grouped by station name, nested and sorted by time.

    The nested list is built per (station, day of ``day``) so that a list
    never holds more than one day of a station (a whole-history list per
    station would be an unbounded group). ``day=None`` nests per station.
    """
    j = pred.join(places.select(place, name), place)
    keys = [name] + ([F.to_date(day).alias("day")] if day else [])
    return j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("predictions"))


# JOIN13 ------------------------------------------------------------------------
def join_back(rows: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(stats, list(keys), "left")


# JOIN15 ------------------------------------------------------------------------
def nearest_within(points: DataFrame, sites: DataFrame, n: int = NEAREST_OBS_STATIONS,
                   max_km: float = NEAREST_OBS_MAX_KM, pid: str = "station", sid: str = "site",
                   lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The ``n`` nearest sites within ``max_km`` of each point (ties broken by site id).

    Both sides become points of the unit sphere, where the straight distance orders as the great circle does and
    neither the 180th meridian nor the poles are special. ``neighbours.k_nearest`` finds the n nearest exactly,
    cell by cell; the great-circle distance then ranks them and whatever is as near as the n-th but for rounding.
    """
    from stormrail.operators.neighbours import k_nearest

    def on_sphere(df, key, name):
        a, o = F.radians(F.col(lat).cast("double")), F.radians(F.col(lon).cast("double"))
        return df.select(F.col(key).alias(name), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"),
                         (F.cos(a) * F.cos(o)).alias("_x"), (F.cos(a) * F.sin(o)).alias("_y"), F.sin(a).alias("_z"))

    p, s = on_sphere(points, pid, "_pid"), on_sphere(sites, sid, "_sid")
    chord = 2.0 * math.sin(min(max_km / EARTH_RADIUS_KM / 2.0, math.pi / 2.0)) * (1 + 1e-9)
    near = k_nearest(p, s, n, ["_x", "_y", "_z"], "_pid", "_sid", radius=chord, slack=1e-9)
    both = near.join(p.select(F.col("_pid").alias("qid"), F.col("_lat").alias("_plat"), F.col("_lon").alias("_plon")),
                     "qid").join(s.select(F.col("_sid").alias("sid"), "_lat", "_lon"), "sid")
    j = both.withColumn("dist_km", haversine_km("_plat", "_plon", "_lat", "_lon")).where(F.col("dist_km") <= max_km)
    w = Window.partitionBy("qid").orderBy("dist_km", "sid")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) \
            .select(F.col("qid").alias(pid), F.col("sid").alias(sid), "dist_km", "rank")


# JOIN16 ------------------------------------------------------------------------
def _both_ways(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct (_a, _b), each edge in both directions."""
    e = edges.select(F.col(src).alias("_a"), F.col(dst).alias("_b"))
    return e.unionByName(e.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct()


#: Links and (station, time) entries of a block of ``link_counts`` aimed at, terms that are summed at once in it, and
#: rows that are packed together on their way to it.
BLOCK_LINKS = 6_000_000
BLOCK_ENTRIES = 4_000_000
STEP = 1_000_000
PACK = 1 << 18


def _packs(batches, deal, names):
    """Rows in packs: one row for each block of up to ``PACK`` rows, their columns as lists. ``deal`` gives the number
    of each row's block and the columns that go there."""
    def pack(held):
        at, columns = deal(*[np.concatenate([np.asarray(b.column(i)) for b in held]) for i in range(held[0].num_columns)])
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = pa.array(np.append(first, len(at)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(at[first]), *lists], names=names)

    held, n = [], 0
    for batch in batches:
        held, n = held + [batch], n + batch.num_rows
        if n >= PACK:
            yield pack(held)
            held, n = [], 0
    if n:
        yield pack(held)


def _met_counts(a: np.ndarray, b: np.ndarray, given: Sequence[np.ndarray], asked: Sequence[np.ndarray], n_times: int,
                step: int):
    """Pieces (s, t, n): for each asked (s, t), the counts at t of the stations that a link joins with s. Links a -> b,
    ascending; ``given`` (s, t, n) by s, the counts of the b side; ``asked`` (s, t) ascending, the places of the a side."""
    s, t, n = given
    first, last = np.searchsorted(s, b, "left"), np.searchsorted(s, b, "right")
    some = last > first
    a, first, size = a[some], first[some], (last - first)[some]
    want = asked[0].astype(np.int64) * n_times + asked[1]
    upto, i = np.cumsum(size), 0
    while i < len(a):
        done = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, done + step, "right")))
        terms = int(upto[j - 1] - done)
        of = np.repeat(first[i:j] - (upto[i:j] - size[i:j] - done), size[i:j]) + np.arange(terms)
        low = int(a[i]) * n_times
        key = np.repeat(a[i:j].astype(np.int64) * n_times - low, size[i:j]) + t[of]
        mine = want[np.searchsorted(want, low):np.searchsorted(want, (int(a[j - 1]) + 1) * n_times)] - low
        if key.max() < 4 * max(step, terms):
            sums = np.bincount(key, n[of], minlength=int(key.max()) + 1)
            hit = mine[mine < len(sums)]
            found = sums[hit]
        else:  # few terms for each station and many times
            keys, inverse = np.unique(key, return_inverse=True)
            sums = np.bincount(inverse, n[of])
            place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = mine[keys[place] == mine]
            found = sums[place[keys[place] == mine]]
        hit, found = hit[found > 0] + low, found[found > 0]
        yield hit // n_times, hit % n_times, found.astype(np.int64)
        i = j


def _block_sums(i: int, j: int, batches, k: int, step: int):
    """Batches (s, t, n) of the block of parts i and j: the sums that its links bring to the places of both."""
    def flat(batch, name):  # a copy, so that nothing keeps the batch
        return np.array(batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False))

    pairs, entries, seen = [], {i: [], j: []}, np.empty(0, np.int64)
    for batch in batches:
        pairs.append((flat(batch, "a"), flat(batch, "b")))
        parts = batch.column(batch.schema.get_field_index("part")).fill_null(-1)
        for p in entries:
            mine = batch.select(["s", "t", "n"]).filter(pa.array(np.equal(parts, p)))
            st, tt, nn = (flat(mine, c) for c in ("s", "t", "n"))
            if len(st):
                seen = np.union1d(seen, tt)
                entries[p].append((st, tt, nn.astype(np.min_scalar_type(nn.max()))))
        batch = parts = mine = st = tt = nn = None
    for p, found in entries.items():
        if not found:
            entries[p] = (np.empty(0, np.int32),) * 3
            continue
        s, n = np.concatenate([x[0] for x in found]), np.concatenate([x[2] for x in found])
        t = np.concatenate([np.searchsorted(seen, x[1]).astype(np.int32) for x in found])
        found.clear()
        order = np.lexsort((t, s))
        entries[p] = s[order], t[order], n[order]
    a, b = (np.concatenate([x[c] for x in pairs]).astype(np.int64) for c in (0, 1))
    pairs.clear()
    base = max(int(a.max(initial=0)), int(b.max(initial=0))) + 1
    ways = [(i, j, a * base + b), (j, i, b * base + a)] if i != j else [(i, i, np.r_[a * base + b, b * base + a])]
    del a, b
    for to, of, pair in ways:
        pair = np.unique(pair)
        for s, t, n in _met_counts(*(x.astype(np.int32) for x in np.divmod(pair, base)), entries[of], entries[to][:2],
                                   len(seen), step):
            yield pa.RecordBatch.from_arrays([pa.array(s * k + to), pa.array(seen[t]), pa.array(n)], names=["s", "t", "n"])


def link_counts(rows: DataFrame, edges: DataFrame, station: str = "station", src: str = "src", dst: str = "dst",
                same_time: str | None = "time", out: str = "n_links") -> DataFrame:
    """``rows`` with the number of rows that each is linked to: rows of stations that an edge joins with its own (of
    the same time step if ``same_time`` is given). Rows without links are left out, as from the pairs.

    Neither pairs of rows nor a row for each edge and time step are made. Rows are counted by (station, time) first.
    Stations are numbered and dealt into k parts; a block for each pair of parts meets the links between them and the
    (station, time) counts of both, and gives the sums for both, which are added up over the blocks. So counts and
    sums are shuffled k times and links once; k grows with the root of the number of links, and with the number of
    counts. Links and counts travel in packs, and a task holds those of one block as plain numbers.
    """
    from stormrail.operators.ordered import global_row_number
    from stormrail.session import stored
    by = [station] + ([same_time] if same_time else [])
    there = rows.where(" and ".join(f"`{c}` is not null" for c in by))
    counts = stored(there.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "counts")
    names = stored(global_row_number(counts.select(station).distinct(), [station], "_s"), "stations")
    coded = counts.join(names, station)
    if same_time:
        coded = coded.join(global_row_number(counts.select(same_time).distinct(), [same_time], "_t"), same_time)
    else:
        coded = coded.withColumn("_t", F.lit(0).cast("long"))
    coded = stored(coded, "coded")
    ends = [names.select(F.col(station).alias(c), F.col("_s").alias(i)) for c, i in (("_a", "a"), ("_b", "b"))]
    e = edges.select(F.col(src).alias("_a"), F.col(dst).alias("_b")).join(ends[0], "_a").join(ends[1], "_b")
    e = stored(e.select("a", "b"), "links")
    k = max(1, math.ceil(math.sqrt(2 * e.count() / BLOCK_LINKS)), math.ceil(2 * coded.count() / BLOCK_ENTRIES))
    step = STEP

    def of_link(a, b):
        x, y = np.where(a % k <= b % k, a, b), np.where(a % k <= b % k, b, a)
        return x % k * k + y % k, [(x // k).astype(np.int32), (y // k).astype(np.int32)]

    def of_entry(s, t, n):
        return s % k, [(s // k).astype(np.int32), t, n]

    def block_sums(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _block_sums(key[0].as_py(), key[1].as_py(), batches, k, step)

    links = e.mapInArrow(lambda x: _packs(x, of_link, ["at", "a", "b"]), "at long, a array<int>, b array<int>")
    links = links.select(F.expr(f"cast(at div {k} as int)").alias("i"), F.expr(f"cast(at % {k} as int)").alias("j"), "a", "b")
    entries = coded.select("_s", "_t", "_n").mapInArrow(lambda x: _packs(x, of_entry, ["part", "s", "t", "n"]),
                                                        "part long, s array<int>, t array<long>, n array<long>")
    entries = entries.withColumn("part", F.col("part").cast("int")).withColumn(
        "_o", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        F.least("part", "_o").alias("i"), F.greatest("part", "_o").alias("j"), "part", "s", "t", "n")
    met = links.unionByName(entries, allowMissingColumns=True).groupBy("i", "j").applyInArrow(
        block_sums, "s long, t long, n long")
    # sums of different blocks meet after the shuffle: within a block no (s, t) comes twice but for its two directions
    sums = met.select(F.col("s").alias("_s"), F.col("t").alias("_t"), "n").repartition("_s", "_t").groupBy(
        "_s", "_t").agg(F.sum("n").cast("long").alias(out))
    return rows.join(coded.join(sums, ["_s", "_t"]).select(*by, out), by)


def row_links(rows: DataFrame, edges: DataFrame, row_id: str = "row_id", station: str = "station",
              src: str = "src", dst: str = "dst", same_time: str | None = "time") -> DataFrame:
    """The pairs of rows whose stations are linked, for callers that need each of them: as many as ``link_counts``
    adds up to, so they grow with the product of the rows at the two ends of an edge."""
    e = _both_ways(edges, src, dst)
    keep = [row_id, station] + ([same_time] if same_time else [])
    left = rows.select(*[F.col(k).alias(f"l_{k}") for k in keep])
    right = rows.select(*[F.col(k).alias(f"r_{k}") for k in keep])
    j = left.join(e, F.col(f"l_{station}") == F.col("_a"))
    cond = [F.col("_b") == F.col(f"r_{station}")]
    if same_time:
        cond.append(F.col(f"l_{same_time}") == F.col(f"r_{same_time}"))
    j = j.join(right, cond)
    return j.select(F.col(f"l_{row_id}").alias("row_a"), F.col(f"r_{row_id}").alias("row_b"))
