"""Sampling, balancing and splits (SMP*, SPL*, LIM3, BAL1 pieces).

Random choices are made repeatable with a hash of the row key and a seed
(the same rows are picked whatever the partitioning). Drawing the first n
rows of each class in hash order needs no sort: rows are counted by class and
leading hash digits, which tells the bin that holds the n-th row; lower bins
are kept whole and only that bin is ranked. Null groups are groups like any
other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormrail.operators.ordered import global_row_number


def hash_order(keys: Sequence, seed: int = 42) -> Column:
    """A repeatable pseudo-random order: md5 of the key text and the seed."""
    parts = [F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_percent(keys: Sequence, seed: int = 42) -> Column:
    """0..99 from the first 8 hex digits of ``hash_order``."""
    return (F.conv(F.substring(hash_order(keys, seed), 1, 8), 16, 10).cast("long") % 100).cast("int")


def null_safe_join(left: DataFrame, right: DataFrame, groups: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``groups``, nulls equal to nulls; the right side's group columns go."""
    if not groups:
        raise ValueError("no group columns to join on")
    r = right.select(*[F.col(g).alias(f"_ns_{g}") for g in groups], *[x for x in right.columns if x not in groups])
    on = None
    for g in groups:
        same = F.col(g).eqNullSafe(F.col(f"_ns_{g}"))
        on = same if on is None else on & same
    return left.join(r, on, how).drop(*[f"_ns_{g}" for g in groups])


def rank_within(df: DataFrame, groups: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """1-based rank of each row inside its group in ``order`` (unique within
    the group), computed without a per-group window: the position in (group,
    order) less the first position of the group."""
    groups = list(groups)
    g = global_row_number(df, [*groups, *order], "_sr_pos")
    starts = g.groupBy(*groups).agg((F.min("_sr_pos") - 1).alias("_sr_start"))
    j = null_safe_join(g, starts, groups)
    return j.withColumn(name, F.col("_sr_pos") - F.col("_sr_start")).drop("_sr_pos", "_sr_start")


#: Leading hash digits that a bin stands for: 65 536 bins for each class.
BIN_DIGITS = 4


def _marked_by_hash(df: DataFrame, keys: Sequence[str], quota: DataFrame, groups: Sequence[str], seed: int) -> DataFrame:
    """``df`` with ``_sr_take``: whether a row is among the first ``quota`` (groups..., _sr_n) rows of its group in
    hash order. Groups without a quota are taken not at all. The input is read twice, for the counts and for the
    rows; only the rows of one bin for each group are ranked."""
    groups = list(groups)
    one = [F.lit(0).alias("_sr_all")] if not groups else []
    by = groups or ["_sr_all"]
    h = df.select("*", *one, hash_order(keys, seed).alias("_sr_h"))
    h = h.withColumn("_sr_bin", F.substring("_sr_h", 1, BIN_DIGITS))
    bins = h.groupBy(*by, "_sr_bin").agg(F.count(F.lit(1)).alias("_sr_c"))
    run = bins.withColumn("_sr_cum", F.sum("_sr_c").over(
        Window.partitionBy(*by).orderBy("_sr_bin").rowsBetween(Window.unboundedPreceding, 0)))
    over = null_safe_join(run, quota, by).where("_sr_cum > _sr_n").groupBy(*by).agg(
        F.min_by(F.struct(F.col("_sr_bin").alias("bin"), (F.col("_sr_n") - F.col("_sr_cum") + F.col("_sr_c"))
                          .alias("rest")), "_sr_bin").alias("_sr_cut"))
    # one row for each group, sent to every task: a join that shuffles by group would put a class's rows into one task
    cuts = F.broadcast(null_safe_join(quota, over, by, "left").select(*by, "_sr_cut", F.lit(True).alias("_sr_has")))
    rows = null_safe_join(h, cuts, by, "left")
    # rows of the cut bin have the same group, so this window holds one bin of a group and no more
    edge = F.col("_sr_bin") == F.col("_sr_cut.bin")
    inside = rows.where(edge).withColumn("_sr_rank", F.row_number().over(
        Window.partitionBy(*by, "_sr_bin").orderBy("_sr_h", *keys)))
    inside = inside.withColumn("_sr_take", F.col("_sr_rank") <= F.col("_sr_cut.rest"))
    outside = rows.where(~F.coalesce(edge, F.lit(False))).withColumn("_sr_take", F.col("_sr_has").isNotNull() & (
        F.col("_sr_cut").isNull() | (F.col("_sr_bin") < F.col("_sr_cut.bin"))))
    cols = [*df.columns, "_sr_take"]
    return inside.select(*cols).union(outside.select(*cols))


def _sample(df: DataFrame, keys: Sequence[str], quota: DataFrame, groups: Sequence[str], seed: int) -> DataFrame:
    return _marked_by_hash(df, keys, quota, groups, seed).where("_sr_take").drop("_sr_take")


def _one_quota(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(0).alias("_sr_all"), F.lit(n).cast("long").alias("_sr_n"))


# SMP1 / SMP6 ------------------------------------------------------------------
def exact_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all when fewer), picked by hash order."""
    return _sample(df, keys, _one_quota(df, n), [], seed)


def pick_out(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(n picked rows, the remaining rows)."""
    r = _marked_by_hash(df, keys, _one_quota(df, n), [], seed)
    return r.where("_sr_take").drop("_sr_take"), r.where(~F.col("_sr_take")).drop("_sr_take")


# SMP2 -------------------------------------------------------------------------
def downsample_to_smallest(df: DataFrame, keys: Sequence[str], label: str = "class",
                           seed: int = 42) -> DataFrame:
    """Every class (a NULL label is one) cut to the size of the smallest."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    least = F.min("n").over(Window.partitionBy(F.lit(0)))  # one row for each class
    return _sample(df, keys, sizes.select(label, least.alias("_sr_n")), [label], seed)


# SMP3 -------------------------------------------------------------------------
def ratio_downsample(df: DataFrame, keys: Sequence[str], ratio: float, label: str = "class",
                     neg_class: int = 0, pos_class: int = 1, n_samples: int | None = None,
                     seed: int = 42) -> DataFrame:
    """``ratio`` negatives for each positive, other classes dropped. The base number of positives is the size of the
    smallest class, and no more than fits ``n_samples`` rows; if there are too few negatives for it, it shrinks to
    what they allow. No rows give no rows."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    facts = sizes.agg(F.min("n").alias("least"),
                      F.coalesce(F.sum(F.when(F.col(label) == neg_class, F.col("n"))), F.lit(0)).alias("negatives"))
    room = F.col("least") if n_samples is None else F.floor(F.least("least", F.lit(n_samples / (ratio + 1))))
    quotas = facts.select("negatives", room.alias("base")).select(
        F.floor(F.least(F.lit(ratio) * F.col("base"), F.col("negatives"))).alias("neg"), "base").select(
        "neg", F.least("base", F.floor(F.col("neg") / F.lit(ratio))).alias("pos"))
    kind = df.schema[label].dataType
    each = F.array(*[F.struct(F.lit(c).cast(kind).alias(label), F.col(q).cast("long").alias("_sr_n"))
                     for c, q in ((neg_class, "neg"), (pos_class, "pos"))])
    return _sample(df, keys, quotas.select(F.explode(each).alias("q")).select("q.*"), [label], seed)


# SMP4 -------------------------------------------------------------------------
def _draw(keys: Sequence[Column], first_digit: int, seed: int) -> Column:
    """A repeatable whole number below 2**32: eight hex digits of the hash of ``keys``."""
    return F.conv(F.substring(hash_order(keys, seed), first_digit, 8), 16, 10).cast("long")


def smote(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "class", ratio: float = 1.0,
          minority: int = 1, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` and synthetic rows of the ``minority`` class, up to ``ratio`` times the largest other class.

    A synthetic row lies on the segment from a minority row to one of its ``k`` nearest minority rows (exact ones,
    ``neighbours.k_nearest``): features are interpolated, the label is the minority's, and all other columns are NULL.
    Minority rows serve in turn, as evenly as the number allows, the odd ones in hash order; neighbour and place are
    drawn from a hash of the ``keys``, which must be unique. Features come back as doubles. Rows with a NULL or NaN
    feature stay but serve neither as base nor as neighbour. Fewer than two usable minority rows, or as many rows as
    asked for already, give no synthetic ones.
    """
    from stormrail.operators.neighbours import k_nearest
    from stormrail.session import cut_lineage
    features, kinds = list(features), dict(df.dtypes)
    ident = F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in keys])
    usable = F.lit(True)
    for f in features:
        usable = usable & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(
        F.col(label).isNotNull()).orderBy(F.desc("n"), F.col(label) == minority).limit(2).collect()}
    small = cut_lineage(df.where(F.col(label) == minority).where(usable).select(
        *keys, ident.alias("_id"), *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]))
    n_small, n_all = small.count(), df.where(F.col(label) == minority).count()
    n_large = max([n for c, n in sizes.items() if c != minority], default=0)
    new = int(n_large * ratio) - n_all
    rest = df.select(*[F.col(c).cast("double").alias(c) if c in features else F.col(c) for c in df.columns])
    if new <= 0 or n_small < 2:
        return rest
    xs = [f"_f{i}" for i in range(len(features))]
    near = k_nearest(small, small, k, xs, "_id", "_id", own=True)
    ends = near.join(small.select(F.col("_id").alias("sid"), F.array(*xs).alias("_to")), "sid").groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "_to"))).alias("_ends"))
    marked = _marked_by_hash(small, keys, _one_quota(small, new % n_small), [], seed)
    turns = F.lit(new // n_small) + F.col("_sr_take").cast("int")
    base = marked.withColumn("_turns", turns).where("_turns > 0").withColumn(
        "_turn", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)))
    drawn = base.join(ends, F.col("_id") == F.col("qid"))
    named = [*keys, F.col("_turn")]
    to = F.col("_ends")[(_draw(named, 1, seed) % F.size("_ends")).cast("int")]["_to"]
    drawn = drawn.withColumns({"_to": to, "_at": _draw(named, 9, seed) / F.lit(float(1 << 32))})
    value = {f: F.col(f"_f{i}") + F.col("_at") * (F.col("_to")[i] - F.col(f"_f{i}")) for i, f in enumerate(features)}
    made = drawn.select(*[value[c].alias(c) if c in value else F.lit(minority).cast(kinds[c]).alias(c) if c == label
                          else F.lit(None).cast(kinds[c]).alias(c) for c in df.columns])
    return rest.unionByName(made)


# SPL1 -------------------------------------------------------------------------
def holdout(df: DataFrame, keys: Sequence[str], test_percent: int = 30, seed: int = 42) -> DataFrame:
    """Tag rows 'train' / 'test' by a repeatable hash (about test_percent %)."""
    return df.withColumn("split", F.when(hash_percent(keys, seed) < test_percent, F.lit("test"))
                         .otherwise(F.lit("train")))


# SPL2 -------------------------------------------------------------------------
def ordered_holdout(df: DataFrame, order: Sequence[str], test_size: float = 0.3) -> DataFrame:
    """The last ceil(test_size * n) rows in ``order`` are 'test'."""
    n = df.agg(F.count(F.lit(1))).scalar()
    n_test = F.ceil(n * F.lit(test_size))
    r = global_row_number(df, order, "_sr_pos")
    return r.withColumn("split", F.when(F.col("_sr_pos") > n - n_test, F.lit("test")).otherwise(F.lit("train"))) \
            .drop("_sr_pos")


# SPL3 -------------------------------------------------------------------------
def time_folds(df: DataFrame, order: Sequence[str], n_splits: int = 5) -> DataFrame:
    """Expanding time folds: with s = n // (n_splits + 1), fold k (1..n_splits)
    tests rows n-(n_splits+1-k)*s+1 .. n-(n_splits-k)*s (1-based, in order)
    and is fitted on all rows before. Adds ``test_fold`` (NULL when the row is
    never tested) and ``first_train_fold`` (NULL when never trained on)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    s = F.floor(n / F.lit(n_splits + 1))
    r = global_row_number(df, order, "_sr_pos")
    start0 = n - F.lit(n_splits) * s  # first test row of fold 1 is start0 + 1
    k_test = F.floor(F.try_divide(F.col("_sr_pos") - start0 - 1, s)) + 1  # fewer rows than folds: NULL
    test_fold = F.when(F.col("_sr_pos") > start0, k_test.cast("int"))
    # row p is fitted in fold k when p <= start0 + (k-1)*s  ->  k >= (p - start0)/s + 1
    ahead = F.ceil(F.try_divide(F.col("_sr_pos") - start0, s)) + 1
    k_train = F.when(ahead.isNotNull(), F.greatest(F.lit(1), ahead))
    first_train = F.when(k_train <= n_splits, k_train.cast("int"))
    return r.withColumn("test_fold", test_fold).withColumn("first_train_fold", first_train).drop("_sr_pos")


# SPL4 -------------------------------------------------------------------------
def enough_rows(df: DataFrame, n: float, key: str = "station") -> DataFrame:
    """Only keys with at least ``n`` rows (counts joined back, one row per key)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_sr_cnt")).where(F.col("_sr_cnt") >= n)
    return df.join(counts.select(key), key, "left_semi")
