"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words from its weight. The whole part of target / size of the source is certain
copies of all its documents. The words still due after those go to one copy more of some documents, each with a chance of
its own: in proportion to the root of its size, 1 at most, so that the chances times the sizes add up to what is due. Long
documents are likelier, and many short ones are left to fill the words that remain at the end. Who gets the copy is drawn by
Pareto order sampling: with a uniform draw u and a chance p, documents rank by (u / (1 - u)) / (p / (1 - p)), and those first
in rank are taken until the words due are reached (Rosén, 1997). What is left at the end goes to the next ones that fit, so
the shortest documents are taken a little more often than their chance says.
The cut in the ranking is found from sums over bins of the rank, finer ones within the bin that holds the cut; no
source's documents are ever sorted or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormrail.llm.common import WORD, numbered, uniform, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source, and so a document, is taken this many times at most.
MOST = 3
#: Bins of the rank at each of two levels.
BINS = 1 << 10


def word_count(text_col: str) -> Column:
    """Words of the whole text; 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, most: float = MOST) -> DataFrame:
    """(source, size, weight, target) from (source, size), one row each. Weights repeat over the sources in code
    point order, null last; targets share ``share`` of all sizes and stop at ``most`` times the source's size, the
    excess being shared again by weight until none is above.

    The level at which the water stands is one number; each round caps at least one source more, and only two sums
    come to the driver.
    """
    rows = numbered(sources, [F.col("source").isNull(), F.col("source")], "nth", "sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("nth") % len(weights) + 1).cast("int"))).drop("nth")
    first = rows.agg(F.sum("size"), F.sum("weight")).first()
    total, level = share * float(first[0] or 0), 0.0
    if first[1]:
        level, was = total / first[1], None
        while level != was:
            full = F.col("weight") * F.lit(level) >= most * F.col("size")
            capped, open_ = rows.agg(F.sum(F.when(full, most * F.col("size"))), F.sum(F.when(~full, F.col("weight")))
                                     ).first()
            if not open_:
                break
            was, level = level, max(level, (total - float(capped or 0)) / open_)
    return rows.withColumn("target", F.least(most * F.col("size").cast("double"), F.col("weight") * F.lit(level)))


def pareto_rank(draw: Column, chance: Column) -> Column:
    """Random odds divided by inclusion odds, mapped to (0, 1) in the same order."""
    odds = (draw / (1 - draw)) / (chance / (1 - chance))
    return odds / (1 + odds)


def inclusion(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """(group, level): documents of ``rows`` (group, size) are to be taken with the chance level * sqrt(size), 1 at most, so
    that chances times sizes add up to what is ``due`` in ``budget`` (group, due). Groups with no more words than that
    have an infinite level.

    Chances rise with the size, so those that reach 1 are the sizes above some size. Words above each size, and sizes
    times roots up to it, are running sums over the distinct sizes of a group; the largest size whose chance stays below
    1 gives the level.
    """
    sizes = rows.filter("size > 0").groupBy("group", "size").agg(F.count("*").alias("n"))
    above = Window.partitionBy("group").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("group").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    root = F.sqrt("size")
    run = sizes.select("group", "size", F.coalesce(F.sum(F.col("n") * F.col("size")).over(above), F.lit(0)).alias("above"),
                       F.sum(F.col("n") * F.col("size") * root).over(upto).alias("open"))
    b = budget.select(F.col("group").alias("g"), "due")
    level = (F.col("due") - F.col("above")) / F.col("open")
    below = level * root < 1
    found = run.join(b, F.col("group").eqNullSafe(F.col("g"))).withColumn("level", level).groupBy("group").agg(
        F.max_by(F.when(below, level), F.when(below, F.col("size"))).alias("level"))
    return found.select("group", F.coalesce("level", F.lit(float("inf"))).alias("level"))


def _cut(rows: DataFrame, bins: Column, budget: DataFrame, kind: str) -> DataFrame:
    """(group, due, cut): for each group the first bin up to which the sizes exceed what is ``due``, and what is
    still due within it. Groups that never exceed it are left out."""
    sums = rows.groupBy("group", bins.alias("bin")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("group").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("upto", F.sum("words").over(order)).join(
        budget.withColumnRenamed("group", "g"), F.col("group").eqNullSafe(F.col("g")))
    over = run.filter("upto > due").groupBy("group").agg(
        F.min(F.struct("bin", F.expr("due - (upto - words)").alias("due"))).alias("m"))
    return written(over.select("group", F.col("m.due").alias("due"), F.col("m.bin").alias("cut")), kind)


def _next_cut(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """(group, due, cut): for each group of ``rows`` the rank up to which the sizes exceed what is ``due``, and what is
    still due before it. Groups that never exceed it are left out."""
    def inside(frame: DataFrame, bins: Column, cuts: DataFrame) -> DataFrame:
        c = cuts.select(F.col("group").alias("g"), F.col("cut").alias("at"))
        return frame.join(c, F.col("group").eqNullSafe(F.col("g"))).filter(bins == F.col("at")).drop("g", "at")

    coarse, fine = F.floor(F.col("rank") * BINS), F.floor(F.col("rank") * (BINS * BINS))
    one = _cut(rows, coarse, budget, "cut1")
    rows = inside(rows, coarse, one)
    two = _cut(rows, fine, one.drop("cut"), "cut2")
    return _cut(inside(rows, fine, two), F.col("rank"), two.drop("cut"), "cut3")


def _behind(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Those of ``rows`` behind the cut of their group that are no larger than what is still due there."""
    c = cuts.select(F.col("group").alias("g"), "due", "cut")
    return rows.join(c, F.col("group").eqNullSafe(F.col("g"))).filter(
        "rank > cut and size > 0 and size <= due").select("group", "size", "rank")


def pareto_sample(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """(group, cut, extra): documents to take from each group of ``rows`` (group, size, rank): those with a rank below
    ``cut`` (all if null), and those that ``taken_behind`` finds in ``extra``, an array of (after, before, most).

    ``budget`` (group, due) says how many words are due. Documents are taken in rank order, each if it still fits: up to
    the cut, where the next one is larger than what is left; then, of those behind it that are no larger than that, up to
    their own cut, and so on until nothing that is left fits. Only whether a cut was found comes to the driver.
    """
    cuts = [_next_cut(rows, budget)]
    rest = written(_behind(rows, cuts[0]), "behind")
    while not cuts[-1].isEmpty():
        cuts.append(_next_cut(_behind(rest, cuts[-1]), cuts[-1].drop("cut")))
    first = cuts[0].select(F.col("group").alias("g"), "cut")
    every = cuts[0].withColumn("nth", F.lit(0))
    for k, c in enumerate(cuts[1:-1], 1):
        every = every.union(c.withColumn("nth", F.lit(k)))
    steps = every.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("nth", "cut", "due"))).alias("s"))
    extra = F.transform("s", lambda x, i: F.struct(x["cut"].alias("after"), F.get("s", i + 1)["cut"].alias("before"),
                                                   x["due"].alias("most")))
    out = steps.select("group", extra.alias("extra")).join(first, F.col("group").eqNullSafe(F.col("g"))).select(
        F.col("group").alias("g"), "cut", "extra")
    return budget.join(out, F.col("group").eqNullSafe(F.col("g")), "left").select("group", "cut", "extra")


def taken_behind(extra: Column, rank: Column, size: Column) -> Column:
    """Whether a document is taken behind the first cut: between two cuts (to the end if there is no other), and no larger
    than what was still due at the former."""
    return F.coalesce(F.exists(extra, lambda x: (rank > x["after"]) & (x["before"].isNull() | (rank < x["before"]))
                               & (size > 0) & (size <= x["most"])), F.lit(False))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, share: float = 1.0, most: float = MOST, seed: int = 1) -> DataFrame:
    """(doc, source, size, source_size, target, copies, taken) for each row of ``docs``.

    ``copies`` is how often the mix takes the document, never more than ``most`` times; ``taken`` is copies * size.
    A null text has size 0 and is taken for nothing; a null source is a source of its own, last in order. Rows that
    repeat id, source and size share one draw, so they are taken alike. The draw is a hash of id and size: reruns
    agree, however the rows are spread. Other columns are not read.
    """
    rows = written(docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"),
                               word_count(text_col).alias("size")), "sizes")
    plan = written(targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most), "targets")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumnRenamed("size", "source_size").withColumn("whole", F.floor(times + 1e-9).cast("long"))
    plan = plan.withColumn("due", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = plan.withColumnRenamed("source", "s")
    open_ = rows.join(plan.filter("due > 0").select("s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("group"), "size")
    levels = inclusion(open_, plan.filter("due > 0").select(F.col("s").alias("group"), "due"))
    plan = written(plan.join(levels, F.col("s").eqNullSafe(F.col("group")), "left").drop("group"), "levels", slim=True)
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    draw = uniform(F.lit(seed), "doc", "size")
    chance = F.col("level") * F.sqrt(F.greatest(F.col("size"), F.lit(1)))
    chance = F.greatest(F.lit(1e-12), F.least(chance, F.lit(1 - 1e-12)))
    dealt = dealt.withColumn("rank", pareto_rank(draw, chance))
    units = dealt.filter("due > 0").select(F.col("source").alias("group"), "size", "rank")
    # written, so the planner knows the size of this table of one row for each source before it joins the documents
    chosen = written(pareto_sample(units, plan.filter("due > 0").select(F.col("s").alias("group"), "due")), "chosen",
                     slim=True)
    out = dealt.join(chosen, F.col("source").eqNullSafe(F.col("group")), "left")
    more = F.expr("due > 0 and (cut is null or rank < cut)") | taken_behind(F.col("extra"), F.col("rank"), F.col("size"))
    copies = F.col("whole") + F.when(more, 1).otherwise(0)
    return out.select("doc", "source", "size", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"))
