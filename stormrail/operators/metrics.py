"""Evaluation metrics over y / y_pred (/ proba) columns (MET1-MET13).

All metrics are aggregates, optionally per group, so they partially
aggregate before any shuffle. Curves (ROC, precision-recall) are computed
on the distinct scores: counts per score, then a distributed running sum in
descending score order (``prefix_sums``), then the area from each step's own
counts (no lag, no global window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormrail.functions.constants import CLIMATOLOGY_RMSE_SUM
from stormrail.operators.ordered import prefix_sums


def _div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 (never an error under ANSI mode)."""
    return F.when(b != 0, a / b)


def _zero_div(a: Column, b: Column) -> Column:
    """a / b with 0 for a zero denominator (the classification convention)."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


# MET1 / MET2 / MET3 / MET4 ----------------------------------------------------------
def regression_aggs(y: str = "y", yhat: str = "y_pred", climatology: float | None = None) -> list[Column]:
    """Aggregate expressions for the regression metrics. Rows without a label or without a prediction count in none
    of them."""
    both = F.col(y).isNotNull() & F.col(yhat).isNotNull()
    yy, e = F.when(both, F.col(y)), F.col(yhat) - F.col(y)
    n = F.count(e)
    sse = F.sum(e * e)
    out = [n.cast("long").alias("n"),
           F.sqrt(F.avg(e * e)).alias("rmse"),
           F.avg(F.abs(e)).alias("mae"),
           (F.lit(1.0) - _div(sse, n * F.var_pop(yy))).alias("r2")]
    if climatology is not None:
        out.append((F.lit(1.0) - _div(F.sqrt(F.avg(e * e)),
                                      F.sqrt(F.avg(F.pow(yy - F.lit(climatology), 2))))).alias("skill"))
    return out


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "y_pred", groups: Sequence = (),
                       climatology: float | None = CLIMATOLOGY_RMSE_SUM, median: bool = False) -> DataFrame:
    """n, RMSE, MAE, R^2 (1 - SSE / (n * var_pop(y))), the skill score against a constant climatology forecast and,
    with ``median``, the median absolute error: a distributed exact quantile (``exact_quantiles``), so a group's
    errors are never held in one task."""
    from stormrail.operators.quantiles import exact_quantiles
    from stormrail.operators.sampling import null_safe_join
    groups = list(groups)
    aggs = regression_aggs(y, yhat, climatology)
    out = df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)
    cols = ["n", "rmse", "mae", "r2"] + (["skill"] if climatology is not None else [])
    if median:
        err = df.select(*groups, F.abs(F.col(yhat) - F.col(y)).alias("_ae"))
        med = exact_quantiles(err, "_ae", [0.5], groups, prefix="_m").withColumnRenamed("_m_0_5", "median_ae")
        out = null_safe_join(out, med, groups, "left") if groups else (
            out.select("*", med.select("median_ae").scalar().alias("median_ae")))
        cols.insert(4, "median_ae")
    return out.select(*groups, *cols)


def skill_constant_rmse(rmse: Column, reference_rmse: float = CLIMATOLOGY_RMSE_SUM) -> Column:
    """The reference's form: 1 - RMSE / a given climatology RMSE constant."""
    return F.lit(1.0) - rmse / F.lit(reference_rmse)


# MET5 / MET6 / MET11 / MET13 --------------------------------------------------------
def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred", groups: Sequence = (),
                   beta: float = 2.0) -> DataFrame:
    """Accuracy, precision, recall, F1, F-beta and predicted-positive share
    for a 0/1 label (zero denominators give 0). Rows without a label or
    without a prediction count in none of them."""
    df = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    tp = F.sum((yy & pp).cast("long"))
    fp = F.sum((~yy & pp).cast("long"))
    fn = F.sum((yy & ~pp).cast("long"))
    n = F.count(F.lit(1))
    aggs = [n.cast("long").alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
            F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"),
            F.avg(pp.cast("double")).alias("pred_pos_share")]
    g = df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)
    prec = _zero_div(F.col("tp"), (F.col("tp") + F.col("fp")).cast("double"))
    rec = _zero_div(F.col("tp"), (F.col("tp") + F.col("fn")).cast("double"))
    g = g.withColumn("precision", prec).withColumn("recall", rec)
    g = g.withColumn("f1", _zero_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    b2 = beta * beta
    g = g.withColumn("fbeta", _zero_div((1 + b2) * F.col("precision") * F.col("recall"),
                                        b2 * F.col("precision") + F.col("recall")))
    return g.withColumn("pred_neg_share", F.lit(1.0) - F.col("pred_pos_share"))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", groups: Sequence = ()) -> DataFrame:
    """MET7: counts per (y, pred) and the share of the y row, summed over the counts (a few rows for each class)."""
    g = df.groupBy(*groups, y, pred).agg(F.count(F.lit(1)).cast("long").alias("count"))
    return g.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*groups, y)))


def confusion_table(df: DataFrame, classes: Sequence, y: str = "y", pred: str = "pred") -> DataFrame:
    """MET7 as a table: one row for each true class, one column for each predicted one."""
    return df.groupBy(y).pivot(pred, list(classes)).agg(F.count(F.lit(1))).fillna(0)


def _class_counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    """(cls, tp, support, npred) for every class seen as label or prediction, from the (y, pred) counts alone."""
    pairs = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(y).alias("_y"), F.col(pred).alias(
        "_p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("_y").alias("cls"), hit.cast("long").alias("tp"), F.col("n").alias("support"),
                             zero.alias("npred")),
                    F.struct(F.col("_p").alias("cls"), zero.alias("tp"), zero.alias("support"),
                             F.col("n").alias("npred")))
    return pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("cls").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("npred").alias("npred"))


def micro_average(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Micro-averaged precision, recall and F1: sums of hits, predictions and labels over the classes."""
    c = _class_counts(df, y, pred).agg(*[F.sum(x).cast("double").alias(x) for x in ("tp", "support", "npred")])
    p, r = _zero_div(F.col("tp"), F.col("npred")), _zero_div(F.col("tp"), F.col("support"))
    return c.select(p.alias("precision"), r.alias("recall"), _zero_div(2 * p * r, p + r).alias("f1"))


def per_class_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """MET6: precision, recall, F1 and support per class, plus rows
    'macro avg' and 'weighted avg' (class as string)."""
    r = _class_counts(df, y, pred)
    r = r.withColumn("precision", _zero_div(F.col("tp"), F.col("npred").cast("double"))) \
         .withColumn("recall", _zero_div(F.col("tp"), F.col("support").cast("double")))
    r = r.withColumn("f1", _zero_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    # each class row counts for itself and for both averages: one pass over a few rows
    names = F.array(F.col("cls").cast("string"), F.lit("macro avg"), F.lit("weighted avg"))
    each = r.select(F.explode(names).alias("name"), "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    total = F.sum("support")

    def mean(x):
        weighted = F.sum(F.col(x) * F.col("support")) / total
        return F.when(F.col("name") == "weighted avg", F.when(total != 0, weighted)).otherwise(F.avg(x)).alias(x)

    return each.groupBy("name").agg(mean("precision"), mean("recall"), mean("f1"), total.alias("support")
                                    ).withColumnRenamed("name", "cls")


# MET8 / MET9 / MET10 ----------------------------------------------------------------
def _score_table(df: DataFrame, y: str, score: str, groups: Sequence[str]) -> DataFrame:
    """Counts per distinct score; rows without a label or a score count in no curve."""
    df = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    return df.groupBy(*groups, F.col(score).alias("score")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))


def roc_points(df: DataFrame, y: str = "y", score: str = "proba", groups: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score (descending): cumulative tp/fp and the
    rates, per group. Ties share one point."""
    groups = list(groups)
    t = _score_table(df, y, score, groups)
    if groups:
        # running sums per group: global running sums in (groups, -score)
        # order minus the totals of earlier groups
        t2 = t.withColumn("_sr_ns", -F.col("score"))
        cum = prefix_sums(t2, [*groups, "_sr_ns"], {"tp": F.col("pos"), "fp": F.col("neg")})
        from stormrail.operators.sampling import null_safe_join
        starts = cum.groupBy(*groups).agg(
            F.sum("pos").alias("P"), F.sum("neg").alias("N"),
            F.min(F.col("tp") - F.col("pos")).alias("_sp"), F.min(F.col("fp") - F.col("neg")).alias("_sn"))
        cum = null_safe_join(cum, starts, groups)
        cum = cum.withColumn("tp", F.col("tp") - F.col("_sp")).withColumn("fp", F.col("fp") - F.col("_sn")) \
                 .drop("_sp", "_sn", "_sr_ns")
    else:
        cum = prefix_sums(t, ["score"], {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
        P = t.agg(F.sum("pos")).scalar()
        N = t.agg(F.sum("neg")).scalar()
        cum = cum.withColumn("P", P).withColumn("N", N)
    return cum.withColumn("tpr", _div(F.col("tp").cast("double"), F.col("P"))) \
              .withColumn("fpr", _div(F.col("fp").cast("double"), F.col("N"))) \
              .withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))


def auc_ap(df: DataFrame, y: str = "y", score: str = "proba", groups: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC (trapezoids between consecutive distinct scores) and
    average precision sum((R_n - R_{n-1}) P_n); NULL when one class is
    missing."""
    pts = roc_points(df, y, score, groups)
    # each step's segment: from (fp - neg, tp - pos) to (fp, tp)
    area = F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0
    ap = F.col("pos") * F.col("precision")
    aggs = [F.sum(area).alias("_a"), F.sum(ap).alias("_ap"), F.first("P").alias("P"), F.first("N").alias("N")]
    g = pts.groupBy(*groups).agg(*aggs) if groups else pts.agg(*aggs)
    return g.select(*groups, _div(F.col("_a"), (F.col("P") * F.col("N")).cast("double")).alias("auc"),
                    _div(F.col("_ap"), F.col("P").cast("double")).alias("ap"))


def one_vs_rest_auc(df: DataFrame, y: str, probas: str) -> DataFrame:
    """MET10: AUC per class of a multi-class probability array (class i =
    position i) and the macro mean as class -1."""
    per = auc_ap(_one_vs_rest(df, y, probas), "_bin", "score", ["cls"]).select(F.col("cls").cast("int").alias("cls"), "auc")
    macro = per.agg(F.lit(-1).alias("cls"), F.avg("auc").alias("auc"))
    return per.unionByName(macro)


def _one_vs_rest(df: DataFrame, y: str, probas: str) -> DataFrame:
    ex = df.select(F.posexplode(probas).alias("cls", "score"), F.col(y).alias("_y"))
    return ex.withColumn("_bin", (F.col("_y") == F.col("cls")).cast("int"))


def macro_roc(df: DataFrame, y: str, probas: str) -> DataFrame:
    """MET10's mean curve: (fpr, tpr) at every false-positive rate that any class's curve has, tpr being the mean over
    the classes of their interpolated curves (at a vertical step its upper end).

    Each class's curve is a sum of pieces: one for each distinct score, flat before it, a straight line across it, flat
    behind it. A piece starts and ends a line a + b * fpr; so the sum of all curves at a rate is A + B * fpr, with A and
    B the running sums of what has started and ended up to there. One running sum over the distinct rates of all classes
    together; no class is interpolated at the rates of the others. Classes that lack one of the two kinds have no
    curve and do not count.
    """
    pts = roc_points(_one_vs_rest(df, y, probas), "_bin", "score", ["cls"]).where("P > 0 and N > 0")
    x0, x1 = (F.col("fp") - F.col("neg")) / F.col("N"), F.col("fpr")
    rise = F.col("pos") / F.col("P")
    slope = F.when((F.col("neg") > 0) & (F.col("pos") > 0), rise / (F.col("neg") / F.col("N"))).otherwise(F.lit(0.0))
    zero = F.lit(0.0)
    events = F.array(F.struct(zero.alias("x"), zero.alias("a"), zero.alias("b")),
                     F.struct(x0.alias("x"), (-slope * x0).alias("a"), slope.alias("b")),
                     F.struct(x1.alias("x"), (slope * x0 + rise).alias("a"), (-slope).alias("b")))
    at = pts.select(F.explode(events).alias("e")).select("e.*").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = prefix_sums(at, ["x"], {"_a": F.col("a"), "_b": F.col("b")})
    classes = pts.agg(F.count_distinct("cls")).scalar()
    return run.select(F.col("x").alias("fpr"), ((F.col("_a") + F.col("_b") * F.col("x")) / classes).alias("tpr"))


def curve_area(points: DataFrame, x: str = "fpr", y: str = "tpr", order: Sequence[str] = ()) -> DataFrame:
    """(auc): the area under a curve of unique points by trapezoids; each point meets the one before it in a segmented
    scan, so a curve of any length has no task of its own."""
    from stormrail.operators.ordered import scan_window
    out = scan_window(points, [], [x, *order], lambda w: {"_x": F.lag(x).over(w), "_y": F.lag(y).over(w)}, k_before=1)
    return out.agg(F.sum((F.col(x) - F.col("_x")) * (F.col(y) + F.col("_y")) / 2).alias("auc"))


# MET12 ------------------------------------------------------------------------
def regression_line(df: DataFrame, y: str = "y", yhat: str = "y_pred", groups: Sequence = ()) -> DataFrame:
    aggs = [F.regr_slope(y, yhat).alias("slope"), F.regr_intercept(y, yhat).alias("intercept")]
    return df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)


# MET17 ------------------------------------------------------------------------
def reconstruction_error(x: Column, x_hat: Column) -> Column:
    """Mean squared difference of two equal-length arrays, per row."""
    sq = F.zip_with(x, x_hat, lambda a, b: (a - b) * (a - b))
    return F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)
