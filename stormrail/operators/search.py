"""Model selection: random search (MOD7), learning curves (MET16), feature
subsets (FTR5).

All fits of a search read one table, written once with the columns they need,
and run as concurrent Spark jobs: the driver only submits them and gathers one
number for each fit. Folds are columns of that table, not tables of their own.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormrail.operators.models import fit_model
from stormrail.operators.sampling import hash_order
from stormrail.session import stored

#: Fits submitted at the same time.
PARALLEL = 4
_REGRESSION = ("rmse", "mse", "mae", "r2", "var")


def evaluator(label: str, metric: str) -> Evaluator:
    """The evaluator of a regression metric, else of a classification one (f1, accuracy, ...)."""
    kind = RegressionEvaluator if metric in _REGRESSION else MulticlassClassificationEvaluator
    return kind(labelCol=label, predictionCol="prediction", metricName=metric)


def _all(spark: SparkSession, jobs: Sequence[Callable[[], float]]) -> list:
    """Results of the jobs in their order, ``PARALLEL`` of them running at a time."""
    with ThreadPoolExecutor(PARALLEL) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def _ranks(scores: Sequence[float], larger_is_better: bool) -> list[int]:
    """1 for the best score; equal scores share a rank."""
    return [1 + sum((t > s) if larger_is_better else (t < s) for t in scores) for s in scores]


def random_search(folds: DataFrame, cols: Sequence[str], label: str, kind: str, grid: dict, n_iter: int | None = None,
                  seed: int = 42, metric: str = "rmse", **fixed) -> tuple[DataFrame, PipelineModel, dict]:
    """Score ``n_iter`` parameter sets drawn from ``grid`` (all by default) on every expanding time fold of ``folds``
    (columns of ``time_folds``: fold k is trained on ``first_train_fold <= k`` and tested on ``test_fold = k``), and fit
    the best one again on all rows.

    Returns (params, mean_score, std_score, rank; best first), the refitted model and its parameters. Whether larger
    is better is the metric's own.
    """
    sets = [dict(zip(grid, c)) for c in itertools.product(*grid.values())]
    picked = sets if n_iter is None or n_iter >= len(sets) else random.Random(seed).sample(sets, n_iter)
    rows = stored(folds.select(*cols, label, "test_fold", "first_train_fold"), "folds")
    ev = evaluator(label, metric)
    n = rows.agg(F.max("test_fold")).first()[0] or 0
    if not n:
        raise ValueError("no fold to test on")

    def score(params, k):
        model = fit_model(rows.where(F.col("first_train_fold") <= k), cols, label, kind, **fixed, **params)
        return ev.evaluate(model.transform(rows.where(F.col("test_fold") == k)))

    found = np.array(_all(rows.sparkSession, [lambda p=p, k=k: score(p, k) for p in picked for k in range(1, n + 1)])).reshape(len(picked), n)
    ranks = _ranks(found.mean(axis=1).tolist(), ev.isLargerBetter())
    best = picked[ranks.index(1)]
    table = sorted((r, ",".join(f"{k}={v}" for k, v in sorted(p.items())), float(s.mean()), float(s.std()))
                   for r, p, s in zip(ranks, picked, found))
    out = folds.sparkSession.createDataFrame([(p, m, s, r) for r, p, m, s in table],
                                             "params string, mean_score double, std_score double, rank int")
    return out, fit_model(rows, cols, label, kind, **fixed, **best), best


def learning_curve(folds: DataFrame, cols: Sequence[str], label: str, kind: str, keys: Sequence[str],
                   sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), metric: str = "rmse", **params) -> DataFrame:
    """(train_percent, train_mean, train_std, test_mean, test_std): scores on growing shares of each fold's training
    rows (the first ones in the order of a hash of ``keys``) and on its test rows."""
    digits = F.conv(F.substring(hash_order(keys), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    rows = stored(folds.select(*cols, label, "test_fold", "first_train_fold", digits.alias("_place")), "folds")
    ev = evaluator(label, metric)
    n = rows.agg(F.max("test_fold")).first()[0] or 0

    def score(size, k):
        train = rows.where((F.col("first_train_fold") <= k) & (F.col("_place") < size))
        model = fit_model(train, cols, label, kind, **params)
        return ev.evaluate(model.transform(train)), ev.evaluate(model.transform(rows.where(F.col("test_fold") == k)))

    found = np.array(_all(rows.sparkSession, [lambda s=s, k=k: score(s, k) for s in sizes for k in range(1, n + 1)])).reshape(len(sizes), n, 2)
    table = [(round(100.0 * s, 6), *(float(x) for j in (0, 1) for x in (f[:, j].mean(), f[:, j].std()))) for s, f in zip(sizes, found)]
    return folds.sparkSession.createDataFrame(
        table, "train_percent double, train_mean double, train_std double, test_mean double, test_std double")


def feature_subsets(train: DataFrame, test: DataFrame, subsets: dict[str, Sequence[str]], label: str, kind: str,
                    metric: str = "rmse", **params) -> DataFrame:
    """(subset, features, score): a model for each named set of features, scored on ``test``."""
    cols = sorted({c for s in subsets.values() for c in s})
    train, test = (stored(df.select(*cols, label), "subset") for df in (train, test))
    ev = evaluator(label, metric)

    def score(own):
        return ev.evaluate(fit_model(train, own, label, kind, **params).transform(test))

    found = _all(train.sparkSession, [lambda own=own: score(list(own)) for own in subsets.values()])
    return train.sparkSession.createDataFrame(
        [(n, ",".join(c), float(s)) for (n, c), s in zip(subsets.items(), found)],
        "subset string, features string, score double")
