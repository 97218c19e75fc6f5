"""Feature transforms and model fitting (FTR*, MOD*, PRED*).

- Scalers and Gaussian naive Bayes are plain aggregates: one small row or one
  array of classes, which the rows are scored with in a projection.
- Forests, boosted trees, linear models, linear SVC, mixtures and PCA are
  Spark ML estimators on an assembled vector.
- Per-station linear models are solved from per-station covariances (partial
  aggregation of centred sums), so a hot station is never collected into one
  task; only the k x k systems (one row per station) are solved in numpy, all
  of a batch at once.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


# FTR1 -------------------------------------------------------------------------
def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row table of mean_<c> and std_<c> (population std; 0 -> 1)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    st = df.agg(*aggs)
    return st.select(*[F.col(f"mean_{c}") for c in cols],
                     *[F.when(F.col(f"std_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"std_{c}")).alias(f"std_{c}")
                       for c in cols])


def apply_standard_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str], inverse: bool = False) -> DataFrame:
    """(x - mean) / std, or x * std + mean. The stats, one row of two numbers for each column, are taken as literals,
    so the input of the fit is read once."""
    s = stats.first()

    def scaled(c):
        m, d = (F.lit(s[f"{k}_{c}"]).cast("double") for k in ("mean", "std"))
        return F.col(c) * d + m if inverse else (F.col(c) - m) / d

    return df.withColumns({c: scaled(c) for c in cols})


# FTR2 -------------------------------------------------------------------------
def fit_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.min(c).alias(f"min_{c}") for c in cols], *[F.max(c).alias(f"max_{c}") for c in cols])


def apply_minmax(df: DataFrame, stats: DataFrame, cols: Sequence[str], lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Scale to [lo, hi]; a constant column maps to the middle."""
    s = stats.first()  # one row

    def scaled(c):
        mn, mx = (F.lit(s[f"{k}_{c}"]).cast("double") for k in ("min", "max"))
        return F.when(mx != mn, F.lit(lo) + (F.col(c) - mn) * (hi - lo) / (mx - mn)).otherwise(F.lit((lo + hi) / 2))

    return df.withColumns({c: scaled(c) for c in cols})


# helpers ----------------------------------------------------------------------
def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


# FTR3 / MET14 -----------------------------------------------------------------
def fit_pca(df: DataFrame, cols: Sequence[str], k: int):
    """Centred PCA (ML PCA does not centre the rows it projects). Returns
    (model, means, eigenvalues) where eigenvalues are those of the sample
    covariance (explained variance ratio x total variance)."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centred = df.select(*[(F.col(c) - F.lit(means[c])).alias(c) for c in cols])
    vec = assemble(centred, cols)
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(vec)
    total_var = df.agg(sum(F.var_samp(c) for c in cols)).first()[0]  # one number
    eig = [float(r) * total_var for r in model.explainedVariance.toArray()]
    return model, means, eig


def apply_pca(df: DataFrame, model, means: Row, cols: Sequence[str], eig: Sequence[float] | None = None,
              whiten: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    centred = df.select(*keep, *[(F.col(c) - F.lit(means[c])).alias(c) for c in cols])
    out = model.transform(assemble(centred, cols)).withColumn("pc", vector_to_array("pca"))
    if whiten and eig:
        scale = F.array(*[F.lit(1.0 / np.sqrt(e)) if e > 0 else F.lit(0.0) for e in eig])
        out = out.withColumn("pc", F.zip_with("pc", scale, lambda a, b: a * b))
    return out.select(*keep, "pc")


def reconstruct_pca(df: DataFrame, model, means: Row, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """x_hat = mean + P (P'(x - mean)); returns x and x_hat arrays (MET17). The work for a row is twice components x
    columns, and the plan holds one array for each component."""
    parts = [F.array(*[F.lit(float(v)) for v in p]) for p in model.pc.toArray().T]
    mean = F.array(*[F.lit(float(means[c])) for c in cols])
    x = F.array(*[F.col(c).cast("double") for c in cols])
    off = F.zip_with("x", mean, lambda v, m: v - m)
    scores = F.array(*[F.aggregate(F.zip_with("_off", p, lambda v, w: v * w), F.lit(0.0), lambda t, v: t + v)
                       for p in parts])

    def step(x_hat, j):
        return F.zip_with(x_hat, parts[j], lambda h, w: h + F.col("_scores")[j] * w)

    x_hat = functools.reduce(step, range(len(parts)), mean)
    out = df.select(*keep, x.alias("x")).withColumn("_off", off).withColumn("_scores", scores)
    return out.select(*keep, "x", x_hat.alias("x_hat"))


# MOD1 / MOD2 / MOD3 / MOD5 / MOD6 ---------------------------------------------------
def _estimator(kind: str, label: str, **params):
    from pyspark.ml import classification as C
    from pyspark.ml import clustering as K
    from pyspark.ml import regression as Rg
    table = {
        "rf_regressor": Rg.RandomForestRegressor, "rf_classifier": C.RandomForestClassifier,
        "gbt_regressor": Rg.GBTRegressor, "gbt_classifier": C.GBTClassifier,
        "linear": Rg.LinearRegression, "linear_svc": C.LinearSVC, "logistic": C.LogisticRegression,
        "gmm": K.GaussianMixture,
    }
    cls = table[kind]
    if kind == "gmm":
        return cls(featuresCol="features", **params)
    return cls(featuresCol="features", labelCol=label, **params)


def fit_model(df: DataFrame, cols: Sequence[str], label: str, kind: str, **params) -> PipelineModel:
    """Assemble + estimator as one ``PipelineModel`` (savable with
    ``model.write().overwrite().save(path)``)."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep"),
                            _estimator(kind, label, **params)])
    return pipe.fit(df)


def feature_importances(model: PipelineModel, cols: Sequence[str]) -> pd.DataFrame:
    """MET15: importance per feature (a tiny driver table)."""
    imp = model.stages[-1].featureImportances.toArray()
    return pd.DataFrame({"feature": list(cols), "importance": imp}).sort_values("importance", ascending=False)


def select_important(model: PipelineModel, cols: Sequence[str]) -> list[str]:
    """FTR4: features whose importance is at least the mean importance."""
    imp = model.stages[-1].featureImportances.toArray()
    return [c for c, v in zip(cols, imp) if v >= imp.mean()]


def slice_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    idx = [list(cols).index(c) for c in keep]
    return VectorSlicer(inputCol="features", outputCol="selected", indices=idx).transform(assemble(df, cols))


# MOD4 -------------------------------------------------------------------------
def gaussian_nb_fit(df: DataFrame, cols: Sequence[str], label: str, var_smoothing: float = 1e-9) -> DataFrame:
    """Class statistics: prior (unsmoothed), mean and variance per class x
    feature; variances get ``var_smoothing * max feature variance`` added. A
    variance that is 0 all the same (every feature constant) counts as 1, so
    scores stay defined."""
    long = df.select(label, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("kv"))
    whole = df.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    eps = var_smoothing * max([whole[f"v{i}"] or 0.0 for i in range(len(cols))], default=0.0)
    st = long.groupBy(label, "kv.feature").agg(F.avg("kv.v").alias("mean"), (F.var_pop("kv.v") + eps).alias("var"),
                                               F.count(F.lit(1)).alias("n_c"))
    return st.select(label, "feature", "mean", F.when(F.col("var") > 0, F.col("var")).otherwise(1.0).alias("var"),
                     (F.col("n_c") / F.lit(max(1, whole["n"]))).alias("prior"))


def gaussian_nb_moments(df: DataFrame, cols: Sequence[str], label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mergeable moments (groups..., label, feature, n, mean, m2): how many values a class has of a feature, their mean,
    and the sum of squares about it. Batches merge with :func:`merge_moments`, in any order."""
    long = df.select(*groups, label, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("kv"))
    return long.groupBy(*groups, label, "kv.feature").agg(
        F.count("kv.v").alias("n"), F.coalesce(F.avg("kv.v"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop("kv.v") * F.count("kv.v"), F.lit(0.0)).alias("m2"))


def merge_moments(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments of all rows with equal ``keys`` taken together. Squares are summed about the common mean, so means far
    from 0 cost no precision."""
    from stormrail.operators.sampling import null_safe_join
    n = F.sum("n")
    whole = moments.groupBy(*keys).agg(n.alias("_n"), F.coalesce(
        F.sum(F.col("n") * F.col("mean")) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("_mean"))
    off = F.col("mean") - F.col("_mean")
    return null_safe_join(moments, whole, keys).groupBy(*keys).agg(
        F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"))


def gaussian_nb_finish(moments: DataFrame, label: str, groups: Sequence[str] = (),
                       var_smoothing: float = 1e-9) -> DataFrame:
    """Class statistics as of :func:`gaussian_nb_fit` (one model for each of ``groups``) from moments, which are merged
    first."""
    from stormrail.operators.sampling import null_safe_join
    groups = list(groups)
    m = merge_moments(moments, [*groups, label, "feature"])
    every = merge_moments(m, [*groups, "feature"])
    var = F.when(F.col("n") > 0, F.col("m2") / F.col("n"))
    eps = F.lit(var_smoothing) * F.coalesce(F.max(var), F.lit(0.0))
    sizes = m.groupBy(*groups, label).agg(F.max("n").alias("_n_c"))
    both = sizes.groupBy(*groups).agg(F.sum("_n_c").alias("_n")) if groups else sizes.agg(F.sum("_n_c").alias("_n"))
    wide = every.groupBy(*groups).agg(eps.alias("_eps")) if groups else every.agg(eps.alias("_eps"))
    st = null_safe_join(m, sizes, [*groups, label])
    if groups:
        st = null_safe_join(null_safe_join(st, both, groups), wide, groups)
    else:  # one row each
        st = st.select("*", both.scalar().alias("_n"), wide.scalar().alias("_eps"))
    spread = var + F.col("_eps")
    return st.select(*groups, label, "feature", "mean", F.when(spread > 0, spread).otherwise(1.0).alias("var"),
                     (F.col("_n_c") / F.col("_n")).alias("prior"))


def _nb_scored(table: Column, x: Column, df: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """``_nb``, the joint log-likelihood of each class of ``table``, and ``_best``, the largest (ties -> smaller class)."""
    def score(c):
        terms = F.zip_with("_x", c["f"], lambda v, s: F.lit(0.5) * F.log(F.lit(2 * np.pi) * s["var"])
                           + F.pow(v - s["mean"], F.lit(2)) / (F.lit(2.0) * s["var"]))
        ll = F.aggregate(terms, F.log(c["prior"]), lambda acc, t: acc - t)
        return F.struct(ll.alias("ll"), (-c["cls"]).alias("neg_cls"), c["cls"].alias("cls"))

    whole = df.select(*keys, *extra, x.alias("_x"), table.alias("_t"))
    return whole.select(*keys, F.transform("_t", score).alias("_nb")).withColumn("_best", F.array_max("_nb"))


def _class_table(stats: DataFrame, cols: Sequence[str], label: str, groups: Sequence[str] = ()) -> DataFrame:
    """The classes of a model (of each of ``groups``) as one array: classes x features numbers, however many rows the
    model was fitted on."""
    per = stats.groupBy(*groups, F.col(label).alias("cls")).agg(
        F.first("prior").alias("prior"),
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "var")))).alias("f"))
    table = F.collect_list(F.struct("cls", "prior", F.array(*[F.col("f")[c] for c in cols]).alias("f"))).alias("_t")
    return per.groupBy(*groups).agg(table) if groups else per.agg(table)


def gaussian_nb_predict(df: DataFrame, stats: DataFrame, cols: Sequence[str], label: str,
                        keys: Sequence[str], out: str = "pred", groups: Sequence[str] = ()) -> DataFrame:
    """The class of the largest joint log-likelihood (ties -> smaller class),
    that log-likelihood, the class's probability and those of all classes
    (``probabilities``, a map). The class table is one array, a scalar
    subquery: scoring is a projection, no join and no shuffle, for any number
    of classes. With ``groups`` each row is scored by the model of its group
    (NULLs where there is none), joined in as one array for each group."""
    x = F.array(*[F.col(c).cast("double") for c in cols])
    table = _class_table(stats, cols, label, groups)
    if groups:
        from stormrail.operators.sampling import null_safe_join
        scored = _nb_scored(F.col("_t"), x, null_safe_join(df, table, groups, "left"), keys)
    else:
        scored = _nb_scored(table.scalar(), x, df, keys)
    total = F.aggregate("_nb", F.lit(0.0), lambda acc, s: acc + F.exp(s["ll"] - F.col("_best.ll")))
    each = F.transform("_nb", lambda s: F.struct(s["cls"], F.exp(s["ll"] - F.col("_best.ll")) / F.col("_total")))
    return scored.withColumn("_total", total).select(
        *keys, F.col("_best.cls").alias(out), F.col("_best.ll").alias("log_likelihood"),
        (F.lit(1.0) / F.col("_total")).alias("probability"), F.map_from_entries(each).alias("probabilities"))


# MOD8 -------------------------------------------------------------------------
def per_group_linear(df: DataFrame, group: str, cols: Sequence[str], label: str, ridge: float = 0.0,
                     min_rows: int = 2) -> DataFrame:
    """Least squares y ~ 1 + x per group from its covariances, which stay exact for values far from 0. Rows with a
    NULL feature or label are left out, groups of fewer than ``min_rows`` have no model, and a constant feature gets
    the coefficient 0. Returns (group, coef array [intercept, b1..bk], n)."""
    k = len(cols)
    xs = [F.col(c).cast("double") for c in cols]
    y = F.col(label).cast("double")
    known = df.where(F.col(label).isNotNull())
    for c in cols:
        known = known.where(F.col(c).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.array(*[F.avg(x) for x in xs]).alias("mx"),
            F.array(*[F.covar_pop(a, b) for a in xs for b in xs]).alias("xx"),
            F.array(*[F.covar_pop(x, y) for x in xs]).alias("xy")]
    st = known.groupBy(F.col(group).cast("string").alias(group)).agg(*aggs).where(F.col("n") >= min_rows)

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            xx = np.stack(pdf["xx"].to_list()).reshape(-1, k, k) + ridge * np.eye(k) / pdf["n"].to_numpy()[:, None, None]
            b = np.einsum("gij,gj->gi", np.linalg.pinv(xx), np.stack(pdf["xy"].to_list()))
            b0 = pdf["my"].to_numpy() - (b * np.stack(pdf["mx"].to_list())).sum(axis=1)
            yield pd.DataFrame({group: pdf[group], "coef": list(np.column_stack([b0, b])), "n": pdf["n"]})

    # one row per group: the solve step handles small k x k systems only
    return st.mapInPandas(solve, f"{group} string, coef array<double>, n long")


def predict_per_group(df: DataFrame, coefs: DataFrame, group: str, cols: Sequence[str],
                      fallback: DataFrame | None = None, out: str = "prediction") -> DataFrame:
    """Dot product with the group's coefficients; groups without a model
    use ``fallback`` (a one-row coefficient table, e.g. the "all" model)."""
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in cols])
    j = df.join(coefs.select(F.col(group).alias("_g"), F.col("coef").alias("_c")),
                F.col(group).cast("string") == F.col("_g"), "left")

    def dot(coef):
        return F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)

    pred = dot(F.col("_c"))
    if fallback is not None:
        fb = fallback.select("coef").first()[0]  # one row, k + 1 numbers
        pred = F.when(F.col("_c").isNull(), dot(F.array(*[F.lit(float(v)) for v in fb]))).otherwise(pred)
    return j.withColumn(out, pred).drop("_g", "_c")


# MOD9 / PRED1 / PRED2 -----------------------------------------------------------------
def flagged_rows(df: DataFrame, proba: str, limit: float = 0.5) -> DataFrame:
    """Rows the classifier flags (train the regressor on these only)."""
    return df.where(F.col(proba) >= limit)


def dual_prediction(proba: Column | str, yhat: Column | str, limit: float = 0.5) -> Column:
    """Class 0 -> 0, class 1 -> the regression value."""
    p = F.col(proba) if isinstance(proba, str) else proba
    y = F.col(yhat) if isinstance(yhat, str) else yhat
    return F.when(p >= limit, y).otherwise(F.lit(0.0))


def predict_dual(df: DataFrame, classifier: DataFrame, class_cols: Sequence[str], label: str, regressor: DataFrame,
                 value_cols: Sequence[str], keys: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Both models on every row: the chance of class 1, the class it gives at ``limit``, the regression value (y_pred,
    of all rows) and the dual prediction, which is 0 where the class is. ``classifier``: naive Bayes statistics;
    ``regressor``: a one-row coefficient table."""
    from stormrail.operators.sampling import null_safe_join
    scored = gaussian_nb_predict(df, classifier, class_cols, label, keys)
    chance = F.coalesce(F.col("probabilities")[1], F.lit(0.0))
    scored = scored.select(*keys, chance.alias("proba"))
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in value_cols])
    coef = regressor.select("coef").first()[0]  # one row, k + 1 numbers
    y = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in coef]), lambda a, b: a * b), F.lit(0.0),
                    lambda t, v: t + v)
    both = null_safe_join(df.select(*keys, y.alias("y_pred")), scored, keys)
    return both.select(*keys, "proba", (F.col("proba") >= limit).cast("int").alias("class"), "y_pred",
                       dual_prediction("proba", "y_pred", limit).alias("dual"))


# MOD3, chunk by chunk ---------------------------------------------------------------
@dataclass
class LinearState:
    """A linear model while it is fitted: weights (the intercept first) on features that ``mean`` and ``basis`` centre
    and decorrelate, their velocity, and the steps made."""

    mean: np.ndarray
    basis: np.ndarray
    weights: np.ndarray
    velocity: np.ndarray
    steps: int = 0

    def coefficients(self) -> np.ndarray:
        """Intercept and slopes on the features as they come."""
        slopes = self.basis @ self.weights[1:]
        return np.concatenate([[self.weights[0] - slopes @ self.mean], slopes])


def _decorrelating(known: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means, and a matrix that makes the centred columns uncorrelated with variance 1 (0 where they do not vary)."""
    k = len(cols)
    s = known.agg(*[F.avg(c) for c in cols], *[F.covar_pop(a, b) for a in cols for b in cols]).first()
    mean = np.array([v or 0.0 for v in s[:k]])
    values, vectors = np.linalg.eigh(np.array([v or 0.0 for v in s[k:]]).reshape(k, k))
    fine = values > 1e-12 * values.max(initial=0.0)
    return mean, vectors * np.where(fine, 1.0 / np.sqrt(np.where(fine, values, 1.0)), 0.0)


def partial_fit_linear(chunk: DataFrame, cols: Sequence[str], label: str, state: LinearState | None = None,
                       steps: int = 1, rate: float = 0.6, momentum: float = 0.3, ridge: float = 0.0) -> LinearState:
    """Go on fitting a linear model on ``chunk``: ``steps`` gradient steps, each one partial aggregate over the chunk
    (columns + 1 sums come to the driver). The first chunk decorrelates the features, so that few steps do; the rate
    falls with the steps made, so that chunks that differ are averaged. Rows with a NULL feature or label do not count;
    an empty chunk changes nothing."""
    k, known = len(cols), chunk
    for c in [*cols, label]:
        known = known.where(F.col(c).isNotNull())
    known = known.select(*[F.col(c).cast("double").alias(c) for c in [*cols, label]])
    if state is None:
        mean, basis = _decorrelating(known, cols)
        state = LinearState(mean, basis, np.zeros(k + 1), np.zeros(k + 1))
    for _ in range(steps):
        c = state.coefficients()
        error = sum((F.lit(float(w)) * F.col(n) for w, n in zip(c[1:], cols)), F.lit(float(c[0]))) - F.col(label)
        sums = known.agg(F.count(F.lit(1)), F.sum(error), *[
            F.sum(error * (F.col(n) - float(m))) for n, m in zip(cols, state.mean)]).first()
        if not sums[0]:
            return state
        raw = np.array(sums[1:]) / sums[0]
        gradient = np.concatenate([raw[:1], state.basis.T @ raw[1:] + ridge * state.weights[1:]])
        velocity = momentum * state.velocity - rate / (1 + state.steps / 10) * gradient
        state = LinearState(state.mean, state.basis, state.weights + velocity, velocity, state.steps + 1)
    return state
