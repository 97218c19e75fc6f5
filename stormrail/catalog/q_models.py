"""Registered queries: feature transforms, models and predictions (FTR*, MOD*, PRED*, MET14-16)."""

from pyspark.sql import functions as F

from stormrail.catalog import query
from stormrail.catalog.q_plans import features
from stormrail.catalog.util import R, r6, sql_r6, with_roles
from stormrail.operators import models as MD
from stormrail.operators import search as SR
from stormrail.operators.sampling import holdout, time_folds
from stormrail.session import stored
from stormrail.sources import sinks as SK

KEYS = ["station", "time", "train_type"]
FEATS = ["train_count", "prec", "gust", "vis", "n", "prec_3h", "prec_6h", "flashcount"]


def _data(spark, sf):
    """The rows that models are fitted on and scored, written once: each pass of a fit would build the features anew."""
    f = features(spark, sf).withColumn("label", (F.col("delay") > 50).cast("int"))
    return stored(holdout(f, KEYS, 30).select(*KEYS, *FEATS, "delay", "label", "split"), "features")


def _train_test(spark, sf):
    d = _data(spark, sf)
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


_SC = ["gust", "prec", "flashcount"]


@query("ftr1_scale", with_roles(", ".join(
    [f"select station, time, train_type"] +
    [f"{sql_r6(f'({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1)', 4)} as {c}" for c in _SC])
    + " from (" + __import__("stormrail.catalog.q_plans", fromlist=["ING1_BODY"]).ING1_BODY + ")"))
def ftr1_scale(spark, sf):
    f = features(spark, sf)
    st = MD.fit_standard_scaler(f, _SC)
    out = MD.apply_standard_scaler(f, st, _SC)
    return out.select(*KEYS, *[r6(c, 4).alias(c) for c in _SC])


@query("ftr1_inverse", with_roles(", ".join(
    ["select station, time, train_type"] + [f"0.0 as {c}_roundtrip_error" for c in _SC])
    + " from (" + __import__("stormrail.catalog.q_plans", fromlist=["ING1_BODY"]).ING1_BODY + ")"))
def ftr1_inverse(spark, sf):
    f = features(spark, sf)
    st = MD.fit_standard_scaler(f, _SC)
    back = MD.apply_standard_scaler(MD.apply_standard_scaler(f, st, _SC), st, _SC, inverse=True)
    j = back.select(*KEYS, *[F.col(c).alias(f"b_{c}") for c in _SC]).join(f.select(*KEYS, *_SC), KEYS)
    return j.select(*KEYS, *[r6(F.col(f"b_{c}") - F.col(c)).alias(f"{c}_roundtrip_error") for c in _SC])


@query("ftr2_minmax", with_roles(", ".join(
    ["select vec_id"] + [f"{sql_r6(f'case when max(f{i}) over () <> min(f{i}) over () then -1 + (f{i} - min(f{i}) over ()) * 2 / (max(f{i}) over () - min(f{i}) over ()) else 0 end')} as f{i}" for i in range(64)])
    + " from r_vec"))
def ftr2_minmax(spark, sf):
    v = R.vectors(spark, sf)
    cols = [f"f{i}" for i in range(64)]
    out = MD.apply_minmax(v, MD.fit_minmax(v, cols), cols)
    return out.select("vec_id", *[r6(c).alias(c) for c in cols])


_VEC = [f"f{i}" for i in range(64)]


@query("ftr3_pca_whiten")
def ftr3_pca_whiten(spark, sf):
    v = R.vectors(spark, sf)
    model, means, eig = MD.fit_pca(v, _VEC, 3)
    out = MD.apply_pca(v, model, means, _VEC, eig, whiten=True, keep=["vec_id"])
    return out.select("vec_id", *[F.col("pc")[i].alias(f"pc{i}") for i in range(3)])


@query("met14_explained_variance")
def met14_explained_variance(spark, sf):
    v = R.vectors(spark, sf)
    model, _, eig = MD.fit_pca(v, _VEC, 4)
    ratios = model.explainedVariance.toArray().tolist()
    return spark.createDataFrame([(i, float(r), float(e)) for i, (r, e) in enumerate(zip(ratios, eig))],
                                 "component int, ratio double, eigenvalue double")


@query("met17_pca_reconstruction")
def met17_pca_reconstruction(spark, sf):
    from stormrail.operators.metrics import reconstruction_error
    v = R.vectors(spark, sf)
    model, means, _ = MD.fit_pca(v, _VEC, 3)
    rec = MD.reconstruct_pca(v, model, means, _VEC, keep=["vec_id", "label"])
    return rec.select("vec_id", "label", reconstruction_error(F.col("x"), F.col("x_hat")).alias("err")) \
              .withColumn("above_5", F.col("err") > 5)


def _predict(spark, sf, kind, label, **params):
    train, test = _train_test(spark, sf)
    m = MD.fit_model(train, FEATS, label, kind, **params)
    return m.transform(test).select(*KEYS, F.col(label).alias("y"), "prediction")


@query("mod1_rf_regressor")
def mod1_rf_regressor(spark, sf):
    return _predict(spark, sf, "rf_regressor", "delay", numTrees=20, maxDepth=6, seed=7)


@query("mod1_rf_classifier")
def mod1_rf_classifier(spark, sf):
    return _predict(spark, sf, "rf_classifier", "label", numTrees=20, maxDepth=6, seed=7)


@query("mod2_gbt_regressor")
def mod2_gbt_regressor(spark, sf):
    return _predict(spark, sf, "gbt_regressor", "delay", maxIter=10, maxDepth=4, seed=7)


@query("mod2_gbt_classifier")
def mod2_gbt_classifier(spark, sf):
    return _predict(spark, sf, "gbt_classifier", "label", maxIter=10, maxDepth=4, seed=7)


@query("mod3_linear_elastic")
def mod3_linear_elastic(spark, sf):
    return _predict(spark, sf, "linear", "delay", regParam=0.1, elasticNetParam=0.5)


@query("mod5_linear_svc")
def mod5_linear_svc(spark, sf):
    return _predict(spark, sf, "linear_svc", "label", maxIter=20, regParam=0.01)


@query("mod6_mixture")
def mod6_mixture(spark, sf):
    v = R.vectors(spark, sf)
    m = MD.fit_model(v, _VEC, "label", "gmm", k=4, seed=7, maxIter=20)
    return m.transform(v).select("vec_id", "prediction")


def _gnb_sql(probability: bool = False):
    each = lambda form: "[" + ", ".join(form.format(f=f) for f in _VEC) + "]"
    eps = "select 1e-9 * greatest(" + ", ".join(f"var_pop({f})" for f in _VEC) + ") as eps from r_vec"
    stats = (f"select label, count(*) / (select count(*) from r_vec) as prior, {each('avg({f})')} as m, "
             f"{each('var_pop({f}) + any_value(eps)')} as v from r_vec, e group by label")
    ll = ("ln(s.prior) - list_sum(list_transform(range(1, 65), "
          "lambda i: 0.5 * ln(2 * pi() * s.v[i]) + pow(r.x[i] - s.m[i], 2) / (2 * s.v[i])))")
    more = f", {sql_r6('1 / sum(exp(ll - top)) over (partition by vec_id)', 4)} as probability" if probability else ""
    keep = "qualify" if probability else "where"
    return with_roles(f"""
select vec_id, pred{more} from (select *, row_number() over (partition by vec_id order by ll desc, pred) as rn,
    max(ll) over (partition by vec_id) as top
  from (select r.vec_id, s.label as pred, {ll} as ll
  from (select vec_id, {each('{f}')} as x from r_vec) r, st s)) {keep} rn = 1""", ("e", eps), ("st", stats))


@query("mod4_gnb", _gnb_sql())
def mod4_gnb(spark, sf):
    v = R.vectors(spark, sf)
    st = MD.gaussian_nb_fit(v, _VEC, "label")
    return MD.gaussian_nb_predict(v, st, _VEC, "label", ["vec_id"]).select("vec_id", "pred")


@query("mod4_probability", _gnb_sql(True))
def mod4_probability(spark, sf):
    v = R.vectors(spark, sf)
    st = MD.gaussian_nb_fit(v, _VEC, "label")
    p = MD.gaussian_nb_predict(v, st, _VEC, "label", ["vec_id"])
    return p.select("vec_id", "pred", r6("probability", 4).alias("probability"))


@query("mod4_merged", _gnb_sql())
def mod4_merged(spark, sf):
    """Three batches of moments, one of them stored twice, merged: the fit of all rows at once."""
    v = R.vectors(spark, sf)
    path = SK.scratch_path(spark, "moments")
    for b in (0, 1, 2, 1):
        part = v.where(F.pmod(F.col("vec_id"), F.lit(3)) == b)
        SK.committed_append(MD.gaussian_nb_moments(part, _VEC, "label"), path, f"part-{b}")
    st = MD.gaussian_nb_finish(SK.read_committed(spark, path), "label")
    return MD.gaussian_nb_predict(v, st, _VEC, "label", ["vec_id"]).select("vec_id", "pred")


_NB2 = ["train_count", "total_delay"]


def _nb2_sql(group: str, source: str) -> str:
    """Two-feature naive Bayes as CTEs: st (class table) of each ``group`` (an expression) of ``source``."""
    return f"""
e as (select {group} as g, 1e-9 * greatest(var_pop(train_count), var_pop(total_delay)) as eps, count(*) as n from {source} group by 1),
st as (select {group} as g, label, count(*) / any_value(e.n) as prior, avg(train_count) as m1, avg(total_delay) as m2,
  var_pop(train_count) + any_value(eps) as v1, var_pop(total_delay) + any_value(eps) as v2
  from {source} join e on {group} = e.g group by 1, 2),
sv as (select * replace (case when v1 > 0 then v1 else 1 end as v1, case when v2 > 0 then v2 else 1 end as v2) from st),
sc as (select d.station, d.time, d.train_type, s.label as cls, ln(s.prior)
  - (0.5 * ln(2 * pi() * s.v1) + pow(d.train_count - s.m1, 2) / (2 * s.v1))
  - (0.5 * ln(2 * pi() * s.v2) + pow(d.total_delay - s.m2, 2) / (2 * s.v2)) as ll from {source} d join sv s on {group} = s.g)"""


@query("mod8_station_nb", with_roles(f"""
with b as (select *, cast(delay > 25 as integer) as label from r_delays),{_nb2_sql('station', 'b')}
select station, time, train_type, cls as pred from sc qualify row_number() over (partition by station, time, train_type
  order by ll desc, cls) = 1"""))
def mod8_station_nb(spark, sf):
    d = R.delays(spark, sf).withColumn("label", (F.col("delay") > 25).cast("int"))
    moments = MD.gaussian_nb_moments(d, _NB2, "label", ["station"])
    st = MD.gaussian_nb_finish(moments, "label", ["station"])
    return MD.gaussian_nb_predict(d, st, _NB2, "label", KEYS, groups=["station"]).select(*KEYS, "pred")


@query("mod3_partial_fit")
def mod3_partial_fit(spark, sf):
    """Three chunks in turn, a step on each, twelve rounds: coefficients beside those of the closed form."""
    d = R.delays(spark, sf)
    state = None
    rows = stored(d.select("delay", *_NB2, F.pmod(F.xxhash64(*KEYS), F.lit(3)).alias("chunk")), "chunks")
    for chunk in (0, 1, 2) * 12:
        state = MD.partial_fit_linear(rows.where(F.col("chunk") == chunk), _NB2, "delay", state)
    exact = MD.per_group_linear(d.withColumn("_all", F.lit("all")), "_all", _NB2, "delay").first()["coef"]
    rows = [(n, float(a), float(b), state.steps) for n, a, b in zip(["intercept", *_NB2], state.coefficients(), exact)]
    return spark.createDataFrame(rows, "term string, weight double, closed_form double, steps int")


@query("mod7_random_search")
def mod7_random_search(spark, sf):
    """All four sets on five time folds; the best is refitted, saved and loaded again."""
    folds = stored(time_folds(_data(spark, sf), ["time", "station", "train_type"], 5), "folded")
    res, model, _ = SR.random_search(folds, FEATS, "delay", "rf_regressor", {"numTrees": [5, 10], "maxDepth": [3, 5]}, seed=7)
    path = SK.scratch_path(spark, "best")
    SK.save_model(model, path)
    best = SK.load_model(path).transform(folds)
    n = best.where(F.col("prediction").isNotNull()).count()
    return res.withColumn("refit_rows", F.when(F.col("rank") == 1, F.lit(n)))


@query("ftr4_select_important")
def ftr4_select_important(spark, sf):
    train, _ = _train_test(spark, sf)
    m = MD.fit_model(train, FEATS, "delay", "rf_regressor", numTrees=10, maxDepth=5, seed=7)
    keep = MD.select_important(m, FEATS)
    imp = MD.feature_importances(m, FEATS)
    imp["selected"] = imp["feature"].isin(keep)
    return spark.createDataFrame(imp)


@query("ftr5_feature_subsets")
def ftr5_feature_subsets(spark, sf):
    train, test = _train_test(spark, sf)
    subsets = {"counts": ["train_count"], "weather": ["prec", "gust", "vis", "prec_3h"], "all": FEATS}
    return SR.feature_subsets(train, test, subsets, "delay", "linear", regParam=0.1).withColumnRenamed("score", "rmse")


@query("met16_learning_curve")
def met16_learning_curve(spark, sf):
    folds = time_folds(_data(spark, sf), ["time", "station", "train_type"], 5)
    return SR.learning_curve(folds, FEATS, "delay", "linear", KEYS, regParam=0.1)


@query("mod8_per_station_linear", with_roles(f"""
select station, {sql_r6('regr_intercept(y, train_count)', 4)} as intercept, {sql_r6('regr_slope(y, train_count)', 4)} as slope,
  count(*) as n from (select d.station, d.delay as y, cast(d.train_count as double) as train_count from r_delays d) group by station"""))
def mod8_per_station_linear(spark, sf):
    d = R.delays(spark, sf)
    coefs = MD.per_group_linear(d, "station", ["train_count"], "delay")
    return coefs.select("station", r6(F.col("coef")[0], 4).alias("intercept"), r6(F.col("coef")[1], 4).alias("slope"), "n")


@query("mod8_predict_fallback", with_roles(f"""
with st as (select station, regr_intercept(delay, train_count) as a, regr_slope(delay, train_count) as b
            from r_delays group by station having count(*) >= 1700),
al as (select regr_intercept(delay, train_count) as a, regr_slope(delay, train_count) as b from r_delays)
select d.station, d.time, d.train_type,
  {sql_r6('case when st.a is null then al.a + al.b * d.train_count else st.a + st.b * d.train_count end', 3)} as prediction
from r_delays d left join st using (station), al"""))
def mod8_predict_fallback(spark, sf):
    d = R.delays(spark, sf)
    coefs = MD.per_group_linear(d, "station", ["train_count"], "delay", min_rows=1700)
    overall = MD.per_group_linear(d.withColumn("_all", F.lit("all")), "_all", ["train_count"], "delay")
    p = MD.predict_per_group(d, coefs, "station", ["train_count"], fallback=overall)
    return p.select(*KEYS, r6("prediction", 3).alias("prediction"))


@query("mod9_flagged_regressor")
def mod9_flagged_regressor(spark, sf):
    train, test = _train_test(spark, sf)
    clf = MD.fit_model(train, FEATS, "label", "rf_classifier", numTrees=10, maxDepth=5, seed=7)
    scored = clf.transform(train)
    from pyspark.ml.functions import vector_to_array
    scored = scored.withColumn("p1", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    reg = MD.fit_model(MD.flagged_rows(scored, "p1", 0.1), FEATS, "delay", "rf_regressor", numTrees=10, maxDepth=5, seed=7)
    return reg.transform(test).select(*KEYS, "prediction")


def _dual_sql(cols: str) -> str:
    return with_roles(f"""
with b as (select *, cast(delay > 50 as integer) as label from r_delays),{_nb2_sql("'all'", 'b')},
p as (select station, time, train_type, coalesce(max(exp(ll - top)) filter (cls = 1), 0) / sum(exp(ll - top)) as proba
  from (select *, max(ll) over (partition by station, time, train_type) as top from sc) group by all),
r as (select regr_intercept(delay, train_count) as a, regr_slope(delay, train_count) as s from b)
select b.station, b.time, b.train_type, {cols} from b join p using (station, time, train_type), r""")


def _dual(spark, sf):
    d = R.delays(spark, sf).withColumn("label", (F.col("delay") > 50).cast("int"))
    classifier = MD.gaussian_nb_fit(d, _NB2, "label")
    regressor = MD.per_group_linear(d.withColumn("_all", F.lit("all")), "_all", ["train_count"], "delay")
    return MD.predict_dual(d, classifier, _NB2, "label", regressor, ["train_count"], KEYS, 0.3)


@query("pred1_dual", _dual_sql(f"{sql_r6('case when proba >= 0.3 then r.a + r.s * train_count else 0.0 end', 3)} as dual"))
def pred1_dual(spark, sf):
    return _dual(spark, sf).select(*KEYS, r6("dual", 3).alias("dual"))


@query("pred2_dual_all", _dual_sql(f"{sql_r6('r.a + r.s * train_count', 3)} as y_pred, "
                                   f"cast(proba >= 0.3 as integer) as class, {sql_r6('proba', 4)} as proba"))
def pred2_dual_all(spark, sf):
    return _dual(spark, sf).select(*KEYS, r6("y_pred", 3).alias("y_pred"), "class", r6("proba", 4).alias("proba"))
