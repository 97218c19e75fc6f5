"""Registered queries: metrics (MET*) and evaluation plans (EVAL1, EVAL2, FRAC1, AGG25, WIN13)."""

from pyspark.sql import functions as F

from stormrail.catalog import query
from stormrail.catalog.util import R, r6, sql_r6, with_roles
from stormrail.functions.scalar import class_by_limits
from stormrail.operators import metrics as M
from stormrail.operators.sampling import holdout
from stormrail.plans import evaluation as EV

_E = "(y_pred - y)"
_REG_SQL = (f"count(y) as n, {sql_r6(f'sqrt(avg({_E} * {_E}))')} as rmse, {sql_r6(f'avg(abs({_E}))')} as mae, "
            f"{sql_r6(f'1 - case when count(y) * var_pop(y) <> 0 then sum({_E} * {_E}) / (count(y) * var_pop(y)) end')} as r2, "
            f"{sql_r6(f'quantile_cont(abs({_E}), 0.5)')} as median_ae")
_SKILL_SQL = sql_r6(f"1 - sqrt(avg({_E} * {_E})) / sqrt(avg(pow(y - 6.0112, 2)))") + " as skill"
_REG_COLS = ["rmse", "mae", "r2", "median_ae"]


def _reg(df, groups, skill=True):
    g = M.regression_metrics(df, "y", "y_pred", groups, climatology=6.0112 if skill else None, median=True)
    cols = _REG_COLS + (["skill"] if skill else [])
    return g.select(*groups, "n", *[r6(c).alias(c) for c in cols])


@query("met1_rmse_mae", with_roles(f"""select station, {_REG_SQL}, {_SKILL_SQL} from r_reg group by station"""))
def met1_rmse_mae(spark, sf):
    return _reg(R.regression_eval(spark, sf), ["station"])


@query("met1_overall", with_roles(f"""select {_REG_SQL}, {_SKILL_SQL} from r_reg"""))
def met1_overall(spark, sf):
    return _reg(R.regression_eval(spark, sf), [])


@query("met4_skill_constant", with_roles(f"""
select train_type, {sql_r6(f'1 - sqrt(avg({_E} * {_E})) / 6.0112')} as skill_const from r_reg group by train_type"""))
def met4_skill_constant(spark, sf):
    g = M.regression_metrics(R.regression_eval(spark, sf), "y", "y_pred", ["train_type"], climatology=None)
    return g.select("train_type", r6(M.skill_constant_rmse(F.col("rmse"), 6.0112)).alias("skill_const"))


_BIN_SQL = """count(*) as n, cast(sum(cast(y = 1 and pred = 1 as bigint)) as bigint) as tp,
  cast(sum(cast(y <> 1 and pred = 1 as bigint)) as bigint) as fp, cast(sum(cast(y = 1 and pred <> 1 as bigint)) as bigint) as fn"""
_BIN_COLS = ["accuracy", "precision", "recall", "f1", "fbeta", "pred_pos_share", "pred_neg_share"]


def _bin_sql(groups: str, where: str = "") -> str:
    g = f"group by {groups}" if groups else ""
    sel = f"{groups}, " if groups else ""
    return with_roles(f"""
select {sel}n, tp, fp, fn, {sql_r6('acc')} as accuracy, {sql_r6('p')} as precision, {sql_r6('r')} as recall,
  {sql_r6('case when p + r <> 0 then 2 * p * r / (p + r) else 0 end')} as f1,
  {sql_r6('case when 4 * p + r <> 0 then 5 * p * r / (4 * p + r) else 0 end')} as fbeta,
  {sql_r6('pp')} as pred_pos_share, {sql_r6('1 - pp')} as pred_neg_share
from (select *, case when tp + fp <> 0 then tp / (tp + fp) else 0 end as p,
        case when tp + fn <> 0 then tp / (tp + fn) else 0 end as r from (
  select {sel}{_BIN_SQL}, avg(cast(y = pred as double)) as acc, avg(cast(pred = 1 as double)) as pp
  from r_binary {where} {g}))""")


def _bin(df, groups):
    g = M.binary_metrics(df, "y", "pred", groups)
    return g.select(*groups, "n", "tp", "fp", "fn", *[r6(c).alias(c) for c in _BIN_COLS])


@query("met5_prf", _bin_sql("period"))
def met5_prf(spark, sf):
    return _bin(R.binary_eval(spark, sf), ["period"])


_CLS = "cast(case when {c} <= 10 then 0 when {c} <= 50 then 1 when {c} <= 100 then 2 else 3 end as integer)"


def _classes(spark, sf):
    r = R.regression_eval(spark, sf)
    return r.select(class_by_limits("y").alias("y"), class_by_limits("y_pred").alias("pred"))


@query("met6_report", with_roles(f"""
with c as (select {_CLS.format(c='y')} as y, {_CLS.format(c='y_pred')} as pred from r_reg),
k as (select y as cls from c union select pred from c),
t as (select k.cls, (select count(*) from c where c.y = k.cls and c.pred = k.cls) as tp,
        (select count(*) from c where c.y = k.cls) as support, (select count(*) from c where c.pred = k.cls) as npred from k),
m as (select cls, case when npred <> 0 then tp / npred else 0 end as precision,
        case when support <> 0 then tp / support else 0 end as recall, support from t),
f as (select *, case when precision + recall <> 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from m)
select cast(cls as varchar) as cls, {sql_r6('precision')} as precision, {sql_r6('recall')} as recall, {sql_r6('f1')} as f1,
  cast(support as bigint) as support from f
union all select 'macro avg', {sql_r6('avg(precision)')}, {sql_r6('avg(recall)')}, {sql_r6('avg(f1)')}, cast(sum(support) as bigint) from f
union all select 'weighted avg', {sql_r6('sum(precision * support) / sum(support)')}, {sql_r6('sum(recall * support) / sum(support)')},
  {sql_r6('sum(f1 * support) / sum(support)')}, cast(sum(support) as bigint) from f"""))
def met6_report(spark, sf):
    r = M.per_class_report(_classes(spark, sf))
    return r.select("cls", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@query("met7_confusion", with_roles(f"""
select y, pred, count(*) as count, {sql_r6('count(*) / sum(count(*)) over (partition by y)')} as share
from (select {_CLS.format(c='y')} as y, {_CLS.format(c='y_pred')} as pred from r_reg) group by y, pred"""))
def met7_confusion(spark, sf):
    c = M.confusion(_classes(spark, sf))
    return c.select("y", "pred", "count", r6("share").alias("share"))


def _auc_sql(groups: str) -> str:
    gsel = f"{groups}, " if groups else ""
    part = f"partition by {groups} " if groups else ""
    return with_roles(f"""
with s as (select {gsel}proba as score, sum(cast(y = 1 as bigint)) as pos, sum(cast(y <> 1 as bigint)) as neg
           from r_binary group by {gsel}proba),
c as (select *, sum(pos) over ({part}order by score desc rows unbounded preceding) as tp,
        sum(neg) over ({part}order by score desc rows unbounded preceding) as fp,
        sum(pos) over ({part.strip()}) as P, sum(neg) over ({part.strip()}) as N from s)
select {gsel}{sql_r6('case when min(P) * min(N) <> 0 then sum(neg * (2 * tp - pos) / 2.0) / (min(P) * min(N)) end')} as auc,
  {sql_r6('case when min(P) <> 0 then sum(pos * tp / (tp + fp)) / min(P) end')} as ap
from c {'group by ' + groups if groups else ''}""")


@query("met8_auc", _auc_sql("period"))
def met8_auc(spark, sf):
    a = M.auc_ap(R.binary_eval(spark, sf), "y", "proba", ["period"])
    return a.select("period", r6("auc").alias("auc"), r6("ap").alias("ap"))


@query("met9_ap", _auc_sql(""))
def met9_ap(spark, sf):
    a = M.auc_ap(R.binary_eval(spark, sf), "y", "proba")
    return a.select(r6("auc").alias("auc"), r6("ap").alias("ap"))


@query("met10_ovr_auc", with_roles(f"""
with e as (select cls - 1 as cls, [{', '.join(f'f{i}' for i in range(64))}][cls] as score, cast(label % 64 = cls - 1 as integer) as y
           from r_vec, range(1, 65) t(cls)),
s as (select cls, score, sum(cast(y = 1 as bigint)) as pos, sum(cast(y <> 1 as bigint)) as neg from e group by cls, score),
c as (select *, sum(pos) over (partition by cls order by score desc rows unbounded preceding) as tp,
        sum(pos) over (partition by cls) as P, sum(neg) over (partition by cls) as N from s),
a as (select cls, case when min(P) * min(N) <> 0 then sum(neg * (2 * tp - pos) / 2.0) / (min(P) * min(N)) end as auc from c group by cls)
select cast(cls as integer) as cls, {sql_r6('auc')} as auc from a union all select -1, {sql_r6('avg(auc)')} from a"""))
def met10_ovr_auc(spark, sf):
    v = R.vectors(spark, sf).select((F.col("label") % 64).alias("y"),
                                     F.array(*[f"f{i}" for i in range(64)]).alias("p"))
    a = M.one_vs_rest_auc(v, "y", "p")
    return a.select("cls", r6("auc").alias("auc"))


@query("met8_points", with_roles(f"""
with b as (select l_suppkey % 5 as grp, cast(l_returnflag = 'R' as bigint) as y, l_extendedprice as score from lineitem),
s as (select grp, score, sum(y) as pos, sum(1 - y) as neg from b group by all),
c as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by grp) as P, sum(neg) over (partition by grp) as N
  from s window w as (partition by grp order by score desc rows unbounded preceding))
select cast(grp as bigint) as grp, score, cast(tp as bigint) as tp, cast(fp as bigint) as fp, {sql_r6('tp / P')} as tpr, {sql_r6('fp / N')} as fpr, {sql_r6('tp / (tp + fp)')} as precision
from c"""))
def met8_points(spark, sf):
    """Points of the ROC and precision-recall curves for a continuous score."""
    li = R.read_table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("grp"), (
        F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("proba"))
    p = M.roc_points(li, "y", "proba", ["grp"])
    return p.select(F.col("grp").cast("long").alias("grp"), "score", F.col("tp").cast("long").alias("tp"),
                    F.col("fp").cast("long").alias("fp"), *[r6(c).alias(c) for c in ("tpr", "fpr", "precision")])


_MACRO = f"""
with e as (select cls - 1 as cls, [{', '.join(f'f{i}' for i in range(64))}][cls] as score, cast(label % 64 = cls - 1 as integer) as y
           from r_vec, range(1, 65) t(cls)),
s as (select cls, score, sum(cast(y = 1 as bigint)) as pos, sum(cast(y <> 1 as bigint)) as neg from e group by cls, score),
c as (select *, sum(pos) over (partition by cls order by score desc rows unbounded preceding) as tp,
        sum(neg) over (partition by cls order by score desc rows unbounded preceding) as fp,
        sum(pos) over (partition by cls) as P, sum(neg) over (partition by cls) as N from s),
p as (select cls, 0.0::double as fpr, 0.0::double as tpr from c where P > 0 and N > 0 group by cls
      union all select cls, fp / N, tp / P from c where P > 0 and N > 0),
v as (select cls, fpr, min(tpr) as lo, max(tpr) as hi from p group by all),
n as (select *, lead(fpr) over w as nx, lead(lo) over w as nlo from v window w as (partition by cls order by fpr)),
q as (select x, cls from (select distinct fpr as x from p), (select distinct cls from p)),
i as (select q.x, case when n.nx is null or q.x = n.fpr then n.hi else n.hi + (q.x - n.fpr) / (n.nx - n.fpr) * (n.nlo - n.hi) end as f
  from q asof join n on q.cls = n.cls and q.x >= n.fpr),
m as (select x as fpr, avg(f) as tpr from i group by x)"""


@query("met10_macro_curve", with_roles(_MACRO + f" select {sql_r6('fpr')} as fpr, {sql_r6('tpr', 5)} as tpr from m"))
def met10_macro_curve(spark, sf):
    m = M.macro_roc(_vec_classes(spark, sf), "y", "p")
    return m.select(r6("fpr").alias("fpr"), r6("tpr", 5).alias("tpr"))


@query("met10_macro_auc", with_roles(_MACRO + f""" select {sql_r6('sum((fpr - px) * (tpr + py) / 2)')} as auc from (
  select *, lag(fpr) over (order by fpr) as px, lag(tpr) over (order by fpr) as py from m)"""))
def met10_macro_auc(spark, sf):
    return M.curve_area(M.macro_roc(_vec_classes(spark, sf), "y", "p")).select(r6("auc").alias("auc"))


def _vec_classes(spark, sf):
    return R.vectors(spark, sf).select((F.col("label") % 64).alias("y"), F.array(*[f"f{i}" for i in range(64)]).alias("p"))


@query("met6_micro", with_roles(f"""
with c as (select {_CLS.format(c='y')} as y, {_CLS.format(c='y_pred')} as pred from r_reg),
t as (select count(*) filter (y = pred) as tp, count(*) as n from c)
select {sql_r6('tp / n')} as precision, {sql_r6('tp / n')} as recall, {sql_r6('tp / n')} as f1 from t"""))
def met6_micro(spark, sf):
    m = M.micro_average(_classes(spark, sf))
    return m.select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("met12_line", with_roles(f"""
select station, {sql_r6('regr_slope(y, y_pred)')} as slope, {sql_r6('regr_intercept(y, y_pred)')} as intercept
from r_reg group by station"""))
def met12_line(spark, sf):
    g = M.regression_line(R.regression_eval(spark, sf), groups=["station"])
    return g.select("station", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("met17_reconstruction", with_roles(f"""
select vec_id, {sql_r6('(' + ' + '.join(f'pow(f{i} - f{i + 32}, 2)' for i in range(32)) + ') / 32')} as err from r_vec"""))
def met17_reconstruction(spark, sf):
    v = R.vectors(spark, sf)
    x = F.array(*[f"f{i}" for i in range(32)])
    xh = F.array(*[f"f{i}" for i in range(32, 64)])
    return v.select("vec_id", r6(M.reconstruction_error(x, xh)).alias("err"))


_P3H = """sum(flag) over (partition by station order by time, train_type rows unbounded preceding)"""
_FLAG = """case when date_diff('second', lag(time) over (partition by station order by time, train_type), time) > 10800
  then 1 else 0 end"""


@query("eval1_sets", with_roles(f"""
select coalesce(station, 'all') as station, cast(coalesce(period, -1) as bigint) as period, {_REG_SQL}, {_SKILL_SQL}
from (select *, {_P3H} as period from (select *, {_FLAG} as flag from r_reg))
group by grouping sets ((station, period), (station), (period), ())"""))
def eval1_sets(spark, sf):
    e = EV.station_evaluation(R.regression_eval(spark, sf), gap_seconds=10800, climatology=6.0112,
                              tiebreak=["train_type"])
    return e.select("station", "period", "n", *[r6(c).alias(c) for c in _REG_COLS + ["skill"]])


@query("eval2_periods", _bin_sql("period").replace("select period, n,", "select period, n,") + "")
def eval2_periods(spark, sf):
    e = EV.classification_evaluation(R.binary_eval(spark, sf))
    return e.where(F.col("period") != -1).select("period", "n", "tp", "fp", "fn", *[r6(c).alias(c) for c in _BIN_COLS])


@query("eval2_overall", _bin_sql(""))
def eval2_overall(spark, sf):
    e = EV.classification_evaluation(R.binary_eval(spark, sf))
    return e.where(F.col("period") == -1).select("n", "tp", "fp", "fn", *[r6(c).alias(c) for c in _BIN_COLS])


@query("frac1_station_errors", with_roles(f"""
with b as (select *, cast(case when lat > 63.41 then 3 when lat > 61.55 then 2 when lat > 59 then 1 else 0 end as integer) as band from r_reg),
q as (select time, band, quantile_cont(y_pred, 0.1) as q_low, quantile_cont(y_pred, 0.9) as q_high from b group by all),
j as (select b.*, q.q_low, q.q_high from b join q using (time, band))
select coalesce(station, 'all') as station, count(*) as n,
  {sql_r6('sqrt(avg(pow(y_pred - y, 2)))')} as rmse_pred, {sql_r6('quantile_cont(abs(y_pred - y), 0.5)')} as median_ae_pred,
  {sql_r6('sqrt(avg(pow(q_low - y, 2)))')} as rmse_q_low, {sql_r6('quantile_cont(abs(q_low - y), 0.5)')} as median_ae_q_low,
  {sql_r6('sqrt(avg(pow(q_high - y, 2)))')} as rmse_q_high, {sql_r6('quantile_cont(abs(q_high - y), 0.5)')} as median_ae_q_high,
  {sql_r6('1 - case when var_pop(y) > 0 then sum(pow(y_pred - y, 2)) / (count(y) * var_pop(y)) end')} as r2
from j group by grouping sets ((station), ())"""))
def frac1_station_errors(spark, sf):
    e = EV.band_evaluation(R.regression_eval(spark, sf))
    cols = [c for c in e.columns if c not in ("station", "n")]
    return e.select("station", "n", *[r6(c).alias(c) for c in cols])


_SPLIT = "case when ('0x' || substr(md5(concat_ws('|', '42', station, cast(time as varchar), train_type)), 1, 8))::bigint % 100 < 30 then 'test' else 'train' end"


@query("agg25_metrics_by_name", with_roles(f"""
select name, {_REG_SQL} from (select *, {_SPLIT} as name from r_reg) group by name"""))
def agg25_metrics_by_name(spark, sf):
    r = holdout(R.regression_eval(spark, sf), ["station", "time", "train_type"], 30).withColumnRenamed("split", "name")
    g = EV.metrics_by_name(r)
    return g.select("name", "n", *[r6(c).alias(c) for c in _REG_COLS])


@query("win13_chunk_metrics", with_roles(f"""
select cast(time as date)::varchar as chunk, {_REG_SQL} from r_reg group by 1"""))
def win13_chunk_metrics(spark, sf):
    r = R.regression_eval(spark, sf).withColumn("chunk", F.to_date("time").cast("string"))
    return _reg(r, ["chunk"], skill=False)
