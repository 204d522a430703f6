"""Source shift, correction, metrics and statistics over the stand-in views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import correction as C
from touchline.operators import metrics as M
from touchline.operators import shift as X
from touchline.plans.registry import query, rounded
from touchline.plans.standin import Tables

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _floats(df: DataFrame) -> DataFrame:
    return rounded(df, [c for c, kind in df.dtypes if kind == "double"])


def _r(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-9, 6) as {n}" for n in names)


_LONG = "long as (select source, feature, value from (select source, l_quantity, l_extendedprice, l_discount, l_tax from drift_v) q unpivot (value for feature in (l_quantity, l_extendedprice, l_discount, l_tax)))"


@query(
    "ks",
    "drift_v",
    f"""
with {_LONG},
c as (select feature, value, count(*) filter (source = 'F') as a, count(*) filter (source = 'O') as b from long group by 1, 2),
r as (select feature, sum(a) over (partition by feature order by value) as ca, sum(b) over (partition by feature order by value) as cb,
  sum(a) over (partition by feature) as na, sum(b) over (partition by feature) as nb from c),
k as (select feature, max(abs(ca / na - cb / nb)) as ks_stat, cast(max(na) as bigint) as n_a, cast(max(nb) as bigint) as n_b from r group by 1),
p as (select *, n_a::double * n_b / (n_a + n_b) * ks_stat * ks_stat as l2 from k),
q as (select *, case when l2 < 0.04 then 1.0 else least(greatest(list_sum(list_transform(range(1, 101),
  lambda j: case when j % 2 = 1 then 2.0 else -2.0 end * exp(-2.0 * j * j * l2))), 0.0), 1.0) end as p_value from p)
select feature, n_a, n_b, {_r("ks_stat", "p_value")}, round(least(p_value * 4, 1.0) + 1e-9, 6) as p_value_bonferroni from q
""",
)
def ks(t: Tables) -> DataFrame:
    return _floats(X.ks_per_feature(t.view("drift_v"), FEATURES, "F", "O"))


@query(
    "location_scale",
    "drift_v",
    f"""
with {_LONG},
s as (select feature, count(*) filter (source = 'F') as n_a, count(*) filter (source = 'O') as n_b, avg(value) filter (source = 'F') as mean_a,
  avg(value) filter (source = 'O') as mean_b, stddev_samp(value) as pooled_std, var_samp(value) filter (source = 'F') as variance_a,
  var_samp(value) filter (source = 'O') as variance_b, var_samp(value) as pooled_variance from long group by 1)
select feature, n_a, n_b, round(mean_a, 4) as mean_a, round(mean_b, 4) as mean_b, round(pooled_std, 4) as pooled_std, round(mean_b - mean_a, 4) as gamma,
  round((mean_b - mean_a) / pooled_std + 1e-9, 6) as gamma_pooled_sd, round(variance_a / pooled_variance + 1e-9, 6) as delta2_a,
  round(variance_b / pooled_variance + 1e-9, 6) as delta2_b, round(variance_b / variance_a + 1e-9, 6) as variance_ratio from s
""",
)
def location_scale(t: Tables) -> DataFrame:
    out = X.location_scale(t.view("drift_v"), FEATURES, "F", "O")
    out = out.drop("variance_a", "variance_b", "pooled_variance")
    out = out.withColumns({c: F.round(c, 4) for c in ("mean_a", "mean_b", "pooled_std", "gamma")})
    return rounded(out, ["gamma_pooled_sd", "delta2_a", "delta2_b", "variance_ratio"])


_UNIFORM = "(cast(concat('0x', substr(md5(concat('42:', cast(k as varchar), ':{i}:{part}')), 1, 8)) as bigint) + 0.5) / 4294967296.0"
_WAVE = ", ".join(
    f"sqrt(-2 * ln({_UNIFORM.format(i=i, part='r')})) * cos(2 * pi() * {_UNIFORM.format(i=i, part='a')}) / w as f{i}"
    for i in range(len(FEATURES))
)
_Z = ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () as z{i}" for i, c in enumerate(FEATURES))
_PHASE = " + ".join(f"z{i} * f{i}" for i in range(len(FEATURES)))
_MMD_COMPONENTS = 32


@query(
    "mmd",
    "drift_v",
    f"""
with z as (select source, count(*) over () as t, {_Z} from drift_v where source in ('F', 'O')),
bw as (select max(sqrt(8.0 * t / (t - 1))) as w from z),
fr as (select k, {_WAVE} from range({_MMD_COMPONENTS}) as r(k), bw),
s as (select k, sum(cos({_PHASE})) filter (source = 'F') as ca, sum(sin({_PHASE})) filter (source = 'F') as sa,
  sum(cos({_PHASE})) filter (source = 'O') as cb, sum(sin({_PHASE})) filter (source = 'O') as sb from z, fr group by 1),
n as (select count(*) filter (source = 'F') as n, count(*) filter (source = 'O') as m from z)
select round(max(w) + 1e-9, 6) as bandwidth, cast(max(n) as bigint) as n_source, cast(max(m) as bigint) as n_target,
  round(avg((ca * ca + sa * sa - n) / (n * (n - 1.0)) + (cb * cb + sb * sb - m) / (m * (m - 1.0))
  - 2 * (ca * cb + sa * sb) / (n * m::double)) + 1e-9, 6) as mmd_sq from s, bw, n
""",
)
def mmd(t: Tables) -> DataFrame:
    out = X.mmd(t.view("drift_v"), FEATURES, "F", "O", key=ROW_KEY, components=_MMD_COMPONENTS, permutations=0)
    return _floats(out.select("bandwidth", "n_source", "n_target", "mmd_sq"))


_MIX = "(xor({x}, {x} >> {bits})::uhugeint * {factor}::uhugeint % 18446744073709551616::uhugeint)::ubigint"


@query(
    "mmd_permutation",
    "drift_v",
    f"""
with z as (select source, row_number() over () as rid, count(*) over () as t, {_Z},
    cast(concat('0x', substr(md5(concat_ws(':', '43', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15)) as ubigint) as d
  from drift_v where source in ('F', 'O')),
n as (select count(*) filter (source = 'F') as n, count(*) filter (source = 'O') as m, max(sqrt(8.0 * t / (t - 1))) as w from z),
fr as (select k, {_WAVE} from range(128) as r(k), n),
waves as materialized (select rid, k, cos({_PHASE}) as c, sin({_PHASE}) as s from z, fr),
every as (select k, sum(c) as c, sum(s) as s from waves group by 1),
salted as (select rid, perm, xor(d, ((perm + 42)::uhugeint * 11400714819323198485::uhugeint % 18446744073709551616::uhugeint)::ubigint) as x
  from z, range(1, 101) as p(perm)),
half as (select rid, perm, {_MIX.format(x="x", bits=30, factor=13787848793156543929)} as x from salted),
whole as (select rid, perm, {_MIX.format(x="x", bits=27, factor=10723151780598845931)} as x from half),
first as (select rid, perm from (select rid, perm, row_number() over (partition by perm order by x) as place from whole), n where place <= n
  union all select rid, 0 from z where source = 'F'),
mine as (select perm, k, sum(c) as ca, sum(s) as sa from first join waves using (rid) group by 1, 2),
v as (select perm, avg((ca * ca + sa * sa - n) / (n * (n - 1.0)) + ((e.c - ca) * (e.c - ca) + (e.s - sa) * (e.s - sa) - m) / (m * (m - 1.0))
  - 2 * (ca * (e.c - ca) + sa * (e.s - sa)) / (n * m::double)) as v from mine join every e using (k), n group by 1),
o as (select v as mmd_sq from v where perm = 0)
select round(max(mmd_sq) + 1e-9, 6) as mmd_sq, (count(*) filter (v >= mmd_sq) + 1) / 101.0 as p_value, round(max(w) + 1e-9, 6) as bandwidth,
  cast(max(n) as bigint) as n_source, cast(max(m) as bigint) as n_target, cast(count(*) as int) as n_permutations,
  round(avg(v) + 1e-9, 6) as permutation_mean, round(stddev_pop(v) + 1e-9, 6) as permutation_std from v, o, n where perm > 0
""",
)
def mmd_permutation(t: Tables) -> DataFrame:
    out = X.mmd(t.view("drift_v"), FEATURES, "F", "O", key=ROW_KEY, permutations=100)
    return rounded(out, ["mmd_sq", "bandwidth", "permutation_mean", "permutation_std"])


@query(
    "impute_median",
    "drift_v",
    """
with h as (select *, case when l_orderkey % 7 = 0 then null else l_quantity end as q from drift_v)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(q, (select quantile_cont(q, 0.5) from h)) as l_quantity from h
""",
)
def impute_median(t: Tables) -> DataFrame:
    holes = t.view("drift_v").withColumn(
        "l_quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity"))
    )
    return X.impute_median(holes, ["l_quantity"]).select(*ROW_KEY, "l_quantity")


_SPLIT = "l_orderkey % 3 <> 0"


@query(
    "ls_correct",
    "drift_v",
    f"""
with s as (select source, avg(l_quantity) as mq, stddev_pop(l_quantity) as sq, avg(l_tax) as mt, stddev_pop(l_tax) as st from drift_v where {_SPLIT} group by 1),
r as (select * from s where source = 'F')
select d.l_orderkey, d.l_linenumber, d.l_partkey, d.l_suppkey, round((l_quantity - s.mq) / s.sq * r.sq + r.mq + 1e-9, 6) as l_quantity,
  round((l_tax - s.mt) / s.st * r.st + r.mt + 1e-9, 6) as l_tax
from drift_v d join s on d.source = s.source, r where not ({_SPLIT})
""",
)
def ls_correct(t: Tables) -> DataFrame:
    df = t.view("drift_v")
    out = C.correct(df.filter(_SPLIT), df.filter(f"not ({_SPLIT})"), ["l_quantity", "l_tax"], method="ls", reference="F")
    return rounded(out.test.select(*ROW_KEY, "l_quantity", "l_tax"), ["l_quantity", "l_tax"])


def _random_order(seed: int) -> str:
    keys = ", ".join(f"cast({key} as varchar)" for key in ROW_KEY)
    return f"row_number() over (order by substr(md5(concat_ws(':', '{seed}', {keys})), 1, 8), {', '.join(ROW_KEY)}) as place"


_MOMENTS = ", ".join(f"avg({c}) as m{i}, stddev_pop({c}) as s{i}" for i, c in enumerate(FEATURES))
_MOVED = ", ".join(
    f"round(avg((d.{c} - s.m{i}) / s.s{i} * r.s{i} + r.m{i}) + 1e-9, 4) as {c}" for i, c in enumerate(FEATURES)
)


@query(
    "ls_correct_permuted",
    "drift_v",
    f"""
with tr as (select * from drift_v where {_SPLIT}),
ra as (select {", ".join(FEATURES)}, {_random_order(42)} from tr),
la as (select source, {_random_order(43)} from tr),
s as (select source, {_MOMENTS} from ra join la using (place) group by 1),
r as (select * from s where source = 'F')
select d.source, {_MOVED} from drift_v d join s on d.source = s.source, r where not ({_SPLIT}) group by 1
""",
)
def ls_correct_permuted(t: Tables) -> DataFrame:
    df = t.view("drift_v")
    out = C.correct(df.filter(_SPLIT), df.filter(f"not ({_SPLIT})"), FEATURES, method="ls_permuted", reference="F", key=ROW_KEY)
    return out.test.groupBy("source").agg(*[F.round(F.avg(c) + 1e-9, 4).alias(c) for c in FEATURES])


_COMBAT_DIGITS = {"l_quantity": 5, "l_extendedprice": 3, "l_discount": 6, "l_tax": 6}
_COMBAT_STEP_G = "(n * t2 * gh + a.d * gb) / (n * t2 + a.d)"
_COMBAT_OUT = ", ".join(
    f"round(({c} - max(c) filter (feature = '{c}')) / max(s) filter (feature = '{c}') + max(o) filter (feature = '{c}') + 1e-9, {digits}) as {c}"
    for c, digits in _COMBAT_DIGITS.items()
)


@query(
    "combat",
    "drift_v",
    f"""
with long as (select source, feature, value from (select source, {", ".join(FEATURES)} from drift_v where {_SPLIT}) q
  unpivot (value for feature in ({", ".join(FEATURES)}))),
mo as (select source, feature, count(*)::double as n, avg(value) as mean, var_pop(value) * count(*) as sq, var_samp(value) as v from long group by 1, 2),
co as (select feature, sum(n * mean) / sum(n) as grand, sqrt(sum(sq) / sum(n)) as pooled from mo group by 1),
sc as (select source, feature, n, grand, pooled, (mean - grand) / pooled as gh, v / (pooled * pooled) as dh, sq / (pooled * pooled) as sq from mo join co using (feature)),
pr as (select source, avg(gh) as gb, greatest(var_samp(gh), 1e-12) as t2, avg(dh) as u, greatest(var_samp(dh), 1e-12) as s2 from sc group by 1),
st as (select sc.*, gb, t2, 2 + u * u / s2 as shape, u + u * u * u / s2 as rate from sc join pr using (source)),
so as (select source, feature, grand, pooled, list_reduce(list_transform(range(101), lambda i: {{'g': gh, 'd': dh}}), lambda a, b:
    {{'g': {_COMBAT_STEP_G}, 'd': (rate + (sq + n * (gh - {_COMBAT_STEP_G}) ** 2) / 2) / (shape + n / 2 - 1)}}) as r from st),
pa as (select source, feature, grand + r.g * pooled as c, sqrt(r.d) as s, grand as o from so)
select d.source, match_id, {", ".join(ROW_KEY)}, {_COMBAT_OUT}
from drift_v d join pa on d.source = pa.source where not ({_SPLIT}) group by d.source, match_id, {", ".join(ROW_KEY)}, {", ".join(FEATURES)}
""",
)
def combat(t: Tables) -> DataFrame:
    df = t.view("drift_v")
    out = C.correct(df.filter(_SPLIT), df.filter(f"not ({_SPLIT})"), FEATURES, method="combat_p")
    rows = out.test.select("source", "match_id", *ROW_KEY, *FEATURES)
    return rows.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c, digits in _COMBAT_DIGITS.items()})


@query(
    "metrics_clf",
    "preds_v",
    f"""
with c as (select cell_id, y_true, y_pred, count(*) as n from preds_v group by 1, 2, 3),
k as (select cell_id, y_true as l, sum(n) as sup, 0 as g, sum(case when y_true = y_pred then n else 0 end) as h from c group by 1, 2
  union all select cell_id, y_pred, 0, sum(n), 0 from c group by 1, 2),
p as (select cell_id, l, sum(sup) as sup, sum(g) as g, sum(h) as h from k group by 1, 2),
m as (select cell_id, sum(h) / sum(sup) as accuracy, avg(case when sup > 0 then h / sup end) as balanced_accuracy, avg(2 * h / (sup + g)) as macro_f1,
  cast(sum(sup) as bigint) as n_test from p group by 1)
select cell_id, n_test, {_r("accuracy", "balanced_accuracy", "macro_f1")} from m
""",
)
def metrics_clf(t: Tables) -> DataFrame:
    return _floats(M.classification_metrics(t.view("preds_v"), ["cell_id"]))


@query(
    "positive_rates",
    "preds_v",
    f"""
with b as (select cell_id, cast(y_true = 'R' as int) as t, cast(y_pred = 'R' as int) as g from preds_v)
select cell_id, round(case when count(distinct t) = 2 then avg(t) end + 1e-9, 6) as positive_rate_true,
  round(case when count(distinct t) = 2 then avg(g) end + 1e-9, 6) as positive_rate_pred from b group by 1
""",
)
def positive_rates(t: Tables) -> DataFrame:
    binary = t.view("preds_v").select(
        "cell_id", (F.col("y_true") == "R").cast("int").alias("y_true"), (F.col("y_pred") == "R").cast("int").alias("y_pred")
    )
    return _floats(M.positive_rates(binary, ["cell_id"]))


@query(
    "metrics_reg",
    "preds_v",
    """
select cell_id, count(*) as n_test, round(avg(abs(y - yhat)), 3) as mae, round(sqrt(avg((y - yhat) * (y - yhat))), 3) as rmse,
  round(1 - avg((y - yhat) * (y - yhat)) / var_pop(y) + 1e-9, 6) as r2, round(avg(y), 3) as target_mean, round(stddev_pop(y), 3) as target_std
from preds_v group by 1
""",
)
def metrics_reg(t: Tables) -> DataFrame:
    out = M.regression_metrics(t.view("preds_v"), ["cell_id"])
    out = out.withColumns({c: F.round(c, 3) for c in ("mae", "rmse", "target_mean", "target_std")})
    return rounded(out, ["r2"])


@query(
    "ci_summary",
    "measurements_v",
    """
select target_source, regime, train_size, round(avg(macro_f1) + 1e-9, 5) as macro_f1_mean, round(stddev_samp(macro_f1) + 1e-9, 5) as macro_f1_std,
  round(case when count(macro_f1) > 1 then 1.96 * stddev_samp(macro_f1) / sqrt(count(macro_f1)) else 0 end + 1e-9, 5) as macro_f1_ci95, count(macro_f1) as n_runs
from measurements_v group by 1, 2, 3
""",
)
def ci_summary(t: Tables) -> DataFrame:
    out = M.summarise(t.view("measurements_v"), ["target_source", "regime", "train_size"], ["macro_f1"])
    names = ("macro_f1_mean", "macro_f1_std", "macro_f1_ci95")
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in names})


_PAIRS = """
deltas as (select c.fold_id, c.target_source, c.train_size, c.regime as compare_regime, c.macro_f1 - b.macro_f1 as delta_macro_f1
  from measurements_v c join measurements_v b on c.fold_id = b.fold_id and c.target_source = b.target_source and c.train_size = b.train_size
  where b.regime = 'target_only' and c.regime in ('merged_same_n', 'target_plus_other_2n', 'other_only'))
"""
_PAIR_KEYS = ["fold_id", "target_source", "train_size"]
_GROUPS = ["target_source", "train_size", "compare_regime"]


def deltas(t: Tables) -> DataFrame:
    return M.paired_deltas(t.view("measurements_v"), _PAIR_KEYS, ["macro_f1"])


@query(
    "paired_join",
    "measurements_v",
    f"with {_PAIRS.strip()} select fold_id, target_source, train_size, compare_regime, round(delta_macro_f1, 4) as delta_macro_f1 from deltas",
)
def paired_join(t: Tables) -> DataFrame:
    return deltas(t).withColumn("delta_macro_f1", F.round("delta_macro_f1", 4))


@query(
    "paired_merged",
    "measurements_v",
    """
select s.train_size, s.target_source, s.regime as source_regime,
  round(avg(m.macro_f1 - s.macro_f1) + 1e-9, 4) as delta_macro_f1_mean,
  round(stddev_samp(m.macro_f1 - s.macro_f1) + 1e-9, 4) as delta_macro_f1_std,
  round(case when count(*) > 1 then 1.96 * stddev_samp(m.macro_f1 - s.macro_f1) / sqrt(count(*)) else 0 end + 1e-9, 4) as delta_macro_f1_ci95,
  count(*) as n_pairs
from measurements_v s join measurements_v m
  on m.fold_id = s.fold_id and m.target_source = s.target_source and m.train_size = s.train_size
where m.regime = 'merged_same_n' and s.regime in ('target_only', 'other_only')
group by 1, 2, 3
""",
)
def paired_merged(t: Tables) -> DataFrame:
    out = M.merged_summary(
        t.view("measurements_v"), _PAIR_KEYS, ["train_size", "target_source"], ["macro_f1"],
        ("target_only", "other_only"), merged="merged_same_n",
    )
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in out.columns if c.startswith("delta_")})


_BOOT = """
pl as (select target_source, train_size, compare_regime, delta_macro_f1 as v,
  row_number() over (partition by target_source, train_size, compare_regime order by delta_macro_f1) - 1 as j,
  count(*) over (partition by target_source, train_size, compare_regime) as n from deltas),
dr as (select target_source, train_size, compare_regime, b, cast(concat('0x', substr(md5(concat_ws(':', '0', cast(b as varchar), cast(j as varchar))), 1, 8)) as bigint) % n as jj
  from pl, range(0, 500) as r(b) where n > 1),
me as (select d.target_source, d.train_size, d.compare_regime, b, avg(v) as mean from dr d join pl p on d.target_source = p.target_source
  and d.train_size = p.train_size and d.compare_regime = p.compare_regime and d.jj = p.j group by 1, 2, 3, 4),
bo as (select target_source, train_size, compare_regime, quantile_cont(mean, 0.025) as ci_low, quantile_cont(mean, 0.975) as ci_high from me group by 1, 2, 3)
"""


@query(
    "bootstrap_ci",
    "measurements_v",
    f"with {_PAIRS.strip()}, {_BOOT.strip()} select target_source, train_size, compare_regime, round(ci_low + 1e-9, 4) as ci_low, round(ci_high + 1e-9, 4) as ci_high from bo",
)
def bootstrap_ci(t: Tables) -> DataFrame:
    out = M.bootstrap_ci(deltas(t), _GROUPS, "delta_macro_f1", resamples=500)
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("ci_low", "ci_high")})


_ERFC = ""
for _coefficient in M.ERFC_FIT:
    _ERFC = f"({_ERFC} * t + {_coefficient})" if _ERFC else str(_coefficient)
_WILCOXON = f"""
ab as (select target_source, train_size, compare_regime, abs(delta_macro_f1) as a, count(*) as t, count(*) filter (delta_macro_f1 > 0) as pos
  from deltas where delta_macro_f1 <> 0 group by 1, 2, 3, 4),
ra as (select *, coalesce(sum(t) over (partition by target_source, train_size, compare_regime order by a rows between unbounded preceding and 1 preceding), 0)
  + (t + 1) / 2.0 as rk from ab),
wx as (select target_source, train_size, compare_regime, sum(rk * pos) as w_plus, sum(t) as n, sum(t * t * t - t) as ties from ra group by 1, 2, 3),
zs as (select *, (w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) as z from wx),
xs as (select *, abs(z) / sqrt(2.0) as x, 1 / (1 + abs(z) / sqrt(2.0) / 2) as t from zs),
pv as (select target_source, train_size, compare_regime, w_plus, n, z, case when n >= 2 then t * exp({_ERFC} - x * x) end as p_value from xs)
"""


@query(
    "wilcoxon",
    "measurements_v",
    f"""
with {_PAIRS.strip()}, {_WILCOXON.strip()}
select target_source, train_size, compare_regime, w_plus, cast(n as bigint) as n,
  round(z + 1e-9, 6) as z, round(p_value + 1e-9, 6) as p_value from pv
""",
)
def wilcoxon(t: Tables) -> DataFrame:
    return rounded(M.wilcoxon(deltas(t), _GROUPS, "delta_macro_f1", method="normal"), ["z", "p_value"])


@query(
    "paired_summary",
    "measurements_v",
    f"""
with {_PAIRS.strip()}, {_BOOT.strip()}, {_WILCOXON.strip()},
s as (select target_source, train_size, compare_regime, avg(delta_macro_f1) as mean, coalesce(stddev_samp(delta_macro_f1), 0) as sd, count(*) as n_pairs from deltas group by 1, 2, 3)
select s.target_source, s.train_size, s.compare_regime, round(mean + 1e-9, 4) as mean, round(sd + 1e-9, 4) as std,
  round(case when n_pairs > 1 then 1.96 * sd / sqrt(n_pairs) else 0 end + 1e-9, 4) as ci95, n_pairs,
  round(ci_low + 1e-9, 4) as ci_low, round(ci_high + 1e-9, 4) as ci_high, round(p_value + 1e-9, 4) as p_value
from s left join bo on s.target_source = bo.target_source and s.train_size = bo.train_size and s.compare_regime = bo.compare_regime
left join pv on s.target_source = pv.target_source and s.train_size = pv.train_size and s.compare_regime = pv.compare_regime
""",
)
def paired_summary(t: Tables) -> DataFrame:
    out = M.paired_summary(deltas(t), _GROUPS, "delta_macro_f1", resamples=500, method="normal")
    names = ("mean", "std", "ci95", "ci_low", "ci_high", "p_value")
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in names})


@query(
    "forest_table",
    "measurements_v",
    f"""
with {_PAIRS.strip()}, {_BOOT.strip()}, {_WILCOXON.strip()},
s as (select target_source, train_size, compare_regime, avg(delta_macro_f1) as mean from deltas where compare_regime = 'merged_same_n' group by 1, 2, 3)
select 'stand_in' as task, s.target_source, s.train_size, s.compare_regime, round(mean + 1e-9, 4) as mean, round(coalesce(ci_low, mean) + 1e-9, 4) as lo,
  round(coalesce(ci_high, mean) + 1e-9, 4) as hi, coalesce(p_value < 0.05, false) as significant
from s left join bo on s.target_source = bo.target_source and s.train_size = bo.train_size and s.compare_regime = bo.compare_regime
left join pv on s.target_source = pv.target_source and s.train_size = pv.train_size and s.compare_regime = pv.compare_regime
""",
)
def forest_table(t: Tables) -> DataFrame:
    summary = M.paired_summary(deltas(t), _GROUPS, "delta_macro_f1", resamples=500, method="normal")
    out = M.forest_table(summary.withColumn("task", F.lit("stand_in")))
    out = out.select("task", "target_source", "train_size", "compare_regime", "mean", "lo", "hi", "significant")
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("mean", "lo", "hi")})
