"""Learning queries over the stand-in views; small grids, whole tables as pools."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from touchline.operators import models as ML
from touchline.operators import sampling as O
from touchline.operators import trajectory as T
from touchline.operators.features import mean_pool
from touchline.plans import experiments as G
from touchline.plans import views as V
from touchline.plans.registry import query
from touchline.plans.standin import Tables
from touchline.session import materialise

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
SMALL_FOREST = {"numTrees": 10, "maxDepth": 5}


def _rows(t: Tables) -> DataFrame:
    return t.sql(
        "drift_v", "select d.*, case when l_quantity > 25 then 'large' else 'small' end as size_class from drift_v d"
    )


def _task(t: Tables, **extra) -> G.Task:
    settings = {"label": "size_class", "features": FEATURES[1:], "params": SMALL_FOREST, **extra}
    return G.Task(df=_rows(t), key=KEY, sources=("F", "O"), **settings)


@query("domain_clf")
def domain_clf(t: Tables) -> DataFrame:
    scores, _ = ML.domain_classifier(_rows(t), FEATURES)
    return scores


@query("domain_importances")
def domain_importances(t: Tables) -> DataFrame:
    _, importances = ML.domain_classifier(_rows(t), FEATURES)
    return importances


@query("shift_report")
def shift_report(t: Tables) -> DataFrame:
    rows = _rows(t).drop("size_class")
    # Two views of the same rows.
    described = {
        "player_tracking": V.View((), None, KEY, FEATURES),
        "player_tracking_core": V.View((), None, KEY, tuple(c for c in FEATURES if c != "l_tax")),
    }
    sections = G.shift_report(
        {name: rows for name in described}, described=described, sources=("F", "O"), permutations=20
    )
    return sections["summary"]


@query("rf_fit")
def rf_fit(t: Tables) -> DataFrame:
    task = _task(t)
    train = O.reservoir_sample(task.df, 2000, KEY)
    return task.fit(train, "rf", 42).predict(task.df).select(*KEY, "size_class", "y_pred")


@query("gbt_fit")
def gbt_fit(t: Tables) -> DataFrame:
    task = _task(t, params={"maxIter": 5, "maxDepth": 3})
    train = O.reservoir_sample(task.df, 2000, KEY)
    return task.fit(train, "gbt", 42).predict(task.df).select(*KEY, "size_class", "y_pred")


@query("mlp_warm")
def mlp_warm(t: Tables) -> DataFrame:
    rows = _rows(t)
    first = O.reservoir_sample(rows.filter("source = 'O'"), 500, KEY)
    tune = O.reservoir_sample(rows.filter("source = 'F'"), 200, KEY)
    fitted = ML.pretrain_finetune(first, tune, FEATURES[1:], "size_class", hidden=(8,), max_iter=20)
    return fitted.predict(rows).select(*KEY, "size_class", "y_pred")


@query("density_weights")
def density_weights(t: Tables) -> DataFrame:
    rows = _rows(t).withColumn("in_target", F.col("source") == "F")
    out = ML.density_weights(rows, FEATURES, "in_target", max_iter=20)
    return out.select(*KEY, "source", "density_weight")


@query("learning_curve")
def learning_curve(t: Tables) -> DataFrame:
    return G.learning_curve(_task(t), (500,), seeds=(42,))


@query("transfer")
def transfer(t: Tables) -> DataFrame:
    return G.transfer(_task(t), seeds=(42,), max_budget=2000)


_DESIGN_SQL = """
with seeds as (select unnest([42, 7]) as seed),
groups as (select source, match_id, count(*) as n_rows from drift_v group by source, match_id),
sides as (
  select seed, source, match_id, n_rows,
         row_number() over (partition by seed, source order by md5(concat(seed, ':', match_id)), match_id)
           <= ceil(count(*) over (partition by seed, source) * 0.3) as is_test
  from groups, seeds),
pools as (
  select seed, source as target_source, 'target' as role, source, match_id, n_rows, seed as draw_seed from sides where not is_test
  union all
  select s.seed, t.target_source, 'other', g.source, g.match_id, g.n_rows, s.seed + 100
  from groups g, seeds s, (select unnest(['F', 'O']) as target_source) t where g.source <> t.target_source),
sizes as (select seed, target_source, role, sum(n_rows) as found from pools group by all),
ranked as (
  select p.seed, p.target_source, p.role, d.l_orderkey, d.l_linenumber, d.l_partkey, d.l_suppkey,
         row_number() over (partition by p.seed, p.target_source, p.role order by
           md5(concat_ws(':', p.draw_seed, d.l_orderkey, d.l_linenumber, d.l_partkey, d.l_suppkey))) as place
  from drift_v d join pools p on p.source = d.source and p.match_id = d.match_id),
cells as (
  select seed, target_source, regime, train_size,
         case regime when 'other_only' then 0 when 'merged_same_n' then train_size // 2 else train_size end as of_target,
         case regime when 'target_only' then 0 when 'merged_same_n' then train_size - train_size // 2 else train_size end as of_other
  from seeds, (select unnest(['F', 'O']) as target_source), (select unnest([100, 751, 100000000]) as train_size),
       (select unnest(['target_only', 'other_only', 'merged_same_n', 'target_plus_other_2n']) as regime)),
judged as (
  select c.*, case when a.found >= of_target and b.found >= of_other then 'ok' else 'skipped' end as status
  from cells c join sizes a on a.seed = c.seed and a.target_source = c.target_source and a.role = 'target'
  join sizes b on b.seed = c.seed and b.target_source = c.target_source and b.role = 'other'),
taken as (
  select j.seed, j.target_source, j.regime, j.train_size,
         md5(string_agg(k, ',' order by k)) as rows_md5
  from judged j join (
    select *, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) as k from ranked) r
  on r.seed = j.seed and r.target_source = j.target_source
     and r.place <= case r.role when 'target' then of_target else of_other end
  where j.status = 'ok' group by all)
select j.seed, concat('shuffle:', j.seed) as fold_id, j.target_source, j.regime, j.train_size, j.status,
       cast(of_target + of_other as int) as n_train, coalesce(rows_md5, '') as rows_md5
from judged j left join taken t on t.seed = j.seed and t.target_source = j.target_source and t.regime = j.regime
     and t.train_size = j.train_size
"""


def _digests(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """md5 of each group's ``k``, sorted and joined by commas: a task reads them in order and holds a batch of them."""
    names = list(groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, digest = None, hashlib.md5()
        for pdf in batches:
            for found, part in pdf.groupby(names, sort=False):
                text = ",".join(part["k"]).encode()
                if found == group:
                    digest.update(b"," + text)
                    continue
                if group is not None:
                    yield pd.DataFrame([(*group, digest.hexdigest())], columns=[*names, "rows_md5"])
                group, digest = found, hashlib.md5(text)
        if group is not None:
            yield pd.DataFrame([(*group, digest.hexdigest())], columns=[*names, "rows_md5"])

    ordered = rows.repartition(*names).sortWithinPartitions(*names, "k")
    return ordered.mapInPandas(run, T_.StructType([*(rows.schema[name] for name in names), T_.StructField("rows_md5", T_.StringType())]))


@query("grid_design", "drift_v", _DESIGN_SQL)
def grid_design(t: Tables) -> DataFrame:
    """Cells of an augmentation grid: status, rows, and a digest of the training rows' keys."""
    task = _task(t)
    spark = task.df.sparkSession
    design = G.augmentation_design(task, (100, 751, 100_000_000), seeds=(42, 7))
    taken = _digests(design.memberships(spark, KEY).select(*G.D.CELL, F.concat_ws(":", *KEY).alias("k")), G.D.CELL)
    return design.table(spark).join(taken, G.D.CELL, "left").select(
        "seed", "fold_id", "target_source", "regime", "train_size", "status", "n_train", F.coalesce("rows_md5", F.lit("")).alias("rows_md5")
    )


@query("augmentation")
def augmentation(t: Tables) -> DataFrame:
    return G.augmentation(_task(t), (200,), seeds=(42,), correction="ls")


@query("augmentation_regression")
def augmentation_regression(t: Tables) -> DataFrame:
    task = _task(t, label="l_quantity", kind="regression", features=("l_discount", "l_tax"), more_labels=("l_extendedprice",))
    return G.augmentation(task, (200,), seeds=(42,), regimes=("target_only", "merged_same_n"))


@query("acquisition")
def acquisition(t: Tables) -> DataFrame:
    return G.acquisition(_task(t), (100, 200), (0, 100), seeds=(42,))


@query("importance_weighted")
def importance_weighted(t: Tables) -> DataFrame:
    return G.importance_weighted(_task(t), (200,), seeds=(42,))


@query("pretrain_finetune")
def pretrain_finetune(t: Tables) -> DataFrame:
    return G.pretrain(_task(t), (100,), seeds=(42,), max_iter=10)


def _snippets(t: Tables) -> DataFrame:
    out = T.snippets(
        t.tracking(), ["match_id", "player_id", "period"], "fi", ["x", "y", "speed_kmh"],
        length=10, min_segment=10, stride=5, carry=["source"],
    )
    return ML.flatten_snippets(out, ["x", "y", "speed_kmh"], 10)


def embeddings(t: Tables) -> DataFrame:
    encoded = ML.encode_pca(materialise(_snippets(t)), "values", 30, components=8)
    return mean_pool(encoded, ["source", "match_id", "player_id"], "embedding", 8)


@query("snippet_pca")
def snippet_pca(t: Tables) -> DataFrame:
    return embeddings(t)


@query("linear_probe")
def linear_probe(t: Tables) -> DataFrame:
    rows = embeddings(t).withColumn(
        "side", F.when(F.substring("player_id", 2, 2).cast("int") < 11, "home").otherwise("away")
    )
    names = tuple(c for c in rows.columns if c.startswith("emb_"))

    def task(params: dict) -> G.Task:
        return G.Task(
            rows, names, "side", ("match_id", "player_id"), sources=("A", "B"), params=params
        ).prepared()

    regimes = ("target_only", "merged_same_n")
    linear = G.augmentation(task({"maxIter": 50}), (16,), seeds=(42,), model="logistic", regimes=regimes)
    forest = G.augmentation(task(SMALL_FOREST), (16,), seeds=(42,), regimes=regimes)
    return G.headline(linear, forest)
