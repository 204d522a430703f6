"""Estimators of the source and downstream tasks, on Spark ML."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import constants as K
from touchline.operators.forest import Cells, bin_borders, confusion, count_cells, grow
from touchline.operators.metrics import classification_metrics
from touchline.operators.quantiles import exact_quantiles
from touchline.operators.sampling import group_folds
from touchline.session import materialise


def training_medians(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact median of every feature over all training rows."""
    row = exact_quantiles(train, [], {f"m{i}": (c, 0.5) for i, c in enumerate(features)}).first()
    return {c: row[f"m{i}"] for i, c in enumerate(features) if row and row[f"m{i}"] is not None}


def balanced_weights(train: DataFrame, label: str, name: str = "_weight") -> tuple[DataFrame, tuple[str, ...]]:
    """Weight rows by n / (classes * class size); also returns the sorted class names."""
    sizes = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).collect()
    total, k = sum(r["_n"] for r in sizes), len(sizes)
    table = train.sparkSession.createDataFrame(
        [(r[label], total / (k * r["_n"])) for r in sizes], f"{label} {train.schema[label].dataType.simpleString()}, {name} double"
    )
    # A row per class, which the driver holds anyway; a shuffle would put a class into one task.
    return train.join(F.broadcast(table), label), tuple(sorted(r[label] for r in sizes))


def _classifier(kind: str, seed: int, classes: int, width: int, **params):
    common = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "_p"}
    if kind == "rf":
        settings = {"numTrees": 200, "maxDepth": 8, "minInstancesPerNode": 5, **params}
        return RandomForestClassifier(**common, seed=seed, weightCol="_weight", **settings)
    if kind == "gbt":
        settings = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.05, "minInstancesPerNode": 5, **params}
        if classes <= 2:
            return GBTClassifier(**common, seed=seed, weightCol="_weight", **settings)
        inner = GBTClassifier(featuresCol="_x", labelCol="_y", seed=seed, weightCol="_weight", **settings)
        return OneVsRest(classifier=inner, weightCol="_weight", **common)
    if kind == "logistic":
        settings = {"maxIter": 1000, "regParam": 0.0, **params}
        return LogisticRegression(**common, weightCol="_weight", **settings)
    if kind == "mlp":
        settings = {"maxIter": 400, **params}
        layers = [width, *settings.pop("hidden", (64, 32)), max(classes, 2)]
        return MultilayerPerceptronClassifier(**common, layers=layers, seed=seed, **settings)
    raise ValueError(f"unknown classifier {kind}")


def _regressor(kind: str, seed: int, label: str, **params):
    common = {"featuresCol": "_x", "labelCol": label, "predictionCol": "yhat", "seed": seed}
    if kind == "rf":
        return RandomForestRegressor(**common, **{"numTrees": 300, "maxDepth": 10, "minInstancesPerNode": 3, **params})
    if kind == "gbt":
        return GBTRegressor(**common, **{"maxIter": 100, "maxDepth": 5, "stepSize": 0.05, "minInstancesPerNode": 3, **params})
    raise ValueError(f"unknown regressor {kind}")


@dataclass(frozen=True)
class Fitted:
    """A fitted pipeline with its imputation values and label names."""

    model: PipelineModel
    medians: dict[str, float]
    labels: tuple[str, ...]

    def predict(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        out = self.model.transform(df.na.fill(self.medians) if self.medians else df)
        if self.labels:
            names = F.array(*[F.lit(v) for v in self.labels])
            out = out.withColumn(name, F.get(names, F.col("_p").cast("int")))
        hidden = [c for c in out.columns if c in ("_raw", "_x", "_p", "_y", "rawPrediction", "probability")]
        return out.drop(*hidden)

    def importances(self) -> list[float]:
        return list(self.model.stages[-1].featureImportances.toArray())


def _prepare(features: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
    ]


def fit_classifier(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    kind: str = "rf",
    seed: int = K.SEED,
    weight: str | None = None,
    **params,
) -> Fitted:
    """Median imputation, scaling and a class-balanced classifier (or given weights).

    ``kind``: rf, gbt, logistic or mlp; the perceptron has no row weights.
    """
    typed = train.withColumns({**{c: F.col(c).cast("double") for c in features}, label: F.col(label).cast("string")})
    medians = training_medians(typed, features)
    filled, labels = balanced_weights(typed.na.fill(medians), label)
    if weight:
        filled = filled.withColumn("_weight", F.col("_weight") * F.col(weight))
    index = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)) - 1
    indexed = filled.withColumn("_y", index.cast("double"))
    stages = [*_prepare(features), _classifier(kind, seed, len(labels), len(features), **params)]
    return Fitted(Pipeline(stages=stages).fit(indexed), medians, labels)


def fit_regressor(
    train: DataFrame, features: Sequence[str], label: str, *, kind: str = "rf", seed: int = K.SEED, **params
) -> Fitted:
    typed = train.withColumns({c: F.col(c).cast("double") for c in [*features, label]})
    medians = training_medians(typed, features)
    stages = [*_prepare(features), _regressor(kind, seed, label, **params)]
    return Fitted(Pipeline(stages=stages).fit(typed.na.fill(medians)), medians, ())


def pretrain_finetune(
    pretrain: DataFrame,
    finetune: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    seed: int = K.SEED,
    hidden: Sequence[int] = (64, 32),
    max_iter: int = 200,
) -> Fitted:
    """Fit a two-layer perceptron on one source, then continue on the other.

    Imputation and scaling come from the pretraining rows, the classes from both.
    """
    both = pretrain.select(F.col(label).cast("string").alias(label)).unionByName(
        finetune.select(F.col(label).cast("string").alias(label))
    )
    labels = tuple(sorted(r[0] for r in both.distinct().collect()))
    medians = training_medians(pretrain, features)
    index = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label).cast("string")) - 1

    def ready(df: DataFrame) -> DataFrame:
        typed = df.withColumns({c: F.col(c).cast("double") for c in features})
        return typed.na.fill(medians).withColumn("_y", index.cast("double"))

    scale = Pipeline(stages=_prepare(features)).fit(ready(pretrain))

    def perceptron(**extra):
        return MultilayerPerceptronClassifier(
            layers=[len(features), *hidden, max(len(labels), 2)], featuresCol="_x", labelCol="_y", predictionCol="_p",
            seed=seed, maxIter=max_iter, **extra,
        )

    first = perceptron().fit(scale.transform(ready(pretrain)))
    second = perceptron(initialWeights=first.weights).fit(scale.transform(ready(finetune)))
    return Fitted(PipelineModel(stages=[*scale.stages, second]), medians, labels)


def density_weights(
    rows: DataFrame,
    features: Sequence[str],
    is_target: str,
    *,
    clip: tuple[float, float] = (0.05, 20.0),
    max_iter: int = 500,
    name: str = "density_weight",
) -> DataFrame:
    """Weight rows outside the target by p(target | x) / p(other | x), clipped; target rows get 1.

    The probability comes from a logistic regression on scaled features.
    """
    typed = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    flagged = typed.withColumn("_y", F.col(is_target).cast("double"))
    n = flagged.count()
    # Penalty of sklearn's C=1 in the objective averaged over n rows.
    model = Pipeline(
        stages=[*_prepare(features), LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=max_iter, regParam=1.0 / max(n, 1), standardization=False)]
    ).fit(flagged)
    p = F.get(vector_to_array("probability"), F.lit(1))
    ratio = p / F.greatest(1 - p, F.lit(1e-6))
    clipped = F.least(F.greatest(ratio, F.lit(clip[0])), F.lit(clip[1]))
    scored = model.transform(flagged).withColumn(name, F.when(F.col(is_target), F.lit(1.0)).otherwise(clipped))
    return scored.select(*rows.columns, name)


def domain_classifier(
    df: DataFrame,
    features: Sequence[str],
    *,
    source: str = "source",
    group: str = "match_id",
    folds: int = 5,
    seed: int = K.SEED,
    **params,
) -> tuple[DataFrame, DataFrame]:
    """Cross-validated accuracy of telling the sources apart, and mean importances.

    Whole groups stay on one side of a split, with both sources on both sides. If a source has
    a single group, rows are dealt into folds by a hash of their features instead. Returns
    one row per fold and the mean importances of all features. Forests grow on counts of rows that share
    the bins of all features (``forest.py``), or on the rows where hardly any do.
    """
    settings = {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 1, **params}
    groups = df.groupBy(source).agg(F.count_distinct(group).alias("n")).agg(F.min("n")).first()[0] or 0
    if groups >= 2:
        dealt = group_folds(df, group=group, strata=[source], folds=folds, seed=seed)
    else:
        dealt = df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *features), F.lit(folds)))
    sides = dealt.select("fold", F.col(source).cast("string")).distinct().collect()
    numbers, classes = sorted({r[0] for r in sides}), sorted({r[1] for r in sides if r[1] is not None})
    cells = _cells(dealt, features, source, numbers, classes) if _COUNTED >= set(settings) and settings["maxDepth"] <= DEEPEST else None
    if cells is not None and (cells.size <= FEW_CELLS or ROWS_PER_CELL * cells.size <= cells.totals.sum()):
        forest = grow(cells, seed=seed, **settings)
        scores, totals = classification_metrics(confusion(cells, forest), ["fold"], rows="n"), forest.importances()
    else:
        scores, totals = _by_rows(materialise(dealt), features, source, numbers, seed, settings)
    table = df.sparkSession.createDataFrame(list(zip(features, map(float, totals))), "feature string, importance double")
    return scores, table.orderBy(F.desc("importance"), "feature")


#: Settings that forests on counted cells know; their trees are arrays of 2^depth nodes.
_COUNTED = {"numTrees", "maxDepth", "minInstancesPerNode"}
DEEPEST = 12
#: Forests grow on counts where there are so few cells of equal bins, or so many rows in a cell; else they read the rows themselves.
FEW_CELLS = 500_000
ROWS_PER_CELL = 4


def _cells(dealt: DataFrame, features: Sequence[str], source: str, folds: Sequence[int], classes: Sequence[str]) -> Cells:
    """Counted cells of all folds; where values are missing they take the bin of the training rows' median."""
    borders, holes = bin_borders(dealt, features)
    missing = np.zeros((len(folds), len(features)), np.int16)
    if any(holes):
        for i, fold in enumerate(folds):
            medians = training_medians(dealt.filter(F.col("fold") != fold), features)
            missing[i] = [bisect_left(b, medians[c]) if c in medians else len(b) for c, b in zip(features, borders)]
    return count_cells(dealt, features, source, "fold", folds, classes, borders, missing)


def _by_rows(
    dealt: DataFrame, features: Sequence[str], source: str, folds: Sequence[int], seed: int, settings: dict
) -> tuple[DataFrame, list[float]]:
    parts, totals = None, [0.0] * len(features)
    for fold in folds:
        fitted = fit_classifier(dealt.filter(F.col("fold") != fold), features, source, seed=seed, **settings)
        guessed = fitted.predict(dealt.filter(F.col("fold") == fold)).select(
            "fold", F.col(source).alias("y_true"), "y_pred"
        )
        parts = guessed if parts is None else parts.unionByName(guessed)
        totals = [a + b / len(folds) for a, b in zip(totals, fitted.importances())]
    return classification_metrics(parts, ["fold"]), totals


def flatten_snippets(snippets: DataFrame, fields: Sequence[str], length: int, name: str = "values") -> DataFrame:
    """Snippet structs as one flat array, time step by time step."""
    flat = F.flatten(F.transform("snippet", lambda p: F.array(*[p[f].cast("double") for f in fields])))
    return snippets.withColumn(name, flat).filter(F.size(name) == length * len(fields))


def encode_pca(
    df: DataFrame, column: str, size: int, *, components: int = 64, name: str = "embedding"
) -> DataFrame:
    """Standardise a numeric array column and project it on its leading components."""
    ready = df.withColumn("_raw", array_to_vector(column))
    stages = [
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        PCA(k=min(components, size), inputCol="_x", outputCol="_z"),
    ]
    out = Pipeline(stages=stages).fit(ready).transform(ready)
    return out.withColumn(name, vector_to_array("_z")).drop("_raw", "_x", "_z")
