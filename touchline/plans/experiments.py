"""Cross-source learning experiments: grids of fits whose predictions are scored together.

A grid cell is one Spark ML fit per target. The design of a grid (``design.py``) decides the rows of all
cells beforehand; fits are launched from the driver, a few at a time; all predictions of a grid
end in one table, and one aggregation scores every cell and target.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import constants as K
from touchline.operators import metrics as M
from touchline.operators import models as ML
from touchline.operators import sampling as O
from touchline.operators import shift as X
from touchline.operators.correction import correct
from touchline.plans import design as D
from touchline.plans.views import View
from touchline.session import materialise

CELL = [*D.CELL, "target"]


@dataclass(frozen=True)
class Task:
    """A feature view with its label; ``key`` identifies a row.

    ``more_labels`` are further targets: every cell fits each of them on the same rows.
    """

    df: DataFrame
    features: tuple[str, ...]
    label: str
    key: tuple[str, ...]
    kind: str = "classification"
    sources: tuple[str, str] = (K.SOURCE_XML, K.SOURCE_JSON)
    params: dict = field(default_factory=dict)
    more_labels: tuple[str, ...] = ()
    written: bool = False

    def single(self) -> list[Task]:
        """One task for each target."""
        return [replace(self, label=label, more_labels=()) for label in (self.label, *self.more_labels)]

    def of(self, source: str) -> DataFrame:
        return self.df.filter(F.col("source") == source)

    def fit(self, train: DataFrame, model: str, seed: int, weight: str | None = None) -> ML.Fitted:
        if self.kind == "classification":
            return ML.fit_classifier(train, self.features, self.label, kind=model, seed=seed, weight=weight, **self.params)
        return ML.fit_regressor(train, self.features, self.label, kind=model, seed=seed, **self.params)

    def score(self, fitted: ML.Fitted, test: DataFrame, **cell) -> DataFrame:
        """Predictions of one cell, tagged with the cell's coordinates and its target."""
        typed = test.withColumns({c: F.col(c).cast("double") for c in self.features})
        if self.kind == "classification":
            out = fitted.predict(typed).select(F.col(self.label).cast("string").alias("y_true"), "y_pred")
        else:
            out = fitted.predict(typed).select(F.col(self.label).cast("double").alias("y"), "yhat")
        defaults = {"experiment": "", "fold_id": "", "target_source": "", "regime": "", "target": self.label}
        tags = {c: F.lit(cell.get(c, defaults.get(c, 0))) for c in CELL}
        return out.select(*[v.alias(c) for c, v in tags.items()], *out.columns)

    def measure(self, parts: list[DataFrame]) -> DataFrame:
        if not parts:
            raise ValueError("no cell of the grid could be run; its design names the sizes of the pools")
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        scorer = M.classification_metrics if self.kind == "classification" else M.regression_metrics
        return scorer(every, CELL)

    def prepared(self) -> Task:
        """The same task over a written copy of its view, so no fit recomputes it."""
        return self if self.written else replace(self, df=materialise(self.df), written=True)


def _run(task: Task, design: D.Design, train: Callable[[D.Cell], tuple[DataFrame, DataFrame]], fit) -> DataFrame:
    """Fit every cell that its pools can fill, several at a time, and score all predictions together."""

    def one(cell: D.Cell) -> list[DataFrame]:
        rows, test = train(cell)
        rows = materialise(rows)
        return [task.score(fit(part, rows, cell), test, **cell.tags(), target=part.label) for part in task.single()]

    ready = [cell for cell in design.cells if design.runs(cell)]
    return task.measure([part for parts in D.in_parallel(one, ready) for part in parts])


def _plain(design: D.Design):
    return lambda cell: (design.train(cell), design.test(cell))


def _model(kind: str, **settings):
    return lambda task, rows, cell: task.fit(rows, kind, cell.seed, **settings)


def curve_design(task: Task, train_sizes: Sequence[int], *, seeds: Sequence[int] = K.SEEDS, test_size: float = 0.30) -> D.Design:
    def cells(split, sizes):
        seed, fold, target = split
        for regime in (*task.sources, "merged"):
            for n in train_sizes:
                yield D.Cell(seed=seed, fold_id=fold, target_source=target, regime=regime, train_size=n, parts=((regime, n),))

    return D.lay_out(task.df, task.key, task.sources, cells, seeds=seeds, test_size=test_size, by_target=False)


def learning_curve(
    task: Task, train_sizes: Sequence[int], *, seeds: Sequence[int] = K.SEEDS, test_size: float = 0.30, model: str = "rf"
) -> DataFrame:
    """Each source alone and both merged, at growing training sizes."""
    task = task.prepared()
    design = curve_design(task, train_sizes, seeds=seeds, test_size=test_size)
    return _run(task, design, _plain(design), _model(model))


def transfer_design(
    task: Task, *, seeds: Sequence[int] = K.SEEDS, test_size: float = 0.35, max_budget: int = 32_000, min_budget: int = 50
) -> D.Design:
    """Budgets are equal: as many rows as the smaller pool has; below ``min_budget`` cells are skipped."""

    def cells(split, sizes):
        seed, fold, target = split
        other = task.sources[1 - task.sources.index(target)]
        budget = min(sizes.get("other", 0), sizes.get("target", 0), max_budget)
        wanted = max(budget, min_budget)
        half = wanted // 2
        for name, parts in (
            (f"{other}_to_{target}", (("other", wanted),)),
            (f"{target}_only_to_{target}", (("target", wanted),)),
            (f"merged_to_{target}", (("other", half), ("target", wanted - half))),
        ):
            # A budget below the least is wanted of both pools, so that no cell of it runs.
            need = parts if budget >= min_budget else (("target", min_budget), ("other", min_budget))
            yield D.Cell(name.lower(), seed, fold, target, train_size=wanted, parts=need)

    return D.lay_out(task.df, task.key, task.sources, cells, seeds=seeds, test_size=test_size)


def transfer(
    task: Task, *, seeds: Sequence[int] = K.SEEDS, test_size: float = 0.35, max_budget: int = 32_000, min_budget: int = 50, model: str = "rf"
) -> DataFrame:
    """Train on the other source, on the target, or half and half; test on the target."""
    task = task.prepared()
    design = transfer_design(task, seeds=seeds, test_size=test_size, max_budget=max_budget, min_budget=min_budget)
    return _run(task, design, _plain(design), _model(model))


def augmentation_design(
    task: Task, train_sizes: Sequence[int], *, seeds: Sequence[int] = K.SEEDS, test_size: float = 0.30, scheme: str = "shuffle",
    regimes: Sequence[str] = K.TARGET_REGIMES,
) -> D.Design:
    def cells(split, sizes):
        seed, fold, target = split
        for n in train_sizes:
            for regime in regimes:
                parts = tuple((role, take) for role, take in O.regime_quota(regime, n).items() if take)
                yield D.Cell(seed=seed, fold_id=fold, target_source=target, regime=regime, train_size=n, parts=parts)

    return D.lay_out(task.df, task.key, task.sources, cells, seeds=seeds, test_size=test_size, scheme=scheme)


def augmentation(
    task: Task,
    train_sizes: Sequence[int],
    *,
    seeds: Sequence[int] = K.SEEDS,
    test_size: float = 0.30,
    scheme: str = "shuffle",
    model: str = "rf",
    correction: str = "none",
    regimes: Sequence[str] = K.TARGET_REGIMES,
) -> DataFrame:
    """Four training regimes at equal budgets against a fixed target test set."""
    task = task.prepared()
    design = augmentation_design(task, train_sizes, seeds=seeds, test_size=test_size, scheme=scheme, regimes=regimes)

    def corrected(cell: D.Cell) -> tuple[DataFrame, DataFrame]:
        fixed = correct(
            materialise(design.train(cell)), design.test(cell), task.features, method=correction,
            reference=cell.target_source, key=task.key, seed=cell.seed,
        )
        return fixed.train, fixed.test

    return _run(task, design, _plain(design) if correction == "none" else corrected, _model(model))


def acquisition_design(
    task: Task, target_sizes: Sequence[int], other_sizes: Sequence[int], *, seeds: Sequence[int] = K.SEEDS,
    test_size: float = 0.30, scheme: str = "shuffle",
) -> D.Design:
    def cells(split, sizes):
        seed, fold, target = split
        for nt in target_sizes:
            for no in other_sizes:
                parts = (("target", nt),) + ((("other", no),) if no else ())
                yield D.Cell(seed=seed, fold_id=fold, target_source=target, n_target=nt, n_other=no, parts=parts)

    return D.lay_out(task.df, task.key, task.sources, cells, seeds=seeds, test_size=test_size, scheme=scheme)


def acquisition(
    task: Task, target_sizes: Sequence[int], other_sizes: Sequence[int], *, seeds: Sequence[int] = K.SEEDS,
    test_size: float = 0.30, scheme: str = "shuffle", model: str = "rf",
) -> DataFrame:
    """Every combination of target rows and added rows of the other source."""
    task = task.prepared()
    design = acquisition_design(task, target_sizes, other_sizes, seeds=seeds, test_size=test_size, scheme=scheme)
    return _run(task, design, _plain(design), _model(model))


def importance_weighted(
    task: Task, train_sizes: Sequence[int], *, seeds: Sequence[int] = K.SEEDS, test_size: float = 0.30, scheme: str = "shuffle", model: str = "rf"
) -> DataFrame:
    """Half target, half other rows, the latter weighted by their density ratio."""
    task = task.prepared()

    def cells(split, sizes):
        seed, fold, target = split
        for n in train_sizes:
            parts = (("target", n // 2), ("other", n - n // 2))
            yield D.Cell(seed=seed, fold_id=fold, target_source=target, regime="merged_same_n_iw", train_size=n, parts=parts)

    design = D.lay_out(task.df, task.key, task.sources, cells, seeds=seeds, test_size=test_size, scheme=scheme)

    def weighted(cell: D.Cell) -> tuple[DataFrame, DataFrame]:
        parts = [X.impute_median(design.part(cell, role), task.features) for role in ("target", "other")]
        both = materialise(parts[0].unionByName(parts[1]).withColumn("_target", F.col("source") == cell.target_source))
        return ML.density_weights(both, task.features, "_target"), design.test(cell)

    return _run(task, design, weighted, _model(model, weight="density_weight"))


def pretrain(
    task: Task, train_sizes: Sequence[int], *, seeds: Sequence[int] = K.SEEDS, test_size: float = 0.30, scheme: str = "shuffle",
    budget: int = 200, max_iter: int = 200,
) -> DataFrame:
    """Perceptron on the target alone against one pretrained on the other source."""
    task = task.prepared()
    second = "pretrain_other_finetune_target"

    def cells(split, sizes):
        seed, fold, target = split
        # As many rows of the other source as there are, up to the budget.
        start = min(budget, sizes.get("other", 0))
        for n in train_sizes:
            for regime, parts in (("target_only_mlp", (("target", n),)), (second, (("target", n), ("other", start)))):
                yield D.Cell(seed=seed, fold_id=fold, target_source=target, regime=regime, train_size=n, parts=parts)

    design = D.lay_out(task.df, task.key, task.sources, cells, seeds=seeds, test_size=test_size, scheme=scheme)

    def fit(part: Task, tune: DataFrame, cell: D.Cell) -> ML.Fitted:
        start = materialise(design.part(cell, "other")) if cell.regime == second else tune
        return ML.pretrain_finetune(start, tune, part.features, part.label, seed=cell.seed, max_iter=max_iter)

    return _run(task, design, lambda cell: (design.part(cell, "target"), design.test(cell)), fit)


def headline(linear: DataFrame, forest: DataFrame, *, compare: Sequence[str] = ("merged_same_n", "target_plus_other_2n")) -> DataFrame:
    """Linear probe against random forest: baseline, compared score and difference."""
    keys = ["fold_id", "target_source", "train_size"]
    out = None
    for name, measurements in (("linear_probe", linear), ("rf", forest)):
        pairs = M.paired_deltas(measurements, keys, ["macro_f1"], compare=compare)
        base = measurements.filter(F.col("regime") == "target_only").select(*keys, F.col("macro_f1").alias("_base"))
        part = pairs.join(base, keys).groupBy("target_source", "train_size", "compare_regime").agg(
            F.avg("_base").alias(f"{name}_target_only_macro_f1"),
            (F.avg("_base") + F.avg("delta_macro_f1")).alias(f"{name}_compare_macro_f1"),
            F.avg("delta_macro_f1").alias(f"{name}_delta_macro_f1"),
            F.count(F.lit(1)).alias(f"{name}_pairs"),
        )
        out = part if out is None else out.join(part, ["target_source", "train_size", "compare_regime"], "left")
    return out


@dataclass(frozen=True)
class Measured:
    """Prepared rows, and the tests and shifts of single features; views of the same rows share them.

    ``kernel`` has the kernel test of each view by name, if all were made together.
    """

    rows: DataFrame
    ks: DataFrame
    moved: DataFrame
    kernel: DataFrame | None = None


def measure_features(
    df: DataFrame, features: Sequence[str], *, sources: tuple[str, str], key: Sequence[str], per_source: int | None, seed: int
) -> Measured:
    # What is filled in comes from the driver; the rows below are written.
    rows = X.prepare(df, features, key=("match_id", *key), per_source=per_source, seed=seed)
    ks = X.ks_per_feature(rows, features, *sources)
    return Measured(rows, materialise(ks), materialise(X.location_scale(rows, features, *sources)))


def evaluate_view(
    name: str, df: DataFrame, *, sources: tuple[str, str] = (K.SOURCE_XML, K.SOURCE_JSON), key: Sequence[str],
    features: Sequence[str] | None = None, per_source: int | None = None, permutations: int = 100, components: int = 128,
    classifier: bool = True, folds: int = 5, seed: int = K.SEED, measured: Measured | None = None, **params,
) -> dict[str, DataFrame]:
    """Kernel test, source classifier, per-feature tests and shifts of one feature view.

    ``measured`` has these rows and, among others, these features. Without ``classifier`` no source classifier is fitted. A view with less than two rows of a source
    has the section ``skipped`` only, with the numbers of rows.
    """
    features = list(features or X.numeric_features(df, ("source", "match_id", *key)))
    if measured is None:
        measured = measure_features(df, features, sources=sources, key=key, per_source=per_source, seed=seed)
    rows = measured.rows
    one = F.lit(name).alias("name")
    sizes = rows.agg(*[F.count_if(F.col("source") == source).alias(side) for side, source in zip(("n_source", "n_target"), sources)])
    if min(sizes.first()) < 2:
        return {"skipped": sizes.select(one, "*")}
    if measured.kernel is None:
        kernel = X.mmd(rows, features, *sources, key=("match_id", *key), permutations=permutations, components=components, seed=seed)
    else:
        kernel = measured.kernel.filter(F.col("name") == name).drop("name")
    ks = X.bonferroni(measured.ks.filter(F.col("feature").isin(*features)), len(features))
    moved = measured.moved.filter(F.col("feature").isin(*features))
    significant = ks.agg(F.count_if(F.col("p_value_bonferroni") < 0.05).alias("n_ks_significant"), F.avg("ks_stat").alias("ks_mean"))
    shifted = moved.agg(F.avg(F.abs("gamma_pooled_sd")).alias("shift_mean"))
    # Tables of one row side by side.
    summary = kernel.select(one, "*").join(significant.select(one, "*"), "name").join(shifted.select(one, "*"), "name")
    sections = {"ks": ks.withColumn("name", one), "location_scale": moved.withColumn("name", one)}
    if classifier:
        folds_df, importances = ML.domain_classifier(rows, features, folds=folds, seed=seed, **params)
        accuracy = folds_df.agg(
            F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"),
            F.avg("balanced_accuracy").alias("balanced_accuracy_mean"), F.stddev_pop("balanced_accuracy").alias("balanced_accuracy_std"),
        )
        summary = summary.join(accuracy.select(one, "*"), "name")
        sections["importances"] = importances.withColumn("name", one)
    return {"summary": summary.withColumn("n_features", F.lit(len(features))), **sections}


MEASURES = ("mmd_sq", "ks_mean", "n_ks_significant", "shift_mean")


def shift_report(
    views: Mapping[str, DataFrame], *, described: Mapping[str, View] | None = None, **settings
) -> dict[str, DataFrame]:
    """All views evaluated, a few at a time, plus the change between related views.

    ``described`` gives the key and the features of each view; else ``settings`` name the key of all.
    """

    own = {name: dict(settings) for name in views}
    alike: dict[tuple, list[str]] = {}
    for name, df in views.items():
        if described:
            own[name] |= {"key": described[name].key, "features": described[name].features_of(df)}
        if not own[name].get("features"):
            own[name]["features"] = X.numeric_features(df, ("source", "match_id", *own[name]["key"]))
        alike.setdefault((id(df), tuple(own[name]["key"])), []).append(name)

    def several(names: list[str]) -> dict[str, dict[str, DataFrame]]:
        """Views of the same rows: each feature is measured once."""
        first = own[names[0]]
        given = {
            "sources": first.get("sources", (K.SOURCE_XML, K.SOURCE_JSON)), "key": first["key"],
            "per_source": first.get("per_source"), "seed": first.get("seed", K.SEED),
        }
        features = list(dict.fromkeys(c for name in names for c in own[name]["features"]))
        measured = measure_features(views[names[0]], features, **given)
        rows, sources = measured.rows, given["sources"]
        sizes = rows.agg(*[F.count_if(F.col("source") == source) for source in sources]).first()
        if min(sizes) >= 2:
            kernel = X.kernel_tests(
                rows, {name: own[name]["features"] for name in names}, *sources, key=("match_id", *given["key"]), seed=given["seed"],
                **{c: first[c] for c in ("permutations", "components") if c in first},
            )
            measured = replace(measured, kernel=materialise(kernel))
        return {name: evaluate_view(name, views[name], **own[name], measured=measured) for name in names}

    found = {name: part for group in D.in_parallel(several, alike.values()) for name, part in group.items()}
    sections: dict[str, DataFrame] = {}
    for evaluated in (found[name] for name in views):
        for section, part in evaluated.items():
            sections[section] = part if section not in sections else sections[section].unionByName(part)
    if "summary" not in sections:
        return sections
    sections["summary"] = materialise(sections["summary"])
    pairs = [p for p in X.ABLATION_PAIRS if set(p) <= set(views)]
    if pairs:
        sections["changes"] = X.measure_changes(sections["summary"], pairs, MEASURES)
        if "accuracy_mean" in sections["summary"].columns:
            sections["ablation"] = X.accuracy_drop(sections["summary"], pairs)
    return sections


# Presets: which view each task reads, its label and further targets, and which grids it runs.
_RATES = {"label": "distance_per_minute_m", "more_labels": ("hsr_per_minute_m", "mean_speed_kmh"), "kind": "regression"}
PRESETS: dict[str, dict] = {
    "ball_status": {"view": "frame_state", "label": "ball_in_play", "runs": {"learning_curve": {"train_sizes": K.TRACKING_TRAIN_SIZES}, "transfer": {}}},
    "player_position": {
        "view": "player_profile", "label": "position_group",
        "runs": {
            "learning_curve": {"train_sizes": (25, 50, 75, 100, 150, 200)}, "transfer": {},
            "augmentation": {"train_sizes": (50, 100, 150)}, "acquisition": {"target_sizes": (25, 50, 100), "other_sizes": (0, 25, 50, 100)},
            "importance_weighted": {"train_sizes": (50, 100, 150)}, "pretrain": {"train_sizes": (50, 100, 150)},
        },
    },
    "player_position_no_kinematic": {"view": "player_profile_no_kinematic", "label": "position_group", "runs": {"augmentation": {"train_sizes": (50, 100, 150)}}},
    "player_position_context": {"view": "profile_with_context", "label": "position_group", "runs": {"augmentation": {"train_sizes": (50, 100, 150)}}},
    "intensity": {"view": "intensity_rates", **_RATES, "runs": {"learning_curve": {"train_sizes": (50, 100, 150)}, "transfer": {}, "augmentation": {"train_sizes": (50, 100, 150)}}},
    "intensity_visible": {"view": "intensity_rates_vis", **_RATES, "runs": {"augmentation": {"train_sizes": (50, 100, 150)}}},
    "pass_success": {
        "view": "pass_view", "label": "pass_success",
        "runs": {
            "learning_curve": {"train_sizes": (250, 500, 1000, 2000)}, "transfer": {},
            "augmentation": {"train_sizes": (250, 500, 1000, 2000)},
            "acquisition": {"target_sizes": (100, 250, 500, 1000, 2000), "other_sizes": (0, 250, 500, 1000, 2000, 4000)},
            "importance_weighted": {"train_sizes": (250, 500, 1000, 2000)}, "pretrain": {"train_sizes": (250, 500, 1000, 2000)},
        },
    },
    "pass_success_context": {"view": "pass_context", "label": "pass_success", "runs": {"learning_curve": {"train_sizes": (250, 500, 1000, 2000)}, "transfer": {}, "augmentation": {"train_sizes": (250, 500, 1000, 2000)}}},
    "shot_success": {"view": "shot_view", "label": "shot_success", "runs": {"learning_curve": {"train_sizes": (25, 50, 100)}, "transfer": {}, "augmentation": {"train_sizes": (25, 50, 100)}}},
}
# Position and intensity again, with the training rows of each cell corrected between sources, or by permuted sources.
for _name in ("player_position", "intensity"):
    for _method in ("ls", "ls_permuted", "combat_p", "combat_p_permuted"):
        PRESETS[f"{_name}_{_method}"] = {
            **PRESETS[_name], "runs": {"augmentation": {"train_sizes": (50, 100, 150), "correction": _method}},
        }
RUNS: dict[str, Callable[..., DataFrame]] = {
    "learning_curve": learning_curve, "transfer": transfer, "augmentation": augmentation, "acquisition": acquisition,
    "importance_weighted": importance_weighted, "pretrain": pretrain,
}


def preset_task(name: str, views: Mapping[str, DataFrame], described: Mapping[str, View], **settings) -> Task:
    """The task of a preset over its view; ``settings`` replace fields of the task."""
    preset = PRESETS[name]
    df, view = views[preset["view"]], described[preset["view"]]
    labels = (preset["label"], *preset.get("more_labels", ()))
    features = tuple(c for c in view.features_of(df) if c not in labels)
    given = {c: preset[c] for c in ("kind", "more_labels") if c in preset}
    return Task(df=df, features=features, label=labels[0], key=("match_id", *view.key), **{**given, **settings})


def run_preset(name: str, task: Task, *, grids: Mapping[str, Mapping] | None = None, **overrides) -> dict[str, DataFrame]:
    """Run the grids of a preset on its task, or ``grids`` (settings by grid); ``overrides`` are settings of them all."""
    task = task.prepared()
    chosen = PRESETS[name]["runs"] if grids is None else grids
    return {run: RUNS[run](task, **{**settings, **overrides}) for run, settings in chosen.items()}
