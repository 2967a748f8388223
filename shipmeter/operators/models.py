"""Regressors for merge time and for CI duration, attempts and success.

Settings there are not: a forest takes no minimum size of a split and no depth
beyond 30.  Boosting is second order and, for ``leafwise``, grows best-first
to a number of leaves (``histboost``); tuning grids use MLlib's forest and booster.

Training reads a feature table that is written once to the shared folder, and every
model is fitted on all its training rows.  What the driver receives is bounded: one row
per feature and per vocabulary term, a booster's trees, a forest's while it is small.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipmeter import KEYS
from shipmeter.functions.hashing import split_bucket
from shipmeter.operators import features as feats
from shipmeter.operators.folds import contiguous_folds
from shipmeter.operators.forest import Forest, ForestConfig, ForestGrower, ForestModel
from shipmeter.operators.histboost import BoostConfig, BoostedModel, HistBooster
from shipmeter.operators.quantiles import percentiles
from shipmeter.operators.scaling import fitted_scaling, scale_by, with_split
from shipmeter.operators.textfeatures import (
    CI_TEXT,
    PR_TEXT,
    TextConfig,
    collect_terms,
    pr_text,
    vocabulary,
    with_ngrams,
    with_wide_tfidf,
)
from shipmeter.session import materialize, shared_dir

CI_TARGETS = ("duration", "attempts", "success")
MIN_ROWS = 50
SEED = 42

_ALGORITHMS = {
    "random_forest": "random_forest",
    "gradient_boosting": "gradient_boosting",
    "xgboost": "gradient_boosting",
    "leafwise": "leafwise",
    "lightgbm": "leafwise",
}


@dataclass(frozen=True)
class ModelConfig:
    """Algorithm and settings; ``rounds`` are trees of a forest or boosting steps."""

    algorithm: str = "random_forest"
    rounds: int = 200
    depth: int = 20
    min_leaf: int = 2
    step: float = 0.1
    subsample: float = 0.9
    seed: int = SEED
    leaves: int | None = None  # leaf-limited, best-first growth


PR_DEFAULTS = {
    "random_forest": ModelConfig("random_forest", rounds=200, depth=20, min_leaf=2),
    "gradient_boosting": ModelConfig("gradient_boosting", 200, 8, 1, 0.1, 0.9),
    "leafwise": ModelConfig("leafwise", 200, 8, 20, 0.1, 1.0, leaves=62),
}
CI_DEFAULTS = {
    "random_forest": ModelConfig("random_forest", rounds=150, depth=15, min_leaf=2),
    "gradient_boosting": ModelConfig("gradient_boosting", 150, 6, 1, 0.1, 0.8),
    "leafwise": ModelConfig("leafwise", 150, 6, 20, 0.1, 1.0, leaves=31),
}


def algorithm_name(name: str) -> str:
    if name not in _ALGORITHMS:
        raise ValueError(f"unsupported model type: {name}")
    return _ALGORITHMS[name]


def booster_config(config: ModelConfig) -> BoostConfig:
    """Second-order boosting, level-wise (``gradient_boosting``: L2 weight 1, hessian 1
    a side) or best-first to ``leaves`` leaves (``leafwise``: no L2 weight, 20 rows and
    1e-3 hessian a side)."""
    if algorithm_name(config.algorithm) == "leafwise":
        return BoostConfig(config.rounds, config.depth, config.leaves or 31, max(config.min_leaf, 1), 1e-3, 0.0,
                           step=config.step, subsample=config.subsample, seed=config.seed)
    return BoostConfig(config.rounds, config.depth, None, max(config.min_leaf, 1), 1.0, 1.0,
                       step=config.step, subsample=config.subsample, seed=config.seed)


def regressor(config: ModelConfig, mllib: bool = False):
    """The estimator for a configuration.  A forest grows on numpy blocks (``forest``) and
    considers every feature at each split; boosting grows trees from histograms of gradients
    and hessians (``histboost``).  ``mllib`` gives MLlib's, which tuning takes: a forest of
    deep trees caches the node of each row and checkpoints it to the shared folder; for shallow
    ones a walk is cheaper.  Depths over 30 are not supported and an error.
    """
    if algorithm_name(config.algorithm) != "random_forest" and not mllib:
        return HistBooster(booster_config(config))
    if config.depth > 30:
        raise ValueError(f"depth {config.depth} is over 30, the most that is supported")
    if not mllib:
        return ForestGrower(ForestConfig(config.rounds, config.depth, config.min_leaf, seed=config.seed))
    common = dict(
        featuresCol="features",
        labelCol="label",
        predictionCol="prediction",
        maxDepth=config.depth,
        maxBins=64,
        maxMemoryInMB=512,
        minInstancesPerNode=config.min_leaf,
        seed=config.seed,
        cacheNodeIds=config.depth > 10,
        checkpointInterval=10,
    )
    if algorithm_name(config.algorithm) == "random_forest":
        return RandomForestRegressor(
            numTrees=config.rounds, featureSubsetStrategy="all", **common
        )
    return GBTRegressor(
        maxIter=config.rounds, stepSize=config.step, subsamplingRate=config.subsample, **common
    )


def param_grid(config: ModelConfig, scope: str = "pr") -> tuple[object, list]:
    """The estimator and the full tuning grid of an algorithm."""
    estimator = regressor(config, mllib=True)
    grid = ParamGridBuilder()
    if algorithm_name(config.algorithm) == "random_forest":
        grid.addGrid(estimator.numTrees, [100, 200, 300])
        grid.addGrid(estimator.maxDepth, [10, 20, 30])
        grid.addGrid(estimator.minInstancesPerNode, [1, 2, 4])
        return estimator, grid.build()
    grid.addGrid(estimator.maxIter, [100, 200, 300])
    grid.addGrid(estimator.maxDepth, [6, 8, 10] if scope == "pr" else [4, 6, 8])
    grid.addGrid(estimator.stepSize, [0.01, 0.1, 0.2])
    if algorithm_name(config.algorithm) == "gradient_boosting":
        grid.addGrid(estimator.subsamplingRate, [0.8, 0.9, 1.0])
    return estimator, grid.build()


# --- metrics ----------------------------------------------------------------


def regression_metrics(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", by=(), extra: tuple[Column, ...] = ()
) -> DataFrame:
    """MAE, MSE, RMSE, R2 and MAPE in percent, and any ``extra`` aggregates, in one aggregate.

    MAPE skips zero labels and is null if there is no other; R2 is null for
    constant labels.
    """
    y, p = F.col(label), F.col(prediction)
    error = y - p
    squares = F.sum(error * error)
    spread = F.var_pop(y) * F.count("*")
    return (
        scored.where(y.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(
            F.avg(F.abs(error)).alias("mae"),
            F.try_divide(squares, F.count("*")).alias("mse"),
            F.sqrt(F.try_divide(squares, F.count("*"))).alias("rmse"),
            (F.lit(1.0) - F.try_divide(squares, spread)).alias("r2"),
            (F.avg(F.try_divide(F.abs(error), F.abs(F.nullif(y, F.lit(0.0))))) * 100).alias("mape"),
            *extra,
        )
    )


def ci_metrics(scored: DataFrame, target: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The same, with minutes for durations and accuracy at one half for success.
    MAPE is infinite when every label is 0."""
    same = (F.col(label) > 0.5) == (F.col(prediction) > 0.5)
    extra = (F.avg(same.cast("int")).alias("accuracy"),) if target == "success" else ()
    metrics = regression_metrics(scored, label, prediction, extra=extra).withColumn(
        "mape", F.when(F.col("mae").isNotNull(), F.coalesce("mape", F.lit(float("inf"))))
    )
    if target == "duration":
        return metrics.withColumns({"mae_minutes": F.col("mae") * 60, "rmse_minutes": F.col("rmse") * 60})
    return metrics


def accuracy(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows whose label and prediction lie on the same side of one half."""
    same = (F.col(label) > 0.5) == (F.col(prediction) > 0.5)
    return scored.agg(F.avg(same.cast("int")).alias("accuracy"))


# --- fitted models ----------------------------------------------------------


@dataclass(frozen=True)
class Fitted:
    """A regressor with all it needs to score new rows."""

    target: str
    features: list[str]
    scaling: dict[str, tuple[float, float]]
    terms: list[tuple[str, float]]
    text: TextConfig | None
    model: Model
    metrics: dict[str, float] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)

    @property
    def forest(self) -> Forest | None:
        """The trees of ``model`` where it is a forest that the driver holds."""
        return getattr(self.model, "held", None)

    def wide(self, df: DataFrame) -> DataFrame:
        """Unscaled features, text included, for rows that carry ``ngrams``."""
        return with_wide_tfidf(df, self.terms, self.text) if self.text else df

    def score(self, wide: DataFrame, kept: Iterable[str] | None = None) -> DataFrame:
        """``prediction`` for rows of unscaled features, beside the columns ``kept`` (all)."""
        full, scaled = _scaled(wide, self.features, self.scaling)
        kept = list(full.columns if kept is None else kept)
        if isinstance(self.model, ForestModel):
            return self.model.scored(full, F.array(*scaled), kept)
        return self.model.transform(_vectors(wide, self.features, self.scaling)).select(*kept, "prediction")

    def importance(self, spark: SparkSession, k: int) -> DataFrame:
        pairs = zip(self.features, self.model.featureImportances.toArray().tolist())
        ranked = spark.createDataFrame(list(pairs), "feature string, importance double")
        return ranked.orderBy(F.desc("importance"), "feature").limit(k)


def _scaled(
    wide: DataFrame, names: list[str], scaling: dict[str, tuple[float, float]]
) -> tuple[DataFrame, list[Column]]:
    """The frame and its trained columns in trained order, scaled.  A column the frame
    lacks counts as 0."""
    have = set(wide.columns)
    missing = {n: F.lit(0.0) for n in names if n not in have}
    return wide.withColumns(missing) if missing else wide, scale_by({n: scaling[n] for n in names})


def _vectors(wide: DataFrame, names: list[str], scaling: dict[str, tuple[float, float]]) -> DataFrame:
    """Add ``features``: the trained columns in trained order, scaled."""
    full, columns = _scaled(wide, names, scaling)
    inputs = [f"_scaled_{n}" for n in names]
    scaled = [c.alias(i) for i, c in zip(inputs, columns)]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    return assembler.transform(full.select("*", *scaled)).drop(*inputs)


def pr_table(
    prs: DataFrame,
    text: TextConfig | None,
    keys=KEYS,
    label: str | None = "merge_time_hours",
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """Structural features, n-grams and label of pull requests."""
    carried = [*keys, *carried, *(["ngrams"] if text else [])]
    rows = prs.withColumn("_text", pr_text(F.col("title"), F.col("body")))
    if text:
        rows = with_ngrams(rows, "_text", text)
    if label:
        rows = rows.withColumn("label", F.col(label))
        carried.append("label")
    return feats.pr_features(rows, *carried)


def ci_table(rollup: DataFrame, text: TextConfig | None, keys=KEYS) -> DataFrame:
    """Structural features, n-grams of the title and the three labels."""
    carried = [*keys, *[f"label_{t}" for t in CI_TARGETS]]
    rows = feats.with_ci_labels(rollup)
    if text:
        rows = with_ngrams(rows, "pr_title", text)
        carried.append("ngrams")
    return feats.ci_feature_table(rows, *carried)


def least_by_hash(train: DataFrame, most: int, keys=KEYS) -> DataFrame:
    """The ``most`` rows with the least hash of their key, in that order.

    Their last hash comes from a pass over the keys alone, so the pass that reads the whole
    rows drops nearly all of them before it builds them.  No model is fitted on such a part.
    """
    order = F.xxhash64(*keys)
    last = train.select(order.alias("_h")).orderBy("_h").limit(most).agg(F.max("_h")).first()[0]
    return train.where(order <= F.lit(last)).orderBy(order, *keys).limit(most)


def fit(
    rows: DataFrame,
    structural: list[str],
    config: ModelConfig,
    text: TextConfig | None,
    target: str = "merge_time",
    keys=KEYS,
    min_rows: int = MIN_ROWS,
    test_percent: int = 20,
    text_on_all_rows: bool = False,
    estimator=None,
) -> Fitted:
    """Split, fit text features and scaling on the training rows, train, evaluate.

    ``rows`` carries ``label`` (never null), the structural features and, with
    ``text``, ``ngrams``; it should be a written table, for it is read repeatedly.
    ``text_on_all_rows`` fits the vocabulary before the split.  Trees grow on all
    training rows.
    """
    shared_dir(rows.sparkSession)
    split = with_split(rows, keys, test_percent)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    sizes = split.agg(
        F.count("*").alias("data_points"),
        F.count_if(~F.col("is_test")).alias("training_size"),
        F.count_if(F.col("is_test")).alias("test_size"),
    ).first().asDict()
    if sizes["data_points"] < min_rows:
        raise ValueError(
            f"insufficient data: {sizes['data_points']} rows found, minimum {min_rows} required"
        )
    terms: list[tuple[str, float]] = []
    names = list(structural)
    if text:
        vocab = vocabulary(rows if text_on_all_rows else train, text)
        terms = collect_terms(vocab)
        wide = with_wide_tfidf(split, terms, text).drop("ngrams")
        written = materialize(wide, f"{target}-wide-features")
        train, test = written.where(~F.col("is_test")), written.where(F.col("is_test"))
        names += [f"{text.prefix}{i}" for i in range(text.max_features)]
    scaling = fitted_scaling(train, names)
    grown = _vectors(train.select("label", *names), names, scaling).select("label", "features")
    model = (estimator or regressor(config)).fit(materialize(grown, f"{target}-vectors"))
    result = Fitted(target, names, scaling, terms, text, model, sizes=sizes)
    scored = result.score(test.select("label", *names), ["label"])
    scored = materialize(scored, f"{target}-test-scores")
    return replace(result, metrics=_evaluate(scored, target))


def _evaluate(scored: DataFrame, target: str) -> dict[str, float]:
    if target == "merge_time":
        row = regression_metrics(scored).first().asDict()
        spread = percentiles(
            scored.withColumn("_r", F.col("label") - F.col("prediction")),
            "_r",
            {"residual_p05": 0.05, "residual_p95": 0.95},
        ).first()
        row.update(spread.asDict() if spread else {})
        return row
    return ci_metrics(scored, target).first().asDict()


def fit_merge_time(prs: DataFrame, config: ModelConfig, text: TextConfig | None = PR_TEXT, keys=KEYS, **options) -> Fitted:
    """The merge-time model of merged pull requests that took at most 30 days."""
    rows = materialize(pr_table(feats.training_rows(prs), text, keys), "pr-features")
    return fit(rows, list(feats.PR_STRUCTURAL), config, text, keys=keys, **options)


def fit_ci(
    rollup: DataFrame,
    config: ModelConfig,
    text: TextConfig | None = CI_TEXT,
    keys=KEYS,
    exclude_leaky: bool = False,
    **options,
) -> tuple[dict[str, Fitted], dict[str, str]]:
    """Three models over one written feature table, and the errors of those that failed.

    By default the features contain the columns the labels come from, so scores
    look better than they are; ``exclude_leaky`` leaves those columns out.
    """
    table = materialize(ci_table(rollup, text, keys), "ci-features")
    fitted: dict[str, Fitted] = {}
    errors: dict[str, str] = {}
    for target in CI_TARGETS:
        names = [
            n for n in feats.CI_STRUCTURAL if not (exclude_leaky and n in feats.CI_LEAKS[target])
        ]
        rows = table.withColumn("label", F.col(f"label_{target}")).where(F.col("label").isNotNull())
        try:
            fitted[target] = fit(rows, names, config, text, target, keys, **options)
        except Exception as e:  # one target may fail without the others
            errors[target] = str(e)
    return fitted, errors


# --- tuning -----------------------------------------------------------------


def tuned(train: DataFrame, estimator, grid: list, folds: int = 5, parallelism: int = 4):
    """The cross-validation over a grid with the lowest MAE; folds go by key hash.

    ``train`` carries ``features``, ``label`` and ``fold``.
    """
    evaluator = RegressionEvaluator(metricName="mae", labelCol="label", predictionCol="prediction")
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=evaluator,
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    ).fit(train)


def fold_of(*keys: str, folds: int = 5) -> Column:
    return split_bucket(*keys, buckets=1000) % folds


def cross_validate(vectors: DataFrame, estimator, folds: int = 5) -> list[float]:
    """MAE per fold; folds are parts of the key hash, so they do not overlap or move."""
    evaluator = RegressionEvaluator(metricName="mae", labelCol="label", predictionCol="prediction")
    return [
        evaluator.evaluate(
            estimator.fit(vectors.where(F.col("fold") != i)).transform(vectors.where(F.col("fold") == i))
        )
        for i in range(folds)
    ]


def fold_table(rows: DataFrame, names: list[str], keys=KEYS, folds: int = 5) -> DataFrame:
    """A written table of ``features``, ``label`` and ``fold`` for tuning and validation;
    folds are contiguous in key order, as an unshuffled k-fold split cuts them."""
    written = materialize(contiguous_folds(rows, list(keys), folds).drop("position"), "fold-features")
    scaling = fitted_scaling(written, names)
    return _vectors(written, names, scaling).select("features", "label", "fold")


def grid_report(spark: SparkSession, grid: list, found) -> DataFrame:
    """Mean and deviation of MAE per combination, and which one won."""
    best = min(range(len(grid)), key=lambda i: found.avgMetrics[i])
    rows = [
        (
            i,
            ", ".join(f"{p.name}={v}" for p, v in sorted(combo.items(), key=lambda x: x[0].name)),
            float(found.avgMetrics[i]),
            float(found.stdMetrics[i]),
            i == best,
        )
        for i, combo in enumerate(grid)
    ]
    return spark.createDataFrame(
        rows, "combination int, settings string, cv_mae_mean double, cv_mae_std double, best boolean"
    )


def cv_report(spark: SparkSession, maes: list[float]) -> DataFrame:
    """One row per fold with the mean and population deviation over the folds."""
    rows = spark.createDataFrame(list(enumerate(maes)), "fold int, mae double")
    overall = rows.agg(F.struct(F.avg("mae").alias("m"), F.stddev_pop("mae").alias("s")))
    return rows.select(
        "fold",
        "mae",
        overall.scalar()["m"].alias("cv_mae_mean"),
        overall.scalar()["s"].alias("cv_mae_std"),
    )


# --- persistence ------------------------------------------------------------


def save(fitted: Fitted, path: str) -> None:
    """Model, feature order with scaling, vocabulary and metrics; nothing else."""
    spark = SparkSession.active()
    fitted.model.write().overwrite().save(f"{path}/model")
    kind = type(fitted.model).__name__
    spark.createDataFrame([(kind,)], "kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")
    scaling = [(i, n, *fitted.scaling[n]) for i, n in enumerate(fitted.features)]
    spark.createDataFrame(scaling, "position int, feature string, mean double, std double").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/features")
    terms = [(i, t, idf) for i, (t, idf) in enumerate(fitted.terms)]
    spark.createDataFrame(terms, "position int, term string, idf double").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/vocabulary")
    numbers = {**fitted.sizes, **fitted.metrics}
    metrics = [
        (fitted.target, name, None if value is None else float(value)) for name, value in numbers.items()
    ]
    spark.createDataFrame(metrics, "target string, metric string, value double").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/metrics")


def load(spark: SparkSession, path: str, text: TextConfig | None = PR_TEXT) -> Fitted:
    """A saved model.  ``text`` gives the limits its vocabulary was fitted with."""
    kind = spark.read.parquet(f"{path}/kind").first()["kind"]
    loaders = {c.__name__: c for c in (ForestModel, RandomForestRegressionModel, GBTRegressionModel, BoostedModel)}
    if kind not in loaders:
        raise ValueError(f"unknown model kind {kind!r} at {path}")
    model: Model = loaders[kind].load(f"{path}/model")
    scaling = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    terms = spark.read.parquet(f"{path}/vocabulary").orderBy("position").collect()
    metrics = spark.read.parquet(f"{path}/metrics").collect()
    return Fitted(
        target=metrics[0]["target"],
        features=[r["feature"] for r in scaling],
        scaling={r["feature"]: (r["mean"], r["std"]) for r in scaling},
        terms=[(r["term"], r["idf"]) for r in terms],
        text=text,
        model=model,
        metrics={r["metric"]: r["value"] for r in metrics},
    )


def save_ci(fitted: dict[str, Fitted], path: str) -> None:
    for target, model in fitted.items():
        save(model, f"{path}_{target}")


def load_ci(spark: SparkSession, path: str, text: TextConfig | None = CI_TEXT) -> dict[str, Fitted]:
    """The CI models that exist below a base path; missing ones are left out."""
    found = {}
    for target in CI_TARGETS:
        try:
            found[target] = load(spark, f"{path}_{target}", text)
        except Exception as e:
            if "does not exist" not in str(e) and "PATH_NOT_FOUND" not in str(e):
                raise
    return found


def registry(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Metrics of saved models with their number, as stored."""
    metrics = spark.read.parquet(*[f"{p}/metrics" for p in paths])
    return metrics.withColumn("model_count", F.lit(len(paths)))
