"""Model training on feature frames with MLlib.

One model is fitted over all series of a panel; its errors are reported per split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.scoring import accuracy_percent, non_negative
from almanac.operators.metrics import regression_metrics
from almanac.operators.split import chronological_split, contiguous_folds
from almanac.plans.features import align_features
from almanac.session import ensure_checkpoint_dir
from almanac.sources.sinks import overwrite_metrics, read_metrics, upsert_metrics

LABEL = "value"
SEED = 42
# Rows of one part of a training table.
ROWS_PER_PART = 20_000
TREES = (GBTRegressor, RandomForestRegressor)


def gradient_boosting(
    trees: int = 280, rate: float = 0.08, depth: int = 4, leaf: int = 3, subsample: float = 0.85,
    features: str = "all", seed: int = SEED,
) -> GBTRegressor:
    """Boosted trees; the defaults are those of the monthly model with covariates."""
    return GBTRegressor(
        labelCol=LABEL, featuresCol="features", maxIter=trees, stepSize=rate, maxDepth=depth,
        minInstancesPerNode=leaf, subsamplingRate=subsample, featureSubsetStrategy=features, seed=seed,
        checkpointInterval=10,
    )


def random_forest(
    trees: int = 300, depth: int = 8, leaf: int = 4, features: str = "sqrt", seed: int = SEED, bootstrap: bool = True
) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol=LABEL, featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf,
        featureSubsetStrategy=features, seed=seed, bootstrap=bootstrap,
    )


def subsampled_boosting(trees: int = 100, rate: float = 0.1, depth: int = 5, leaf: int = 5, seed: int = SEED) -> GBTRegressor:
    """Boosted trees that see 80% of the rows and of the columns.

    Stands in for second-order boosting: columns are drawn per node, and there are no
    penalty terms on leaf weights.
    """
    return gradient_boosting(trees, rate, depth, leaf, subsample=0.8, features="0.8", seed=seed)


def linear() -> LinearRegression:
    """Least squares, solved from the normal equations: the cheap baseline."""
    return LinearRegression(labelCol=LABEL, featuresCol="features", solver="normal")


def ridge(train: DataFrame, alpha: float = 0.1, label: str = LABEL) -> LinearRegression:
    """Least squares with an L2 penalty ``alpha`` on the coefficients.

    MLlib divides the loss by the row count and scales by the label's deviation; the
    penalty is converted so that the solution is the textbook one.
    """
    n, spread = train.agg(F.count(label), F.stddev_pop(label)).first()
    return LinearRegression(
        labelCol=label, featuresCol="features", regParam=alpha / n * (spread or 0.0), elasticNetParam=0.0,
        standardization=False, solver="normal",
    )


def assembled(features: list[str], scaled: bool = True) -> list:
    """Stages from feature columns to the ``features`` vector; the scaler learns from train rows only."""
    if not scaled:
        return [VectorAssembler(inputCols=features, outputCol="features")]
    return [
        VectorAssembler(inputCols=features, outputCol="assembled"),
        StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True),
    ]


def fit(train: DataFrame, features: list[str], estimator: Estimator, scaled: bool | None = None) -> PipelineModel:
    """The fitted stages. Features are standardised unless the estimator is of trees, which only
    compare values."""
    ensure_checkpoint_dir(train.sparkSession)
    scaled = not isinstance(estimator, TREES) if scaled is None else scaled
    return Pipeline(stages=[*assembled(features, scaled), estimator]).fit(train)


def predict(model: PipelineModel, df: DataFrame, name: str = "predicted", clamp: bool = False) -> DataFrame:
    """The frame with the model's prediction added and its helper columns removed."""
    scored = model.transform(df)
    value = F.col("prediction")
    return scored.select(*df.columns, (non_negative(value) if clamp else value).alias(name))


@dataclass
class Trained:
    """A fitted model with what scoring needs to know about it."""

    model: PipelineModel
    features: list[str]
    base_year: int
    metrics: dict[str, float | None]
    # The variant of daily features, if it is one of ``DAILY_SPECS``.
    variant: str | None = None


def training_rows(df: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """The rows of a fit, in parts of about ``rows_per_part`` and persisted; the caller releases them.

    Fitting passes over them again and again, and trees draw their samples part by part. So the
    parts follow from the rows' keys (all columns, where there are none) and their number, and rows stand in the order of their
    keys: a fit gives the same model whatever the shuffle setting, and a lost part is made again
    as it was.
    """
    keys = [c for c in ("series_id", "date", "year", "month") if c in df.columns] or df.columns
    parts = max(1, -(-df.count() // rows_per_part))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).persist()


def evaluate(model: PipelineModel, split_frame: DataFrame) -> DataFrame:
    """Errors by split."""
    return regression_metrics(predict(model, split_frame), ["split"], actual=LABEL)


def train_and_evaluate(
    frame: DataFrame, features: list[str], estimator: Estimator, base_year: int, order: list[str],
    split: Column | None = None,
) -> tuple[Trained, DataFrame]:
    """Fit on the train rows and report errors by split.

    The earlier rows of each series train unless ``split`` decides otherwise, as
    ``hashed_split`` does for a random hold-out.
    """
    rows = chronological_split(frame, order) if split is None else frame.withColumn("split", split)
    split_frame = training_rows(rows)
    try:
        model = fit(split_frame.filter(F.col("split") == "train"), features, estimator)
        errors = {r["split"]: r for r in evaluate(model, split_frame).collect()}  # one row per split
    finally:
        split_frame.unpersist()
    test = errors.get("test")
    metrics = {"mae": test["mae"], "rmse": test["rmse"], "r2_score": test["r2"]} if test else {}
    spark = frame.sparkSession
    report = spark.createDataFrame(
        [(s, r["n"], r["mae"], r["rmse"], r["r2"]) for s, r in sorted(errors.items())],
        "split string, n bigint, mae double, rmse double, r2 double",
    )
    return Trained(model, features, base_year, metrics), report


INFO_SCHEMA = "features array<string>, base_year int, mae double, rmse double, r2_score double, variant string"


def save_bundle(trained: Trained, path: str, spark: SparkSession) -> None:
    """The fitted stages and, beside them, a one-row table of features, base year and metrics."""
    trained.model.write().overwrite().save(f"{path}/model")
    m = trained.metrics
    spark.createDataFrame(
        [(trained.features, trained.base_year, m.get("mae"), m.get("rmse"), m.get("r2_score"), trained.variant)],
        INFO_SCHEMA,
    ).write.mode("overwrite").json(f"{path}/info")


def load_bundle(path: str, spark: SparkSession) -> Trained:
    info = spark.read.schema(INFO_SCHEMA).json(f"{path}/info").first()
    metrics = {k: info[k] for k in ("mae", "rmse", "r2_score")}
    return Trained(PipelineModel.load(f"{path}/model"), list(info["features"]), info["base_year"], metrics, info["variant"])


def metrics_row(spark: SparkSession, key: str, metrics: dict[str, float | None]) -> DataFrame:
    """One model's entry of the metrics table, rounded as it is shown."""
    one = spark.createDataFrame(
        [(key, metrics.get("mae"), metrics.get("rmse"), metrics.get("r2_score"))],
        "model_key string, mae double, rmse double, r2_score double",
    )
    return one.select(
        "model_key",
        F.round("mae", 2).alias("mae"),
        F.round("rmse", 2).alias("rmse"),
        F.round("r2_score", 4).alias("r2_score"),
        accuracy_percent(F.col("r2_score")).alias("accuracy_percent"),
    )


def register(
    spark: SparkSession, trained: Trained, key: str, bundle_path: str, metrics_to: str, metrics_from: str | None = None
) -> DataFrame:
    """Save the bundle and put the model's errors into the metrics table.

    The merged table goes to a path of its own, never over the files being read. Without
    ``metrics_from`` a new table starts.
    """
    if metrics_from == metrics_to:
        raise ValueError("the merged metrics need a path of their own")
    save_bundle(trained, bundle_path, spark)
    fresh = metrics_row(spark, key, trained.metrics)
    merged = upsert_metrics(read_metrics(spark, metrics_from), fresh) if metrics_from else fresh
    overwrite_metrics(merged, metrics_to)
    return read_metrics(spark, metrics_to)


def feature_importance(model: PipelineModel, features: list[str], n: int = 10) -> DataFrame:
    """The n most important features of a fitted tree model."""
    weights = model.stages[-1].featureImportances.toArray()
    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame(
        [(f, float(w)) for f, w in zip(features, weights)], "feature string, importance double"
    )
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def select_features(train: DataFrame, features: list[str], k: int = 50) -> list[str]:
    """The k features with the strongest linear relation to the target, judged on train rows."""
    vectors = VectorAssembler(inputCols=features, outputCol="assembled").transform(train)
    selector = UnivariateFeatureSelector(
        featuresCol="assembled", labelCol=LABEL, outputCol="selected", selectionMode="numTopFeatures"
    )
    selector.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(min(k, len(features)))
    return [features[i] for i in sorted(selector.fit(vectors).selectedFeatures)]


# --- Ensembles --------------------------------------------------------------------------


def _chain(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """One prediction column per model, added in turn; no join of prediction frames."""
    out = df
    for name, model in models.items():
        out = predict(model, out, name)
    return out


def _save_all(models: dict[str, PipelineModel], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def average_predictions(df: DataFrame, columns: list[str], name: str = "predicted") -> DataFrame:
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return df.withColumn(name, total / len(columns))


@dataclass
class Voting:
    """Unweighted mean of several models."""

    models: dict[str, PipelineModel]

    def predict(self, df: DataFrame) -> DataFrame:
        scored = average_predictions(_chain(self.models, df), list(self.models))
        return scored.drop(*self.models)

    def save(self, path: str) -> None:
        _save_all(self.models, path)

    @staticmethod
    def load(path: str, names: list[str]) -> Voting:
        return Voting({n: PipelineModel.load(f"{path}/{n}") for n in names})


def fit_voting(train: DataFrame, features: list[str], estimators: dict[str, Estimator]) -> Voting:
    return Voting({name: fit(train, features, e) for name, e in estimators.items()})


@dataclass
class Stacking:
    """Base models whose predictions feed a ridge regression."""

    models: dict[str, PipelineModel]
    meta: PipelineModel

    def predict(self, df: DataFrame) -> DataFrame:
        return predict(self.meta, _chain(self.models, df)).drop(*self.models)

    def save(self, path: str) -> None:
        _save_all({**self.models, "meta": self.meta}, path)

    @staticmethod
    def load(path: str, names: list[str]) -> Stacking:
        models = {n: PipelineModel.load(f"{path}/{n}") for n in names}
        return Stacking(models, PipelineModel.load(f"{path}/meta"))


def fit_stacking(
    train: DataFrame, features: list[str], estimators: dict[str, Estimator], order: list[str],
    folds: int = 5, alpha: float = 0.1,
) -> Stacking:
    """The meta model learns from predictions made on folds the base model did not see.

    The base models are then fitted again on all train rows.
    """
    folded = training_rows(contiguous_folds(train, order, folds))
    try:
        held_out = None
        for k in range(folds):
            models = {
                name: fit(folded.filter(F.col("fold") != k), features, e) for name, e in estimators.items()
            }
            part = _chain(models, folded.filter(F.col("fold") == k)).select(LABEL, *estimators)
            held_out = part if held_out is None else held_out.unionByName(part)
        held_out = training_rows(held_out)
        meta = fit(held_out, list(estimators), ridge(held_out, alpha), scaled=False)
        held_out.unpersist()
        final = {name: fit(folded, features, e) for name, e in estimators.items()}
    finally:
        folded.unpersist()
    return Stacking(final, meta)


# --- Scoring ----------------------------------------------------------------------------


def score(trained: Trained, requests: DataFrame, keep: list[str], strict: bool = False) -> DataFrame:
    """Predict request rows that carry the history features. A feature they lack counts as 0, or is
    an error if ``strict``."""
    lacking = [c for c in trained.features if c not in requests.columns]
    if strict and lacking:
        raise ValueError(f"requests lack the features {', '.join(lacking)}")
    extra = [c for c in keep if c not in trained.features]
    shared = [c for c in keep if c in trained.features]
    frame = requests.select(
        *extra, *[F.col(c).alias(f"kept_{c}") for c in shared], *align_features(requests, trained.features)
    )
    scored = predict(trained.model, frame, clamp=True)
    return scored.select(*extra, *[F.col(f"kept_{c}").alias(c) for c in shared], "predicted")
