"""Parameter grids, hold-out and cross-validated searches."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators.metrics import error_columns
from almanac.operators.split import contiguous_folds
from almanac.plans import second_order
from almanac.plans.training import LABEL, assembled, fit, gradient_boosting, predict, training_rows
from almanac.session import ensure_checkpoint_dir

# Axes of the boosted-tree search, named as the arguments of ``gradient_boosting``. The five
# lists of values are fixed by what the search has to cover.
HOLD_OUT_GRID = {
    "trees": [100, 200, 300, 400],
    "rate": [0.01, 0.05, 0.1, 0.15],
    "depth": [3, 4, 5, 6, 7],
    "leaf": [3, 5, 7, 10],
    "subsample": [0.6, 0.8, 0.9, 1.0],
}

# Axes of the cross-validated search; these values are fixed too.
CROSS_VALIDATED_GRID = {
    "trees": [200, 300],
    "depth": [6, 8],
    "rate": [0.05, 0.1],
    "leaf": [3, 5],
    "subsample": [0.8, 0.9],
    "columns": [0.8, 0.9],
}


def boosting(params: dict[str, float]) -> Estimator:
    """Boosted trees with one combination of a grid; an axis they don't have is an error."""
    return gradient_boosting(**{k: v if k in ("rate", "subsample") else int(v) for k, v in params.items()})


RESULT_SCHEMA = "params map<string,double>, train_r2 double, test_r2 double, test_mae double, test_rmse double"


def expand_grid(df: DataFrame, grid: dict[str, list[float]]) -> DataFrame:
    """Every row with each combination of the grid, as a ``params`` map.

    The axes are literals exploded in turn on the row itself: no join, and the number of
    combinations is known when the plan is built.
    """
    out = df
    for name, values in grid.items():
        out = out.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(f"axis_{name}"))
    entries = [x for name in grid for x in (F.lit(name), F.col(f"axis_{name}"))]
    return out.select(*df.columns, F.create_map(*entries).alias("params"))


def combinations(grid: dict[str, list[float]]) -> list[dict[str, float]]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def hold_out_search(
    split_frame: DataFrame,
    features: list[str],
    make: Callable[[dict[str, float]], Estimator],
    grid: dict[str, list[float]],
    parallelism: int = 4,
) -> DataFrame:
    """Fit each combination on the train rows and report its errors; best test R2 first.

    The fits share one persisted frame and run ``parallelism`` at a time, each as
    distributed Spark jobs.
    """
    spark = split_frame.sparkSession
    ensure_checkpoint_dir(spark)
    frame = training_rows(split_frame)
    train = frame.filter(F.col("split") == "train")

    def run(params: dict[str, float]) -> tuple:
        scored = predict(fit(train, features, make(params)), frame)
        by_split = [
            error_columns(F.when(F.col("split") == s, F.col(LABEL)), F.col("predicted")) for s in ("train", "test")
        ]
        (_, _, train_r2), (mae, rmse, r2) = by_split
        row = scored.agg(train_r2.alias("a"), r2.alias("b"), mae.alias("c"), rmse.alias("d")).first()
        return ({k: float(v) for k, v in params.items()}, row["a"], row["b"], row["c"], row["d"])

    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            rows = list(pool.map(inheritable_thread_target(spark)(run), combinations(grid)))
    finally:
        frame.unpersist()
    return spark.createDataFrame(rows, RESULT_SCHEMA).orderBy(F.desc_nulls_last("test_r2"))


def top_results(results: DataFrame, n: int = 10, score: str = "test_r2", tiebreak: list[str] | None = None) -> DataFrame:
    """The n best results. Spark keeps n per task and merges them."""
    ties = [F.col(c) for c in tiebreak] if tiebreak else [F.to_json("params")]
    return results.orderBy(F.desc_nulls_last(score), *ties).limit(n)


def cross_validated_search(
    train: DataFrame,
    features: list[str],
    estimator: Estimator,
    grid: dict[str, list[float]],
    order: list[str],
    folds: int = 3,
    parallelism: int = 4,
) -> tuple[DataFrame, object]:
    """Mean R2 over contiguous folds for each combination, best first, and the refitted best model.

    Grid keys are the estimator's own parameter names.
    """
    ensure_checkpoint_dir(train.sparkSession)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    folded = training_rows(contiguous_folds(train, order, folds))
    search = CrossValidator(
        estimator=Pipeline(stages=[*assembled(features), estimator]),
        estimatorParamMaps=builder.build(),
        evaluator=RegressionEvaluator(labelCol=LABEL, metricName="r2"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    try:
        fitted = search.fit(folded)
    finally:
        folded.unpersist()
    rows = [
        ({p.name: float(v) for p, v in params.items()}, float(mean))
        for params, mean in zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics)
    ]
    table = train.sparkSession.createDataFrame(rows, "params map<string,double>, mean_r2 double")
    return table.orderBy(F.desc("mean_r2")), fitted.bestModel


def cross_validated_score(
    train: DataFrame, features: list[str], estimator: Estimator, order: list[str], folds: int = 5
) -> DataFrame:
    """R2 of each contiguous fold, and their mean and twice their deviation."""
    folded = training_rows(contiguous_folds(train, order, folds))
    spark = train.sparkSession
    rows = []
    try:
        for k in range(folds):
            model = fit(folded.filter(F.col("fold") != k), features, estimator)
            _, _, r2 = error_columns(F.col(LABEL), F.col("predicted"))
            scored = predict(model, folded.filter(F.col("fold") == k))
            rows.append((k, scored.agg(r2).first()[0]))
    finally:
        folded.unpersist()
    scores = spark.createDataFrame(rows, "fold int, r2 double")
    summary = scores.agg(F.avg("r2").alias("mean_r2"), (2 * F.stddev_pop("r2")).alias("margin"))
    # One row per fold beside one summary row.
    return scores.select("fold", "r2", F.lit(None).cast("double").alias("margin")).unionByName(
        summary.select(F.lit(None).cast("int").alias("fold"), F.col("mean_r2").alias("r2"), "margin")
    )


# --- Staged searches: all combinations grow in the same passes ----------------------------


def _specs(grid: dict[str, list[float]], fold: int | None = None) -> list[second_order.Boosted]:
    """One model for each combination of the axes but ``trees``, as large as the largest there."""
    rest = {k: v for k, v in grid.items() if k != "trees"}
    whole = {"depth"}
    return [
        second_order.Boosted(trees=max(grid["trees"]), fold=fold, **{k: int(v) if k in whole else float(v) for k, v in c.items()})
        for c in combinations(rest)
    ]


def _params(specs: list[second_order.Boosted], grid: dict[str, list[float]]) -> Column:
    """The parameters of a row's model and number of trees, as a map."""
    names = [k for k in grid if k != "trees"]
    values = F.array(*[F.array(*[F.lit(float(getattr(s, k))) for k in names]) for s in specs])
    own = F.get(values, F.col("model"))
    entries = [x for i, k in enumerate(names) for x in (F.lit(k), F.get(own, F.lit(i)))]
    return F.create_map(F.lit("trees"), F.col("trees").cast("double"), *entries)


def staged_hold_out_search(split_frame: DataFrame, features: list[str], grid: dict[str, list[float]], keys: list[str]) -> DataFrame:
    """Errors of every combination on the train and test rows; best test R2 first.

    Combinations that differ in ``trees`` alone are stages of one fit, and all fits grow in the same passes over
    rows that are binned once.
    """
    fold = F.when(F.col("split") == "train", 0).otherwise(second_order.HELD_OUT)
    data = second_order.bin_rows(split_frame, features, fold, keys, LABEL)
    specs = _specs(grid)
    _, errors = second_order.fit_together(data, specs, [int(n) for n in grid["trees"]])
    of = lambda f, c: F.max(F.when(F.col("fold") == f, F.col(c)))
    rows = errors.groupBy("trees", "model").agg(
        of(0, "r2").alias("train_r2"), *[of(second_order.HELD_OUT, c).alias(f"test_{c}") for c in ("r2", "mae", "rmse")]
    )
    return rows.select(_params(specs, grid).alias("params"), "train_r2", "test_r2", "test_mae", "test_rmse").orderBy(F.desc_nulls_last("test_r2"))


def staged_cross_validated_search(
    train: DataFrame, features: list[str], grid: dict[str, list[float]], order: list[str], folds: int = 3
) -> DataFrame:
    """(params, mean_r2) over contiguous folds for every combination, best first.

    The models of all folds grow together over one table; each leaves its own fold out and is judged on it.
    """
    data = second_order.bin_rows(contiguous_folds(train, order, folds), features, F.col("fold"), ["series_id", *order], LABEL)
    specs = [s for k in range(folds) for s in _specs(grid, k)]
    _, errors = second_order.fit_together(data, specs, [int(n) for n in grid["trees"]])
    count = len(specs) // folds
    judged = errors.filter(F.col("fold") == F.floor(F.col("model") / count))
    mean = judged.groupBy("trees", (F.col("model") % count).alias("model")).agg(F.avg("r2").alias("mean_r2"))
    return mean.select(_params(specs[:count], grid).alias("params"), "mean_r2").orderBy(F.desc_nulls_last("mean_r2"))
