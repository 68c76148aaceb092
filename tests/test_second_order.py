"""Second-order boosting against a plain implementation over all rows at once."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.plans import second_order as S
from almanac.plans import tuning


def plain(bins, label, seen_by, spec):
    """Predictions of all rows; ``seen_by`` says which rows a tree sees."""
    out = np.full(len(label), label[seen_by(None)].mean())
    for t in range(spec.trees):
        seen, cols = seen_by(t), S._columns(spec, t, bins.shape[1])
        g = out - label
        step = np.zeros(len(label))

        def weight(rows):
            total = g[rows].sum()
            return -spec.rate * np.sign(total) * max(abs(total) - spec.alpha, 0) / (len(rows) + spec.penalty)

        def grow(rows, every, depth):
            score = lambda r: max(abs(g[r].sum()) - spec.alpha, 0) ** 2 / (len(r) + spec.penalty)
            best = (1e-12, None, None)
            for f in cols if depth < spec.depth else []:
                for cut in range(int(bins[:, f].max()) + 1):
                    left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                    if min(len(left), len(right)) >= max(spec.leaf, 1):
                        gain = (score(left) + score(right) - score(rows)) / 2 - spec.gamma
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
            if best[1] is None:
                step[every] = weight(rows)
                return
            for side in (True, False):
                part = lambda r: r[(bins[r, best[1]] <= best[2]) == side]  # noqa: E731, B023
                grow(part(rows), part(every), depth + 1)

        grow(np.flatnonzero(seen), np.arange(len(label)), 0)
        out = out + step
    return out


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=(n, 4))
    x[:, 3] = rng.integers(0, 5, n)
    y = 3 * (x[:, 0] > 0.3) + x[:, 1] * x[:, 3] + rng.normal(size=n) * 0.3
    rows = [(i, *map(float, x[i]), float(y[i]), -1 if i % 5 == 4 else i % 3) for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, value double, fold int").repartition(5)
    return S.bin_rows(frame, ["a", "b", "c", "d"], F.col("fold"), ["id"], bins=16), frame


def gathered(data):
    rows = data.rows.orderBy("tag").collect()
    return (
        np.array([r.tag for r in rows]), np.array([r.label for r in rows]), np.array([r.fold for r in rows]),
        np.array([list(r.bins) for r in rows]),
    )


SPECS = [
    S.Boosted(trees=7, rate=0.3, depth=3, subsample=0.7, columns=0.5),
    S.Boosted(trees=4, rate=0.2, depth=2, leaf=20, subsample=1.0, columns=1.0, gamma=0.5, alpha=2.0, penalty=3.0),
    S.Boosted(trees=7, rate=0.1, depth=4, subsample=0.9, columns=0.75, seed=5, fold=1),
]


def test_models_in_step_equal_plain_ones(table):
    data, frame = table
    tag, label, fold, bins = gathered(data)
    models, errors = S.fit_together(data, SPECS, [2, 7])
    found = {(r.trees, r.model, r.fold): r for r in errors.collect()}
    for m, spec in enumerate(SPECS):
        learned = (fold != -1) & (fold != (spec.fold if spec.fold is not None else -2))

        def seen(t, spec=spec, learned=learned):
            return learned if t is None else learned & S._drawn(tag, spec, t)

        for stage in (2, 7):
            shorter = dataclasses.replace(spec, trees=min(stage, spec.trees))
            predicted = plain(bins, label, seen, shorter)
            for k in (-1, 0, 1, 2):
                mine = fold == k
                assert found[stage, m, k].mae == pytest.approx(np.abs(predicted - label)[mine].mean(), rel=1e-9)
                assert found[stage, m, k].n == mine.sum()
        scored = {r.value: r.predicted for r in S.predict(models[m], frame).collect()}
        assert [scored[y] for y in label] == pytest.approx(list(plain(bins, label, seen, spec)), rel=1e-9)


def test_stages_equal_separate_fits(table):
    data, _ = table
    spec = SPECS[0]
    _, staged = S.fit_together(data, [spec], [3, 5, 7])
    for trees in (3, 5):
        _, alone = S.fit_together(data, [dataclasses.replace(spec, trees=trees)])
        rows = lambda e: sorted((r.fold, r.mae, r.rmse, r.r2) for r in e.filter(F.col("trees") == trees).collect())  # noqa: E731, B023
        assert rows(staged) == rows(alone)


def test_training_loss_never_rises(table):
    data, _ = table
    spec = S.Boosted(trees=8, rate=0.3, depth=3, subsample=1.0, columns=1.0)
    _, errors = S.fit_together(data, [spec], list(range(1, 9)))
    learned = errors.filter("fold <> -1").groupBy("trees").agg((F.sum(F.col("rmse") * F.col("rmse") * F.col("n"))).alias("sse"))
    losses = [r.sse for r in learned.orderBy("trees").collect()]
    assert all(b <= a for a, b in zip(losses[:-1], losses[1:], strict=True)) and losses[-1] < losses[0] / 2


def test_missing_values_and_constant_features(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 7), 2.0, None if i % 10 == 9 else float(i % 3 == 0)) for i in range(90)]
    frame = spark.createDataFrame(rows, "id long, a double, b double, value double")
    data = S.bin_rows(frame, ["a", "b"], F.lit(0), ["id"])
    assert data.rows.count() == 81
    models, errors = S.fit_together(data, [S.Boosted(trees=3, depth=1, subsample=1.0, columns=1.0)])
    assert errors.count() == 1
    assert S.predict(models[0], frame).count() == 90


def test_staged_grids(table):
    """Every combination has its row, and each agrees with a model of its own."""
    _, frame = table
    rows = frame.withColumn("split", F.when(F.col("fold") == -1, "test").otherwise("train"))
    grid = {"trees": [1, 3], "rate": [0.1, 0.3], "depth": [1, 2], "leaf": [3], "subsample": [0.8]}
    found = tuning.staged_hold_out_search(rows, ["a", "b", "c", "d"], grid, ["id"]).collect()
    assert len(found) == 8 and [r.test_r2 for r in found] == sorted((r.test_r2 for r in found), reverse=True)
    data = S.bin_rows(rows, ["a", "b", "c", "d"], F.when(F.col("split") == "train", 0).otherwise(-1), ["id"])
    best = found[0].params
    spec = S.Boosted(trees=int(best["trees"]), rate=best["rate"], depth=int(best["depth"]), leaf=3, subsample=0.8)
    _, errors = S.fit_together(data, [spec])
    alone = {r.fold: r for r in errors.collect()}
    assert (alone[-1].r2, alone[0].r2) == pytest.approx((found[0].test_r2, found[0].train_r2), rel=1e-12)


def test_staged_cross_validation(table):
    _, frame = table
    train = frame.filter("fold <> -1").drop("fold").withColumn("series_id", F.lit("s"))
    grid = {"trees": [2, 3], "depth": [2], "rate": [0.2, 0.4], "leaf": [3], "subsample": [0.9], "columns": [1.0]}
    found = {(r.params["trees"], r.params["rate"]): r.mean_r2 for r in tuning.staged_cross_validated_search(train, ["a", "b", "c", "d"], grid, ["id"], folds=3).collect()}
    assert len(found) == 4
    folded = tuning.contiguous_folds(train, ["id"], 3)
    data = S.bin_rows(folded, ["a", "b", "c", "d"], F.col("fold"), ["series_id", "id"])
    r2 = []
    for k in range(3):
        _, errors = S.fit_together(data, [S.Boosted(trees=3, depth=2, rate=0.4, leaf=3, subsample=0.9, columns=1.0, fold=k)])
        r2.append(next(r.r2 for r in errors.collect() if r.fold == k))
    assert found[3.0, 0.4] == pytest.approx(np.mean(r2), rel=1e-12)
