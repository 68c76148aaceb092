"""Second-order boosted trees with penalties, many models in step over one table of binned features.

Features become small integers once: cuts come from quantile sketches over the rows that are learned from. A level
of a tree is one pass: each task sums gradients and second derivatives by node, feature and bin, the
sums of a node meet in one group, which finds the best cut, and only the cuts go to the driver.
Models that differ in rate, depth, penalties, draws or the fold they leave out grow their trees in
the same passes, so that a grid costs as many passes as its largest model. The first trees of a model are
those of the same model with fewer trees: its errors after 100 trees are the errors of the shorter one.

The loss is half the squared error. A leaf weighs -T(G) / (H + lambda), where T takes alpha off the
sum of gradients; a cut gains half the growth of T(G)^2 / (H + lambda), less gamma. Rows are drawn
by a hash of their keys and the tree, columns by the tree, so that a pass that is run
again sees the same. Every few trees the sums so far are written back beside the rows, so that no pass goes through
more trees than that, and a lost executor costs a re-read.

Missing values go with the least ones. Rows without a label are left out. Equal gains go to the first
feature and the lower cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from almanac.operators.metrics import error_columns
from almanac.sources.sinks import stored

BINS = 64
# Error of the sketch's ranks: one in so many rows.
SKETCH = 10_000
# Trees after which the sums are written back.
STORE_EVERY = 5
# Fold of the rows that are never learned from.
HELD_OUT = -1
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Boosted:
    """What one model is to be; ``fold`` is left out of its rows."""

    trees: int = 100
    rate: float = 0.1
    depth: int = 5
    leaf: float = 1.0
    subsample: float = 0.8
    columns: float = 0.8
    gamma: float = 0.0
    alpha: float = 0.0
    penalty: float = 1.0
    seed: int = 42
    fold: int | None = None


@dataclass
class Tree:
    """Nodes of a full binary tree, the children of i at 2i + 1 and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def bare(depth: int) -> Tree:
        size = (1 << depth + 1) - 1
        return Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            right = bins[rows, np.maximum(feature, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)


@dataclass
class Ensemble:
    """A fitted model over features that are binned by ``cuts``."""

    spec: Boosted
    base: float
    features: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)


@dataclass
class Binned:
    """(tag, label, fold, bins): rows with one byte a feature."""

    rows: DataFrame
    features: list[str]
    cuts: list[np.ndarray]


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _cut(values: list, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of columns: how many cuts lie below each value."""
    out = np.zeros((len(values[0]), len(cuts)), np.uint8)
    for i, (column, edges) in enumerate(zip(values, cuts, strict=True)):
        x = np.asarray(column, np.float64)
        out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(edges, x, "left"))
    return out


def bin_rows(frame: DataFrame, features: list[str], fold: Column, keys: list[str], label: str = "value", bins: int = BINS) -> Binned:
    """The frame's rows as bins; ``fold`` is HELD_OUT for rows that are not learned from."""
    rows = frame.filter(F.col(label).isNotNull()).select(
        F.xxhash64(*keys).alias("tag"), F.col(label).cast("double").alias("label"), fold.cast("int").alias("fold"),
        *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)],
    )
    rows = stored(rows, "features")
    probs = [i / bins for i in range(1, bins)]
    sketches = [F.percentile_approx(f"f{i}", probs, SKETCH).alias(f"f{i}") for i in range(len(features))]
    found = rows.filter(F.col("fold") != HELD_OUT).agg(*sketches).first()
    cuts = [np.unique(np.array(found[f"f{i}"] or [], np.float64)) for i in range(len(features))]
    ddl = "tag long, label double, fold int, bins binary"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = [b.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(cuts))]
                packed = pa.array([x.tobytes() for x in _cut(columns, cuts)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), packed], schema=schema)

    # Every pass reads these rows, so that a small table is dealt to all cores.
    binned, cores = rows.mapInArrow(run, ddl), frame.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        binned = binned.repartition(cores, "tag")
    return Binned(stored(binned, "bins"), features, cuts)


def _drawn(tags: np.ndarray, spec: Boosted, tree: int) -> np.ndarray:
    """The rows that a tree sees: those whose mixed hash falls below the share."""
    if spec.subsample >= 1:
        return np.ones(len(tags), bool)
    h = tags.view(np.uint64) ^ np.uint64((spec.seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))) < np.uint64(int(spec.subsample * float(1 << 63)) * 2)


def _columns(spec: Boosted, tree: int, count: int) -> np.ndarray:
    """The features that a tree may cut."""
    take = max(1, round(spec.columns * count))
    return np.sort(np.random.Generator(np.random.PCG64([spec.seed, tree])).permutation(count)[:take])


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _weight(g: float, h: float, spec: Boosted) -> float:
    return float(-spec.rate * _shrunk(np.float64(g), spec.alpha) / (h + spec.penalty)) if h + spec.penalty > 0 else 0.0


def best_cut(grad: np.ndarray, count: np.ndarray, spec: Boosted) -> tuple[int, int, float, float, float]:
    """(row, bin, gain, left gradient, left count) of the best cut of a node; sums by feature and bin."""
    left_g, left_n = grad.cumsum(1), count.cumsum(1)
    g, n = left_g[:1, -1:], left_n[:1, -1:]
    score = lambda g, n: _shrunk(g, spec.alpha) ** 2 / np.maximum(n + spec.penalty, 1e-300)
    gain = (score(left_g, left_n) + score(g - left_g, n - left_n) - score(g, n)) / 2 - spec.gamma
    allowed = (left_n >= max(spec.leaf, 1)) & (n - left_n >= max(spec.leaf, 1))
    gain = np.where(allowed, gain, -np.inf)
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(at[0]), int(at[1]), float(gain[at]), float(left_g[at]), float(left_n[at])


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tags, labels, folds, bins and sums so far (a row for each model) of a batch."""
    bins = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, width)
    sums = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1).T
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), bins, sums


def _level(state: DataFrame, models: list[Ensemble], recent: dict[int, list[Tree]], growing: dict[int, Tree], tree: int, level: int) -> list:
    """The best cuts of all nodes of one level, of all models that grow: one pass."""
    ddl = "model int, node int, part int, grad binary, n binary"
    schema, width, bins_most = _schema(ddl), len(models[0].cuts), max((len(c) for m in models for c in m.cuts), default=0) + 1
    first, nodes = (1 << level) - 1, 1 << level
    specs = {m: models[m].spec for m in growing}
    columns = {m: _columns(s, tree, width) for m, s in specs.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros((2, nodes * len(columns[m]) * bins_most)) for m in growing}
        for b in batches:
            if not b.num_rows:
                continue
            tags, label, fold, bins, before = _read(b, width)
            for m, own in growing.items():
                spec, cols = specs[m], columns[m]
                seen = (fold != HELD_OUT) & _drawn(tags, spec, tree)
                if spec.fold is not None:
                    seen &= fold != spec.fold
                mine = bins[seen]
                node = own.route(mine) - first
                open_ = node >= 0
                mine, node = mine[open_], node[open_]
                margin = before[m][seen][open_]
                for t in recent[m]:
                    margin = margin + t.value[t.route(mine)]
                gradient = margin - label[seen][open_]
                at = ((node[:, None] * len(cols) + np.arange(len(cols))) * bins_most + mine[:, cols]).ravel()
                size = total[m].shape[1]
                total[m][0] += np.bincount(at, np.repeat(gradient, len(cols)), size)
                total[m][1] += np.bincount(at, minlength=size)
        out, part = [], TaskContext.get().partitionId()
        for m, both in total.items():
            by_node = both.reshape(2, nodes, -1)
            for i in np.flatnonzero(by_node[1].any(1)):
                out.append((m, first + int(i), part, by_node[0, i].tobytes(), by_node[1, i].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    found_ddl = "model int, node int, feature int, cut int, gain double, g double, n double, left_g double, left_n double"
    found_schema = _schema(found_ddl)

    def choose(group: pa.Table) -> pa.Table:
        # Summed in the order of the tasks, so that the sums are the same each time.
        group = group.sort_by("part")
        model, node = group.column("model")[0].as_py(), group.column("node")[0].as_py()
        shape = (len(group), len(columns[model]), bins_most)
        grad, count = (np.frombuffer(b"".join(group.column(c).to_pylist())).reshape(shape).sum(0) for c in ("grad", "n"))
        row, cut, gain, left_g, left_n = best_cut(grad, count, specs[model])
        values = [model, node, int(columns[model][row]), cut, gain, float(grad[0].sum()), float(count[0].sum()), left_g, left_n]
        return pa.table([pa.array([v], f.type) for v, f in zip(values, found_schema, strict=True)], schema=found_schema)

    return state.mapInArrow(sums, ddl).groupBy("model", "node").applyInArrow(choose, found_ddl).collect()


def _grow(state: DataFrame, models: list[Ensemble], recent: dict[int, list[Tree]], tree: int) -> dict[int, Tree]:
    """The next tree of every model that is to have one."""
    growing = {m: Tree.bare(e.spec.depth) for m, e in enumerate(models) if tree < e.spec.trees}
    made = dict(growing)
    level = 0
    while growing:
        # A cut for each node that has rows: nodes of a level times models.
        cuts = _level(state, models, recent, growing, tree, level)
        split = set()
        for c in cuts:
            own, spec = made[c["model"]], models[c["model"]].spec
            if level == 0:
                own.value[0] = _weight(c["g"], c["n"], spec)
            if c["gain"] > LEAST_GAIN:
                node = c["node"]
                own.feature[node], own.cut[node] = c["feature"], c["cut"]
                own.value[2 * node + 1] = _weight(c["left_g"], c["left_n"], spec)
                own.value[2 * node + 2] = _weight(c["g"] - c["left_g"], c["n"] - c["left_n"], spec)
                split.add(c["model"])
        level += 1
        growing = {m: made[m] for m in split if level < models[m].spec.depth}
    return made


def _written(state: DataFrame, models: list[Ensemble], recent: dict[int, list[Tree]]) -> DataFrame:
    """The rows with the recent trees' values in their sums."""
    ddl, width = "tag long, label double, fold int, bins binary, sums array<double>", len(models[0].cuts)
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, _, _, bins, before = _read(b, width)
                # One tree after the other, as a pass in between adds them.
                after = np.array([sum((t.value[t.route(bins)] for t in recent[m]), x) for m, x in enumerate(before)])
                offsets = pa.array(np.arange(b.num_rows + 1) * len(after), pa.int32())
                sums = pa.ListArray.from_arrays(offsets, pa.array(after.T.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], sums.cast(schema.field(4).type)], schema=schema)

    return stored(state.mapInArrow(run, ddl), "boosted")


def stage_errors(state: DataFrame) -> DataFrame:
    """(model, fold, n, mae, rmse, r2) of the sums written so far."""
    each = state.select("fold", "label", F.posexplode("sums").alias("model", "predicted"))
    mae, rmse, r2 = error_columns(F.col("label"), F.col("predicted"))
    return each.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), mae.alias("mae"), rmse.alias("rmse"), r2.alias("r2"))


def fit_together(data: Binned, specs: list[Boosted], stages: list[int] | None = None) -> tuple[list[Ensemble], DataFrame]:
    """A model for each spec, and (trees, model, fold, n, mae, rmse, r2) after each number of trees in ``stages``.

    Models that have fewer trees than a stage stand in it as they ended.
    """
    totals = data.rows.filter(F.col("fold") != HELD_OUT).groupBy("fold").agg(F.sum("label").alias("s"), F.count("*").alias("n")).collect()

    def base(spec: Boosted) -> float:
        own = [r for r in totals if r["fold"] != spec.fold]
        return sum(r["s"] for r in own) / max(sum(r["n"] for r in own), 1)

    models = [Ensemble(s, base(s), data.features, data.cuts) for s in specs]
    start = F.array(*[F.lit(float(m.base)) for m in models])
    state = stored(data.rows.select("tag", "label", "fold", "bins", start.alias("sums")), "boosted")
    recent: dict[int, list[Tree]] = {m: [] for m in range(len(models))}
    most = max(s.trees for s in specs)
    stages = sorted(stages or [most])
    errors: DataFrame | None = None
    for tree in range(most):
        for m, made in _grow(state, models, recent, tree).items():
            recent[m].append(made)
            models[m].trees.append(made)
        if (tree + 1) % STORE_EVERY == 0 or tree + 1 in stages or tree + 1 == most:
            state = _written(state, models, recent)
            recent = {m: [] for m in recent}
        if tree + 1 in stages:
            now = stored(stage_errors(state).withColumn("trees", F.lit(tree + 1)), "stage")
            errors = now if errors is None else errors.unionByName(now)
    return models, errors


def predict(model: Ensemble, frame: DataFrame, name: str = "predicted") -> DataFrame:
    """The frame with the model's prediction."""
    schema = StructType(list(frame.schema.fields)).add(name, "double")
    out, places = to_arrow_schema(schema), [frame.columns.index(f) for f in model.features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = [b.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in places]
                bins = _cut(columns, model.cuts)
                value = sum((t.value[t.route(bins)] for t in model.trees), np.full(b.num_rows, model.base))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(value)], schema=out)

    return frame.mapInArrow(run, schema)
