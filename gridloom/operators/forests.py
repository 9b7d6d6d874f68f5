"""Forests as arrays: extremely randomised trees grown level by level, and scoring in one pass.

A forest is a set of heaps: node i has the children 2i + 1 and 2i + 2, a leaf has feature -1. It has
as many bytes as trees, nodes and outputs ask for, however many rows it was grown on.

`extra_trees` grows the trees of one model, or of one model for each held-out group, together. Rows stay
where they are. At each level a task finds every row's node in every tree, and what leaves it are
aggregates: the ends of each feature in each open node, then, for one threshold drawn between these ends
for each of `max_features` features, the weights left of it. Spark sums both over tasks; the driver gets sums for
(tree, node, feature), whose number the model bounds, and chooses the splits.

Bootstrap counts are Poisson(1) by a keyed hash of (tree, row key), so that no rows are drawn or
moved and a lost task counts alike when it runs again. `balanced` weighs classes by n / (k n_c) of
each tree's own bootstrap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.cluster import ship_package
from gridloom.functions.sized import stored

MASK = (1 << 32) - 1
#: Values of a 32-bit hash from which on a Poisson(1) count is at least 1, 2, ...
POISSON = tuple(int(c * 2**32) for c in accumulate(exp(-1) / factorial(k) for k in range(12)))
#: Bytes that the sums of a task may take; more trees are grown in several rounds.
ROUND_BYTES = 64 << 20
#: Bytes of models that are broadcast at once.
MODEL_BYTES = 256 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of numbers below 2^32 (as unsigned 64-bit)."""
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(73244475)) & np.uint64(MASK)
    return x ^ (x >> np.uint64(16))


def keyed(seed: int, *parts: int | np.ndarray) -> np.ndarray:
    """A 32-bit hash of the parts in their order (integers; 64 bits of each count)."""
    h = np.uint64(seed & MASK)
    for part in parts:
        x = np.asarray(part, dtype=np.int64).astype(np.uint64)
        for half in (x & np.uint64(MASK), x >> np.uint64(32)):
            h = mix((h * np.uint64(31) + half + np.uint64(1)) & np.uint64(MASK))
    return h


def keyed_column(seed: int, *parts: Column) -> Column:
    """`keyed` as an expression."""

    def mixed(x: Column) -> Column:
        step = lambda x: ((x.bitwiseXOR(F.shiftrightunsigned(x, 16))) * 73244475).bitwiseAND(MASK)
        return F.element_at(F.transform(F.transform(F.transform(F.array(x), step), step), lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 16))), 1)

    halves = [h for p in parts for h in (p.cast("bigint").bitwiseAND(MASK), F.shiftrightunsigned(p.cast("bigint"), 32))]
    return reduce(lambda h, half: mixed((h * 31 + half + 1).bitwiseAND(MASK)), halves, F.lit(seed & MASK).cast("bigint"))


def bootstrap_count(seed: int, tree: Column, key: Column) -> Column:
    """How often the bootstrap of a tree has a row: Poisson(1)."""
    h = keyed_column(seed, tree, key)
    return F.element_at(F.transform(F.array(h), lambda h: reduce(lambda s, c: s + (h >= c).cast("int"), POISSON, F.lit(0))), 1)


def balanced_weights(rows: DataFrame, seed: int = 0, tree: str = "tree", key: str = "key", target: str = "target") -> DataFrame:
    """rows (tree, key, target) with n (the row's bootstrap count) and weight: n_tree / (k n_class) of the
    tree's bootstrap, of k classes that it has; null where the class is not in it."""
    drawn = rows.withColumn("n", bootstrap_count(seed, F.col(tree), F.col(key)))
    by_class = drawn.groupBy(tree, target).agg(F.sum("n").alias("n_class")).where("n_class > 0")
    of_tree = Window.partitionBy(tree)
    weights = by_class.select(tree, target, (F.sum("n_class").over(of_tree) / (F.count("*").over(of_tree) * F.col("n_class"))).alias("weight"))
    return drawn.join(weights, [tree, target], "left")


@dataclass(frozen=True)
class Forest:
    """trees x nodes arrays of feature and threshold, and trees x nodes x outputs of values: class shares, or one mean."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    features: tuple[str, ...]
    classes: tuple[float, ...] | None = None

    @property
    def nbytes(self) -> int:
        return self.feature.nbytes + self.threshold.nbytes + self.value.nbytes

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """rows x outputs: the trees' mean."""
        node, tree = self.nodes(x), np.arange(len(self.feature))
        return self.value[tree, node].mean(axis=1) if len(x) else np.empty((0, self.value.shape[2]))

    def nodes(self, x: np.ndarray, trees: slice = slice(None)) -> np.ndarray:
        """rows x trees: the leaf of each row."""
        feature, threshold = self.feature[trees], self.threshold[trees]
        tree, row = np.arange(len(feature)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(feature)), np.int64)
        for _ in range(int(feature.shape[1] + 1).bit_length() - 2):
            f = feature[tree, node]
            right = x[row, np.maximum(f, 0)] > threshold[tree, node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def predictions(self, outputs: np.ndarray) -> np.ndarray:
        return outputs[:, 0] if self.classes is None else np.asarray(self.classes)[outputs.argmax(axis=1)] if len(outputs) else np.empty(0)


def from_spark(model, features: Sequence[str]) -> Forest:
    """A regression forest of Spark ML as arrays."""
    lines = [line.strip() for line in model.toDebugString.split("\n")[1:]]
    trees: list[dict[int, tuple]] = []
    stack: list[int] = []
    for line in lines:
        if line.startswith("Tree "):
            trees.append({})
            stack = [0]
        elif line.startswith("If "):
            name, bound = line[len("If (feature ") : -1].split(" <= ")
            at = stack.pop()
            trees[-1][at] = (int(name), float(bound), 0.0)
            stack += [2 * at + 2, 2 * at + 1]
        elif line.startswith("Predict: "):
            trees[-1][stack.pop()] = (-1, 0.0, float(line[len("Predict: ") :]))
    size = (1 << (max(max(t) + 1 for t in trees)).bit_length()) - 1
    feature, threshold, value = np.full((len(trees), size), -1, np.int32), np.zeros((len(trees), size)), np.zeros((len(trees), size, 1))
    for k, tree in enumerate(trees):
        for at, (f, bound, v) in tree.items():
            feature[k, at], threshold[k, at], value[k, at, 0] = f, bound, v
    return Forest(feature, threshold, value, tuple(features))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _sums(arrays: dict[str, np.ndarray], kinds: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32() if k == "int" else pa.float64()) for a, k in zip(arrays.values(), kinds, strict=True)], names=list(arrays))


class _Rows:
    """The rows of a batch as the trees see them."""

    def __init__(self, batch: pa.RecordBatch, state: dict):
        self.x = _matrix(batch, state["width"])
        self.y = batch.column("y").to_numpy(zero_copy_only=False)
        self.key = batch.column("key").to_numpy(zero_copy_only=False)
        self.group = batch.column("g").to_numpy(zero_copy_only=False)
        self.state = state

    def of(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of a tree's bootstrap, their counts)."""
        count = np.searchsorted(np.asarray(POISSON, np.uint64), keyed(self.state["seed"], tree, self.key), side="right")
        count[self.group == tree // self.state["per_group"]] = 0
        at = np.flatnonzero(count)
        return at, count[at]

    def stats(self, at: np.ndarray, count: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
        """Sums of the rows of each slot: counts of classes, or n, sum and sum of squares of the target."""
        y, k = self.y[at], self.state["classes"]
        if k is not None:
            return np.bincount(slot * len(k) + np.searchsorted(k, y), weights=count, minlength=slots * len(k)).reshape(slots, len(k))
        return np.column_stack([np.bincount(slot, weights=count * v, minlength=slots) for v in (1.0, y, y * y)])


def _aggregate(table: DataFrame, state: dict, schema: str, make) -> DataFrame:
    """Rows that `make` gives once for each task, from a function that it gets for each batch."""
    shared = table.sparkSession.sparkContext.broadcast(state)
    kinds = [c.split(" ")[1] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, done = make(shared.value)
        for batch in batches:
            if batch.num_rows:
                add(_Rows(batch, shared.value))
        yield _sums(done(), kinds)

    return table.mapInArrow(run, schema)


def _root(state: dict):
    trees, width = state["trees"], state["stats"]
    total = np.zeros((len(trees), width))

    def add(rows: _Rows) -> None:
        for k, tree in enumerate(trees):
            at, count = rows.of(tree)
            total[k] += rows.stats(at, count, np.zeros(len(at), np.int64), 1)[0]

    return add, lambda: {"tree": np.arange(len(trees))} | {f"s{j}": total[:, j] for j in range(width)}


def _open(rows: _Rows, state: dict, k: int, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, counts, slot among the level's nodes) of the rows that stand at open nodes of a tree."""
    at, count = rows.of(tree)
    slot = state["forest"].nodes(rows.x[at], slice(k, k + 1))[:, 0] - state["first"]
    inside = np.flatnonzero(slot >= 0)
    inside = inside[state["open"][k, slot[inside]]]
    return at[inside], count[inside], slot[inside]


def _ends(state: dict):
    trees, slots, width = state["trees"], state["open"].shape[1], state["width"]
    low, high = np.full((len(trees), slots, width), np.inf), np.full((len(trees), slots, width), -np.inf)

    def add(rows: _Rows) -> None:
        for k, tree in enumerate(trees):
            at, _, slot = _open(rows, state, k, tree)
            order = np.argsort(slot, kind="stable")
            found, begin = np.unique(slot[order], return_index=True)
            if len(found):
                x = rows.x[at[order]]
                low[k, found] = np.minimum(low[k, found], np.minimum.reduceat(x, begin, axis=0))
                high[k, found] = np.maximum(high[k, found], np.maximum.reduceat(x, begin, axis=0))

    def done() -> dict[str, np.ndarray]:
        tree, slot, feature = np.nonzero(low <= high)
        return {"tree": tree, "slot": slot, "feature": feature, "low": low[tree, slot, feature], "high": high[tree, slot, feature]}

    return add, done


def _left(state: dict):
    trees, (feature, threshold), width = state["trees"], state["tried"], state["stats"]
    slots, tries = feature.shape[1:]
    total = np.zeros((len(trees), slots, tries, width))

    def add(rows: _Rows) -> None:
        for k, tree in enumerate(trees):
            at, count, slot = _open(rows, state, k, tree)
            for m in range(tries):
                f = feature[k, slot, m]
                left = np.flatnonzero((f >= 0) & (rows.x[at, np.maximum(f, 0)] <= threshold[k, slot, m]))
                total[k, :, m] += rows.stats(at[left], count[left], slot[left], slots)

    def done() -> dict[str, np.ndarray]:
        tree, slot, m = np.nonzero(feature >= 0)
        return {"tree": tree, "slot": slot, "m": m} | {f"s{j}": total[tree, slot, m, j] for j in range(width)}

    return add, done


def _impurity(stats: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(weight, weight times impurity) of nodes: Gini's, or the sum of squared deviations."""
    if weights is None:
        n = stats[..., 0]
        return n, stats[..., 2] - stats[..., 1] ** 2 / np.maximum(n, 1e-300)
    w = stats * weights
    n = w.sum(axis=-1)
    return n, n - (w * w).sum(axis=-1) / np.maximum(n, 1e-300)


def _grow(table: DataFrame, state: dict, tries: int, depth: int, balanced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """feature, threshold and value of the trees that state names."""
    trees, seed, k = state["trees"], state["seed"], state["classes"]
    nodes, width = (2 << depth) - 1, state["stats"]
    feature, threshold, stats = np.full((len(trees), nodes), -1, np.int32), np.zeros((len(trees), nodes)), np.zeros((len(trees), nodes, width))
    names = [f"s{j}" for j in range(width)]
    sums = lambda keys, df: df.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in names]).toArrow()  # noqa: E731  # bounded by trees, nodes and features
    got = sums(["tree"], _aggregate(table, state, ", ".join(["tree int", *(f"{s} double" for s in names)]), _root))
    stats[got.column("tree").to_numpy(), 0] = np.column_stack([got.column(s).to_numpy() for s in names])
    weights = None
    if k is not None:
        weights = np.ones((len(trees), len(k)))
        if balanced:
            n = stats[:, 0]
            weights = n.sum(axis=1, keepdims=True) / np.maximum((n > 0).sum(axis=1, keepdims=True) * n, 1e-300) * (n > 0)
    for level in range(depth):
        first = (1 << level) - 1
        here = stats[:, first : 2 * first + 1]
        weight, impure = _impurity(here, None if weights is None else weights[:, None])
        size = here.sum(axis=2) if k is not None else here[..., 0]
        reached = np.ones((len(trees), 1), bool) if level == 0 else np.repeat(feature[:, (first - 1) // 2 : first] >= 0, 2, axis=1)
        state |= {"open": reached & (size >= 2) & (impure > 1e-9 * weight), "first": first, "forest": Forest(feature, threshold, stats[:, :, :1], ())}
        if not state["open"].any():
            break
        ends = _aggregate(table, state, "tree int, slot int, feature int, low double, high double", _ends).groupBy("tree", "slot", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
        names_of = F.get(F.array(*[F.lit(t) for t in trees]), F.col("tree"))
        ends = ends.withColumn("h", keyed_column(seed + 1, names_of, F.col("slot") + first, F.col("feature")))
        chosen = ends.withColumn("m", F.row_number().over(Window.partitionBy("tree", "slot").orderBy("h", "feature")) - 1).where(F.col("m") < tries).toArrow()
        c = {n: chosen.column(n).to_numpy() for n in chosen.column_names}
        f, t = np.full((len(trees), state["open"].shape[1], tries), -1, np.int32), np.zeros((len(trees), state["open"].shape[1], tries))
        share = keyed(seed + 2, np.asarray(trees)[c["tree"]], c["slot"] + first, c["feature"]) / 2.0**32
        f[c["tree"], c["slot"], c["m"]] = c["feature"]
        t[c["tree"], c["slot"], c["m"]] = c["low"] + share * (c["high"] - c["low"])
        state["tried"] = (f, t)
        got = sums(["tree", "slot", "m"], _aggregate(table, state, ", ".join(["tree int", "slot int", "m int", *(f"{s} double" for s in names)]), _left))
        left = np.zeros((*f.shape, width))
        left[got.column("tree").to_numpy(), got.column("slot").to_numpy(), got.column("m").to_numpy()] = np.column_stack([got.column(s).to_numpy() for s in names])
        right = here[:, :, None] - left
        own = None if weights is None else weights[:, None, None]
        gain = impure[:, :, None] - _impurity(left, own)[1] - _impurity(right, own)[1]
        gain[f < 0] = -np.inf
        best = np.lexsort((f, -gain), axis=-1)[..., 0]
        at = np.ix_(range(len(trees)), range(f.shape[1]))
        tree, slot = np.nonzero(f[(*at, best)] >= 0)
        m, node = best[tree, slot], slot + first
        feature[tree, node], threshold[tree, node] = f[tree, slot, m], t[tree, slot, m]
        stats[tree, 2 * node + 1], stats[tree, 2 * node + 2] = left[tree, slot, m], right[tree, slot, m]
        state.pop("tried")
    if k is None:
        return feature, threshold, (stats[..., 1] / np.maximum(stats[..., 0], 1e-300))[..., None]
    shares = stats * weights[:, None]
    return feature, threshold, shares / np.maximum(shares.sum(axis=2, keepdims=True), 1e-300)


def extra_trees(
    rows: DataFrame, features: Sequence[str], classes: bool = True, trees: int = 100, depth: int = 5, seed: int = 0, max_features: int | None = None, balanced: bool = False,
    hold_out: str | None = None, key: str = "key", target: str = "target",
) -> dict:
    """{held-out value (None without hold_out): Forest}. Rows need an integer key, a target and all
    features; by default classes try the square root of the number of features at a node, means all."""
    width = len(features)
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    table = rows.select(F.col(key).cast("bigint").alias("key"), F.col(target).cast("double").alias("y"), x.alias("x"), (F.col(hold_out) if hold_out else F.lit(0)).alias("group"))
    ship_package(rows.sparkSession)
    table = stored(table, "extra-trees")
    groups = sorted(r[0] for r in table.select("group").distinct().collect()) if hold_out else [None]
    known = np.array(sorted(r[0] for r in table.select("y").distinct().collect())) if classes else None
    number = F.lit(-1) if not hold_out else reduce(lambda out, i: F.when(F.col("group") == groups[i], i).otherwise(out), range(len(groups)), F.lit(-1))
    table = table.select("key", "y", "x", number.cast("int").alias("g"))
    tries = min(width, max_features or (max(1, int(width**0.5)) if classes else width))
    stats = len(known) if classes else 3
    at_once = max(1, ROUND_BYTES // ((1 << max(depth - 1, 0)) * 8 * max(2 * width, tries * stats)))
    every, parts = list(range(len(groups) * trees)), []
    for k in range(0, len(every), at_once):
        state = {"trees": every[k : k + at_once], "per_group": trees, "seed": seed, "classes": known, "stats": stats, "width": width}
        parts.append(_grow(table, state, tries, depth, balanced))
    feature, threshold, value = (np.concatenate(a) for a in zip(*parts, strict=True))
    names = None if known is None else tuple(known.tolist())
    return {g: Forest(feature[i * trees : (i + 1) * trees], threshold[i * trees : (i + 1) * trees], value[i * trees : (i + 1) * trees], tuple(features), names) for i, g in enumerate(groups)}


def score(table: DataFrame, forests: dict, keep: Sequence[str], group: str, model_col: str = "model") -> DataFrame:
    """The columns `keep` of each row (x: its features), with model_col and prediction, once for each model of the
    row's group; forests are {group: [(model, Forest)]}. One pass without a shuffle; models beyond
    `MODEL_BYTES` are broadcast in rounds, each over the rows of its own groups."""
    rounds: list[dict] = [{}]
    size = 0
    for g in sorted(forests):
        own = sum(f.nbytes for _, f in forests[g])
        if rounds[-1] and size + own > MODEL_BYTES:
            rounds.append({})
            size = 0
        rounds[-1][g] = forests[g]
        size += own
    ship_package(table.sparkSession)
    kinds = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep)

    def one(models: dict) -> DataFrame:
        shared = table.sparkSession.sparkContext.broadcast(models)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(group).to_numpy(zero_copy_only=False)
                for g in np.unique(own).tolist():
                    part = batch.filter(pa.array(own == g))
                    for model, forest in shared.value.get(g, ()):
                        outputs = forest.outputs(_matrix(part, len(forest.features)))
                        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array([model] * part.num_rows, pa.int32()), pa.array(forest.predictions(outputs), pa.float64())], names=[*keep, model_col, "prediction"])

        rows = table.where(F.col(group).isin(list(models))).select(*dict.fromkeys([*keep, group, "x"]))
        return rows.mapInArrow(run, f"{kinds}, {model_col} int, prediction double")

    return reduce(DataFrame.unionByName, [one(r) for r in rounds])


def with_prediction(forest: Forest, table: DataFrame, prediction: str = "prediction", probability: str | None = None) -> DataFrame:
    """table (x: its features, or null) with the prediction, and the classes' probabilities; null where x is. x goes."""
    kept = [c for c in table.columns if c != "x"]
    ship_package(table.sparkSession)
    shared = table.sparkSession.sparkContext.broadcast(forest)
    schema = ", ".join([*(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in kept), f"`{prediction}` double", *([f"`{probability}` array<double>"] if probability else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = np.asarray(batch.column("x").is_valid())
            outputs = shared.value.outputs(_matrix(batch.filter(pa.array(have)), len(shared.value.features)))
            place = pa.array(np.where(have, np.cumsum(have) - 1, -1))
            place = pa.array([None if p < 0 else p for p in place.to_pylist()], pa.int64())
            new = [pa.array(shared.value.predictions(outputs), pa.float64()).take(place)]
            if probability:
                new.append(pa.array(list(outputs), pa.list_(pa.float64())).take(place))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=[*kept, prediction, *([probability] if probability else [])])

    return table.select(*[F.col(f"`{c}`") for c in [*kept, "x"]]).mapInArrow(run, schema)
