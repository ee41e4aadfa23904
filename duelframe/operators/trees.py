"""Forests and boosted trees over binned features, each tree grown within one task.

Features become codes of 32 bins, one byte each, and every task gets the codes of all rows (12 features of a million rows
are 12 MB). A tree grows level by level from counts per node, feature and bin, as Spark ML's do: bins of equal counts,
features drawn for each node, gini, entropy or variance gain, bags of Poisson or Bernoulli counts, logistic loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions import numeric as N

BINS = 32
#: Nodes of a level that are counted at once.
NODES = 4096


def thresholds(df: DataFrame, features: list[str], medians: dict[str, float]) -> list[np.ndarray]:
    """Upper ends of all bins but the last, by quantiles of all rows."""
    shares = [i / BINS for i in range(1, BINS)]
    row = df.agg(*[F.percentile_approx(F.coalesce(N.real(F.col(f)), F.lit(medians[f])), shares, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(q or [], float)) for q in row]


def coded(x: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, i], "left").astype(np.uint8) for i, e in enumerate(ends)])


def codes(df: DataFrame, features: list[str], medians: dict[str, float], ends: list[np.ndarray], label: str) -> tuple[np.ndarray, np.ndarray]:
    """The codes and labels of all rows, on the driver."""
    rows = df.select(*[F.coalesce(N.real(F.col(f)), F.lit(medians[f])).alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([coded(x, ends).tobytes()], pa.binary()), pa.array([x[:, -1].astype(np.uint8).tobytes()], pa.binary())], names=["c", "y"])

    got = rows.mapInArrow(pack, "c binary, y binary").collect()
    x, y = (np.frombuffer(b"".join(bytes(r[i]) for r in got), np.uint8) for i in (0, 1))
    return x.reshape(-1, len(features)), y


#: Nodes in arrays (plain ones, which tasks can send): the feature that a node asks (-1 in a leaf), the last bin that goes
#: left, the left child, the value.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def values(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The value of each row's leaf."""
    feature, end, left, value = tree
    at, flat, base = np.zeros(len(x), np.int32), x.ravel(), np.arange(len(x)) * x.shape[1]
    rows = np.arange(len(x)) if feature[0] >= 0 else np.empty(0, int)
    while len(rows):
        node = at[rows]
        at[rows] = node = left[node] + (flat[base[rows] + feature[node]] > end[node])
        rows = rows[feature[node] >= 0]
    return value[at]


def _impurity(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    n = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(n > 0, a / n, 0.0)
        if kind == "gini":
            return 2 * p * (1 - p)
        q = 1 - p
        return -(np.where(p > 0, p * np.log2(p), 0.0) + np.where(q > 0, q * np.log2(q), 0.0))


def grow(x: np.ndarray, rows: np.ndarray, count: np.ndarray | None, target: np.ndarray, depth: int, per_node: int, least: int, kind: str, weights: tuple[float, float], draw: np.random.Generator, importance: np.ndarray) -> Tree:
    """A tree on ``rows`` of the codes, each ``count`` times (once without). ``target`` is a row's count of label 1 for
    "gini" and "entropy", or its sum for "variance"; a leaf's value is the share of label 1 by ``weights``, or the mean.
    Gains are added to ``importance``.
    """
    k, flat, base = x.shape[1], x.ravel(), rows * x.shape[1]
    node, first, parts, total = np.zeros(len(rows), np.int64), 0, [], None
    for level in range(depth + 1):
        n_nodes = 1 if level == 0 else int(total[0])
        n = np.bincount(node, count, n_nodes).astype(float)
        s = np.bincount(node, target, n_nodes)
        if kind == "variance":
            value = s / np.maximum(n, 1)
        else:
            w0, w1 = weights[0] * (n - s), weights[1] * s
            value = w1 / np.maximum(w0 + w1, 1e-300)
        feature, end, best = np.full(n_nodes, -1, np.int16), np.zeros(n_nodes, np.uint8), np.zeros(n_nodes)
        if level < depth:
            drawn = np.argsort(draw.random((n_nodes, k)), axis=1)[:, :per_node] if per_node < k else np.broadcast_to(np.arange(k), (n_nodes, k))
            order = np.argsort(node, kind="stable") if n_nodes > NODES else None
            for lo in range(0, n_nodes, NODES):
                hi = min(lo + NODES, n_nodes)
                if order is None:
                    own, at, c, t = node, base, count, target
                else:
                    a, b = np.searchsorted(node, [lo, hi], sorter=order)
                    part = order[a:b]
                    own, at, c, t = node[part] - lo, base[part], None if count is None else count[part], target[part]
                nn, ss = n[lo:hi, None], s[lo:hi, None]
                for j in range(drawn.shape[1]):
                    pick = drawn[lo:hi, j]
                    key = own * BINS + flat[at + pick[own]]
                    nl = np.bincount(key, c, (hi - lo) * BINS).reshape(-1, BINS).cumsum(axis=1)[:, :-1].astype(float)
                    sl = np.bincount(key, t, (hi - lo) * BINS).reshape(-1, BINS).cumsum(axis=1)[:, :-1]
                    nr, sr = nn - nl, ss - sl
                    with np.errstate(divide="ignore", invalid="ignore"):
                        if kind == "variance":
                            gain = (sl**2 / nl + sr**2 / nr - ss**2 / nn) / nn
                        else:
                            l0, l1, r0, r1 = weights[0] * (nl - sl), weights[1] * sl, weights[0] * (nr - sr), weights[1] * sr
                            wl, wr = l0 + l1, r0 + r1
                            gain = _impurity(l1 + r1, l0 + r0, kind) - (wl * _impurity(l1, l0, kind) + wr * _impurity(r1, r0, kind)) / (wl + wr)
                    gain = np.where((nl >= least) & (nr >= least) & (nl > 0) & (nr > 0), gain, 0.0)
                    top = gain.argmax(axis=1)
                    g = gain[np.arange(hi - lo), top]
                    better = g > np.maximum(best[lo:hi], 1e-15)
                    best[lo:hi][better], feature[lo:hi][better], end[lo:hi][better] = g[better], pick[better], top[better]
        split = feature >= 0
        left = np.where(split, first + n_nodes + 2 * (np.cumsum(split) - 1), -1).astype(np.int32)
        parts.append((feature, end, left, value))
        if not split.any():
            break
        np.add.at(importance, feature[split], best[split] * n[split])
        stay = split[node]
        if not stay.all():
            node, base, target = node[stay], base[stay], target[stay]
            count = None if count is None else count[stay]
        node = left[node] - (first + n_nodes) + (flat[base + feature[node]] > end[node])
        first, total = first + n_nodes, np.array([2 * int(split.sum())])
    return tuple(np.concatenate(c) for c in zip(*parts))


def forest_tree(x: np.ndarray, y: np.ndarray, i: int, seed: int, s: dict, per_node: int, importance: np.ndarray) -> Tree:
    """Tree ``i`` of a forest: a bag of Poisson counts; ``s`` are Spark ML's settings and ``class_weight``."""
    draw = np.random.default_rng([seed, i])
    count = draw.poisson(s["subsamplingRate"], len(x))
    rows = np.flatnonzero(count)
    count = count[rows].astype(float)
    ones = int((y == 1).sum())
    weights = (len(y) / (2 * max(len(y) - ones, 1)), len(y) / (2 * max(ones, 1))) if s["class_weight"] else (1.0, 1.0)
    own = np.zeros(len(importance))
    tree = grow(x, rows, count, count * y[rows], s["maxDepth"], per_node, s["minInstancesPerNode"], s["impurity"], weights, draw, own)
    importance += own / own.sum() if own.sum() else 0.0
    return tree


def boosted_trees(x: np.ndarray, y: np.ndarray, seed: int, s: dict, per_node: int, importance: np.ndarray) -> Iterator[tuple[float, Tree]]:
    """The trees of a boosted model with their weights: each fits the negative slope of the logistic loss of twice the sum."""
    sign, margin = 2.0 * y - 1.0, np.zeros(len(x))
    for i in range(s["maxIter"]):
        draw = np.random.default_rng([seed, i])
        rate = s["subsamplingRate"]
        rows = np.arange(len(x)) if rate >= 1 else np.flatnonzero(draw.random(len(x)) < rate)
        residual = sign if i == 0 else 4 * sign / (1 + np.exp(2 * sign * margin))
        own = np.zeros(len(importance))
        tree = grow(x, rows, None, residual[rows], s["maxDepth"], per_node, s["minInstancesPerNode"], "variance", (1.0, 1.0), draw, own)
        weight = 1.0 if i == 0 else s["stepSize"]
        importance += own / own.sum() if own.sum() else 0.0
        margin += weight * values(tree, x)
        yield weight, tree


def in_tasks(spark: SparkSession, work, tasks: list) -> list:
    """What ``work`` makes of each of ``tasks`` (pickled), each in a Spark task, in their order."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(work(tasks[i]))], pa.binary())], names=["i", "r"])

    rows = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, "i bigint, r binary").collect()
    return [pickle.loads(bytes(r.r)) for r in sorted(rows, key=lambda r: r.i)]
