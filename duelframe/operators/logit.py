"""Elastic-net logistic regressions of many feature sets over one table, solved together.

The table's features are packed once into blocks of doubles. Medians, scales and every Newton step are a pass over the
blocks in which each block adds counts or a gradient and Hessian of each set; a pass serves all sets, and a set that has
converged is left out of the next. The driver holds a matrix of features by features for each set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions import numeric as N

#: Rows of a block.
BLOCK = 16_384
#: The largest slope that counts as none, of a mean log loss on scaled features.
TOLERANCE = 1e-9


class Blocks:
    """The features of a table (missing ones are NaN) and its label, in blocks of a matrix."""

    def __init__(self, df: DataFrame, features: list[str], label: str):
        self.features, width = list(features), len(features) + 1
        rows = df.select(*[N.real(F.col(f)).alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def block() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["x"])

            for batch in batches:
                if batch.num_rows:
                    held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
                    n += batch.num_rows
                if n >= BLOCK:
                    yield block()
                    held, n = [], 0
            if held:
                yield block()

        self.width = width
        self.table = rows.mapInArrow(pack, "x binary").persist(StorageLevel.MEMORY_AND_DISK)

    def each(self, work: Callable[[np.ndarray], object], schema: str, rows: Callable[[list], pa.RecordBatch]) -> DataFrame:
        """``rows`` of what ``work`` makes of the blocks of a partition."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column(0):
                    yield rows(work(np.frombuffer(x.as_buffer(), float).reshape(-1, width)))

        return self.table.mapInArrow(run, schema)

    def total(self, work: Callable[[np.ndarray], list[np.ndarray]], merge: Callable[[list, list], list] | None = None) -> list[np.ndarray] | None:
        """The arrays that ``work`` makes of each block, added up (or merged): first in the tasks, then on the driver."""
        width, merge = self.width, merge or (lambda a, b: [p + q for p, q in zip(a, b)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                for x in batch.column(0):
                    found = work(np.frombuffer(x.as_buffer(), float).reshape(-1, width))
                    held = found if held is None else merge(held, found)
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([[np.ascontiguousarray(a, float).tobytes() for a in held]], pa.list_(pa.binary()))], names=["a"])

        out = None
        for r in self.table.mapInArrow(run, "a array<binary>").collect():
            found = [np.frombuffer(a, float) for a in r.a]
            out = found if out is None else merge(out, found)
        return out

    def medians(self) -> np.ndarray:
        """The median of each feature, NaN where it has no value: digits of the values' ordered bits, from the highest on."""
        k = self.width - 1
        prefixes: list[dict[int, list[int]]] = []  # of each feature: known bits -> ranks looked for among the values with them
        known = 0
        for bits in (16, 12, 12, 12, 12):
            shift, wanted = 64 - known - bits, [sorted(p) for p in prefixes]

            def count(x: np.ndarray, first: bool = not known, known: int = known, shift: int = shift, bits: int = bits, wanted: list = wanted) -> pa.RecordBatch:
                feature, prefix, digit, n = [], [], [], []
                for i in range(k):
                    v = np.ascontiguousarray(x[:, i])
                    v = v[~np.isnan(v)] + 0.0  # no negative zero
                    b = v.view(np.uint64)
                    b = np.where(b >> np.uint64(63), ~b, b | np.uint64(1 << 63))
                    for p in [0] if first else wanted[i]:
                        own = b if first else b[b >> np.uint64(64 - known) == np.uint64(p)]
                        d, c = np.unique((own >> np.uint64(shift)) & np.uint64((1 << bits) - 1), return_counts=True)
                        feature.append(np.full(len(d), i)), prefix.append(np.full(len(d), p, np.uint64)), digit.append(d.astype(np.int64)), n.append(c)
                whole = lambda a, t: np.concatenate(a).astype(t)
                return pa.RecordBatch.from_arrays([pa.array(whole(feature, np.int64)), pa.array(whole(prefix, np.int64)), pa.array(whole(digit, np.int64)), pa.array(whole(n, np.int64))], names=["f", "p", "d", "n"])

            counts = self.each(count, "f bigint, p bigint, d bigint, n bigint", lambda b: b).groupBy("f", "p", "d").agg(F.sum("n").alias("n")).toPandas()
            found = [{} for _ in range(k)]
            for (f, p), part in counts.sort_values("d").groupby(["f", "p"]):
                ends = part["n"].cumsum().to_numpy()
                ranks = prefixes[f][p] if known else [(ends[-1] - 1) // 2, ends[-1] // 2]
                for r in ranks:
                    j = int(np.searchsorted(ends, r, "right"))
                    found[f].setdefault(int(p) << bits | int(part["d"].iloc[j]), []).append(r - (ends[j - 1] if j else 0))
            prefixes, known = found, known + bits
        out = np.full(k, np.nan)
        for i, p in enumerate(prefixes):
            values = [x ^ (1 << 63) if x >> 63 else ~x & (1 << 64) - 1 for x in p]
            if values:
                out[i] = np.array(values, np.uint64).view(float).mean()
        return out

    def moments(self, medians: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Rows, rows with label 1, and the mean and population deviation of each feature once medians are filled in."""

        def work(x: np.ndarray) -> list[np.ndarray]:
            v = filled(x[:, :-1], medians)
            mean = v.mean(axis=0)
            return [np.array([len(v), np.sum(x[:, -1] == 1), np.sum((x[:, -1] != 1) & (x[:, -1] != 0))], float), mean, ((v - mean) ** 2).sum(axis=0)]

        def merge(a: list, b: list) -> list:
            n, m = a[0][0], b[0][0]
            gap = b[1] - a[1]
            return [a[0] + b[0], a[1] + gap * m / (n + m), a[2] + b[2] + gap**2 * n * m / (n + m)]

        got = self.total(work, merge)
        if got is None:
            raise ValueError("no rows to fit")
        if got[0][2]:
            raise ValueError("labels must be 0 or 1")
        return int(got[0][0]), int(got[0][1]), got[1], np.sqrt(got[2] / got[0][0])

    def free(self) -> None:
        self.table.unpersist()


def filled(x: np.ndarray, medians: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), medians, x)


def scaled(x: np.ndarray, medians: np.ndarray, means: np.ndarray, deviations: np.ndarray) -> np.ndarray:
    """Features that don't vary are 0."""
    vary = deviations > 0
    return np.where(vary, (filled(x, medians) - means) / np.where(vary, deviations, 1.0), 0.0)


def sparse_quadratic(h: np.ndarray, g: np.ndarray, penalty: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The least of x'hx/2 + g'x + sum(penalty |x|), by search over the signs from ``x`` on."""
    value = lambda v: v @ h @ v / 2 + g @ v + penalty @ np.abs(v)
    x, free = x.copy(), penalty == 0
    sign, slack = np.sign(x), 1e-12 * max(1.0, np.abs(g).max())
    for _ in range(50 * len(x) + 50):
        on = free | (sign != 0)
        slope = h @ x + g
        if np.all(np.abs(slope + penalty * sign)[on] <= slack):
            more = np.where(on, 0.0, np.abs(slope) - penalty)
            i = int(more.argmax())
            if more[i] <= slack:
                break
            sign[i], on[i] = -np.sign(slope[i]), True
        a = np.flatnonzero(on)
        goal = x.copy()
        goal[a] = np.linalg.lstsq(h[np.ix_(a, a)], -(g + penalty * sign)[a], rcond=1e-15)[0]
        step = goal - x
        with np.errstate(divide="ignore", invalid="ignore"):
            at = np.where(~free & (x != 0) & (np.sign(goal) != np.sign(x)), -x / step, 2.0)
        best, least = None, np.inf
        for t in sorted({1.0, *at[(at > 0) & (at < 1)]}):
            v = x + t * step
            v[at == t] = 0.0
            if (now := value(v)) < least:
                best, least = v, now
        if least >= value(x) - 1e-16 * abs(value(x)):
            break
        x = best
        sign = np.sign(x)
    return x


@dataclass
class Problem:
    """One set of features with its penalty; ``at`` is where the next pass looks: the intercept, then the coefficients."""

    columns: list[int]
    penalty: float
    l1_ratio: float
    most: int
    at: np.ndarray = field(init=False)
    done: bool = False

    def __post_init__(self):
        k = len(self.columns) + 1
        self.at, self.best, self.least, self.passes = np.zeros(k), np.zeros(k), np.inf, 0
        weight = np.concatenate([[0.0], np.ones(k - 1)]) * self.penalty
        self.l1, self.l2 = weight * self.l1_ratio, weight * (1 - self.l1_ratio)

    def take(self, loss: float, g: np.ndarray, h: np.ndarray) -> None:
        """The loss, its gradient and Hessian at ``at``: goes on to the next point, or back where the step was too long."""
        now = loss + self.l1 @ np.abs(self.at) + self.l2 @ self.at**2 / 2
        self.passes += 1
        if self.least < np.inf and not now <= self.least + 1e-4 * self.size * self.gain + 1e-15:
            self.size /= 2
            self.done = self.size < 1e-6 or self.passes >= self.most
            self.at = self.best + self.size * self.step
            return
        self.best, self.least = self.at, now
        slope = g + self.l2 * self.at
        off = np.where(self.at != 0, np.abs(slope + self.l1 * np.sign(self.at)), np.maximum(np.abs(slope) - self.l1, 0.0))
        self.done = off.max() <= TOLERANCE or self.passes >= self.most
        curve = h + np.diag(self.l2)
        goal = sparse_quadratic(curve, slope - curve @ self.at, self.l1, self.at)
        self.step, self.size = goal - self.at, 1.0
        self.gain = slope @ self.step + self.l1 @ (np.abs(goal) - np.abs(self.at))
        if self.gain > -1e-16:
            self.done = True
        self.at = goal


def solve(blocks: Blocks, medians: np.ndarray, means: np.ndarray, deviations: np.ndarray, problems: list[Problem], n: int, positive: int) -> list[np.ndarray]:
    """Intercept and coefficients of each problem on scaled features."""
    if positive in (0, n):  # one class only
        return [np.concatenate([[np.inf if positive else -np.inf], np.zeros(len(p.columns))]) for p in problems]
    for p in problems:
        p.at[0] = np.log(positive / (n - positive))
    while waiting := [p for p in problems if not p.done]:
        points = [(p.columns, p.at) for p in waiting]

        def work(x: np.ndarray, points: list = points) -> list[np.ndarray]:
            z, y, out = scaled(x[:, :-1], medians, means, deviations), x[:, -1], []
            for columns, at in points:
                v = np.empty((len(z), len(columns) + 1))
                v[:, 0], v[:, 1:] = 1.0, z[:, columns]
                m = v @ at
                p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
                out += [np.array([np.sum(np.logaddexp(0, m) - y * m)]), v.T @ (p - y), (v.T @ (v * (p * (1 - p))[:, None])).ravel()]
            return out

        got = blocks.total(work)
        for i, p in enumerate(waiting):
            k = len(p.at)
            p.take(got[3 * i][0] / n, got[3 * i + 1] / n, got[3 * i + 2].reshape(k, k) / n)
    return [p.best for p in problems]


def probabilities(blocks: Blocks, medians: np.ndarray, means: np.ndarray, deviations: np.ndarray, points: list[tuple[list[int], np.ndarray]]) -> DataFrame:
    """``setting, label, p`` of every row of the blocks under each point's columns and coefficients."""

    def work(x: np.ndarray) -> pa.RecordBatch:
        z, y = scaled(x[:, :-1], medians, means, deviations), x[:, -1].astype(np.int32)
        with np.errstate(over="ignore"):
            p = [1 / (1 + np.exp(-(at[0] + z[:, columns] @ at[1:]))) for columns, at in points]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(points), dtype=np.int32), len(y))), pa.array(np.tile(y, len(points))), pa.array(np.concatenate(p))], names=["setting", "label", "p"])

    return blocks.each(work, "setting int, label int, p double", lambda b: b)
