"""Probability models, calibration and selection on Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from multiprocessing.pool import ThreadPool
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark import SparkContext
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions import numeric as N
from duelframe.operators import logit as L
from duelframe.operators import metrics as M
from duelframe.operators import trees as T
from duelframe.runtime import checkpoint

#: The final models' settings and the spaces that the searches draw from.
LOGISTIC = {"C": 10.0, "l1_ratio": 0.8, "max_iter": 5000}
FOREST = {"numTrees": 800, "maxDepth": 12, "featureSubsetStrategy": "0.3", "minInstancesPerNode": 1, "subsamplingRate": 1.0, "impurity": "entropy", "class_weight": "balanced"}
BOOST = {"maxIter": 300, "maxDepth": 2, "stepSize": 0.01, "subsamplingRate": 0.85, "minInstancesPerNode": 5}
#: The searches' spaces are the reference's, as far as Spark ML has them: 30 is its deepest tree, "entropy" is also the
#: reference's "log_loss", "balanced" its "balanced_subsample". There is no least size of a split node (forest) and no
#: reg_lambda and reg_alpha (boost); features are drawn for each node, not for each boosted tree.
FOREST_SPACE = {"numTrees": (200, 300, 500, 800, 1200), "maxDepth": (2, 3, 4, 5, 6, 8, 10, 12, 15, 30), "minInstancesPerNode": (1, 2, 5, 10, 20, 40), "featureSubsetStrategy": ("sqrt", "log2", "0.3", "0.5", "0.7", "all"), "impurity": ("gini", "entropy", "entropy"), "class_weight": (None, "balanced", "balanced")}
BOOST_SPACE = {"maxIter": (100, 300, 500), "maxDepth": (2, 3, 4, 5), "stepSize": (0.01, 0.03, 0.05, 0.1), "subsamplingRate": (0.7, 0.85, 1.0), "featureSubsetStrategy": ("0.7", "0.85", "all"), "minInstancesPerNode": (1, 3, 5)}
#: Models of a family other than the logistic that are fitted at once.
AT_ONCE = 3
#: Values of a table up to which trees are grown within one task each; above, Spark ML grows them over all tasks.
IN_TASK = 100_000_000


class Scaler:
    """Median filling and scaling to mean 0, population deviation 1, all learned from one table in two aggregates."""

    def __init__(self, medians: dict[str, float], means: dict[str, float], deviations: dict[str, float]):
        self.medians, self.means, self.deviations = medians, means, deviations

    @classmethod
    def fit(cls, df: DataFrame, features: list[str]) -> Scaler:
        medians = df.agg(*[F.median(N.real(F.col(f))).alias(f) for f in features]).first().asDict()
        medians = {f: float(v) if v is not None else 0.0 for f, v in medians.items()}
        filled = [F.coalesce(N.real(F.col(f)), F.lit(medians[f])) for f in features]
        stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(filled)], *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(filled)]).first()
        return cls(medians, {f: stats[f"m{i}"] or 0.0 for i, f in enumerate(features)}, {f: stats[f"d{i}"] or 0.0 for i, f in enumerate(features)})

    def apply(self, df: DataFrame, scale: bool = True) -> DataFrame:
        """``df`` with the vector ``features``; a feature that doesn't vary is 0."""
        out = []
        for f, median in self.medians.items():
            value = F.coalesce(N.real(F.col(f)), F.lit(median))
            if scale:
                value = (value - self.means[f]) / self.deviations[f] if self.deviations[f] > 0 else F.lit(0.0)
            out.append(value.alias(f"__f_{f}"))
        names = [f"__f_{f}" for f in self.medians]
        return VectorAssembler(inputCols=names, outputCol="features").transform(df.select("*", *out)).drop(*names)


class Fitted:
    """A fitted model: ``predict`` adds the probability ``p``."""

    def __init__(self, features: list[str], scaler: Scaler, model: Model, scaled: bool):
        self.features, self.scaler, self.model, self.scaled = features, scaler, model, scaled
        # the summary holds the session, which can't be sent to tasks once it has a tag or an observation
        if getattr(model, "hasSummary", False):
            model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())

    def predict(self, df: DataFrame) -> DataFrame:
        rows = self.model.transform(self.scaler.apply(df, self.scaled))
        return rows.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def coefficients(self) -> list[tuple[str, float]]:
        """Coefficients on scaled features, largest first; for trees the importances."""
        values = self.model.coefficients if hasattr(self.model, "coefficients") else self.model.featureImportances
        return sorted(zip(self.features, map(float, values.toArray())), key=lambda x: -abs(x[1]))

    def formula(self, digits: int = 4) -> str:
        """The logit as text, on scaled features."""
        terms = [f"{c:+.{digits}f} * {f}" for f, c in self.coefficients() if c]
        return " ".join([f"logit = {self.model.intercept:.{digits}f}", *terms])


class Logit(Fitted):
    """A fitted logistic regression: its probability is a plain expression."""

    def __init__(self, features: list[str], scaler: Scaler, at: np.ndarray):
        super().__init__(features, scaler, SimpleNamespace(coefficients=Vectors.dense(at[1:]), intercept=float(at[0])), True)

    def predict(self, df: DataFrame) -> DataFrame:
        s, z = self.scaler, F.lit(self.model.intercept)
        for f, c in zip(self.features, map(float, self.model.coefficients)):
            if s.deviations[f] > 0:
                z = z + (F.coalesce(N.real(F.col(f)), F.lit(s.medians[f])) - s.means[f]) / s.deviations[f] * c
        return df.withColumn("p", N.sigmoid(z))


class Packed:
    """A training table and one to judge on, packed for logistic fits of any sets of ``features``."""

    def __init__(self, train: DataFrame, validation: DataFrame | None, features: list[str], label: str = "red_win"):
        self.features = list(dict.fromkeys(features))
        self.train = L.Blocks(train, self.features, label)
        self.medians = np.nan_to_num(self.train.medians())
        self.n, self.positive, self.means, self.deviations = self.train.moments(self.medians)
        self.validation = None if validation is None else L.Blocks(validation.where(F.col(label).isNotNull()), self.features, label)

    def scaler(self, features: list[str]) -> Scaler:
        at = [self.features.index(f) for f in features]
        return Scaler(*[{f: float(v[i]) for f, i in zip(features, at)} for v in (self.medians, self.means, self.deviations)])

    def fit(self, asked: list[tuple[list[str], dict]]) -> list[Logit]:
        """The fits of sets with their ``C``, ``l1_ratio`` and ``max_iter``; the penalty is 1 / (C n), the intercept is not penalised."""
        problems = []
        for features, given in asked:
            s = LOGISTIC | given
            problems.append(L.Problem([self.features.index(f) for f in features], 1.0 / (s["C"] * self.n), s["l1_ratio"], s["max_iter"]))
        found = L.solve(self.train, self.medians, self.means, self.deviations, problems, self.n, self.positive)
        return [Logit(f, self.scaler(f), at) for (f, _), at in zip(asked, found)]

    def score(self, fits: list[Logit]) -> list[dict]:
        """The metrics of each fit; all are judged together."""
        points = [([self.features.index(f) for f in m.features], np.array([m.model.intercept, *m.model.coefficients])) for m in fits]
        rows = L.probabilities(self.validation, self.medians, self.means, self.deviations, points)
        found = {r["setting"]: {k: v for k, v in r.asDict().items() if k != "setting"} for r in M.evaluate(rows, ["setting"]).collect()}
        return [found.get(i, {}) for i in range(len(fits))]

    def free(self) -> None:
        for blocks in (self.train, self.validation):
            if blocks is not None:
                blocks.free()


class Joint:
    """Logistic fits of several sets with their metrics, made together when the first of them is asked for."""

    def __init__(self, train: DataFrame, validation: DataFrame, asked: list[tuple[list[str], dict]], packed: Packed | None = None, label: str = "red_win"):
        self.train, self.validation, self.asked, self.packed, self.label, self.found = train, validation, asked, packed, label, None

    def __getitem__(self, i: int) -> Part:
        return Part(self, i)

    def results(self) -> list[tuple[Logit, dict]]:
        if self.found is None:
            packed = self.packed or Packed(self.train, self.validation, [f for features, _ in self.asked for f in features], self.label)
            fits = packed.fit(self.asked)
            self.found = list(zip(fits, packed.score(fits)))
            if self.packed is None:
                packed.free()
        return self.found


class Part:
    """One of the fits of a ``Joint``."""

    def __init__(self, joint: Joint, i: int):
        self.joint, self.i = joint, i

    def result(self) -> tuple[Logit, dict]:
        return self.joint.results()[self.i]


def fit_logistic(df: DataFrame, features: list[str], label: str = "red_win", C: float = LOGISTIC["C"], l1_ratio: float = LOGISTIC["l1_ratio"], max_iter: int = LOGISTIC["max_iter"]) -> Fitted:
    """Elastic-net logistic regression; the penalty is 1 / (C n), the intercept is not penalised."""
    packed = Packed(df, None, features, label)
    fitted = packed.fit([(list(features), {"C": C, "l1_ratio": l1_ratio, "max_iter": max_iter})])[0]
    packed.free()
    return fitted


def _per_node(strategy: str, n: int) -> str:
    """How many of n features a node draws, rounded down as in the reference; Spark ML would round up."""
    named = {"sqrt": math.sqrt(n), "log2": math.log2(n), "all": n}
    return str(max(1, int(named[strategy] if strategy in named else float(strategy) * n)))


class Ensemble(Fitted):
    """Trees with weights: the mean of the shares of a forest, the sum of a boosted model."""

    def __init__(self, features: list[str], scaler: Scaler, family: str, ends: list[np.ndarray], trees: list[tuple[float, T.Tree]], importance: np.ndarray):
        total = importance.sum()
        super().__init__(features, scaler, SimpleNamespace(featureImportances=Vectors.dense(importance / total if total else importance)), False)
        self.family, self.ends, self.trees = family, ends, trees

    def predict(self, df: DataFrame) -> DataFrame:
        family, known = self.family, df.sparkSession.sparkContext.broadcast((self.ends, self.trees))

        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            ends, trees = known.value
            for columns in batches:
                yield pd.Series(_probability(family, T.coded(np.column_stack([c.to_numpy(float) for c in columns]), ends), trees))

        values = [F.coalesce(N.real(F.col(f)), F.lit(self.scaler.medians[f])) for f in self.features]
        one = lambda it: run((c,) for c in it)
        return df.withColumn("p", F.pandas_udf(one if len(values) == 1 else run, "double", F.PandasUDFType.SCALAR_ITER)(*values))


def _probability(family: str, x: np.ndarray, trees: list[tuple[float, T.Tree]]) -> np.ndarray:
    total = np.zeros(len(x))
    for weight, tree in trees:
        total += weight * T.values(tree, x)
    return total / max(len(trees), 1) if family == "forest" else 1 / (1 + np.exp(-2 * total))


def _in_task(df: DataFrame, features: list[str]) -> bool:
    return df.count() * len(features) <= IN_TASK


def _grown(family: str, x: np.ndarray, y: np.ndarray, seed: int, settings: dict, some: list[int] | None = None) -> tuple[list[tuple[float, T.Tree]], np.ndarray]:
    """The trees of a model (of a forest only ``some``) and the features' importances."""
    importance = np.zeros(x.shape[1])
    per_node = int(_per_node(settings["featureSubsetStrategy"], x.shape[1]))
    if family == "boost":
        return list(T.boosted_trees(x, y, seed, settings, per_node, importance)), importance
    return [(1.0, T.forest_tree(x, y, i, seed, settings, per_node, importance)) for i in (range(settings["numTrees"]) if some is None else some)], importance


def _fit_trees(df: DataFrame, features: list[str], label: str, seed: int, scaler: Scaler | None, family: str, settings: dict) -> Ensemble:
    scaler, spark = scaler or Scaler.fit(df, features), df.sparkSession
    ends = T.thresholds(df, features, scaler.medians)
    data = spark.sparkContext.broadcast(T.codes(df, features, scaler.medians, ends, label))
    n = settings["numTrees"] if family == "forest" else 1
    parts = [list(range(i, n, k)) for k in [min(n, 4 * spark.sparkContext.defaultParallelism)] for i in range(k)]
    found = T.in_tasks(spark, lambda some: _grown(family, *data.value, seed, settings, some), parts)
    trees = {i: t for some, (grown, _) in zip(parts, found) for i, t in zip(some, grown)} if family == "forest" else dict(enumerate(found[0][0]))
    data.destroy()
    return Ensemble(features, scaler, family, ends, [trees[i] for i in sorted(trees)], sum(importance for _, importance in found))


def fit_forest(df: DataFrame, features: list[str], label: str = "red_win", seed: int = 42, scaler: Scaler | None = None, **settings) -> Fitted:
    """The setting ``class_weight`` "balanced": both classes weigh the same in all."""
    settings = FOREST | settings
    if _in_task(df, features):
        return _fit_trees(df, features, label, seed, scaler, "forest", settings)
    scaler = scaler or Scaler.fit(df, features)
    settings["featureSubsetStrategy"] = _per_node(settings["featureSubsetStrategy"], len(features))
    rows = scaler.apply(df, False)
    if settings.pop("class_weight"):
        n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
        weights = [x for k, c in n.items() for x in (F.lit(k), F.lit(sum(n.values()) / (len(n) * c)))]
        rows, settings["weightCol"] = rows.withColumn("__weight", F.create_map(*weights)[F.col(label)]), "__weight"
    return Fitted(features, scaler, RandomForestClassifier(labelCol=label, seed=seed, **settings).fit(rows), False)


def fit_boost(df: DataFrame, features: list[str], label: str = "red_win", seed: int = 42, scaler: Scaler | None = None, **settings) -> Fitted:
    if _in_task(df, features):
        return _fit_trees(df, features, label, seed, scaler, "boost", {"featureSubsetStrategy": "all"} | BOOST | settings)
    scaler = scaler or Scaler.fit(df, features)
    return Fitted(features, scaler, GBTClassifier(labelCol=label, seed=seed, **(BOOST | settings)).fit(scaler.apply(df, False)), False)


FAMILIES: dict[str, Callable[..., Fitted]] = {"logistic": fit_logistic, "forest": fit_forest, "boost": fit_boost}


def score(df: DataFrame, label: str = "red_win") -> dict[str, float | None]:
    """The metrics of a predicted table as a dict."""
    row = M.evaluate(df.select(F.col(label).alias("label"), "p").withColumn("g", F.lit(1)), ["g"]).first()
    return {k: v for k, v in row.asDict().items() if k != "g"} if row else {}


def fit_and_evaluate(train: DataFrame | Part, validation: DataFrame, features: list[str], name: str = "", family: str = "logistic", **settings) -> dict:
    """Metrics of one feature set on the validation table; an empty set gives only its name. ``train`` may be one of a joint fit's parts."""
    if not features:
        return {"name": name, "n_features": 0}
    metrics = train.result()[1] if isinstance(train, Part) else score(FAMILIES[family](train, features, **settings).predict(validation))
    return {"name": name, "n_features": len(features), "features": features, **metrics}


def forward_selection(train: DataFrame, validation: DataFrame, candidates: list[str], start: list[str] | None = None, least_gain: float = 5e-4, **settings) -> list[dict]:
    """The path that adds the feature which lowers the log loss most, while it does by at least ``least_gain``."""
    chosen, path, best = list(start or []), [], float("inf")
    packed = None if "family" in settings else Packed(train, validation, [*chosen, *candidates], settings.get("label", "red_win"))
    while rest := [c for c in candidates if c not in chosen]:
        tried = evaluate_sets(train, validation, {c: [*chosen, c] for c in rest}, packed, **settings)
        top = min(tried, key=lambda r: r["log_loss"])
        if best - top["log_loss"] < least_gain and path:
            break
        best = top["log_loss"]
        chosen.append(top["name"])
        path.append({"step": len(path) + 1, "added": top["name"], **{k: v for k, v in top.items() if k != "name"}})
    if packed:
        packed.free()
    return path


def evaluate_sets(train: DataFrame, validation: DataFrame, sets: dict[str, list[str]], packed: Packed | None = None, **settings) -> list[dict]:
    """Metrics of named feature sets in their order. Logistic models are fitted together, of other families a few at once."""
    named = [(n, f) for n, f in sets.items() if f]
    if settings.get("family", "logistic") == "logistic":
        own = {k: v for k, v in settings.items() if k not in ("family", "label")}
        joint = Joint(train, validation, [(f, own) for _, f in named], packed, settings.get("label", "red_win"))
        return [fit_and_evaluate(joint[i], validation, f, n, **settings) for i, (n, f) in enumerate(named)]
    train, validation = train.cache(), validation.cache()
    with ThreadPool(AT_ONCE) as pool:
        return pool.starmap(lambda n, f: fit_and_evaluate(train, validation, f, n, **settings), named, 1)


def compare_sets(train: DataFrame, validation: DataFrame, sets: dict[str, list[str]], **settings) -> list[dict]:
    """Metrics of named feature sets, best log loss first."""
    return sorted(evaluate_sets(train, validation, sets, **settings), key=lambda r: r["log_loss"])


def single_features(train: DataFrame, validation: DataFrame, features: list[str], label: str = "red_win", **settings) -> list[dict]:
    """Metrics and coefficient of the logistic model of each feature alone, best log loss first."""

    def one(f: str, fitted: Logit, metrics: dict) -> dict:
        c = fitted.coefficients()[0][1]
        return {"feature": f, **metrics, "coefficient": c, "coefficient_sign": "positive" if c > 0 else "negative" if c < 0 else "zero"}

    found = Joint(train, validation, [([f], settings) for f in features], label=label).results()
    return sorted([one(f, *r) for f, r in zip(features, found)], key=lambda r: r["log_loss"])


def leave_one_out(train: DataFrame, validation: DataFrame, features: list[str], base: list[str] | None = None, **settings) -> list[dict]:
    """Metrics with each of ``features`` left out, beside ``base``, with the change of each metric against all of them."""
    fixed = [f for f in base or [] if f not in features]
    every = evaluate_sets(train, validation, {"all": [*fixed, *features], **{f: [*fixed, *[g for g in features if g != f]] for f in features}}, **settings)
    full, rows = every[0], every[1:]
    delta = lambda r: {f"delta_{m}": r[m] - full[m] for m in ("log_loss", "roc_auc", "brier", "accuracy")}
    return [{"removed": r["name"], **{k: v for k, v in r.items() if k != "name"}, **delta(r)} for r in rows]


def penalty_grid(train: DataFrame, validation: DataFrame, features: list[str], strengths: tuple[float, ...], ratios: tuple[float, ...]) -> list[dict]:
    """Metrics of each pair of inverse penalty strength and share of the absolute penalty, best log loss first."""
    picks = [{"C": c, "l1_ratio": r} for c in strengths for r in ratios]
    joint = Joint(train, validation, [(features, s) for s in picks])
    rows = [{"settings": s, **fit_and_evaluate(joint[i], validation, features, "", **s)} for i, s in enumerate(picks)]
    return sorted(rows, key=lambda r: r["log_loss"])


def interactions(df: DataFrame, feature: str, groups: dict[str, list[str]], by: str = "weight_class") -> tuple[DataFrame, list[str]]:
    """``df`` with the feature times the indicator of each group of classes (all others are "Other"), and the new names."""
    group = F.lit("Other")
    for name, labels in groups.items():
        group = F.when(F.lower(by).isin(*labels), F.lit(name)).otherwise(group)
    names = [f"{feature}_x_{g}" for g in (*groups, "Other")]
    return df.select("*", *[F.when(group == n.rsplit("_x_", 1)[1], N.real(F.col(feature))).otherwise(0.0).alias(n) for n in names]), names


def ablation(train: DataFrame, validation: DataFrame, groups: dict[str, list[str]], **settings) -> list[dict]:
    """All groups, then without each group in turn, with the change of log loss."""
    every = list(dict.fromkeys(f for g in groups.values() for f in g))
    base = fit_and_evaluate(train, validation, every, "all", **settings)
    fits = evaluate_sets(train, validation, {f"without {n}": [f for f in every if f not in group] for n, group in groups.items()}, **settings)
    return [{**base, "delta": 0.0}, *[{**r, "delta": r["log_loss"] - base["log_loss"]} for r in fits]]


def subset_search(train: DataFrame, validation: DataFrame, base: list[str], pool: list[str], sizes: tuple[int, ...] = (2, 3, 4), tie: float = 1e-3, **settings) -> tuple[list[dict], dict]:
    """All subsets of the pool of the given sizes on top of ``base``; the pick is the smallest within ``tie`` of the best."""
    subsets = {"+".join(s): s for k in sizes for s in combinations(pool, k)}
    fits = evaluate_sets(train, validation, {n: [*base, *s] for n, s in subsets.items()}, **settings)
    rows = [r | {"size": len(subsets[r["name"]])} for r in fits]
    best = min(r["log_loss"] for r in rows)
    return rows, min((r for r in rows if r["log_loss"] <= best + tie), key=lambda r: (r["size"], r["log_loss"]))


def near_best(rows: list[dict], within: float = 1e-3) -> list[dict]:
    best = min(r["log_loss"] for r in rows)
    return [r | {"near_best": r["log_loss"] <= best + within} for r in rows]


def sample_settings(space: dict[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """n different random settings of a space (all of them where it has fewer)."""
    draw, out = random.Random(seed), {}
    total = 1
    for values in space.values():
        total *= len(set(values))
    while len(out) < min(n, total):
        pick = {k: draw.choice(v) for k, v in space.items()}
        out[tuple(map(str, pick.values()))] = pick
    return list(out.values())


def _search_in_tasks(train: DataFrame, validation: DataFrame, features: list[str], family: str, picks: list[dict], scaler: Scaler, label: str, seed: int = 42) -> DataFrame:
    """``setting, label, p`` of the validation rows: a task grows a setting's trees and keeps none of them; the longest begin first."""
    spark, ends = train.sparkSession, T.thresholds(train, features, scaler.medians)
    data = spark.sparkContext.broadcast((T.codes(train, features, scaler.medians, ends, label), T.codes(validation.where(F.col(label).isNotNull()), features, scaler.medians, ends, label)))
    settings = [{"forest": FOREST, "boost": {"featureSubsetStrategy": "all"} | BOOST}[family] | p for p in picks]
    work = lambda s: s.get("numTrees", s.get("maxIter")) * s["maxDepth"] * int(_per_node(s["featureSubsetStrategy"], len(features)))
    order = sorted(range(len(picks)), key=lambda i: -work(settings[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (x, y), (vx, vy) = data.value
        for b in batches:
            for i in (order[j] for j in b.column(0).to_pylist()):
                s, total, per_node, importance = settings[i], np.zeros(len(vx)), int(_per_node(settings[i]["featureSubsetStrategy"], x.shape[1])), np.zeros(x.shape[1])
                grown = T.boosted_trees(x, y, seed, s, per_node, importance) if family == "boost" else ((1.0, T.forest_tree(x, y, t, seed, s, per_node, importance)) for t in range(s["numTrees"]))
                for weight, tree in grown:
                    total += weight * T.values(tree, vx)
                p = total / s["numTrees"] if family == "forest" else 1 / (1 + np.exp(-2 * total))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), i, np.int32)), pa.array(vy.astype(np.int32)), pa.array(p)], names=["setting", "label", "p"])

    return checkpoint(spark.range(0, len(picks), 1, len(picks)).mapInArrow(run, "setting int, label int, p double"))


def random_search(train: DataFrame, validation: DataFrame, features: list[str], family: str, n: int = 100, seed: int = 42, space: dict[str, tuple] | None = None, label: str = "red_win") -> list[dict]:
    """Metrics of n random settings, best log loss first; the predictions of all settings are judged together."""
    picks = sample_settings(space or {"forest": FOREST_SPACE, "boost": BOOST_SPACE}[family], n, seed)
    train, validation = train.cache(), validation.cache()
    scaler = Scaler.fit(train, features)

    def predicted(i: int) -> DataFrame:
        fitted = FAMILIES[family](train, features, label, scaler=scaler, **picks[i])
        return checkpoint(fitted.predict(validation).select(F.lit(i).alias("setting"), F.col(label).alias("label"), "p"))

    if _in_task(train, features):
        judged = _search_in_tasks(train, validation, features, family, picks, scaler, label)
    else:
        with ThreadPool(AT_ONCE) as pool:
            judged = checkpoint(reduce(DataFrame.unionByName, pool.map(predicted, range(len(picks)), 1)))
    found = {r["setting"]: r.asDict() for r in M.evaluate(judged, ["setting"]).collect()}
    rows = [{"settings": s, "name": str(i), "n_features": len(features), "features": features, **{k: v for k, v in found[i].items() if k != "setting"}} for i, s in enumerate(picks)]
    return sorted(rows, key=lambda r: r["log_loss"])


def fit_sigmoid(df: DataFrame, p: str = "p", label: str = "red_win") -> Callable[[DataFrame], DataFrame] | None:
    """Platt calibration: logistic regression on the logit; None where there is one class only. Adds ``p_sigmoid``."""
    if df.select(label).distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=["z"], outputCol="features").transform(df.select(label, N.logit(F.col(p)).alias("z")))
    model = LogisticRegression(labelCol=label, regParam=1.0 / rows.count(), elasticNetParam=0.0, standardization=False).fit(rows)
    a, b = float(model.coefficients[0]), float(model.intercept)
    return lambda d: d.withColumn("p_sigmoid", N.sigmoid(a * N.logit(F.col(p)) + b))


def fit_isotonic(df: DataFrame, p: str = "p", label: str = "red_win") -> Callable[[DataFrame], DataFrame] | None:
    """Isotonic calibration, held at the ends outside the seen range. Adds ``p_isotonic``."""
    if df.select(label).distinct().count() < 2:
        return None
    rows = df.select(F.col(label).cast("double").alias("label"), F.col(p).alias("features"))
    model = Pipeline(stages=[IsotonicRegression()]).fit(rows).stages[0]

    def apply(d: DataFrame) -> DataFrame:
        out = model.transform(d.withColumn("features", F.col(p)))
        return out.withColumn("p_isotonic", N.clip(F.col("prediction"), 0.0, 1.0)).drop("features", "prediction")

    return apply
