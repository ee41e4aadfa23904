"""Walk-forward research: models against the market, fold by fold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators import metrics as M
from duelframe.operators import models
from duelframe.operators import splits as S
from duelframe.runtime import checkpoint

METHODS = ("market", "raw", "sigmoid", "isotonic", "blend_raw", "blend_sigmoid", "blend_isotonic")


def fold_predictions(train: DataFrame, calibration: DataFrame, test: DataFrame, features: list[str], family: str = "forest", label: str = "red_win", market: str = "market", **settings) -> DataFrame:
    """The test rows with a probability per method; calibrators and blend weights are learned on the calibration rows."""
    fitted = models.FAMILIES[family](train, features, label, **settings)
    cal, out = checkpoint(fitted.predict(calibration)), checkpoint(fitted.predict(test))  # each is read many times
    sigmoid, isotonic = models.fit_sigmoid(cal, label=label), models.fit_isotonic(cal, label=label)
    for calibrate, name in ((sigmoid, "p_sigmoid"), (isotonic, "p_isotonic")):
        cal, out = ((calibrate(d) if calibrate else d.withColumn(name, F.col("p"))) for d in (cal, out))
    columns = {"raw": "p", "sigmoid": "p_sigmoid", "isotonic": "p_isotonic"}
    weights = {m: M.blend_search(cal.where(F.col(market).isNotNull()), [], c, market, label).first()["w"] for m, c in columns.items()}
    blends = [F.least(F.greatest(w * F.col(columns[m]) + (1 - w) * F.col(market), F.lit(1e-6)), F.lit(1 - 1e-6)).alias(f"blend_{m}") for m, w in weights.items() if w is not None]
    shown = [F.col(c).alias(m) for m, c in columns.items()] + blends + [F.lit(w).alias(f"w_{m}") for m, w in weights.items()]
    keep = [c for c in ("bout_id", "event_date", "fold_id") if c in out.columns]
    return out.select(*keep, F.col(label).alias("label"), F.col(market).alias("market"), *shown)


def research(df: DataFrame, features: list[str], family: str = "forest", label: str = "red_win", market: str = "market", least: tuple[int, int, int] = (250, 50, 50), **settings) -> DataFrame:
    """All folds' test predictions. Rows without a market probability are left out before the folds are made; no rows without a fold that is large enough."""
    rows = df.where(F.col(market).isNotNull())
    folds = S.walk_forward_folds(rows, "event_date", *least).orderBy("fold_id").collect()  # one row per year
    if not folds:
        return df.sparkSession.createDataFrame([], "bout_id bigint, event_date date, fold_id int, label int, " + ", ".join(f"{m} double" for m in METHODS))
    rows, year, panels = rows.cache(), F.year("event_date"), []
    for f in folds:
        parts = [rows.where(year < f.calibration_year), rows.where(year == f.calibration_year), rows.where(year == f.test_year)]
        panels.append(fold_predictions(*[p.withColumn("fold_id", F.lit(f.fold_id)) for p in parts], features, family, label, market, **settings))
    return checkpoint(reduce(DataFrame.unionByName, panels))


def compare(panel: DataFrame) -> DataFrame:
    """Metrics of each method over all test rows with the difference of its log loss to the market's."""
    long = M.unpivot_methods(panel, [], [m for m in METHODS if m in panel.columns]).withColumn("all", F.lit(1))
    return M.against(M.evaluate(long, ["all", "method"]), ["all"], "method", "market").drop("all")


def by_year(panel: DataFrame) -> DataFrame:
    long = M.unpivot_methods(panel.withColumn("year", F.year("event_date")), ["year"], [m for m in METHODS if m in panel.columns])
    return M.against(M.evaluate(long, ["year", "method"]), ["year"], "method", "market")


def by_fold(panel: DataFrame) -> DataFrame:
    long = M.unpivot_methods(panel, ["fold_id"], [m for m in METHODS if m in panel.columns])
    return M.against(M.evaluate(long, ["fold_id", "method"]), ["fold_id"], "method", "market")
