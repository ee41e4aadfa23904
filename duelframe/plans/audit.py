"""Checks of a feature table, its splits, models and bets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions.numeric import audit_equal
from duelframe.operators import splits as S
from duelframe.operators.metrics import TINY, ranked


def leakage(features: list[str], expected: list[str] | None = None, table: DataFrame | None = None, since: str = "2010-01-01") -> list[dict]:
    """Named checks with pass or fail: for each feature that the table has it, that its prefix is safe and that no word of it points to the contest itself; the expected set; the cutoff."""
    suspect, out = S.suspects(features), []
    for f in features:
        safe = f.startswith(("diff_", "pre_fight_"))
        there = table is None or f in table.columns
        out.append({"check": "available and safe", "feature": f, "passed": there and safe and f not in suspect, "detail": ", ".join([*([] if there else ["missing"]), *([] if safe else ["prefix"]), *suspect.get(f, [])])})
    if expected is not None:
        out.append({"check": "expected set", "feature": "", "passed": list(features) == list(expected), "detail": ", ".join(sorted(set(features) ^ set(expected)))})
    if table is not None:
        early = table.where(F.col("event_date") < F.lit(since).cast("date")).count()
        out.append({"check": "cutoff", "feature": "", "passed": early == 0, "detail": f"{early} rows before {since}"})
    return out


def selection(results: list[dict], frozen: dict) -> list[dict]:
    """Whether the best row of a search (log loss, then AUC, then Brier score) has the frozen settings, and no column of the results is of the test split."""
    best = min(results, key=lambda r: (r["log_loss"], -(r["roc_auc"] or 0.0), r["brier"]))
    off = [k for k, v in frozen.items() if str(best["settings"].get(k)) != str(v)]
    test = sorted({c for r in results for c in r if "test" in c.lower()})
    return [{"check": "best settings are the frozen ones", "passed": not off, "detail": ", ".join(off)}, {"check": "no test columns", "passed": not test, "detail": ", ".join(test)}]


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """``only_a, only_b``: rows that one table has more often than the other."""
    columns = a.columns
    return a.exceptAll(b.select(*columns)).agg(F.count("*").alias("only_a")).crossJoin(b.select(*columns).exceptAll(a).agg(F.count("*").alias("only_b")))


def configuration(expected: dict, actual: dict) -> list[dict]:
    return [{"parameter": k, "expected": v, "actual": actual.get(k), "passed": actual.get(k) == v} for k, v in expected.items()]


def metric_comparison(saved: DataFrame, computed: DataFrame, keys: list[str], atol: float = 1e-12) -> DataFrame:
    """Saved against recomputed metrics ``keys, metric, value``; a metric on one side only fails."""
    a, b = saved.withColumnRenamed("value", "saved"), computed.withColumnRenamed("value", "computed")
    rows = a.join(b, [*keys, "metric"], "full")
    return rows.select(*keys, "metric", "saved", "computed", audit_equal(F.col("saved"), F.col("computed"), atol, 0.0).alias("passed"))


def recomputed_metrics(df: DataFrame, label: str = "label", p: str = "p", key: str = "bout_id") -> DataFrame:
    """``metric, value`` by other formulas than ``metrics.evaluate``: the AUC from mean ranks, the rest from sums over the four cells."""
    rows = ranked(df.where(F.col(label).isNotNull() & F.col(p).isNotNull()).select(key, label, p), [], [p, key])
    pos = F.col(label) == 1
    ties = rows.groupBy(p).agg(F.avg("r").alias("rank"), F.sum(F.when(pos, 1).otherwise(0)).alias("k"))
    u = ties.agg(F.sum(F.col("rank") * F.col("k")).alias("ranks"))
    inside = F.least(F.greatest(F.col(p), F.lit(TINY)), F.lit(1 - TINY))
    loss = F.when(pos, -F.ln(inside)).otherwise(-F.log1p(-inside))
    hit = F.col(p) >= 0.5
    n = lambda c, name: F.sum(F.when(c, 1.0).otherwise(0.0)).alias(name)
    sums = rows.agg(F.count("*").cast("double").alias("n"), F.sum(loss).alias("loss"), F.sum(F.when(pos, (1 - F.col(p)) ** 2).otherwise(F.col(p) ** 2)).alias("squares"), n(pos & hit, "tp"), n(~pos & hit, "fp"), n(pos & ~hit, "fn"), n(~pos & ~hit, "tn"))
    c = F.col
    positives, negatives = c("tp") + c("fn"), c("tn") + c("fp")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    auc = F.when((positives > 0) & (negatives > 0), (c("ranks") - positives * (positives + 1) / 2) / (positives * negatives))
    values = {"n": c("n"), "log_loss": c("loss") / c("n"), "roc_auc": auc, "brier": c("squares") / c("n"), "accuracy": (c("tp") + c("tn")) / c("n"), "precision": safe(c("tp"), c("tp") + c("fp")), "recall": safe(c("tp"), positives), "f1": safe(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))}
    return sums.crossJoin(u).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])))  # one row each


def melt_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    names = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])))


def prediction_checks(df: DataFrame, p: str = "p", label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row of counts: probabilities outside [0, 1], missing values, labels that don't follow the threshold."""
    n = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(name)
    return df.agg(F.count("*").alias("n_rows"), n((F.col(p) < 0) | (F.col(p) > 1), "outside"), n(F.col(p).isNull() | F.col(label).isNull(), "missing"), n((F.col(p) >= 0.5).cast("int") != F.col(predicted), "label_mismatches"))


def bet_checks(bets: DataFrame, cap: float = 0.25) -> DataFrame:
    """One row of counts: profits that don't follow from odds and result, edges that aren't model less market, stakes below 0, fractions above the cap."""
    n = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(name)
    won = F.when(F.col("bet_won"), F.col("stake") * (F.col("selected_decimal_odds") - 1)).otherwise(-F.col("stake"))
    full = F.col("full_kelly_fraction") if "full_kelly_fraction" in bets.columns else F.lit(0.0)
    return bets.agg(F.count("*").alias("n_bets"), n(F.abs(F.col("profit") - won) > 1e-6 * (1 + F.abs(won)), "wrong_profit"), n(F.abs(F.col("selected_edge") - (F.col("selected_model_prob") - F.col("selected_market_prob"))) > 1e-9, "wrong_edge"), n(F.col("stake") < 0, "negative_stakes"), n(full > cap, "above_cap"))


def text_report(title: str, sections: dict[str, list[dict]], made_at: str | None = None) -> str:
    """A plain-text report; the time is given, never read from a clock."""
    lines = [title, "=" * len(title)] + ([f"made at {made_at}"] if made_at else [])
    for name, rows in sections.items():
        lines += ["", name, "-" * len(name)]
        lines += ["; ".join(f"{k}: {v:.6f}" if isinstance(v, float) else f"{k}: {v}" for k, v in r.items()) for r in rows] or ["none"]
    return "\n".join(lines) + "\n"
