"""Classification metrics and calibration tables, for any grouping in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.runtime import checkpoint

TINY = 2.220446049250313e-16
#: Slices of the probabilities for the AUC.
SLICES = 4096


def _log_loss(y: Column, p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(TINY)), F.lit(1 - TINY))
    return F.avg(-F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def confusion(df: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    y, q = F.col(label) == 1, F.col(predicted) == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return df.groupBy(*by).agg(n(~y & ~q)("tn"), n(~y & q)("fp"), n(y & ~q)("fn"), n(y & q)("tp"))


def evaluate(df: DataFrame, by: list[str], label: str = "label", p: str = "p") -> DataFrame:
    """Log loss, AUC (null with one class), Brier score, accuracy, precision, recall and F1 of each group.

    Rows without a label or probability are left out; the groups' keys must not be null. The AUC comes from counts per
    distinct probability: negatives with a lower one are those of the lower slices of [0, 1] and those before in the slice.
    """
    # three aggregates read the rows
    rows = checkpoint(df.where(F.col(label).isNotNull() & F.col(p).isNotNull()).select(*by, label, p))
    y, q = F.col(label) == 1, F.col(p) >= 0.5
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    base = rows.groupBy(*by).agg(F.count("*").alias("n"), n(y).alias("n_pos"), _log_loss(F.col(label), F.col(p)).alias("log_loss"), F.avg((F.col(p) - F.col(label)) ** 2).alias("brier"), F.avg((y == q).cast("int")).alias("accuracy"), n(y & q).alias("tp"), n(~y & q).alias("fp"), n(y & ~q).alias("fn"))
    values = rows.groupBy(*by, p).agg(F.sum(F.when(y, 1).otherwise(0)).alias("pos"), F.sum(F.when(y, 0).otherwise(1)).alias("neg"))
    values = values.withColumn("__b", F.floor(F.col(p) * SLICES))
    slices = values.groupBy(*by, "__b").agg(F.sum("neg").alias("neg_in"))
    up = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(*by, "__b", F.coalesce(F.sum("neg_in").over(up(Window.partitionBy(*by).orderBy("__b"))), F.lit(0)).alias("below"))
    within = F.coalesce(F.sum("neg").over(up(Window.partitionBy(*by, "__b").orderBy(p))), F.lit(0))
    placed = values.withColumn("within", within).join(offsets, [*by, "__b"])
    area = placed.select(*by, (F.col("pos") * (F.col("below") + F.col("within") + F.col("neg") / 2)).alias("a")).groupBy(*by).agg(F.sum("a").alias("a"))
    joined = base.join(area, by) if by else base.crossJoin(area)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")), F.col("a") / (F.col("n_pos") * (F.col("n") - F.col("n_pos"))))
    return joined.select(*by, "n", "log_loss", auc.alias("roc_auc"), "brier", "accuracy", precision.alias("precision"), recall.alias("recall"), safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def ranked(df: DataFrame, by: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``r`` (1..n within its group in the order) and ``n``, without gathering a group in one task.

    Rows are range-partitioned by group and order; a row's rank is its place in its partition's part of the group plus the
    sizes of the group's parts before it.
    """
    keys = [*by, *order]
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    sizes = placed.groupBy(*by, "__p").agg(F.count("*").alias("__k"), F.min("__m").alias("__first"))
    w = Window.partitionBy(*by)
    offsets = sizes.select(*by, "__p", "__first", F.coalesce(F.sum("__k").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"), F.sum("__k").over(w).alias("n"))  # one row per group and partition
    return placed.join(offsets, [*by, "__p"]).withColumn("r", F.col("__o") + F.col("__m") - F.col("__first") + 1).drop("__p", "__m", "__first", "__o")


def quantile_bin(bins: int = 10) -> Column:
    """The bin of rank r of n as a quantile cut of ranks gives it; at most n bins."""
    k = F.least(F.lit(bins), F.col("n"))
    return F.when(F.col("n") > 1, F.greatest(F.ceil(k * (F.col("r") - 1) / (F.col("n") - 1)) - 1, F.lit(0))).otherwise(0).cast("int")


def calibration(df: DataFrame, by: list[str], order: str, label: str = "label", p: str = "p", bins: int = 10, extra: dict[str, str] | None = None) -> DataFrame:
    """Count, mean probability and observed rate of each quantile bin; ``extra`` names further columns to average."""
    rows = ranked(df.where(F.col(p).isNotNull()), by, [p, order])
    binned = rows.withColumn("bin", quantile_bin(bins))
    aggs = [F.avg(c).alias(n) for n, c in (extra or {}).items()]
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("n_rows"), F.avg(p).alias("mean_p"), F.avg(label).alias("observed"), F.min(p).alias("least_p"), F.max(p).alias("most_p"), *aggs)


def calibration_gap(table: DataFrame, by: list[str]) -> DataFrame:
    return table.groupBy(*by).agg(F.avg(F.abs(F.col("mean_p") - F.col("observed"))).alias("calibration_gap"))


def against(table: DataFrame, by: list[str], method: str, base: str, value: str = "log_loss") -> DataFrame:
    """``delta``: a method's value less the base method's in the same group."""
    w = Window.partitionBy(*by)
    return table.withColumn("delta", F.col(value) - F.max(F.when(F.col(method) == base, F.col(value))).over(w))


def unpivot_methods(df: DataFrame, keep: list[str], methods: list[str], label: str = "label") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("p")) for m in methods])
    return df.select(*keep, F.col(label).alias("label"), F.inline(pairs))


def blend_search(df: DataFrame, by: list[str], model: str, market: str, label: str = "label", steps: int = 10, eps: float = 1e-6) -> DataFrame:
    """The model weight in 0, 1/steps, .. 1 with the least log loss of each group; of equal ones the larger."""
    weights = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps)).alias("w")
    rows = df.select(*by, F.col(label).alias("label"), F.col(model).alias("m"), F.col(market).alias("q"), weights)
    p = F.least(F.greatest(F.col("w") * F.col("m") + (1 - F.col("w")) * F.col("q"), F.lit(eps)), F.lit(1 - eps))
    losses = rows.select(*by, "label", "w", p.alias("p")).groupBy(*by, "w").agg(F.round(_log_loss(F.col("label"), F.col("p")), 12).alias("log_loss"))
    best = F.min_by("w", F.struct("log_loss", (-F.col("w")).alias("x"))).alias("w")
    return losses.groupBy(*by).agg(best, F.min("log_loss").alias("log_loss")) if by else losses.agg(best, F.min("log_loss").alias("log_loss"))
