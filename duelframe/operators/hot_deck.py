"""Sequential hot-deck imputation: missing values are taken from the nearest donor in sorted groups of similar records.

A group is never held by one task: records are range-partitioned by group, day and key, so a block is a run of that order
with about as many records as any other, however large its group; what lies before and after a block is carried over from
per-block summaries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.runtime import checkpoint, parts_for

#: Records of one block of the sorted order, at most about.
BLOCK_ROWS = 500_000


@dataclass(frozen=True)
class Field:
    """An attribute that both sides of a contest have, as ``<side>_<name>``; ``kind`` is "number" or "birth date"."""

    name: str
    kind: str = "number"
    least: float = 48.0
    most: float = 96.0

    def usable(self, value: Column, day: Column) -> Column:
        """The value as a BIGINT (whole units, or yyyymmdd), null where it is missing or out of range."""
        if self.kind == "number":
            value = value.cast("double")
            fits = ~F.isnan(value) & (value >= self.least) & (value <= self.most)
            return F.when(fits, F.round(value).cast("bigint"))
        born = value.cast("date")
        number = (F.year(born) * 10000 + F.month(born) * 100 + F.dayofmonth(born)).cast("bigint")
        young, old = F.add_months(born, int(self.least) * 12) > day, F.add_months(born, int(self.most) * 12) < day
        return F.when(born.isNotNull() & ~F.coalesce(young | old, F.lit(False)), number)


FIELDS = (Field("fighter_height"), Field("fighter_reach"), Field("fighter_dob", "birth date", 16, 60))


def observations(contests: DataFrame, fields: tuple[Field, ...] = FIELDS, key: str = "bout_id", day: str = "event_date", similar: Column | None = None) -> DataFrame:
    """Two rows per contest: ``k`` (key), ``red``, ``entity``, ``day``, ``similar`` and the usable value ``v<i>`` of each field."""
    date = F.col(day).cast("date")
    similar = F.lit(None).cast("string") if similar is None else similar

    def side(name: str) -> Column:
        values = [f.usable(F.col(f"{name}_{f.name}"), date).alias(f"v{i}") for i, f in enumerate(fields)]
        return F.struct(F.lit(name == "red").alias("red"), F.col(f"{name}_fighter_id").alias("entity"), *values)

    # a row without a date stands at the start of its group
    return contests.select(F.col(key).alias("k"), F.coalesce(F.unix_date(date), F.lit(-719162)).alias("day"), similar.alias("similar"), F.inline(F.array(side("red"), side("blue"))))


def nearest_donors(obs: DataFrame, group: str, n_fields: int, modal: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``obs`` with a donor struct ``d<i>`` (day, k, value, distance) for each field, null where the group has no donor.

    Records of a group are sorted by day, key and side. A field's donors are the group's records with a usable value, with
    ``modal`` only those with the group's most frequent one (of equally frequent ones the smallest). The nearer of the
    previous and the next donor is taken, the previous one on equal distance. The distance is in days. Records without a
    group get no donor.
    """
    fs = range(n_fields)
    known = obs.where(F.col(group).isNotNull())
    parts = parts_for(obs.sparkSession, known.count(), block_rows)
    grouped = checkpoint(known.repartitionByRange(parts, group, "day", "k", "red").withColumn("block", F.spark_partition_id()))
    spot = F.struct("day", "k", "red")
    values = [f"v{i}" for i in fs]
    # one row for each block, group and, with modal, combination of values: both combine before they are shuffled
    cells = grouped.groupBy("block", group, *(values if modal else []))
    if modal:
        cells = cells.agg(F.count("*").alias("n"), F.max(spot).alias("last"), F.min(spot).alias("first"))
        each = cells.select(group, "n", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(v).alias("v")) for i, v in zip(fs, values)]))).where("v IS NOT NULL")
        counts = each.groupBy(group, "i", "v").agg(F.sum("n").alias("n"))
        best = [(-F.max(F.when(F.col("i") == i, F.struct("n", (-F.col("v")).alias("v"))))["v"]).alias(f"m{i}") for i in fs]
        cells = cells.join(counts.groupBy(group).agg(*best), group, "left")
        ends = []
        for i, v in zip(fs, values):
            gives = lambda end, v=v, i=i: F.when(F.col(v) == F.col(f"m{i}"), F.struct(f"{end}.day", f"{end}.k", f"{end}.red", F.col(v).alias("v")))
            ends += [F.max(gives("last")).alias(f"last{i}"), F.min(gives("first")).alias(f"first{i}"), F.first(f"m{i}").alias(f"m{i}")]
        blocks = cells.groupBy("block", group).agg(*ends)
    else:
        given = lambda v: F.when(F.col(v).isNotNull(), F.struct("day", "k", "red", F.col(v).alias("v")))
        blocks = cells.agg(*[x for i, v in zip(fs, values) for x in (F.max(given(v)).alias(f"last{i}"), F.min(given(v)).alias(f"first{i}"))])
    # as many rows of a group as it has blocks
    up = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(group).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(group, "block", *[f"m{i}" for i in fs if modal], *[F.last(f"last{i}", True).over(up).alias(f"before{i}") for i in fs], *[F.last(f"first{i}", True).over(down).alias(f"after{i}") for i in fs])
    joined = grouped.join(carried, ["block", group])
    # both frames grow from the start of their order: a frame to the end of the block would be read again for each row
    order = [F.col("day"), F.col("k"), F.col("red")]
    up = Window.partitionBy("block", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("block", group).orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for i in fs:
        own = F.when(F.col(f"v{i}") == F.col(f"m{i}") if modal else F.col(f"v{i}").isNotNull(), F.struct("day", "k", "red", F.col(f"v{i}").alias("v")))
        out += [F.coalesce(F.last(own, True).over(up), F.col(f"before{i}")).alias(f"p{i}"), F.coalesce(F.last(own, True).over(down), F.col(f"after{i}")).alias(f"n{i}")]
    near = joined.select(*obs.columns, *out)

    def choose(i: int) -> Column:
        p, n, day = F.col(f"p{i}"), F.col(f"n{i}"), F.col("day")
        take = p.isNotNull() & (n.isNull() | (day - p["day"] <= n["day"] - day))
        donor = F.when(take, p).otherwise(n)
        return F.when(donor.isNotNull(), F.struct(donor["day"].alias("day"), donor["k"].alias("k"), donor["v"].alias("value"), F.abs(day - donor["day"]).alias("distance")))

    return near.select(*obs.columns, *[choose(i).alias(f"d{i}") for i in fs])


def weight_class(bout_type: str = "bout_type") -> Column:
    """The class of a contest without its promotion and title words; what makes contests similar."""
    text = F.lower(F.coalesce(F.col(bout_type), F.lit("")))
    return F.coalesce(F.nullif(F.regexp_extract(text, r"((?:women's )?(?:light )?(?:straw|fly|bantam|feather|light|welter|middle|heavy|catch )weight)", 1), F.lit("")), F.lit("any"))


def fill_contests(df: DataFrame, fields: tuple[Field, ...] = FIELDS, key: str = "bout_id", day: str = "event_date", block_rows: int = BLOCK_ROWS, modal: bool = False) -> DataFrame:
    """One row per contest with the red side's fields filled.

    Columns: the key; for each field ``red_<field>`` as BIGINT (whole inches, or yyyymmdd), ``red_<field>_mark`` (null:
    observed, "same fighter", "similar contests", "none"), ``red_<field>_donor`` and ``red_<field>_distance`` (the donor
    contest's key and its distance in days; null where observed).

    A value is missing if it is null, NaN, out of the field's range, or gives an impossible age. Donors are first the
    same fighter's records with a usable value, on either side; failing these, the records of the same weight class. With
    ``modal`` only those of the fighter's records donate that hold the fighter's most frequent usable value. Repeated rows
    count once; an empty table gives no rows; a contest without a fighter id is filled from similar contests only. Columns
    not named here are ignored.
    """
    names = [f"{s}_{f.name}" for s in ("red", "blue") for f in fields]
    rows = df.select(key, day, "red_fighter_id", "blue_fighter_id", *names, *(["bout_type"] if "bout_type" in df.columns else [])).distinct()
    obs = checkpoint(observations(rows, fields, key, day, weight_class() if "bout_type" in df.columns else F.lit("any")))
    n = len(fields)
    none = F.lit(None).cast(f"struct<day:int,k:{df.schema[key].dataType.simpleString()},value:bigint,distance:int>")
    # pass 1: the same fighter
    same = nearest_donors(obs, "entity", n, modal, block_rows).where("red").unionByName(obs.where("red AND entity IS NULL").select("*", *[none.alias(f"d{i}") for i in range(n)]))
    red = same.select("k", *[x for i in range(n) for x in (f"v{i}", f"d{i}")])
    # pass 2: the weight class; any usable record of it is a donor
    peers = nearest_donors(obs, "similar", n, False, block_rows).where("red")
    red = red.join(peers.select("k", *[F.col(f"d{i}").alias(f"s{i}") for i in range(n)]), "k", "left")
    out = [F.col("k").alias(key)]
    for i, f in enumerate(fields):
        v, d, s = F.col(f"v{i}"), F.col(f"d{i}"), F.col(f"s{i}")
        donor = F.when(v.isNull(), F.coalesce(d, s))
        mark = F.when(v.isNotNull(), F.lit(None)).when(d.isNotNull(), "same fighter").when(s.isNotNull(), "similar contests").otherwise("none")
        out += [F.coalesce(v, donor["value"]).alias(f"red_{f.name}"), mark.alias(f"red_{f.name}_mark"), donor["k"].alias(f"red_{f.name}_donor"), donor["distance"].alias(f"red_{f.name}_distance")]
    return red.select(*out)


def filled_from_same(filled: DataFrame, fields: tuple[Field, ...] = FIELDS, key: str = "bout_id") -> DataFrame:
    """One row per contest and field that the same fighter's records filled."""
    cells = F.array(*[F.struct(F.lit(f"red_{f.name}").alias("field_name"), F.col(f"red_{f.name}").alias("filled"), F.col(f"red_{f.name}_mark").alias("mark")) for f in fields])
    return filled.select(key, F.inline(cells)).where("mark = 'same fighter'").drop("mark")
