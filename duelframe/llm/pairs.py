"""All pairs within groups, with no task that holds a large group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_in_groups(rows: DataFrame, group: str, member: str, size: str, block: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``<member>_a < <member>_b`` of all members of a group, with the columns of ``keep`` of both as ``_a`` and ``_b``.

    ``size`` is a column with the number of the group's rows. A group is split by the members' hash into blocks of about
    ``block``; a member goes to the cell of its block with each other block, so one task makes the pairs of at most two
    blocks. Two members of one block meet in that block's own cell only. Each member must be once in its group.
    """
    parts = F.ceil(F.col(size) / block).cast("int")
    placed = rows.select(group, member, *keep, parts.alias("__s")).withColumn("__r", F.pmod(F.xxhash64(member), F.col("__s")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("__s") - 1), lambda j: F.struct(F.least(F.col("__r"), j).alias("i"), F.greatest(F.col("__r"), j).alias("j")))
    spread = placed.select(group, member, *keep, "__r", F.explode(cells).alias("__c")).select("*", F.col("__c.i").alias("__i"), F.col("__c.j").alias("__j"))

    def side(s: str) -> DataFrame:
        return spread.select(group, "__i", "__j", F.col("__r").alias(f"__r{s}"), *[F.col(c).alias(f"{c}_{s}") for c in (member, *keep)])

    meet = (F.col(f"{member}_a") < F.col(f"{member}_b")) & ((F.col("__ra") != F.col("__rb")) | (F.col("__i") == F.col("__j")))
    return side("a").join(side("b"), [group, "__i", "__j"]).where(meet).drop("__i", "__j", "__ra", "__rb")
