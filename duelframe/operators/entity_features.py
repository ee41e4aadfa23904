"""Per-entity feature table from typed event records, built in dense numpy blocks.

Records are de-duplicated by key, hashed into buckets by entity, turned into (entity index, type index) cells and summed
with ``bincount``; the latest day is a maximum scatter. Each entity leaves the operator as one row of Arrow list columns
that hold one slot for every type the entity has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.runtime import checkpoint, parallelism

#: Cells of one dense block (entities x types): 2M cells are 16 MB for each measure.
BLOCK_CELLS = 2_000_000
#: Records of one bucket, about; an entity with more is salted by record key.
BUCKET_ROWS = 1_000_000
#: Most entities that are salted, so that their list may be broadcast; more records make larger buckets instead.
MOST_HOT = 1_000_000


def clean_type(c: Column) -> Column:
    """Lower case, one underscore for each run of other characters than letters and digits, none at the ends."""
    text = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_")
    return F.nullif(F.regexp_replace(text, "^_|_$", ""), F.lit(""))


def latest_versions(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """One row per key, the one with the latest version (null is oldest; ties fall to the largest remaining values).

    Rows without a key cannot be versions of each other and are all kept.
    """
    order = [F.col(version).desc_nulls_last()] + [F.col(c).desc_nulls_last() for c in columns]
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.select(key, version, *columns)
    known = rows.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return known.unionByName(rows.where(F.col(key).isNull())) if df.schema[key].nullable and _has_null(df, key) else known


def _has_null(df: DataFrame, key: str) -> bool:
    return not df.where(F.col(key).isNull()).select(F.lit(1)).limit(1).isEmpty()


def entity_features(
    df: DataFrame,
    entity: str = "fighter_id",
    kind: str = "stat_type",
    day: str = "event_date",
    measures: tuple[str, ...] = ("fighter_sig_str_landed", "fighter_sig_str_attempted", "diff_win_streak"),
    key: str = "record_id",
    version: str = "loaded_at",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per entity: ``entity``, ``types``, ``n_records``, one list per measure and ``last_day`` (yyyymmdd).

    The lists of a row are parallel and ordered by type. A key counts once, in its latest version; null measures count as
    0; records whose latest version has no usable type, or no entity, are left out; a null date leaves ``last_day`` null
    unless another record of the cell has one. An empty table gives no rows. Columns not named here are ignored.

    There are as many buckets as hold ``bucket_rows`` records each; entities with more are split over several of them by
    the key's hash and their partial rows are merged afterwards, so that no task holds a whole hot entity. Types are
    indexed within a bucket, so their number has no bound.
    """
    spark = df.sparkSession
    rows = latest_versions(df.select(key, version, entity, clean_type(F.col(kind)).alias("__kind"), F.col(day).cast("date").alias("__day"), *[F.col(m).cast("long").alias(f"__m{i}") for i, m in enumerate(measures)]), key, version, [entity, "__kind", "__day", *[f"__m{i}" for i in range(len(measures))]])
    rows = rows.where(F.col("__kind").isNotNull() & F.col(entity).isNotNull())
    # The numbers of records come from a narrow scan that aggregates before it shuffles.
    loads = df.where(F.col(entity).isNotNull()).groupBy(entity).count()
    total = loads.agg(F.sum("count")).first()[0] or 0
    bucket_rows = max(bucket_rows, -(-total // MOST_HOT))
    # fewer than total / bucket_rows <= MOST_HOT rows of two numbers
    hot = checkpoint(loads.where(F.col("count") > bucket_rows).select(entity, F.ceil(F.col("count") / bucket_rows).cast("int").alias("__parts")))
    salted = rows.join(F.broadcast(hot), entity, "left")
    salt = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(key), F.col("__parts")).cast("int")).otherwise(0)
    day_no = F.year("__day") * 10000 + F.month("__day") * 100 + F.dayofmonth("__day")
    buckets = salted.select(F.col(entity).alias("__entity"), salt.alias("__salt"), "__kind", day_no.cast("int").alias("__day"), *[f"__m{i}" for i in range(len(measures))]).repartition(max(parallelism(spark), -(-total // bucket_rows)), "__entity", "__salt").drop("__salt")
    lists = [T.StructField("n_records", T.ArrayType(T.LongType()))] + [T.StructField(f"total_{m}", T.ArrayType(T.LongType())) for m in measures] + [T.StructField("last_day", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(entity, df.schema[entity].dataType), T.StructField("types", T.ArrayType(T.StringType())), *lists])
    parts = buckets.mapInArrow(_block_folder(len(measures), [f.name for f in schema]), schema)
    if hot.isEmpty():
        return parts
    parts = checkpoint(parts)
    merged = long_rows(parts.join(F.broadcast(hot), entity, "left_semi"), entity, measures)
    return parts.join(F.broadcast(hot), entity, "left_anti").unionByName(_collect_lists(merged, entity, measures))


def _block_folder(n_measures: int, names: list[str]):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entities, cells, days, values = [], [], [], [[] for _ in range(n_measures)]
        known: dict[str, int] = {}  # the bucket's types by their index
        for batch in batches:
            entities.append(batch.column(0))
            coded = batch.column(1).dictionary_encode()
            index = np.array([known.setdefault(k, len(known)) for k in coded.dictionary.to_pylist()], np.int32)
            cells.append(index[coded.indices.to_numpy(zero_copy_only=False)] if len(index) else np.empty(0, np.int32))
            days.append(pc.fill_null(batch.column(2), 0).to_numpy(zero_copy_only=False))
            for i in range(n_measures):
                values[i].append(pc.fill_null(batch.column(3 + i), 0).to_numpy(zero_copy_only=False))
        if not entities:
            return
        coded = pa.chunked_array(entities).combine_chunks()
        coded = (coded if isinstance(coded, pa.Array) else coded.chunk(0)).dictionary_encode()
        who, kind, day = coded.indices.to_numpy(zero_copy_only=False), np.concatenate(cells), np.concatenate(days)
        values = [np.concatenate(v) for v in values]
        order = np.argsort(who, kind="stable")
        who, kind, day, values = who[order], kind[order], day[order], [v[order] for v in values]
        # types in order, so that a row's lists are
        order = sorted(range(len(known)), key=list(known).__getitem__)
        vocabulary = pa.array(sorted(known), pa.string())
        place = np.empty(len(known), np.int32)
        place[order] = np.arange(len(known))
        kind, width, ids = place[kind], len(known), coded.dictionary
        step = max(1, BLOCK_CELLS // max(1, width))
        edges = np.searchsorted(who, np.arange(0, len(ids) + step, step))
        for b in range(len(edges) - 1):
            lo, hi, first = edges[b], edges[b + 1], b * step
            if lo == hi:
                continue
            entities_here = min(step, len(ids) - first)
            cell = (who[lo:hi] - first).astype(np.int64) * width + kind[lo:hi]
            counts = np.bincount(cell, minlength=entities_here * width)
            filled = np.flatnonzero(counts)
            # bincount sums in doubles: exact for integers whose absolute sum stays under 2**53
            sums = [_exact_sums(cell, v[lo:hi], entities_here * width)[filled] for v in values]
            last = np.zeros(entities_here * width, np.int64)
            np.maximum.at(last, cell, day[lo:hi])
            last = last[filled]
            offsets = pa.array(np.searchsorted(filled, np.arange(entities_here + 1) * width).astype(np.int32))
            kinds_here = vocabulary.take(pa.array(filled % width))
            columns = [ids.slice(first, entities_here), pa.ListArray.from_arrays(offsets, kinds_here)]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (counts[filled].astype(np.int64), *sums)]
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(last, mask=last == 0)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return fold


def _exact_sums(cell: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    if len(value) and float(np.abs(value).astype(np.float64).sum()) >= 2.0**53:
        out = np.zeros(size, np.int64)
        np.add.at(out, cell, value)
        return out
    return np.bincount(cell, weights=value, minlength=size).astype(np.int64)


def long_rows(features: DataFrame, entity: str, measures: tuple[str, ...]) -> DataFrame:
    """One row per entity and type of the list columns."""
    lists = ["types", "n_records", *[f"total_{m}" for m in measures], "last_day"]
    zipped = F.arrays_zip(*[F.col(c) for c in lists])
    return features.select(entity, F.inline(zipped)).withColumnRenamed("types", "stat_type")


def _collect_lists(rows: DataFrame, entity: str, measures: tuple[str, ...]) -> DataFrame:
    totals = [F.sum(c).alias(c) for c in ["n_records", *[f"total_{m}" for m in measures]]]
    cells = rows.groupBy(entity, "stat_type").agg(*totals, F.max("last_day").alias("last_day"))
    names = ["n_records", *[f"total_{m}" for m in measures], "last_day"]
    packed = cells.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("stat_type", *names))).alias("__cells"))
    return packed.select(entity, F.col("__cells.stat_type").alias("types"), *[F.col(f"__cells.{c}").alias(c) for c in names])


def wide_features(features: DataFrame, entity: str, types: list[str], column: str, default: int | None = 0) -> DataFrame:
    """The named list column spread over one column per type; absent types give ``default``."""
    cells = F.map_from_arrays("types", column)
    return features.select(entity, *[F.coalesce(F.element_at(cells, F.lit(t)), F.lit(default).cast("long")).alias(f"{column}__{t}") for t in types])
