"""Readers, header handling and writers."""

from __future__ import annotations

import csv
import json
import os
import re
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.functions.text import clean_text_columns

#: Headers under which a profile attribute is found.
PROFILE_ALIASES = {
    "fighter_name": ("fighter_name", "name", "fighter", "full_name", "fighter_full_name"),
    "height": ("height", "ht", "fighter_height", "height_in", "height_inches", "height_cm", "height_cms"),
    "weight": ("weight", "wt", "fighter_weight", "weight_lbs", "weight_in_lbs", "weight_kg", "weight_kgs"),
    "reach": ("reach", "fighter_reach", "reach_in", "reach_inches", "reach_cm", "reach_cms"),
    "stance": ("stance", "fighter_stance"),
    "dob": ("dob", "date_of_birth", "birth_date", "fighter_dob"),
}
#: Headers of a quote table, by target.
QUOTE_ALIASES = {
    "event_date": ("event_date", "date", "fight_date", "eventdate", "commence_time"),
    "fighter_1": ("fighter_1", "fighter1", "red_fighter", "fighter_a", "home_fighter", "fighter_a_name"),
    "fighter_2": ("fighter_2", "fighter2", "blue_fighter", "fighter_b", "away_fighter", "fighter_b_name", "opponent"),
    "odds_1": ("fighter_1_odds", "fighter1_odds", "red_odds", "odds_1", "moneyline_1", "fighter_a_odds"),
    "odds_2": ("fighter_2_odds", "fighter2_odds", "blue_odds", "odds_2", "moneyline_2", "fighter_b_odds"),
    "source": ("source", "bookmaker", "sportsbook", "book", "site"),
    "quoted_at": ("timestamp", "date_scraped", "scraped_at", "created_at", "updated_at", "snapshot_time"),
}


def sniff_delimiter(text: str, choices: str = ",;") -> str:
    """The delimiter of the sample; where sniffing fails, the more frequent in the first line; "," for a blank sample."""
    if not text.strip():
        return ","
    try:
        return csv.Sniffer().sniff(text[:8192], delimiters=choices).delimiter
    except csv.Error:
        return count_delimiter(text.splitlines()[0], choices)


def count_delimiter(text: str, choices: str = ",;") -> str:
    return max(choices, key=lambda c: (text[:4096].count(c), c == ","))


def snake_headers(names: list[str]) -> list[str]:
    """Lower case with single underscores; a repeated header gets _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        clean = re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_") or "column"
        seen[clean] = seen.get(clean, 0) + 1
        out.append(clean if seen[clean] == 1 else f"{clean}_{seen[clean]}")
    return out


def _first_lines(spark: SparkSession, path: str, label: str) -> list[str]:
    """The first lines of a file, wherever it lies."""
    try:
        return [r[0] for r in spark.read.text(path).limit(20).collect()]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"{label} not found: {path}") from e
        raise


def read_csv(spark: SparkSession, path: str, label: str = "table", schema: T.StructType | None = None) -> DataFrame:
    """A CSV table with its delimiter found from its first lines, headers in snake case and placeholder texts as null.

    A missing file raises FileNotFoundError; an empty one gives an empty table. Without a schema all columns are strings:
    inferring types would read the data twice.
    """
    lines = _first_lines(spark, path, label)
    if not lines:
        return spark.createDataFrame([], schema or T.StructType([]))
    reader = spark.read.option("header", True).option("sep", sniff_delimiter("\n".join(lines))).option("multiLine", False)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return clean_text_columns(df.toDF(*snake_headers(df.columns)))


def try_read_csv(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """An optional source: an empty table of the schema where there is no path or no file."""
    try:
        return spark.createDataFrame([], schema) if path is None else read_csv(spark, path, schema=schema)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)


def read_backtest_inputs(spark: SparkSession, predictions: str, merged: str, keys: tuple[str, ...] = ("event_date", "red_fighter_name", "blue_fighter_name")) -> tuple[DataFrame, DataFrame]:
    """The predictions and the contests with prices of a backtest, with typed dates; ValueError where a key column is missing."""
    out = []
    for path in (predictions, merged):
        df = read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
        missing = [k for k in keys if k not in df.columns]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
        out.append(df.withColumn("event_date", F.col("event_date").try_cast("date")) if "event_date" in df.columns else df)
    return out[0], out[1]


def read_contests(spark: SparkSession, path: str, day: str = "event_date", target: str = "red_win") -> DataFrame:
    """A built feature table again: typed date and target, rows without either left out."""
    df = spark.read.parquet(path) if not path.endswith(".csv") else read_csv(spark, path)
    typed = df.withColumn(day, F.col(day).try_cast("date")).withColumn(target, F.col(target).try_cast("int"))
    return typed.where(F.col(day).isNotNull() & F.col(target).isNotNull())


BET_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("event_date", "red_fighter_name", "blue_fighter_name", "selected_side")] + [T.StructField(c, T.DoubleType()) for c in ("edge_threshold", "selected_edge", "selected_decimal_odds", "selected_model_prob", "selected_market_prob", "stake", "profit")] + [T.StructField("bet_won", T.BooleanType())])


def read_bets(spark: SparkSession, path: str) -> DataFrame:
    """A table of bets with its declared types; values that don't read are null."""
    df = read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in BET_SCHEMA.fields])


def first_existing(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    return next((a for a in aliases if a in columns), None)


def matching_column(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """An exact match of normalised headers first, then one that contains, or lies in, an alias."""
    plain = {c: re.sub(r"[^a-z0-9]", "", c.lower()) for c in columns}
    wanted = [re.sub(r"[^a-z0-9]", "", a.lower()) for a in aliases]
    exact = next((c for w in wanted for c, p in plain.items() if p == w), None)
    return exact or next((c for w in wanted for c, p in plain.items() if p and (w in p or p in w)), None)


def resolve_columns(columns: list[str], aliases: dict[str, tuple[str, ...]], fuzzy: bool = False) -> dict[str, str]:
    """Target -> the table's header, for those found; with ``fuzzy`` no header serves two targets."""
    out, free = {}, list(columns)
    for target, names in aliases.items():
        found = matching_column(free, names) if fuzzy else first_existing(free, names)
        if found:
            out[target] = found
            if fuzzy:
                free.remove(found)
    return out


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with each missing column (name -> type) as null."""
    return df.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in columns.items() if c not in df.columns])


def locate_quotes(folder: str, league: str = "ufc") -> str | None:
    """The CSV file of a local folder that most likely holds quotes: by words in its name, then by size; null without one."""
    words = ("odds", "book", "bet", "moneyline", "line")
    files = [p for p in Path(folder).glob("*.csv") if any(w in p.name.lower() for w in words)]
    best = max(files, key=lambda p: ("odds" in p.name.lower(), league in p.name.lower(), p.stat().st_size, p.name), default=None)
    return str(best) if best else None


def read_parameters(path: str, default: dict) -> dict:
    """Parameters from a JSON file over the defaults; the defaults where there is no file."""
    return default | json.loads(Path(path).read_text()) if os.path.exists(path) else dict(default)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition: list[str] | None = None) -> None:
    """Parquet (the default, for stages and results) or CSV with a header."""
    writer = df.write.mode("overwrite").partitionBy(*(partition or []))
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def write_report(payload: dict | str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(payload if isinstance(payload, str) else json.dumps(payload, indent=2, sort_keys=True, default=str))
