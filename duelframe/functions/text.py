"""Text parsers and key builders as Column -> Column functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for a missing value.
PLACEHOLDERS = ("", " ", "---", "--", "-", "null", "NULL", "None", "none", "nan", "NaN")
#: Contest classes, in the order in which they are looked for.
WEIGHT_CLASSES = (
    "women's strawweight",
    "women's flyweight",
    "women's bantamweight",
    "women's featherweight",
    "light heavyweight",
    "middleweight",
    "welterweight",
    "lightweight",
    "featherweight",
    "bantamweight",
    "flyweight",
    "heavyweight",
    "open weight",
    "catch weight",
    "superfight",
)


def number(text: Column) -> Column:
    """The text as a double, null where it is no number (never an error)."""
    return text.try_cast("double")


def clean_placeholder(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*PLACEHOLDERS), F.trim(c))


def clean_text_columns(df: DataFrame) -> DataFrame:
    """Every string column trimmed, placeholder texts to null."""
    return df.select(*[clean_placeholder(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def simple_name(c: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space; empty is null."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), F.lit(""))


def _unmarked(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x))


@F.pandas_udf(T.StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _unmarked(x))


def strip_marks(c: Column) -> Column:
    """Compatibility decomposition without combining marks; there is no such built-in. ASCII texts stay in the JVM."""
    return F.coalesce(_decomposed(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def name_key(c: Column) -> Column:
    """Upper case ASCII letters, digits and single spaces; letters that don't decompose become a space; null is ''."""
    plain = F.upper(strip_marks(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^A-Z0-9\s]", " "), r"\s+", " "))


def source_name(c: Column) -> Column:
    """Marks removed, white space collapsed, case kept; null and blank are UNKNOWN_SOURCE."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(strip_marks(c), r"\s+", " ")), F.lit("")), F.lit("UNKNOWN_SOURCE"))


def text_key(c: Column) -> Column:
    """Lower case words joined by single underscores; null is ''."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip_marks(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), "^_|_$", "")


def weight_class(c: Column) -> Column:
    """The first label that the text contains, in title case; null without one."""
    text = F.lower(c)
    return reduce(lambda rest, label: F.when(F.contains(text, F.lit(label)), F.lit(_title(label))).otherwise(rest), reversed(WEIGHT_CLASSES), F.lit(None).cast("string"))


def _title(label: str) -> str:
    return " ".join(w[0].upper() + w[1:] for w in label.split())


_OF = r"^(\d+(?:\.\d+)?)\s+of\s+(\d+(?:\.\d+)?)$"


def landed(c: Column) -> Column:
    """The first number of "3 of 12"; null for any other text."""
    return number(F.regexp_extract(F.trim(c), _OF, 1))


def attempted(c: Column) -> Column:
    return number(F.regexp_extract(F.trim(c), _OF, 2))


def parse_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``<column>_landed`` and ``<column>_attempted`` of each "x of y" column that the table has; present numbers win where the text has none."""
    out = {}
    for c in columns:
        if c in df.columns:
            for part, value in (("landed", landed(F.col(c))), ("attempted", attempted(F.col(c)))):
                name = f"{c}_{part}"
                out[name] = F.coalesce(value, F.col(name).try_cast("double")) if name in df.columns else value
    return df.withColumns(out) if out else df


def clock_seconds(c: Column) -> Column:
    """Seconds of "m:ss", "h:mm:ss" or a plain number; null for anything else."""
    parts = F.split(F.trim(c), ":")
    part = lambda i: number(F.get(parts, F.lit(i)))
    size = F.size(parts)
    return F.when(size == 1, part(0)).when(size == 2, part(0) * 60 + part(1)).when(size == 3, part(0) * 3600 + part(1) * 60 + part(2))


def contest_seconds(round_: Column, clock: Column, round_seconds: int = 300) -> Column:
    """Length of a contest that ended at ``clock`` of its round; null without a round."""
    return (round_.try_cast("double") - 1) * round_seconds + clock_seconds(clock)


def first_number(c: Column) -> Column:
    return number(F.regexp_extract(c, r"\d+(?:\.\d+)?", 0))


def inches(c: Column) -> Column:
    """Feet and inches in either quote style, else centimetres, else the first number."""
    text = F.translate(c, "’‘′″”“", "'''\"\"\"")
    feet = r"(\d+)\s*(?:'|ft)\s*(\d+(?:\.\d+)?)?"
    f, i = number(F.regexp_extract(text, feet, 1)), number(F.regexp_extract(text, feet, 2))
    cm = number(F.regexp_extract(F.lower(text), r"(\d+(?:\.\d+)?)\s*cm", 1)) / 2.54
    return F.coalesce(f * 12 + F.coalesce(i, F.lit(0.0)), cm, first_number(text))


def share(c: Column) -> Column:
    """"55%" as 0.55; a bare number above 1 is a percentage too."""
    value = first_number(c)
    return F.when(F.contains(c, F.lit("%")) | (value > 1), value / 100).otherwise(value)


def measure(c: Column, header: str, kind: str) -> Column:
    """A height, weight or reach whose unit its column's header states (cm, kg); inches and pounds otherwise."""
    value = inches(c) if kind in ("height", "reach") else first_number(c)
    words = header.lower()
    if kind == "weight":
        return value * 2.2046226218 if "kg" in words else value
    return first_number(c) / 2.54 if "cm" in words else value


def scheduled_rounds(c: Column) -> Column:
    """Rounds of "5 Rnd (5-5-5-5-5)"; else the number of parts in brackets; else the first number."""
    stated = F.regexp_extract(F.lower(c), r"^\s*(\d+)\s*rnd", 1).try_cast("int")
    inside = F.regexp_extract(c, r"\(([^)]*)\)", 1)
    parts = F.when(F.length(inside) > 0, F.size(F.filter(F.split(inside, "-"), lambda x: F.length(F.trim(x)) > 0)))
    return F.coalesce(stated, F.nullif(parts, F.lit(0)), F.regexp_extract(c, r"\d+", 0).try_cast("int"))


def method_flags(method: Column, happened: Column) -> dict[str, Column]:
    """0/1 for ko, submission and decision in the method, only where ``happened`` (a win, or a loss)."""
    text = F.lower(F.coalesce(method, F.lit("")))
    return {m: F.when(happened & F.contains(text, F.lit(m)), 1).otherwise(0) for m in ("ko", "submission", "decision")}


def unordered_key(a: Column, b: Column) -> Column:
    """One key for both orders of a pair; null counts as ''."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.concat(F.least(a, b), F.lit("__"), F.greatest(a, b))


def row_key(*columns: Column) -> Column:
    return F.concat_ws("||", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
