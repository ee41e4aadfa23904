"""Quantities written in different units, brought to canonical units.

A small grammar reads numbers and unit words; a unit is an exponent vector over base dimensions with a scale and an
offset to SI. A value expression is one quantity or a compound of falling units of one dimension ("5 ft 11", "13st 6",
"1m93"); a second expression in parentheses restates the first and is only used when the first can't be read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base dimensions of the exponent vectors.
DIMENSIONS = ("length", "mass", "time", "temperature")


@dataclass(frozen=True)
class Unit:
    """``si = value * scale + offset``; ``exponents`` are powers of DIMENSIONS; ``below`` is the unit a bare number after it is in."""

    exponents: tuple[int, int, int, int]
    scale: float
    offset: float = 0.0
    below: str | None = None

    def __mul__(self, other: Unit) -> Unit:
        return Unit(tuple(a + b for a, b in zip(self.exponents, other.exponents)), self.scale * other.scale)

    def __pow__(self, n: int) -> Unit:
        return Unit(tuple(a * n for a in self.exponents), self.scale**n)

    def convert(self, value: float, to: Unit) -> float:
        if self.exponents != to.exponents:
            raise ValueError("dimensions differ")
        return (value * self.scale + self.offset - to.offset) / to.scale


LENGTH, MASS, TIME, TEMPERATURE = (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)
UNITS = {
    "m": Unit(LENGTH, 1.0, below="cm"),
    "cm": Unit(LENGTH, 0.01),
    "mm": Unit(LENGTH, 0.001),
    "in": Unit(LENGTH, 0.0254),
    "ft": Unit(LENGTH, 0.3048, below="in"),
    "yd": Unit(LENGTH, 0.9144),
    "km": Unit(LENGTH, 1000.0),
    "mi": Unit(LENGTH, 1609.344),
    "kg": Unit(MASS, 1.0),
    "g": Unit(MASS, 0.001),
    "lb": Unit(MASS, 0.45359237, below="oz"),
    "oz": Unit(MASS, 0.028349523125),
    "st": Unit(MASS, 6.35029318, below="lb"),
    "s": Unit(TIME, 1.0),
    "min": Unit(TIME, 60.0, below="s"),
    "h": Unit(TIME, 3600.0, below="min"),
    "K": Unit(TEMPERATURE, 1.0),
    "C": Unit(TEMPERATURE, 1.0, 273.15),
    "F": Unit(TEMPERATURE, 5 / 9, 459.67 * 5 / 9),
}
#: Spellings of the units.
SPELLINGS = {
    "m": "m meter meters metre metres",
    "cm": "cm cms centimeter centimeters centimetre centimetres",
    "mm": "mm millimeter millimeters millimetre millimetres",
    "in": "in ins inch inches \" '' ″ ” “ ’’ ′′",
    "ft": "ft foot feet ' ′ ’ ‘ `",
    "yd": "yd yard yards",
    "km": "km kms kilometer kilometers kilometre kilometres",
    "mi": "mi mile miles",
    "kg": "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes",
    "g": "g gr gram grams gramme grammes",
    "lb": "lb lbs pound pounds #",
    "oz": "oz ounce ounces",
    "st": "st stone stones",
    "s": "s sec secs second seconds",
    "min": "min mins minute minutes",
    "h": "h hr hrs hour hours",
    "K": "kelvin",
    "C": "°c celsius",
    "F": "°f fahrenheit",
}
WORDS = {word: unit for unit, words in SPELLINGS.items() for word in words.split()}
#: Words for a whole system of units, as length and mass unit.
SYSTEMS = {"metric": ("cm", "kg"), "imperial": ("in", "lb"), "us": ("in", "lb")}
#: Texts that stand for no value.
PLACEHOLDERS = {"", "-", "--", "---", "n/a", "na", "null", "none", "nan", "unknown", "tbd", "?", "tba"}

#: Symbols that may touch; longest first.
_SYMBOLS = sorted((w for w in WORDS if not w[-1].isalpha()), key=len, reverse=True)
_TOKEN = re.compile(r"(?P<number>\d+(?:[.,]\d+)*)|(?P<word>°[cf]\b|[^\W\d_]+)|(?P<symbol>" + "|".join(map(re.escape, _SYMBOLS)) + r")|(?P<open>[(\[])|(?P<close>[)\]])|(?P<dash>[-–])|(?P<other>\S)", re.I)


def _number(text: str) -> float:
    """A comma followed by other than three digits, or alone with a zero before it, is a decimal comma."""
    if "," in text and "." in text:
        text = text.replace(".", "").replace(",", ".") if text.rfind(",") > text.rfind(".") else text.replace(",", "")
    elif text.count(",") == 1 and not (len(text.split(",")[1]) == 3 and text[0] != "0" and len(text.split(",")[0]) > 1):
        text = text.replace(",", ".")
    else:
        text = text.replace(",", "")
    return float(text) if text.count(".") < 2 else float(text.replace(".", ""))


def tokens(text: str) -> list[tuple[str, object]]:
    """Numbers, units and brackets in order; words that are no units are dropped."""
    out: list[tuple[str, object]] = []
    for m in _TOKEN.finditer(text):
        kind, part = m.lastgroup, m.group()
        if kind == "number":
            out.append(("number", _number(part)))
        elif kind in ("word", "symbol"):
            word = part.lower()
            if word in WORDS:
                out.append(("unit", WORDS[word]))
            elif word in SYSTEMS:
                out.append(("system", word))
        elif kind != "other":
            out.append((kind, part))
    return out


def _expression(part: list[tuple[str, object]], exponents: tuple) -> tuple[float, str | None] | None:
    """``expression := quantity (quantity)*``, ``quantity := number unit? | unit number``; also ``feet - inches``."""
    numbers = [v for k, v in part if k == "number"]
    if not numbers:
        return None
    units = [v for k, v in part if k == "unit" and UNITS[v].exponents == exponents]
    kinds = [k for k, _ in part]
    if not units:
        if exponents == LENGTH and kinds[:3] == ["number", "dash", "number"] and 3 <= numbers[0] <= 8 and numbers[1] < 12:
            return (numbers[0] * 0.3048 + numbers[1] * 0.0254), "si"
        return numbers[0], None
    if part[0][0] == "unit":  # "KG 60.8": the unit stands before its number
        return UNITS[part[0][1]].convert(numbers[0], Unit(exponents, 1.0)) if UNITS[part[0][1]].exponents == exponents else numbers[0], "si"
    total, last, i = 0.0, None, 0
    while i < len(part):
        kind, value = part[i]
        if kind != "number":
            i += 1
            continue
        if i + 1 < len(part) and part[i + 1][0] == "unit" and UNITS[part[i + 1][1]].exponents == exponents:
            unit, i = part[i + 1][1], i + 2
        else:
            unit, i = (UNITS[last].below if last else units[0]), i + 1
        if unit is None or (last and UNITS[unit].scale >= UNITS[last].scale):
            break  # what follows restates the value
        total += value * UNITS[unit].scale + UNITS[unit].offset
        last = unit
    return total, "si"


def parse_quantity(text: str | None, exponents: tuple) -> tuple[float, bool] | None:
    """(value, is it SI). A value without a unit comes back as written; None: no value."""
    if text is None or text.strip().lower() in PLACEHOLDERS:
        return None
    groups, depth = [[]], 0
    for token in tokens(text):
        if token[0] == "open":
            depth += 1
            groups.append([])
        elif token[0] == "close":
            depth = max(0, depth - 1)
            groups.append([])
        else:
            groups[-1].append(token)
    read = [r for r in (_expression(g, exponents) for g in groups if g) if r]
    if not read:
        return None
    value, unit = next((r for r in read if r[1]), read[0])
    return value, unit is not None


_FACTOR = re.compile(r"(?P<by>per\b|[/])|(?P<times>[*·×])(?!\*)|(?P<power>(?:\^|\*\*)\s*-?\d+|[²³]|\bsquared\b|\bcubed\b)|(?P<unit>°[cf]\b|[^\W\d_²³]+|" + "|".join(map(re.escape, _SYMBOLS)) + r")|(?P<other>\S)", re.I)
_POWERS = {"²": 2, "³": 3, "squared": 2, "cubed": 3}


def parse_unit(text: str) -> Unit | None:
    """``unit := factor (("*" | "/" | "per")? factor)*``, ``factor := word power?``: a product of powers; None if it doesn't read.

    A slash holds for the next factor only. Offsets count only where a unit stands alone: in a product a degree is a difference.
    """
    factors: list[list] = []  # unit, power
    sign = 1
    for m in _FACTOR.finditer(text.strip()):
        kind, part = m.lastgroup, m.group().lower()
        if kind == "unit" and part in WORDS:
            factors.append([UNITS[WORDS[part]], sign])
            sign = 1
        elif kind == "by":
            sign = -1
        elif kind == "power" and factors:
            factors[-1][1] *= _POWERS[part] if part in _POWERS else int(part.lstrip("^* "))
        elif kind != "times":
            return None
    if not factors:
        return None
    if len(factors) == 1 and factors[0][1] == 1:
        return factors[0][0]
    out = Unit((0, 0, 0, 0), 1.0)
    for unit, power in factors:
        out = out * unit**power
    return out


def parse_measurement(text: str | None, to: str) -> float | None:
    """The value of "12.5 km/h"-like text in the unit ``to``; None without a number, a readable unit, or with other dimensions."""
    m = re.match(r"\s*([-+]?)\s*(\d+(?:[.,]\d+)*)(.*)$", text or "", re.S)
    unit, target = parse_unit(m.group(3)) if m else None, parse_unit(to)
    if target is None:
        raise ValueError(f"no unit: {to}")
    if unit is None or unit.exponents != target.exponents:
        return None
    return (-1 if m.group(1) == "-" else 1) * _number(m.group(2)) * unit.scale / target.scale if not (unit.offset or target.offset) else unit.convert((-1 if m.group(1) == "-" else 1) * _number(m.group(2)), target)


#: "in" is mostly a preposition: it is a unit only in a list of units joined by marks.
_LISTED = "|".join(sorted((re.escape(w) for w in WORDS if w[-1].isalpha() and w != "in"), key=len, reverse=True))
_INCHES = re.compile(rf"(?<![\w-])in\s*[,/&+]\s*(?:{_LISTED})\b|\b(?:{_LISTED})\s*[,/&+]\s*in\b", re.I)


def stated_unit(text: str | None, exponents: tuple) -> str | None:
    """The unit of this dimension that other text of the row names, if it names exactly one."""
    text = text or ""
    named = {"in"} if exponents == LENGTH and _INCHES.search(text) else set()
    for kind, value in tokens(re.sub(r"\bin\b", " ", text, flags=re.I)):
        if kind == "unit" and UNITS[value].exponents == exponents:
            named.add(value)
        elif kind == "system":
            named |= {u for u in SYSTEMS[value] if UNITS[u].exponents == exponents}
    return named.pop() if len(named) == 1 else None


@dataclass(frozen=True)
class Measure:
    """A field, its canonical unit, what a bare number may be in, and the range of an adult's value in the canonical unit."""

    field: str
    canonical: str
    bare: tuple[str, ...]
    least: float
    most: float

    @property
    def exponents(self) -> tuple:
        return UNITS[self.canonical].exponents


#: Heights and reaches in inches, weights in pounds.
PERSON = (
    Measure("height", "in", ("in", "cm", "m", "mm", "ft"), 48.0, 96.0),
    Measure("reach", "in", ("in", "cm", "m", "mm", "ft"), 48.0, 96.0),
    Measure("weight", "lb", ("lb", "kg", "g", "st"), 88.0, 400.0),
)
#: Body mass index about which an adult fighter's weight is most plausible, where two units fit.
LIKELY_BMI = 24.0


def resolve_row(texts: dict[str, str | None], note: str | None, measures: tuple[Measure, ...] = PERSON) -> dict[str, float | None]:
    """Canonical values of one row. A bare number takes the unit the note states, else the one that makes it an adult's.

    Where several units fit a weight, the row's height (else reach) decides by body mass index; without either, a
    fractional number is a conversion and so in the later of the two units.
    """
    out: dict[str, float | None] = {}
    metres = None
    for m in measures:
        read = parse_quantity(texts.get(m.field), m.exponents)
        to = UNITS[m.canonical]
        if read is None:
            out[m.field] = None
            continue
        value, si = read
        if si:
            out[m.field] = (value - to.offset) / to.scale
        else:
            stated = stated_unit(note, m.exponents)
            fits = {u: UNITS[u].convert(value, to) for u in ((stated,) if stated else m.bare)}
            if not stated:
                fits = {u: v for u, v in fits.items() if m.least <= v <= m.most}
            if len(fits) > 1:
                if m.exponents == MASS and metres:
                    fits = dict([min(fits.items(), key=lambda x: abs(x[1] * to.scale / metres**2 - LIKELY_BMI))])
                elif value != int(value):
                    fits = dict(list(fits.items())[1:2])
            out[m.field] = next(iter(fits.values()), None)
        if m.exponents == LENGTH and out[m.field] and metres is None:
            metres = out[m.field] * to.scale
    return out


def canonical_measures(df: DataFrame, note: str | None = "notes", measures: tuple[Measure, ...] = PERSON) -> DataFrame:
    """The input with one ``<field>_<unit>`` double per measure, null where the text holds no value.

    Placeholders, empty and null texts give null; a value in no known unit whose size fits no unit gives null; text of any
    length is read whole. Each distinct combination of texts is parsed once per Arrow batch. Columns of the input stay as
    they are; a missing field gives null.
    """
    fields = [m.field for m in measures]
    names = [f"{m.field}_{m.canonical}" for m in measures]
    inputs = [F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string") for f in fields]
    inputs.append(F.col(note).cast("string") if note and note in df.columns else F.lit(None).cast("string"))
    schema = ", ".join(f"{n} double" for n in names)

    @F.pandas_udf(schema)
    def read(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple] = {}
        for columns in parts:
            rows = []
            for row in zip(*[c.where(c.notna(), None) for c in columns]):
                if row not in known:
                    if len(known) > 200_000:
                        known.clear()
                    got = resolve_row(dict(zip(fields, row)), row[-1], measures)
                    known[row] = tuple(got[f] for f in fields)
                rows.append(known[row])
            yield pd.DataFrame(rows, columns=names, dtype="float64")

    spread = df.select("*", read(*inputs).alias("__read"))
    return spread.select(*[c for c in df.columns if c not in names], *[F.col(f"__read.{n}").alias(n) for n in names])


def long_measures(df: DataFrame, key: str, measures: tuple[Measure, ...] = PERSON) -> DataFrame:
    """One row per key and field that holds a measure: ``field_name``, ``value``."""
    pairs = F.array(*[F.struct(F.lit(m.field).alias("field_name"), F.col(f"{m.field}_{m.canonical}").alias("value")) for m in measures])
    return df.select(key, F.inline(pairs)).where("value IS NOT NULL")
