"""Spellings of person names: reading a typed name, and linking the spellings of one person.

A typed name is read as (given name, surname) in one or more ways. Readings are points of a metric space whose distance is
the Levenshtein distance of the surnames plus a multiple of that of the given names; where the given name stays open, the
space is that of the surnames alone. Linking partitions the space: names go to their nearest pivot, boundary names also to
every cell that the triangle inequality can't rule out, and each cell runs an exact radius join.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.pairs import pairs_in_groups
from duelframe.runtime import checkpoint, parallelism, parts_for

#: Greatest distance of two spellings of one person.
RADIUS = 2
#: What an edit of the given name weighs against one of the surname. Readings have given names from a lexicon, where a typing
#: slip is already undone, so another given name is another person: the weight is above the radius.
GIVEN_WEIGHT = 4
#: Names of one cell that are aimed at, and most pivots; both are about parallel work, not about results.
CELL_NAMES, MOST_PIVOTS = 256, 4_096
#: The same where only surnames count: they lie about equally far from all pivots, so a query goes to nearly every cell.
LOOSE_NAMES = 4_096
#: Distinct given names a lexicon may have on the driver.
MOST_GIVEN = 50_000
#: Surnames up to this length are joined by their deletion neighbourhoods, longer ones by comparing.
SHORT = 40
#: Surnames of one given name that a word must stand before, and their share, to be learned as a form of that name.
LEARN_SURNAMES, LEARN_SHARE = 3, 0.2

#: Letters that do not decompose.
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "0": "o", "1": "l", "5": "s"})
#: Titles and marks beside names.
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "sr", "jr", "sir", "prof", "the", "ii", "iii"}
#: Pet forms in general use that are not the beginning of their name. A parameter of the functions below; what
#: it lacks is learned from the names (``learned_forms``).
_SHORT_FORMS = """
abigail: gail
albert: bert
alexander: sandy sasha lex
alexei: alyosha lyosha
alfred: fred
anastasia: nastya
andrew: drew
anthony: tony
barbara: babs
catherine: kate kathy katie kitty
charles: chuck
christine: tina
christopher: kit topher
dolores: lola
dmitri: dima mitya
dorothy: dolly
edward: ned ted teddy
eduardo: lalo
ekaterina: katya
eleanor: nell nora
elizabeth: liz beth betty lizzie bess libby
eugene: gene
francis: frank
francisco: paco pancho
friedrich: fritz
gerald: jerry
giovanni: gianni
harold: harry hal
heinrich: heinz
helen: nell
henry: hank harry hal
ignacio: nacho
isabella: bella
ivan: vanya
james: jim jimmy
jesus: chuy
johannes: hans hannes
john: jack
jose: pepe
katherine: kate kathy katie kitty
lawrence: larry
malgorzata: gosia
margaret: maggie meg peggy greta
maria: masha
martha: patty
mary: molly polly
michael: mike mick
mikhail: misha
natalia: natasha
nathaniel: nate
nicholas: nick
nikolai: kolya
patricia: trish
patrick: paddy
rebecca: becky becca
richard: dick rick ricky
robert: bob bobby bert
rosemary: rosie
sarah: sally
stanislaw: staszek
tatiana: tanya
theodore: ted teddy
theresa: tess
tomasz: tomek
victoria: vicky tori
virginia: ginny
vladimir: vova volodya
walter: wally
william: bill billy liam
yevgeni: zhenya
"""


def _by_pet(text: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in text.strip().splitlines():
        full, pets = line.split(": ")
        for pet in pets.split():
            out.setdefault(pet, []).append(full)
    return out


PET_FORMS = _by_pet(_SHORT_FORMS)

_ASIDE = re.compile(r"""(?<!\w)["“”„«»][^"“”„«»]*["“”„«»]|(?<!\w)['‘’][^'‘’]+['‘’](?!\w)|\([^)]*\)|\[[^\]]*\]|\baka\b.*$|[*†]""", re.I | re.S)
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")


def fold(text: str) -> str:
    """Lower case without accents, digits that stand for letters as letters; other characters stay."""
    text = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_LETTERS)


def levenshtein(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is greater: a band of the usual table."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) > len(b):
        a, b = b, a
    previous = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        lo, hi = max(1, j - most), min(len(a), j + most)
        row = [most + 1] * (len(a) + 1)
        row[0] = j
        for i in range(lo, hi + 1):
            row[i] = previous[i - 1] if a[i - 1] == y else 1 + min(previous[i - 1], previous[i], row[i - 1])
        if min(row[max(0, lo - 1) : hi + 1]) > most:
            return most + 1
        previous = row
    return min(previous[-1], most + 1)


#: Letters that look or sound alike; such a typing slip counts half.
_ALIKE = {frozenset(p) for p in ("ec", "il", "iy", "vw", "ck", "ou", "sz", "ao", "gq", "uv", "nm", "lt")}


def slip_cost(a: str, b: str) -> float:
    """How unlikely a slip from one spelling to the other is: restricted Damerau distance, half for letters alike and doubled letters."""
    if a == b:
        return 0.0
    rows = [[float(i) for i in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            change = 0.0 if x == y else 0.6 if frozenset((x, y)) in _ALIKE else 1.0
            drop = 0.7 if i > 1 and a[i - 2] == x else 1.0
            add = 0.7 if j > 1 and b[j - 2] == y else 1.0
            best = min(rows[-1][j - 1] + change, rows[-1][j] + drop, row[j - 1] + add)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, rows[-2][j - 2] + 0.9)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


#: Cost of a reading that leaves the given name open.
OPEN_COST = 1.2


class Reader:
    """Reads typed names against a lexicon of given names; ``pet_forms`` maps a pet form to the names it stands for."""

    def __init__(self, given: list[str], pet_forms: dict[str, list[str]] | None = None):
        self.pet_forms = PET_FORMS if pet_forms is None else pet_forms
        self.given = sorted(set(given))
        self._set = set(self.given)
        self._memory: dict[str, list[tuple[str, float]]] = {}
        self._near: dict[str, list[str]] | None = None

    def given_names(self, token: str) -> list[tuple[str, float]]:
        """The lexicon's names a token may stand for, with costs; none for a word that is no given name."""
        if token not in self._memory:
            if len(self._memory) > 100_000:
                self._memory.clear()
            self._memory[token] = self._given_names(token)
        return self._memory[token]

    def _given_names(self, token: str) -> list[tuple[str, float]]:
        if token in self._set:
            return [(token, 0.0)]
        if len(token) == 1:
            return [(g, 0.5) for g in self._beginning(token)]
        found = {g: 0.25 for g in self.pet_forms.get(token, ()) if g in self._set}
        found |= {g: 0.3 for g in self._beginning(token) if g not in found}
        if 2 < len(token) <= SHORT:
            for g in self._slips(token):
                most = 1 if min(len(g), len(token)) < 5 else 2
                if g not in found and levenshtein(g, token, most) <= most:
                    found[g] = min(0.2 + slip_cost(token, g), OPEN_COST)
        return list(found.items())

    def _beginning(self, token: str) -> list[str]:
        at, out = bisect_left(self.given, token), []
        while at < len(self.given) and self.given[at].startswith(token):
            out.append(self.given[at])
            at += 1
        return out

    def _slips(self, token: str) -> list[str]:
        """Names that may lie within two edits: those that share a string with the token after up to two deletions each."""
        if self._near is None:
            self._near = {}
            for g in self.given:
                for d in deletions(g, 2) if len(g) <= SHORT else ():
                    self._near.setdefault(d, []).append(g)
        return sorted({g for d in deletions(token, 2) for g in self._near.get(d, ())})

    def readings(self, name: str | None) -> list[tuple[str, str, float]]:
        """(given name, surname, cost) of each way to read a name; given name "" where it is no lexicon name."""
        if name is None:
            return []
        # a name wholly inside quotes or brackets is read as it stands
        plain = _ASIDE.sub(" ", name)
        if len(re.findall(r"[^\W\d_]", plain)) < 3:
            plain = re.sub(r"[\"“”„«»()\[\]*†]", " ", name)
        left, comma, right = plain.partition(",")
        if comma and left.strip() and right.strip():
            return self._best([(*x, 0.0) for x in self._pairs(self._tokens(right, split=False), self._tokens(left, split=False))])
        tokens = self._tokens(plain.replace(",", " "))
        if not tokens:
            return []
        if len(tokens) == 1:
            return self._best(self._glued(tokens[0]))
        if len(tokens) > 2:  # a middle initial
            tokens = [tokens[0], *[t for t in tokens[1:-1] if len(fold(t)) > 1], tokens[-1]]
        out = [(*x, 0.0) for x in self._pairs(tokens[:1], tokens[1:])]
        swapped = 0.0 if tokens[0].isupper() and not tokens[-1].isupper() or len(fold(tokens[-1])) == 1 else 0.1
        out += [(*x, swapped) for x in self._pairs(tokens[-1:], tokens[:-1]) if x[0]]
        if len(tokens) > 2:
            out += [(*x, 0.5) for x in self._pairs(tokens[:1], tokens[-1:])]
        return self._best(out)

    def _tokens(self, text: str, split: bool = True) -> list[str]:
        text = text.replace(".", ". ")
        out = []
        for word in text.split():
            word = word.strip("-–'’.;:/\\|_")
            parts = re.split(r"[-–/_]", word)
            if split and len(parts) > 1 and (fold(parts[0]) in self._set or fold(parts[-1]) in self._set):
                out += [p for p in parts if p]
            elif word:
                out.append(re.sub(r"[^\w]", "", word) or word)
        return [t for t in out if fold(t) not in _TITLES and any(c.isalnum() for c in t)]

    def _pairs(self, given: list[str], surname: list[str]) -> list[tuple[str, str, float]]:
        last = fold("".join(surname))
        first = next((fold(g) for g in given if len(fold(g)) > 1), fold(given[0]) if given else "")
        if not last or len(last) < 2:
            return []
        options = [(g, last, c) for g, c in (self.given_names(first) if first else [])]
        # a word that may be no given name at all leaves it open
        return options if options and min(c for _, _, c in options) < OPEN_COST else [*options, ("", last, OPEN_COST)]

    def _glued(self, token: str) -> list[tuple[str, str, float, float]]:
        parts = _CAMEL.split(token)
        out = []
        if len(parts) > 1:
            out += [(*x, 0.1) for x in self._pairs(parts[:1], parts[1:])] + [(*x, 0.2) for x in self._pairs(parts[-1:], parts[:-1])]
        word = fold(token)
        cuts = range(1, len(word)) if len(word) <= 4 * SHORT else ()
        out += [(word[:n], word[n:], 0.0, 0.2) for n in cuts if len(word) - n > 2 and word[:n] in self._set]
        out += [(word[n:], word[:n], 0.0, 0.3) for n in cuts if n > 2 and word[n:] in self._set]
        return out or [("", word, OPEN_COST, 0.5)]

    @staticmethod
    def _best(ways: list[tuple[str, str, float, float]]) -> list[tuple[str, str, float]]:
        """Ways with an exact given name rule out the others; else all that are near the best."""
        if not ways:
            return []
        costs = {}
        for g, s, c, extra in ways:
            costs[g, s] = min(costs.get((g, s), 9.0), c + extra)
        least = min(costs.values())
        return [(g, s, c) for (g, s), c in costs.items() if c <= least + (0.15 if least < 0.2 else 1.1)]


def deletions(text: str, radius: int) -> set[str]:
    """The text without up to ``radius`` of its characters: texts within that edit distance share one."""
    out = {text}
    for n in range(1, min(radius, len(text)) + 1):
        for drop in combinations(range(len(text)), n):
            kept, at = [], 0
            for d in drop:
                kept.append(text[at:d])
                at = d + 1
            out.add("".join(kept) + text[at:])
    return out


class Cell:
    """The points of one cell, indexed for exact radius queries: short surnames by deletion neighbourhoods, long ones as a list."""

    def __init__(self, points: list[tuple[int, str, str]], radius: int):
        self.points, self.radius = points, radius
        self.given = {g for _, g, _ in points}
        self.near: dict[tuple[str, str], list[int]] = {}
        self.long: list[int] = []
        for j, (_, g, s) in enumerate(points):
            if len(s) > SHORT:
                self.long.append(j)
                continue
            for d in deletions(s, radius):
                self.near.setdefault((g, d), []).append(j)

    def within(self, g: str, s: str) -> Iterator[tuple[int, int]]:
        """(point id, edits of the surname) of all points of the given name within the radius."""
        if g not in self.given:
            return
        found = {j for j in self.long if self.points[j][1] == g}
        if len(s) <= SHORT + self.radius:
            for d in deletions(s, self.radius):
                found.update(self.near.get((g, d), ()))
        for j in found:
            n = levenshtein(s, self.points[j][2], self.radius)
            if n <= self.radius:
                yield self.points[j][0], n


def distance(a: tuple[str, str], b: tuple[str, str], most: int = 64) -> int:
    """The metric of the space: Levenshtein of the surnames and, GIVEN_WEIGHT times, of the given names."""
    return GIVEN_WEIGHT * levenshtein(a[0], b[0], most) + levenshtein(a[1], b[1], most)


def distances(texts: list[str], pivots: list[str]) -> np.ndarray:
    """Levenshtein distance of each text to each pivot (of at most 64 characters): columns of the table as bit vectors, all texts at once."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")  # longest first: the texts that have a character at a place come first
    codes = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le"), np.uint32)
    letters, flat = np.unique(codes, return_inverse=True)
    sizes = lengths[order]
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(texts), len(pivots)), np.int32)
    one, whole = np.uint64(1), ~np.uint64(0)
    having = [int(np.searchsorted(-sizes, -place, side="left")) for place in range(int(sizes[0]) if len(sizes) else 0)]
    columns = [flat[starts[:n] + place] for place, n in enumerate(having)]
    for c, pivot in enumerate(pivots):
        score = np.full(len(texts), len(pivot), np.int32)
        if not pivot:
            out[order, c] = sizes
            continue
        where = np.zeros(len(letters), np.uint64)
        for i, letter in enumerate(pivot):
            at = np.searchsorted(letters, ord(letter))
            if at < len(letters) and letters[at] == ord(letter):
                where[at] |= one << np.uint64(i)
        top = np.uint64(len(pivot) - 1)
        up, down = np.full(len(texts), whole), np.zeros(len(texts), np.uint64)  # where a column rises and falls
        for n, column in zip(having, columns):
            u, d, eq = up[:n], down[:n], where[column]
            flat_ = (((eq & u) + u) ^ u) | eq
            right, left = d | ~(flat_ | u), u & flat_
            score[:n] += ((right >> top) & one).astype(np.int32) - ((left >> top) & one).astype(np.int32)
            right, left = (right << one) | one, left << one
            up[:n], down[:n] = left | ~(eq | d | right), right & (eq | d)
        out[order, c] = score
    return out


def _to_pivots(given: list[str], surname: list[str], pivots: list[tuple[str, str]]) -> np.ndarray:
    """Distance of each point to each pivot."""

    def part(texts: list[str], marks: list[str]) -> np.ndarray:
        own, at = np.unique(np.array(texts, object), return_inverse=True)
        other, to = np.unique(np.array(marks, object), return_inverse=True)
        return distances(own.tolist(), other.tolist())[np.ix_(at, to)]

    return GIVEN_WEIGHT * part(given, [g for g, _ in pivots]) + part(surname, [s for _, s in pivots])


def choose_pivots(points: DataFrame, n: int) -> list[tuple[str, str]]:
    """n points picked by hash: a bounded, repeatable sample. Of texts longer than 64 characters none is a pivot."""
    short = points.select("given", "surname").distinct().where("length(given) <= 64 AND length(surname) <= 64")
    return sorted((r[0], r[1]) for r in short.orderBy(F.xxhash64("given", "surname"), "given", "surname").limit(n).collect())


#: Rows of which a task holds the distances to all pivots at once.
ROWS_AT_ONCE = 1_000


def radius_join(queries: DataFrame, points: DataFrame, radius: int = RADIUS, cell_names: int | None = None) -> DataFrame:
    """All ``(qid, pid, edits)`` with distance up to ``radius`` of ``queries (qid, given, surname)`` and ``points (pid, given, surname)``.

    A point lies in the cell of its nearest pivot. A query goes to every cell whose pivot is no further from it than its
    own nearest pivot plus twice the radius (triangle inequality), and no further than the cell's covering radius plus the
    radius. The radius must be below GIVEN_WEIGHT, so that names within it have one given name.
    """
    if radius >= GIVEN_WEIGHT:
        raise ValueError("the radius must be below the weight of the given name")
    spark = points.sparkSession
    n = points.count()
    pivots = choose_pivots(points, min(MOST_PIVOTS, -(-n // (cell_names or CELL_NAMES)))) or [("", "")]
    shared = spark.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS short names

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                p = batch.iloc[at : at + ROWS_AT_ONCE]
                yield p, _to_pivots(p["given"].tolist(), p["surname"].tolist(), shared.value)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, away in chunks(batches):
            yield p.assign(cell=away.argmin(1), reach=away.min(1))

    homes = checkpoint(points.repartition(parts_for(spark, n, 200_000, 2_000)).mapInPandas(assign, "pid bigint, given string, surname string, cell int, reach int"))
    covers = np.full(len(pivots), -radius - 1)
    for c, reach in homes.groupBy("cell").agg(F.max("reach")).collect():  # one row per pivot
        covers[c] = reach
    covered = spark.sparkContext.broadcast(covers)

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, away in chunks(batches):
            row, cell = np.nonzero((away <= away.min(1, keepdims=True) + 2 * radius) & (away <= covered.value + radius))
            yield p.iloc[row].assign(cell=cell)

    visits = queries.mapInPandas(replicate, "qid bigint, given string, surname string, cell int")
    sides = visits.select("cell", F.lit(True).alias("query"), F.col("qid").alias("id"), "given", "surname").unionByName(homes.select("cell", F.lit(False).alias("query"), F.col("pid").alias("id"), "given", "surname"))
    # the cell's points come first, then its queries stream past them
    ordered = sides.repartition(max(parts_for(spark, n, 200_000, 2_000), min(parallelism(spark), len(pivots))), "cell").sortWithinPartitions("cell", "query")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, points_here, index = None, [], None
        for p in batches:
            hits = []
            for c, q, i, g, s in zip(p["cell"], p["query"], p["id"], p["given"], p["surname"]):
                if c != cell:
                    cell, points_here, index = c, [], None
                if not q:
                    points_here.append((i, g, s))
                    continue
                if index is None:
                    index = Cell(points_here, radius)
                hits += [(i, j, n) for j, n in index.within(g, s)]
            yield pd.DataFrame(hits, columns=["qid", "pid", "edits"])

    return ordered.mapInPandas(join, "qid bigint, pid bigint, edits int")


#: Points of one given name in one part of an index, and most pairs that a task compares at once; about memory, not results.
PART_POINTS, PAIRS_AT_ONCE = 100_000, 500_000
#: The base of the keys' polynomial and its powers modulo 2^64.
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(2 * SHORT)], np.uint64)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of each text, filled up with 0, and the lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(lengths.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return out, lengths


def deletion_keys(codes: np.ndarray, lengths: np.ndarray, seeds: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each text without up to ``radius`` of its characters, as ``deletions`` but hashed, all texts of a length at once.

    A key is a polynomial of the characters left plus the seed. Its parts between the dropped characters are differences
    of running sums, of which there is one for each number of characters dropped before.
    """
    rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        letters = np.ascontiguousarray(codes[at, :n].T).astype(np.uint64)
        sums = np.zeros((radius + 1, n + 1, len(at)), np.uint64)
        for d in range(radius + 1):
            np.cumsum(letters * _POWERS[radius - d : radius - d + n, None], axis=0, out=sums[d, 1:])
        for k in range(min(radius, n) + 1):
            for drop in combinations(range(n), k):
                key, begin = seeds[at], 0
                for d, end in enumerate((*drop, n)):
                    key, begin = key + sums[d, end] - sums[d, begin], end + 1
                rows.append(at)
                keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def edits_within(a: np.ndarray, a_lengths: np.ndarray, b: np.ndarray, b_lengths: np.ndarray, radius: int) -> np.ndarray:
    """``levenshtein`` of the texts of equal rows (code points as of ``_codes``), radius + 1 where it is greater."""
    most = radius + 1
    width = 2 * radius + 1  # a column for each j - i
    previous = [np.full(len(a), min(k - radius, most) if k >= radius else most) for k in range(width)]
    at = np.clip(b_lengths - a_lengths + radius, 0, width - 1)
    out = np.where(a_lengths == 0, np.minimum(b_lengths, most), most)
    for i in range(1, int(a_lengths.max(initial=0)) + 1):
        row: list[np.ndarray] = []
        for k in range(width):
            j = i + k - radius
            if j <= 0 or j > b.shape[1]:
                row.append(np.full(len(a), min(i, most) if j == 0 else most))
                continue
            least = np.minimum(previous[k] + (a[:, i - 1] != b[:, j - 1]), most)
            if k > 0:
                least = np.minimum(least, row[k - 1] + 1)
            row.append(np.minimum(least, previous[k + 1] + 1) if k + 1 < width else least)
        ends = np.flatnonzero(a_lengths == i)
        out[ends] = np.stack(row)[at[ends], ends]
        previous = row
    return np.where(np.abs(b_lengths - a_lengths) > radius, most, out)


class Index:
    """Points (``seeds`` stand for the given names) for exact radius queries: short surnames by sorted deletion keys, long ones as a list."""

    def __init__(self, seeds: np.ndarray, surnames: list[str], radius: int):
        self.seeds, self.radius = seeds, radius
        self.codes, self.lengths = _codes(surnames)
        short, self.long = np.flatnonzero(self.lengths <= SHORT), np.flatnonzero(self.lengths > SHORT)
        rows, keys = deletion_keys(self.codes[short], self.lengths[short], seeds[short], radius)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], short[rows[order]].astype(np.int32)

    def within(self, seeds: np.ndarray, surnames: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, point and edits of all pairs of one seed within the radius."""
        codes, lengths = _codes(surnames)
        found = [np.empty((3, 0), np.int64)]
        for q, p in self._likely(codes, lengths, seeds):
            same = seeds[q] == self.seeds[p]
            q, p = q[same], p[same]
            n = edits_within(codes[q], lengths[q], self.codes[p], self.lengths[p], self.radius)
            found.append(np.stack([q, p, n])[:, n <= self.radius])
        q, p, n = np.unique(np.concatenate(found, axis=1), axis=1)
        return q, p, n

    def _likely(self, codes: np.ndarray, lengths: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that share a key, and all of long points with long queries, some at a time."""
        near = np.flatnonzero(lengths <= SHORT + self.radius)
        rows, keys = deletion_keys(codes[near], lengths[near], seeds[near], self.radius)
        order = np.argsort(keys)
        rows, keys = near[rows[order]], keys[order]
        first = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == keys) if len(self.keys) else order[:0]
        hit = hit[np.argsort(rows[hit], kind="stable")]  # a query's keys together, so that most of its pairs come once
        rows, first, n = rows[hit], first[hit], np.searchsorted(self.keys, keys[hit], "right") - first[hit]
        piece = np.cumsum(n) // PAIRS_AT_ONCE
        for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(piece)) + 1):
            each = n[part]
            at = np.repeat(first[part] - np.cumsum(each) + each, each) + np.arange(each.sum())
            pairs = np.unique(np.repeat(rows[part], each) * len(self.lengths) + self.rows[at])
            yield pairs // len(self.lengths), pairs % len(self.lengths)
        far = np.flatnonzero(lengths > SHORT - self.radius) if len(self.long) else near[:0]
        step = max(1, PAIRS_AT_ONCE // max(1, len(self.long)))
        for i in range(0, len(far), step):
            some = far[i : i + step]
            yield np.repeat(some, len(self.long)), np.tile(self.long, len(some))


def key_join(queries: DataFrame, points: DataFrame, radius: int = RADIUS, part_points: int = PART_POINTS) -> DataFrame:
    """The rows of ``radius_join``, without pivots: the work for a query doesn't grow with the number of points.

    Names within the radius have one given name, so a given name's points lie in one task, or where they are more than
    ``part_points`` in several parts, each of which all its queries visit. A task finds the surnames near a query by keys
    that near surnames share.
    """
    if radius >= GIVEN_WEIGHT:
        raise ValueError("the radius must be below the weight of the given name")
    spark = points.sparkSession
    large = points.groupBy("given").agg(F.ceil(F.count("*") / part_points).cast("int").alias("parts")).where("parts > 1")
    large = F.broadcast(large)  # fewer than points / part_points
    parts = F.coalesce("parts", F.lit(1))
    homes = points.join(large, "given", "left").select(F.lit(False).alias("query"), F.col("pid").alias("id"), "surname", "given", F.pmod(F.xxhash64("pid"), parts).cast("int").alias("part"))
    visits = queries.join(large, "given", "left").select(F.lit(True).alias("query"), F.col("qid").alias("id"), "surname", "given", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    sides = homes.unionByName(visits).select("query", "id", "surname", F.xxhash64("given", "part").alias("cell"))
    ordered = sides.repartition(parts_for(spark, points.count(), part_points // 2, 2_000), "cell").sortWithinPartitions("query")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points_here, index, ids = [], None, None
        for p in batches:
            points_here.append(p[~p["query"]])
            q = p[p["query"]]
            if not len(q):
                continue
            if index is None:  # the points come first
                own = pd.concat(points_here, ignore_index=True)
                index, ids = Index(own["cell"].to_numpy().view(np.uint64), own["surname"].tolist(), radius), own["id"].to_numpy()
            i, j, n = index.within(q["cell"].to_numpy().view(np.uint64), q["surname"].tolist())
            yield pd.DataFrame({"qid": q["id"].to_numpy()[i], "pid": ids[j], "edits": n.astype(np.int32)})

    return ordered.mapInPandas(join, "qid bigint, pid bigint, edits int")



def spellings(df: DataFrame, column: str) -> DataFrame:
    """``name, n``: each distinct non-blank string of a column and its number of rows."""
    return df.select(F.col(column).cast("string").alias("name")).where(F.length(F.trim("name")) > 0).groupBy("name").agg(F.count("*").alias("n"))


def _lexicon(registry: DataFrame) -> list[str]:
    """Given names of the registry: its first words."""

    @F.pandas_udf("struct<given string, surname string>")
    def halves(names: pd.Series) -> pd.DataFrame:
        rows = [fold(n).split() for n in names]
        return pd.DataFrame([(r[0], "".join(r[1:])) if len(r) > 1 else (None, None) for r in rows], columns=["given", "surname"])

    rows = registry.select(halves("name").alias("h")).select("h.*").where("given IS NOT NULL")
    found = [r[0] for r in rows.where("length(given) > 1").select("given").distinct().limit(MOST_GIVEN + 1).collect()]
    if len(found) > MOST_GIVEN:
        raise ValueError("more given names than a lexicon may have; clean the registry first")
    return found


def registry_entities(registry: DataFrame) -> DataFrame:
    """``entity, given, surname, weight, display`` of a table ``name, n`` of full spellings; spellings equal but for case and accents are one."""

    @F.pandas_udf("struct<given string, surname string>")
    def halves(names: pd.Series) -> pd.DataFrame:
        rows = [re.sub(r"[^\w\s]", "", fold(n)).split() for n in names]
        return pd.DataFrame([(r[0], "".join(r[1:])) if len(r) > 1 else ("", "".join(r)) for r in rows], columns=["given", "surname"])

    rows = registry.select("name", "n", halves("name").alias("h")).select("name", "n", "h.given", "h.surname").where("length(surname) > 0")
    # among spellings of one key the one in mixed case, then the most frequent, is displayed
    shown = F.max_by("name", F.struct((F.col("name") != F.upper("name")).alias("mixed"), F.col("n"), F.col("name")))
    return rows.groupBy("given", "surname").agg(F.sum("n").alias("weight"), shown.alias("display")).withColumn("entity", F.xxhash64("given", "surname"))


#: Greatest cost of a spelling (its reading's and its surname's slips), and of the slips where the given name is open.
MOST_COST, MOST_OPEN = 3.3, 1.05


def link_spellings(names: DataFrame, registry: DataFrame, pet_forms: dict[str, list[str]] | None = None) -> DataFrame:
    """``name, n, entity, display, cost`` of each spelling: the person it means.

    ``names`` and ``registry`` are ``name, n`` (distinct strings and their numbers of rows). Every reading of a spelling
    is joined with the registry's persons within the radius; the person with the least cost is taken (of equally near
    ones that with the greater weight). Spellings near no registered person form groups around their own most frequent
    full spelling; a spelling that can't be read is a group of its own. Null and blank names are no spellings.
    ``pet_forms`` maps a pet form to the given names that it stands for, in place of the general list; further ones are
    learned.
    """
    people, numbered, ways = _prepared(names, registry, pet_forms)
    linked = checkpoint(_resolve(ways, people, False).where("i = 1").select("qid", "entity", "display", "cost"))
    rest = numbered.join(linked.select("qid"), "qid", "left_anti")
    own = checkpoint(_own_groups(rest, ways).select("qid", "entity", "display", "cost"))
    alone = rest.join(own.select("qid"), "qid", "left_anti").select("qid", F.col("qid").alias("entity"), F.col("name").alias("display"), F.lit(0.0).alias("cost"))
    best = linked.unionByName(own).unionByName(alone)
    return numbered.join(best, "qid").select("name", "n", "entity", "display", "cost")


def possible_people(names: DataFrame, registry: DataFrame, margin: float = 0.6, pet_forms: dict[str, list[str]] | None = None) -> DataFrame:
    """``name, entity, cost`` of all registered persons a spelling may mean: those within ``margin`` of the least cost."""
    # read several times; without the cut the readers of names run on all rows instead of the distinct names
    people, numbered, ways = _prepared(names, checkpoint(registry), pet_forms)
    near = _resolve(ways, people, True).where(F.col("cost") <= F.col("least") + margin)
    return numbered.select("qid", "name").join(near.select("qid", "entity", "cost"), "qid").select("name", "entity", "cost")


def _prepared(names: DataFrame, registry: DataFrame, pet_forms: dict[str, list[str]] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registered persons, numbered names, and the names' readings."""
    people = checkpoint(registry_entities(registry))
    given = _lexicon(registry)
    numbered = checkpoint(names.withColumn("qid", F.xxhash64("name")))
    forms = PET_FORMS if pet_forms is None else pet_forms
    first = checkpoint(_readings(numbered, given, forms))
    learned = learned_forms(first, people)
    if not learned:
        return people, numbered, first
    # only names with such a word are read in another way
    known = names.sparkSession.createDataFrame([(w,) for w in learned], "word string")
    again = checkpoint(first.join(known, "word", "left_semi").select("qid").distinct())
    more = {w: sorted({*forms.get(w, ()), *g}) for w, g in learned.items()}
    second = _readings(numbered.join(again, "qid", "left_semi"), given, forms | more)
    return people, numbered, checkpoint(first.join(again, "qid", "left_anti").unionByName(second))


def _readings(numbered: DataFrame, given: list[str], pet_forms: dict[str, list[str]]) -> DataFrame:
    """``rid, qid, given, surname, cost, open, word``: a reading whose given name is open has "" for it; ``word`` is what stands for an inexact one."""
    spark = numbered.sparkSession
    shared = spark.sparkContext.broadcast((given, pet_forms))  # at most MOST_GIVEN names and as many forms

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*shared.value)
        for p in batches:
            rows = []
            for q, name in zip(p["qid"], p["name"]):
                words = [w for w in (re.sub(r"\W", "", fold(t)) for t in name.split()) if w]
                for g, s, c in reader.readings(name):
                    # a word that is no given name (a nickname of the ring, say) leaves the given name open
                    word = next((w for w in words if w not in s), None) if c > 0 else None
                    rows.append((q, g, s, c, not g, word))
            yield pd.DataFrame(rows, columns=["qid", "given", "surname", "cost", "open", "word"])

    parts = parts_for(spark, numbered.count(), 200_000, 2_000)
    ways = numbered.select("qid", "name").repartition(parts).mapInPandas(read, "qid bigint, given string, surname string, cost double, open boolean, word string")
    best = ways.groupBy("qid", "given", "surname").agg(F.min("cost").alias("cost"), F.min("open").alias("open"), F.min("word").alias("word"))
    return best.withColumn("rid", F.xxhash64("qid", "given", "surname"))


def learned_forms(ways: DataFrame, people: DataFrame) -> dict[str, list[str]]:
    """Words that stand for given names, from the names themselves.

    A word that is no given name of the lexicon, before an exact surname that only persons of one given name have, suggests
    that given name. It is learned as a form of each name that LEARN_SURNAMES of its surnames and a share of LEARN_SHARE of
    them suggest.
    """
    sure = people.groupBy("surname").agg(F.min("given").alias("given"), F.max("given").alias("other")).where("given = other AND given != ''").select("surname", "given")
    seen = ways.where("length(word) > 1").select("word", "surname").distinct().join(sure, "surname")
    counts = seen.groupBy("word", "given").agg(F.count("*").alias("k"))
    total = counts.groupBy("word").agg(F.sum("k").alias("all"))
    rows = counts.where(F.col("k") >= LEARN_SURNAMES).join(total, "word").where(F.col("k") >= LEARN_SHARE * F.col("all")).select("word", "given").limit(MOST_GIVEN + 1).collect()
    if len(rows) > MOST_GIVEN:
        raise ValueError("more forms of given names than a lexicon may have; clean the names first")
    out: dict[str, list[str]] = {}
    for word, given in rows:
        if word != given:
            out.setdefault(word, []).append(given)
    return out


def _near(ways: DataFrame, points: DataFrame, every: bool) -> DataFrame:
    """``rid, pid`` of readings and points ``pid, given, surname, weight`` within the radius; open readings by surname alone.

    Of the points with one surname an open reading gets all with ``every``, else the one of greatest weight. With ``every``
    the points are found by keys, else by pivots; the pairs are the same.
    """
    tight, wide = (key_join, key_join) if every else (radius_join, partial(radius_join, cell_names=LOOSE_NAMES))
    closed = tight(ways.where("NOT open").select(F.col("rid").alias("qid"), "given", "surname"), points.select("pid", "given", "surname"))
    # surnames in their own space, with ids made of them
    last = points.select("surname").distinct().select(F.xxhash64("surname").alias("pid"), F.lit("").alias("given"), "surname")
    loose = ways.where("open")
    met = wide(loose.select("surname").distinct().select(F.xxhash64("surname").alias("qid"), F.lit("").alias("given"), "surname"), last)
    holders = points if every else points.groupBy("surname").agg(F.max_by("pid", F.struct("weight", -F.col("pid"))).alias("pid"))
    people = holders.select("pid", F.xxhash64("surname").alias("sid"))
    opened = loose.select("rid", F.xxhash64("surname").alias("qid")).join(met.withColumnRenamed("pid", "sid"), "qid").join(people, "sid").select("rid", "pid")
    return closed.select(F.col("qid").alias("rid"), "pid").unionByName(opened)


def _resolve(ways: DataFrame, people: DataFrame, every: bool) -> DataFrame:
    points = people.select(F.col("entity").alias("pid"), "given", "surname", "weight")
    hits = _near(ways, points, every).join(ways.withColumnRenamed("surname", "typed").drop("given", "word"), "rid").join(people.withColumnRenamed("entity", "pid"), "pid")

    @F.pandas_udf("double")
    def slips(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([slip_cost(x, y) for x, y in zip(a, b)], dtype="float64")

    total = F.col("cost") + slips("typed", "surname")
    # an open given name needs the whole surname to be right
    scored = hits.select("qid", F.col("pid").alias("entity"), "display", "weight", total.alias("cost"), "open", (total - F.col("cost")).alias("slips")).where((F.col("cost") <= MOST_COST) & (~F.col("open") | (F.col("slips") < MOST_OPEN)))
    order = Window.partitionBy("qid").orderBy(F.round("cost", 3), F.desc("weight"), "entity")
    return scored.withColumn("i", F.row_number().over(order)).withColumn("least", F.min("cost").over(Window.partitionBy("qid")))


def _own_groups(rest: DataFrame, readings: DataFrame) -> DataFrame:
    """Groups of spellings without a registered person: each goes to the strongest spelling within the radius of one of its readings.

    A spelling is strong if it reads plainly (a full known given name), then by its number of rows; a leader that itself
    follows another passes its followers on.
    """
    ways = checkpoint(readings.join(rest.select("qid"), "qid", "left_semi").where("cost < 2"))
    best = F.min_by(F.struct("given", "surname", "cost"), F.struct("cost", "given", "surname")).alias("b")
    full = checkpoint(ways.groupBy("qid").agg(best).join(rest.select("qid", "name", "n"), "qid").select("qid", "name", "n", "b.given", "b.surname", "b.cost"))
    strength = full.select(F.col("qid").alias("pid"), F.struct((-F.col("cost")).alias("plain"), "n", "qid").alias("strength"), F.col("name").alias("display"))
    points = full.select(F.col("qid").alias("pid"), "given", "surname", F.struct((-F.col("cost")).alias("plain"), "n").alias("weight"))
    hits = _near(ways, points, False).join(ways.select("rid", "qid"), "rid")
    itself = full.select("qid", F.col("qid").alias("pid"))  # so that each has a leader
    top = hits.select("qid", "pid").unionByName(itself).join(strength, "pid").groupBy("qid").agg(F.max(F.struct("strength", "pid", "display")).alias("b")).select("qid", "b.pid", "b.display")
    leaders = top.select(F.col("qid").alias("pid"), F.col("pid").alias("next"), F.col("display").alias("next_display"))
    return top.join(leaders, "pid").select("qid", F.col("next").alias("entity"), F.col("next_display").alias("display"), F.lit(0.0).alias("cost"))


#: Spellings of one person that one task pairs.
BLOCK_SPELLINGS = 2_000


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """``name_a < name_b`` of all different spellings of one entity; strings compare by their UTF-8 bytes, which is by code point."""
    sizes = linked.groupBy("entity").agg(F.count("*").alias("size"))
    rows = linked.select("entity", "name").join(sizes.where("size > 1"), "entity")
    return pairs_in_groups(rows, "entity", "name", "size", BLOCK_SPELLINGS).select("name_a", "name_b")
