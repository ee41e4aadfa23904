"""Evaluation items that leaked into training texts: BM25 retrieval with block-max WAND, then exact overlap.

The items are the indexed side and every passage of every training text is a query. An item's threshold is the least score
that a passage with ``min_words`` of its consecutive words can have, so retrieval loses no such passage; impacts are
divided by it, and one threshold of 1 holds for all items.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Words of a passage; passages overlap by ``min_words - 1`` so that each run of min_words lies whole in one.
PASSAGE = 48
#: Items of one posting block, for its block maximum.
BLOCK_ITEMS = 16
#: Items of one index. More are handled index by index: each passes over the texts, none grows with the corpus.
INDEX_ITEMS = 100_000

_WORD = re.compile(r"[^\W_]+")


def _class_of_marks() -> str:
    """A regular-expression class of all combining characters, as ranges."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    out, start = [], marks[0]
    for c, n in zip(marks, [*marks[1:], None]):
        if n != c + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(c))}")
            start = n
    return f"[{''.join(out)}]+"


_MARKS = re.compile(_class_of_marks())


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case and accents."""
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text.lower())
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", text).casefold()))


class ItemIndex:
    """Inverted index of the items: for each term, postings by item with impacts, and the maximum of each block."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], min_words: int):
        self.min_words = min_words
        self.ids = [i for i, _, _ in items]
        texts = [words(t) for _, t, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.items = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t] for t in texts]
        self.answers = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(a)] for _, _, a in items]
        n, mean = max(1, len(items)), max(1.0, float(np.mean([len(t) for t in texts] or [1])))
        postings: dict[int, dict[int, int]] = {}
        for k, t in enumerate(self.items):
            for w in t:
                postings.setdefault(w, {}).setdefault(k, 0)
                postings[w][k] += 1
        idf = {w: float(np.log1p((n - len(p) + 0.5) / (len(p) + 0.5))) for w, p in postings.items()}
        impact = {w: {k: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(self.items[k]) / mean)) for k, tf in p.items()} for w, p in postings.items()}
        self.grams: dict[tuple[int, ...], list[int]] = {}
        threshold = np.full(len(items), np.inf)
        for k, t in enumerate(self.items):
            for at in range(len(t) - min_words + 1):
                window = tuple(t[at : at + min_words])
                threshold[k] = min(threshold[k], sum(impact[w][k] for w in set(window)))
                owners = self.grams.setdefault(window, [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        # items with fewer than min_words words can't leak: their impacts are 0
        self.postings: dict[int, tuple[list[int], list[float], float, dict[int, float]]] = {}
        self.ceiling = np.zeros(len(self.vocabulary))
        for w, p in impact.items():
            kept = [(k, x / threshold[k]) for k, x in sorted(p.items()) if np.isfinite(threshold[k])]
            if not kept:
                continue
            blocks: dict[int, float] = {}
            for k, x in kept:
                blocks[k // BLOCK_ITEMS] = max(blocks.get(k // BLOCK_ITEMS, 0.0), x)
            self.ceiling[w] = max(x for _, x in kept)
            self.postings[w] = ([k for k, _ in kept], [x for _, x in kept], float(self.ceiling[w]), blocks)

    def search(self, terms: set[int], least: float = 1.0 - 1e-9) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose score over the passage's terms reaches ``least``."""
        cursors = [[p[0][0], 0, p] for t in terms if (p := self.postings.get(t))]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for n, c in enumerate(cursors):
                bound += c[2][2]
                if bound >= least:
                    pivot = n
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if sum(c[2][3].get(block, 0.0) for c in cursors[: pivot + 1]) < least:
                # no item of this block (before the next cursor) can reach the threshold
                target = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                self._advance(cursors, pivot + 1, max(target, item + 1))
            elif cursors[0][0] == item:
                score = sum(c[2][1][c[1]] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                self._advance(cursors, pivot + 1, item + 1)
            else:
                self._advance(cursors, pivot, item)
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    @staticmethod
    def _advance(cursors: list, upto: int, item: int) -> None:
        for c in cursors[:upto]:
            items = c[2][0]
            at = bisect_left(items, item, c[1])
            c[0], c[1] = (items[at], at) if at < len(items) else (-1, at)

    def leaks(self, text: str | None) -> dict[int, tuple[int, float, bool]]:
        """Item index -> (most consecutive words shared, best passage score, whether the answer follows in the text)."""
        get = self.vocabulary.get
        ids = [get(w, -1) for w in words(text)]
        m = self.min_words
        if len(ids) < m:
            return {}
        step = PASSAGE - m + 1
        known = np.asarray(ids)
        weight = np.concatenate([[0.0], np.cumsum(np.where(known >= 0, self.ceiling[np.maximum(known, 0)], 0.0))])
        starts = np.arange(0, max(1, len(ids) - m + 1), step)
        bound = weight[np.minimum(starts + PASSAGE, len(ids))] - weight[starts]
        out: dict[int, tuple[int, float, bool]] = {}
        for s in starts[bound >= 1.0 - 1e-9].tolist():
            passage = ids[s : s + PASSAGE]
            for item, score in self.search({t for t in passage if t >= 0}):
                run = self._longest(ids, s, item)
                if run >= m:
                    answer = self.answers[item]
                    after = any(ids[i : i + len(answer)] == answer for i in range(s, min(len(ids), s + 2 * PASSAGE))) if answer else False
                    old = out.get(item, (0, 0.0, False))
                    out[item] = (max(run, old[0]), max(score, old[1]), after or old[2])
        return out

    def _longest(self, ids: list[int], start: int, item: int) -> int:
        """Longest run of the item's consecutive words that begins in the passage."""
        m, best, text = self.min_words, 0, self.items[item]
        for at in range(start, min(start + PASSAGE, len(ids)) - m + 1):
            if item not in self.grams.get(tuple(ids[at : at + m]), ()):
                continue
            for j in range(len(text) - m + 1):
                if text[j : j + m] == ids[at : at + m]:
                    n = m
                    while j + n < len(text) and at + n < len(ids) and text[j + n] == ids[at + n]:
                        n += 1
                    best = max(best, n)
        return best


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 12, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", answer: str = "answer") -> DataFrame:
    """One row per document and leaked item: ``doc_id, item_id, shared_words, score, answer_follows``.

    A leak is a run of at least ``min_words`` consecutive words of the item's text; words are runs of letters and digits,
    compared without case and accents, whatever stands between them. ``shared_words`` is the longest such run. Null and
    empty texts hold no leak; items with fewer words than ``min_words`` or null text can't leak; repeated rows count once;
    either table may be empty. Items are indexed ``INDEX_ITEMS`` at a time, so the broadcast index is bounded.
    """
    spark = docs.sparkSession
    schema = f"{doc_key} {docs.schema[doc_key].dataType.simpleString()}, {item_key} {items.schema[item_key].dataType.simpleString()}, shared_words int, score double, answer_follows boolean"
    columns = [item_key, text, answer if answer in items.columns else F.lit(None).cast("string").alias(answer)]
    wanted = items.select(*columns).where(F.col(text).isNotNull() & F.col(item_key).isNotNull()).distinct()
    out, after = None, None
    while True:
        block = wanted if after is None else wanted.where(F.col(item_key) > F.lit(after))
        rows = [tuple(r) for r in block.orderBy(item_key).limit(INDEX_ITEMS).collect()]
        if rows:
            after = rows[-1][0]
            part = _find(docs, rows, min_words, doc_key, item_key, text, schema)
            out = part if out is None else out.unionByName(part)
        if len(rows) < INDEX_ITEMS:
            break
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("shared_words", "score")).alias("b")
    return out.groupBy(doc_key, item_key).agg(best, F.max("answer_follows").alias("answer_follows")).select(doc_key, item_key, "b.shared_words", "b.score", "answer_follows")


#: The index that a worker built last, by the name of its items.
_BUILT: dict[str, ItemIndex] = {}


def _index_of(name: str, shared, min_words: int) -> ItemIndex:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = ItemIndex(shared.value, min_words)
    return _BUILT[name]


def _find(docs: DataFrame, rows: list[tuple], min_words: int, doc_key: str, item_key: str, text: str, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)  # at most INDEX_ITEMS items; each worker builds the index once
    name = uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(name, shared, min_words)
        names = [doc_key, item_key, "shared_words", "score", "answer_follows"]
        for batch in batches:
            hits = [(row, index.ids[k], *v) for row, t in enumerate(batch.column(1).to_pylist()) for k, v in index.leaks(t).items()]
            if hits:
                at, item, run, score, follows = zip(*hits)
                arrays = [batch.column(0).take(pa.array(at)), pa.array(item, pa.int64()), pa.array(run, pa.int32()), pa.array(score, pa.float64()), pa.array(follows, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(doc_key, text).mapInArrow(search, schema)
