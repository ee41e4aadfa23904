"""Long spans that stand character by character in several texts, and passages that nearly do.

Each distinct text gives k-mer seeds by winnowing: of every window that a span of ``min_chars`` must contain, the k-mer of
least hash is a seed, so equal spans have equal seeds. Texts that share seeds become pairs. Their seeds grow to maximal
matches, which are chained in the order of both texts with gap costs through a Fenwick tree; every match lies in one chain.
Chains are aligned, match by match and gap by gap: an aligned chain is a fuzzy passage, and the matched stretches in it are
what the texts share exactly. Copies of one text are one text until the very end.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.pairs import pairs_in_groups
from duelframe.runtime import Written, checkpoint

#: Characters of a seed; below min_chars, so that a shared span holds a chain of them.
SEED_CHARS = 128
#: Code points hashed together; longer texts go in pieces that overlap by a span.
PIECE = 1 << 20
#: Cost of a chain for each character between two of its matches, in either text.
GAP_COST = 0.25
#: Texts of one seed that one task pairs; a seed in more texts is split into cells of two blocks each.
BLOCK_TEXTS = 2_000
#: Places of one seed in one text that are kept; with more the pair's exact spans come from comparing all windows instead.
PLACES = 4
#: A chain whose next match is further than this in both texts goes on as another passage.
LONGEST_GAP = 2_000
#: Least share of equal characters of a fuzzy passage.
FUZZY = 0.8

_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-mer, by doubling: that of 2n characters is made of two of n."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    n, parts, at = 1, None, 0
    rest = k
    while rest:
        if rest & 1:
            size = len(codes) - k + 1
            piece = h[at : at + size]
            parts = piece.copy() if parts is None else parts * _STEP + (piece ^ (piece >> np.uint64(32)))
            at += n
        rest >>= 1
        if rest:
            h = h[:-n] * _STEP + (h[n:] ^ (h[n:] >> np.uint64(32)))
            n *= 2
    parts = (parts ^ (parts >> np.uint64(31))) * _MIX
    return parts ^ (parts >> np.uint64(29))


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    n = 1
    while n * 2 <= w:
        x = best(x[:-n], x[n:])
        n *= 2
    return best(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def winnow(hashes: np.ndarray, w: int, valid: np.ndarray | None = None) -> np.ndarray:
    """Positions whose hash is the least of some whole window of w; ``valid`` marks where windows may start."""
    least = _slide(hashes, w, np.minimum)
    if valid is not None:
        least = np.where(valid[: len(least)], least, np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([pad, least, pad]), w, np.maximum) == hashes)


def text_id(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode())


def seeds_of(texts: list[str], k: int, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, position, hash) of the seeds of a batch of texts, hashed piece by piece."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    w, group, size = min_chars - k + 1, [], 0

    def flush() -> None:
        if not group:
            return
        codes = np.frombuffer("".join(t for _, _, t in group).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for _, _, t in group])
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(group)), lengths)
        place = np.arange(len(codes)) - (ends - lengths)[owner]
        h = kmer_hashes(codes, k)
        valid = place <= lengths[owner] - min_chars
        at = winnow(h, w, valid)
        at = at[place[at] <= lengths[owner[at]] - k]
        who = np.array([i for i, _, _ in group])[owner[at]]
        offset = np.array([o for _, o, _ in group])[owner[at]]
        out.append((who, place[at] + offset, h[at].view(np.int64)))

    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - min_chars + 1), PIECE - min_chars + 1):
            part = t[o : o + PIECE]
            if len(part) < min_chars:
                continue
            if size + len(part) > PIECE and group:
                flush()
                group, size = [], 0
            group.append((i, o, part))
            size += len(part)
    flush()
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _seed_batches(k: int, min_chars: int):
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            who, place, h = seeds_of(texts, k, min_chars)
            if not len(who):
                continue
            order = np.lexsort((place, h, who))
            who, place, h = who[order], place[order], h[order]
            first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (h[1:] != h[:-1])])
            counts = np.diff(np.r_[first, len(who)])
            rank = np.arange(len(who)) - np.repeat(first, counts)
            keep = rank < PLACES
            ids = pa.array([text_id(t) for t in texts], pa.binary(16)).cast(pa.binary())
            kept = np.minimum(counts, PLACES)
            offsets = np.r_[0, np.cumsum(kept)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first]), ids.take(pa.array(who[first])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[keep].astype(np.int32))), pa.array(counts > PLACES)],
                names=["seed", "tid", "places", "dense"],
            )

    return seeds


def chain(matches: list[tuple[int, int, int]]) -> list[tuple[float, list[int]]]:
    """Chains of matches (start in a, start in b, length) that follow each other in both texts, best first.

    A chain scores its matched characters less GAP_COST for each character between two matches, in either text. That cost
    is linear in the ends, so the best predecessor of a match is a prefix maximum over the ends in b of the matches that
    end in a before it: a Fenwick tree, in a sweep over a. Each match is in one chain.
    """
    n = len(matches)
    ends_b = sorted({j + m for _, j, m in matches})
    rank = {e: r + 1 for r, e in enumerate(ends_b)}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ends_b) + 1)
    score, before = [0.0] * n, [-1] * n
    events = sorted([(i + m, 0, x) for x, (i, _, m) in enumerate(matches)] + [(i, 1, x) for x, (i, _, _) in enumerate(matches)])
    for at, starts, x in events:
        i, j, m = matches[x]
        if starts:
            best, r = (float("-inf"), -1), bisect_right(ends_b, j)
            while r > 0:
                best = max(best, tree[r])
                r -= r & -r
            gain = best[0] - GAP_COST * (i + j)
            score[x], before[x] = (m + gain, best[1]) if gain > 0 else (float(m), -1)
        else:
            value, r = (score[x] + GAP_COST * (i + m + j + m), x), rank[j + m]
            while r < len(tree):
                tree[r] = max(tree[r], value)
                r += r & -r
    used, chains = [False] * n, []
    for x in sorted(range(n), key=lambda y: -score[y]):
        path, y = [], x
        while y >= 0 and not used[y]:
            used[y] = True
            path.append(y)
            y = before[y]
        if path:
            chains.append((score[x], path[::-1]))
    return chains


def _common(x: str, y: str) -> int:
    """Length of the common prefix."""
    if x == y:
        return len(x)
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _forward(x: str, i: int, y: str, j: int) -> int:
    step, n = 256, 0
    while True:
        p, q = x[i + n : i + n + step], y[j + n : j + n + step]
        c = _common(p, q)
        n += c
        if c < step:
            return n
        step *= 2


def _backward(x: str, i: int, y: str, j: int) -> int:
    step, n = 256, 0
    while True:
        p, q = x[max(0, i - n - step) : i - n][::-1], y[max(0, j - n - step) : j - n][::-1]
        c = _common(p, q)
        n += c
        if c < step or not p or not q:
            return n
        step *= 2


def dense_spans(x: str, y: str, min_chars: int) -> list[tuple[int, int]]:
    """(start, length) of every run of x whose windows of min_chars all stand somewhere in y, compared window by window."""
    hx, hy = (kmer_hashes(np.frombuffer(t.encode("utf-32-le"), np.uint32), min_chars) for t in (x, y))
    known, first = np.unique(hy, return_index=True)
    rank = np.minimum(np.searchsorted(known, hx), len(known) - 1)
    at = np.flatnonzero(known[rank] == hx)
    same = [x[p : p + min_chars] == y[q : q + min_chars] for p, q in zip(at.tolist(), first[rank[at]].tolist())]
    at = at[np.array(same, bool)]
    breaks = np.flatnonzero(np.diff(at) > 1)
    starts, ends = at[np.r_[0, breaks + 1]] if len(at) else at, at[np.r_[breaks, -1]] if len(at) else at
    return [(s, e - s + min_chars) for s, e in zip(starts.tolist(), ends.tolist())]


def maximal_matches(x: str, y: str, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The seeds (place in x, place in y) grown to maximal equal runs: (start in x, start in y, length)."""
    runs: dict[int, list[tuple[int, int]]] = {}
    for i, j in sorted(seeds):
        here = runs.setdefault(i - j, [])
        if here and i < here[-1][1]:
            continue
        back, ahead = _backward(x, i, y, j), _forward(x, i, y, j)
        if ahead + back:
            here.append((i - back, i + ahead))
    return sorted((s, s - d, e - s) for d, spans in runs.items() for s, e in spans)


def edits(a: str, b: str) -> int:
    """Levenshtein distance: columns of the table as bit vectors."""
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    whole, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = whole, 0, len(a)  # where a column rises and falls
    for c in b:
        eq = where.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq
        right, left = down | ~(flat | up) & whole, up & flat
        score += (right & top > 0) - (left & top > 0)
        right, left = (right << 1 | 1) & whole, left << 1 & whole
        up, down = left | ~(eq | down | right) & whole, right & (eq | down)
    return score


def align(x: str, y: str, path: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """(start in x, end in x, start in y, end in y, share of equal characters) of the passages of one chain of matches.

    Matches are aligned as they stand and the gaps between them by their edit distance; the share is 1 less the edits over
    the longer side.
    """
    out, first, wrong = [], path[0], 0
    for (i, j, n), following in zip(path, [*path[1:], None]):
        gap = following and (following[0] - i - n, following[1] - j - n)
        if gap and min(gap) <= LONGEST_GAP:
            wrong += edits(x[i + n : following[0]], y[j + n : following[1]])
            continue
        out.append((first[0], i + n, first[1], j + n, 1 - wrong / max(i + n - first[0], j + n - first[1])))
        first, wrong = following, 0
    return out


def _pair_batches(min_chars: int):
    names = ["tid_a", "tid_b", "from_a", "to_a", "from_b", "to_b", "same", "starts_a", "lengths_a", "starts_b", "lengths_b"]
    kinds = [pa.binary(), pa.binary(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.float64()), *[pa.list_(pa.int32())] * 4]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, seeds, dense, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                matches = maximal_matches(x, y, sorted({(i, j) for m in seeds for i in m["pa"] for j in m["pb"]}))
                if not matches:
                    continue  # different seeds with one hash
                chains = [[matches[p] for p in path] for _, path in chain(matches)]
                passages = [p for c in chains for p in align(x, y, c) if p[4] >= FUZZY and min(p[1] - p[0], p[3] - p[2]) >= min_chars]
                if dense:  # not all places of a seed are known
                    runs_a, runs_b = dense_spans(x, y, min_chars), dense_spans(y, x, min_chars)
                else:
                    long = [m for c in chains for m in c if m[2] >= min_chars]
                    runs_a, runs_b = [(i, n) for i, _, n in long], [(j, n) for _, j, n in long]
                if passages or runs_a:
                    rows.append((a, b, *[[p[k] for p in passages] for k in range(5)], *[[r[k] for r in runs] for runs in (runs_a, runs_b) for k in (0, 1)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return compare


def distinct_texts(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """``doc``, ``tid`` of each row long enough to share a span; the id is a 128-bit hash of the text."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_id(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc", "tid"])

    long = docs.where(F.length(text) >= min_chars).select(F.col(key).alias("doc"), text)
    return long.mapInArrow(ids, f"doc {docs.schema[key].dataType.simpleString()}, tid binary")


def matched_texts(docs: DataFrame, min_chars: int = 300, text: str = "text", k: int = SEED_CHARS) -> DataFrame:
    """One row per pair of different texts that share a passage.

    Columns: ``tid_a < tid_b``; lists ``from_a``, ``to_a``, ``from_b``, ``to_b``, ``same`` of the fuzzy passages (aligned
    chains of at least ``min_chars`` in either text and a share of equal characters of at least ``FUZZY``); lists
    ``starts_a``, ``lengths_a`` and ``starts_b``, ``lengths_b`` of the runs of at least ``min_chars`` of each text that the
    other holds too (empty: the passage is only fuzzily shared).
    """
    if not 1 <= k <= min_chars:
        raise ValueError("a seed must fit into a span")
    long = docs.where(F.length(text) >= min_chars).select(text)
    # written once, narrow; what follows reads the columns that it needs
    seeds = Written(docs.sparkSession).keep(long.mapInArrow(_seed_batches(k, min_chars), "seed bigint, tid binary, places array<int>, dense boolean"))
    often = seeds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")  # combined before the shuffle
    # copies are one text from here on
    own = checkpoint(seeds.join(often, "seed").groupBy("seed", "tid").agg(F.any_value("places").alias("places"), F.any_value("dense").alias("dense")))
    shared = checkpoint(own.join(own.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "seed"))
    pairs = pairs_in_groups(shared, "seed", "tid", "n", BLOCK_TEXTS, ("places", "dense"))
    both = F.struct(F.col("places_a").alias("pa"), F.col("places_b").alias("pb"))
    packed = pairs.groupBy("tid_a", "tid_b").agg(F.collect_list(both).alias("matches"), F.max(F.col("dense_a") | F.col("dense_b")).alias("dense"))
    wanted = shared.select("tid").distinct()

    def texts_by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([text_id(t) for t in batch.column(0).to_pylist()], pa.binary()), batch.column(0)], names=["tid", "text"])

    texts = long.mapInArrow(texts_by_id, "tid binary, text string").join(wanted, "tid", "left_semi").dropDuplicates(["tid"])
    texts = checkpoint(texts)
    left, right = (texts.select(F.col("tid").alias(f"tid_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")
    rows = packed.join(left, "tid_a").join(right, "tid_b").select("tid_a", "tid_b", "matches", "dense", "text_a", "text_b")
    lists = ", ".join(f"{c} array<int>" for c in ("starts_a", "lengths_a", "starts_b", "lengths_b"))
    return rows.mapInArrow(_pair_batches(min_chars), f"tid_a binary, tid_b binary, from_a array<int>, to_a array<int>, from_b array<int>, to_b array<int>, same array<double>, {lists}")


def fuzzy_passages(docs: DataFrame, min_chars: int = 300, key: str = "doc_id", text: str = "text", k: int = SEED_CHARS) -> DataFrame:
    """One row per pair of different texts and passage that they share at least nearly: ``<key>_a``, ``<key>_b``, ``start_a``, ``end_a``, ``start_b``, ``end_b``, ``same_share``.

    A text stands under its smallest key; copies of one text make no rows. Passages are aligned chains of matches that hold
    a common seed of ``k`` characters; a seed that stands more than ``PLACES`` times in a text enters with its first places.
    Null, empty and shorter texts share nothing; an empty table gives no rows.
    """
    first = checkpoint(distinct_texts(docs, key, text, min_chars).groupBy("tid").agg(F.min("doc").alias("doc")))
    a, b = (first.select(F.col("tid").alias(f"tid_{s}"), F.col("doc").alias(f"{key}_{s}")) for s in "ab")
    passages = F.inline(F.arrays_zip(F.col("from_a").alias("start_a"), F.col("to_a").alias("end_a"), F.col("from_b").alias("start_b"), F.col("to_b").alias("end_b"), F.col("same").alias("same_share")))
    rows = matched_texts(docs, min_chars, text, k).select("tid_a", "tid_b", passages)
    return rows.join(a, "tid_a").join(b, "tid_b").select(f"{key}_a", f"{key}_b", "start_a", "end_a", "start_b", "end_b", F.round("same_share", 6).alias("same_share"))


def shared_span_pairs(docs: DataFrame, min_chars: int = 300, key: str = "doc_id", text: str = "text", k: int = SEED_CHARS) -> DataFrame:
    """``<key>_a < <key>_b`` of all documents that hold the same span of at least ``min_chars`` code points.

    Null, empty and shorter texts share nothing; documents with equal texts share them whole; repeated rows count once; an
    empty table gives no rows; texts are compared exactly as stored and whole.
    """
    members = checkpoint(distinct_texts(docs, key, text, min_chars).distinct())
    exact = matched_texts(docs, min_chars, text, k).where(F.size("lengths_a") > 0).select("tid_a", "tid_b")
    a, b = (members.select(F.col("tid").alias(f"tid_{s}"), F.col("doc").alias(f"d{s}")) for s in "ab")
    across = exact.join(a, "tid_a").join(b, "tid_b").select("da", "db")
    sizes = members.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1")
    within = pairs_in_groups(members.join(sizes, "tid"), "tid", "doc", "n", BLOCK_TEXTS).select(F.col("doc_a").alias("da"), F.col("doc_b").alias("db"))
    both = across.unionByName(within).where("da != db")
    return both.select(F.least("da", "db").alias(f"{key}_a"), F.greatest("da", "db").alias(f"{key}_b")).distinct()


def shared_share(docs: DataFrame, min_chars: int = 300, key: str = "doc_id", text: str = "text", k: int = SEED_CHARS) -> DataFrame:
    """One row per document with a shared span: ``n_chars``, ``shared_chars``, ``shared_share``, ``n_texts``, ``n_copies``.

    ``shared_chars`` counts the characters that lie in a span of at least ``min_chars`` that another document holds too;
    ``n_texts`` is the number of other texts with such a span, ``n_copies`` that of other documents with the very text.
    """
    members = checkpoint(distinct_texts(docs, key, text, min_chars).distinct())
    matched = matched_texts(docs, min_chars, text, k).where(F.size("lengths_a") > 0)
    side = lambda s: matched.select(F.col(f"tid_{s}").alias("tid"), F.col(f"tid_{'b' if s == 'a' else 'a'}").alias("other"), F.explode(F.arrays_zip(F.col(f"starts_{s}").alias("start"), F.col(f"lengths_{s}").alias("length"))).alias("x"))
    spans = checkpoint(side("a").unionByName(side("b")).select("tid", "other", F.col("x.start").alias("s"), (F.col("x.start") + F.col("x.length")).alias("e")))
    partners = spans.groupBy("tid").agg(F.countDistinct("other").alias("n_texts"))
    # union of the spans of a text: a span adds what lies beyond the furthest end so far
    ends = spans.groupBy("tid", "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy("tid").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    new: Column = F.greatest(F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(w), F.lit(0))), F.lit(0))
    covered = ends.withColumn("new", new).groupBy("tid").agg(F.sum("new").alias("covered"))
    copies = members.groupBy("tid").agg((F.count("*") - 1).alias("n_copies"))
    per_text = copies.join(covered, "tid", "left").join(partners, "tid", "left").where("n_copies > 0 OR covered IS NOT NULL")
    lengths = docs.where(F.length(text) >= min_chars).select(F.col(key).alias("doc"), F.length(text).cast("bigint").alias("n_chars")).distinct()
    rows = members.join(per_text, "tid").join(lengths, "doc")
    shared = F.when(F.col("n_copies") > 0, F.col("n_chars")).otherwise(F.col("covered")).cast("bigint")
    return rows.select(F.col("doc").alias(key), "n_chars", shared.alias("shared_chars"), (shared / F.col("n_chars")).alias("shared_share"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), "n_copies")
