"""One ranking from pairwise results: probit paired-comparison strengths.

P(i beats j) = Phi(s_i - s_j) with a normal (ridge) prior on the strengths. The posterior mode is found by iteratively
reweighted least squares, with the weights of the results seen; each step's sparse normal equations (X'WX + ridge) d =
gradient are solved by conjugate gradients. Standard errors are the roots of the diagonal of the inverse normal matrix with
the expected (Fisher) weights.

Vectors and pairs are blocks of a table. Items are numbered and cut into blocks of ``BLOCK_ITEMS``; each pair lies with the
item that has fewer opponents, so an item that met a third of all others leaves its pairs with them. One product of the
normal matrix is one job: blocks of items send the values that blocks of pairs need, these send back sums. The driver sees
a few sums over all blocks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from duelframe.operators.metrics import ranked
from duelframe.runtime import Written, parts_for

#: Items of one block of a vector.
BLOCK_ITEMS = 16_384
#: Sign vectors that the standard errors are estimated from (a power of two); up to so many items they are exact.
PROBES = 8
#: Items with most comparisons, whose standard errors are solved for exactly: sign vectors are worst for these.
EXACT_ITEMS = 12
#: Most steps of Newton's method and of one solve: an error beyond.
NEWTON_STEPS, SOLVER_STEPS = 60, 500
#: Greatest entry of the gradient at which the strengths are taken as found, and residuals (against the right side) of a solve.
GRADIENT, STEP_RESIDUAL, ERROR_RESIDUAL = 1e-3, 0.05, 2e-3

_GRID = np.linspace(-6.5, 6.5, 1_301)
_CDF = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in _GRID])


def normal(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Density, Phi(d) and Phi(-d); Phi by cubic Hermite interpolation between exact values, d held within 6."""
    d = np.clip(d, -6.0, 6.0)
    h = _GRID[1] - _GRID[0]

    def cdf(x: np.ndarray) -> np.ndarray:
        i = np.minimum(((x - _GRID[0]) / h).astype(np.int64), len(_GRID) - 2)
        t, x0 = (x - _GRID[i]) / h, _GRID[i]
        m0, m1 = (np.exp(-0.5 * y * y) / math.sqrt(2 * math.pi) * h for y in (x0, x0 + h))
        return (2 * t**3 - 3 * t**2 + 1) * _CDF[i] + (t**3 - 2 * t**2 + t) * m0 + (-2 * t**3 + 3 * t**2) * _CDF[i + 1] + (t**3 - t**2) * m1

    return np.exp(-0.5 * d * d) / math.sqrt(2 * math.pi), cdf(d), cdf(-d)


def pair_terms(d: np.ndarray, wins: np.ndarray, losses: np.ndarray, seen: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and weight of each pair at strength difference d: the expected (Fisher) weight, or that of the results seen."""
    density, up, down = normal(d)
    win, loss = density / up, density / down
    if seen:
        return wins * win - losses * loss, wins * win * (win + d) + losses * loss * (loss - d)
    return wins * win - losses * loss, (wins + losses) * win * loss


def _blocks(pairs: DataFrame, items: DataFrame, parts: int) -> DataFrame:
    """``block, kind, payload``: one row of kind "pairs" for each block that has pairs and one of kind "wants" for each block of items and block of pairs that needs values of it."""
    a = items.select(F.col("item").alias("winner"), F.col("idx").alias("i"))
    b = items.select(F.col("item").alias("loser"), F.col("idx").alias("j"))
    lo, up = F.least("i", "j"), F.col("i") < F.col("j")
    met = pairs.join(a, "winner").join(b, "loser").groupBy(lo.alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.sum(F.when(up, F.col("n")).otherwise(0.0)).alias("wins"), F.sum(F.when(up, 0.0).otherwise(F.col("n"))).alias("losses"))
    opponents = met.select(F.explode(F.array("lo", "hi")).alias("idx")).groupBy("idx").agg(F.count("*").alias("k"))
    sized = met.join(opponents.select(F.col("idx").alias("lo"), F.col("k").alias("klo")), "lo").join(opponents.select(F.col("idx").alias("hi"), F.col("k").alias("khi")), "hi")
    first = F.col("klo") <= F.col("khi")
    turn = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    rows = sized.select(turn("lo", "hi").alias("own"), turn("hi", "lo").alias("other"), turn("wins", "losses").alias("wins"), turn("losses", "wins").alias("losses"))
    rows = rows.withColumn("block", F.floor(F.col("own") / BLOCK_ITEMS).cast("int"))
    size = BLOCK_ITEMS

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        at = int(p["block"].iloc[0])
        own, other = p["own"].to_numpy(), p["other"].to_numpy()
        nodes = np.unique(np.concatenate([own, other]))
        homes = nodes // size
        held = {"own": np.searchsorted(nodes, own), "other": np.searchsorted(nodes, other), "wins": p["wins"].to_numpy(), "losses": p["losses"].to_numpy(), "homes": homes}
        out = [(at, "pairs", pickle.dumps(held))]
        out += [(int(c), "wants", pickle.dumps((at, (nodes[homes == c] - c * size).astype(np.int32)))) for c in np.unique(homes)]
        return pd.DataFrame(out, columns=["block", "kind", "payload"])

    return rows.repartition(parts, "block").groupBy("block").applyInPandas(pack, "block int, kind string, payload binary")


class _Solver:
    """The iterations. A block's state is a dict of arrays; a round is: each state sends, pairs fold, states merge."""

    def __init__(self, blocks: DataFrame, n: int, ridge: float, parts: int, exact: list[int]):
        self.n, self.ridge, self.parts, self.exact, self.spark = n, ridge, parts, exact, blocks.sparkSession
        self.store = Written(self.spark)
        # a table, so that the state's lineage begins here
        packed = self.store.keep(blocks, "blocks")
        self.pairs = self._placed(packed.where("kind = 'pairs'").select("block", "payload"))
        self.weighted = None
        size = BLOCK_ITEMS

        def start(p: pd.DataFrame) -> pd.DataFrame:
            c = int(p["block"].iloc[0])
            state = {"base": c * size, "n": min(size, n - c * size), "wants": dict(map(pickle.loads, p["payload"]))}
            state["s"] = np.zeros((state["n"], 1))
            return pd.DataFrame({"block": [c], "payload": [pickle.dumps(state)]})

        wants = packed.where("kind = 'wants'").select("block", "payload")
        self.state = self.store.keep(wants.repartition(parts, "block").groupBy("block").applyInPandas(start, "block int, payload binary"), "state")

    def _placed(self, pairs: DataFrame) -> DataFrame:
        return pairs.repartition(self.parts, "block").persist(StorageLevel.MEMORY_AND_DISK)

    def _round(self, send: Callable, fold: Callable, merge: Callable, dots: int, reweigh: bool = False, kind: type = np.float64) -> np.ndarray:
        """One exchange; the sums over all blocks (with ``reweigh`` the greatest) of the ``dots`` numbers that ``merge`` returns.

        ``send(state)`` gives the values to send, a row for each item; ``fold(pairs, values)`` gives the sums for the items of
        a block of pairs (and with ``reweigh`` its new contents before them); ``merge(state, sums)`` changes the state.
        """

        def sending(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                for c, payload in zip(p["block"], p["payload"]):
                    state = pickle.loads(payload)
                    values = send(state).astype(kind)
                    yield pd.DataFrame([(b, c, pickle.dumps(values[at])) for b, at in state["wants"].items()], columns=["block", "sender", "payload"])

        def folding(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame([], columns=["block", "sender", "payload"])
            held, b, sent = pickle.loads(left["payload"].iloc[0]), int(left["block"].iloc[0]), right.sort_values("sender")
            # senders and items are in the order of the block's own list of items
            sums, out = fold(held, np.concatenate([pickle.loads(v) for v in sent["payload"]]).astype(np.float64)), []
            if reweigh:
                held, sums = sums
                out.append((b, -2, pickle.dumps(held)))
            out += [(int(c), b, pickle.dumps(sums[held["homes"] == c].astype(kind))) for c in np.unique(held["homes"])]
            return pd.DataFrame(out, columns=["block", "sender", "payload"])

        def merging(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            state = pickle.loads(left["payload"].iloc[0])
            send(state)  # as in the task that sent: a state is read twice instead of being carried along
            sums = None
            for b, payload in sorted(zip(right["sender"], right["payload"])):
                part = pickle.loads(payload)
                sums = np.zeros((state["n"], part.shape[1])) if sums is None else sums
                sums[state["wants"][b]] += part  # an item stands once in a list
            found = merge(state, sums)
            return pd.DataFrame({"block": [int(left["block"].iloc[0])], "payload": [pickle.dumps(state)], "dots": [[float(v) for v in found]]})

        pairs = self.pairs if reweigh else self.weighted
        message = "block int, sender int, payload binary"
        state = self.state.select("block", "payload")
        sent = state.mapInPandas(sending, message).repartition(self.parts, "block")
        folded = pairs.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(folding, message)
        if reweigh:
            folded = self.store.keep(folded, "folded")
        sums = folded.where("sender != -2").repartition(self.parts, "block")
        state = state.repartition(self.parts, "block").groupBy("block").cogroup(sums.groupBy("block")).applyInPandas(merging, "block int, payload binary, dots array<double>")
        # each round's state is a table: plans that hold cached plans would grow from round to round
        seen = Observation()
        over = F.max if reweigh else F.sum
        self.state = self.store.keep(state.observe(seen, *[over(F.col("dots")[i]).alias(f"d{i}") for i in range(dots)]), "state")
        if reweigh:
            if self.weighted is not None:
                self.weighted.unpersist()
            self.weighted = self._placed(self.store.keep(folded.where("sender = -2").select("block", "payload"), "weighted"))
        return np.array([seen.get[f"d{i}"] for i in range(dots)])

    def _gradient(self, seen: bool) -> float:
        """Take the last solve's step, and the gradient and the weights at the new strengths."""
        ridge = self.ridge

        def send(state):
            state["s"] = state["s"] + state.pop("x", 0.0)
            return state["s"]

        def fold(held, y):
            own, other, k = held["own"], held["other"], len(y)
            g, w = pair_terms(y[own, 0] - y[other, 0], held["wins"], held["losses"], seen)
            sums = np.stack([np.bincount(own, g, k) - np.bincount(other, g, k), np.bincount(own, w, k) + np.bincount(other, w, k)], axis=1)
            return held | {"w": w}, sums

        def merge(state, sums):
            state["d"] = sums[:, 1:] + ridge
            state["r"] = sums[:, :1] - ridge * state["s"]
            for done in ("p", "q", "h"):
                state.pop(done, None)
            return [np.abs(state["r"]).max()]

        return float(self._round(send, fold, merge, 1, reweigh=True)[0])

    @staticmethod
    def _product(held, y):
        """The sums of w (y_i - y_j) over the pairs of each item, for every column."""
        own, other, k = held["own"], held["other"], len(y)
        flow = held["w"][:, None] * (y[own] - y[other])
        return np.stack([np.bincount(own, f, k) - np.bincount(other, f, k) for f in flow.T], axis=1)

    def _solve(self, width: int, tolerance: float, kind: type = np.float64) -> None:
        """Conjugate gradients for the right sides in ``r``, with the diagonal as preconditioner, into ``x``.

        In the form with one reduction a step: the products of u = r / d are carried on to those of the directions.
        """
        ridge, alpha, beta = self.ridge, None, None
        gamma, first = None, None
        for _ in range(SOLVER_STEPS):

            def send(state, alpha=alpha, beta=beta):
                if alpha is None:
                    state["r"] = state["r"].astype(kind)
                    state |= {c: np.zeros_like(state["r"]) for c in "xpq"}
                else:
                    state["p"] = (state["r"] / state["d"] + beta * state["p"]).astype(kind)
                    state["q"] = (state["h"] + beta * state["q"]).astype(kind)
                    state["x"] = (state["x"] + alpha * state["p"]).astype(kind)
                    state["r"] = (state["r"] - alpha * state["q"]).astype(kind)
                return state["r"] / state["d"]

            def merge(state, sums):
                r = state["r"].astype(np.float64)
                u = r / state["d"]
                h = sums + ridge * u
                state["h"] = h.astype(kind)
                return [*(r * u).sum(0), *(h * u).sum(0), *(r * r).sum(0)]

            new, delta, rr = self._round(send, self._product, merge, 3 * width, kind=kind).reshape(3, width)
            first = rr if first is None else first
            if (rr <= tolerance**2 * first).all():
                return
            new, delta = np.maximum(new, 1e-300), np.maximum(delta, 1e-300)
            beta = np.zeros(width) if gamma is None else new / gamma
            alpha = new / (delta if gamma is None else np.maximum(delta - beta * new / alpha, 1e-300))
            gamma = new
        raise RuntimeError(f"a solve didn't converge in {SOLVER_STEPS} steps")

    def _errors(self) -> None:
        """Standard errors from sign vectors z: the diagonal of the inverse is the mean of z (inverse z) over them.

        What is known of the inverse is left out of the mean and added exactly. A constant is an eigenvector with value
        ridge, so only the part of the inverse without constants, P inverse P, is sought. With D the diagonal and W the
        weights between items the inverse begins with M = 1/D + W/D^2 + the paths of two steps, whose diagonal is a sum over
        pairs; the diagonal of P M P needs M 1 besides, and the solve begins at P M P z. All terms of the inverse are
        positive, so the result is held above M's. The sign vectors of items whose numbers differ modulo their count are
        orthogonal, so that up to PROBES items nothing is left to chance. The items of ``exact`` get unit vectors of their own.
        """
        ridge, m, n, exact = self.ridge, PROBES, self.n, self.exact
        hadamard = np.array([[1.0]])
        while len(hadamard) < m:
            hadamard = np.block([[hadamard, hadamard], [hadamard, -hadamard]])

        def signs(state):
            idx = np.arange(state["base"], state["base"] + state["n"])
            mixed = (idx.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            return hadamard[idx % m] * np.where(mixed >> np.uint64(40) & np.uint64(1), 1.0, -1.0)[:, None]

        def send(state):
            if "v" not in state:
                state["z"] = np.concatenate([signs(state), np.ones((state["n"], 1))], axis=1)
                state["v"], state["m"] = state["z"] / state["d"], 0.0
            return np.concatenate([state["v"], 1 / state["d"]], axis=1)

        def fold(held, y):
            own, other, k, w2 = held["own"], held["other"], len(y), held["w"] ** 2
            two = np.bincount(own, w2 * y[other, -1], k) + np.bincount(other, w2 * y[own, -1], k)
            return np.concatenate([_Solver._product(held, y[:, :-1]), two[:, None]], axis=1)

        def merge(state, sums):
            state["m"] = state["m"] + state["v"]
            dots = [*state["z"].sum(0), *state["v"].sum(0)]
            state["v"] = state["v"] - (sums[:, :-1] + ridge * state["v"]) / state["d"]
            state["known"] = 1 / state["d"] + sums[:, -1:] / state["d"] ** 2
            return dots

        total = np.zeros(m + 1)
        for _ in range(3):
            dots = self._round(send, fold, merge, 2 * (m + 1), kind=np.float32)
            mean, total = dots[: m + 1] / n, total + dots[m + 1 :] / n
        middle = total[:m] - mean[:m] * total[m]  # of M P z

        def begin(state):
            # P z less the normal matrix times P M P z
            rest = state["d"] * (state["v"][:, :m] - mean[:m] * state["v"][:, m:]) + ridge * middle
            units = np.arange(state["base"], state["base"] + state["n"])[:, None] == np.array(exact, np.int64)
            state["r"] = np.concatenate([rest, units], axis=1)
            state["m"] = state["m"][:, m:]
            del state["z"], state["v"]  # the solve's vectors need the room
            return state

        self._change(begin)
        self._solve(m + len(exact), ERROR_RESIDUAL, np.float32)

        def end(state):
            without = state["known"] - 2 / n * state["m"] + total[m] / n
            found = without + (signs(state) * state["x"][:, :m]).mean(1, keepdims=True) + 1 / (n * ridge)
            for c, i in enumerate(exact):
                at = i - state["base"]
                if 0 <= at < state["n"]:
                    found[at] = state["x"][at, m + c]
            state["error"] = np.sqrt(np.maximum(found, state["known"]))
            return state

        self._change(end)

    def _change(self, change: Callable) -> None:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                yield p.assign(payload=[pickle.dumps(change(pickle.loads(v))) for v in p["payload"]])

        self.state = self.store.keep(self.state.select("block", "payload").mapInPandas(each, "block int, payload binary"), "state")

    def fit(self) -> DataFrame:
        """``idx, strength, std_error`` as a written table."""
        for _ in range(NEWTON_STEPS):
            if self._gradient(True) < GRADIENT:
                break
            self._solve(1, STEP_RESIDUAL)
        else:
            raise RuntimeError(f"strengths didn't converge in {NEWTON_STEPS} steps")
        self._gradient(False)
        self._errors()

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                for state in map(pickle.loads, p["payload"]):
                    yield pd.DataFrame({"idx": np.arange(state["base"], state["base"] + state["n"]), "strength": state["s"][:, 0], "std_error": state["error"][:, 0]})

        out = self.store.keep(self.state.select("block", "payload").mapInPandas(rows, "idx bigint, strength double, std_error double"), "fitted")
        for df in (self.pairs, self.weighted):
            df.unpersist()
        return out


def rank_items(results: DataFrame, winner: str = "winner", loser: str = "loser", ridge: float = 1.0) -> DataFrame:
    """One row per item: ``item, n_won, n_lost, strength, std_error, position``.

    ``results`` holds one row per decided comparison. Rows with a null side or an item against itself say nothing and are
    left out; repeated rows count as often as they stand (make them distinct before, where they are copies). Items with
    few comparisons are drawn to 0 by the prior, which also joins items that no chain of comparisons connects. Equal
    strengths are ordered by item. An empty table gives no rows. RuntimeError if the iterations do not converge.
    """
    spark = results.sparkSession
    store = Written(spark)
    pairs = results.select(F.col(winner).alias("winner"), F.col(loser).alias("loser")).where("winner IS NOT NULL AND loser IS NOT NULL AND winner != loser")
    pairs = store.keep(pairs.groupBy("winner", "loser").agg(F.count("*").cast("double").alias("n")), "pairs")
    each = pairs.select(F.inline(F.array(F.struct(F.col("winner").alias("item"), F.col("n").alias("won"), F.lit(0.0).alias("lost")), F.struct(F.col("loser").alias("item"), F.lit(0.0).alias("won"), F.col("n").alias("lost")))))
    totals = store.keep(each.groupBy("item").agg(F.sum("won").cast("long").alias("n_won"), F.sum("lost").cast("long").alias("n_lost")), "totals")
    n = totals.count()
    if not n:
        return totals.select("*", F.lit(0.0).alias("strength"), F.lit(0.0).alias("std_error"), F.lit(0).cast("long").alias("position"))
    sorts = parts_for(spark, n)
    items = store.keep(ranked(totals, [], ["item"], sorts).select("item", "n_won", "n_lost", (F.col("r") - 1).alias("idx")), "items")
    parts = -(-n // BLOCK_ITEMS)
    exact = [r[0] for r in items.orderBy(F.desc(F.col("n_won") + F.col("n_lost")), "idx").select("idx").limit(EXACT_ITEMS).collect()]
    fitted = _Solver(_blocks(pairs, items.select("item", "idx"), parts), n, ridge, parts, exact).fit()
    rows = items.join(fitted, "idx").withColumn("weak", -F.col("strength"))
    placed = ranked(rows, [], ["weak", "item"], sorts)
    return placed.select("item", "n_won", "n_lost", "strength", "std_error", F.col("r").alias("position"))
