"""Anomaly detectors: random half-space trees, Gaussian projections, a random cut forest."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.expressions import sigmoid, total
from ebbflow.operators.base import Sequential, apply_global
from ebbflow.operators.linear import with_state
from ebbflow.plans.fold import fold, struct_of
from ebbflow.plans.layout import Layout, Names
from ebbflow.plans.windows import prefix, row_numbers

EPSILON = float(np.finfo(np.float64).eps)


def is_anomaly(score: Column | str, threshold: float = 0.5) -> Column:
    return (F.col(score) if isinstance(score, str) else score) > threshold


class HalfSpaceTrees(Sequential):
    """Mass of the leaf a row falls into, in the window before.

    Trees are complete, drawn once from the seed and not from the data: a box
    ``[u, u + v]`` for each, with u in [-1, 1] and v in [0, 2] for each feature
    (or the given ``bounds``), halved at random places. Counts are kept by
    window of ``window_size`` rows, and a row is scored by the last window that
    was complete when it came. ``score`` is the mean of mass times ``2^height``
    over trees, ``score_one`` its complement in [0, 1], high for anomalies.
    """

    state_ddl = "n bigint, reference array<array<bigint>>, latest array<array<bigint>>"
    output_ddl = "score double, score_one double"
    supervised = False

    def __init__(self, n_trees: int = 25, height: int = 8, window_size: int = 250, seed: int = 1, bounds: tuple[float, float] | None = None):
        if n_trees <= 0 or height < 0 or window_size <= 0:
            raise ValueError("n_trees > 0, height >= 0 and window_size > 0 are needed")
        self.n_trees, self.height, self.window_size, self.seed, self.bounds = n_trees, height, window_size, seed, bounds
        self._trees: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def trees(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Feature and threshold of each inner node, trees by rows; node k has children 2k + 1 and 2k + 2."""
        if d not in self._trees:
            rng, inner = np.random.default_rng(self.seed), (1 << self.height) - 1
            dims, cuts = np.zeros((self.n_trees, inner), np.int64), np.zeros((self.n_trees, inner))
            for t in range(self.n_trees):
                low = rng.random(d) * 2 - 1
                high = low + rng.random(d) * 2
                if self.bounds:
                    low, high = np.full(d, self.bounds[0]), np.full(d, self.bounds[1])
                boxes = [(low, high)]
                for k in range(inner):
                    low, high = boxes[k]
                    j = int(rng.integers(d))
                    dims[t, k], cuts[t, k] = j, low[j] + rng.random() * (high[j] - low[j])
                    left, right = high.copy(), low.copy()
                    left[j] = right[j] = cuts[t, k]
                    boxes += [(low, left), (right, high)]
            self._trees[d] = dims, cuts
        return self._trees[d]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree, from 0."""
        dims, cuts = self.trees(x.shape[1])
        node, rows, trees = np.zeros((len(x), self.n_trees), np.int64), np.arange(len(x))[:, None], np.arange(self.n_trees)
        for _ in range(self.height):
            node = 2 * node + 1 + (x[rows, dims[trees, node]] >= cuts[trees, node])
        return node - ((1 << self.height) - 1)

    def _count(self, leaves: np.ndarray) -> np.ndarray:
        size = 1 << self.height
        return np.bincount((leaves + np.arange(self.n_trees) * size).ravel(), minlength=self.n_trees * size).reshape(self.n_trees, size)

    def _scores(self, leaves: np.ndarray, reference: np.ndarray) -> np.ndarray:
        return reference[np.arange(self.n_trees), leaves].sum(axis=1) * float(1 << self.height) / self.n_trees

    def _one(self, scores: np.ndarray) -> np.ndarray:
        return np.clip(1 - scores / (self.window_size * float(1 << self.height)), 0, 1)

    def _blank(self) -> np.ndarray:
        return np.zeros((self.n_trees, 1 << self.height), np.int64)

    def initial(self):
        return {"n": 0, "reference": self._blank(), "latest": self._blank()}

    def run(self, state, x, y, emit):
        leaves, scores, at, w, new = self.leaves(x), np.zeros(len(x)), 0, self.window_size, state["n"] == 0
        while at < len(x):
            n = state["n"]
            end = min(len(x), at + w - n % w)
            first = at
            if n and n % w == 0:  # the row is scored before it closes the window
                scores[at] = self._scores(leaves[at : at + 1], state["reference"])[0]
                state["reference"], state["latest"] = state["latest"], self._blank()
                first = at + 1
            scores[first:end] = self._scores(leaves[first:end], state["reference"])
            state["latest"] = state["latest"] + self._count(leaves[at:end])
            state["n"] += end - at
            at = end
        ones = self._one(scores)
        if new and len(x):
            ones[0] = 0.5
        return {"score": scores, "score_one": ones} if emit else {}

    def apply(self, state, x):
        if not state["n"]:
            return {"score": np.zeros(len(x)), "score_one": np.full(len(x), 0.5)}
        scores = self._scores(self.leaves(x), state["reference"])
        return {"score": scores, "score_one": self._one(scores)}

    def dump(self, state):
        return {"n": state["n"], "reference": state["reference"].tolist(), "latest": state["latest"].tolist()}

    def load(self, row):
        return {"n": row["n"], "reference": np.array(row["reference"], np.int64), "latest": np.array(row["latest"], np.int64)}

    def prequential_parts(self, df: DataFrame, features: Names, order_by: Names, key: Names = None) -> DataFrame:
        """``prequential`` without one owner for each key.

        A row goes to the group that scores it and to the one it is a reference
        for: groups hold two windows, however long the stream. Rows with a null
        feature hold their place and count nowhere.
        """
        at = self.layout(df, features, None, order_by, key)
        place = F.col("__rn") - 1
        numbered = row_numbers(df, at.order_by, at.key, "__rn")
        copies = F.array(
            F.struct(F.greatest(F.floor((place - 1) / self.window_size), F.lit(0)).alias("g"), F.lit(1.0).alias("q")),
            F.struct((F.floor(place / self.window_size) + 1).alias("g"), F.lit(0.0).alias("q")),
        )
        dealt = numbered.withColumn("__to", F.explode(copies)).select("*", F.col("__to.g").alias("__group"), F.col("__to.q").alias("__query"), (F.col("__to.q") == 0).alias("__spare")).drop("__to")
        inner = replace(at, key=(*at.key, "__group"), order_by=("__query", "__rn"), target="__query")
        out = fold(dealt, _WindowPair(self), inner, "run", spare="__spare")
        first = F.when(F.col("__rn") == 1, 0.5).otherwise(F.col("score_one"))
        return out.select(*[F.col(f"`{c}`") for c in df.columns], "score", first.alias("score_one"))


class _WindowPair(Sequential):
    """Rows of target 0 are counted, rows of target 1 scored by the counts."""

    state_ddl, output_ddl = "n bigint", "score double, score_one double"

    def __init__(self, op: HalfSpaceTrees):
        self.op = op

    def initial(self):
        return {"mass": self.op._blank()}

    def run(self, state, x, y, emit):
        leaves, queries = self.op.leaves(x), y == 1
        state["mass"] = state["mass"] + self.op._count(leaves[~queries])
        scores = np.where(queries, self.op._scores(leaves, state["mass"]), 0.0)
        return {"score": scores, "score_one": self.op._one(scores)}


class GaussianProjectionDetector:
    """Mean absolute z-score over random directions, squashed to [0, 1]; 0.5 below two rows.

    ``directions`` may be given; otherwise they are drawn from the seed.
    """

    def __init__(self, n_projections: int = 10, seed: int = 1, directions: np.ndarray | None = None):
        if n_projections <= 0:
            raise ValueError("n_projections must be positive")
        self.n_projections, self.seed, self._given = n_projections, seed, directions

    def directions(self, d: int) -> np.ndarray:
        if self._given is not None:
            return np.asarray(self._given, dtype=np.float64)
        drawn = np.random.default_rng(self.seed).standard_normal((self.n_projections, d))
        return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)

    def projections(self, features: tuple[str, ...]) -> list[Column]:
        out = []
        for weights in self.directions(len(features)):
            terms = [F.col(f"`{f}`").cast("double") * float(w) for f, w in zip(features, weights, strict=True)]
            total_ = terms[0]
            for t in terms[1:]:
                total_ = total_ + t
            out.append(total_)
        return out

    @staticmethod
    def _score(n: Column, parts: list[tuple[Column, Column, Column]]) -> Column:
        """``parts``: projection, mean and sample variance of each direction."""
        z = [F.when(v > EPSILON, F.abs(p - m) / F.sqrt(F.when(v > EPSILON, v))).otherwise(0.0) for p, m, v in parts]
        return F.when(F.coalesce(n, F.lit(0)) < 2, 0.5).otherwise(sigmoid(total(F.array(*z)) / len(z) - 2.0))

    def fit(self, df: DataFrame, features: Names = None, key: Names = None, *, exclude: Names = None) -> FittedProjections:
        at = Layout.of(df, features, None, None, key, ordered=False, exclude=exclude)
        values = self.projections(at.features)
        state = df.groupBy(*[F.col(f"`{k}`") for k in at.key]).agg(
            F.count(values[0]).alias("n"), F.array(*[F.avg(v) for v in values]).alias("mean"), F.array(*[F.var_pop(v) * F.count(v) for v in values]).alias("m2")
        )
        return FittedProjections(self, at, state)

    def prequential(self, df: DataFrame, features: Names, order_by: Names, key: Names = None, name: str = "score_one") -> DataFrame:
        """All columns of ``df`` and the score of each row by the rows before it."""
        at = Layout.of(df, features, None, order_by, key)
        values = self.projections(at.features)
        row = df.agg(*[F.avg(v).alias(f"p{i}") for i, v in enumerate(values)]).first()
        pivots = [v if v is not None and v == v else 0.0 for v in row]
        sums = {}
        for i, (v, p) in enumerate(zip(values, pivots, strict=True)):
            sums |= {f"__s{i}": ("sum", v - p), f"__q{i}": ("sum", (v - p) * (v - p))}
        run = prefix(df, {"__n": ("count", values[0]), **sums}, at.order_by, at.key, False)
        n = F.when(F.col("__n") > 0, F.col("__n"))
        parts = [(v, F.col(f"__s{i}") / n + p, (F.col(f"__q{i}") - F.col(f"__s{i}") * F.col(f"__s{i}") / n) / F.when(n > 1, n - 1)) for i, (v, p) in enumerate(zip(values, pivots, strict=True))]
        return run.select(*[F.col(f"`{c}`") for c in df.columns], self._score(F.col("__n"), parts).alias(name))


LODA = GaussianProjectionDetector


@dataclass
class FittedProjections:
    op: GaussianProjectionDetector
    layout: Layout
    state: DataFrame

    def score_one(self, df: DataFrame, name: str = "score_one") -> DataFrame:
        held = self.state.select(*[F.col(f"`{k}`") for k in self.layout.key], F.struct("n", "mean", "m2").alias("__s"))
        met = with_state(df, held, self.layout.key)
        n = F.col("__s.n")
        parts = [(v, F.get(F.col("__s.mean"), F.lit(i)), F.get(F.col("__s.m2"), F.lit(i)) / F.when(n > 1, n - 1)) for i, v in enumerate(self.op.projections(self.layout.features))]
        return met.select(*[F.col(f"`{c}`") for c in df.columns], self.op._score(n, parts).alias(name))

    def merge(self, other: FittedProjections) -> FittedProjections:
        d = self.op.n_projections
        both = self.state.unionByName(other.state)
        at = lambda name, i: F.get(F.col(name), F.lit(i))
        mean = [F.sum(F.col("n") * at("mean", i)) / F.sum("n") for i in range(d)]
        m2 = [F.sum(at("m2", i)) + F.greatest(F.sum(F.col("n") * at("mean", i) * at("mean", i)) - F.sum("n") * mean[i] * mean[i], F.lit(0.0)) for i in range(d)]
        state = both.groupBy(*[F.col(f"`{k}`") for k in self.layout.key]).agg(F.sum("n").alias("__n"), F.array(*mean).alias("__mean"), F.array(*m2).alias("__m2"))
        return FittedProjections(self.op, self.layout, state.withColumnsRenamed({"__n": "n", "__mean": "mean", "__m2": "m2"}))


_MASK = 0xFFFFFFFFFFFFFFFF


def _mix(numbers: np.ndarray, seed: int, tree: int, draw: int) -> np.ndarray:
    """Uniform in [0, 1) for each row number (splitmix64 over seed, tree, number and draw)."""
    h: int | np.ndarray = 0x9E3779B97F4A7C15
    for p in (seed, tree):
        h = (h ^ p) * 0xBF58476D1CE4E5B9 & _MASK
        h = (h ^ h >> 27) * 0x94D049BB133111EB & _MASK
        h ^= h >> 31
    h = np.full(len(numbers), h, dtype=np.uint64)
    for p in (numbers.astype(np.uint64), np.uint64(draw)):
        h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


class CutTree:
    """A binary tree over retained points; node ids index parallel lists, leaves are found by point number."""

    __slots__ = ("cut", "dim", "free", "leaf", "left", "parent", "right", "root")

    def __init__(self):
        self.left, self.right, self.parent, self.dim, self.cut = [], [], [], [], []
        self.leaf: dict[int, int] = {}
        self.free: list[int] = []
        self.root = -1

    @property
    def size(self) -> list[int]:
        """Points below each node."""
        out = [0] * len(self.left)
        for at in self.leaf.values():
            while at >= 0:
                out[at] += 1
                at = self.parent[at]
        return out

    def learn(self, points: list, first: int, window: int, flat: list[bool], dims: list[int], cuts: list[float], ahead: list[bool]) -> list[int]:
        """Inserts points numbered from ``first``, the oldest leaving a window of ``window`` first; the depth of each when it was inserted.

        Down by the cuts to a leaf, which a random cut of the bounding box then
        shares with the new point. Where a point leaves, its sibling takes the
        parent's place.
        """
        left, right, parent, dim, cut, leaf, free, root = self.left, self.right, self.parent, self.dim, self.cut, self.leaf, self.free, self.root
        depths = []
        for number, (point, low, d, c, after) in enumerate(zip(points, flat, dims, cuts, ahead, strict=True), first):
            if number > window:
                at = leaf.pop(number - window)
                branch = parent[at]
                free.append(at)
                if branch < 0:
                    root = -1
                else:
                    other = right[branch] if left[branch] == at else left[branch]
                    above = parent[branch]
                    parent[other] = above
                    if above < 0:
                        root = other
                    elif left[above] == branch:
                        left[above] = other
                    else:
                        right[above] = other
                    free.append(branch)
            if free:
                new = free.pop()
                left[new] = right[new] = parent[new] = -1
            else:
                new = len(left)
                left.append(-1), right.append(-1), parent.append(-1), dim.append(0), cut.append(0.0)
            leaf[number] = new
            if root < 0:
                root = new
                depths.append(0)
                continue
            at, above, depth = root, -1, 1
            while (next_ := left[at]) >= 0:
                above = at
                at = next_ if low or point[dim[at]] <= cut[at] else right[at]
                depth += 1
            if free:
                branch = free.pop()
            else:
                branch = len(left)
                left.append(-1), right.append(-1), parent.append(-1), dim.append(0), cut.append(0.0)
            left[branch], right[branch] = (at, new) if after else (new, at)
            dim[branch], cut[branch], parent[branch] = d, c, above
            parent[at] = parent[new] = branch
            if above < 0:
                root = branch
            elif left[above] == at:
                left[above] = branch
            else:
                right[above] = branch
            depths.append(depth)
        self.root = root
        return depths

    def codisplacement(self, number: int) -> float:
        """Depth plus the sizes of the siblings on the way up, which are all other points; 0 for a lone point."""
        at, depth = self.leaf[number], 0
        while (at := self.parent[at]) >= 0:
            depth += 1
        return float(depth + len(self.leaf) - 1)


def _random_cuts(low: np.ndarray, high: np.ndarray, numbers: np.ndarray, seed: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and place of each row's cut through its bounding box, features in proportion to their spans."""
    spans = high - low
    whole = np.zeros(len(low))
    for j in range(spans.shape[1]):
        whole += spans[:, j]
    left, dim = _mix(numbers, seed, tree, 0) * whole, np.full(len(low), spans.shape[1] - 1)
    waiting = np.ones(len(low), dtype=bool)
    for j in range(spans.shape[1]):
        left = left - spans[:, j]
        dim[waiting & (left <= 0)] = j
        waiting &= left > 0
    dim[whole <= 0] = 0
    each = np.arange(len(low))
    cut = low[each, dim] + _mix(numbers, seed, tree, 1) * spans[each, dim]
    return dim, np.where(whole <= 0, (low[:, 0] + high[:, 0]) / 2, cut)


class CutForest(Sequential):
    """Some trees of a forest: scores are sums over these trees."""

    state_ddl = (
        "n bigint, numbers array<bigint>, points array<array<double>>, low array<double>, high array<double>, "
        "trees array<struct<root:int,left:array<int>,right:array<int>,parent:array<int>,dim:array<int>,cut:array<double>,size:array<int>,points:array<bigint>,leaves:array<int>,free:array<int>>>"
    )
    output_ddl = "score double, size int"
    supervised = False

    def __init__(self, trees: list[int], tree_size: int, seed: int):
        self.trees, self.tree_size, self.seed = trees, tree_size, seed

    def initial(self):
        return {"n": 0, "numbers": [], "points": [], "low": None, "high": None, "trees": [CutTree() for _ in self.trees]}

    def run(self, state, x, y, emit):
        """Inserts each row, the oldest leaving a full window first; a row's score is that after its insertion.

        Boxes and cuts of all rows are drawn at once, and each tree then takes
        the rows in one loop.
        """
        if not len(x):
            return {"score": [], "size": []}
        if state["points"] and len(state["points"][0]) != x.shape[1]:
            raise ValueError(f"expected {len(state['points'][0])} features, got {x.shape[1]}")
        held = state["low"] is not None
        low = np.minimum.accumulate(np.concatenate(([state["low"]], x)) if held else x)[-len(x) :]
        high = np.maximum.accumulate(np.concatenate(([state["high"]], x)) if held else x)[-len(x) :]
        numbers = np.arange(state["n"] + 1, state["n"] + len(x) + 1)
        points, flat = x.tolist(), (low == high).all(axis=1).tolist()
        sizes = np.minimum(numbers, self.tree_size)
        scores = np.zeros(len(x), dtype=np.int64)
        for t, name in zip(state["trees"], self.trees, strict=True):
            dims, cuts = _random_cuts(low, high, numbers, self.seed, name)
            ahead = (_mix(numbers, self.seed, name, 2) < 0.5).tolist()
            scores += t.learn(points, state["n"] + 1, self.tree_size, flat, dims.tolist(), cuts.tolist(), ahead)
            scores += sizes - 1
        state["n"], state["low"], state["high"] = int(numbers[-1]), low[-1].tolist(), high[-1].tolist()
        state["numbers"] = (state["numbers"] + numbers[-self.tree_size :].tolist())[-self.tree_size :]
        state["points"] = (state["points"] + points[-self.tree_size :])[-self.tree_size :]
        return {"score": scores.astype(np.float64).tolist(), "size": sizes.tolist()}

    def apply(self, state, x):
        """Scores of retained points, the oldest that is equal to within rounding; null for others."""
        held, out = np.array(state["points"]).reshape(len(state["points"]), -1), []
        for point in x:
            near = np.flatnonzero(np.linalg.norm(held - point, axis=1) <= 1.5e-8 * np.maximum(np.linalg.norm(held, axis=1), np.linalg.norm(point))) if len(held) else []
            out.append(sum(t.codisplacement(state["numbers"][int(near[0])]) for t in state["trees"]) if len(near) else None)
        return {"score": out, "size": [len(held)] * len(x)}

    def dump(self, state):
        trees = [
            {"root": t.root, "left": t.left, "right": t.right, "parent": t.parent, "dim": t.dim, "cut": t.cut, "size": t.size, "points": list(t.leaf), "leaves": list(t.leaf.values()), "free": t.free}
            for t in state["trees"]
        ]
        return {**{k: state[k] for k in ("n", "numbers", "points", "low", "high")}, "trees": trees}

    def load(self, row):
        trees = []
        for held in row["trees"]:
            t = CutTree()
            t.root = held["root"]
            for name in ("left", "right", "parent", "dim", "cut", "free"):
                setattr(t, name, list(held[name]))
            t.leaf = dict(zip(held["points"], held["leaves"], strict=True))
            trees.append(t)
        points = [list(p) for p in row["points"]]
        low, high = (list(row[k]) if row[k] is not None else None for k in ("low", "high"))
        return {"n": row["n"], "numbers": list(row["numbers"]), "points": points, "low": low, "high": high, "trees": trees}


class _SharedForest(Sequential):
    """A share of the trees, by the number in the first feature."""

    output_ddl = CutForest.output_ddl
    state_ddl = CutForest.state_ddl
    supervised = False

    def __init__(self, shares: list[list[int]], tree_size: int, seed: int):
        self.forests = [CutForest(share, tree_size, seed) for share in shares]

    def initial(self):
        return {}

    def run(self, state, x, y, emit):
        forest = self.forests[int(x[0, 0])] if len(x) else self.forests[0]
        if not state and len(x):
            state.update(forest.initial())
        return forest.run(state, x[:, 1:], y, emit)


class RandomCutForestApproximation:
    """A forest of random cut trees over the last ``tree_size`` rows; high scores for points that stand apart.

    Trees are independent, so a key's rows are folded by ``blocks`` owners, each
    with its share of the trees; scores are means over all trees.
    """

    def __init__(self, n_trees: int = 100, tree_size: int = 256, seed: int = 1, blocks: int = 8):
        if n_trees <= 0 or tree_size <= 0:
            raise ValueError("n_trees and tree_size must be positive")
        self.n_trees, self.tree_size, self.seed, self.blocks = n_trees, tree_size, seed, max(1, min(blocks, n_trees))

    def _shares(self) -> list[list[int]]:
        return [list(range(b, self.n_trees, self.blocks)) for b in range(self.blocks)]

    def fit_score(self, df: DataFrame, features: Names, order_by: Names, key: Names = None, threshold: float = 3.0) -> DataFrame:
        """All columns of ``df``, the score of each row after it was inserted, and ``is_anomaly``: the score over the expected depth exceeds ``threshold``."""
        at = Layout.of(df, features, None, order_by, key)
        by = [f"__k{i}" for i in range(len(at.key))] + [f"__o{i}" for i in range(len(at.order_by))]
        rows = df.select(
            *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(at.key)], *[F.col(f"`{o}`").alias(f"__o{i}") for i, o in enumerate(at.order_by)],
            *[F.col(f"`{f}`").cast("double").alias(f"__f{i}") for i, f in enumerate(at.features)], F.struct("*").alias("__whole"),
        )
        inner = Layout(("__b", *[f"__f{i}" for i in range(len(at.features))]), None, tuple(by[len(at.key) :]), (*by[: len(at.key)], "__b"))
        # one scan: each row goes to the owners of all shares, the whole row to the first alone
        dealt = rows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))).withColumn("__whole", F.when(F.col("__b") == 0, F.col("__whole")))
        summed = fold(dealt, _SharedForest(self._shares(), self.tree_size, self.seed), inner, "run").select(*by, "__whole", "score", "size")
        met = summed.groupBy(*by).agg(F.first("__whole", ignorenulls=True).alias("__whole"), (F.sum("score") / self.n_trees).alias("score"), F.max("size").alias("__size"))
        depth = F.greatest(F.lit(1.0), F.log2(F.greatest(F.col("__size").cast("double"), F.lit(1.0))))
        return met.select(*[F.col(f"__whole.`{c}`").alias(c) for c in df.columns], "score", (F.col("score") / depth > threshold).alias("is_anomaly"))

    def fit(self, df: DataFrame, features: Names, order_by: Names, key: Names = None) -> FittedForest:
        at = Layout.of(df, features, None, order_by, key)
        return FittedForest(self, at, [fold(df, CutForest(share, self.tree_size, self.seed), at, "fit") for share in self._shares()])


RobustRandomCutForest = RandomCutForestApproximation


@dataclass
class FittedForest:
    """``states``: a table for each share of the trees."""

    op: RandomCutForestApproximation
    layout: Layout
    states: list[DataFrame]

    def score(self, df: DataFrame) -> DataFrame:
        """All columns of ``df`` and the scores of points that the forest retains, null for others."""
        at = replace(self.layout, order_by=())
        out = df
        names = []
        for i, (share, state) in enumerate(zip(self.op._shares(), self.states, strict=True)):
            forest = CutForest(share, self.op.tree_size, self.op.seed)
            made = fold(out, forest, at, "apply", state) if at.key else apply_global(out, forest, at.features, state)
            out = made.withColumnRenamed("score", f"__s{i}").drop("size")
            names.append(f"__s{i}")
        whole = F.col(names[0])
        for n in names[1:]:
            whole = whole + F.col(n)
        return out.select(*[F.col(f"`{c}`") for c in df.columns], (whole / self.op.n_trees).alias("score"))

    def inspect(self) -> DataFrame:
        """Key columns, ``n_trees``, ``tree_size`` and ``current_size``."""
        keys = [F.col(f"`{k}`") for k in self.layout.key]
        return self.states[0].select(*keys, F.lit(self.op.n_trees).alias("n_trees"), F.lit(self.op.tree_size).alias("tree_size"), F.size("numbers").alias("current_size"))


__all__ = ["LODA", "CutForest", "CutTree", "GaussianProjectionDetector", "HalfSpaceTrees", "RandomCutForestApproximation", "RobustRandomCutForest", "is_anomaly", "struct_of"]
