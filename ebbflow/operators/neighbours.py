"""k nearest neighbours over the last rows of a stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ebbflow.operators.base import Sequential
from ebbflow.plans.fold import fold
from ebbflow.plans.layout import Names
from ebbflow.plans.windows import halo_blocks

DISTANCES = ("euclidean", "cityblock", "chebyshev", "minkowski", "cosine")
#: Numbers in a block of distances: 16 MB.
CELLS = 1 << 21


class KNN(Sequential):
    """Votes of the ``k`` nearest of the last ``window_size`` rows.

    Weights are ``1 / distance`` (``1e10`` at distance 0) or, if not
    ``weighted``, 1. Of equal distances the older row counts; of equal votes
    the least label wins. With no rows yet: label 0 and no probabilities.
    """

    state_ddl = "n bigint, window array<struct<x:array<double>,label:int>>"
    output_ddl = "y_pred int, proba map<int,double>"

    def __init__(self, k: int = 5, window_size: int = 1000, weighted: bool = True, distance: str = "euclidean", p: float = 2.0):
        if k <= 0 or window_size <= 0:
            raise ValueError("k and window_size must be positive")
        if distance not in DISTANCES:
            raise ValueError(f"distance must be one of {DISTANCES}")
        self.k, self.window_size, self.weighted, self.distance, self.p = k, window_size, weighted, distance, p

    def initial(self):
        return {"n": 0, "x": None, "y": np.zeros(0, dtype=np.int64)}

    def _distances(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.distance == "cosine":
            lengths = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)
            return 1 - queries @ rows.T / np.where(lengths > 0, lengths, 1)
        out = np.empty((len(queries), len(rows)))
        step = max(1, CELLS // max(1, rows.size))
        for a in range(0, len(queries), step):
            gaps = np.abs(queries[a : a + step, None, :] - rows)
            if self.distance == "euclidean":
                out[a : a + step] = np.sqrt((gaps * gaps).sum(axis=2))
            elif self.distance == "cityblock":
                out[a : a + step] = gaps.sum(axis=2)
            elif self.distance == "chebyshev":
                out[a : a + step] = gaps.max(axis=2)
            else:
                out[a : a + step] = (gaps**self.p).sum(axis=2) ** (1 / self.p)
        return out

    def _vote(self, distances: np.ndarray, labels: np.ndarray) -> tuple[list, list]:
        """Distances of each query to rows in their order; infinite where a row doesn't count."""
        k = min(self.k, distances.shape[1])
        order = np.argsort(distances, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(distances, order, axis=1)
        weight = np.ones_like(near) if not self.weighted else np.where(near == 0, 1e10, 1 / np.where(near == 0, 1, near))
        weight = np.where(np.isinf(near), 0.0, weight)
        predicted, shares = [], []
        for w, at in zip(weight, order, strict=True):
            votes: dict[int, float] = {}
            for v, c in zip(w.tolist(), labels[at].tolist(), strict=True):
                if v:
                    votes[c] = votes.get(c, 0.0) + v
            if not votes:
                predicted.append(0)
                shares.append([])
                continue
            whole = sum(votes.values())
            predicted.append(min(votes, key=lambda c: (-votes[c], c)))
            shares.append([(c, votes[c] / whole) for c in sorted(votes)])
        return predicted, shares

    def run(self, state, x, y, emit):
        d, w = x.shape[1], self.window_size
        held = np.zeros((0, d)) if state["x"] is None else state["x"]
        if held.shape[1] != d:
            raise ValueError(f"expected {held.shape[1]} features, got {d}")
        predicted: list = []
        shares: list = []
        labels = y.astype(np.int64)
        step = max(1, min(512, w))
        for a in range(0, len(x), step):
            block, marks = x[a : a + step], labels[a : a + step]
            rows, known = np.concatenate((held, block)), np.concatenate((state["y"], marks))
            if emit:
                distances = self._distances(block, rows)
                age = np.arange(len(rows)) - len(held)  # row i of the block sees rows of age i - w to i - 1
                at = np.arange(len(block))[:, None]
                distances[(age >= at) | (age < at - w)] = np.inf
                found = self._vote(distances, known)
                predicted += found[0]
                shares += found[1]
            held, state["y"] = rows[-w:], known[-w:]
        state["x"], state["n"] = held, state["n"] + len(x)
        return {"y_pred": predicted, "proba": shares}

    def apply(self, state, x):
        if not state["n"]:
            return {"y_pred": [0] * len(x), "proba": [[]] * len(x)}
        if state["x"].shape[1] != x.shape[1]:
            raise ValueError(f"expected {state['x'].shape[1]} features, got {x.shape[1]}")
        predicted: list = []
        shares: list = []
        for a in range(0, len(x), 512):
            found = self._vote(self._distances(x[a : a + 512], state["x"]), state["y"])
            predicted += found[0]
            shares += found[1]
        return {"y_pred": predicted, "proba": shares}

    def dump(self, state):
        rows = [] if state["x"] is None else state["x"].tolist()
        return {"n": state["n"], "window": [{"x": r, "label": c} for r, c in zip(rows, state["y"].tolist(), strict=True)]}

    def load(self, row):
        held = row["window"] or []
        return {"n": row["n"], "x": np.array([v["x"] for v in held]) if held else None, "y": np.array([v["label"] for v in held], dtype=np.int64)}

    def prequential_parts(self, df: DataFrame, features: Names, target: str, order_by: Names, key: Names = None, rows_per_block: int = 20_000) -> DataFrame:
        """``prequential``, with a key's rows dealt into parts that overlap by the window: one long stream is no longer one task."""
        at = self.layout(df, features, target, order_by, key)
        dealt = halo_blocks(df, at.order_by, self.window_size + 1, at.key, rows_per_block)
        from dataclasses import replace

        out = fold(dealt, self, replace(at, key=(*at.key, "__part"), order_by=("__rn",)), "run", spare="__halo")
        return out.drop("__part", "__rn")
