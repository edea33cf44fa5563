"""Streaming k-means with a fixed learning rate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbflow.functions.expressions import total
from ebbflow.operators.base import Sequential


class StreamingKMeans(Sequential):
    """The first ``k`` rows become centroids as they are; after that the nearest, the first of equals, moves by ``learning_rate``.

    Clusters are numbered from 1; 0 means that nothing was learned.
    """

    state_ddl = "n bigint, centroids array<array<double>>, sizes array<bigint>"
    output_ddl = "cluster int"
    supervised = False

    def __init__(self, k: int = 3, learning_rate: float = 0.1):
        if k <= 0 or not 0 < learning_rate <= 1:
            raise ValueError("k > 0 and 0 < learning_rate <= 1 are needed")
        self.k, self.learning_rate = k, learning_rate

    def initial(self):
        return {"n": 0, "c": None, "sizes": []}

    def run(self, state, x, y, emit):
        if state["c"] is not None and state["c"].shape[1] != x.shape[1]:
            raise ValueError(f"expected {state['c'].shape[1]} features, got {x.shape[1]}")
        c, sizes, rate = state["c"], state["sizes"], self.learning_rate
        out = np.zeros(len(x), dtype=np.int64)
        for i, row in enumerate(x):
            if c is not None:
                gaps = c - row
                near = int(np.einsum("ij,ij->i", gaps, gaps).argmin())
                out[i] = near + 1
            if c is None or len(c) < self.k:
                c = row[None, :].copy() if c is None else np.concatenate((c, row[None, :]))
                sizes.append(1)
            else:
                c[near] -= rate * gaps[near]
                sizes[near] += 1
        state.update(n=state["n"] + len(x), c=c, sizes=sizes)
        return {"cluster": out}

    def apply(self, state, x):
        if state["c"] is None:
            return {"cluster": np.zeros(len(x), dtype=np.int64)}
        if state["c"].shape[1] != x.shape[1]:
            raise ValueError(f"expected {state['c'].shape[1]} features, got {x.shape[1]}")
        out = np.zeros(len(x), dtype=np.int64)
        for a in range(0, len(x), 8192):
            gaps = x[a : a + 8192, None, :] - state["c"]
            out[a : a + 8192] = (gaps * gaps).sum(axis=2).argmin(axis=1) + 1
        return {"cluster": out}

    def dump(self, state):
        return {"n": state["n"], "centroids": [] if state["c"] is None else state["c"].tolist(), "sizes": list(state["sizes"])}

    def load(self, row):
        return {"n": row["n"], "c": np.array(row["centroids"]) if row["centroids"] else None, "sizes": list(row["sizes"] or [])}


def nearest(centroids: Column, x: Column) -> Column:
    """Number of the nearest centroid, from 1, the first of equals; 0 if there is none."""
    gaps = F.transform(centroids, lambda c: total(F.zip_with(c, x, lambda a, b: (a - b) * (a - b))))
    return F.when(F.size(centroids) > 0, F.array_position(gaps, F.array_min(gaps))).otherwise(0).cast("int")
