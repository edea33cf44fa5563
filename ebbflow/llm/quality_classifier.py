"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, on the executors. Training takes a bounded
sample of labelled rows to the driver (``MAX_TRAINING_ROWS`` rows of
``len(FEATURES)`` numbers), bins each statistic into at most 256 cells and grows
trees level by level from histograms of gradients. A fitted model is three flat
arrays; scoring walks all trees for all rows of a batch at once with numpy, one
step for each level, and is a narrow map without shuffle.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.shared import arrow_map, binary_values, slices

MAX_TRAINING_ROWS = 20_000
_COMMON = frozenset(
    b"the of and to a in is that it for was on with as by be this are at from "
    b"der die und den von zu das mit sich des auf ist im dem nicht ein eine als "
    b"de la le et les en un du une que pour est dans qui par sur pas au avec "
    b"el y los se las del por con no su para al es lo".split()
)
FEATURES = (
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "newline", "bang", "comma_stop", "symbol", "other_punct", "high_bytes",
    "byte_entropy", "mean_word", "max_word", "distinct_words", "top_word", "same_as_previous", "distinct_pairs", "common_words",
    "words_per_line", "repeated_lines", "symbol_ends",
)


def _mask(chars: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(chars)] = 1
    return mask


_CLASSES = np.stack(
    [
        _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789"), _mask(b" \t\r\x0b\x0c"), _mask(b"\n"), _mask(b"!"),
        _mask(b",."), _mask(b"#*$%&|<>"), _mask(b"\"'()-/:;=?@[]^_`{}~+\\"), _mask(bytes(range(128, 256))),
    ],
    axis=1,
)


def statistics(text: bytes) -> list[float]:
    """``FEATURES`` of one text's UTF-8 bytes; every share of an empty text is 0."""
    words = text.split()
    n_bytes, n = len(text), len(words)
    if not n:
        return [float(np.log1p(n_bytes)), *[0.0] * (len(FEATURES) - 1)]
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    shares = counts / n_bytes
    positive = shares[shares > 0]
    found = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    lengths = list(map(len, words))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    return [
        float(np.log1p(n_bytes)), float(np.log1p(n)), *(shares @ _CLASSES).tolist(), float(-(positive * np.log2(positive)).sum()),
        sum(lengths) / n, float(np.log1p(max(lengths))), len(found) / n, max(found.values()) / n,
        sum(map(operator.eq, words, words[1:])) / n, pairs / max(1, n - 1), sum(map(_COMMON.__contains__, text.lower().split())) / n,
        n / len(lines), 1 - len(set(lines)) / len(lines), sum(c for w, c in found.items() if w[-1] in b"#*$%&|<>!") / n,
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(text) for text in binary_values(column)], dtype=np.float64).reshape(-1, len(FEATURES))


def document_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` columns ``doc_id`` and, if there, ``target``, with ``features: array<double>``. Null texts count as empty."""
    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    kept.append((F.col("target") if "target" in docs.columns else F.lit(None)).cast("int").alias("target"))

    def describe(batches):
        for batch in slices(batches):
            values = _matrix(batch.column(1))
            bounds = np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)
            features = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), features], ["doc_id", "target", "features"])

    return arrow_map(docs.select(*kept), describe, "doc_id long, target int, features array<double>")


@dataclass(frozen=True)
class GradientBoostedTrees:
    """Complete binary trees in flat arrays: node ``k`` has children ``2k + 1`` and ``2k + 2``; a row goes right if its value exceeds the threshold."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    n_rows: int = 0

    @property
    def trained(self) -> bool:
        return self.n_rows > 0

    def margin(self, values: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        out = np.full(len(values), self.base)
        if not trees:
            return out
        offsets = np.arange(trees) * inner
        feature, threshold, leaf = self.feature.ravel(), self.threshold.ravel(), self.leaf.ravel()
        rows = np.arange(len(values))[:, None]
        node = np.zeros((len(values), trees), dtype=np.int64)
        while inner and node[0, 0] < inner if len(values) else False:
            at = node + offsets
            node = 2 * node + 1 + (values[rows, feature[at]] > threshold[at])
        return out + leaf[node - inner + np.arange(trees) * (inner + 1)].sum(axis=1)

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(values)))


def train(
    values: np.ndarray, target: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 128, least: float = 2.0, l2: float = 1.0
) -> GradientBoostedTrees:
    """Logistic loss, Newton leaves, depth-wise growth. ``least``: hessian that each child needs. Ties go to the lower feature and bin."""
    n, d = values.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    positive = float(target.sum())
    base = float(np.log((positive + 1) / (n - positive + 1)))
    if n == 0 or positive in (0.0, float(n)):
        return GradientBoostedTrees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), n)
    cuts = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    cell = np.stack([np.searchsorted(cuts[j], values[:, j], side="left") for j in range(d)], axis=1)
    width = max(len(c) for c in cuts) + 1
    flat = cell + np.arange(d) * width
    margin = np.full(n, base)
    features, thresholds, values_of = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = target - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            size, first = 1 << level, (1 << level) - 1
            index = ((node - first)[:, None] * (d * width) + flat).ravel()
            g = np.bincount(index, np.repeat(gradient, d), size * d * width).reshape(size, d, width).cumsum(axis=2)
            h = np.bincount(index, np.repeat(hessian, d), size * d * width).reshape(size, d, width).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(h < least) | (all_h - h < least)] = -np.inf
            for k in range(size):
                best = int(np.argmax(gain[k]))
                j, b = divmod(best, width)
                if gain[k].flat[best] > 1e-6 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (values[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = rate * np.bincount(at, gradient, leaves) / (np.bincount(at, hessian, leaves) + l2)
        margin += leaf[at]
        features.append(feature), thresholds.append(threshold), values_of.append(leaf)
    return GradientBoostedTrees(base, np.array(features), np.array(thresholds), np.array(values_of), n)


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from: CRC-32 of the id as text leaves 2 when divided by 4. Null ids aren't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> GradientBoostedTrees:
    """Trains on at most ``max_rows`` labelled documents that aren't held out, those with the least hash of their id.

    Labels that are null, other than 0 or 1, or in conflict for one id are
    left out; of repeated documents one counts. Without labels of both classes
    the model scores every text alike.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("target")
    )
    agreed = usable.where(~held_out("of")).groupBy("of").agg(F.min("target").alias("target"), F.max("target").alias("most"))
    chosen = agreed.where(F.col("target") == F.col("most")).orderBy(F.xxhash64("of"), "of").limit(max_rows).select("of", "target")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most max_rows rows of two numbers
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("doc_id", "text", "target")
    one = document_statistics(joined).groupBy("doc_id").agg(F.min(F.struct("features", "target")).alias("row"))
    rows = one.select("doc_id", "row.features", "row.target").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    flat = rows.column("features").combine_chunks()
    values = np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, len(FEATURES))
    return train(values[order], rows.column("target").to_numpy().astype(np.float64)[order])


def score(docs: DataFrame, model: GradientBoostedTrees, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Null texts score as empty ones. Null and repeated ids are kept, each row
    scored by its own text; other columns are ignored; an empty table gives no
    rows.
    """

    def rate(batches):
        for batch in slices(batches):
            scores = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = arrow_map(texts, rate, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: GradientBoostedTrees, threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs``, all columns, whose score reaches ``threshold``; all rows if nothing was learned."""
    if not model.trained:
        return docs
    names = docs.columns
    at = names.index("text")

    def sift(batches):
        for batch in slices(batches):
            good = model.score(_matrix(batch.column(at))) >= threshold
            yield batch.filter(pa.array(good))

    return arrow_map(docs, sift, docs.schema)
