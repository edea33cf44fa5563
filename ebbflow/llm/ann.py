"""Approximate nearest neighbours by additive quantisation.

A vector, scaled to length 1, is approximated by the sum of one full-dimensional
codeword from each codebook. Codebooks are fitted on a bounded sample: k-means
on residuals, then joint least squares. Encoding is a beam search that keeps the
``beam`` best partial sums; the norm of the sum is stored beside the codes. A
query is scored against codes by adding table entries (query times codeword)
and dividing by the norm; the best of each block of rows are rescored exactly,
in double precision, on the original vectors.

Identical vectors are one row of the index, with their least ids: no group of
copies fills the places of a block, and ties within it go to the smaller ids.
Every distinct vector is encoded, on the executors. Queries go out in blocks of a fixed
size, each meeting all rows once; a task returns ``k`` exact neighbours for each
query and block of rows, so what is shuffled is k rows for each query and block.
Work is queries x rows. Coarse cells would cut it only where vectors cluster; the
README has the figures. Vectors are scaled by powers of two before any square.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbflow.llm.shared import arrow_map, cut_lineage, slices, stored

SAMPLE_ROWS = 8192
QUERY_BLOCK = 2048
ROW_BLOCK = 4096
#: A beam step holds rows x beam x codewords numbers: 8 MB for so many rows.
ENCODE_ROWS = 512
#: Least squares solves for codebooks x codewords unknowns on the driver: 3,072 of them take 75 MB a matrix.
CODEBOOKS = 12


#: Query blocks of one plan; each has a broadcast and a branch of the plan.
PLAN_BLOCKS = 32


def _scaled(values: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest number to between 0.5 and 1: the cosine is the same to the bit, and squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(values).max(axis=1, keepdims=True))
    return np.ldexp(values, -exponent)


def _lengths(values: np.ndarray) -> np.ndarray:
    return np.sqrt(np.add.reduce(values * values, axis=1))


def _unit(values: np.ndarray) -> np.ndarray:
    values = _scaled(values)
    return values / _lengths(values)[:, None]


def _kmeans(values: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = values[rng.choice(len(values), size=k, replace=len(values) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(values @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, values)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if (~full).any():
            centres[~full] = values[rng.choice(len(values), size=int((~full).sum()))]
    return centres


@dataclass(frozen=True)
class Codebooks:
    """``words``: codebooks x codewords x dimensions."""

    words: np.ndarray
    beam: int = 8

    @property
    def dimension(self) -> int:
        return self.words.shape[2]

    @cached_property
    def gram(self) -> np.ndarray:
        """Products of all pairs of codewords."""
        m, k, d = self.words.shape
        flat = self.words.reshape(m * k, d)
        return (flat @ flat.T).reshape(m, k, m, k)

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x codebooks, one byte each) and norms of the sums. Rows are taken ``ENCODE_ROWS`` at a time."""
        codes, norms = np.zeros((len(units), len(self.words)), np.uint8), np.zeros(len(units))
        for start in range(0, len(units), ENCODE_ROWS):
            part = slice(start, start + ENCODE_ROWS)
            codes[part], norms[part] = self._beam_search(units[part])
        return codes, norms

    def _beam_search(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, k, d = self.words.shape
        flat, gram = self.words.reshape(m * k, d), self.gram
        cross = (units @ flat.T).reshape(-1, m, k)
        own = np.einsum("mkd,mkd->mk", self.words, self.words)
        n = len(units)
        codes = np.zeros((n, 1, 0), dtype=np.int64)
        error = np.zeros((n, 1))
        for j in range(m):
            grown = error[:, :, None] + own[j] - 2 * cross[:, j, None, :]
            for i in range(j):
                grown += 2 * gram[i, :, j, :][codes[:, :, i]]
            width = grown.shape[1]
            flat_error = grown.reshape(n, width * k)
            keep = min(self.beam, flat_error.shape[1])
            best = np.argpartition(flat_error, keep - 1, axis=1)[:, :keep]
            error = np.take_along_axis(flat_error, best, axis=1)
            before = np.take_along_axis(codes, (best // k)[:, :, None].repeat(j, axis=2), axis=1)
            codes = np.concatenate((before, (best % k)[:, :, None]), axis=2)
        chosen = codes[np.arange(n), np.argmin(error, axis=1)]
        return chosen.astype(np.uint8), np.linalg.norm(self.decode(chosen), axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[j][codes[:, j]] for j in range(self.words.shape[0]))

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Rows x queries: approximate cosines by table lookup."""
        tables = np.einsum("mkd,qd->mkq", self.words, queries).astype(np.float32)
        total = tables[0][codes[:, 0]]
        for j in range(1, len(tables)):
            total += tables[j][codes[:, j]]
        return total / np.maximum(norms, 1e-12)[:, None].astype(np.float32)


def fit_codebooks(sample: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = 256, rounds: int = 8, beam: int = 8, seed: int = 7) -> Codebooks:
    """Residual k-means for each codebook in turn, then least squares for all codewords at once with the codes held."""
    units = _unit(np.asarray(sample, dtype=np.float64))
    rng = np.random.default_rng(seed)
    k = max(1, min(codewords, len(units), 256))
    rest, words = units.copy(), []
    for _ in range(codebooks):
        centres = _kmeans(rest, k, rounds, rng)
        near = np.argmax(rest @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        rest -= centres[near]
        words.append(centres)
    first = Codebooks(np.array(words), beam)
    codes, _ = first.encode(units)
    columns = codes.astype(np.int64) + np.arange(codebooks) * k
    design = np.zeros((codebooks * k, codebooks * k))
    target = np.zeros((codebooks * k, units.shape[1]))
    for i in range(codebooks):
        np.add.at(target, columns[:, i], units)
        for j in range(codebooks):
            cells = np.bincount(codes[:, i].astype(np.int64) * k + codes[:, j], minlength=k * k)
            design[i * k : (i + 1) * k, j * k : (j + 1) * k] = cells.reshape(k, k)
    design[np.diag_indices(len(design))] += 1e-2  # towards the codewords so far
    solved = np.linalg.solve(design, target + 1e-2 * first.words.reshape(codebooks * k, -1))
    return Codebooks(solved.reshape(codebooks, k, -1), beam)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of rows that take part: an id, and a vector without null or non-finite numbers that isn't zero."""
    values = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # no -0.0
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)


def distinct_vectors(rows: DataFrame, most_ids: int) -> DataFrame:
    """``ids, embedding``: each distinct vector of ``rows(vec_id, embedding)`` once, with its ``most_ids`` least ids.

    Every task drops what lies beyond ``most_ids`` before the shuffle, so a large group of copies stays small.
    """
    marked = rows.withColumn("mark", F.xxhash64("embedding"))  # compared first
    least = F.dense_rank().over(Window.partitionBy("mark", "embedding").orderBy("vec_id"))
    kept = marked.withColumn("place", least).where(F.col("place") <= most_ids)
    return kept.groupBy("mark", "embedding").agg(F.collect_set("vec_id").alias("ids")).select("ids", "embedding")


def build_index(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, codebooks: int = CODEBOOKS, beam: int = 8, most_ids: int = 6, **settings) -> tuple[Codebooks | None, DataFrame | None]:
    """Codebooks and the stored index ``ids, embedding, codes, norm`` of every distinct usable vector.

    ``ids``: the ``most_ids`` least ids of the vector, one more than the neighbours to be searched for.

    The sample is the ``sample_rows`` usable vectors of the least hash of their
    id. The index has one dimension, the one that most sampled vectors have;
    rows of another take no part. Null and None if no row is usable.
    """
    rows = usable(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").toArrow().column("embedding").to_pylist()
    if not sample:
        return None, None
    sizes = [len(v) for v in sample]
    d = max(sorted(set(sizes)), key=sizes.count)
    model = fit_codebooks(np.array([v for v in sample if len(v) == d]), codebooks, beam=beam, **settings)

    def encode(batches):
        for batch in slices(batches, ROW_BLOCK, 1 << 24):
            values = _vectors(batch.column(1), d)
            codes, norms = model.encode(_unit(values))
            packed = [row.tobytes() for row in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(norms)], ["ids", "embedding", "codes", "norm"])

    same = distinct_vectors(rows.where(F.size("embedding") == d), most_ids)
    index = cut_lineage(arrow_map(same, encode, "ids array<long>, embedding array<double>, codes binary, norm double"))
    return model, index


RESULT_SCHEMA = "query_id long, vec_id long, score double"


def search(model: Codebooks, index: DataFrame, queries: DataFrame, k: int = 5, rerank: int = 192, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries(vec_id, embedding)`` its ``k`` nearest of the index.

    Candidates are all rows of another id. Of each block of distinct vectors
    the ``rerank`` best by codes are scored exactly. The index must hold
    ``k + 1`` ids of a vector, as one may be the query's own. Ties go to the smaller id;
    rows that repeat an id count once, by their best score; of queries that
    repeat an id the least vector counts.
    """
    spark, d = index.sparkSession, model.dimension
    asked = cut_lineage(usable(queries).where(F.size("embedding") == d).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    total = asked.count()
    blocks = -(-total // block)
    numbered = asked.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))).alias("block"))
    found, groups = [], []
    for number in range(blocks):
        # a block holds about `block` queries: a fixed size, whatever the number of rows
        part = numbered.where(F.col("block") == number).orderBy("vec_id").select("vec_id", "embedding").toArrow()
        if not part.num_rows:
            continue
        ids = part.column("vec_id").to_numpy()
        held = spark.sparkContext.broadcast((ids, _vectors(part.column("embedding").combine_chunks(), d)))

        def look(batches, held=held):
            ids, values = held.value
            units, values = _unit(values), _scaled(values)
            lengths = _lengths(values)
            for batch in slices(batches, ROW_BLOCK, 1 << 24):
                own, held_ids = batch.column(0).flatten().to_numpy(), batch.column(0).value_lengths().to_numpy().astype(np.int64)
                first = np.cumsum(held_ids) - held_ids
                lone = np.flatnonzero(held_ids == 1)
                rows = _scaled(_vectors(batch.column(1), d))
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(rows), -1)
                norms, sizes = batch.column(3).to_numpy(), _lengths(rows)
                out_q, out_v, out_s = [], [], []
                for start in range(0, len(ids), 256):
                    near = model.scores(units[start : start + 256], codes, norms)
                    mine, asked_by = np.nonzero(own[first[lone], None] == ids[None, start : start + 256])
                    near[lone[mine], asked_by] = -np.inf
                    keep = min(rerank, len(rows))
                    best = np.argpartition(-near, keep - 1, axis=0)[:keep]
                    for q in range(best.shape[1]):
                        at = best[:, q]
                        # summed along each row by itself: a score doesn't depend on where its row stands
                        exact = np.add.reduce(rows[at] * values[start + q], axis=1) / (sizes[at] * lengths[start + q])
                        # a vector's score stands for each of its ids
                        many = held_ids[at]
                        names = own[np.arange(many.sum()) + np.repeat(first[at] - (np.cumsum(many) - many), many)]
                        exact = np.repeat(exact, many)[names != ids[start + q]]
                        names = names[names != ids[start + q]]
                        order = np.lexsort((names, -exact))
                        _, firsts = np.unique(names[order], return_index=True)
                        take = order[np.sort(firsts)[:k]]
                        out_q.append(np.full(len(take), ids[start + q]))
                        out_v.append(names[take])
                        out_s.append(exact[take])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

        found.append(arrow_map(index, look, RESULT_SCHEMA))
        if len(found) == PLAN_BLOCKS:  # what was found so far is stored, so a plan stays small
            groups.append(stored(reduce(DataFrame.unionByName, found)))
            found = []
    if not found and not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    union = reduce(DataFrame.unionByName, groups + found)
    best = union.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, **settings) -> DataFrame:
    """Neighbours of the rows whose ``vec_id`` is divisible by ``every`` among all other rows; see ``build_index`` and ``search``."""
    model, index = build_index(vectors, most_ids=k + 1, **settings)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(model, index, vectors.where(F.col("vec_id") % every == 0).select("vec_id", "embedding"), k)


__all__ = ["Codebooks", "build_index", "fit_codebooks", "nearest", "search", "usable"]
