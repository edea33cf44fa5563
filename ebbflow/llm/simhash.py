"""Near-duplicates by SimHash under the general pigeonhole principle.

The 64 bits are grouped into partitions so that correlated bits share one. Two
fingerprints within ``radius`` bits agree, in some partition, up to that
partition's threshold, for any thresholds whose sum is ``radius - partitions +
1`` (a threshold of -1 leaves a partition out). For each fingerprint a dynamic
program over histograms of partition values picks the thresholds with the
fewest expected candidates; it probes the values within them, and candidates
are verified on all bits inside the join.

Identical fingerprints are merged first. A fingerprint whose cheapest choice
still has more than ``most_candidates`` candidates sends itself and its
one-bit (in general ``radius / 2``-bit) neighbours as keys instead: two such
fingerprints are linked if and only if they share a key, and at most that many
fingerprints can share one, so the work stays linear in any group. A pair in
which one side is below the limit is found by that side's probes. No pair is
lost, and no bucket is read by more probes than the limit allows.

Sizes on the driver: a 64 x 64 table of bit counts and a histogram of at most
``partitions * 2**width`` cells, whatever the number of documents.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.components import components
from ebbflow.llm.shared import arrow_map, binary_values, cut_lineage, listed_in, row_key, sieve_of, slices, stored, xxh64

BITS = 64


def fingerprint(text: bytes, size: int = 3, digest=xxh64(42)) -> bytes:
    """Big-endian fingerprint of one text: A-Z lower-cased, ``size``-word shingles, each bit 1 if set in over half the hashes."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter(map(digest, shingles), dtype=np.uint64, count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, 255):  # sums of bytes up to 255 rows can't overflow
        bits = np.unpackbits(hashes[start : start + 255].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, k1, k2, fp`` (``k1, k2``: the row's key; ``fp``: a signed long with the fingerprint's bits). Null texts count as empty."""

    def mark(batches):
        for batch in slices(batches):
            marks = b"".join([fingerprint(text, size) for text in binary_values(batch.column(3))])
            own = pa.array(np.frombuffer(marks, dtype=">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), own], ["doc_id", "k1", "k2", "fp"])

    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return arrow_map(docs.select(id_.alias("doc_id"), *row_key(id_, text), text.alias("text")), mark, "doc_id long, k1 long, k2 long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones, the lowest bit first."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _longs(batch) -> np.ndarray:
    return batch.column(0).to_numpy().view(np.uint64)


def correlated_partitions(nodes: DataFrame, partitions: int) -> list[list[int]]:
    """Bits dealt into equal partitions: each grows from the strongest correlated pair that is left by the bit most correlated to it."""

    def count(batches):
        total = np.zeros((BITS, BITS), dtype=np.int64)
        for batch in slices(batches, 8192):
            bits = _bits(_longs(batch)).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total.ravel()[cells])], ["cell", "n"])

    rows = arrow_map(nodes.select("fp"), count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros(BITS * BITS)
    both[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    both = both.reshape(BITS, BITS)
    n = max(1, nodes.count())
    share = np.diag(both) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    strength = np.abs(both / n - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(strength, -1)
    left, out = list(range(BITS)), []
    sizes = [BITS // partitions + (k < BITS % partitions) for k in range(partitions)]
    for size in sizes:
        if size == len(left):
            out.append(sorted(left))
            break
        inner = strength[np.ix_(left, left)]
        group = [left[k] for k in np.unravel_index(int(np.argmax(inner)), inner.shape)][: min(size, 2)]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(strength[np.ix_(rest, group)].sum(axis=1)))])
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def part_values(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Column k: the bits of partition k as one integer."""
    bits = _bits(fps)
    return np.stack([bits[:, g].astype(np.int64) @ (1 << np.arange(len(g), dtype=np.int64)) for g in groups], axis=1)


def ball(width: int, radius: int) -> np.ndarray:
    """Masks of at most ``radius`` of ``width`` bits, the empty one first."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], dtype=np.int64)


def candidate_counts(histogram: list[np.ndarray], groups: list[list[int]], radius: int) -> list[list[np.ndarray]]:
    """``[k][t]``: for each value of partition k, fingerprints whose value lies within t bits."""
    out = []
    for cells, group in zip(histogram, groups, strict=True):
        index, sums, total, seen = np.arange(len(cells)), [], np.zeros(len(cells), dtype=np.int64), 0
        for t in range(radius + 1):
            masks = ball(len(group), t)
            for mask in masks[seen:]:
                total = total + cells[index ^ mask]
            seen = len(masks)
            sums.append(total)
        out.append(sums)
    return out


def allocate(values: np.ndarray, counts: list[list[np.ndarray]], groups: list[list[int]], radius: int, per_key: float = 0.5):
    """Thresholds of each row by dynamic programming, and the candidates that they stand for.

    ``radius + 1`` units are dealt out; k units make a threshold of k - 1.
    The cost of a threshold is its candidates and ``per_key`` for each probe.
    """
    n, m = values.shape
    units = radius + 1
    best = np.full((units + 1, n), np.inf)
    best[0] = 0
    choices = []
    for k in range(m):
        cost = [np.zeros(n)]
        cost += [counts[k][t][values[:, k]] + per_key * sum(comb(len(groups[k]), r) for r in range(t + 1)) for t in range(units)]
        nxt, choice = np.full((units + 1, n), np.inf), np.zeros((units + 1, n), dtype=np.int64)
        for total in range(units + 1):
            for used in range(total + 1):
                found = best[total - used] + cost[used]
                better = found < nxt[total]
                nxt[total][better] = found[better]
                choice[total][better] = used
        best = nxt
        choices.append(choice)
    thresholds, at, rows = np.zeros((n, m), dtype=np.int64), np.full(n, units), np.arange(n)
    for k in range(m - 1, -1, -1):
        used = choices[k][at, rows]
        thresholds[:, k] = used - 1
        at = at - used
    candidates = sum(np.where(thresholds[:, k] >= 0, np.stack(counts[k])[np.maximum(thresholds[:, k], 0), values[:, k]], 0) for k in range(m))
    return thresholds, candidates


def links(nodes: DataFrame, radius: int = 2, partitions: int = 4, most_candidates: int = 256) -> DataFrame:
    """``a, b``: links that join all fingerprints of ``nodes(fp)`` (distinct) within ``radius`` bits.

    Every pair within the radius is listed or, in crowded regions, connected
    through others at no more than the radius. ``partitions`` must give widths of at most 20 bits.
    """
    if -(-BITS // partitions) > 20:
        raise ValueError("partitions of over 20 bits need too large a histogram")
    groups = correlated_partitions(nodes, partitions)

    def tally(batches):
        cells = [np.zeros(1 << len(g), dtype=np.int64) for g in groups]
        for batch in slices(batches, 8192):
            values = part_values(_longs(batch), groups)
            for k in range(partitions):
                cells[k] += np.bincount(values[:, k], minlength=len(cells[k]))
        for k in range(partitions):
            at = np.flatnonzero(cells[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(cells[k][at])], ["part", "value", "n"]
            )

    rows = arrow_map(nodes.select("fp"), tally, "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    part, value, n = (rows.column(c).to_numpy() for c in ("part", "value", "n"))
    histogram = []
    for k, g in enumerate(groups):
        cells = np.zeros(1 << len(g), dtype=np.int64)
        cells[value[part == k]] = n[part == k]
        histogram.append(cells)

    def rows_of(batches, counts):
        for batch in slices(batches, 4096):
            fps = _longs(batch)
            values = part_values(fps, groups)
            thresholds, candidates = allocate(values, counts, groups, radius)
            yield fps, values, thresholds, candidates > most_candidates + partitions

    def emit(key, side, fps):
        arrays = [pa.array(np.concatenate(x)) if x else pa.array([], t) for x, t in ((key, pa.int64()), (side, pa.int32()), (fps, pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["key", "side", "fp"])

    def signatures(batches):
        """side 0: entries of the index; side 1: probes; side 2: neighbourhood keys of crowded fingerprints."""
        counts = candidate_counts(histogram, groups, radius)
        near = np.array([sum(1 << b for b in c) for r in range((radius + 1) // 2 + 1) for c in combinations(range(BITS), r)], dtype=np.uint64)
        balls = [[ball(len(g), t) for t in range(radius + 1)] for g in groups]
        for fps, values, thresholds, crowded in rows_of(batches, counts):
            key, side, out = [], [], []

            def add(keys, of, which, key=key, side=side, out=out):
                key.append(keys.astype(np.int64, copy=False))
                side.append(np.full(len(keys), which, dtype=np.int32))
                out.append(of.view(np.int64))

            for k in range(partitions):
                own = histogram[k][values[:, k]]
                listed = own <= most_candidates + partitions
                add(values[listed, k] << 8 | k, fps[listed], 0)
                for t in range(radius + 1):
                    chosen = ~crowded & (thresholds[:, k] == t)
                    if chosen.any():
                        masks = balls[k][t]
                        probes = values[chosen, k][:, None] ^ masks
                        useful = histogram[k][probes] > (masks == 0)  # its own entry alone is no candidate
                        add((probes << 8 | k)[useful], np.repeat(fps[chosen][:, None], len(masks), axis=1)[useful], 1)
            if crowded.any():
                keys = fps[crowded][:, None] ^ near
                add(keys.ravel().view(np.int64), np.repeat(fps[crowded], len(near)), 2)
            yield emit(key, side, out)

    signed = cut_lineage(arrow_map(nodes.select("fp"), signatures, "key long, side int, fp long"))
    index = signed.where("side = 0").select(F.col("key").alias("at"), F.col("fp").alias("b"))
    probes = signed.where("side = 1").select("key", F.col("fp").alias("a"))
    close = (F.col("key") == F.col("at")) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    pairs = probes.join(index, close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # at most len(near) fingerprints lie within radius / 2 of a key
    met = signed.where("side = 2").groupBy("key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b")
    if radius % 2:
        stars = stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return pairs.unionByName(stars)


def _placed(docs: DataFrame, radius: int, size: int, partitions: int, most_candidates: int) -> tuple[DataFrame, DataFrame]:
    """Stored fingerprints of all rows, and of each distinct fingerprint ``fp`` the ``root`` of its component."""
    if radius % 2:
        raise ValueError("radius must be even")
    marked = cut_lineage(fingerprints(docs, size))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.count("*").alias("rows")))
    found = components(links(nodes.select("fp"), radius, partitions, most_candidates))
    placed = nodes.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("mark"), F.coalesce("root", "fp").alias("root"))
    return marked, cut_lineage(placed)  # stored: a join with it can be split where very many rows share a fingerprint


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, partitions: int = 4, most_candidates: int = 256) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``.

    ``fingerprint``: 16 lower-case hex digits. ``component_id``: the least
    ``doc_id`` that is reached over links of at most ``radius`` (even) bits, the
    row's own included. Null and empty texts have fingerprint 0 and are linked
    like any other. Repeated ids are kept, each row by its own text; a null id
    is never the least, and rows whose component has null ids alone get null.
    Other columns are ignored; an empty table gives no rows.
    """
    marked, placed = _placed(docs, radius, size, partitions, most_candidates)
    rooted = marked.groupBy("fp").agg(F.min("doc_id").alias("first")).join(placed, F.col("fp") == F.col("mark"))
    least = cut_lineage(rooted.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id")))
    ids = cut_lineage(placed.join(least, F.col("root") == F.col("of")).select("mark", "component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(ids, F.col("fp") == F.col("mark")).select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, size: int = 3, partitions: int = 4, most_candidates: int = 256) -> DataFrame:
    """Rows of ``docs``, all columns: of each component one row, that of the least ``doc_id`` (null last).

    Rows are judged one by one, also where ids repeat: of equal ids in one
    component the row with the least hash of its text stays, while the same id
    in another component isn't touched. Rows alike in both id and text are one
    row, and stay or go together.
    """
    marked, placed = _placed(docs, radius, size, partitions, most_candidates)
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "k1", "k2")
    first = marked.groupBy("fp").agg(F.min(rank).alias("first")).join(placed, F.col("fp") == F.col("mark"))
    stays = first.groupBy("root").agg(F.min("first").alias("first"))
    one = stored(stays.select(F.col("first.k1").alias("h1"), F.col("first.k2").alias("h2")))
    same = (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    gone = stored(marked.join(one, same, "left_anti").select(F.col("k1").alias("h1"), F.col("k2").alias("h2")).distinct())
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(id_, text))
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(gone.select("h1")))  # at most 16 MB

    def stay(batches):
        for batch in batches:
            yield batch.filter(pa.array(~listed_in(sieve.value, batch.column(1).to_numpy())))

    def move(batches):
        for batch in batches:
            yield batch.filter(pa.array(listed_in(sieve.value, batch.column(1).to_numpy())))

    # only rows that may go are shuffled, to meet those that do
    moved = arrow_map(rows, move, rows.schema).join(gone, same, "left_anti")
    return arrow_map(rows, stay, rows.schema).unionByName(moved).select("row.*")
