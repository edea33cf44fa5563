"""Byte-level BPE by a hierarchical-bitmap rank queue.

Each pre-token is a doubly linked list of parts. Every adjacent pair whose
joined bytes have a merge rank waits in that rank's bucket. A bitmap of
non-empty buckets, 64 to a word, under a bitmap of non-zero words gives the
lowest rank in two find-first-set steps whatever the number of pairs; entries whose pair
has changed since are skipped when they come up. A very long pre-token thus
costs O(n log n) in place of O(n^2).

Ranks come from a ``tiktoken`` rank file; no model is trained. Pre-tokens recur,
so workers memoise them in a bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.shared import PieceEncoder, arrow_map, held, pack_ids, slices, string_values


class ByteBpe:
    """Encoder and decoder over ranks ``{bytes: id}``; every single byte must have one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 600_000):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.words = {rank: token for token, rank in ranks.items()}
        self.pieces = PieceEncoder(self._split, self._whole, False, cache, self._core)

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token: always joins the pair of least rank, the leftmost first.

        ``buckets[rank]`` is a position, or a heap of them; ``words[rank >> 6]``
        has a bit for each non-empty bucket of 64 ranks and ``top`` a bit for
        each non-zero word. ``after`` and ``before`` link the parts; ``pair[at]``
        is the rank that the part at ``at`` and the next would make, which
        tells entries that are still valid from stale ones.
        """
        ranks = self.ranks
        if token in ranks:
            return [ranks[token]]
        n, find = len(token), ranks.get
        after, before, pair = [*range(1, n + 1)], [*range(-1, n - 1)], [-1] * n
        buckets: dict = {}
        words: dict[int, int] = {}
        top = 0
        waiting = [(rank, at) for at in range(n - 1) if (rank := find(token[at : at + 2])) is not None]
        while True:
            for rank, at in waiting:
                pair[at] = rank
                held = buckets.get(rank)
                if held is None:
                    buckets[rank] = at
                    word = rank >> 6
                    words[word] = words.get(word, 0) | 1 << (rank & 63)
                    top |= 1 << word
                elif held.__class__ is int:
                    buckets[rank] = [held, at] if held < at else [at, held]
                else:
                    heapq.heappush(held, at)
            if not top:
                break
            word = (top & -top).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word << 6 | low.bit_length() - 1
            held = buckets[rank]
            at = held if held.__class__ is int else heapq.heappop(held)
            if at is held or not held:
                del buckets[rank]
                words[word] = bits = bits ^ low
                if not bits:
                    top ^= 1 << word
            waiting = []
            if pair[at] != rank:
                continue
            gone = after[at]
            end = after[at] = after[gone]
            pair[gone] = pair[at] = -1
            if end < n:
                before[end] = at
                rank = find(token[at : after[end]])
                if rank is not None:
                    waiting.append((rank, at))
            left = before[at]
            if left >= 0:
                rank = find(token[left:end])
                if rank is None:
                    pair[left] = -1
                else:
                    waiting.append((rank, left))
        out, at = [], 0
        while at < n:
            end = after[at]
            out.append(ranks[token[at:end]])
            at = end
        return out

    def _core(self, text: str) -> bytes:
        return pack_ids(self.merge(text.encode()))

    def _split(self, text: str) -> bytes:
        return pack_ids([i for token in self.pattern.findall(text) for i in self.merge(token.encode())])

    def _whole(self, text: str) -> bytes:
        cores, limit = self.pieces.cores, 64
        return b"".join([cores[t] if len(t) <= limit else self._core(t) for t in self.pattern.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.pieces.encode(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def worker_bpe(ranks_path: str, pattern: str) -> ByteBpe:
    return held((ranks_path, pattern), lambda: ByteBpe(load_ranks(ranks_path), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: whole texts encoded without special tokens.

    Null and empty texts have no ids. Null and repeated document ids are kept,
    other columns ignored; an empty table gives no rows.
    """

    def encode(batches):
        bpe = worker_bpe(ranks_path, pattern)
        for batch in slices(batches):
            chunks = [bpe.encode(text) for text in string_values(batch.column(1))]
            bounds = np.concatenate(([0], np.cumsum([len(c) // 4 for c in chunks]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(chunks), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return arrow_map(_rows(docs), encode, "doc_id long, ids array<int>", encodes=True)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` of ``encoded(doc_id, ids)``; null ids decode to nothing."""

    def decode(batches):
        bpe = worker_bpe(ranks_path, pattern)
        for batch in slices(batches):
            texts = [bpe.decode(np.array(ids or [], dtype="<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return arrow_map(encoded.select("doc_id", "ids"), decode, "doc_id long, bytes binary", encodes=True)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes and decodes each text in one pass; rows as in ``encode_documents``."""

    def digest(batches):
        bpe = worker_bpe(ranks_path, pattern)
        for batch in slices(batches):
            counts, of_ids, of_text = [], [], []
            for text in string_values(batch.column(1)):
                ids = bpe.encode(text)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return arrow_map(_rows(docs), digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", encodes=True)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
