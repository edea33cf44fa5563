"""Helpers that the operators of this subpackage share.

Words everywhere are maximal runs of code points other than U+0020 and
U+0009-U+000D, which is exactly what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

import ctypes
import re
import struct
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is made only where none is configured and the master is local."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="ebbflow-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once, stored in the shared folder and reread from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path in this application's part of the shared folder; ``clear_scratch`` deletes that part."""
    return f"{_own_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/ebbflow-{spark.sparkContext.applicationId}"


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the tables that this application's operators stored. Results not yet read are lost with them."""
    remove_folder(spark, _own_folder(spark))


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as zstd Parquet in the shared folder, or one in it: what ``cut_lineage`` does, at a fraction of its disk for large tables."""
    spark = df.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}" if folder else scratch(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_: Column, text: Column) -> list[Column]:
    """``k1, k2``: 128 bits over a row's id, which may be null, and its text. Rows that are alike in both share it."""
    parts = (id_, id_.isNull(), F.coalesce(text, F.lit("")))
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *reversed(parts)).alias("k2")]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string or binary column; null becomes empty."""
    return [b"" if value is None else value for value in column.cast(pa.large_binary()).to_pylist()]


def string_values(column: pa.Array) -> list[str]:
    return ["" if value is None else value for value in column.to_pylist()]


def slices(batches, rows: int = 512, most_bytes: int = 1 << 21):
    """Arrow batches cut into pieces of at most ``rows`` rows and, where there is more than one, ``most_bytes``: a task holds little at a time."""
    for batch in batches:
        waiting = [batch.slice(start, rows) for start in range(0, batch.num_rows, rows)][::-1]
        while waiting:
            piece = waiting.pop()
            if piece.num_rows > 1 and piece.nbytes > most_bytes:
                half = piece.num_rows // 2
                waiting += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


#: What a Python worker keeps between tasks: one encoder at a time.
_HELD: dict = {}
#: Bytes of an Arrow batch between the JVM and a worker; Spark's own limit is larger.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def held(key, make: Callable):
    """``make()``, kept while this worker is asked for nothing else."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _let_go() -> None:
    """Drops what the worker keeps and gives freed memory back to the machine."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, work: Callable, schema, encodes: bool = False) -> DataFrame:
    """``df.mapInArrow(work, schema)`` with batches of bounded bytes.

    Spark takes the bound from the session when the plan runs, which may be long
    after this call; so the session gets it, unless it has a smaller one.
    Workers live on between tasks; unless this work ``encodes``, what an
    encoder kept is dropped before and after.
    """
    conf = df.sparkSession.conf
    current = conf.get(_BATCH_SETTING, None)
    if current is None or not current.isdigit() or not 0 < int(current) <= BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def run(batches):
        # called by name: this function travels by value, with copies of what it refers to
        if not encodes:
            _let_go()
        yield from work(batches)
        if not encodes:
            _let_go()

    return df.mapInArrow(run, schema)


BITMAP_BITS = 27


def sieve_of(hashes: DataFrame) -> np.ndarray:
    """Bitmap, by the upper bits, of the one column of ``hashes``: at most 2**27 bits, whatever the number of rows."""
    h = F.col(hashes.columns[0])
    cell = F.shiftrightunsigned(h, 64 - BITMAP_BITS)
    rows = (
        hashes.groupBy(F.shiftright(cell, 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(63).cast("int"))).alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint64)


def listed_in(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return (sieve[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)


class BoundedCache(dict):
    """A dict that computes what it lacks and is emptied when it reaches ``limit`` entries. Keys of over ``longest`` signs aren't kept."""

    def __init__(self, make: Callable, limit: int, longest: int):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) > self.longest:
            return value
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


_MARKS = ".,!?;:*$%&#"
_CORE = re.compile(rf"([^\W\d_]+)([{_MARKS}]*)")
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


class PieceEncoder:
    """Encodes whole texts by memoising what lies between spaces.

    ``encode_piece(str) -> bytes`` must return little-endian uint32 ids of any
    string, and splitting at a piece border must not change the ids of the
    whole. Two rules make that so:

    * ``drops_space``: the tokenizer discards white space, so any split at
      white space is a border;
    * otherwise the pattern splits text into ``␠letters``, ``␠digits``,
      ``␠symbols`` and runs of white space. A single space or newline between
      two characters that aren't white space always starts a new match. Texts
      with other white space go to ``encode_text`` whole.

    ``encode_core`` is a faster ``encode_piece`` for one run of letters, led
    by a space or not, or one run of symbols. Memory is bounded: both caches are emptied at ``limit`` entries, and long
    keys are not kept.
    """

    def __init__(self, encode_piece: Callable[[str], bytes], encode_text: Callable[[str], bytes], drops_space: bool, limit: int = 300_000, encode_core: Callable[[str], bytes] | None = None):
        self.encode_piece, self.encode_text, self.drops_space = encode_piece, encode_text, drops_space
        self.words = BoundedCache(self._word, limit, 80)
        self.cores = BoundedCache(encode_core or encode_piece, limit + limit // 2, 64)

    def _core(self, text: str) -> bytes:
        return self.cores[text]

    def _word(self, key: str) -> bytes:
        """``key``: a word; for patterns that keep white space, led by a newline, by NUL (text start) or by nothing (a space)."""
        lead, word = "", key
        if not self.drops_space:
            if key[0] == "\n":
                lead, word = "\n", key[1:]
            elif key[0] == "\0":
                word = key[1:]
            else:
                lead = " "
        if word.isascii():
            core = word.rstrip(_MARKS)
            if not core.isalpha():
                return self.encode_piece(lead + word)
            tail = word[len(core) :]
        else:
            match = _CORE.fullmatch(word)
            if match is None or not match[1].isalpha():
                return self.encode_piece(lead + word)
            core, tail = match.groups()
            if tail and max(core) >= "\u0130":
                # its normal form or lower case may end in a mark that belongs to the next match, as that of U+0130 does
                return self.encode_piece(lead + word)
        if self.drops_space:
            out = self._core(core.lower() if core.isascii() or max(core) < "\u0130" else core)
        elif lead == "\n":
            out = self._core("\n") + self._core(core)
        else:
            out = self._core(lead + core)
        return out + self._core(tail) if tail else out

    def _ids(self, keys: list[str]) -> bytes:
        return b"".join(map(self.words.__getitem__, keys))

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids of a whole text."""
        words = text.split()
        if not words:
            return self.encode_text(text) if text else b""
        if self.drops_space:
            if any(mark in text for mark in _SEPARATORS):
                return self.encode_text(text)
            return self._ids(words)
        if "\0" in text or " ".join(words) != text.replace("\n", " "):
            return self.encode_text(text)
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\0" + keys[0]
        return self._ids(keys)


def library_encoder(path: str, drops_space: bool, limit: int = 600_000) -> PieceEncoder:
    """A :class:`PieceEncoder` over a ``tokenizers`` JSON file, without special tokens added."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    merge, table = tokenizer.model.tokenize, _byte_letters()

    def encode(text: str) -> bytes:
        return pack_ids(tokenizer.encode(text, add_special_tokens=False).ids)

    def encode_core(text: str) -> bytes:
        """One match of the splitting pattern. Up to U+012F its letters are in normal form and have one lower-case letter each."""
        ascii_only = text.isascii()
        if not ascii_only and max(text) >= "\u0130":
            return encode(text)
        if drops_space:
            text = text.lower()
        plain = ascii_only and text.isprintable() and " " not in text  # these bytes are written as themselves
        letters = text if plain else text.encode().decode("latin-1").translate(table)
        return pack_ids([token.id for token in merge(letters)])

    return PieceEncoder(encode, encode, drops_space, limit, encode_core)


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> dict[int, int]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in plain else next(others) for b in range(256)}


def worker_encoder(path: str, drops_space: bool, limit: int = 600_000) -> PieceEncoder:
    """One encoder for each Python worker, kept while it is the one in use."""
    return held((path, drops_space, limit), lambda: library_encoder(path, drops_space, limit))


def xxh64(seed: int = 42) -> Callable[[bytes], int]:
    import functools

    import xxhash

    return functools.partial(xxhash.xxh64_intdigest, seed=seed) if seed else xxhash.xxh64_intdigest


def mix64(values: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


__all__ = [
    "BITMAP_BITS", "WORD_PATTERN", "BoundedCache", "PieceEncoder", "arrow_map", "binary_values", "clear_scratch", "cut_lineage", "ensure_checkpoint_dir", "held",
    "library_encoder", "listed_in", "mix64", "pack_ids", "remove_folder", "row_key", "scratch", "shuffle_width", "sieve_of", "slices", "stored", "string_values", "worker_encoder", "xxh64",
]
