"""Removal of repeated word windows through a log-structured fingerprint index.

The index is a folder of immutable runs. A batch's window fingerprints become
one run: each fingerprint once, with its count, dealt into buckets and sorted
within them. The run is merge-joined, bucket by bucket and without a shuffle,
with each earlier run; what both hold, and what the batch holds twice, recurs.
Matches are verified, and runs are compacted when there are many, so a corpus
is deduplicated batch by batch. A manifest, written last, says what belongs to
the index: a batch that failed half-way is not part of it, and a folder is
taken up where its last manifest left it. Runs that compaction replaced are
deleted once the manifest no longer names them.

A run needn't hold every window of K words. Of each window the least hash among
its G-word parts is kept ("winnowing"). Equal windows keep equal parts, so a
window that occurs elsewhere always holds a part that occurs elsewhere, and
about 2 of K - G + 2 parts suffice. Where a part lies is kept beside the runs,
with a hash of its context: all words of the windows around it. Then

1. parts whose hash and context both occur elsewhere mark all windows around
   them as repeated (the inside of long repeated passages);
2. for parts that recur in another context (the borders of passages) the
   windows around them are hashed one by one, in a second pass over the texts.

Both compare 128 bits (two independent hashes of all the words concerned), not
the words themselves: unequal windows are held equal with a chance of about
2**-128 a pair. Rows are told apart by 128 bits over id and text.

Shuffles carry fingerprints and positions. Bitmaps of at most 2**27 bits keep
most of what occurs once out of them, and texts move only where repeats were
found. A bitmap is a first sieve before an exact join: when it fills up, as it
must when far more than 10**8 fingerprints recur, it is left out, and the border
pass gets its parts by a join instead. Hot fingerprints are counted before the
shuffle and joined by plain equality with stored tables, which Spark may split.
"""

from __future__ import annotations

import hashlib
import json
import operator
import uuid
from contextlib import contextmanager
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.llm.shared import BITMAP_BITS, WORD_PATTERN, arrow_map, binary_values, listed_in, mix64, remove_folder, row_key, scratch, shuffle_width, sieve_of, slices, stored, xxh64

#: A sieve that holds more than this share of its bits lets too much through.
FULL = 0.25
POSITION_SCHEMA = "part long, context long, k1 long, k2 long, at int"
RUN_SCHEMA = "part long, n long"


class Rolling:
    """Hashes of any stretch of a sequence of word hashes, by prefix sums of a polynomial modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: np.ndarray, base: int):
        n = len(words) + 1
        held = self._powers.get(base)
        if held is None or len(held[0]) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                held = tuple(
                    np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, b, dtype=np.uint64)))) for b in (base, pow(base, -1, 1 << 64))
                )
            self._powers[base] = held
        self.inverse = held[1]
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * held[0][: n - 1])))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.inverse[start])


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Windows:
    """The words of some texts one after another, and their winnowed parts."""

    def __init__(self, texts: list[bytes], window: int, part: int):
        words = [text.split() for text in texts]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        hashes = np.fromiter(map(xxh64(7), chain.from_iterable(words)), dtype=np.uint64, count=int(sizes.sum()))
        self.first, self.second = Rolling(hashes, _BASES[0]), Rolling(hashes, _BASES[1])
        self.window, self.width = window, window - part + 1
        n = np.maximum(sizes - window + 1, 0)
        row = np.repeat(np.arange(len(texts)), n)
        begins = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.starts[row]
        if len(begins):
            grams = np.arange(len(hashes) - part + 1)
            values = self.first.hash(grams, grams + part)
            least = begins + np.lib.stride_tricks.sliding_window_view(values, self.width)[begins].argmin(axis=1)
            new = np.concatenate(([True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])))
            self.at, self.row = least[new], row[new]
            self.part = values[self.at]
        else:
            self.at = self.row = np.zeros(0, np.int64)
            self.part = np.zeros(0, np.uint64)
        #: the windows that hold each part, by first word
        self.low = np.maximum(self.at - self.width + 1, self.starts[self.row])
        self.high = np.minimum(self.at, self.ends[self.row] - window)

    def context(self) -> np.ndarray:
        """Of each part: a hash of the words of all windows that hold it and of where it lies in them."""
        end = self.high + self.window
        shape = ((self.at - self.low) * 4096 + (end - self.at)).astype(np.uint64)
        return mix64(self.second.hash(self.low, end) ^ mix64(shape + np.uint64(1)))


def _keyed(docs: DataFrame) -> DataFrame:
    """``k1, k2, text``: rows with the same id and text share a key, and their result; others don't."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*row_key(F.col("doc_id").cast("long"), text), text.alias("text"))


def _take(column: pa.Array, rows: np.ndarray) -> pa.Array:
    return column.take(pa.array(rows))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


@contextmanager
def _file_order_trusted(spark: SparkSession):
    """Scans of a bucket that is one sorted file count as sorted, so a merge join needs no sort. For plans that run inside alone."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class FingerprintIndex:
    """Runs of winnowed window fingerprints in a folder that all machines share.

    ``runs``: names of sorted runs; ``positions``: where each batch's parts
    lie; ``repeats``: for each batch the parts found to recur when it came. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = 35, part: int = 14, most_runs: int = 4):
        if not 1 <= part <= window:
            raise ValueError("part must lie in 1..window")
        self.spark, self.path, self.window, self.part, self.most_runs = spark, path, window, part, most_runs
        self.version, held = self._manifest()
        if held and (held["window"], held["part"]) != (window, part):
            raise ValueError(f"{path} holds windows of {held['window']} words and parts of {held['part']}")
        self.buckets: int = held.get("buckets", shuffle_width(spark))
        self.runs: list[str] = held.get("runs", [])
        self.positions: list[str] = held.get("positions", [])
        self.repeats: list[str] = held.get("repeats", [])

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict]:
        """The latest manifest's number and content; 0 and nothing where there is none."""
        jvm, folder, files = self._files()
        names = [entry.getPath().getName() for entry in files.listStatus(folder)] if files.exists(folder) else []
        version = max((int(name[9:]) for name in names if name.startswith("manifest-")), default=0)
        if not version:
            return 0, {}
        stream = files.open(jvm.org.apache.hadoop.fs.Path(folder, f"manifest-{version}"))
        try:
            return version, json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self) -> None:
        """Writes the next manifest under another name and renames it, so readers see it whole or not at all."""
        jvm, folder, files = self._files()
        content = {k: getattr(self, k) for k in ("window", "part", "buckets", "runs", "positions", "repeats")}
        draft, final = (jvm.org.apache.hadoop.fs.Path(folder, name) for name in (f"draft-{uuid.uuid4().hex}", f"manifest-{self.version + 1}"))
        stream = files.create(draft)
        try:
            stream.write(json.dumps(content).encode())
        finally:
            stream.close()
        if not files.rename(draft, final):
            raise RuntimeError(f"another writer committed to {self.path}")
        self.version += 1

    def _write_run(self, keys: DataFrame) -> str:
        """One sorted file for each bucket of ``keys(part, n)``, whose parts are distinct."""
        name = f"run_{uuid.uuid4().hex}"
        # the exchange of the aggregation that made the keys deals them already, if it has as many partitions
        dealt = keys if self.buckets == shuffle_width(self.spark) else keys.repartition(self.buckets, "part")
        writer = dealt.write.bucketBy(self.buckets, "part").sortBy("part").option("compression", "zstd").option("path", f"{self.path}/{name}")
        writer.format("parquet").saveAsTable(f"ebbflow_{name}")
        return name

    def run(self, name: str) -> DataFrame:
        """``part, n`` of a run, known to Spark as bucketed and sorted."""
        place = f"{self.path}/{name}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS ebbflow_{name} (part BIGINT, n BIGINT) USING parquet CLUSTERED BY (part) SORTED BY (part) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        return self.spark.table(f"ebbflow_{name}")

    def _forget(self, name: str) -> None:
        """Takes the run out of Spark's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS ebbflow_{name}")

    def recurring(self, name: str) -> DataFrame:
        """Parts of the run ``name`` that occur twice in it, or in an earlier run as well: one merge join for each earlier run."""
        new = self.run(name)
        met = [new.hint("merge").join(self.run(old).select("part"), "part", "left_semi").select("part") for old in self.runs if old != name]
        return reduce(DataFrame.unionByName, met, new.where("n > 1").select("part"))

    def add(self, docs: DataFrame) -> str:
        """Makes ``docs(doc_id, text)`` one more run; compacts when there are more than ``most_runs``. The name of the batch's repeats."""
        window, part = self.window, self.part

        def fingerprints(batches):
            for batch in slices(batches, 256):
                found = Windows(binary_values(batch.column(2)), window, part)
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(found.part), _signed(found.context()), _take(batch.column(0), found.row), _take(batch.column(1), found.row),
                        pa.array((found.at - found.starts[found.row]).astype(np.int32)),
                    ],
                    ["part", "context", "k1", "k2", "at"],
                )

        at, repeats = f"positions_{uuid.uuid4().hex}", f"repeats_{uuid.uuid4().hex}"
        arrow_map(_keyed(docs), fingerprints, POSITION_SCHEMA).write.option("compression", "zstd").parquet(f"{self.path}/{at}")
        run = self._write_run(self._read(POSITION_SCHEMA, [at]).groupBy("part").agg(F.count("*").alias("n")))
        with _file_order_trusted(self.spark):
            self.recurring(run).distinct().write.option("compression", "zstd").parquet(f"{self.path}/{repeats}")
        for name in [*self.runs, run]:
            self._forget(name)
        self.runs, self.positions, self.repeats = [*self.runs, run], [*self.positions, at], [*self.repeats, repeats]
        self._commit()
        if len(self.runs) > self.most_runs:
            self.compact()
        return repeats

    def compact(self) -> None:
        """Merges all runs into one; the others are deleted once the manifest doesn't name them."""
        old = self.runs
        keys = reduce(DataFrame.unionByName, [self.run(name) for name in old])
        self.runs = [self._write_run(keys.groupBy("part").agg(F.sum("n").alias("n")))]
        for name in [*old, *self.runs]:
            self._forget(name)
        self._commit()
        for name in old:
            remove_folder(self.spark, f"{self.path}/{name}")

    def _read(self, schema: str, names: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}" for name in names])

    def entries(self) -> DataFrame:
        """Where parts lie: ``part, context, k1, k2, at``."""
        return self._read(POSITION_SCHEMA, self.positions) if self.positions else self.spark.createDataFrame([], POSITION_SCHEMA)

    def repeated_parts(self, batches: list[str] | None = None) -> DataFrame:
        """``part``: distinct parts that were found to recur when the named batches came, or any."""
        names = self.repeats if batches is None else batches
        return self._read("part long", names).distinct() if names else self.spark.createDataFrame([], "part long")


def _full(sieve: np.ndarray) -> bool:
    return int(np.bitwise_count(sieve).sum()) > FULL * (1 << BITMAP_BITS)


def _equal(*pairs: tuple[str, str]):
    return reduce(operator.and_, [F.col(a) == F.col(b) for a, b in pairs])


WINDOW_SCHEMA = "w long, v long, k1 long, k2 long, at int"


def _border_windows(texts: DataFrame, hits: DataFrame, alone: DataFrame, window: int, part: int, folder: str) -> DataFrame:
    """Hashes of the windows of ``texts(k1, k2, text)`` around the parts in ``alone``, and perhaps of some others."""
    sieve = sieve_of(alone)
    exact = _full(sieve)
    listed = None if exact else texts.sparkSession.sparkContext.broadcast(sieve)

    def around(batches):
        for batch in slices(batches, 256):
            found = Windows(binary_values(batch.column(2)), window, part)
            if exact:
                parts = batch.column(3)
                mine = [np.asarray(parts[k].values, dtype=np.int64) for k in range(batch.num_rows)]
                ends = np.searchsorted(found.row, np.arange(batch.num_rows + 1))
                some = [np.flatnonzero(np.isin(found.part[a:b].view(np.int64), m)) + a for a, b, m in zip(ends[:-1], ends[1:], mine, strict=True)]
                hit = np.concatenate(some) if some else np.zeros(0, np.int64)
            else:
                hit = np.flatnonzero(listed_in(listed.value, found.part))
            n = found.high[hit] - found.low[hit] + 1
            row = np.repeat(found.row[hit], n)
            begins = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(found.low[hit], n)
            begins, first = np.unique(begins, return_index=True)
            row = row[first]
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(found.first.hash(begins, begins + window)), _signed(found.second.hash(begins, begins + window)),
                    _take(batch.column(0), row), _take(batch.column(1), row), pa.array((begins - found.starts[row]).astype(np.int32)),
                ],
                ["w", "v", "k1", "k2", "at"],
            )

    if exact:  # a document's own border parts go to its text
        near = hits.join(alone.select(F.col("part").alias("p")), _equal(("part", "p")), "left_semi")
        own = stored(near.groupBy(F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(F.collect_set("part").alias("parts")), folder)
        texts = texts.join(own, _equal(("k1", "h1"), ("k2", "h2"))).select("k1", "k2", "text", "parts")
    return arrow_map(texts, around, WINDOW_SCHEMA)


def repeated_positions(index: FingerprintIndex, docs: DataFrame, folder: str, history: DataFrame | None = None, batches: list[str] | None = None) -> DataFrame:
    """``k1, k2, marks``: for each text with repeats a list of ``2 * position + kind``.

    Kind 0: all windows around the part at that word are repeated; kind 1: the
    window that starts there is. ``docs`` and ``history`` must hold every
    document of the index. Only what the named ``batches`` found to recur is
    looked at (all, if None); of ``history`` only documents that hold the border
    of such a repeat are worked on. The result reads tables in ``folder``.
    """
    window, part, spark = index.window, index.part, index.spark
    often = stored(index.repeated_parts(batches), folder)
    sieve = sieve_of(often)
    entries = index.entries()
    if not _full(sieve):
        recurs = spark.sparkContext.broadcast(sieve)  # at most 16 MB, like the others

        def recurring(rows):
            for batch in rows:
                yield batch.filter(pa.array(listed_in(recurs.value, batch.column(0).to_numpy())))

        # nearly all parts that occur once stay out of the shuffles; the joins below are exact
        entries = stored(arrow_map(entries, recurring, POSITION_SCHEMA), folder)
    hits = entries
    counted = stored(hits.groupBy("part", "context").agg(F.count("*").alias("n")), folder)
    inside = counted.where("n > 1").select(F.col("part").alias("p"), F.col("context").alias("c"))
    whole = hits.join(inside, _equal(("part", "p"), ("context", "c")), "left_semi").select("k1", "k2", (F.col("at") * 2).alias("mark"))
    alone = stored(counted.where("n = 1").select("part").distinct().join(often.select(F.col("part").alias("p")), _equal(("part", "p")), "left_semi"), folder)
    texts = _keyed(docs)
    if history is not None:
        near = hits.join(alone.select(F.col("part").alias("p")), _equal(("part", "p")), "left_semi")
        own = stored(near.select(F.col("k1").alias("h1"), F.col("k2").alias("h2")).distinct(), folder)
        texts = texts.unionByName(_keyed(history).join(own, _equal(("k1", "h1"), ("k2", "h2")), "left_semi"))
    single = stored(_border_windows(texts, hits, alone, window, part, folder), folder)
    # stored: Spark splits a skewed join only where both sides are plain exchanges
    twice = stored(single.groupBy(F.col("w").alias("w2"), F.col("v").alias("v2")).agg(F.count("*").alias("n")).where("n > 1").select("w2", "v2"), folder)
    same = single.join(twice, _equal(("w", "w2"), ("v", "v2")), "left_semi").select("k1", "k2", (F.col("at") * 2 + 1).alias("mark"))
    return whole.unionByName(same).groupBy("k1", "k2").agg(F.collect_set("mark").alias("marks"))


def _kept(text: bytes, marks, window: int, part: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many don't."""
    words = text.split()
    n = len(words)
    if marks is None or n < window:
        return words, 0
    marks = np.asarray(marks, dtype=np.int64)
    at, whole = marks >> 1, (marks & 1) == 0
    low = np.where(whole, np.maximum(at - (window - part), 0), at)
    high = np.where(whole, np.minimum(at, n - window), at) + window
    delta = np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)
    gone = np.cumsum(delta[:n]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def _matched(docs: DataFrame, index: FingerprintIndex | None, history: DataFrame | None, window: int, part: int, batches: int) -> DataFrame:
    """``h1, h2, marks`` of the documents that have repeats."""
    spark = docs.sparkSession
    own, folder = index is None, scratch(spark, "matching")
    if own:
        index = FingerprintIndex(spark, f"{folder}/index", window, part)
    rows = docs.select("doc_id", "text")
    # every row belongs to one batch, by a hash of id and text
    batch = F.pmod(row_key(F.col("doc_id").cast("long"), F.col("text").cast("string"))[0], F.lit(batches))
    found = [index.add(rows.where(batch == number)) for number in range(batches)]
    marks = repeated_positions(index, rows, folder, None if history is None else history.select("doc_id", "text"), None if own else found)
    out = stored(marks.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), "marks"))
    remove_folder(spark, folder)
    return out


def _cut(rows: DataFrame, marks: DataFrame, work, schema: T.StructType | str) -> DataFrame:
    """``work(batches)`` over the columns of ``rows(k1, k2, ...)`` but these two, and ``marks``.

    A bitmap tells which documents may have marks. The others are worked on
    where they are read; only these move, to meet their marks.
    """
    sieve = rows.sparkSession.sparkContext.broadcast(sieve_of(marks.select("h1")))
    kept = [c for c in rows.columns if c not in ("k1", "k2")]
    keyed = rows.select(*kept, "k1", "k2")
    none = pa.list_(pa.int32())

    def stay(batches):
        def free():
            for batch in batches:
                left = batch.filter(pa.array(~listed_in(sieve.value, batch.column(len(kept)).to_numpy())))
                columns = [left.column(k) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(left.num_rows, none)], [*kept, "marks"])

        yield from work(free())

    def move(batches):
        for batch in batches:
            yield batch.filter(pa.array(listed_in(sieve.value, batch.column(len(kept)).to_numpy())))

    moved = arrow_map(keyed, move, keyed.schema)
    met = moved.join(marks, _equal(("k1", "h1"), ("k2", "h2")), "left").select(*kept, "marks")
    return arrow_map(keyed, stay, schema).unionByName(arrow_map(met, work, schema))


def repeat_digests(
    docs: DataFrame, index: FingerprintIndex | None = None, history: DataFrame | None = None, window: int = 35, part: int = 14, batches: int = 2
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs(doc_id, text)``.

    A word goes if a window of ``window`` words that covers it also starts
    anywhere else, in ``docs`` or in what ``index`` holds. Windows are judged
    on the input. ``docs`` is dealt into ``batches`` that go into the index one
    after another, each merge-joined with the runs before it. With an index that
    has runs, ``history`` must hold their documents. Null and empty texts
    have no words. Null and repeated ids are kept, and two rows that repeat one
    another are each other's copies. Other columns are ignored; an empty table
    gives no rows.
    """
    marks = _matched(docs, index, history, window, part, batches)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(id_.alias("doc_id"), text.alias("text"), *row_key(id_, text))

    def digest(batches):
        for batch in slices(batches, 1024):
            out = []
            for body, found in zip(binary_values(batch.column(1)), batch.column(2), strict=True):
                kept, gone = _kept(body, found.values if found.is_valid else None, window, part)
                out.append((len(kept) + gone, gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return _cut(rows, marks, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(
    docs: DataFrame, index: FingerprintIndex | None = None, history: DataFrame | None = None, window: int = 35, part: int = 14, batches: int = 2
) -> DataFrame:
    """``docs``, all columns, with repeated windows cut out of ``text`` as in ``repeat_digests``.

    Texts that lose words have the others joined by single spaces, and
    ``n_chars``, if there, is their new length; other texts stay as they are.
    All rows stay, also those that lose every word.
    """
    marks = _matched(docs, index, history, window, part, batches)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(id_, text))

    def clean(batches):
        for batch in slices(batches, 1024):
            bodies = batch.column(0).field("text") if batch.num_rows else pa.array([], pa.string())
            out = []
            for body, found in zip(binary_values(bodies), batch.column(1), strict=True):
                kept, gone = _kept(body, found.values if found.is_valid else None, window, part)
                out.append(b" ".join(kept).decode() if gone else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "cut"])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("cut", T.StringType())])
    cut = _cut(rows, marks, clean, schema)
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    named = dict(zip(docs.columns, columns, strict=True))
    named["text"] = F.coalesce("cut", "row.text").alias("text")
    if "n_chars" in named:
        named["n_chars"] = F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.length("cut")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cut.select(*named.values())


def digests_sql(table: str, window: int) -> str:
    """What ``repeat_digests`` returns for a table whose ids are distinct, in DuckDB's SQL: every window spelled out."""
    return f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS words FROM {table}),
starts AS (SELECT doc_id, unnest(range(1, len(words) - {window - 2})) AS place, words FROM texts WHERE len(words) >= {window}),
windows AS (SELECT doc_id, place, array_to_string(words[place:place + {window - 1}], ' ') AS said FROM starts),
repeated AS (SELECT doc_id, place FROM windows WHERE said IN (SELECT said FROM windows GROUP BY said HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(place, place + {window})) AS place FROM repeated),
spread AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts),
kept AS (
    SELECT doc_id, count(g.place) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY s.place) FILTER (WHERE g.place IS NULL), '') AS said
    FROM spread AS s LEFT JOIN gone AS g USING (doc_id, place) GROUP BY doc_id
)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM texts AS t LEFT JOIN kept USING (doc_id)"""
