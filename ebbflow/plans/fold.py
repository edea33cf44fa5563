"""The ordered fold: one owner for each key, rows in order, bounded memory.

Rows are dealt by key and sorted within partitions, which spills to disk; the
fold streams through them in Arrow batches and holds one state and one batch,
never a whole key. A state to start from travels as a row of its own that sorts
before the key's other rows, so no join is needed.

A fold without a key is one task by nature. What makes it parallel is a key,
the members of an ensemble, or the parts of a bounded window
(:func:`ebbflow.plans.windows.halo_blocks`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ebbflow.functions.ddl import columns as ddl_columns
from ebbflow.functions.expressions import vector
from ebbflow.plans.layout import Layout, Names, names
from ebbflow.plans.ops import ColumnOps, as_column
from ebbflow.plans.placement import measure

#: A key may be folded inside one row (``native``) up to so many rows.
NATIVE_ROWS = 50_000


class Fold(Protocol):
    """A sequential operator. States are Python objects; ``dump`` and ``load`` turn them into rows of ``state_ddl``."""

    state_ddl: str
    output_ddl: str
    #: Rows of a key that ``run`` gets at a time, counted from the key's first; 0: as they come.
    chunk: int

    def initial(self) -> Any: ...

    def run(self, state: Any, x: np.ndarray, y: np.ndarray, emit: bool) -> dict[str, Any]:
        """Learns rows in order, changing ``state``. With ``emit``, what ``output_ddl`` names, a value for each row."""

    def apply(self, state: Any, x: np.ndarray) -> dict[str, Any]:
        """Predictions for rows, without learning."""

    def dump(self, state: Any) -> dict: ...

    def load(self, row: dict) -> Any: ...


def struct_of(ddl: str) -> T.StructType:
    return ddl_columns(ddl)


def _changes(columns: list[pa.Array], n: int) -> np.ndarray:
    """True where a row's key differs from the row before; nulls are equal to each other."""
    out = np.zeros(n, dtype=bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        out[1:] |= differ | nulls
    return out


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow list column as rows of ``d`` doubles; nulls are NaN."""
    if len(column) == 0:
        return np.zeros((0, d))
    return np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)


def _cuts(change: np.ndarray, kinds: np.ndarray, chunk: int) -> np.ndarray:
    """Where keys begin in a batch, and every ``chunk`` rows after that; states to start from don't count."""
    begins = np.flatnonzero(change | (np.arange(len(change)) == 0))
    cuts = [begins]
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(change)], strict=True):
        if b - a > chunk:
            first = a + int(np.argmax(kinds[a:b] != 0))
            cuts.append(np.arange(first + chunk, b, chunk))
    return np.sort(np.concatenate(cuts))


def aligned(batches: Iterable[pa.RecordBatch], n_keys: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a key ends or has had a multiple of ``chunk`` rows, so what is learned at once does not depend on the layout."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < chunk:
            continue
        whole = pa.concat_batches(held)
        change = _changes([whole.column(k) for k in range(n_keys)], whole.num_rows)
        kinds = whole.column(n_keys).to_numpy()
        cut = int(_cuts(change, kinds, chunk)[-1])
        if np.count_nonzero(kinds[cut:]) >= chunk:
            cut = whole.num_rows
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)] if cut < whole.num_rows else []
    if held:
        yield pa.concat_batches(held)


def _full(values, valid: np.ndarray):
    """Outputs of the valid rows, spread over all rows with nulls."""
    if valid.all():
        return list(values) if not isinstance(values, np.ndarray) else values
    out: list = [None] * len(valid)
    for at, value in zip(np.flatnonzero(valid).tolist(), values, strict=True):
        out[at] = value.item() if isinstance(value, np.generic) else value
    return out


def fold_batches(batches: Iterable[pa.RecordBatch], op: Fold, d: int, n_keys: int, mode: str, spare: bool, out_schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Columns: keys, ``__kind``, ``__row``, ``__x``, ``__y`` and, with ``spare``, ``__spare``, then, with states to start from, ``__state``.

    ``mode``: ``fit`` emits a state for each key, ``run`` outputs for each row,
    ``apply`` predictions. Spare rows are learned and leave no output.
    """
    outputs = struct_of(op.output_ddl)
    types = [to_arrow_type(f.dataType) for f in out_schema.fields]
    key, state, open_ = None, None, False

    def closed():
        dumped = op.dump(state)
        row = [*key, *[dumped[f.name] for f in struct_of(op.state_ddl).fields]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], out_schema.fieldNames())

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(k) for k in range(n_keys)]
        first_key = [k[0].as_py() for k in keys]
        change = _changes(keys, n)
        change[0] = not open_ or first_key != key
        kinds = batch.column(n_keys).to_numpy()
        starts = _cuts(change, kinds, op.chunk) if op.chunk else np.flatnonzero(change | (np.arange(n) == 0))
        x, y = matrix(batch.column(n_keys + 2), d), batch.column(n_keys + 3).to_numpy(zero_copy_only=False).astype(np.float64)
        silent = batch.column(n_keys + 4).to_numpy(zero_copy_only=False).astype(bool) if spare else None
        valid = ~np.isnan(x).any(axis=1) & (~np.isnan(y) if mode != "apply" else True)
        parts: dict[str, list] = {f.name: [] for f in outputs.fields}
        done = []
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            if change[a]:
                if open_ and mode == "fit":
                    done.append(closed())
                key, state, open_ = [k[int(a)].as_py() for k in keys], op.initial(), True
            while a < b and kinds[a] == 0:
                state = op.load(batch.column(batch.num_columns - 1)[int(a)].as_py())
                a += 1
            if a == b:
                continue
            use = valid[a:b]
            rows = slice(a, b) if use.all() else np.arange(a, b)[use]
            if mode == "apply":
                found = op.apply(state, x[rows])
            else:
                found = op.run(state, x[rows], y[rows], mode == "run")
            if mode != "fit":
                for f in outputs.fields:
                    parts[f.name].append(_full(found[f.name], use))
        yield from done
        if mode != "fit":
            keep = kinds == 1
            if not keep.any():
                continue
            arrays = [batch.column(n_keys + 1).filter(pa.array(keep))]
            for f, t in zip(outputs.fields, types[1:], strict=True):
                pieces = [pa.array(p, t, from_pandas=True) if isinstance(p, np.ndarray) else pa.array(p, t) for p in parts[f.name]]
                arrays.append(pa.concat_arrays(pieces))
            made = pa.RecordBatch.from_arrays(arrays, out_schema.fieldNames())
            yield made.filter(pa.array(~silent[keep])) if silent is not None else made
    if open_ and mode == "fit":
        yield closed()


def fold(
    df: DataFrame, op: Fold, layout: Layout, mode: str = "run", state: DataFrame | None = None, spare: str | None = None, partitions: int | None = None, keep: Names = None
) -> DataFrame:
    """Runs ``op`` over ``df`` in the order of ``layout``.

    ``run``: all columns of ``df``, or those in ``keep``, and the outputs; ``apply``: the same for
    predictions from ``state``; ``fit``: key columns and state. Rows with a null
    or NaN feature, or a null target where one is needed, are not learned from
    and have null outputs. Null keys are one key. An empty table gives no rows.
    For an ``op`` with ``few_keys`` the keys of ``df`` are counted first.
    """
    keys, d = layout.key, len(layout.features)
    state_type = struct_of(op.state_ddl)
    target = F.col(f"`{layout.target}`").cast("double") if layout.target else F.lit(0.0)
    columns = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    orders = [F.col(f"`{o}`").alias(f"__o{i}") for i, o in enumerate(layout.order_by)] if mode != "apply" else []
    # only rows that come out again go through the shuffle whole
    whole = F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else names(keep)) if c != spare]) if mode != "fit" else F.lit(None).cast("int")
    data = df.select(
        *columns, F.lit(1).alias("__kind"), whole.alias("__row"), vector([F.col(f"`{f}`") for f in layout.features]).alias("__x"),
        target.alias("__y"), *([F.col(f"`{spare}`").alias("__spare")] if spare else []), *([F.lit(None).cast(state_type).alias("__state")] if state is not None else []), *orders,
    )
    if state is not None:
        held = F.struct(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in state_type.fields])
        kinds = dict(zip(data.columns, [f.dataType for f in data.schema.fields], strict=True))
        first = state.select(
            *columns, F.lit(0).alias("__kind"), F.lit(None).cast(kinds["__row"]).alias("__row"), F.lit(None).cast("array<double>").alias("__x"), F.lit(None).cast("double").alias("__y"),
            *([F.lit(True).alias("__spare")] if spare else []), held.alias("__state"), *[F.lit(None).cast(kinds[f"__o{i}"]).alias(f"__o{i}") for i in range(len(orders))],
        )
        data = data.unionByName(first)
    by, ranks = [f"__k{i}" for i in range(len(keys))], [f"__o{i}" for i in range(len(orders))]
    placed = None
    if keys and orders and op.few_keys:
        seen = df.select(*columns, *orders)
        kinds = {c: data.schema[c].dataType for c in seen.columns}
        placed = measure(seen.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]), by, ranks, partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), state is not None)
    if placed:
        ordered = data.repartitionById(placed.partitions, placed.place).sortWithinPartitions(placed.prefix, *by, "__kind", *ranks)
    else:
        dealt = data.repartition(*([partitions] if partitions else []), *by) if keys else data.repartition(1)
        ordered = dealt.sortWithinPartitions(*by, "__kind", *ranks)
    ordered = ordered.drop(*ranks)
    if mode == "fit":
        schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + state_type.fields)
    else:
        schema = T.StructType([T.StructField("__row", ordered.schema["__row"].dataType), *struct_of(op.output_ddl).fields])
    n_keys, spares = len(keys), spare is not None

    chunk = op.chunk if mode != "apply" else 0

    def work(batches):
        padded = (_padded(b, d) for b in batches)
        yield from fold_batches(aligned(padded, n_keys, chunk) if chunk else padded, op, d, n_keys, mode, spares, schema)

    out = ordered.mapInArrow(work, schema)
    return out if mode == "fit" else out.select("__row.*", *struct_of(op.output_ddl).fieldNames())


def _padded(batch: pa.RecordBatch, d: int) -> pa.RecordBatch:
    """State rows get a vector of nulls, so all vectors of the batch have one length."""
    at = batch.schema.get_field_index("__x")
    x = batch.column(at)
    if x.null_count == 0:
        return batch
    blank = pa.scalar([None] * d, x.type)
    return batch.set_column(at, "__x", pc.fill_null(x, blank) if not pa.types.is_nested(x.type) else pc.if_else(pc.is_null(x), blank, x))


def native_fold(df: DataFrame, op, layout: Layout, rows: int = NATIVE_ROWS) -> DataFrame:
    """Key columns and final state by the higher-order ``aggregate``: no Python worker.

    A key's rows meet in one array, so this is used only if no key has more than
    ``rows`` rows, which is counted first; larger keys go to :func:`fold`.
    ``op`` defines ``fields(d)`` and ``step(ops, state, x, y)``.
    """
    keys = [F.col(f"`{k}`") for k in layout.key]
    most = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0
    if most > rows:
        return fold(df, op, layout, "fit")
    d = len(layout.features)
    x = vector([F.col(f"`{f}`") for f in layout.features])
    target = F.col(f"`{layout.target}`").cast("double") if layout.target else F.lit(0.0)
    entry = F.struct(*[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(layout.order_by)], x.alias("x"), target.alias("y"))
    known = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)) & target.isNotNull() & ~F.isnan(target)
    fields = op.fields(d)

    def typed(values: dict):
        return F.struct(*[as_column(values[name]).cast(kind).alias(name) for name, (kind, _) in fields.items()])

    def start():
        out = {}
        for name, (kind, value) in fields.items():
            out[name] = F.array(*[F.lit(float(v)) for v in value]) if isinstance(value, list) else F.lit(value)
            if isinstance(value, list) and not value:
                out[name] = F.array().cast(kind)
        return typed(out)

    def step(state, row):
        made = op.step(ColumnOps, state, row["x"], row["y"])
        moved = as_column(made)
        return ColumnOps.let(moved, lambda m: typed({name: m[name] for name in fields}))

    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(known, entry))).alias("__rows"))
    folded = grouped.select(*[F.col(f"`{k}`") for k in layout.key], F.aggregate("__rows", start(), step).alias("__s"))
    return folded.select(*[F.col(f"`{k}`") for k in layout.key], *[F.col(f"__s.{name}").alias(name) for name in fields])
