"""Change detectors over a scalar stream. Status: 0 none, 1 warning, 2 drift."""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.functions.expressions import ks_critical
from ebbflow.operators.base import Sequential, Stepped
from ebbflow.plans.layout import Layout, Names
from ebbflow.plans.ops import PyOps
from ebbflow.plans.windows import halo_blocks

NONE, WARNING, DRIFT = 0, 1, 2
STATUS_NAMES: Mapping[int, str] = {NONE: "NoDrift", WARNING: "Warning", DRIFT: "DriftDetected"}


def status_name(status: Column) -> Column:
    """Status numbers as names."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in STATUS_NAMES.items()))[status]


def counts(statuses: DataFrame, key: Names = None) -> DataFrame:
    """``drift_count`` and ``warning_count`` of a run with a ``status`` column."""
    keys = [F.col(f"`{k}`") for k in ((key,) if isinstance(key, str) else key or ())]
    return statuses.groupBy(*keys).agg(F.count_if(F.col("status") == DRIFT).alias("drift_count"), F.count_if(F.col("status") == WARNING).alias("warning_count"))


class Detector(Sequential):
    """Takes one column. ``status`` is that after the row."""

    output_ddl = "status int"
    supervised = False

    def update(self, state, value: float) -> int:
        """Learns one value and returns the status."""
        return int(self.run(state, np.array([[value]]), np.zeros(1), True)["status"][0])

    def layout(self, df, features, target, order_by, key, exclude=None):
        at = super().layout(df, features, target, order_by, key, exclude)
        if len(at.features) != 1:
            raise ValueError("a detector takes one column")
        return at

    def apply(self, state, x):
        raise NotImplementedError("a detector does not predict")


class SteppedDetector(Detector, Stepped):
    """State also counts ``drifts`` and ``warnings``, over resets."""

    COUNTS = {"status": ("int", 0), "drifts": ("bigint", 0), "warnings": ("bigint", 0)}

    def after(self, state):
        return {"status": state["status"]}

    def update(self, state, value):
        self._ready(state, 1)
        state.update(self.step(PyOps, state, [value], 0.0))
        return state["status"]

    @staticmethod
    def counted(ops, state, status):
        """Fields that follow from the new status."""
        return {
            "status": status, "drifts": state["drifts"] + ops.where(status == DRIFT, lambda: 1, lambda: 0),
            "warnings": state["warnings"] + ops.where(status == WARNING, lambda: 1, lambda: 0),
        }


def _binary(x: np.ndarray, name: str) -> None:
    if not np.isin(x, (0.0, 1.0)).all():
        raise ValueError(f"{name} takes 0 and 1")


class DDM(SteppedDetector):
    """Error rate against its best so far, in standard deviations. Takes 0 and 1; starts anew after a drift."""

    def __init__(self, warning_level: float = 2.0, drift_level: float = 3.0, min_instances: int = 30):
        if not (0 < warning_level < drift_level and min_instances > 0):
            raise ValueError("0 < warning_level < drift_level and min_instances > 0 are needed")
        self.warning_level, self.drift_level, self.min_instances = warning_level, drift_level, min_instances

    def fields(self, d):
        return {"n": ("bigint", 0), "errors": ("bigint", 0), "p_min": ("double", math.inf), "s_min": ("double", math.inf), "n_min": ("bigint", 0), **self.COUNTS}

    def step(self, ops, state, x, y):
        def rated(v):
            return ops.let({"n": v["n"], "e": v["e"], "p": v["p"], "s": ops.sqrt(v["p"] * (1 - v["p"]) / v["n"])}, judged)

        def judged(v):
            due = v["n"] >= self.min_instances
            lower = ops.both(due, v["p"] + v["s"] < state["p_min"] + state["s_min"])
            held = {"n": v["n"], "e": v["e"], "t": v["p"] + v["s"], "due": due}
            held |= {"p_min": ops.where(lower, lambda: v["p"], lambda: state["p_min"]), "s_min": ops.where(lower, lambda: v["s"], lambda: state["s_min"])}
            held |= {"n_min": ops.where(lower, lambda: v["n"], lambda: state["n_min"])}
            return ops.let(held, decided)

        def decided(v):
            over = lambda level: ops.both(v["due"], v["t"] > v["p_min"] + level * v["s_min"])
            status = ops.where(over(self.drift_level), lambda: DRIFT, lambda: ops.where(over(self.warning_level), lambda: WARNING, lambda: NONE))
            return ops.let({"status": status, **{k: v[k] for k in ("n", "e", "p_min", "s_min", "n_min")}}, reset)

        def reset(v):
            gone = v["status"] == DRIFT
            fresh = lambda name, value: ops.where(gone, lambda: value, lambda: v[name])
            return {
                "n": fresh("n", 0), "errors": fresh("e", 0), "p_min": fresh("p_min", math.inf), "s_min": fresh("s_min", math.inf), "n_min": fresh("n_min", 0),
                **self.counted(ops, state, v["status"]),
            }

        n, e = state["n"] + 1, state["errors"] + ops.pick(x, 0)
        return ops.let({"n": n, "e": e}, lambda v: ops.let({"n": v["n"], "e": v["e"], "p": v["e"] / v["n"]}, rated))

    def run(self, state, x, y, emit):
        """The same numbers, a stretch at a time: all rates up to the next drift come from running counts."""
        _binary(x, "DDM")
        self._ready(state, 1)
        values, at, size = x[:, 0], 0, len(x)
        out = np.zeros(size, dtype=np.int64)
        while at < size:
            rest = values[at : at + 65536]
            n = state["n"] + np.arange(1, len(rest) + 1)
            e = state["errors"] + np.cumsum(rest)
            p = e / n
            s = np.sqrt(p * (1 - p) / n)
            level = p + s
            due = n >= self.min_instances
            key = np.where(due, level, math.inf)
            lower = key < np.minimum.accumulate(np.concatenate(([state["p_min"] + state["s_min"]], key[:-1])))
            best = np.maximum.accumulate(np.where(lower, np.arange(len(rest)), -1))
            p_min, s_min = np.where(best >= 0, p[best], state["p_min"]), np.where(best >= 0, s[best], state["s_min"])
            with np.errstate(invalid="ignore"):
                drift = due & (level > p_min + self.drift_level * s_min)
                warning = due & ~drift & (level > p_min + self.warning_level * s_min)
            end = int(drift.argmax()) + 1 if drift.any() else len(rest)
            out[at : at + end] = np.where(drift, DRIFT, np.where(warning, WARNING, NONE))[:end]
            last = end - 1
            if drift[last]:
                state.update(n=0, errors=0, p_min=math.inf, s_min=math.inf, n_min=0)
            else:
                seen = int(best[last])
                state.update(n=int(n[last]), errors=int(e[last]), p_min=float(p_min[last]), s_min=float(s_min[last]), n_min=int(n[seen]) if seen >= 0 else state["n_min"])
            at += end
        return _counted(state, out)


def _counted(state: dict, out: np.ndarray) -> dict:
    if len(out):
        state["status"] = int(out[-1])
        state["drifts"] += int((out == DRIFT).sum())
        state["warnings"] += int((out == WARNING).sum())
    return {"status": out}


class EDDM(SteppedDetector):
    """Distance between errors against its longest so far. Takes 0 and 1; judged at errors only; starts anew after a drift."""

    def __init__(self, warning_level: float = 0.95, drift_level: float = 0.90, min_instances: int = 30):
        if not (0 < drift_level < warning_level < 1 and min_instances > 0):
            raise ValueError("0 < drift_level < warning_level < 1 and min_instances > 0 are needed")
        self.warning_level, self.drift_level, self.min_instances = warning_level, drift_level, min_instances

    def fields(self, d):
        whole, real = ("bigint", 0), ("double", 0.0)
        return {"n": whole, "n_errors": whole, "last_error": whole, "mean": real, "std": real, "mean_max": real, "std_max": real, **self.COUNTS}

    def step(self, ops, state, x, y):
        names = ("n", "n_errors", "last_error", "mean", "std", "mean_max", "std_max")

        def error():
            gap, k = state["n"] + 1 - state["last_error"], state["n_errors"]

            def moments(v):
                spread = ops.where(k > 1, lambda: state["std"] * state["std"] * (k - 1), lambda: 0.0)
                m2 = spread + (gap - state["mean"]) * (gap - v["mean"])
                return {"mean": v["mean"], "std": ops.sqrt(ops.greatest(m2 / k, 0.0))}

            none = {"mean": state["mean"], "std": state["std"]}
            moved = ops.where(k > 0, lambda: ops.let({"mean": state["mean"] + (gap - state["mean"]) / k}, moments), lambda: none)
            return ops.let(moved, judged)

        def judged(v):
            now = v["mean"] + 2 * v["std"]
            due = state["n_errors"] + 1 >= self.min_instances
            top = ops.both(due, now > state["mean_max"] + 2 * state["std_max"])
            held = {"mean": v["mean"], "std": v["std"], "now": now, "due": due}
            held |= {"mean_max": ops.where(top, lambda: v["mean"], lambda: state["mean_max"]), "std_max": ops.where(top, lambda: v["std"], lambda: state["std_max"])}
            return ops.let(held, decided)

        def decided(v):
            most = v["mean_max"] + 2 * v["std_max"]
            ratio = ops.where(ops.both(v["due"], most > 0), lambda: v["now"] / most, lambda: 1.0)
            return ops.let({"ratio": ratio, **{k: v[k] for k in ("mean", "std", "mean_max", "std_max")}}, named)

        def named(v):
            below = lambda level: v["ratio"] < level
            status = ops.where(below(self.drift_level), lambda: DRIFT, lambda: ops.where(below(self.warning_level), lambda: WARNING, lambda: NONE))
            return ops.let({"status": status, **{k: v[k] for k in ("mean", "std", "mean_max", "std_max")}}, reset)

        def reset(v):
            gone = v["status"] == DRIFT
            new = {"n": state["n"] + 1, "n_errors": state["n_errors"] + 1, "last_error": state["n"] + 1, **{k: v[k] for k in ("mean", "std", "mean_max", "std_max")}}
            blank = {"n": 0, "n_errors": 0, "last_error": 0, "mean": 0.0, "std": 0.0, "mean_max": 0.0, "std_max": 0.0}
            fields = {k: ops.where(gone, lambda k=k: blank[k], lambda k=k: new[k]) for k in names}
            return {**fields, **self.counted(ops, state, v["status"])}

        still = {**{k: state[k] for k in names}, "n": state["n"] + 1, "status": 0, "drifts": state["drifts"], "warnings": state["warnings"]}
        return ops.where(ops.pick(x, 0) > 0.5, error, lambda: still)

    def run(self, state, x, y, emit):
        """The same steps, at the rows that are errors."""
        _binary(x, "EDDM")
        self._ready(state, 1)
        out, done = np.zeros(len(x), dtype=np.int64), 0
        for at in np.flatnonzero(x[:, 0] > 0.5).tolist():
            state["n"] += at - done
            state.update(self.step(PyOps, state, [1.0], 0.0))
            out[at] = state["status"]
            done = at + 1
        state["n"] += len(x) - done
        drifts, warnings = state["drifts"], state["warnings"]
        found = _counted(state, out)
        state["drifts"], state["warnings"] = drifts, warnings
        return found


class PageHinkley(SteppedDetector):
    """Cumulative excess over a forgetting mean. Upward shifts only, no warnings; starts anew after a drift."""

    def __init__(self, min_instances: int = 30, delta: float = 0.005, threshold: float = 50.0, alpha: float = 0.9999):
        if not (min_instances > 0 and delta >= 0 and threshold > 0 and 0 <= alpha < 1):
            raise ValueError("min_instances > 0, delta >= 0, threshold > 0 and 0 <= alpha < 1 are needed")
        self.min_instances, self.delta, self.threshold, self.alpha = min_instances, delta, threshold, alpha

    def fields(self, d):
        return {"n": ("bigint", 0), "x_mean": ("double", 0.0), "total": ("double", 0.0), "least": ("double", 0.0), **self.COUNTS}

    def step(self, ops, state, x, y):
        value = ops.pick(x, 0)

        def summed(v):
            return ops.let({"m": v["m"], "t": state["total"] + (value - v["m"] - self.delta)}, judged)

        def judged(v):
            return ops.let({"m": v["m"], "t": v["t"], "l": ops.least(state["least"], v["t"])}, decided)

        def decided(v):
            drift = ops.both(state["n"] + 1 >= self.min_instances, v["t"] - v["l"] > self.threshold)
            return ops.let({"m": v["m"], "t": v["t"], "l": v["l"], "status": ops.where(drift, lambda: DRIFT, lambda: NONE)}, reset)

        def reset(v):
            gone = v["status"] == DRIFT
            return {
                "n": ops.where(gone, lambda: 0, lambda: state["n"] + 1), "x_mean": ops.where(gone, lambda: 0.0, lambda: v["m"]),
                "total": ops.where(gone, lambda: 0.0, lambda: v["t"]), "least": ops.where(gone, lambda: 0.0, lambda: v["l"]), **self.counted(ops, state, v["status"]),
            }

        mean = ops.where(state["n"] == 0, lambda: value, lambda: self.alpha * state["x_mean"] + (1 - self.alpha) * value)
        return ops.let({"m": mean}, summed)

    def run(self, state, x, y, emit):
        """The same steps in one plain loop."""
        self._ready(state, 1)
        n, mean, total, least = state["n"], state["x_mean"], state["total"], state["least"]
        a, b, delta, threshold, first = self.alpha, 1 - self.alpha, self.delta, self.threshold, self.min_instances
        out = np.zeros(len(x), dtype=np.int64)
        for i, v in enumerate(x[:, 0].tolist()):
            mean = a * mean + b * v if n else v
            n += 1
            total = total + (v - mean - delta)
            if total < least:
                least = total
            elif n >= first and total - least > threshold:
                out[i] = DRIFT
                n, mean, total, least = 0, 0.0, 0.0, 0.0
        state.update(n=n, x_mean=mean, total=total, least=least)
        return _counted(state, out)


class ADWIN(Detector):
    """A window of all values since the last change, cut wherever two parts of it differ by more than chance.

    Exact: the first admissible cut of the whole window is found at every row.
    Most rows need no scan, since one value can move no cut far enough. A scan
    first bounds whole stretches of cuts by the least and greatest prefix sums in
    them and looks closer only where a cut is possible at all.
    """

    state_ddl = "n bigint, window array<double>, status int, drifts bigint"
    STRETCH = 128

    def __init__(self, delta: float = 0.002, min_window_length: int = 5):
        if not (0 < delta < 1 and min_window_length > 0):
            raise ValueError("0 < delta < 1 and min_window_length > 0 are needed")
        self.delta, self.min_window_length = delta, min_window_length

    def initial(self):
        return {"n": 0, "status": 0, "drifts": 0, "w": _Window([])}

    def run(self, state, x, y, emit):
        if not np.isfinite(x).all():
            raise ValueError("ADWIN takes finite numbers")
        window, out = state["w"], np.zeros(len(x), dtype=np.int64)
        for i, value in enumerate(x[:, 0].tolist()):
            window.push(value)
            if self._reduce(window):
                out[i] = DRIFT
        state["n"] += len(x)
        if len(out):
            state["status"] = int(out[-1])
            state["drifts"] += int((out == DRIFT).sum())
        return {"status": out}

    def _reduce(self, window: _Window) -> bool:
        least, found = self.min_window_length, False
        while window.width >= 2 * least:
            at = self._first_cut(window, least)
            if not at:
                break
            window.drop(at)
            found = True
        return found

    def _first_cut(self, window: _Window, least: int) -> int:
        """Length of the shortest prefix that differs from the rest, or 0.

        With ``g = |prefix - i * mean|`` a cut at i needs ``g > a * sqrt(i (n - i) / n) + b``.
        One more value moves g by at most ``n`` times the change of the mean,
        and the right side falls only as a and b do, so after a scan without a
        cut the least distance between the two sides tells how long none is
        possible; until then only the cut that has become admissible is judged.
        """
        n = window.width
        log_term = math.log(2 * math.log(max(n, 2)) / self.delta)
        variance = window.m2 / (n - 1) if n > 1 else 0.0
        a, b, mean = math.sqrt(2 * max(variance, 0.0) * log_term), 2 / 3 * log_term, window.total / n
        if window.slack > 0:
            old_a, old_b, old_mean = window.judged
            spent = n * abs(mean - old_mean) + max(0.0, old_a - a) * math.sqrt(n) / 2 + max(0.0, old_b - b)
            window.slack -= spent * (1 + 1e-9) + 1e-12 * abs(window.total)
            window.judged = a, b, mean
            i = n - least
            g, need = abs(float(window.sums[i]) - i * mean), a * math.sqrt(i * least / n) + b
            window.slack = min(window.slack, need - g)
            if window.slack > 0:
                return 0
        window.judged, window.slack = (a, b, mean), math.inf
        if n <= 4 * self.STRETCH:
            return self._scan(window, least, n - least, a, b, mean)
        blocks = window.extremes(self.STRETCH)
        begins = np.arange(len(blocks)) * self.STRETCH + 1
        ends = begins + self.STRETCH - 1
        # extremes are of prefix - i * m0 for the mean at the time; the slope since then bounds the rest
        slope = blocks[:, 2] - mean
        high = np.maximum(blocks[:, 1] + np.maximum(slope * begins, slope * ends), -(blocks[:, 0] + np.minimum(slope * begins, slope * ends)))
        high = high * (1 + 1e-9) + 1e-9 * abs(window.total)
        room = np.minimum(begins * (n - begins), np.maximum(ends * (n - ends), 0)) / n
        spare = a * np.sqrt(room) + b - high
        safe = spare > 0
        if safe.any():
            window.slack = float(spare[safe].min())
        for k in np.flatnonzero(~safe).tolist():
            at = self._scan(window, max(least, int(begins[k])), min(n - least, int(ends[k])), a, b, mean)
            if at:
                return at
        return self._scan(window, max(least, len(blocks) * self.STRETCH + 1), n - least, a, b, mean)

    @staticmethod
    def _scan(window: _Window, first: int, last: int, a: float, b: float, mean: float) -> int:
        if last < first:
            return 0
        n = window.width
        i = np.arange(first, last + 1, dtype=np.float64)
        prefix = window.prefix(first, last)
        inverse = 1 / i + 1 / (n - i)
        over = np.abs(prefix / i - (window.total - prefix) / (n - i)) > a * np.sqrt(inverse) + b * inverse
        if over.any():
            return first + int(over.argmax())
        window.slack = min(window.slack, float((a / np.sqrt(inverse) + b - np.abs(prefix - i * mean)).min()))
        return 0

    def dump(self, state):
        return {"n": state["n"], "window": state["w"].values().tolist(), "status": state["status"], "drifts": state["drifts"]}

    def load(self, row):
        return {"n": row["n"], "status": row["status"], "drifts": row["drifts"], "w": _Window(row["window"] or [])}


class _Window:
    """Values and their prefix sums in arrays that grow at the end and lose a front."""

    def __init__(self, values: list[float]):
        self._start(np.asarray(values, dtype=np.float64))

    def _start(self, values: np.ndarray) -> None:
        self.width = len(values)
        self.data = np.zeros(max(64, 2 * self.width))
        self.data[: self.width] = values
        self.sums = np.zeros(len(self.data) + 1)
        self.sums[1 : self.width + 1] = np.cumsum(values)
        self.total = float(self.sums[self.width])
        self.m2 = float(((values - self.total / self.width) ** 2).sum()) if self.width > 1 else 0.0
        self.blocks = np.zeros((64, 3))
        self.counted = 0
        self.slack, self.judged = -1.0, (0.0, 0.0, 0.0)

    def push(self, value: float) -> None:
        if self.width == len(self.data):
            self.data = np.concatenate((self.data, np.zeros(self.width)))
            self.sums = np.concatenate((self.sums, np.zeros(self.width)))
        old = self.total / self.width if self.width else 0.0
        self.data[self.width] = value
        self.total += value
        self.width += 1
        self.sums[self.width] = self.total
        if self.width > 1:
            self.m2 += (value - old) * (value - self.total / self.width)

    def drop(self, count: int) -> None:
        self._start(self.data[count : self.width].copy())

    def values(self) -> np.ndarray:
        return self.data[: self.width]

    def prefix(self, first: int, last: int) -> np.ndarray:
        return self.sums[first : last + 1]

    def extremes(self, size: int) -> np.ndarray:
        """For each full stretch of prefix lengths: least and greatest ``prefix - i * m``, and ``m``."""
        while (self.counted + 1) * size <= self.width:
            if self.counted == len(self.blocks):
                self.blocks = np.concatenate((self.blocks, np.zeros_like(self.blocks)))
            mean = self.total / self.width
            first = self.counted * size + 1
            rest = self.sums[first : first + size] - np.arange(first, first + size) * mean
            self.blocks[self.counted] = rest.min(), rest.max(), mean
            self.counted += 1
        return self.blocks[: self.counted]


class KSWIN(Detector):
    """Two-sample Kolmogorov-Smirnov test between the first and the last values of a window; a warning from 80 % of the critical value."""

    state_ddl = "n bigint, window array<double>, status int, drifts bigint"

    def __init__(self, alpha: float = 0.005, window_size: int = 100, stat_size: int = 30):
        if not (0 < alpha < 1 and window_size > 0 and stat_size > 0 and stat_size <= window_size // 2):
            raise ValueError("0 < alpha < 1, window_size > 0 and 0 < stat_size <= window_size / 2 are needed")
        self.alpha, self.window_size, self.stat_size = alpha, window_size, stat_size

    def initial(self):
        return {"n": 0, "window": [], "status": 0, "drifts": 0}

    def run(self, state, x, y, emit):
        w, s = self.window_size, self.stat_size
        values = np.concatenate((np.array(state["window"], dtype=np.float64), x[:, 0]))
        out = np.zeros(len(x), dtype=np.int64)
        critical = ks_critical(s, s, self.alpha)
        for start in range(0, max(0, len(values) - w + 1), 4096):
            windows = np.lib.stride_tricks.sliding_window_view(values[start : start + 4096 + w - 1], w)
            first, last = np.sort(windows[:, :s], axis=1), np.sort(windows[:, -s:], axis=1)
            # the largest gap is reached at a value of either sample
            pooled = np.concatenate((first, last), axis=1)
            gap = np.zeros(len(pooled))
            for k in range(2 * s):
                v = pooled[:, k : k + 1]
                gap = np.maximum(gap, np.abs((first <= v).sum(axis=1) / s - (last <= v).sum(axis=1) / s))
            found = np.where(gap > critical, DRIFT, np.where(gap > critical * 0.8, WARNING, NONE))
            at = start + w - 1 - len(state["window"])
            keep = np.arange(at, at + len(found))
            out[keep[keep >= 0]] = found[keep >= 0]
        state["n"] += len(x)
        state["window"] = values[-w:].tolist() if len(values) else []
        if len(out):
            state["status"] = int(out[-1])
            state["drifts"] += int((out == DRIFT).sum())
        return {"status": out}

    def windowed(self, df: DataFrame, feature: str, order_by: Names, key: Names = None, rows_per_block: int = 20_000) -> DataFrame:
        """All columns of ``df`` and ``status``, a key's rows dealt into parts that overlap by a window.

        Every row counts; a null among the values of a window makes its status
        0. A task holds one part, at most ``rows_per_block + window_size - 1`` rows.
        """
        at = Layout.of(df, feature, None, order_by, key)
        w, s = self.window_size, self.stat_size
        dealt = halo_blocks(df, at.order_by, w, at.key, rows_per_block)
        rows = dealt.withColumn("__value", F.col(f"`{feature}`").cast("double"))
        kept = df.columns
        schema = T.StructType([*df.schema.fields, T.StructField("status", T.IntegerType())])

        def work(part: pa.Table) -> pa.Table:
            part = part.sort_by("__rn").combine_chunks()
            values = part.column("__value").to_numpy()
            missing = np.cumsum(np.concatenate(([0], np.isnan(values))))
            status = self.run(self.initial(), np.where(np.isnan(values), 0.0, values)[:, None], np.zeros(len(values)), True)["status"].astype(np.int32)
            status[w - 1 :][missing[w:] > missing[:-w]] = NONE
            mine = ~part.column("__halo").to_numpy()
            columns = [part.column(c) for c in kept]
            return pa.Table.from_arrays([*columns, pa.chunked_array([status])], [*kept, "status"]).filter(pa.array(mine))

        return rows.groupBy(*[F.col(f"`{k}`") for k in at.key], "__part").applyInArrow(work, schema)
