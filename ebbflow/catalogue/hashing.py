"""The draws of ``functions.expressions`` in DuckDB's SQL, which has no 64-bit hash of its own."""

from __future__ import annotations

import math
from itertools import count

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
WHOLE = 1 << 64
_names = count()


def _number(v: int) -> str:
    return f"{v}::UHUGEINT"


def _let(value: str, use) -> str:
    """``use(name)`` with ``value`` computed once."""
    name = f"h{next(_names)}"
    return f"list_transform([{value}], lambda {name}: {use(name)})[1]"


def _times(a: str, b: int) -> str:
    return f"(({a}) * {_number(b)} % {_number(WHOLE)})"


def _turned(a: str, bits: int) -> str:
    return _let(a, lambda v: f"({v} * {_number(1 << bits)} % {_number(WHOLE)} + {v} // {_number(1 << (64 - bits))})")


def _folded(a: str, bits: int) -> str:
    return _let(a, lambda v: f"xor({v}, {v} // {_number(1 << bits)})")


def hash_sql(*values: str | int, seed: int = 42) -> str:
    """``xxhash64`` of bigints (names of columns, or numbers) as an unsigned number."""
    h = _number(seed)
    for value in values:
        unsigned = _number(value % WHOLE) if isinstance(value, int) else f"(({value})::HUGEINT + CASE WHEN ({value}) < 0 THEN {WHOLE} ELSE 0 END)::UHUGEINT"
        mixed = _times(_turned(_times(unsigned, P2), 31), P1)
        h = f"xor((({h}) + {_number(P5 + 8)}) % {_number(WHOLE)}, {mixed})"
        h = f"({_times(_turned(h, 27), P1)} + {_number(P4)}) % {_number(WHOLE)}"
        h = _folded(_times(_folded(_times(_folded(h, 33), P2), 29), P3), 32)
    return h


def uniform_sql(seed: int, *parts: str | int) -> str:
    return f"((({hash_sql(seed, *parts)}) // {_number(1 << 11)})::DOUBLE / {float(1 << 53)!r}::DOUBLE)"


def normal_sql(seed: int, *parts: str | int) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {uniform_sql(seed, *parts, 0)})) * cos({2 * math.pi!r}::DOUBLE * {uniform_sql(seed, *parts, 1)}))"


def poisson_sql(rate: float, seed: int, *parts: str | int) -> str:
    """How many terms of the distribution function lie at or below a uniform draw."""
    bounds, p, below, k = [], math.exp(-rate), 0.0, 0
    while k <= rate or below + p != below:
        below += p
        bounds.append(below)
        k += 1
        p *= rate / k
    steps = " + ".join(f"(u >= {b!r}::DOUBLE)::INTEGER" for b in bounds)
    return f"(SELECT {steps} FROM (SELECT {uniform_sql(seed, *parts)} AS u))"
