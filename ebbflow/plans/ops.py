"""One definition of a step, two ways to run it.

A step is written against ``ops`` and evaluates either on Python numbers, row
by row, or as a Catalyst expression inside the higher-order ``aggregate``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


class PyOps:
    """Plain numbers, lists and dicts."""

    sqrt, exp, log, absolute = staticmethod(math.sqrt), staticmethod(math.exp), staticmethod(math.log), staticmethod(abs)
    least, greatest = staticmethod(min), staticmethod(max)

    @staticmethod
    def let(value, use):
        return use(value)

    @staticmethod
    def where(test, yes, no):
        return yes() if test else no()

    @staticmethod
    def both(a, b):
        return a and b

    @staticmethod
    def power(a, b):
        return a**b

    @staticmethod
    def sign(v):
        return (v > 0) - (v < 0)

    @staticmethod
    def dot(a, b):
        return sum(map(lambda x, y: x * y, a, b))

    @staticmethod
    def each(use, *arrays):
        return list(map(use, *arrays))

    @staticmethod
    def pick(array, index):
        return array[index]

    @staticmethod
    def sigmoid(z):
        return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


def as_column(value) -> Column:
    """Dicts become structs."""
    if isinstance(value, dict):
        return F.struct(*[as_column(v).alias(k) for k, v in value.items()])
    return value if isinstance(value, Column) else F.lit(value)


class ColumnOps:
    """Catalyst expressions."""

    sqrt, exp, log, absolute, sign = staticmethod(F.sqrt), staticmethod(F.exp), staticmethod(F.log), staticmethod(F.abs), staticmethod(F.signum)

    @staticmethod
    def least(*values):
        return F.least(*map(as_column, values))

    @staticmethod
    def greatest(*values):
        return F.greatest(*map(as_column, values))

    @staticmethod
    def let(value, use):
        return F.transform(F.array(as_column(value)), lambda v: as_column(use(v))).getItem(0)

    @staticmethod
    def where(test, yes, no):
        return F.when(test, as_column(yes())).otherwise(as_column(no()))

    @staticmethod
    def both(a, b):
        return a & b

    @staticmethod
    def power(a, b):
        return F.pow(as_column(a), as_column(b))

    @staticmethod
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    @staticmethod
    def each(use, *arrays):
        if len(arrays) == 1:
            return F.transform(arrays[0], lambda v: as_column(use(v)))
        if len(arrays) == 2:
            return F.zip_with(*arrays, lambda v, w: as_column(use(v, w)))
        return F.transform(F.arrays_zip(*[a.alias(f"a{k}") for k, a in enumerate(arrays)]), lambda v: as_column(use(*[v[f"a{k}"] for k in range(len(arrays))])))

    @staticmethod
    def pick(array, index):
        return F.get(array, as_column(index))

    @staticmethod
    def sigmoid(z):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
