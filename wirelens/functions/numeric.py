"""Arithmetic and vector expressions."""

from functools import reduce

from pyspark.sql import Column, functions as F


def named(name: str) -> Column:
    """Column by its exact name, dots and slashes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b where b is positive, else ``default``."""
    return F.when(b > 0, a / b).otherwise(F.lit(default))


def finite_or_zero(x: Column) -> Column:
    """NaN, infinities and nulls become 0 (NaN sorts above infinity, null fails every test)."""
    return F.when(F.abs(x) < float("inf"), x).otherwise(0.0)


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def total(columns: list[Column]) -> Column:
    """Sum of columns as a balanced tree, so wide vectors do not nest 78 levels deep."""
    columns = list(columns)
    while len(columns) > 1:
        columns = [reduce(lambda a, b: a + b, columns[i:i + 2]) for i in range(0, len(columns), 2)]
    return columns[0]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where ``body`` uses it in a lambda.
    (A plain column would be inlined into the lambda and computed again for every element.)"""
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column) -> Column:
    """Softmax of an array column, shifted by its maximum so that exp never overflows."""
    def exps(z):
        return let(F.array_max(z), lambda peak: F.transform(z, lambda v: F.exp(v - peak)))

    def shares(e):
        return let(F.aggregate(e, F.lit(0.0), lambda acc, p: acc + p), lambda s: F.transform(e, lambda v: v / s))
    return let(logits, lambda z: let(exps(z), shares))


def first_argmax(vector: Column) -> Column:
    """0-based position of the largest entry; the first one on ties."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                       lambda i: F.when(i == index, 1.0).otherwise(0.0))
