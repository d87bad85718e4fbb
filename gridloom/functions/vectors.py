"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, as a built-in expression."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable(x: Column, dim: int) -> Column:
    """`dim` finite numbers, not all zero."""
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & (F.size(x) == dim) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def half(x: Column) -> Column:
    """The numbers of a vector as they come back from half precision: 11 significant bits, ties to even, infinite beyond 65,504."""

    def one(v: Column) -> Column:
        v = v.cast("double")
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))).cast("double"), F.lit(-14.0)) - 10)
        near = F.rint(v / step) * step
        return F.when((v == 0) | F.isnan(v), v).when(F.abs(near) > 65504, F.signum(v) * F.lit(float("inf"))).otherwise(near)

    return F.transform(x, one)
