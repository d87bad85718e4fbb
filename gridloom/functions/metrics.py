"""Measures of rankings and sets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two id arrays as sets; two empty ones are alike. Null counts as empty."""
    a, b = (F.coalesce(x, F.array().cast("array<bigint>")) for x in (a, b))
    whole = F.size(F.array_union(a, b))
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / whole)


def recall_at_k(result: Column, truth: Column, k: int = 10) -> Column:
    """Both lists are cut to min(k, size of the truth) before they are intersected; an empty truth gives 1."""
    n = F.least(F.lit(k), F.size(truth))
    top = F.slice(F.coalesce(result, F.array().cast("array<bigint>")), F.lit(1), n)
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(top, F.slice(truth, F.lit(1), n))) / n)


def runtime_multiplier(ratio: Column) -> Column:
    """What a run time of `ratio` times the baseline leaves of the score. Null gives the least."""
    return F.when(ratio <= 0.5, 1.0).when(ratio <= 1, 0.9).when(ratio <= 2, 0.75).otherwise(0.5)


def functional_score(search: Column, insert: Column, delete: Column) -> Column:
    return 0.5 * search + 0.3 * insert + 0.2 * delete


def discount(rank: Column) -> Column:
    """Weight of a place: 1 for the first, then 1 / log2(place); so the first two weigh the same."""
    return F.when(rank <= 1, F.lit(1.0)).otherwise(1 / F.log2(rank.cast("double")))


def ideal(n: Column) -> Column:
    """Sum of the first n discounts."""
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + discount(i)))
