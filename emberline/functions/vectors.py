"""Distances between arrays, sets and bags, and small numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_distance(a: Column, b: Column) -> Column:
    """sqrt(2 (1 - similarity)), defined for similarities of any sign."""
    return F.sqrt(F.greatest(F.lit(2.0) * (1 - cosine(a, b)), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Distance of two sets given as arrays; two empty sets are at distance 0."""
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double"))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Distance of two maps of weights: 1 - sum of minima over sum of maxima."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.struct(F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))).alias("lo"), F.greatest(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))).alias("hi")))
    v = F.map_values(both)
    return 1 - F.coalesce(F.try_divide(_sum(F.transform(v, lambda x: x["lo"].cast("double"))), _sum(F.transform(v, lambda x: x["hi"].cast("double")))), F.lit(1.0))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def speed(km: Column, clock_s: Column) -> Column:
    """Distance over the clock in thousands of millions of seconds; null at 0."""
    return F.try_divide(km, clock_s.cast("double") / 1e9)


def ip_octets(c: Column) -> Column:
    """Four numbers 0..1 of a dotted address: parts beyond four dropped, missing and
    non-numeric parts 0, blank and null 0.0.0.0."""
    parts = F.split(F.coalesce(c, F.lit("")), "[.]")
    one = lambda i: F.coalesce(F.when(F.get(parts, F.lit(i)).rlike("^[0-9]{1,9}$"), F.get(parts, F.lit(i))).try_cast("double"), F.lit(0.0)) / 255
    return F.array(*[one(i) for i in range(4)])


def combined(a: Column, weight: float, b: Column) -> Column:
    """a + weight * b for arrays."""
    return F.zip_with(a, b, lambda x, y: x + F.lit(weight) * y)


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


#: Distances by name, each a builder of a column from two columns; callers may add their own.
DISTANCES = {"l1": l1, "l2": l2, "cosine": cosine_distance, "jaccard": jaccard, "weighted_jaccard": weighted_jaccard, "levenshtein": F.levenshtein}
