"""Arithmetic on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is missing or has no length."""
    scale = norm(a) * norm(b)
    return F.coalesce(F.when(scale > 0, dot(a, b) / F.when(scale > 0, scale)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets given as arrays; 0 if both are empty or one is missing."""
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.when(union > 0, F.size(F.array_intersect(a, b)) / F.when(union > 0, union)), F.lit(0.0))


def sized(a: Column, n: int) -> Column:
    """The first n components, zeros added if there are fewer."""
    return F.slice(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(0.0), n)), 1, n)


def pair_features(a: Column, b: Column, decays: Column, evidence: Column) -> Column:
    """[a, b, a*b, |a-b|, decays, evidence] as one array."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: x * y), F.zip_with(a, b, lambda x, y: F.abs(x - y)), decays, evidence)


def byte_vector(text: Column, n: int) -> Column:
    """The first n UTF-8 bytes, each over 255; zeros added if there are fewer."""
    hexed = F.hex(F.substring(F.encode(text, "UTF-8"), 1, n))
    values = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.conv(F.nullif(F.substring(hexed, 2 * i - 1, F.lit(2)), F.lit("")), 16, 10).cast("double"), F.lit(0.0)) / 255)
    return values


def serialized(fields: Column) -> Column:
    """A map as k=v, joined by | in key order."""
    pairs = F.array_sort(F.map_entries(fields))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("")))), "|")
