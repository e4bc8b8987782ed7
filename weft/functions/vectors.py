"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths and for zero vectors."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))


def angular_score(cos: Column) -> Column:
    """Similarity in [0, 1] as an index over cosine distance reports it: 1 - distance / 2."""
    return F.least(F.greatest(1 - (1 - cos) / 2, F.lit(0.0)), F.lit(1.0))


def pad(v: Column, dim: int) -> Column:
    """Cut or zero-padded to ``dim`` numbers."""
    return F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def hash_embedding(text: Column, dim: int) -> Column:
    """A deterministic unit vector of a text, without meaning: a stand-in where no model is at hand.

    Entry i is ((h + i) mod 2000 - 1000) / 1000 before scaling, h being the first 32 bits of the MD5.
    """
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    # Lambdas bind the hash and the length, so that they are computed once for each row.
    raw = _bound(h, lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: ((h + i) % 2000 - 1000) / F.lit(1000.0)))
    return _bound(raw, lambda v: _bound(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def _bound(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def usable(v: Column, dim: int) -> Column:
    """Exactly ``dim`` finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad, F.lit(False))
