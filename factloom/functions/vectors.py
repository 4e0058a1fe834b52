"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths or a zero norm."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (both > 0), dot(a, b) / both).otherwise(F.lit(0.0))


def hash_slot(token: Column, slots: int = SLOTS) -> Column:
    """Slot of a token: the first four bytes of its SHA-256, little-endian, modulo the slots."""
    digest = F.sha2(token.cast("binary"), 256)
    byte = lambda k: F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("long")
    return F.pmod(byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216, F.lit(slots)).cast("int")


def rounded(a: Column, digits: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x.cast("double"), digits))
