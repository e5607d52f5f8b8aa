"""Column functions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import HAN, col, matches


def doubles(v: str | Column) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null for different lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a vector is zero, null for different lengths or null."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(dot(a, b) * 0)


def hash_words(text: str | Column) -> Column:
    """The words of a text, lower case."""
    return matches(F.lower(F.translate(col(text), "Σ", "σ")), rf"[\p{{L}}\p{{N}}_{HAN}]+")


def hash_buckets(text: str | Column, dimensions: int = 384) -> Column:
    """(bucket, sign) of every word: the first four bytes of its SHA-256 choose the bucket, the fifth the sign."""

    def place(w: Column) -> Column:
        code = F.sha2(w, 256)
        bucket = F.conv(F.substring(code, 1, 8), 16, 10).cast("long") % dimensions
        sign = F.when(F.conv(F.substring(code, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
        return F.struct(bucket.cast("int").alias("bucket"), sign.alias("sign"))

    return F.transform(hash_words(text), place)


def mean(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors of one length."""
    n = F.size(vectors)
    total = F.aggregate(F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), F.element_at(vectors, 1), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)
