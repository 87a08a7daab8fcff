"""Vector operators as column expressions, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def _fail(code: str) -> Column:
    return F.raise_error(F.lit(f"LATTICE:{code}"))


def as_double(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) <= 0, _fail("EmptyInput")).when(F.size(b) <= 0, _fail("EmptyInput")).when(F.size(a) != F.size(b), _fail("DimensionMismatch")).otherwise(value)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def dot(a, b) -> Column:
    """Sum of products, left to right. Empty or uneven vectors raise; a null vector is an empty one."""
    a, b = F.coalesce(_col(a), F.array().cast("array<double>")), F.coalesce(_col(b), F.array().cast("array<double>"))
    return _checked(a, b, _dot(a, b))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def l2_norm(v) -> Column:
    v = _col(v)
    return F.when(F.coalesce(F.size(v), F.lit(0)) <= 0, _fail("EmptyInput")).otherwise(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def cosine_similarity(a, b) -> Column:
    """Raises where the product of the norms is at most machine precision."""
    a, b = _col(a), _col(b)
    size = l2_norm(a) * l2_norm(b)
    return F.when(size <= EPSILON, _fail("InvalidInput zero norm")).otherwise(dot(a, b) / size)


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def l2_distance(a, b) -> Column:
    """From direct differences."""
    a, b = _col(a), _col(b)
    return _checked(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def complex_vector(re, im) -> Column:
    return F.zip_with(_col(re), _col(im), lambda x, y: F.struct(x.cast("double").alias("re"), y.cast("double").alias("im")))


def dot_hermitian(a, b) -> Column:
    """Sum of conj(a) b over arrays of structs (re, im)."""
    a, b = _col(a), _col(b)
    re = _sum(F.zip_with(a, b, lambda x, y: x["re"] * y["re"] + x["im"] * y["im"]))
    im = _sum(F.zip_with(a, b, lambda x, y: x["re"] * y["im"] - x["im"] * y["re"]))
    return _checked(a, b, F.struct(re.alias("re"), im.alias("im")))


def l2_norm_complex(v) -> Column:
    v = _col(v)
    return F.when(F.size(v) <= 0, _fail("EmptyInput")).otherwise(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x["re"] * x["re"] + x["im"] * x["im"])))


def cosine_similarity_complex(a, b) -> Column:
    size = l2_norm_complex(a) * l2_norm_complex(b)
    d = dot_hermitian(a, b)
    return F.when(size <= EPSILON, _fail("InvalidInput zero norm")).otherwise(F.struct((d["re"] / size).alias("re"), (d["im"] / size).alias("im")))
