"""Vector algebra on array columns, as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A row is divided by its length, or by this where it is shorter.
FLOOR = 1e-12


def doubles(matrix: Column | str) -> Column:
    """An array of arrays of any numeric type as doubles."""
    return F.col(matrix).cast("array<array<double>>") if isinstance(matrix, str) else matrix.cast("array<array<double>>")


def dot(a: Column, b: Column) -> Column:
    """Scalar product; a longer array makes it null, so dimensions are checked before."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """``v`` over its length, with the floor; a zero row stays zero."""
    # the length is bound once by a one-element transform, not once for each component
    return F.element_at(
        F.transform(F.array(F.greatest(norm(v), F.lit(FLOOR))), lambda n: F.transform(v, lambda x: x / n)), 1
    )


def unit_rows(matrix: Column, passes: int = 1) -> Column:
    """Every row through :func:`unit`, ``passes`` times (a second pass shows below the floor only)."""
    for _ in range(passes):
        matrix = F.transform(matrix, unit)
    return matrix


def is_finite(v: Column) -> Column:
    """True if an array holds neither null nor NaN nor an infinity."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def is_matrix(matrix: Column) -> Column:
    """True for a non-empty array of non-empty arrays of one length."""
    width = F.size(F.get(matrix, F.lit(0)))
    return F.coalesce(
        (F.size(matrix) > 0) & F.forall(matrix, lambda v: v.isNotNull() & (F.size(v) > 0) & (F.size(v) == width)),
        F.lit(False),
    )


def literal(matrix: Sequence[Sequence[float]]) -> Column:
    """A small matrix as a constant column."""
    return F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in matrix))


def maxsim(query: Column, document: Column) -> Column:
    """Sum over query rows of the largest scalar product with a document row; rows are unit rows."""
    return F.aggregate(
        query, F.lit(0.0), lambda s, q: s + F.array_max(F.transform(document, lambda d: dot(q, d)))
    )
