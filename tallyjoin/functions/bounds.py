"""Sizes to which shuffle blocks are padded so that, but for a chance of 2 to the -sigma, all rows fit.

Each bound solves x * x = b * x + c * b for the share x by which a sum may exceed its mean, with b the logarithm of the
admitted chance over that mean, and c 1 or 2 by the form of Chernoff's inequality. No rows need no room: such bounds are 0.
Numbers serve as well as columns: MATH and COLUMNS have the functions that differ.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMA = 40

MATH = SimpleNamespace(sqrt=math.sqrt, ln=math.log, ceil=math.ceil, least=min, whole=lambda a, b: a // b, pick=lambda test, a, b: a() if test else b)
COLUMNS = SimpleNamespace(
    sqrt=F.sqrt,
    ln=F.ln,
    ceil=lambda x: F.ceil(x).cast("bigint"),
    least=F.least,
    whole=lambda a, b: F.floor(a / b).cast("bigint"),
    pick=lambda test, a, b: F.when(test, a()).otherwise(b if isinstance(b, Column) else F.lit(b).cast("bigint")),
)


def kappa(sigma: int = SIGMA) -> float:
    return sigma * math.log(2)


def excess(b, c: int = 2, on: SimpleNamespace = MATH):
    return (b + on.sqrt(b * b + 4 * c * b)) / 2


def size_bound(n, p, sigma: int = SIGMA, on: SimpleNamespace = MATH):
    """Rows that any of p places gets at most when n rows are dealt at random."""

    def bound():
        mean = n / p
        return on.ceil((1 + excess((kappa(sigma) + 2 * on.ln(p)) / mean, on=on)) * mean)

    return on.pick(n > 0, bound, 0)


def sort_size_bound(total, p, sample, n, sigma: int = SIGMA, on: SimpleNamespace = MATH):
    """Rows of n that fall into one of p ranges, whose pivots come from a sample of total rows; never over n.

    The ranges are uneven by the sample's luck, and the rows of a range by their own.
    """

    def bound():
        mean = n / p
        uneven = 1 + excess(2 * (kappa(sigma) + 1 + on.ln(total)) * p / sample, 1, on)
        return on.least(n, on.ceil(uneven * (1 + excess((kappa(sigma) + 1 + 2 * on.ln(p)) * uneven / mean, on=on)) * mean))

    return on.pick((n > 0) & (sample > 0), bound, 0)


def bin_size_bound(n1, n2, degree1, degree2, p, most, sigma: int = SIGMA, on: SimpleNamespace = MATH):
    """Rows of a block when a join's n1 and n2 rows are packed by keys into bins and the bins are dealt to p * p blocks.

    A bin has room for the rows of a key of the largest degrees on both sides. Full bins are the fewest there can be; as a bin
    is closed only when the next key doesn't fit, two neighbours hold more than one bin's room, so at half the room they are
    the most. The mean is over the most, its excess over the fewest; a join of at most one bin fits in it.
    """
    widest = degree1 + degree2

    def bound():
        fewest, bins = on.whole(n1 + n2, widest), on.whole(n1 + n2, on.ceil(widest / 2))
        x = excess((kappa(sigma) + 2 * on.ln(p)) * p * p / fewest, on=on)
        return on.least(most, on.ceil((1 + x) * bins * widest / p / p))

    one = on.pick(n1 + n2 > 0, lambda: on.least(most, n1 + n2), 0)
    return on.pick((widest > 0) & (n1 + n2 >= widest), bound, one)


def size_bound_column(n: Column, p: Column, sigma: int = SIGMA) -> Column:
    """size_bound() of columns, within codegen."""
    return size_bound(n.cast("double"), p.cast("double"), sigma, COLUMNS)


def sort_size_bound_column(total: Column, p: Column, sample: Column, n: Column, sigma: int = SIGMA) -> Column:
    return sort_size_bound(*(c.cast("double") for c in (total, p, sample, n)), sigma, COLUMNS).cast("bigint")


def bin_size_bound_column(n1: Column, n2: Column, degree1: Column, degree2: Column, p: Column, most: Column, sigma: int = SIGMA) -> Column:
    return bin_size_bound(n1, n2, degree1, degree2, p.cast("double"), most, sigma, COLUMNS)
