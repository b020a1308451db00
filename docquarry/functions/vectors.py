"""Vector expressions. Sums run left to right in double so results repeat exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions import let

HASH_DIMENSION = 64


def finite(vector: Column) -> Column:
    """Whether every number of a vector is one: not NULL, not NaN, not infinite."""
    return F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def dot(left: Column, right: Column) -> Column:
    return _sum(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def squared_l2(left: Column, right: Column) -> Column:
    def square(a, b):
        return (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))

    return _sum(F.zip_with(left, right, square))


def inner_product(left: Column, right: Column) -> Column:
    return F.lit(1.0) - dot(left, right)


def cosine(left: Column, right: Column) -> Column:
    """A zero vector is at distance 1 from everything."""
    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.lit(1.0) - F.when(norms > 0, dot(left, right) / norms).otherwise(F.lit(0.0))


DISTANCES = {"l2": squared_l2, "cosine": cosine, "ip": inner_product}


def word_bucket(word: Column, dimension: int = HASH_DIMENSION) -> Column:
    digest = F.md5(word.cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dimension).cast("int")


def hashed_vector(word_list: Column, dimension: int = HASH_DIMENSION) -> Column:
    """Word counts hashed into ``dimension`` buckets and scaled to length 1.

    No words give the zero vector.
    """

    def counts(buckets):
        """Sorted once; the length of each run of equal buckets is the count of its bucket."""
        def by_bucket(run, ends):
            lengths = F.transform(ends, lambda end, k: end - F.coalesce(F.get(ends, k - 1), F.lit(-1)))
            return F.map_from_arrays(F.transform(ends, lambda end: F.get(run, end)), lengths)

        def histogram(run):
            places = F.sequence(F.lit(0), F.size(run) - 1)
            ends = F.filter(places, lambda i: F.coalesce(F.get(run, i) != F.get(run, i + 1), F.lit(True)))
            found = let(ends, lambda e: by_bucket(run, e))
            return let(found, lambda n: F.transform(
                F.sequence(F.lit(0), F.lit(dimension - 1)), lambda b: F.coalesce(F.try_element_at(n, b), F.lit(0))))

        return F.when(F.size(buckets) > 0, let(F.sort_array(buckets), histogram)).when(
            buckets.isNotNull(), F.array_repeat(F.lit(0), dimension))

    def scale(histogram):
        squares = F.transform(histogram, lambda n: n.cast("bigint") * n.cast("bigint"))
        total = F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, n: s + n)
        return let(
            F.sqrt(total.cast("double")),
            lambda norm: F.transform(
                histogram,
                lambda n: F.when(norm > 0, n.cast("double") / norm)
                .otherwise(F.lit(0.0)).cast("float"),
            ),
        )

    buckets = F.transform(word_list, lambda word: word_bucket(word, dimension))
    return let(let(buckets, counts), scale)
