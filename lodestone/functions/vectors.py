"""Vector expressions in double precision, summed in array order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    return let(doubles(v), lambda a: let(norm(a), lambda n: F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(doubles(a)) * norm(doubles(b))
    return F.when(n == 0, 0.0).otherwise(dot(doubles(a), doubles(b)) / n)


# Fixed values of the generator: multiplier, increment, and 2^31 - 1.
MULTIPLIER, INCREMENT, MASK = 1103515245, 12345, 0x7FFFFFFF


def hash_vector(text: Column, size: int) -> Column:
    """Unit vector seeded by the md5 of a text through a linear congruential generator modulo 2^31.

    Its i-th state is a linear function of the seed, so the states are computed
    side by side. Only the seed's low 31 bits count, so products fit a long.
    """
    seed = F.conv(F.substring(F.md5(text.cast("binary")), 25, 8), 16, 10).cast("long").bitwiseAND(F.lit(MASK))
    factor, add, factors, adds = 1, 0, [], []
    for _ in range(size):
        factor, add = factor * MULTIPLIER & MASK, (add * MULTIPLIER + INCREMENT) & MASK
        factors.append(factor)
        adds.append(add)
    states = F.zip_with(F.lit(factors).cast("array<long>"), F.lit(adds).cast("array<long>"), lambda a, c: F.struct(a.alias("a"), c.alias("c")))
    return unit(F.transform(states, lambda x: (x["a"] * seed + x["c"]).bitwiseAND(F.lit(MASK)) / F.lit(float(MASK)) - 0.5))
