"""Small building blocks shared by the other function modules."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MANTISSA = 1 << 52


def built_once(build: Callable) -> Callable:
    """Keep the columns a function builds from plain parameters for the running application.

    A column is an unbound description, so it can serve any number of queries. Describing the
    scoring expressions takes thousands of calls into the JVM, which is worth doing once.
    """

    @functools.lru_cache(maxsize=64)
    def stored(application: str, *parameters):
        return build(*parameters)

    @functools.wraps(build)
    def wrapper(*parameters):
        session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        return stored(session.sparkContext.applicationId, *parameters)

    return wrapper


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`.

    Inside array lambdas there is no common-subexpression elimination, so a value that is
    used several times is bound as the single element of an array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def round_exact(value: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value of a double, in integer arithmetic.

    SQL `round` is half-up and `bround` looks at the shortest decimal form; both differ from
    IEEE round-half-even on some doubles. The fraction times 2**52 is a whole number, plus
    some bits below it for values under 1, and so is compared to the midpoint exactly.
    """
    power = 10 ** digits

    def rounded(v: Column) -> Column:
        size = F.abs(v)
        whole = F.floor(size).cast("bigint")
        scaled = (size - whole) * F.lit(float(MANTISSA))
        mantissa = F.floor(scaled).cast("bigint")
        product = mantissa * F.lit(power).cast("bigint")
        quotient = F.shiftright(product, 52)
        to_midpoint = F.lit(MANTISSA // 2).cast("bigint") - product.bitwiseAND(F.lit(MANTISSA - 1))
        below = (scaled - mantissa) * F.lit(float(power))
        odd = quotient.bitwiseAND(F.lit(1).cast("bigint")) == 1
        up = (below > to_midpoint) | ((below == to_midpoint) & odd)
        units = whole * F.lit(power).cast("bigint") + quotient + F.when(up, 1).otherwise(0)
        return F.when(v < 0, -units).otherwise(units).cast("double") / F.lit(float(power))

    return let(value, rounded)


def pick(bands: list[tuple[float, str]], fallback: str, score: Column) -> Column:
    """First label whose lower bound the score reaches."""
    (bound, label), *others = bands
    chain = F.when(score >= bound, F.lit(label))
    for bound, label in others:
        chain = chain.when(score >= bound, F.lit(label))
    return chain.otherwise(F.lit(fallback))
