"""Rounding and exact sums for reported numbers."""

from pyspark.sql import Column, functions as F

#: Measures are summed as decimals, so a sum does not depend on partitioning.
EXACT = "decimal(28,9)"
#: Cuts a double into two halves whose products with a power of ten are exact.
SPLIT = 134217729.0


def round_even(value: Column, digits: int) -> Column:
    """Decimal rounding of the exact binary value, exact ties to even.

    2.675 is stored slightly below its text, so it gives 2.67 although
    ``2.675 * 100`` comes out as 267.5. The rounding error of that product is
    recovered by splitting the number in two halves, and decides such cases.
    """
    scale = F.lit(float(10**digits))

    def exact(x: Column) -> Column:
        product = x * scale
        high = x * SPLIT - (x * SPLIT - x)
        error = (high * scale - product) + (x - high) * scale
        tie = product - F.floor(product) == 0.5
        nearest = (
            F.when(tie & (error > 0), F.ceil(product).cast("double"))
            .when(tie & (error < 0), F.floor(product).cast("double"))
            .otherwise(F.rint(product))
        )
        return nearest / scale

    return F.get(F.transform(F.array(value), exact), F.lit(0))


def exact_sum(value: Column) -> Column:
    """The same sum however rows are partitioned; with values that no decimal holds, their sum as doubles."""
    held = value.try_cast(EXACT)
    return F.when(F.count(held) == F.count(value), F.try_sum(held).cast("double")).otherwise(F.sum(value.cast("double")))


def exact_mean(value: Column) -> Column:
    return exact_sum(value) / F.count(value).cast("double")
