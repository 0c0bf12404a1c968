"""Exact order statistics per group in one lazy plan, with no group sorted as a whole.

Values are counted once (equal values collapse map-side). A histogram over an
order-preserving bucket of the value, some 11,000 for each factor of two, says
in which bucket a wanted rank lies; only that bucket's distinct values are
ranked. The counts are one exchange that both steps read, spread by value, so a
group with most rows of the table loads no task; histograms are merged from
partial counts.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.operators.joins import null_safe_join

#: Buckets for each factor e of the value.
FINENESS = 16_384
#: Above all buckets of finite values.
INFINITE, NOT_A_NUMBER = 2**40, 2**41

#: 0-based rank as a function of the group size
Rank = Callable[[Column], Column]

MEDIAN: dict[str, Rank] = {
    "lo": lambda n: F.floor((n - 1) / 2),
    "hi": lambda n: F.floor(n / 2),
}


def index_rank(fraction: float) -> Rank:
    """0-based index ``min(n-1, int(n*fraction))``."""
    return lambda n: F.least(n - 1, F.floor(n.cast("double") * F.lit(fraction)))


def bucket(value: Column) -> Column:
    """A bigint that never decreases along the order of doubles, NaN being the largest; ln is semi-monotonic."""
    size = F.abs(value)
    step = F.floor(F.log(size) * F.lit(float(FINENESS))).cast("bigint") + F.lit(2**30)  # ln of a double is above -746
    finite = F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0))
    infinite = F.when(value > 0, F.lit(INFINITE)).otherwise(F.lit(-INFINITE))
    return F.when(F.isnan(value), F.lit(NOT_A_NUMBER)).when(size == float("inf"), infinite).otherwise(finite).cast("bigint")


def order_statistics(
    df: DataFrame,
    keys: list[str],
    measures: list[str],
    ranks: dict[str, Rank],
    totals: list[Column] | None = None,
) -> DataFrame:
    """One row per group: ``totals`` and, as ``<measure>_<rank>``, the exact elements at the ranks.

    Null values are left out. The input is read twice, for the totals and for
    the counts; nothing runs while the plan is built.
    """
    held = F.array(*[F.struct(F.lit(i).alias("measure"), F.col(m).cast("double").alias("value")) for i, m in enumerate(measures)])
    values = (
        df.select(*keys, F.explode(F.filter(held, lambda h: h["value"].isNotNull())).alias("h"))
        .groupBy(*keys, "h.measure", "h.value")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("bucket", bucket(F.col("value")))
    )
    return null_safe_join(df.groupBy(*keys).agg(*(totals or [F.count(F.lit(1)).alias("__rows")])), _picked(values, keys, measures, ranks), keys, "left").drop("__rows")


def weighted_statistics(values: DataFrame, keys: list[str], measure: str, weight: str, ranks: dict[str, Rank]) -> DataFrame:
    """The same from (keys, value, weight) rows, such as the counts of values that a stream keeps."""
    counted = (
        values.filter(F.col(measure).isNotNull())
        .groupBy(*keys, F.lit(0).alias("measure"), F.col(measure).cast("double").alias("value"))
        .agg(F.sum(weight).alias("rows"))
        .withColumn("bucket", bucket(F.col("value")))
    )
    return _picked(counted, keys, [measure], ranks)


def _picked(values: DataFrame, keys: list[str], measures: list[str], ranks: dict[str, Rank]) -> DataFrame:
    """(keys, measure, value, rows, bucket) -> one row per group with all its elements at the ranks."""
    group = [*keys, "measure"]
    upto = lambda by, order: F.sum("rows").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("bigint").alias("at")) for name, rank in ranks.items()])
    within = lambda at: (at < F.col("upto")) & (at >= F.col("upto") - F.col("rows"))
    histogram = values.groupBy(*group, "bucket").agg(F.sum("rows").alias("rows"))
    located = (
        histogram.withColumns({"upto": upto(group, "bucket"), "n": F.sum("rows").over(Window.partitionBy(*group))})
        .withColumn("wanted", F.filter(wanted, lambda w: within(w["at"])))
        .filter(F.size("wanted") > 0)
        .select(*group, "bucket", F.transform("wanted", lambda w: F.struct(w["name"].alias("name"), (w["at"] - F.col("upto") + F.col("rows")).alias("at"))).alias("wanted"))
    )
    ranked = null_safe_join(values, located, [*group, "bucket"]).withColumn("upto", upto([*group, "bucket"], "value"))
    found = ranked.select(*group, "value", F.explode(F.filter("wanted", lambda w: within(w["at"]))).alias("w"))
    return found.groupBy(*keys).agg(
        *[F.max(F.when((F.col("measure") == i) & (F.col("w.name") == r), F.col("value"))).alias(f"{m}_{r}") for i, m in enumerate(measures) for r in ranks]
    )
