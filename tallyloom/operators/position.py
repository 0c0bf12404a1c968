"""Exact positions and exact smallest-k without a single-task sort.

A position is the number of rows that come before. Rows are cut into segments
that follow the order; counts per segment are summed up (a small table), and
``row_number`` runs inside one segment only. Nothing is materialised and
nothing depends on partition numbers, so a re-run task gives the same answer.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions.ordering import HASH_BITS, id_segments
from tallyloom.operators.joins import HOT_ROWS, hot_keys, null_safe_join


def tag_hot(df: DataFrame, group: list[str], segments: list[Column], hot_rows: int) -> DataFrame:
    """Add ``__hot`` and ``__cell``, the unit of rows one task may sort.

    A group of up to ``hot_rows`` rows is one cell; a larger one is cut into its segments.
    """
    seg = [f"__seg{i}" for i in range(len(segments))]
    tagged = null_safe_join(df, hot_keys(df, group, hot_rows), group, "left").withColumn(
        "__hot", F.col("__parts").isNotNull()
    ).drop("__parts")
    parts = [F.when(F.col("__hot"), s).alias(n) for n, s in zip(seg, segments)]
    return tagged.withColumn("__cell", F.struct(*group, *parts))


def dense_position(
    df: DataFrame,
    order: list[str],
    segments: list[Column],
    group: tuple[str, ...] = (),
    name: str = "pos",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the 0-based position of every row in ``order`` (within ``group``).

    ``segments`` run from coarse to fine; each must never decrease along
    ``order``, and rows of one fine segment are sorted in one task. ``order``
    must identify a row, so that the result does not depend on partitioning.
    Without a group everything is segmented; with one, only large groups are.
    """
    group = list(group)
    seg = [f"__seg{i}" for i in range(len(segments))]
    if group:
        tagged = tag_hot(df, group, segments, hot_rows)
        large = tagged.filter("__hot")
    else:
        # One struct key per segment: equal structs match even where a field is null.
        tagged = df.withColumn("__cell", F.struct(*[s.alias(n) for n, s in zip(seg, segments)]))
        large = tagged

    counts = large.groupBy("__cell").agg(F.count(F.lit(1)).alias("__rows"))
    levels = counts.select(*[F.col("__cell")[c].alias(c) for c in group + seg], "__rows")
    offsets = _prefix(levels, group, seg).select(F.struct(*group, *seg).alias("__cell"), "__before")

    # The window leaves rows partitioned and sorted by cell, just as the join needs them.
    inside = Window.partitionBy("__cell").orderBy(*order)
    ranked = tagged.withColumn("__rn", F.row_number().over(inside))
    return (
        ranked.join(offsets, "__cell", "left" if group else "inner")
        .withColumn(name, F.coalesce("__before", F.lit(0)) + F.col("__rn") - F.lit(1))
        .drop("__before", "__rn", "__cell", "__hot")
    )


def _prefix(counts: DataFrame, group: list[str], seg: list[str]) -> DataFrame:
    """Rows before each segment, summed level by level so no window grows with the table."""
    *parent, last = seg
    scope = [F.col(c) for c in group + parent] or [F.lit(0)]
    earlier = (
        Window.partitionBy(*scope).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    if not parent:
        return inner.drop("__rows")
    totals = counts.groupBy(*group, *parent).agg(F.sum("__rows").alias("__rows"))
    outer = _prefix(totals, group, parent).withColumnRenamed("__before", "__outer")
    return null_safe_join(inner, outer, group + parent).select(
        *group, *seg, (F.col("__before") + F.col("__outer")).alias("__before")
    )


def position_by_id(df: DataFrame, row_id: str, name: str = "pos", fine_bits: int = 13) -> DataFrame:
    """Dense position by a unique bigint id."""
    return dense_position(df, [row_id], id_segments(F.col(row_id), fine_bits=fine_bits), name=name)


def smallest_k_threshold(keys: DataFrame, k: Column) -> Column:
    """The (key, id) pair ranked ``k`` (1-based) as a scalar struct; null if there is none.

    ``keys`` holds a 60-bit seeded ``key`` and a unique ``id``. One pass counts
    the top 16 bits; only the bucket holding the boundary is ranked.
    """
    top = keys.select(F.shiftright("key", HASH_BITS - 16).alias("top"), "key", "id")
    counts = top.groupBy("top").agg(F.count(F.lit(1)).alias("rows"))
    running = Window.partitionBy(F.lit(0)).orderBy("top")  # at most 65,536 counts
    boundary = (
        counts.withColumn("upto", F.sum("rows").over(running))
        .filter((F.col("upto") >= k) & (F.col("upto") - F.col("rows") < k))
        .select(F.struct("top", (k - F.col("upto") + F.col("rows")).alias("need")).alias("b"))
    )
    b = boundary.scalar()
    inside = Window.partitionBy("top").orderBy("key", "id")
    return (
        top.filter(F.col("top") == b["top"])
        .withColumn("rank", F.row_number().over(inside))
        .filter(F.col("rank") == b["need"])
        .select(F.struct("key", "id").alias("t"))
        .scalar()
    )


def within_smallest_k(key: Column, row_id: Column, threshold: Column, k: Column, total: Column) -> Column:
    """Whether a row is among the k smallest (key, id); a plain filter, no shuffle of the rows."""
    at_or_below = (key < threshold["key"]) | ((key == threshold["key"]) & (row_id <= threshold["id"]))
    return F.when(k >= total, F.lit(True)).otherwise(F.coalesce(at_or_below, F.lit(False)))
