"""Joins that hold when one key has a large share of the rows."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallyloom.sources.files import scratch_dir

#: A key with more rows than this is split into parts.
HOT_ROWS = 1_000_000
#: A list of at most this many ids is broadcast.
BROADCAST_ROWS = 100_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; the right copies are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__r_{k}" for k in keys])


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """(keys, __parts) of the keys with more than ``hot_rows`` rows.

    There are at most rows / hot_rows of them, so the list is small enough to
    broadcast whatever the table's size.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    parts = F.ceil(F.col("__rows") / F.lit(hot_rows)).cast("int").alias("__parts")
    return F.broadcast(counts.filter(F.col("__rows") > hot_rows).select(*keys, parts))


def spread_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    spread: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to a table with one row per key; rows of a hot key go to several tasks.

    A hot key's rows are dealt out by the hash of the ``spread`` column and its
    table row is repeated once per part. ``counted`` are the rows to count keys
    in, where ``rows`` are dear to make and come from these.
    """
    hot = hot_keys(rows if counted is None else counted, keys, hot_rows)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = null_safe_join(rows, hot, keys, "left").withColumn(
        "__part", F.pmod(F.xxhash64(spread), parts).cast("int")
    )
    repeated = null_safe_join(table, hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return null_safe_join(dealt.drop("__parts"), repeated.drop("__parts"), [*keys, "__part"], how).drop("__part")


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a small table to the shared scratch folder and read it back, so its size is known."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
