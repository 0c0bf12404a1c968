"""Ordered aggregation of turn rows into one row per conversation.

A conversation is put together in two steps: turns of one segment (at most
``SEGMENT`` unique turn numbers), then the finished segments. No task ever
sorts a whole conversation turn by turn, and a very long conversation is
spread over many tasks before its one result row is formed.
"""

from pyspark.sql import Column, DataFrame, functions as F

SEGMENT = 256


def ordered_join(
    df: DataFrame, keys: list[str], order: str, parts: dict[str, tuple[Column, str]]
) -> DataFrame:
    """One text per key and part: non-empty texts in ``order``, joined by a separator.

    ``parts`` maps an output column to (text or null to skip, separator).
    """
    tagged = df.select(*keys, F.col(order).alias("__ord"), *[c.alias(n) for n, (c, _) in parts.items()])
    tagged = tagged.withColumn("__seg", F.floor(F.col("__ord") / SEGMENT).cast("bigint"))

    def joined(position: str, name: str, separator: str) -> Column:
        filled = F.when(F.col(name) != "", F.struct(F.col(position).alias("o"), F.col(name).alias("t")))
        ordered = F.array_sort(F.collect_list(filled))
        return F.array_join(F.transform(ordered, lambda x: x["t"]), separator).alias(name)

    pieces = tagged.groupBy(*keys, "__seg").agg(*[joined("__ord", n, s) for n, (_, s) in parts.items()])
    return pieces.groupBy(*keys).agg(*[joined("__seg", n, s) for n, (_, s) in parts.items()])


def ordered_messages(df: DataFrame, keys: list[str], order: str, role: str, text: str) -> DataFrame:
    """One ``messages`` array of (role, content) structs per key, in ``order``."""
    tagged = df.select(
        *keys,
        F.col(order).alias("o"),
        F.floor(F.col(order) / SEGMENT).cast("bigint").alias("__seg"),
        F.struct(F.col(role).alias("role"), F.col(text).alias("content")).alias("m"),
    )
    pieces = tagged.groupBy(*keys, "__seg").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "m"))), lambda x: x["m"]).alias("ms")
    )
    ordered = F.array_sort(F.collect_list(F.struct("__seg", "ms")))
    return pieces.groupBy(*keys).agg(
        F.flatten(F.transform(ordered, lambda x: x["ms"])).alias("messages")
    )
