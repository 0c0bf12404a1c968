"""Row selection: union, duplicates, sampling, splitting, chunking."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from tallyloom.functions.fixed_values import (
    CHUNK_SIZE,
    KEY_INPUT,
    KEY_INSTRUCTION,
    KEY_OUTPUT,
    KEY_SEPARATOR,
    SAMPLE_LIMIT,
    SEED,
    VALIDATION_FRACTION,
)
from tallyloom.functions.ordering import hash_segments, seeded_key
from tallyloom.functions.text import first_truthy, stable_text
from tallyloom.operators.joins import BROADCAST_ROWS
from tallyloom.operators.position import (
    dense_position,
    position_by_id,
    smallest_k_threshold,
    within_smallest_k,
)

#: Up to this many rows the n-th id is found by a top-k of ids; beyond, from their positions.
TOP_K_ROWS = 10_000


def row_count(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery, evaluated inside the plan."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def union_sources(*sources: DataFrame) -> DataFrame:
    """Sources one after the other; columns are matched by name."""
    if not sources:
        raise ValueError("no sources to unite")
    return reduce(lambda a, b: a.unionByName(b), sources)


# --- duplicates --------------------------------------------------------------


def content_key(record: Column) -> Column:
    """SHA-256 over the stable texts of instruction, input and output.

    A record that is no object is hashed as a whole.
    """
    parts = [stable_text(first_truthy(record, keys)) for keys in (KEY_INSTRUCTION, KEY_INPUT, KEY_OUTPUT)]
    is_object = F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False))
    return F.sha2(F.when(is_object, F.concat_ws(KEY_SEPARATOR, *parts)).otherwise(stable_text(record)), 256)


def dedupe(df: DataFrame, key: Column, pos: str) -> DataFrame:
    """Keep the first row (by unique ``pos``) of each key.

    Only (key, pos) is aggregated, collapsing copies map-side, so a group of
    copies of any size costs one row per task. The rows themselves move once,
    by ``pos``, which no hot key can skew.
    """
    first = (
        df.select(F.unhex(key).alias("__key"), F.col(pos).alias("__pos"))
        .groupBy("__key")
        .agg(F.min("__pos").alias("__first"))
    )
    return df.join(first, df[pos] == first["__first"], "left_semi")


# --- sampling and ordering ---------------------------------------------------


def id_at(df: DataFrame, row_id: str, pos: Column) -> Column:
    """Id at a 0-based position in id order as a scalar; null past the end. Reads ids only."""
    placed = position_by_id(df.select(row_id), row_id, "__at")
    return placed.filter(F.col("__at") == pos).select(row_id).scalar()


def head(df: DataFrame, n: int, pos: str) -> DataFrame:
    """First ``n`` rows by the whole number ``pos``, in no order; all rows when ``n`` is 0 or less."""
    if not isinstance(df.schema[pos].dataType, IntegralType):
        raise TypeError(f"{pos} must be a whole number")
    if n <= 0:
        return df
    if n <= TOP_K_ROWS:
        last = df.select(pos).orderBy(pos).limit(n).agg(F.max(pos)).scalar()
    else:
        last = id_at(df, pos, F.lit(n - 1))
    return df.filter(F.coalesce(F.col(pos) <= last, F.lit(True)))


def shuffle(df: DataFrame, row_id: str, seed: int = SEED, name: str = "pos") -> DataFrame:
    """Add the position of each row in a seeded shuffle."""
    keyed = df.withColumn("__h", seeded_key(F.col(row_id), seed))
    return dense_position(keyed, ["__h", row_id], hash_segments(F.col("__h")), name=name).drop("__h")


def _chosen(df: DataFrame, row_id: str, seed: int, k: Column, total: Column) -> Column:
    """Whether a row is among the ``k`` smallest seeded keys."""
    key = seeded_key(F.col(row_id), seed)
    threshold = smallest_k_threshold(df.select(key.alias("key"), F.col(row_id).alias("id")), k)
    return within_smallest_k(key, F.col(row_id), threshold, k, total)


def sample_random(df: DataFrame, n: int = SAMPLE_LIMIT, row_id: str = "id", seed: int = SEED, name: str = "pos") -> DataFrame:
    """Exactly ``n`` rows (all if ``n`` <= 0 or too large) in seeded random order."""
    kept = df if n <= 0 else df.filter(_chosen(df, row_id, seed, F.lit(n), row_count(df)))
    return shuffle(kept, row_id, seed, name)


def sample_stride(df: DataFrame, n: int, row_id: str, name: str = "pos") -> DataFrame:
    """Rows at positions ``int(i * (size / n))`` for i < n; all rows if n <= 0 or n >= size.

    Positions are worked out on ids alone. One is tested by trying the few i
    that can produce it. The chosen ids, at most ``n``, then pick the rows.
    """
    placed = position_by_id(df.select(row_id), row_id, name)
    if n <= 0:
        return df.join(placed, row_id)
    size = row_count(df)
    step = size.cast("double") / F.lit(float(n))
    guess = F.floor(F.col(name) / step)
    hits = [
        (guess + d >= 0) & (guess + d < n) & (F.floor((guess + d).cast("double") * step) == F.col(name))
        for d in (-1, 0, 1, 2)
    ]
    chosen = placed.filter((F.lit(n) >= size) | reduce(lambda a, b: a | b, hits))
    return df.join(F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen, row_id)


# --- splitting and chunking --------------------------------------------------


def split(
    df: DataFrame,
    fraction: float = VALIDATION_FRACTION,
    row_id: str = "id",
    seed: int = SEED,
    shuffled: bool = True,
    max_train: int = 0,
    max_validation: int = 0,
) -> DataFrame:
    """Add ``split`` = train | validation; validation has ``ceil(fraction * n)`` rows.

    Without shuffling, validation is the tail. The caps keep the first rows of
    a split in shuffled order (or in id order) and apply after splitting.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    n = df.agg(
        F.when(F.count(F.lit(1)) < 2, F.raise_error(F.lit("a split needs at least 2 rows")).cast("bigint"))
        .otherwise(F.count(F.lit(1)))
        .alias("n")
    ).scalar()
    k = F.ceil(F.lit(float(fraction)) * n.cast("double"))
    if shuffled:
        held_out = _chosen(df, row_id, seed, k, n)
        tagged = df.withColumn("split", F.when(held_out, "validation").otherwise("train"))
    else:
        tail = F.col(row_id) >= id_at(df, row_id, n - k)
        tagged = df.withColumn("split", F.when(tail, "validation").otherwise("train"))
    for name, cap in (("train", max_train), ("validation", max_validation)):
        if cap > 0:
            part = tagged.filter(F.col("split") == name)
            kept = (
                part.filter(_chosen(part, row_id, seed, F.lit(cap), row_count(part)))
                if shuffled
                else head(part, cap, row_id)
            )
            tagged = tagged.filter(F.col("split") != name).unionByName(kept)
    return tagged


def chunk_count(n: Column, size: int = CHUNK_SIZE) -> Column:
    """Number of parts; one when chunking is off or everything fits into one part."""
    if size <= 0:
        return F.lit(1).cast("bigint")
    return F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("bigint")


def chunk_id(pos: Column, size: int = CHUNK_SIZE) -> Column:
    """1-based chunk of a dense position."""
    if size <= 0:
        return F.lit(1).cast("bigint")
    return (F.floor(pos / size) + 1).cast("bigint")


def chunk_label(part: Column, parts: Column) -> Column:
    """``partNNN``, at least three digits; ``""`` for a single part."""
    width = F.greatest(F.lit(3), F.length(parts.cast("string")))
    padded = F.lpad(part.cast("string"), width, F.lit("0"))
    return F.when(parts <= 1, F.lit("")).otherwise(F.concat(F.lit("part"), padded))
