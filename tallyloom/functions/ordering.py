"""Ordering keys."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Number of bits of a seeded key.
HASH_BITS = 60


def seeded_key(row_id: Column, seed: int) -> Column:
    """Repeatable pseudo-random bigint in [0, 2**60) for a row id.

    The order of rows by this key depends on ``seed`` and the ids only, never
    on how the data is partitioned.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), row_id.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_segments(key: Column) -> list[Column]:
    """Coarse-to-fine segments of a seeded key: 65,536 x 256, evenly filled."""
    return [F.shiftright(key, HASH_BITS - 16), F.shiftright(key, HASH_BITS - 24)]


def id_segments(row_id: Column, fine_bits: int = 13, coarse_bits: int = 38) -> list[Column]:
    """Coarse-to-fine segments of a unique bigint.

    Uniqueness bounds a fine segment by 2**fine_bits rows, however the ids are
    spread. Both levels above it stay below 2**26 counts even for ids scattered
    over the whole range, and are tiny for running numbers.
    """
    row_id = row_id.cast("bigint")
    return [F.shiftright(row_id, coarse_bits), F.shiftright(row_id, fine_bits)]


def time_segments(micros: Column, fine_seconds: int = 60, coarse_seconds: int = 86_400) -> list[Column]:
    """Coarse-to-fine segments of a time in microseconds."""
    return [F.floor(micros / F.lit(s * 1_000_000)).cast("bigint") for s in (coarse_seconds, fine_seconds)]


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch, whatever the session time zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        quoted = f"`{name}`"
        return F.expr(
            f"CAST(CAST(CAST({quoted} - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND)"
            " AS DECIMAL(20,6)) * 1000000 AS BIGINT)"
        )
    return F.unix_micros(F.col(name))
