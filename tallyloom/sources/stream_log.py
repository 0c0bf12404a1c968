"""Recorded server streams: one row per line, (request_id, seq, micros, line)."""

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.fixed_values import STREAM_END, STREAM_PREFIX
from tallyloom.functions.text import field, is_empty, strip
from tallyloom.operators.joins import spread_join


def is_data_line(line: Column) -> Column:
    return line.startswith(STREAM_PREFIX)


def payload(line: Column) -> Column:
    return F.substring(line, len(STREAM_PREFIX) + 1, 2**31 - 1)


def is_end(line: Column) -> Column:
    return is_data_line(line) & (strip(payload(line)) == STREAM_END)


def token_fields(chunk: Column) -> dict[str, Column]:
    """``has_token`` and ``usage_tokens`` of a decoded chunk."""
    delta = F.try_variant_get(chunk, "$.choices[0].delta", "variant")
    text = lambda key: ~is_empty(field(delta, key))
    usage = F.try_variant_get(chunk, "$.usage.completion_tokens", "bigint")
    return {
        "has_token": text("content") | text("reasoning_content") | text("reasoning"),
        "usage_tokens": usage,
    }


def parse_stream(lines: DataFrame) -> DataFrame:
    """Decoded chunks before the first end marker of each request.

    The end positions are one row per request; a request with very many lines
    is split over tasks when its lines are joined to them. Lines of a request are
    counted as they stand, so each is decoded once.
    """
    data = lines.filter(is_data_line(F.col("line")))
    ends = (
        data.filter(is_end(F.col("line"))).groupBy("request_id").agg(F.min("seq").alias("end_seq"))
    )
    decoded = (
        data.filter(~is_end(F.col("line")))
        .withColumn("chunk", F.try_parse_json(payload(F.col("line"))))
        .filter(F.col("chunk").isNotNull())
        .withColumns(token_fields(F.col("chunk")))
        .drop("chunk", "line")
    )
    return (
        spread_join(decoded, ends, ["request_id"], "seq", "left", counted=lines)
        .filter(F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq")))
        .drop("end_seq")
    )
