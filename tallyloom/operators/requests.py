"""Metrics of single requests."""

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.sources.stream_log import is_end, parse_stream

SECOND = 1_000_000.0


def derive(df: DataFrame, start: str, first: str, end: str, tokens: str) -> DataFrame:
    """Add ttft, total_time and tokens_per_sec from times in microseconds.

    Without a first token the whole request counts as waiting time.
    """
    first_at = F.coalesce(F.col(first), F.col(end))
    generation = F.col(end) - first_at
    return df.withColumns(
        {
            "ttft": (first_at - F.col(start)) / F.lit(SECOND),
            "total_time": (F.col(end) - F.col(start)) / F.lit(SECOND),
            "tokens_per_sec": rate(F.col(tokens), generation / F.lit(SECOND)),
        }
    )


def rate(tokens: Column, seconds: Column) -> Column:
    """Tokens per second, 0 when no time passed."""
    return F.when(seconds > 0, tokens.cast("double") / seconds).otherwise(F.lit(0.0))


def request_metrics(lines: DataFrame) -> DataFrame:
    """One row per request from its stream lines.

    A request runs from its first line to its end marker (to its last line if
    there is none). Reported usage counts as the token number when positive,
    else the chunks that carried text.
    """
    chunks = (
        parse_stream(lines)
        .groupBy("request_id")
        .agg(
            F.min(F.when(F.col("has_token"), F.col("micros"))).alias("first_at"),
            F.count_if("has_token").alias("chunk_count"),
            F.max_by("usage_tokens", F.when(F.col("usage_tokens").isNotNull(), F.col("seq"))).alias("usage_tokens"),
        )
    )
    spans = lines.groupBy("request_id").agg(
        F.min("micros").alias("start_at"),
        F.coalesce(
            F.min_by("micros", F.when(is_end(F.col("line")), F.col("seq"))), F.max("micros")
        ).alias("end_at"),
    )
    joined = spans.join(chunks, "request_id", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0).cast("bigint"))
    )
    tokens = F.when(F.col("usage_tokens") > 0, F.col("usage_tokens")).otherwise(F.col("chunk_count"))
    return derive(joined.withColumn("output_tokens", tokens), "start_at", "first_at", "end_at", "output_tokens").select(
        "request_id", "ttft", "total_time", "output_tokens", "tokens_per_sec", "chunk_count"
    )


def as_results(df: DataFrame) -> DataFrame:
    """Result rows from (ttft, total_time, output_tokens, success, error).

    A failed request keeps its total time and its error text; everything else is zero.
    """
    ok = F.col("success")
    return df.withColumns(
        {
            "ttft": F.when(ok, F.col("ttft")).otherwise(F.lit(0.0)),
            "output_tokens": F.when(ok, F.col("output_tokens")).otherwise(F.lit(0)).cast("bigint"),
            "tokens_per_sec": F.when(
                ok, rate(F.col("output_tokens"), F.col("total_time") - F.col("ttft"))
            ).otherwise(F.lit(0.0)),
            "error": F.when(~ok, F.col("error")),
        }
    )


def status_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests_total"),
        F.count_if("success").alias("requests_ok"),
        F.count_if(~F.col("success")).alias("requests_failed"),
    )
