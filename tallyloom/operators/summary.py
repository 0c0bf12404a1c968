"""Summaries of request results per level, and the tables shown from them."""

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.fixed_values import ALL_FAILED, P95
from tallyloom.functions.rounding import exact_mean, round_even
from tallyloom.operators.joins import null_safe_join
from tallyloom.operators.quantiles import MEDIAN, index_rank, order_statistics
from tallyloom.operators.requests import rate

METRICS = (
    "ttft_avg_ms",
    "ttft_median_ms",
    "ttft_p95_ms",
    "latency_avg_s",
    "latency_median_s",
    "tokens_per_resp_avg",
    "tokens_per_resp_total",
    "tps_per_request_avg",
    "tps_aggregate",
)


def p95_index(df: DataFrame, keys: list[str], value: str, name: str = "p95") -> DataFrame:
    """Element at index ``min(n-1, int(n*0.95))`` of each group's sorted values."""
    return order_statistics(df, keys, [value], {"p95": index_rank(P95)}).withColumnRenamed(f"{value}_p95", name)


def elapsed(wall: Column, longest: Column) -> tuple[Column, Column]:
    """(seconds, basis): measured wall time if positive, else the longest request."""
    measured = F.coalesce(wall, F.lit(0.0)) > 0
    return (
        F.when(measured, wall).otherwise(longest),
        F.when(measured, F.lit("wall")).otherwise(F.lit("max_latency")),
    )


def with_wall(totals: DataFrame, keys: list[str], wall: DataFrame | None) -> DataFrame:
    """Join measured wall times, one ``wall_time`` per group, to the totals."""
    if wall is None:
        return totals.withColumn("wall_time", F.lit(None).cast("double"))
    return null_safe_join(totals, wall.select(*keys, "wall_time"), keys, "left")


def throughput(df: DataFrame, keys: list[str], wall: DataFrame | None = None) -> DataFrame:
    """Total tokens over elapsed time per group, with the basis used."""
    ok = F.col("success")
    totals = df.groupBy(*keys).agg(
        F.max(F.when(ok, F.col("total_time"))).alias("longest"),
        F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0)).alias("tokens"),
    )
    seconds, basis = elapsed(F.col("wall_time"), F.col("longest"))
    return with_wall(totals, keys, wall).select(
        *keys,
        F.col("tokens").alias("tokens_per_resp_total"),
        round_even(rate(F.col("tokens"), seconds), 2).alias("tps_aggregate"),
        basis.alias("basis"),
    )


def summarize(df: DataFrame, keys: list[str], wall: DataFrame | None = None) -> DataFrame:
    """One summary row per group of results.

    Metrics are over successful requests. A group without any has null metrics
    and an ``error``. ``wall`` has the measured ``wall_time`` of groups; without
    one the longest request stands in.
    """
    ok = F.col("success")
    only = lambda c: F.when(ok, F.col(c))
    totals = [
        F.count(F.lit(1)).alias("requests_total"),
        F.count_if(ok).alias("requests_ok"),
        F.count_if(~ok).alias("requests_failed"),
        exact_mean(only("ttft")).alias("ttft_mean"),
        exact_mean(only("total_time")).alias("latency_mean"),
        exact_mean(only("tokens_per_sec")).alias("tps_mean"),
        F.sum(only("output_tokens")).alias("tokens"),
        F.max(only("total_time")).alias("longest"),
    ]
    good = df.withColumns({"wait": only("ttft"), "latency": only("total_time")})
    stats = order_statistics(good, keys, ["wait", "latency"], {**MEDIAN, "p95": index_rank(P95)}, totals)
    middle = lambda m: (F.col(f"{m}_lo") + F.col(f"{m}_hi")) / F.lit(2.0)
    seconds, basis = elapsed(F.col("wall_time"), F.col("longest"))
    tokens = F.col("tokens")
    failed = F.col("requests_ok") == 0
    return with_wall(stats, keys, wall).select(
        *keys,
        "requests_total",
        "requests_ok",
        "requests_failed",
        round_even(F.col("ttft_mean") * 1000, 1).alias("ttft_avg_ms"),
        round_even(middle("wait") * 1000, 1).alias("ttft_median_ms"),
        round_even(F.col("wait_p95") * 1000, 1).alias("ttft_p95_ms"),
        round_even(F.col("latency_mean"), 3).alias("latency_avg_s"),
        round_even(middle("latency"), 3).alias("latency_median_s"),
        round_even(tokens.cast("double") / F.when(~failed, F.col("requests_ok")).cast("double"), 1).alias(
            "tokens_per_resp_avg"
        ),
        tokens.alias("tokens_per_resp_total"),
        round_even(F.col("tps_mean"), 2).alias("tps_per_request_avg"),
        F.when(~failed, round_even(rate(tokens, seconds), 2)).alias("tps_aggregate"),
        F.when(~failed, basis).alias("basis"),
        F.when(failed, F.lit(ALL_FAILED)).alias("error"),
    )


def comparison(summaries: DataFrame, run_keys: list[str], level: str = "level") -> DataFrame:
    """Display rows of runs with more than one level; levels that failed are left out."""
    several = (
        summaries.groupBy(*run_keys)
        .agg(F.count(F.lit(1)).alias("__levels"))
        .filter(F.col("__levels") > 1)
        .drop("__levels")
    )
    shown = null_safe_join(summaries.filter(F.col("error").isNull()), several, run_keys, "left_semi")
    text = lambda form, c: F.format_string(form, F.col(c))
    return shown.select(
        *run_keys,
        F.col(level),
        text("%.1fms", "ttft_avg_ms").alias("ttft_avg"),
        text("%.1fms", "ttft_p95_ms").alias("ttft_p95"),
        text("%.3fs", "latency_avg_s").alias("latency_avg"),
        text("%.1f", "tokens_per_resp_avg").alias("tokens_per_resp"),
        text("%.2f", "tps_per_request_avg").alias("tps_request"),
        text("%.2f", "tps_aggregate").alias("tps_aggregate"),
    ).orderBy(*run_keys, level)
