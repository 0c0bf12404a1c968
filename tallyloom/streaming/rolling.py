"""Rolling summaries and training progress on streams.

Measures that add up are kept per window. For exact medians and p95 the state
counts each value of a window, a row for each value, so that a window with most
of the log is spread over all state partitions.
"""

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.fixed_values import P95
from tallyloom.functions.rounding import exact_sum
from tallyloom.operators.quantiles import MEDIAN, index_rank, weighted_statistics


def rolling_summary(
    stream: DataFrame, keys: list[str], time: str = "ts", width: str = "1 day", late: str = "1 hour"
) -> DataFrame:
    """Additive level measures per tumbling window, emitted when the window is closed."""
    ok = F.col("success")
    only = lambda c: F.when(ok, F.col(c))
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("requests_total"),
            F.count_if(ok).alias("requests_ok"),
            exact_sum(only("ttft")).alias("ttft_sum"),
            exact_sum(only("total_time")).alias("latency_sum"),
            F.max(only("total_time")).alias("latency_max"),
            F.sum(only("output_tokens")).alias("tokens"),
        )
        .select(
            F.unix_micros("w.start").alias("window_start"),
            *keys,
            "requests_total",
            "requests_ok",
            "ttft_sum",
            "latency_sum",
            "latency_max",
            "tokens",
        )
    )


def rolling_counts(stream: DataFrame, keys: list[str], measure: str, time: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """How often each value of a measure of successful requests occurs per tumbling window, emitted when the window is closed."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys, measure)
    rows = counted.agg(F.count_if("success").alias("rows")).select(F.unix_micros("w.start").alias("window_start"), *keys, measure, "rows")
    # Asked of the counts: a filter on rows would go below the watermark, which then would not see all times.
    return rows.filter(F.col("rows") > 0)


def window_quantiles(counts: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Exact median and p95 of each closed window."""
    group = ["window_start", *keys]
    found = weighted_statistics(counts, group, measure, "rows", {**MEDIAN, "p95": index_rank(P95)})
    middle = (F.col(f"{measure}_lo") + F.col(f"{measure}_hi")) / F.lit(2.0)
    return found.select(*group, middle.alias(f"{measure}_median"), f"{measure}_p95")


def rolling_progress(stream: DataFrame, run: str = "run_id", micros: str = "micros") -> DataFrame:
    """Latest progress per run (update or complete mode); one state row per run."""
    logged = stream.filter((F.col("step") > 0) & (F.col("max_steps") > 0))
    latest = logged.groupBy(run).agg(
        F.min(micros).alias("start"),
        F.max(F.struct(F.col("step").alias("step"), F.col(micros).alias("at"), F.col("max_steps").alias("end"))).alias("last"),
    )
    step, end = F.col("last.step").cast("double"), F.col("last.end").cast("double")
    elapsed = (F.col("last.at") - F.col("start")) / F.lit(1_000_000.0)
    return latest.select(
        run,
        F.col("last.step").alias("step"),
        F.least(F.lit(100.0), F.lit(100.0) * step / end).alias("pct"),
        elapsed.alias("elapsed_s"),
        F.when(elapsed > 0, elapsed * (end - step) / step).alias("eta_s"),
    )
