"""Request plans, failure cut-off, resume and leaderboard."""

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.functions.fixed_values import ABORTED_REQUEST, FAILURE_LIMIT
from tallyloom.operators.joins import null_safe_join, spread_join, stage
from tallyloom.operators.position import position_by_id
from tallyloom.operators.select import row_count


def request_plan(prompts: DataFrame, levels: list[int], prompt_id: str, num_requests: int = 0) -> DataFrame:
    """(level, request_no, prompt): request i uses prompt ``i mod prompts``.

    Without a number, a level gets ``max(prompts, 2 * level)`` requests. Each
    prompt row produces its own requests, so nothing is joined.
    """
    placed = position_by_id(prompts, prompt_id, "__at")
    total = row_count(prompts)
    wanted = F.lit(num_requests) if num_requests > 0 else F.greatest(total, 2 * F.col("level"))
    last = wanted.cast("bigint") - 1
    return (
        placed.withColumn("level", F.explode(F.array(*[F.lit(x).cast("bigint") for x in levels])))
        .filter(F.col("__at") <= last)
        .withColumn("request_no", F.explode(F.sequence(F.col("__at"), last, total)))
        .drop("__at")
    )


# --- failure cut-off ---------------------------------------------------------


def failure_runs(df: DataFrame, group: list[str], micros: str, row_id: str, ranges: int | None = None) -> DataFrame:
    """(group, micros, row_id, success, streak): consecutive failures ending at each row, 0 on success.

    A segmented scan. Rows are cut into ranges of like size along (group, time,
    id), wherever the rows are, so also inside one minute of one group; each
    range is scanned by itself. What a range does to a group is summed up
    (its rows, its trailing failures, whether it has a success), and these
    summaries, one row per range and group, are composed along the ranges.
    """
    rows = df.select(*group, micros, row_id, "success")
    order = [*group, micros, row_id]
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    # Ranges come from a sample; written down, all that follows sees the same ones.
    cut = stage(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    cell = ["__range", *group]
    inside = Window.partitionBy(*cell).orderBy(micros, row_id)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        cut.withColumn("__rn", F.row_number().over(inside))
        .withColumn("__last_ok", F.coalesce(F.max(F.when(F.col("success"), F.col("__rn"))).over(upto), F.lit(0)))
        .withColumn("__run", F.col("__rn") - F.col("__last_ok"))
    )
    joined = null_safe_join(local, _carried_failures(local, cell, group), cell, "left")
    carry = F.when(F.col("__last_ok") == 0, F.coalesce("__carry", F.lit(0))).otherwise(F.lit(0))
    return joined.select(*order, "success", (F.col("__run") + carry).alias("streak"))


def _carried_failures(local: DataFrame, cell: list[str], group: list[str]) -> DataFrame:
    """Failures of the group running into each range from the ones before it."""
    ends = local.groupBy(*cell).agg(F.max_by("__run", "__rn").alias("trailing"), F.max("__last_ok").alias("last_ok"))
    along = Window.partitionBy(*group).orderBy("__range")  # one row per range
    block = F.sum((F.col("last_ok") > 0).cast("bigint")).over(along)
    chained = ends.withColumn("block", block).withColumn(
        "out", F.sum("trailing").over(Window.partitionBy(*group, "block").orderBy("__range"))
    )
    return chained.select(*cell, F.lag("out", 1, 0).over(along).alias("__carry"))


def cut_off(
    df: DataFrame,
    run: list[str],
    level: str,
    micros: str,
    row_id: str,
    limit: int = FAILURE_LIMIT,
    ranges: int | None = None,
) -> DataFrame:
    """One row per (run, level): completed, aborted or not_run, with the aborting request.

    A level aborts at its ``limit``-th failure in a row; later levels of the
    run do not start. ``done`` counts the requests up to the abort,
    ``unstarted`` those behind it. An aborted level has no summary.
    """
    keys = [*run, level]
    at = F.struct(F.col(micros).alias("micros"), F.col(row_id).alias("id"))
    streaks = failure_runs(df, keys, micros, row_id, ranges)
    aborts = streaks.filter(F.col("streak") >= limit).groupBy(*keys).agg(F.min(at).alias("abort"))
    first = aborts.groupBy(*run).agg(F.min(level).alias("__stop"))
    marked = spread_join(streaks.select(*keys, micros, row_id), aborts, keys, row_id, "left")
    counted = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("abort").isNull() | (at <= F.col("abort"))).alias("done"),
        F.max("abort.id").alias("abort_id"),
    )
    started = F.col("__stop").isNull() | (F.col(level) <= F.col("__stop"))
    return null_safe_join(counted, first, run, "left").select(
        *keys,
        F.when(~started, "not_run").when(F.col("abort_id").isNotNull(), "aborted").otherwise("completed").alias("outcome"),
        F.when(started, F.col("abort_id")).alias("abort_id"),
        F.when(started, F.col("done")).otherwise(F.lit(0)).cast("bigint").alias("done"),
        F.when(started, F.col("requests") - F.col("done")).otherwise(F.col("requests")).alias("unstarted"),
    )


def apply_cut_off(df: DataFrame, run: list[str], level: str, micros: str, row_id: str, limit: int = FAILURE_LIMIT) -> DataFrame:
    """Result rows as a cut-off run leaves them.

    Levels that never ran are dropped; requests behind an abort become
    failures with zero metrics.
    """
    keys = [*run, level]
    outcome = cut_off(df, run, level, micros, row_id, limit).filter(F.col("outcome") != "not_run")
    stops = null_safe_join(
        outcome.select(*keys, "abort_id"),
        df.select(*keys, F.col(row_id).alias("abort_id"), F.col(micros).alias("__abort_at")),
        [*keys, "abort_id"],
        "left",
    )
    rows = spread_join(df, stops, keys, row_id)
    behind = F.coalesce(
        F.struct(micros, row_id) > F.struct(F.col("__abort_at").alias(micros), F.col("abort_id").alias(row_id)),
        F.lit(False),
    ) & F.col("abort_id").isNotNull()
    return rows.withColumn("__behind", behind).withColumns(
        {
            "success": F.col("success") & ~F.col("__behind"),
            "error": F.when(F.col("__behind"), F.lit(ABORTED_REQUEST)).otherwise(F.col("error")),
            **{
                c: F.when(F.col("__behind"), F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c))
                for c in ("ttft", "total_time", "output_tokens", "tokens_per_sec")
                if c in df.columns
            },
        }
    ).drop("__behind", "__abort_at", "abort_id")


# --- resume and leaderboard --------------------------------------------------

GUARD = ["model", "num_requests", "max_tokens", "temperature"]


def resume(plan: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Plan rows with ``action`` = reused | run and, when reused, the stored ``summary``.

    ``checkpoint`` has the four guard columns and ``completed``, a map from
    level (as text) to summary. Nothing is reused unless all four agree.
    """
    stored = checkpoint.select(*GUARD, F.explode("completed").alias("__level", "summary")).withColumn(
        "level", F.col("__level").try_cast("bigint")
    )
    return null_safe_join(plan, stored.drop("__level"), [*GUARD, "level"], "left").withColumn(
        "action", F.when(F.col("summary").isNotNull(), "reused").otherwise("run")
    )


def leaderboard(models: DataFrame, summaries: DataFrame, completed: DataFrame) -> DataFrame:
    """Display row per model not yet completed.

    ``models`` has (model, started, has_document). The first level counts; a
    summary that holds only an error shows zeros and still is a success, an
    empty document shows N/A.
    """
    metrics = {"ttft_avg": ("ttft_avg_ms", "%.1fms"), "tps_request": ("tps_per_request_avg", "%.2f t/s"), "tps_aggregate": ("tps_aggregate", "%.2f t/s")}
    first = summaries.groupBy("model").agg(
        F.min_by(F.struct(*[c for c, _ in metrics.values()]), "level").alias("first")
    )
    rows = models.join(completed, "model", "left_anti").join(first, "model", "left")
    shown = F.col("started") & F.col("has_document") & F.col("first").isNotNull()
    text = lambda c, form: F.when(
        shown, F.format_string(form, F.coalesce(F.col("first")[c], F.lit(0.0)))
    ).otherwise(F.lit("N/A"))
    return rows.select(
        "model",
        *[text(c, form).alias(name) for name, (c, form) in metrics.items()],
        F.when(~F.col("started"), "FAILED").when(~F.col("has_document"), "NO RESULTS").otherwise("SUCCESS").alias("status"),
    )
