"""Training plans, progress and checkpoints."""

import math

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.durations import interval_value
from tallyloom.functions.fixed_values import EFFECTIVE_BATCH
from tallyloom.functions.rounding import round_even
from tallyloom.operators.joins import spread_join


def accumulation_steps(effective: int = EFFECTIVE_BATCH, per_device: int = 1) -> int:
    return max(1, math.ceil(effective / per_device))


def training_plan(
    df: DataFrame,
    per_device: int = 1,
    world: int = 1,
    accumulation: int = EFFECTIVE_BATCH,
    epochs: float = 1.0,
    max_steps: int = -1,
    eval_interval: int | str | None = 1000,
    save_interval: int | str | None = 1000,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Steps, epochs and the number of evaluations and saves for the rows of ``df``."""
    batch = per_device * max(1, world) * accumulation
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("examples"))
    per_epoch = F.greatest(F.lit(1), F.ceil(F.col("examples") / F.lit(batch))).cast("bigint")
    steps = F.lit(max_steps) if max_steps > 0 else F.ceil(per_epoch.cast("double") * F.lit(float(epochs)))
    planned = steps / per_epoch if max_steps > 0 else F.lit(float(epochs))
    steps = F.greatest(F.lit(1), steps).cast("bigint")

    def times(interval):
        k = interval_value(F.lit(None if interval is None else str(interval)))
        return F.coalesce(F.floor(steps / F.when(k > 0, k)), F.lit(0)).cast("bigint")

    return counted.select(
        *keys,
        "examples",
        F.lit(batch).cast("bigint").alias("effective_batch"),
        per_epoch.alias("steps_per_epoch"),
        round_even(planned.cast("double"), 2).alias("planned_epochs"),
        steps.alias("total_steps"),
        times(eval_interval).alias("eval_count"),
        times(save_interval).alias("save_count"),
    )


def progress(df: DataFrame, run: str = "run_id", micros: str = "micros") -> DataFrame:
    """Add pct, elapsed_s and eta_s (seconds) per log row; rows with step or max <= 0 are left out.

    The run start is one aggregated row per run joined back, so that a very
    long run need not be gathered in one task.
    """
    starts = df.groupBy(run).agg(F.min(micros).alias("__start"))
    step, end = F.col("step").cast("double"), F.col("max_steps").cast("double")
    elapsed = (F.col(micros) - F.col("__start")) / F.lit(1_000_000.0)
    eta = elapsed * (end - step) / step
    logged = df.filter((F.col("step") > 0) & (F.col("max_steps") > 0))
    return (
        spread_join(logged, starts, [run], micros)
        .withColumns(
            {
                "pct": F.least(F.lit(100.0), F.lit(100.0) * step / end),
                "elapsed_s": elapsed,
                "eta_s": F.when(elapsed > 0, eta),
            }
        )
        .drop("__start")
    )


def checkpoint_step(path):
    """Trailing integer of a checkpoint path, 0 if it has none."""
    return F.coalesce(F.substring_index(path, "-", -1).try_cast("bigint"), F.lit(0))


def latest_checkpoint(df: DataFrame, run: str = "run_id", path: str = "path", seq: str = "seq") -> DataFrame:
    """Path named ``checkpoint-*`` with the highest step per run; of equal steps the last by ``seq``. Runs without one are left out."""
    named = df.filter(F.substring_index(F.rtrim(F.col(path), F.lit("/")), "/", -1).startswith("checkpoint-"))
    return named.groupBy(run).agg(
        F.max_by(path, F.struct(checkpoint_step(F.col(path)).alias("step"), F.col(seq).alias("seq"))).alias("path")
    )
