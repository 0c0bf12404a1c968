"""Run reports from recorded request results."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.fixed_values import FAILURE_LIMIT
from tallyloom.operators import runs, summary
from tallyloom.operators.joins import null_safe_join
from tallyloom.sources import sinks


def run_report(
    spark: SparkSession,
    results: DataFrame,
    output: str,
    checkpoint: str,
    wall: DataFrame | None = None,
    limit: int = FAILURE_LIMIT,
) -> DataFrame:
    """Summaries of all finished levels of the recorded runs, written as results documents.

    ``results`` has the four guard columns, level, micros, request_id and the
    result columns. Levels found in a checkpoint of the same settings are
    taken from there. A run that was cut off keeps its finished levels as a
    checkpoint, together with those kept there before, and gets no results
    document; the checkpoint goes when every
    run is finished.
    """
    keys = [*runs.GUARD, "level"]
    ended = runs.cut_off(results, runs.GUARD, "level", "micros", "request_id", limit)
    finished = ended.filter(F.col("outcome") == "completed").select(*keys)
    fresh = summary.summarize(null_safe_join(results, finished, keys, "left_semi"), keys, wall)
    stored = sinks.read_checkpoint(spark, checkpoint)
    if stored is not None:
        known = runs.resume(ended.select(*keys), stored).filter(F.col("action") == "reused").select(*keys, "summary.*")
        fresh = null_safe_join(fresh, known.select(*keys), keys, "left_anti").unionByName(known)
    cut = ended.filter(F.col("outcome") != "completed")
    if stored is not None:
        cut = null_safe_join(cut, known.select(*keys), keys, "left_anti")
    if cut.isEmpty():
        sinks.finish_run(spark, fresh, output, checkpoint, runs.GUARD)
        return spark.read.json(output).select("model", F.explode("results").alias("r")).select("model", "r.*")
    every = fresh
    if stored is not None:
        # Levels of these settings that this run did not come to stay; other settings start afresh.
        old = stored.select(*runs.GUARD, F.explode("completed").alias("level", "summary"))
        old = old.withColumn("level", F.col("level").cast(fresh.schema["level"].dataType)).select(*keys, "summary.*")
        old = null_safe_join(old, ended.select(*runs.GUARD).distinct(), runs.GUARD, "left_semi")
        every = fresh.unionByName(null_safe_join(old, fresh.select(*keys), keys, "left_anti"))
    sinks.write_checkpoint(every, checkpoint, runs.GUARD)
    # What was read from the old checkpoint is read from the new one from here on.
    levels = sinks.read_checkpoint(spark, checkpoint).select(*runs.GUARD, F.explode("completed").alias("level", "summary"))
    return levels.withColumn("level", F.col("level").cast(fresh.schema["level"].dataType)).select(*keys, "summary.*")
