"""Duplicates in records that keep arriving.

Keys seen so far are kept for good, in runs: a run is a table of keys in hash
buckets, sorted inside each. The trigger numbered b reads the runs that the
binary digits of b name (of 6 = 4 + 2 the run of the first four triggers and
that of the next two) and writes one that takes in those which are complete with it.
There are never more runs than log2(b) + 1, a key is written again as often at
most, and which runs a trigger reads depends on its number alone, so a repeated
trigger gives the same result. Of each run only the buckets are read that keys of the trigger fall into.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.select import dedupe
from tallyloom.sources.files import delete, exists

#: Hash buckets of a run, each sorted by one task; the list of those that a trigger hits goes through the driver.
BUCKETS = 1024


def dedupe_within(stream: DataFrame, key: Column, time: str, horizon: str) -> DataFrame:
    """First arrival of each key within ``horizon``; the state forgets older keys."""
    return stream.withColumn("__key", key).withWatermark(time, horizon).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def runs_before(batch_id: int) -> list[tuple[int, int]]:
    """(first trigger, number of triggers) of the runs that hold all triggers before this one, the newest last."""
    runs, first = [], 0
    for bit in reversed(range(batch_id.bit_length())):
        if batch_id >> bit & 1:
            runs.append((first, 1 << bit))
            first += 1 << bit
    return runs


def completed_by(batch_id: int) -> list[tuple[int, int]]:
    """The runs among those that form one run of twice the size, and so on, with this trigger."""
    ones = (batch_id + 1 & -(batch_id + 1)).bit_length() - 1
    return runs_before(batch_id)[len(runs_before(batch_id)) - ones :] if ones else []


def _name(keys: str, run: tuple[int, int]) -> str:
    return f"{keys}/first={run[0]}-count={run[1]}"


def _read(spark: SparkSession, keys: str, runs: list[tuple[int, int]], buckets: list[int] | None = None) -> DataFrame:
    """Keys of some runs, of some buckets only."""
    rows = spark.createDataFrame([], "__key binary, bucket int")
    for run in runs:
        rows = rows.unionByName(spark.read.schema("__key binary, bucket int").parquet(_name(keys, run)))
    return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))


def write_deduped(
    stream: DataFrame, key: Column, pos: str, output: str, keys: str, checkpoint: str, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep the first arrival of each key for good; a trigger's own copies are ranked by ``pos``.

    ``key`` is the hexadecimal text of a hash. The stream runs until the files
    present have been read. ``buckets`` must stay the same for a stream.
    """
    bucket = F.pmod(F.xxhash64("__key"), F.lit(buckets)).cast("int")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = dedupe(batch, key, pos).withColumn("__key", F.unhex(key)).withColumn("bucket", bucket)
        if batch_id:
            hit = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # a number for each bucket at most
            own = own.join(_read(spark, keys, runs_before(batch_id), hit), ["bucket", "__key"], "left_anti")
        own.drop("__key", "bucket").write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        kept = spark.read.schema(batch.schema).parquet(f"{output}/batch={batch_id}")
        new = kept.select(F.unhex(key).alias("__key")).withColumn("bucket", bucket)
        merged = completed_by(batch_id)
        run = (merged[0][0] if merged else batch_id, 2 ** len(merged))
        rows = new.unionByName(_read(spark, keys, merged))
        rows.repartition("bucket").sortWithinPartitions("bucket", "__key").write.mode("overwrite").partitionBy("bucket").parquet(_name(keys, run))
        if batch_id:  # a repeat of this trigger doesn't read what only the one before needed
            for old in set(runs_before(batch_id - 1)) - set(runs_before(batch_id)) - {run}:
                if exists(spark, _name(keys, old)):
                    delete(spark, _name(keys, old))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
