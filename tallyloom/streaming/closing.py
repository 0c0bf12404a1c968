"""Runs over a finite log: everything comes out, and late rows are counted.

Windows and sessions close when the watermark passes them, so at the end of a
log some would stay open. A heartbeat, one row far in the future with nothing
but a time, is written to the stream's folder once all other files have been
read; the second run of the same query then closes everything.
"""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

#: Later than any row of a log.
HEARTBEAT = "2900-01-01 00:00:00"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has left out because they came behind the watermark; 0 only if there were none.

    Spark counts what reaches the state, so late rows of one group in one task count once.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def write_heartbeat(spark: SparkSession, folder: str, schema, time: str) -> None:
    """Append the heartbeat to a folder of Parquet files that a stream reads."""
    values = [F.lit(HEARTBEAT).cast(f.dataType) if f.name == time else F.lit(None).cast(f.dataType) for f in schema.fields]
    names = [f.name for f in schema.fields]
    spark.range(1).select(*[v.alias(n) for v, n in zip(values, names, strict=True)]).coalesce(1).write.mode("append").parquet(folder)


def run_to_end(start: Callable[[], StreamingQuery], spark: SparkSession, folder: str, schema, time: str) -> int:
    """Run a query over all files of ``folder``, then over the heartbeat; returns how many rows came late.

    ``start`` starts the query anew with the same checkpoint, reading what is
    there (``availableNow``).
    """
    late = 0
    for beat in (False, True):
        if beat:
            write_heartbeat(spark, folder, schema, time)
        query = start()
        query.awaitTermination()
        late += late_rows(query)
    return late


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which custom stateful steps need; the session's setting is put back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def to_files(stream: DataFrame, path: str) -> StreamingQuery:
    """Start an append query that writes to ``path/rows``."""
    with state_on_disk(stream.sparkSession):
        return stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
