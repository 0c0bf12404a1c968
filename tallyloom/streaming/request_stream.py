"""Request metrics while stream lines arrive.

A request is one session of the log: it is closed, and reported once, when the
watermark has passed its last line by ``idle``. Until then its lines may come
in any order and in any number of triggers. The state holds open requests
only, with what is needed of each line; lines behind the watermark are left
out and counted by the query's progress.
"""

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators.requests import derive
from tallyloom.sources.stream_log import is_data_line, is_end, payload, token_fields


def read_lines(lines: DataFrame) -> DataFrame:
    """Each line with its decoded fields; the JSON of a line is parsed once."""
    data = is_data_line(F.col("line")) & ~is_end(F.col("line"))
    chunk = lines.withColumn("chunk", F.when(data, F.try_parse_json(payload(F.col("line")))))
    fields = {n: F.when(F.col("chunk").isNotNull(), c) for n, c in token_fields(F.col("chunk")).items()}
    return chunk.withColumns({**fields, "chunk": F.col("chunk").isNotNull(), "end": F.coalesce(is_end(F.col("line")), F.lit(False))}).drop("line")


def streamed_metrics(lines: DataFrame, time: str = "ts", idle: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Metrics of closed requests from a stream of (request_id, seq, micros, ts, line); a null request_id is no request."""
    read = read_lines(lines.withWatermark(time, late))
    line = F.struct("seq", "micros", "chunk", "has_token", "usage_tokens", "end")
    lines_of = F.collect_list(F.when(F.col("request_id").isNotNull(), line))
    sessions = read.groupBy(F.session_window(time, idle).alias("session"), "request_id").agg(lines_of.alias("lines"))
    # Asked of the lists: a filter on ids would go below the watermark, which then would not see all times.
    ordered = sessions.filter(F.size("lines") > 0).withColumn("lines", F.array_sort("lines"))
    ends = ordered.withColumn("ended", F.get(F.filter("lines", lambda x: x["end"]), F.lit(0)))
    own = ends.withColumn("chunks", F.filter("lines", lambda x: x["chunk"] & (F.col("ended").isNull() | (x["seq"] < F.col("ended.seq")))))
    texts, used = F.filter("chunks", lambda x: x["has_token"]), F.filter("chunks", lambda x: x["usage_tokens"].isNotNull())
    times = F.transform("lines", lambda x: x["micros"])
    counted = own.select(
        "request_id",
        F.array_min(times).alias("start_at"),
        F.coalesce("ended.micros", F.array_max(times)).alias("end_at"),
        F.array_min(F.transform(texts, lambda x: x["micros"])).alias("first_at"),
        F.size(texts).cast("bigint").alias("chunk_count"),
        F.try_element_at(used, F.lit(-1)).getField("usage_tokens").alias("usage_tokens"),
    )
    tokens = F.when(F.col("usage_tokens") > 0, F.col("usage_tokens")).otherwise(F.col("chunk_count"))
    return derive(counted.withColumn("output_tokens", tokens), "start_at", "first_at", "end_at", "output_tokens").select(
        "request_id", "ttft", "total_time", "output_tokens", "tokens_per_sec", "chunk_count"
    )
