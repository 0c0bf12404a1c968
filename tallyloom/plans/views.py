"""Views over the given tables in the shapes the operators work on."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions.fixed_values import PART_SEPARATOR
from tallyloom.functions.ordering import epoch_micros, time_segments
from tallyloom.functions.text import strip
from tallyloom.operators.joins import spread_join
from tallyloom.operators.position import dense_position
from tallyloom.operators.requests import as_results
from tallyloom.operators.turns import ordered_join, ordered_messages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def instr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instruction record per conversation; system turns are its input."""
    role, said = F.lower("role"), strip(F.col("text"))
    texts = ordered_join(
        table(spark, sf_dir, "conversations"),
        ["conv_id"],
        "turn",
        {
            "instruction": (F.when(role.isin("user", "human"), said), PART_SEPARATOR),
            "input": (F.when(role == "system", said), PART_SEPARATOR),
            "output": (F.when(role.isin("assistant", "gpt", "model"), said), PART_SEPARATOR),
        },
    )
    return texts.withColumnRenamed("conv_id", "id").withColumn("source_file", F.lit("conversations"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages) per conversation."""
    return ordered_messages(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text")


def alias_record() -> Column:
    """A document as a record whose field names depend on its language."""
    shapes = {
        "en": F.struct(F.col("text").alias("instruction"), F.col("source").alias("output")),
        "fr": F.struct(F.lit("").alias("instruction"), F.col("text").alias("prompt"), F.col("source").alias("context")),
        "de": F.struct(F.array().cast("array<string>").alias("prompt"), F.col("text").alias("question"), F.col("n_chars").alias("data")),
    }
    rest = F.struct(F.col("text").alias("task"), F.col("source").alias("answer"))
    record = F
    for lang, shape in shapes.items():
        record = record.when(F.col("lang") == lang, F.to_variant_object(shape))
    return record.otherwise(F.to_variant_object(rest))


def keyed_record() -> Column:
    """A document as a record with a text and a language under changing field names."""
    shapes = [
        F.struct(F.col("text").alias("instruction"), F.col("lang").alias("input")),
        F.struct(F.col("text").alias("prompt"), F.col("lang").alias("context")),
    ]
    rest = F.struct(F.lit(False).alias("instruction"), F.col("text").alias("question"), F.col("lang").alias("data"))
    kind = F.col("doc_id") % 3
    return (
        F.when(kind == 0, F.to_variant_object(shapes[0]))
        .when(kind == 1, F.to_variant_object(shapes[1]))
        .otherwise(F.to_variant_object(rest))
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request results: model and level by user, failures by type."""
    ev = table(spark, sf_dir, "events")
    waited = F.col("value") / F.lit(1000.0)
    raw = ev.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.expr("shiftleft(1L, CAST(user_id % 4 AS INT))").alias("level"),
        epoch_micros(ev, "ts").alias("micros"),
        (F.col("event_type") != "error").alias("success"),
        waited.alias("ttft"),
        (waited + _k().cast("double") / F.lit(10.0)).alias("total_time"),
        _k().alias("output_tokens"),
        F.lit("HTTP 500").alias("error"),
    )
    return as_results(raw)


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recorded stream lines, one request per user, closed by an end marker."""
    ev = table(spark, sf_dir, "events")
    ev = ev.select("event_id", "user_id", "event_type", epoch_micros(ev, "ts").alias("micros"), _k().cast("string").alias("k"))
    lines = dense_position(
        ev, ["micros", "event_id"], time_segments(F.col("micros"), 3600), group=("user_id",), name="seq"
    ).select(F.col("user_id").alias("request_id"), "seq", "micros", stream_line().alias("line"))
    ends = ev.groupBy(F.col("user_id").alias("request_id")).agg(
        F.count(F.lit(1)).alias("seq"), F.max("micros").alias("micros"), F.lit("data: [DONE]").alias("line")
    )
    return lines.unionByName(ends)


def stream_line() -> Column:
    """The stream line of an event (columns event_type and k)."""
    kind, k = F.col("event_type"), F.col("k")
    return (
        F.when(kind == "view", F.concat(F.lit('data: {"choices":[{"delta":{"content":"t'), k, F.lit('"}}]}')))
        .when(kind == "click", F.concat(F.lit('data: {"choices":[{"delta":{"content":"","reasoning_content":"r'), k, F.lit('"}}]}')))
        .when(kind == "purchase", F.concat(F.lit('data: {"choices":[],"usage":{"completion_tokens":'), k, F.lit("}}")))
        .when(kind == "signup", F.concat(F.lit(": keep-alive "), k))
        .otherwise(F.lit("data: {bad"))
    )


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training log rows: one run per user, one step per event."""
    ev = table(spark, sf_dir, "events")
    ev = ev.select(F.col("user_id").alias("run_id"), "event_id", epoch_micros(ev, "ts").alias("micros"), _k().alias("k"))
    placed = dense_position(
        ev, ["micros", "event_id"], time_segments(F.col("micros"), 3600), group=("run_id",), name="step"
    ).withColumn("step", F.col("step") + 1)
    totals = ev.groupBy("run_id").agg(F.count(F.lit(1)).alias("max_steps"))
    return spread_join(placed, totals, ["run_id"], "event_id")


def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as catalog lines with a position."""
    gpus = F.element_at(F.array(F.lit("1"), F.lit("2"), F.lit("4")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("pos"),
        F.concat_ws(
            "|", "n_name", gpus, F.concat(F.lit("region "), F.col("n_regionkey").cast("string"), F.lit(" | key "), F.col("n_nationkey").cast("string"))
        ).alias("line"),
    )
