"""Subsets for enrichment, export formats and calibration sets."""

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.fixed_values import CALIBRATION_LENGTH, CALIBRATION_ROWS, CHUNK_SIZE, SAMPLE_LIMIT, SEED
from tallyloom.functions.templates import render_chat
from tallyloom.operators import records, select, tokens
from tallyloom.sources import sinks
from tallyloom.sources.json_records import in_file_order, scan_records


def enrichment_subset(
    spark: SparkSession,
    paths: list[str],
    output: str,
    limit: int = SAMPLE_LIMIT,
    seed: int = SEED,
    mode: str = "random",
    chunk_size: int = CHUNK_SIZE,
    dedupe: bool = False,
    lines: bool | None = None,
    pretty: bool = False,
) -> DataFrame:
    """Write a (de-duplicated) sample of records in chunk files; returns the manifest of what was written.

    ``output`` is the name of the file as if there were one, as in
    ``out/subset.json``; chunks are ``out/subset.part001.json`` and so on.
    ``mode`` is random (also shuffles when everything is kept), head or
    stride. Duplicates go first, so ``limit`` counts unique records.
    """
    found = in_file_order(spark, scan_records(spark, paths, lines, keep_raw=True), paths)
    if dedupe:
        found = select.dedupe(found, select.content_key(F.col("record")), "id")
    if mode == "random":
        chosen, order = select.sample_random(found, limit, "id", seed), "pos"
    elif mode == "stride":
        chosen, order = select.sample_stride(found, limit, "id").drop("pos"), "id"
    elif mode == "head":
        chosen, order = select.head(found, limit, "id"), "id"
    else:
        raise ValueError(f"unknown mode {mode!r}")
    body = F.when(F.schema_of_variant("record") == "STRING", F.to_json("record")).otherwise(F.coalesce("raw", F.lit("null")))
    ready = chosen.select(F.col(order).alias("n"), body.alias("body"))
    dense = order == "pos"
    folder, _, name = output.rpartition("/")
    stem, extension = os.path.splitext(name)
    sinks.write_chunk_files(ready, folder or ".", stem, extension, "n", chunk_size, pretty, F.col("body"), dense)
    return sinks.assign_chunks(ready.select("n"), "n", chunk_size, dense=dense).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def export_formats(spark: SparkSession, paths: list[str], domain: str, stem: str, lines: bool | None = None) -> None:
    """Write ``<stem>_alpaca`` and ``<stem>_sharegpt`` as JSON lines; values that are no strings are indented in the order written."""
    scanned = scan_records(spark, paths, lines, keep_raw=True)
    # Elements of arrays come in no order; written as they stood, files by name.
    found = scanned.repartitionByRange("path", "pos").sortWithinPartitions("path", "pos")
    alpaca = records.to_alpaca(found, raw="raw")
    sinks.write_records(alpaca, f"{stem}_alpaca")
    # A blank input is still an input to the prompt, so it is taken as it stands in the record.
    asked = found.withColumn("asked", records.as_string_only(records.field(F.col("record"), "input")))
    texts = records.to_alpaca(asked, keep=("asked",), raw="raw").withColumn("input", F.coalesce("asked", "input"))
    sinks.write_records(records.to_sharegpt(texts, domain), f"{stem}_sharegpt")


def calibration_set(
    found: DataFrame,
    row_id: str = "id",
    rows: int = CALIBRATION_ROWS,
    max_length: int = CALIBRATION_LENGTH,
    template: str = "chatml",
    tokenizer: tokens.Tokenizer | None = None,
) -> DataFrame:
    """Truncated token ids of the first ``rows`` records."""
    text = records.calibration_text(F.col("record"), lambda m: render_chat(m, template))
    ids = (tokenizer or tokens.word_tokenizer())(text)
    return select.head(found, rows, row_id).select(row_id, F.slice(ids, 1, max_length).alias("input_ids"))
