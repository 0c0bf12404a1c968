"""JSON records as (source_file, pos, record VARIANT)."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.text import strip
from tallyloom.operators.position import dense_position
from tallyloom.sources.files import canonical_uri, file_name, first_signs
from tallyloom.sources.json_arrays import scan_arrays

COLUMNS = ("path", "source_file", "pos", "record")
#: File lists up to this length are broadcast: a name and a number each.
LISTED = 50_000


def scan_lines(spark: SparkSession, paths: list[str], with_pos: bool = True, keep_raw: bool = False) -> DataFrame:
    """JSON lines, split over tasks by byte ranges; bad JSON fails.

    ``pos`` is the row's place in its file. It needs one shuffle; leave it out
    where the records carry an id of their own. ``keep_raw`` adds the JSON text
    as written.
    """
    where = (F.col("_metadata.file_path").alias("path"), file_name().alias("source_file"), "_metadata.file_block_start")
    if keep_raw:
        text = spark.read.text(paths).select(*where, F.col("value").alias("raw")).filter(strip(F.col("raw")) != "")
        raw = text.withColumn("record", F.parse_json("raw"))
    else:
        reader = spark.read.option("singleVariantColumn", "record").option("mode", "FAILFAST")
        raw = reader.json(paths).select(*where, "record")
    if not with_pos:
        return raw.drop("file_block_start")
    # Within one byte range rows come in file order, which the increasing id records.
    placed = dense_position(
        raw.withColumn("__n", F.monotonically_increasing_id()),
        ["file_block_start", "__n"],
        [F.col("file_block_start")],
        group=("path",),
    )
    return placed.select(*COLUMNS, *(["raw"] if keep_raw else []))


def scan_records(spark: SparkSession, paths: list[str], lines: bool | None = None, keep_raw: bool = False) -> DataFrame:
    """(path, source_file, pos, record[, raw]) of all files.

    ``lines`` says that all files hold JSON lines, or arrays; without it, each
    file whose first sign is an opening bracket holds arrays, whose elements
    are counted through: lines that are arrays are taken apart, unless
    ``lines`` is true.
    """
    if lines is not None:
        return (scan_lines if lines else scan_arrays)(spark, paths, keep_raw=keep_raw)
    if not paths:
        raise ValueError("no files to read")
    signs = first_signs(spark, paths)
    arrays = [p for p, sign in zip(paths, signs, strict=True) if sign == "["]
    others = [p for p, sign in zip(paths, signs, strict=True) if sign != "["]
    parts = [scan(spark, names, keep_raw=keep_raw) for scan, names in ((scan_arrays, arrays), (scan_lines, others)) if names]
    return reduce(lambda a, b: a.unionByName(b), parts)


def in_file_order(spark: SparkSession, df: DataFrame, paths: list[str], name: str = "id") -> DataFrame:
    """Add a dense id along the listed files and the positions inside them."""
    listed = [(canonical_uri(spark, p), i) for i, p in enumerate(paths)]
    order = spark.createDataFrame(listed, "__path string, __file int")  # one row per listed file
    order = F.broadcast(order) if len(listed) <= LISTED else order
    local = F.regexp_replace("path", "^file:/+", "file:/")
    tagged = df.join(order, local == F.col("__path"))
    segments = [F.col("__file"), F.shiftright("pos", 13)]
    return dense_position(tagged, ["__file", "pos"], segments, name=name).drop("__file", "__path")


def source_counts(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows per source."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("rows"))
