"""JSON sinks, chunked output, results documents and run checkpoints."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.functions.fixed_values import CHUNK_SIZE, RESULTS_PREFIX
from tallyloom.functions.pretty import pretty_json
from tallyloom.operators.position import position_by_id
from tallyloom.operators.select import chunk_count, chunk_id, chunk_label, row_count
from tallyloom.sources.files import delete, exists, list_files, move

PART = re.compile(r"/part=(\d+)/")


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8 and not escaped."""
    df.write.mode("overwrite").json(path)


def assign_chunks(df: DataFrame, row_id: str, size: int = CHUNK_SIZE, name: str = "part", dense: bool = False) -> DataFrame:
    """Add the chunk number and label of each row in id order; ``dense`` ids already are positions."""
    placed = df.withColumn("__pos", F.col(row_id)) if dense else position_by_id(df, row_id, "__pos")
    part = chunk_id(F.col("__pos"), size)
    return placed.withColumns({name: part, "label": chunk_label(part, chunk_count(row_count(df), size))}).drop("__pos")


def chunk_manifest(df: DataFrame, row_id: str, size: int = CHUNK_SIZE) -> DataFrame:
    """Chunk, label and rows written, without moving the rows' contents."""
    return (
        assign_chunks(df.select(row_id), row_id, size)
        .groupBy("part", "label")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id"))
    )


def write_chunk_files(
    df: DataFrame,
    folder: str,
    stem: str,
    extension: str,
    row_id: str,
    size: int = CHUNK_SIZE,
    pretty: bool = False,
    body: Column | None = None,
    dense: bool = False,
) -> list[str]:
    """Named chunk files ``stem.partNNN.ext`` in ``folder``, or one file ``stem.ext`` when all fits into one; returns their names.

    A row is written as the JSON text ``body`` (by default all its columns), as
    JSON lines or, with ``pretty``, as one indented array per file. A file is
    written by one task, so ``size`` bounds what a task holds.

    Rows are staged in the folder ``stem.staged`` first. The commit then moves
    each staged file to its name; stopped at any point, it can be run again
    with ``commit_chunk_files``, and readers never see half a file.
    """
    if pretty and size <= 0:
        raise ValueError("pretty output needs a chunk size")
    text = F.to_json(F.struct(*df.columns)) if body is None else body
    chunked = assign_chunks(df.withColumn("value", text), row_id, size, dense=dense).select("part", row_id, "value")
    chunked = chunked.repartition("part").sortWithinPartitions("part", row_id)
    if pretty:
        first = Window.partitionBy("part").orderBy(row_id)  # one chunk
        last = Window.partitionBy("part").orderBy(F.col(row_id).desc())
        chunked = chunked.withColumn(
            "value",
            F.concat(
                F.when(F.row_number().over(first) == 1, F.lit("[\n")).otherwise(F.lit("")),
                F.regexp_replace(pretty_json(F.col("value")), "(?m)^", "  "),
                F.when(F.row_number().over(last) == 1, F.lit("\n]")).otherwise(F.lit(",")),
            ),
        ).sortWithinPartitions("part", row_id)
    staged = _staged(folder, stem)
    # One file per part, however many rows it has.
    chunked.select("part", "value").write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy("part").text(staged)
    return commit_chunk_files(df.sparkSession, folder, stem, extension)


def _staged(folder: str, stem: str) -> str:
    return f"{folder.rstrip('/')}/{stem}.staged"


def commit_chunk_files(spark: SparkSession, folder: str, stem: str, extension: str) -> list[str]:
    """Give staged chunks their names; those of an earlier output under this stem go first. Safe to run again.

    The list of names is written down before anything is moved, and staging is
    deleted last, so a second run knows which files are done.
    """
    staged, plan = _staged(folder, stem), f"{_staged(folder, stem)}/_names"
    if not exists(spark, f"{staged}/_SUCCESS"):
        raise FileNotFoundError(f"{staged} is not a finished set of chunks")
    if not exists(spark, f"{plan}/_SUCCESS"):
        files = {int(PART.search(f)[1]): f for f in list_files(spark, f"{staged}/part=*/part-*")}
        width = max(3, len(str(len(files))))
        name = lambda n: f"{stem}{extension}" if len(files) == 1 else f"{stem}.part{n:0{width}d}{extension}"
        rows = [(files[n], name(n)) for n in sorted(files)]
        spark.createDataFrame(rows, "staged string, name string").coalesce(1).write.mode("overwrite").json(plan)  # one row per file
    rows = [(r["staged"], r["name"]) for r in spark.read.schema("staged string, name string").json(plan).collect()]
    names = {name for _, name in rows}
    own = re.compile(re.escape(stem) + r"(\.part\d{3,})?" + re.escape(extension))
    for old in list_files(spark, f"{folder.rstrip('/')}/*"):
        base = old.rpartition("/")[2]
        if own.fullmatch(base) and base not in names:
            delete(spark, old)
    for source, name in rows:
        target = f"{folder.rstrip('/')}/{name}"
        if exists(spark, source):
            if exists(spark, target):
                delete(spark, target)
            if not move(spark, source, target):
                raise OSError(f"cannot move {source} to {target}")
    delete(spark, staged)
    return sorted(names)


# --- results and run checkpoints ---------------------------------------------


def safe_name(model):
    """Model name as used in file names."""
    return F.translate(F.replace(model, F.lit("/"), F.lit("--")), " ", "_")


def results_documents(summaries: DataFrame, header: list[str], level: str = "level") -> DataFrame:
    """One document per header with its summaries, one per level, as an ordered array."""
    body = [c for c in summaries.columns if c not in header and c != level]
    return summaries.groupBy(*header).agg(
        F.array_sort(F.collect_list(F.struct(level, *body))).alias("results")
    ).withColumn("file_name", F.concat(F.lit(RESULTS_PREFIX), safe_name(F.col("model"))))


def write_results(summaries: DataFrame, path: str, header: list[str]) -> None:
    write_records(results_documents(summaries, header), path)


def checkpoint_documents(summaries: DataFrame, guard: list[str], level: str = "level") -> DataFrame:
    """One document per run with its finished levels as a map from level text to summary."""
    body = [c for c in summaries.columns if c not in guard and c != level]
    entry = F.struct(F.col(level).cast("string"), F.struct(*body))
    return summaries.groupBy(*guard).agg(F.map_from_entries(F.collect_list(entry)).alias("completed"))


#: Snapshots that stay besides the newest: readers that began before a write go on.
KEPT_SNAPSHOTS = 2


def _snapshots(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and folder of all complete snapshots, the newest last; Spark's marker is written when all files are."""
    done = (f.rpartition("/")[0] for f in list_files(spark, f"{path.rstrip('/')}/snapshot-*/_SUCCESS"))
    return sorted((int(folder.rpartition("-")[2]), folder) for folder in done)


def write_checkpoint(summaries: DataFrame, path: str, guard: list[str]) -> None:
    """Write a new numbered snapshot beside the earlier ones; Parquet keeps the summary types.

    Nothing is replaced: a write that stops half-way leaves a folder without
    its marker, which no reader takes, and the snapshots before it stay.
    ``summaries`` may read them. Older ones go last.
    """
    spark = summaries.sparkSession
    known = _snapshots(spark, path)
    number = known[-1][0] + 1 if known else 1
    checkpoint_documents(summaries, guard).write.mode("overwrite").parquet(f"{path.rstrip('/')}/snapshot-{number:09d}")
    for _, old in known[:-KEPT_SNAPSHOTS]:
        delete(spark, old)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete snapshot."""
    known = _snapshots(spark, path)
    return spark.read.parquet(known[-1][1]) if known else None


def finish_run(spark: SparkSession, summaries: DataFrame, path: str, checkpoint: str, header: list[str]) -> None:
    """Write the results, then remove the checkpoint."""
    write_results(summaries, path, header)
    if exists(spark, checkpoint):
        delete(spark, checkpoint)
