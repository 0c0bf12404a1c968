"""JSON arrays read in byte ranges.

A file is read as text with the comma for a line end, so that Spark splits one file over tasks like any text. Every comma
inside or between values ends a fragment, and each fragment is a step of a small automaton whose state is whether a
string is open and how deep the brackets are:

1. Of each fragment: its quotes, and how it changes the depth if it starts outside a string and if it starts inside one.
2. The fragments of a byte range are composed to the same three numbers for the whole range, and the ranges of a file
   one after the other (one row per range), which gives the state each range really starts in.
3. With its start state, a fragment's comma is known to end an element (outside strings, depth one) or to be part of it.
   A closing bracket that an opening one follows outside strings can only stand between two arrays; it is marked with a
   control character, which JSON strings cannot hold, and cuts the fragment.
4. Elements are numbered along the ranges and put together from their pieces.

A file may hold several arrays, one after the other or one a line; their elements are counted through. A byte-order mark
and white space around arrays are passed over. Anything else between or behind arrays, a missing bracket and bad JSON
fail. No element is parsed as part of the whole array, and no file has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.operators.joins import stage
from tallyloom.sources.files import file_name

MARK = "\u0001"
#: Text outside strings and whole strings, up to a closing bracket or the end.
TO_BRACKET = r'(?s)(?:[^"\]]++|"(?:[^"\\]++|\\.)*+(?:"|\z))*+\]?'
OPENS, CLOSES = r"^[ \t\r\n]*\[", r"\][ \t\r\n]*\z"

def _less(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _depth(text: Column) -> Column:
    """How text outside strings changes the depth."""
    return _less(text, "[{") - _less(text, "]}")


def _fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Fragments with what each does to the state."""
    read = spark.read.option("lineSep", ",").text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        file_name().alias("source_file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("n"),  # within a range it follows the file
        F.col("value").alias("text"),
    )
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    parts = F.split(bare, '"')
    every_other = lambda first: F.array_join(F.filter(parts, lambda x, i: i % 2 == first), "")
    quotes = (F.size(parts) - 1).cast("bigint")
    plain = ~F.contains("text", F.lit('"'))
    return read.withColumns(
        {
            "quotes": F.when(plain, F.lit(0)).otherwise(quotes).cast("bigint"),
            "outside": F.when(plain, _depth(F.col("text"))).otherwise(_depth(every_other(0))).cast("bigint"),
            "inside": F.when(plain, F.lit(0)).otherwise(_depth(every_other(1))).cast("bigint"),
        }
    )


def _range_starts(stepped: DataFrame) -> DataFrame:
    """One row per byte range: the state it starts in, and whether it is its file's first or last."""
    flipped = F.col("before") % 2 == 1
    composed = stepped.groupBy("path", "range").agg(
        F.sum("quotes").alias("quotes"),
        F.sum(F.when(flipped, F.col("inside")).otherwise(F.col("outside"))).alias("outside"),
        F.sum(F.when(flipped, F.col("outside")).otherwise(F.col("inside"))).alias("inside"),
    )
    along = Window.partitionBy("path").orderBy("range")  # one row per byte range of a file
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    opened = composed.withColumn("open", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    changed = opened.withColumn("change", F.when(F.col("open") == 1, F.col("inside")).otherwise(F.col("outside")))
    return changed.select(
        "path",
        "range",
        "open",
        F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth"),
        F.lag("range").over(along).isNull().alias("first_range"),
        F.lead("range").over(along).isNull().alias("last_range"),
    )


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pieces of elements in order, with ``ends``: how many elements of the range end before each."""
    within = Window.partitionBy("path", "range").orderBy("n")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    stepped = _fragments(spark, paths).withColumn("before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))
    known = stepped.join(_range_starts(stepped.drop("text", "source_file")), ["path", "range"])
    known = known.withColumn("within", (F.col("before") + F.col("open")) % 2 == 1)
    change = F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside"))
    placed = known.withColumns(
        {
            "depth": F.col("depth") + F.sum(change).over(within.rowsBetween(Window.unboundedPreceding, 0)),
            "first": F.col("first_range") & F.lag("n").over(within).isNull(),
            "last": F.col("last_range") & F.lead("n").over(within).isNull(),
            "still": (F.col("within").cast("int") + F.col("quotes")) % 2 == 1,
        }
    )
    text = F.when(F.col("first"), F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text"))
    # With the string's opening quote put back, the pattern sees whole strings; it is taken off again.
    whole = F.when(F.col("within"), F.concat(F.lit('"'), text)).otherwise(text)
    runs = F.regexp_extract_all(whole, F.lit(TO_BRACKET), F.lit(0))
    opening = lambda run, i: (i > 0) & F.rlike(run, F.lit(OPENS))
    marked = F.array_join(F.transform(runs, lambda run, i: F.when(opening(run, i), F.concat(F.lit(MARK), run)).otherwise(run)), "")
    both = F.contains(text, F.lit("]")) & F.contains(text, F.lit("["))
    cut = F.split(F.when(both, F.when(F.col("within"), marked.substr(F.lit(2), F.length(marked))).otherwise(marked)).otherwise(text), MARK)
    pieces = placed.select("*", F.size(cut).alias("count"), F.posexplode(cut).alias("i", "piece"))

    final = F.col("i") == F.col("count") - 1
    opens = (F.col("first") & (F.col("i") == 0)) | (F.col("i") > 0)
    closes = ~final | F.col("last")
    comma = final & ~F.col("last") & ~F.col("still")
    wrong = (
        F.when(opens & ~F.rlike("piece", F.lit(OPENS)), F.lit("not a JSON array"))
        .when(closes & ~F.rlike("piece", F.lit(CLOSES)), F.lit("a JSON array is cut off or has other text behind it"))
        .when((F.col("last") & final & (F.col("still") | (F.col("depth") != 0))) | (comma & (F.col("depth") < 1)), F.lit("brackets of a JSON array don't match"))
    )
    inner = F.when(opens, F.regexp_replace("piece", OPENS, "")).otherwise(F.col("piece"))
    inner = F.when(closes, F.regexp_replace(inner, CLOSES, "")).otherwise(inner)
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": "), F.col("path"))).cast("string")).otherwise(inner)
    empty = opens & closes & (F.trim(F.translate(inner, "\t\r\n", "")) == "")
    held = pieces.select("path", "source_file", "range", "n", "i", checked.alias("body"), (closes | (comma & (F.col("depth") == 1))).cast("int").alias("end"), empty.alias("empty"))
    order = Window.partitionBy("path", "range").orderBy("n", "i").rowsBetween(Window.unboundedPreceding, -1)
    return held.filter(~F.col("empty")).drop("empty").withColumn("ends", F.coalesce(F.sum("end").over(order), F.lit(0)))


def scan_arrays(spark: SparkSession, paths: list[str], keep_raw: bool = False) -> DataFrame:
    """(path, source_file, pos, record) of all elements of files that hold JSON arrays; elements may be anything.

    The pieces of elements are written to the scratch folder first, so the files are read while the plan is built.
    ``keep_raw`` adds the JSON text of each element as written.
    """
    if not paths:
        raise ValueError("no files to read")
    pieces = stage(_pieces(spark, paths), "array-pieces")
    earlier = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per byte range
    counts = pieces.groupBy("path", "range").agg(F.sum("end").alias("count"))
    bases = counts.select("path", "range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    part = F.struct("range", "n", "i", "body")
    elements = (
        pieces.join(bases, ["path", "range"])
        .groupBy("path", "source_file", (F.col("base") + F.col("ends")).cast("bigint").alias("pos"))
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
    )
    raw = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["body"]), ","), r"^[ \t\r\n]+|[ \t\r\n]+\z", "")
    text = elements.select("path", "source_file", "pos", raw.alias("raw"))
    return text.select("path", "source_file", "pos", F.parse_json("raw").alias("record"), *(["raw"] if keep_raw else []))
