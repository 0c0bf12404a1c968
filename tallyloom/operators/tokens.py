"""Token features of instruction records."""

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions.fixed_values import IGNORE_LABEL, MAX_LENGTH, MEGA_BATCHES, PAD_MULTIPLE, SEED
from tallyloom.functions.ordering import id_segments
from tallyloom.functions.templates import render_chat
from tallyloom.operators.position import dense_position, position_by_id
from tallyloom.operators.records import build_messages
from tallyloom.operators.select import row_count, shuffle

#: Runs of letters and digits, and single other characters.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\t\n\x0b\f\r \p{L}\p{N}]"
VOCABULARY = 32_000

Tokenizer = Callable[[Column], Column]


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def word_ids(tokens: Column, vocabulary: int = VOCABULARY) -> Column:
    """Token ids by hash; no vocabulary file and no unknown tokens."""
    return F.transform(
        tokens,
        lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint") % vocabulary).cast("int"),
    )


def word_tokenizer(vocabulary: int = VOCABULARY) -> Tokenizer:
    """The default tokenizer, all built-in functions."""
    return lambda text: word_ids(word_tokens(text), vocabulary)


def external_tokenizer(load: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Tokenizer:
    """A subword tokenizer run on Arrow batches.

    ``load`` is called once per Python worker and returns a function from texts
    to id lists.
    """
    import pandas as pd

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for texts in batches:
            yield pd.Series(tokenizer(texts.tolist()), index=texts.index)

    return lambda text: encode(text)


def tokenize(
    df: DataFrame,
    domain: str = "finance",
    template: str = "chatml",
    max_length: int = MAX_LENGTH,
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Add ``full_ids`` (not truncated) and ``prompt_len`` (truncated to ``max_length``)."""
    tokenizer = tokenizer or word_tokenizer()
    prompt = render_chat(build_messages(domain, include_answer=False), template, generation_prompt=True)
    full = render_chat(build_messages(domain, include_answer=True), template)
    features = F.struct(
        tokenizer(full).alias("full_ids"),
        F.least(F.size(tokenizer(prompt)), F.lit(max_length)).alias("prompt_len"),
    )
    # Generating one row from one row evaluates the tokenizer once; as plain
    # columns it would be repeated in every filter pushed below it.
    return df.select("*", F.inline(F.array(features)))


def mask_labels(df: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Replace ``full_ids`` and ``prompt_len`` by truncated ids, mask, labels and lengths."""
    ids = F.slice("full_ids", 1, max_length)
    length = F.least(F.size("full_ids"), F.lit(max_length))
    masked = F.least("prompt_len", length)
    return df.withColumns(
        {
            "input_ids": ids,
            "attention_mask": F.array_repeat(F.lit(1), length),
            # The prompt is masked; slicing keeps the rest without a per-token lambda.
            "labels": F.concat(
                F.array_repeat(F.lit(IGNORE_LABEL), masked),
                F.slice("full_ids", masked + 1, F.greatest(length - masked, F.lit(0))),
            ),
            "was_truncated": F.size("full_ids") > max_length,
            "length": length,
        }
    ).drop("full_ids", "prompt_len")


def is_trainable(labels: Column) -> Column:
    return F.exists(labels, lambda x: x != IGNORE_LABEL)


def filter_trainable(df: DataFrame) -> DataFrame:
    """Drop rows whose answer was cut off completely."""
    return df.filter(is_trainable(F.col("labels")))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The same rows; fails when there are none. Reads until the first row only."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def truncation_report(df: DataFrame) -> DataFrame:
    """Truncated and total rows per split."""
    return df.groupBy("split").agg(
        F.count_if("was_truncated").alias("truncated"), F.count(F.lit(1)).alias("total")
    )


def stage_counts(df: DataFrame) -> DataFrame:
    """Rows per split before and after the trainable filter, from one pass."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("before"), F.count_if(is_trainable(F.col("labels"))).alias("after")
    )


# --- batches -----------------------------------------------------------------


def arrival_batches(df: DataFrame, row_id: str, batch: int) -> DataFrame:
    """Add ``batch_id`` by position in id order."""
    placed = position_by_id(df, row_id, "__at")
    return placed.withColumn("batch_id", F.floor(F.col("__at") / batch).cast("bigint")).drop("__at")


def length_batches(df: DataFrame, row_id: str, batch: int) -> DataFrame:
    """Add ``batch_id`` with rows of similar ``length`` together.

    Truncated rows all share one length; the id below it keeps segments small.
    """
    placed = dense_position(
        df, ["length", row_id], [F.col("length"), *id_segments(F.col(row_id))], name="__at"
    )
    return placed.withColumn("batch_id", F.floor(F.col("__at") / batch).cast("bigint")).drop("__at")


def length_groups(df: DataFrame, row_id: str, batch: int, seed: int = SEED, most: int = MEGA_BATCHES) -> DataFrame:
    """Add ``position`` and ``batch_id`` of a shuffle that keeps rows of similar ``length`` together.

    Rows are shuffled by a seeded key and cut into runs of up to ``most``
    batches (fewer where there would be less than four runs). Inside a run, long rows come
    first. The longest row of all changes places with the very first one, so
    that the largest batch is tried at once. A run is sorted in one task, which
    its size bounds.
    """
    size = row_count(df)
    batches = F.least(F.greatest(F.floor(size / F.lit(4 * batch)), F.lit(1)), F.lit(most))
    run = (batches * batch).cast("bigint")
    shuffled = shuffle(df, row_id, seed, "__at").withColumn("__run", F.floor(F.col("__at") / run).cast("bigint"))
    inside = Window.partitionBy("__run").orderBy(F.col("length").desc(), "__at")
    placed = shuffled.withColumn("__rank", F.row_number().over(inside) - 1)
    longest = placed.filter(F.col("__rank") == 0).agg(F.max_by("__run", F.struct("length", -F.col("__run")))).scalar() * run
    at = (F.col("__run") * run + F.col("__rank")).cast("bigint")
    position = F.when(at == 0, longest).when(at == longest, F.lit(0)).otherwise(at).cast("bigint")
    grouped = placed.withColumn("position", position).withColumn("batch_id", F.floor(F.col("position") / batch).cast("bigint"))
    return grouped.drop("__at", "__run", "__rank")


def padded_length(longest: Column, multiple: int = PAD_MULTIPLE) -> Column:
    if multiple <= 0:
        return longest.cast("int")
    return (F.ceil(longest / multiple) * multiple).cast("int")


def pad_batches(df: DataFrame, pad_id: int, multiple: int = PAD_MULTIPLE) -> DataFrame:
    """Pad the arrays of each ``batch_id`` to one common length."""
    longest = F.max("length").over(Window.partitionBy("batch_id"))  # one batch of rows
    missing = F.col("padded_length") - F.col("length")
    fill = lambda value: F.array_repeat(F.lit(value), missing)
    return df.withColumn("padded_length", padded_length(longest, multiple)).withColumns(
        {
            "input_ids": F.concat("input_ids", fill(pad_id)),
            "attention_mask": F.concat("attention_mask", fill(0)),
            "labels": F.concat("labels", fill(IGNORE_LABEL)),
        }
    )


def batch_report(df: DataFrame, multiple: int = PAD_MULTIPLE) -> DataFrame:
    """Size and padding waste per batch."""
    longest = padded_length(F.max("length"), multiple).cast("bigint")
    return df.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows"),
        longest.alias("padded_length"),
        (longest * F.count(F.lit(1)) - F.sum("length")).alias("padding"),
    )
