"""From instruction files to training features."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.fixed_values import MAX_LENGTH, SEED, TRUE_WORDS, VALIDATION_FRACTION
from tallyloom.operators.joins import stage
from tallyloom.operators import select, tokens
from tallyloom.operators.records import normalize
from tallyloom.sources.json_records import in_file_order, scan_records
from tallyloom.sources.resolve import resolve_sources


def read_instructions(spark: SparkSession, paths: list[str], lines: bool | None = None) -> DataFrame:
    """(id, instruction, input, output, source_file) of all files, ids in file order."""
    scanned = in_file_order(spark, scan_records(spark, paths, lines, keep_raw=True), paths)
    return normalize(scanned, keep=("id",), raw="raw")


#: Type and default of each option; a switch that is given is on for TRUE_WORDS only.
OPTIONS = {
    "DATASET_SEED": (int, SEED),
    "SHUFFLE_DATASETS": (bool, True),
    "MAX_TRAIN_SAMPLES": (int, 0),
    "MAX_VALID_SAMPLES": (int, 0),
    "VALIDATION_SPLIT": (float, VALIDATION_FRACTION),
}


def typed(given: dict[str, str]) -> dict:
    """All options with their types; what is not given, and an empty number, has its default."""
    out = {}
    for name, (kind, default) in OPTIONS.items():
        text = given.get(name)
        if kind is bool and text is not None:
            out[name] = text.strip().casefold() in TRUE_WORDS
        else:
            out[name] = kind(text) if text else default
    return out


def load_instructions(
    spark: SparkSession,
    options: dict[str, str],
    base_dir: str,
    default_train: str,
    default_validation: str,
    lines: bool | None = None,
) -> DataFrame:
    """Normalised records with ``split`` = train | validation.

    Options: those of ``resolve_sources``, and DATASET_SEED, SHUFFLE_DATASETS,
    VALIDATION_SPLIT, MAX_TRAIN_SAMPLES, MAX_VALID_SAMPLES. Ids are unique
    within a split. With validation files of its own, training data is only
    shuffled: ``pos`` then holds the training order.
    """
    sources = resolve_sources(spark, options, base_dir, default_train, default_validation)
    chosen = typed(options)
    seed, shuffled = chosen["DATASET_SEED"], chosen["SHUFFLE_DATASETS"]
    max_train, max_validation = chosen["MAX_TRAIN_SAMPLES"], chosen["MAX_VALID_SAMPLES"]
    train = tokens.require_rows(read_instructions(spark, sources.train, lines), "no training records")
    if not sources.validation:
        return select.split(train, chosen["VALIDATION_SPLIT"], "id", seed, shuffled, max_train, max_validation)
    validation = tokens.require_rows(read_instructions(spark, sources.validation, lines), "no validation records")
    if shuffled:
        train = select.sample_random(train, max_train, "id", seed)
    else:
        train = select.head(train, max_train, "id").withColumn("pos", F.col("id"))
    return select.union_sources(
        train.withColumn("split", F.lit("train")),
        select.head(validation, max_validation, "id").withColumns({"pos": F.col("id"), "split": F.lit("validation")}),
    )


def training_features(
    records: DataFrame, domain: str, template: str = "chatml", max_length: int = MAX_LENGTH, tokenizer: tokens.Tokenizer | None = None
) -> DataFrame:
    """Loss-masked features; rows whose answer was cut off are dropped, no training row left is an error."""
    masked = tokens.mask_labels(tokens.tokenize(records, domain, template, max_length, tokenizer), max_length)
    kept = tokens.filter_trainable(masked)
    tokens.require_rows(kept.filter(F.col("split") == "train"), "no training row has a trainable label")
    return kept


def feature_table(features: DataFrame, *columns: str) -> DataFrame:
    """The features (or some columns of them) as a table in the scratch folder.

    Batches ask for each row several times: to count, to rank and to pad. From
    a table they read numbers; from the plan each time would run the tokenizer.
    """
    return stage(features.select(*columns) if columns else features, "features")
