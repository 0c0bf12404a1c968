"""Model catalog: parsing, lookup with fallbacks, layered settings."""

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.fixed_values import SPECIAL_GPU_MODELS, SPECIAL_GPUS
from tallyloom.functions.text import blank_to_null


def parse_catalog(lines: DataFrame, line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, gpus, description) from ``id|gpus|description``; the last field takes the rest."""
    parts = F.split(F.col(line), r"\|", 3)
    return lines.select(
        *keep,
        F.get(parts, F.lit(0)).alias("id"),
        F.get(parts, F.lit(1)).try_cast("int").alias("gpus"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("description"),
    )


def first_match(catalog: DataFrame, order: str) -> DataFrame:
    """One row per id: the first in ``order``."""
    return catalog.groupBy("id").agg(F.min_by("gpus", order).alias("gpus"))


def lookup_gpus(
    df: DataFrame,
    catalog: DataFrame,
    model: str,
    order: str,
    override: Column | None = None,
    special: tuple[str, ...] = SPECIAL_GPU_MODELS,
    name: str = "gpus",
) -> DataFrame:
    """Add the GPU count of each row's model: override, catalog, special list, else 1; at least 1.

    An equi left join; Spark broadcasts the catalog when its measured size allows.
    """
    found = first_match(catalog, order).select(F.col("id").alias("__id"), F.col("gpus").alias("__gpus"))
    special_gpus = F.when(F.col(model).isin(*special), F.lit(SPECIAL_GPUS)) if special else F.lit(None)
    known = F.coalesce(
        *([override.cast("int")] if override is not None else []), F.col("__gpus"), special_gpus.cast("int"), F.lit(1)
    )
    return (
        df.join(found, df[model] == found["__id"], "left")
        .withColumn(name, F.greatest(known, F.lit(1)))
        .drop("__id", "__gpus")
    )


def layered(override: Column, value: Column, default: Column) -> Column:
    """Override text if not empty, else the model's own value, else the stock default."""
    return F.coalesce(blank_to_null(override), value.cast("string"), default.cast("string"))
