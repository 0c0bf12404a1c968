"""Plain text lines."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.text import strip


def clean_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Strip each line and drop blank ones."""
    return df.withColumn(column, strip(F.col(column))).filter(F.col(column) != "")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return clean_lines(spark.read.text(path)).withColumnRenamed("value", "prompt")
