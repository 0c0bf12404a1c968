"""Reading, staging and splitting shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new one of this machine is set only in local mode and only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: what follows neither repeats its work nor depends on a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict[object, object] = {}


def alone(key: object, make: Callable[[], T]) -> T:
    """What `make` gave for this key in this Python process. One key is held at a time, so that operators that follow each other don't add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def slices(texts: list[str], chars: int = 1_500_000) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, so that their words take bounded memory; a longer text comes by itself."""
    sizes = np.cumsum([len(t) for t in texts], dtype=np.int64) // chars
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
        yield [texts[i] for i in part]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def whole_keys(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """From batches sorted by a number column `key`: frames in which no key is cut, with the starts and ends of their keys."""

    def cut(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        keys = rows["key"].to_numpy()
        turns = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        return rows, np.r_[0, turns], np.r_[turns, len(keys)]

    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        rest.append(b)
        if rest[0]["key"].iloc[0] == b["key"].iloc[-1]:
            continue
        rows = pd.concat(rest, ignore_index=True)
        last = int(np.searchsorted(rows["key"].to_numpy(), rows["key"].iloc[-1]))  # the last key may go on
        rest = [rows.iloc[last:].reset_index(drop=True)]
        if last:
            yield cut(rows.iloc[:last])
    if rest:
        yield cut(pd.concat(rest, ignore_index=True))
