"""Near-duplicate vectors by Euclidean p-stable hashing.

For unit vectors a cosine of at least t is a distance of at most sqrt(2 - 2t). A hash is
floor((a.v + b) / WIDTH) for a Gaussian a; PROJECTIONS of them make a bucket, and vectors that
share a bucket in any of several tables are compared by their exact cosine in double precision.
Both numbers follow from the usual theory: so many projections that a bucket holds about one
unlike vector, so many tables that a pair right at the threshold is met with probability RECALL;
closer pairs are met more often. Nothing below the threshold is ever linked.

Equal vectors of one label are one class with a weight, so copies are never compared. Buckets of
one class are dropped before vectors are moved. A bucket of more than CHUNK classes is split into
chunks, and each pair of chunks is a unit of work. A pair met in several tables counts in the first of
them only, which both sides' hashes tell. A unit returns sums of links and a spanning forest, never pairs.

Vectors that are null, empty, all zeros, or hold null, NaN or infinite components, and rows
with a null label link with nothing; they are their own component. Vectors of different
length are never compared. A row with a null vec_id links with nothing and has null component and kept.
Rows that repeat a vec_id count as vectors of their own in n_links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tallyloom.llm.common import staged, whole_keys
from tallyloom.llm.components import components

THRESHOLD, WIDTH, RECALL, CHUNK, SEED = 0.93, 2.0, 0.99, 2_000, 7
VALID = "label is not null and vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one hash is equal for two points at a distance."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(projections, tables) for so many vectors; unlike ones are taken to be at right angles."""
    projections = max(4, math.ceil(math.log(max(vectors, 2)) / -math.log(collision(math.sqrt(2)))))
    return projections, math.ceil(math.log(1 - recall) / math.log1p(-(collision(math.sqrt(2 - 2 * threshold)) ** projections)))


def _unit(vectors: pd.Series | np.ndarray) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hasher(projections: int, tables: int):
    """vectors -> one bucket number per table."""

    @F.pandas_udf("array<long>")
    def buckets(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        drawn: dict[int, tuple] = {}
        for batch in vectors:
            sizes, out = batch.map(len).to_numpy(), np.empty(len(batch), object)
            for size in np.unique(sizes):
                if size not in drawn:
                    rng = np.random.default_rng([SEED, int(size)])
                    drawn[size] = rng.standard_normal((size, tables * projections)), rng.random(tables * projections) * WIDTH, rng.integers(0, 2**63, tables * projections).astype(np.uint64) | np.uint64(1)
                a, b, mix = drawn[size]
                at = np.flatnonzero(sizes == size)
                for part in np.array_split(at, len(at) // 1024 + 1):
                    cell = np.floor((_unit(batch.iloc[part]) @ a + b) / WIDTH).astype(np.int64).view(np.uint64) * mix
                    cell = cell.reshape(len(part), tables, projections).sum(axis=2, dtype=np.uint64)
                    cell = ((cell ^ (cell >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    for row, i in zip(cell, part, strict=True):
                        out[i] = row
            yield pd.Series(out)

    return buckets


def _linked(x: np.ndarray, hashes: np.ndarray, table: int, side: np.ndarray, cross: bool, threshold: float) -> np.ndarray:
    """Which rows link in this unit and in no earlier table."""
    met = np.zeros((len(x), len(x)), bool)
    for lo in range(0, len(x), 512):
        near = x[lo : lo + 512] @ x.T >= threshold
        if cross:
            near &= side[lo : lo + 512, None] != side[None]
        i, j = np.nonzero(near)
        i += lo
        i, j = i[i < j], j[i < j]
        for p in range(0, len(i), 1 << 17):
            a, b = i[p : p + (1 << 17)], j[p : p + (1 << 17)]
            new = ~(hashes[a, :table] == hashes[b, :table]).any(axis=1)
            met[a[new], b[new]] = True
    return met | met.T


def _tree(met: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest."""
    seen = np.zeros(len(met), bool)
    for root in range(len(met)):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            i = todo.pop()
            found = np.flatnonzero(met[i] & ~seen)
            seen[found] = True
            todo += found.tolist()
            yield from ((i, j) for j in found.tolist())


def _units(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of units -> (a, n): a has n links more; (a, b): an edge."""
        for part, starts, ends in whole_keys(batches):
            ids, copies, table = part["id"].to_numpy(), part["copies"].to_numpy(), part["table"].to_numpy()
            side, cross = part["side"].to_numpy(), part["cross"].to_numpy()
            found: list[tuple] = []
            for lo, hi in zip(starts, ends, strict=True):
                if hi - lo < 2:
                    continue
                met = _linked(_unit(part["embedding"].iloc[lo:hi]), np.stack(part["hashes"].iloc[lo:hi].to_numpy()), int(table[lo]), side[lo:hi], bool(cross[lo]), threshold)
                if met.any():
                    sums = met @ copies[lo:hi]
                    found += [(ids[lo + i], None, int(sums[i])) for i in np.flatnonzero(sums)]
                    found += [(ids[lo + i], ids[lo + j], None) for i, j in _tree(met)]
            yield pd.DataFrame({"a": pd.Series([x[0] for x in found], dtype="Int64"), "b": pd.Series([x[1] for x in found], dtype="Int64"), "n": pd.Series([x[2] for x in found], dtype="Int64")})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and kind.elementType == FloatType()  # moved as they are; all sums are doubles
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), "label")
    classes = staged(vectors.where(VALID).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    hashed = staged(classes.withColumn("hashes", hasher(*plan(largest, threshold, recall))("embedding")))
    entries = hashed.select("id", F.xxhash64("label", F.size("embedding")).alias("space"), F.posexplode("hashes").alias("table", "bucket")).select("id", "table", F.xxhash64("space", "table", "bucket").alias("bucket"))
    sizes = entries.groupBy("bucket").count().where("count > 1")
    chunks = F.ceil(F.col("count") / chunk).cast("int")
    some = entries.join(sizes, "bucket").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("id", "bucket"), F.col("chunks")).cast("int"))
    some = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = some.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "table", F.col("own").alias("side"), (F.col("own") != F.col("other")).alias("cross"))
    # A unit of two chunks holds both; crossed rows of one chunk only find no partner there.
    # Only the hashes of earlier tables are asked for.
    filled = units.join(hashed.select("id", "embedding", "hashes", "copies"), "id").withColumn("hashes", F.slice("hashes", F.lit(1), F.col("table")))
    found = staged(filled.repartition("key").sortWithinPartitions("key").mapInPandas(_units(threshold), "a long, b long, n long"))
    groups = components(found.where("b is not null").select("a", "b"))
    sums = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    facts = classes.join(sums, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    facts = facts.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    told = vectors.where(VALID).join(facts, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(f"not coalesce({VALID}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
