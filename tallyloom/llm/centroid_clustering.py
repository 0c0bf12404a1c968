"""Centroid clustering of vectors in exact integers, by progressive search over Walsh-Hadamard coefficients.

Vectors of 64 finite components become integers floor(1024 * x). The Walsh-Hadamard transform H of such a vector
is exact in integers, and |Hv - Hc|^2 = 64 |v - c|^2, so that a sum over some coefficients never exceeds 64 times the
distance. Coefficients are ordered coarse to fine (by sign changes of their rows of H). For each vector the coarsest
ones choose a centroid whose whole distance is the bound; other centroids add up their differences step by step and leave
as soon as they are strictly worse; those that stay finish all 64. Ties go to the smaller number.

Coefficients are computed once and kept in a table of 256 bytes a vector in the shared folder. A round is one pass over
that table: each task gives sums per centroid, Spark adds them up, and the driver takes one row per centroid.
Sums of vectors are sums of coefficients, turned back at the end, so the vectors are not needed again.

Vectors that are null, of another length, or hold null or non-finite components have no row. Repeated rows count
as often as they occur. The first centroids are the vectors of the smallest hashes of `3:<id>` (a null id: `3:`), equal
hashes in the order of their coefficients; fewer vectors than centroids make fewer centroids, none an empty result.
An integer beyond 2^24, where distances could leave 64 bits, fails and says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import staged

DIM, SCALE, LARGEST = 64, 1024, 2**24
CENTROIDS, ROUNDS = 8, 10
#: Coefficients known after each step.
STEPS = (4, 8, 16, 32, 64)
RESULT = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def walsh() -> np.ndarray:
    """The Hadamard matrix with its rows by number of sign changes."""
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < DIM:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1))]


def forward(vectors: np.ndarray) -> np.ndarray:
    return vectors @ walsh().T


def backward(coefficients: np.ndarray) -> np.ndarray:
    """The exact inverse of `forward`; Python integers are kept as they are."""
    return coefficients @ walsh().astype(coefficients.dtype) // DIM


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For coefficients of vectors and centroids: the number of the nearest centroid and the squared distance."""
    known, rows = STEPS[0], np.arange(len(x))
    partial = ((x[:, None, :known] - centroids[None, :, :known]) ** 2).sum(axis=2)
    guess = partial.argmin(axis=1)
    bound = partial[rows, guess] + ((x[:, known:] - centroids[guess, known:]) ** 2).sum(axis=1)
    row, col = np.nonzero(partial <= bound[:, None])
    total = partial[row, col]
    for upto in STEPS[1:]:
        total = total + ((x[row, known:upto] - centroids[col, known:upto]) ** 2).sum(axis=1)
        alive = total <= bound[row]
        row, col, total, known = row[alive], col[alive], total[alive], upto
    order = np.lexsort((col, total, row))
    first = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
    return col[first], total[first] // DIM


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.floor(SCALE * b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM))
        if np.abs(x).max(initial=0) > LARGEST:
            raise ValueError(f"a component of more than {LARGEST // SCALE}: its distances may not fit into 64 bits")
        data = np.ascontiguousarray(forward(x.astype(np.int64)).astype("<i4"))
        offsets = np.arange(len(x) + 1, dtype=np.int32) * (4 * DIM)
        packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([b.column(0), packed], ["id", "coefficients"])


def _coefficients(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, DIM).astype(np.int64)


def _summing(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's count, sum of distances (place 64) and sums of coefficients for each centroid it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), DIM + 1), dtype=object)
        counts = np.zeros(len(centroids), dtype=np.int64)
        for b in batches:
            x = _coefficients(b.column(0))
            near, distance = nearest(x, centroids)
            for k in np.unique(near):
                mine = near == k
                counts[k] += mine.sum()
                sums[k] += np.r_[x[mine].sum(axis=0), distance[mine].sum()]
        for k in np.flatnonzero(counts):
            lists = [pa.array([[str(v) for v in sums[k]]], type=pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([int(counts[k])]), *lists], ["cluster", "n", "sums"])

    return run


def _pass(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(count, sums) of each centroid that has vectors, over the whole table: one row per centroid comes to the driver."""
    parts = table.select("coefficients").mapInArrow(_summing(centroids), "cluster int, n bigint, sums array<string>")
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIM + 1)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(DIM + 1)]) for r in rows}


def _moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Each centroid that has vectors moves to the floor of their mean, component by component."""
    moved = centroids.copy()
    for k, (n, total) in sums.items():
        whole = backward(np.array(total[:DIM], dtype=object))
        moved[k] = forward(np.array([int(v) // n for v in whole], dtype=np.int64))
    return moved


def _judged(centroids: np.ndarray, inertia: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    texts = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in backward(centroids).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, distance = nearest(_coefficients(b.column(1)), centroids)
            columns = [pa.array(near, pa.int32()), pa.array(distance, pa.int64()), pa.array(np.array(inertia, dtype=np.int64)[near])]
            columns += [pa.array(np.full(len(near), sum(inertia), dtype=np.int64)), pa.array([texts[k] for k in near], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", *(c.split()[0] for c in RESULT.split(", "))])

    return run


def clustered(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """A row for each usable vector: its id, cluster, squared distance, the sums of distances and the hash of its centroid."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == DIM)
    usable = given.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    id_type = usable.schema["id"].dataType.simpleString()
    table = staged(usable.mapInArrow(_transformed, f"id {id_type}, coefficients binary"))
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [r["coefficients"] for r in table.orderBy(key, "coefficients").limit(centroids).collect()]
    schema = f"id {id_type}, {RESULT}"
    if not first:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    places = np.array([np.frombuffer(c, dtype="<i4") for c in first], dtype=np.int64)
    for _ in range(rounds):
        places = _moved(places, _pass(table, places))
    last = _pass(table, places)
    inertia = [last[k][1][DIM] if k in last else 0 for k in range(len(places))]
    return table.mapInArrow(_judged(places, inertia), schema).withColumnRenamed("id", id_column)
