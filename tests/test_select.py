import math

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.ordering import epoch_micros, hash_segments, id_segments, seeded_key, time_segments
from tallyloom.operators import select
from tallyloom.operators.joins import spread_join
from tallyloom.operators.position import dense_position, position_by_id
from tallyloom.operators.quantiles import MEDIAN, index_rank, order_statistics, weighted_statistics
from tallyloom.sources.sinks import assign_chunks


def ids(spark, n, step=1, start=0):
    return spark.range(n).select((F.col("id") * step + start).alias("id"))


@pytest.mark.parametrize("step,start", [(1, 0), (3, -500), (2**40 + 7, -(2**60))])
def test_position_by_id(spark, step, start):
    rows = position_by_id(ids(spark, 5000, step, start).repartition(9), "id", fine_bits=4).collect()
    assert sorted((r.id, r.pos) for r in rows) == [(i * step + start, i) for i in range(5000)]


def skewed(spark, n=6000):
    """One group holds most rows; groups and times may be null."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("g"), F.col("id") % 30)).alias("g"),
        F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(10_000_000_000))).alias("at"),
        "id",
    )


@pytest.mark.parametrize("hot_rows", [100, 10**6])
def test_position_in_groups(spark, hot_rows):
    df = skewed(spark)
    got = {r.id: r.pos for r in dense_position(df, ["at", "id"], time_segments(F.col("at"), 60, 1000), ("g",), hot_rows=hot_rows).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append((r.at is not None, r.at, r.id))
    assert got == {i: n for rows in groups.values() for n, (_, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1] or 0, x[2])))}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_join(spark, how):
    df = skewed(spark)
    table = df.groupBy("g").agg(F.max("id").alias("top")).filter("g is null or g <> 'g4'")
    got = spread_join(df, table, ["g"], "id", how, hot_rows=100)
    want = df.alias("a").join(table.alias("b"), F.expr("a.g <=> b.g"), how).select("a.g", "at", "id", "top")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_partition_count_does_not_matter(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for parts in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = ids(spark, 700).repartition(int(parts))
        results.append([sorted(map(tuple, f(df).collect())) for f in (
            lambda d: select.sample_random(d, 100), lambda d: select.sample_stride(d, 33, "id"),
            lambda d: select.split(d, 0.1), lambda d: select.shuffle(d, "id"))])
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("n", [0, 1, 40, 999, 1000, 5000])
def test_sample_random(spark, n):
    rows = select.sample_random(ids(spark, 1000), n).collect()
    size = 1000 if n <= 0 else min(n, 1000)
    assert len({r.id for r in rows}) == size
    assert sorted(r.pos for r in rows) == list(range(size))
    if size == 1000:
        assert [r.id for r in sorted(rows, key=lambda r: r.pos)] != list(range(1000))


def test_other_seed_other_sample(spark):
    take = lambda seed: {r.id for r in select.sample_random(ids(spark, 1000), 50, seed=seed).collect()}
    assert take(1) == take(1) and take(1) != take(2)


@pytest.mark.parametrize("size,limit", [(30, 22), (1000, 7), (10, 10), (10, 0), (997, 996)])
def test_stride(spark, size, limit):
    got = sorted(r.id for r in select.sample_stride(ids(spark, size), limit, "id").collect())
    whole = limit <= 0 or limit >= size
    assert got == (list(range(size)) if whole else [int(i * (size / limit)) for i in range(limit)])


def test_head(spark, monkeypatch):
    df = ids(spark, 500).repartition(5)
    assert sorted(r.id for r in select.head(df, 20, "id").collect()) == list(range(20))
    assert select.head(df, 0, "id").count() == 500
    monkeypatch.setattr(select, "TOP_K_ROWS", 10)
    assert sorted(r.id for r in select.head(df, 20, "id").collect()) == list(range(20))


@pytest.mark.parametrize("n,f", [(60, 0.05), (61, 0.05), (2, 0.9), (100, 0.999)])
def test_split(spark, n, f):
    for shuffled in (True, False):
        rows = select.split(ids(spark, n), f, shuffled=shuffled).collect()
        held = {r.id for r in rows if r.split == "validation"}
        assert len(rows) == n and len(held) == math.ceil(f * n)
        if not shuffled:
            assert held == set(range(n - len(held), n))


def test_split_caps_and_errors(spark):
    rows = select.split(ids(spark, 100), 0.2, max_train=30, max_validation=500).collect()
    assert sum(r.split == "train" for r in rows) == 30 and sum(r.split == "validation" for r in rows) == 20
    for f in (0, 1, 1.5):
        with pytest.raises(ValueError):
            select.split(ids(spark, 10), f)
    with pytest.raises(Exception, match="at least 2"):
        select.split(ids(spark, 1), 0.5).collect()


def test_dedupe(spark):
    """A third of all rows are copies of one text."""
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "copy").otherwise((F.col("id") % 100).cast("string")).alias("t")
    )
    key = F.sha2("t", 256)
    once = select.dedupe(df.repartition(8), key, "id")
    first = {}
    for r in df.orderBy("id").collect():
        first.setdefault(r.t, r.id)
    assert {r.t: r.id for r in once.collect()} == first
    assert select.dedupe(once, key, "id").count() == len(first)


def test_chunks(spark):
    rows = assign_chunks(ids(spark, 2500), "id", 1000).groupBy("part", "label").count().orderBy("part").collect()
    assert [tuple(r) for r in rows] == [(1, "part001", 1000), (2, "part002", 1000), (3, "part003", 500)]
    assert {r.label for r in assign_chunks(ids(spark, 10), "id", 10).collect()} == {""}
    assert {r.label for r in assign_chunks(ids(spark, 10), "id", 0).collect()} == {""}
    labels = {r.label for r in assign_chunks(ids(spark, 1000), "id", 1).collect()}
    assert "part0001" in labels and "part1000" in labels


def test_union(spark):
    a, b = ids(spark, 3).withColumn("t", F.lit("a")), ids(spark, 2).select(F.lit("b").alias("t"), "id")
    assert select.union_sources(a, b).count() == 5
    with pytest.raises(ValueError):
        select.union_sources()


@pytest.mark.parametrize("n", [1, 2, 8, 19, 20, 40, 3001])
def test_order_statistics(spark, n):
    df = spark.range(n).select((F.col("id") % 2 * 0).alias("k"), F.col("id").cast("double").alias("v"))
    r = order_statistics(df, ["k"], ["v"], {**MEDIAN, "p95": index_rank(0.95)}).first()
    assert (r.v_lo, r.v_hi, r.v_p95) == ((n - 1) // 2, n // 2, min(n - 1, int(n * 0.95)))


def test_buckets_follow_the_order_of_doubles(spark):
    import random
    import struct

    rng = random.Random(3)
    near = [struct.unpack("<d", struct.pack("<q", struct.unpack("<q", struct.pack("<d", b))[0] + i))[0] for b in (1.0, 0.1, 7e200) for i in range(-40, 40)]
    values = [*near, *(rng.uniform(-2, 2) * 10 ** rng.randint(-320, 300) for _ in range(3000)), 0.0, -0.0, 5e-324, 1.7976931348623157e308, float("inf"), -float("inf")]
    from tallyloom.operators.quantiles import bucket

    df = spark.createDataFrame([(v,) for v in values] + [(float("nan"),)], "v double").withColumn("b", bucket(F.col("v")))
    found = [r.b for r in df.orderBy("v").collect()]
    assert found == sorted(found)


def test_order_statistics_run_nothing_while_planned_and_read_twice(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v")).write.parquet(f"{tmp_path}/t")
    group = "order-statistics-plan"
    df = spark.read.parquet(f"{tmp_path}/t")
    spark.sparkContext.setJobGroup(group, group)
    got = order_statistics(df, ["k"], ["v"], MEDIAN, [F.sum("v").alias("s")])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    got.collect()
    spark.sparkContext.setJobGroup("", "")
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("FileScan parquet" in line for line in plan.splitlines()) - sum("ReusedExchange" in line for line in plan.splitlines()) <= 3


def test_weighted_statistics(spark):
    df = spark.createDataFrame([("a", 3.0, 5), ("a", 1.0, 4), ("a", 3.0, 1), ("b", 2.0, 1), ("c", None, 4)], "k string, v double, n long")
    got = {r.k: (r.v_lo, r.v_hi, r.v_p95) for r in weighted_statistics(df, ["k"], "v", "n", {**MEDIAN, "p95": index_rank(0.95)}).collect()}
    assert got == {"a": (3.0, 3.0, 3.0), "b": (2.0, 2.0, 2.0)}


def test_order_statistics_with_ties_and_nulls(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("k"),
        F.when(F.col("id") % 7 == 0, 5.0).when(F.col("id") % 7 != 1, F.pmod(F.xxhash64("id"), F.lit(1000)) / 7.0).alias("v"),
    )
    got = {r.k: (r.v_lo, r.v_hi, r.v_p95) for r in order_statistics(df, ["k"], ["v"], {**MEDIAN, "p95": index_rank(0.95)}).collect()}
    groups = {}
    for r in df.collect():
        if r.v is not None:
            groups.setdefault(r.k, []).append(r.v)
    for k, v in groups.items():
        v.sort()
        n = len(v)
        assert got[k] == (v[(n - 1) // 2], v[n // 2], v[min(n - 1, int(n * 0.95))])


def test_seeded_key_is_even(spark):
    keyed = spark.range(20_000).select(hash_segments(seeded_key(F.col("id"), 42))[0].alias("s"))
    low, high = keyed.agg(F.min("s"), F.max("s")).first()
    assert 0 <= low < 100 and 65_400 < high < 65_536
    assert len(id_segments(F.lit(1))) == 2


def test_epoch_micros_in_any_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.000001' AS n, TIMESTAMP'2024-03-10 02:30:00.000001Z' AS z")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = df.select(epoch_micros(df, "n").alias("n"), epoch_micros(df, "z").alias("z")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert row.n == row.z == 1710037800000001
