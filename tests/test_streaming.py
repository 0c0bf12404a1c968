"""Streams in several triggers, over files in any order, give what one batch gives."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_requests import S, chunk, log, streaks, usage

from tallyloom.operators import requests, runs
from tallyloom.plans import views
from tallyloom.streaming import closing, dedupe_stream
from tallyloom.streaming.dedupe_stream import dedupe_within, write_deduped
from tallyloom.streaming.request_stream import streamed_metrics
from tallyloom.streaming.rolling import rolling_counts, rolling_progress, rolling_summary, window_quantiles
from tallyloom.streaming.streak_stream import streamed_aborts

SF = "/root/testdata/sf0.001"
YEARS = "3650 days"


def arriving(spark, batches, path, start=0):
    """One file per trigger, in the order given."""
    for i, df in enumerate(batches, start):
        df.coalesce(1).write.mode("append").parquet(str(path))
        for f in os.listdir(path):
            if f.endswith(".parquet") and not f.startswith("at-"):
                os.rename(f"{path}/{f}", f"{path}/at-{i}.parquet")
        os.utime(f"{path}/at-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return lambda: spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def in_order(df, order, n):
    """Cut into n consecutive batches."""
    rows = sorted(df.collect(), key=lambda r: [r[c] for c in order])
    size = -(-len(rows) // n)
    return [df.sparkSession.createDataFrame(rows[i : i + size], df.schema) for i in range(0, len(rows), size)]


def run(spark, batches, path, step, time="ts"):
    """What a step gives for files that arrive in this order, and how many rows came late."""
    stream = arriving(spark, batches, f"{path}/in")
    late = closing.run_to_end(lambda: closing.to_files(step(stream()), str(path)), spark, f"{path}/in", batches[0].schema, time)
    return spark.read.schema(step(stream()).schema).parquet(f"{path}/rows"), late


def mixed(batches, seed):
    random.Random(seed).shuffle(batches)
    return batches


@pytest.mark.parametrize("files", [1, 6])
def test_request_metrics_in_any_file_order(spark, tmp_path, files):
    lines = views.stream_lines(spark, SF).withColumn("ts", F.timestamp_micros("micros"))
    got, late = run(spark, mixed(in_order(lines, ["micros", "seq"], files), 1), tmp_path, lambda s: streamed_metrics(s, idle=YEARS, late=YEARS))
    want = requests.request_metrics(lines)
    assert late == 0 and got.count() == want.count() and got.select(want.columns).exceptAll(want).isEmpty()


def test_idle_requests_stray_and_late_lines(spark, tmp_path):
    def make(rows):
        df = spark.createDataFrame(rows, "request_id bigint, seq bigint, micros bigint, line string")
        return df.withColumn("ts", F.timestamp_micros("micros"))

    batches = [
        make([(1, 2, 6 * S, "data: [DONE]"), (2, 0, 0, chunk(content="a")), (1, 0, 0, chunk(content="a")), (3, 0, 0, usage(4))]),
        make([(1, 3, 20 * S, chunk(content="stray")), (1, 1, 5 * S, usage(7)), (3, 1, 20 * S, chunk(content="b"))]),
        make([(3, 2, 45 * S, chunk(content="c"))]),
        make([(3, 3, 70 * S, "data: [DONE]"), (4, 0, 500 * S, chunk(content="d"))]),
        make([(4, 1, 501 * S, chunk(content="e"))]),
        make([(2, 1, 1 * S, chunk(content="far too late"))]),
    ]
    got, late = run(spark, batches, tmp_path, lambda s: streamed_metrics(s, idle="30 seconds", late="20 seconds"))
    rows = {r.request_id: (r.ttft, r.total_time, r.output_tokens, r.chunk_count) for r in got.collect()}
    assert late == 1 and got.count() == 4
    assert rows == {1: (0.0, 6.0, 7, 1), 2: (0.0, 0.0, 1, 1), 3: (20.0, 70.0, 4, 2), 4: (0.0, 1.0, 2, 2)}


def test_runs_of_keys_are_the_binary_digits():
    assert dedupe_stream.runs_before(0) == [] and dedupe_stream.runs_before(6) == [(0, 4), (4, 2)] and dedupe_stream.runs_before(7) == [(0, 4), (4, 2), (6, 1)]
    held = set()
    for b in range(200):
        assert set(dedupe_stream.runs_before(b)) <= held
        merged = dedupe_stream.completed_by(b)
        held.add((merged[0][0] if merged else b, 2 ** len(merged)))
        assert sum(n for _, n in dedupe_stream.runs_before(b)) == b


def test_dedupe(spark, tmp_path):
    """Copies in one trigger, in neighbouring and in far ones; the first arrival stays, and merged runs are gone."""
    df = spark.range(330).select("id", (F.col("id") % 70).cast("string").alias("t"))
    stream = arriving(spark, in_order(df, ["id"], 6), f"{tmp_path}/in")
    write_deduped(stream(), F.sha2("t", 256), "id", f"{tmp_path}/out", f"{tmp_path}/keys", f"{tmp_path}/ck", buckets=16).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(70))
    assert len(os.listdir(f"{tmp_path}/keys")) <= 5
    arriving(spark, [df.select((F.col("id") + 1000).alias("id"), "t"), spark.createDataFrame([(7, "new")], "id bigint, t string")], f"{tmp_path}/in", 6)
    write_deduped(stream(), F.sha2("t", 256), "id", f"{tmp_path}/out", f"{tmp_path}/keys", f"{tmp_path}/ck", buckets=16).awaitTermination()
    assert sorted((r.id, r.t) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted([(i, str(i)) for i in range(70)] + [(7, "new")])


def test_dedupe_within_a_horizon(spark, tmp_path):
    df = spark.range(40).select("id", F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 4).cast("string").alias("t"))
    stream = dedupe_within(arriving(spark, in_order(df, ["id"], 2), tmp_path / "in")(), F.col("t"), "ts", "1 hour")
    closing.to_files(stream, str(tmp_path)).awaitTermination()
    assert sorted(r.t for r in spark.read.parquet(f"{tmp_path}/rows").collect()) == ["0", "1", "2", "3"]


@pytest.mark.parametrize(("width", "files"), [("1 second", 7), ("45 seconds", 7), ("1 hour", 1)])
def test_aborts_in_any_file_order(spark, tmp_path, width, files):
    """Streaks inside a window, over two windows and over many."""
    texts = {"a": "SFFSSFSFFFSFFF", "b": "SFSFSSFFSFSFSF", "c": "FFSSFFSSSSSSFF", "d": "FFFFFFFFFFFFFF", "e": "SSSSFSSSSSSFFF"}
    df = None
    for m, t in texts.items():
        df = log(spark, t, m) if df is None else df.unionByName(log(spark, t, m))
    rows = df.select("model", "level", "micros", "request_id", "success").withColumn("ts", F.timestamp_micros("micros"))
    step = lambda s: streamed_aborts(s, ["model", "level"], "ts", "micros", "request_id", width=width, late="1 day")
    found, late = run(spark, mixed(in_order(rows, ["micros"], files), 2), tmp_path, step)
    got = {r.model: r.request_id for r in found.collect()}
    want = {m: next(i for i, s in enumerate(streaks(t)) if s == 3) for m, t in texts.items() if 3 in streaks(t)}
    assert late == 0 and got == want
    batch = runs.cut_off(df, ["model"], "level", "micros", "request_id").filter("abort_id is not null")
    assert got == {r.model: r.abort_id for r in batch.collect()}


def test_aborts_come_out_while_the_log_goes_on(spark, tmp_path):
    rows = log(spark, "SFFFSFFFSSSSSSSS").select("model", "level", "micros", "request_id", "success").withColumn("ts", F.timestamp_micros("micros"))
    stream = arriving(spark, in_order(rows, ["micros"], 4), f"{tmp_path}/in")
    closing.to_files(streamed_aborts(stream(), ["model", "level"], "ts", "micros", "request_id", width="20 seconds", late="1 second"), str(tmp_path)).awaitTermination()
    assert [r.request_id for r in spark.read.parquet(f"{tmp_path}/rows").collect()] == [3]


def test_rolling_summary_of_every_day(spark, tmp_path):
    reqs = views.requests(spark, SF).withColumn("ts", F.timestamp_micros("micros"))
    found, late = run(spark, mixed(in_order(reqs, ["micros"], 3), 3), tmp_path, lambda s: rolling_summary(s, ["level"], late=YEARS))
    got = {(r[0], r[1]): r[2] for r in found.select("window_start", "level", "requests_total").collect()}
    want = {(r[0], r[1]): r[2] for r in reqs.groupBy(F.unix_micros(F.date_trunc("day", "ts")), "level").count().collect()}
    assert late == 0 and got == want


def test_late_rows_are_counted(spark, tmp_path):
    reqs = views.requests(spark, SF).withColumn("ts", F.timestamp_micros("micros"))
    batches = in_order(reqs, ["micros"], 3)
    found, late = run(spark, [batches[2], batches[1], batches[0]], tmp_path, lambda s: rolling_summary(s, ["level"]))
    missing = reqs.count() - found.agg(F.sum("requests_total")).first()[0]
    assert 0 < late <= missing  # late rows of one day and level in a task count once


def test_window_quantiles(spark, tmp_path):
    reqs = views.requests(spark, SF).withColumn("ts", F.timestamp_micros("micros"))
    counts, late = run(spark, mixed(in_order(reqs, ["micros"], 3), 4), tmp_path, lambda s: rolling_counts(s, ["level"], "total_time", late=YEARS))
    got = {(r[0], r[1]): (r[2], r[3]) for r in window_quantiles(counts, ["level"], "total_time").collect()}
    values = {}
    for r in reqs.filter("success").select(F.unix_micros(F.date_trunc("day", "ts")).alias("d"), "level", "total_time").collect():
        values.setdefault((r.d, r.level), []).append(r.total_time)
    want = {}
    for key, v in values.items():
        v.sort()
        want[key] = ((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2.0, v[min(len(v) - 1, int(len(v) * 0.95))])
    assert late == 0 and got == want


def test_rolling_progress(spark, tmp_path):
    log_rows = views.progress_log(spark, SF).select("run_id", "micros", "step", "max_steps")
    stream = rolling_progress(arriving(spark, in_order(log_rows, ["micros"], 3), tmp_path / "in")())
    q = stream.writeStream.format("memory").queryName("prog").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.run_id: (r.step, r.pct) for r in spark.table("prog").collect()}
    assert got == {r.run_id: (r.n, 100.0) for r in log_rows.groupBy("run_id").agg(F.max("step").alias("n")).collect()}


def test_the_session_keeps_its_settings(spark, tmp_path):
    before = spark.conf.get(closing.PROVIDER)
    with pytest.raises(ValueError), closing.state_on_disk(spark):
        assert spark.conf.get(closing.PROVIDER) == closing.ROCKSDB
        raise ValueError
    assert spark.conf.get(closing.PROVIDER) == before
