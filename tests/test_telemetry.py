import pytest
from pyspark.sql import functions as F

from tallyloom.functions.durations import duration_text, interval_value, next_step
from tallyloom.functions.rounding import round_even
from tallyloom.operators import catalog, telemetry


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_training_plan(spark):
    plan = telemetry.training_plan(spark.range(160_000)).first()
    assert (plan.effective_batch, plan.steps_per_epoch, plan.planned_epochs, plan.total_steps, plan.eval_count, plan.save_count) == (16, 10_000, 1.0, 10_000, 10, 10)
    capped = telemetry.training_plan(spark.range(100), 2, 2, 4, max_steps=14, eval_interval="x", save_interval=5).first()
    assert (capped.effective_batch, capped.steps_per_epoch, capped.planned_epochs, capped.total_steps, capped.eval_count, capped.save_count) == (16, 7, 2.0, 14, 0, 2)
    assert telemetry.training_plan(spark.range(0)).first().total_steps == 1
    assert telemetry.accumulation_steps(16, 5) == 4 and telemetry.accumulation_steps(1, 8) == 1


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_progress(spark, monkeypatch, hot_rows):
    from tallyloom.operators import joins

    monkeypatch.setattr(joins.spread_join, "__defaults__", ("inner", hot_rows))
    log = spark.createDataFrame([(1, 0, 0, 10_000), (1, 2_530_000_000, 1250, 10_000), (1, 1, 5, 0), (1, 4_000_000_000, 12_000, 10_000)], "run_id int, micros bigint, step bigint, max_steps bigint")
    rows = telemetry.progress(log).orderBy("step").select(
        "pct", duration_text(F.col("elapsed_s")).alias("e"), duration_text(F.col("eta_s")).alias("eta")
    ).collect()
    assert [tuple(r) for r in rows] == [(12.5, "42m10s", "4h55m"), (100.0, "1h06m", "unknown")]


@pytest.mark.parametrize("seconds,text", [(None, "unknown"), (0.0, "unknown"), (-3.0, "unknown"), (0.4, "0s"), (59.0, "59s"), (60.0, "1m00s"), (3599.9, "59m59s"), (3600.0, "1h00m"), (360000.0, "100h00m")])
def test_duration(spark, seconds, text):
    assert one(spark, duration_text(F.lit(seconds).cast("double"))) == text


@pytest.mark.parametrize("step,k,end,want", [(1250, 1000, 10000, 2000), (9500, 1000, 9900, None), (5, 0, 10, None), (10, 5, 10, None), (1000, 1000, 3000, 2000)])
def test_next_step(spark, step, k, end, want):
    assert one(spark, next_step(F.lit(step), F.lit(k), F.lit(end))) == want


@pytest.mark.parametrize("text,want", [("1000", 1000), (" 7 ", 7), ("-4", 0), ("1.5", 0), ("x", 0), (None, 0)])
def test_interval(spark, text, want):
    assert one(spark, interval_value(F.lit(text).cast("string"))) == want


def test_latest_checkpoint(spark):
    rows = [("r", "o/checkpoint-9", 1), ("r", "o/checkpoint-10", 2), ("r", "o/checkpoint-x", 3), ("s", "o/checkpoint-a", 1), ("s", "p/checkpoint-b", 2)]
    got = telemetry.latest_checkpoint(spark.createDataFrame(rows, "run_id string, path string, seq int")).collect()
    assert {r.run_id: r.path for r in got} == {"r": "o/checkpoint-10", "s": "p/checkpoint-b"}


def test_catalog(spark):
    text = ["a|2|first | with bar", "b|x|bad number", "c|0|zero", "a|4|second", "d"]
    lines = spark.createDataFrame(list(enumerate(text)), "pos int, line string")
    parsed = catalog.parse_catalog(lines, keep=("pos",))
    assert parsed.filter("pos = 0").first()[1:] == ("a", 2, "first | with bar")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("nvidia/MiniMax-M3-DSpark",), ("zzz",), (None,)], "model string")
    got = {r.model: r.gpus for r in catalog.lookup_gpus(rows, parsed, "model", "pos").collect()}
    assert got == {"a": 2, "b": 1, "c": 1, "nvidia/MiniMax-M3-DSpark": 4, "zzz": 1, None: 1}
    forced = catalog.lookup_gpus(rows, parsed, "model", "pos", override=F.lit(3))
    assert {r.gpus for r in forced.collect()} == {3}


def test_layers(spark):
    df = spark.createDataFrame([("8", 2), ("", 2), (None, None)], "o string, v int")
    assert [r.x for r in df.select(catalog.layered(F.col("o"), F.col("v"), F.lit(5)).alias("x")).collect()] == ["8", "2", "5"]


def test_round_even_keeps_null(spark):
    assert one(spark, round_even(F.lit(None).cast("double"), 2)) is None
