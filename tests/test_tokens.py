import pytest
from pyspark.sql import functions as F

from tallyloom.operators import tokens

ENCODED = "id bigint, full_ids array<int>, prompt_len int"


def features(spark, rows, length):
    return tokens.mask_labels(spark.createDataFrame(rows, ENCODED), length)


def test_mask_and_truncate(spark):
    r = features(spark, [(0, list(range(10, 20)), 4)], 8).first()
    assert r.input_ids == list(range(10, 18)) and r.attention_mask == [1] * 8
    assert r.labels == [-100] * 4 + [14, 15, 16, 17]
    assert r.was_truncated and r.length == 8


def test_prompt_fills_the_row(spark):
    df = features(spark, [(0, [1, 2, 3, 4, 5], 3), (1, [1, 2, 3, 4], 2), (2, [1, 2], 2), (3, [], 0)], 3)
    labels = {r.id: r.labels for r in df.collect()}
    assert labels == {0: [-100] * 3, 1: [-100, -100, 3], 2: [-100, -100], 3: []}
    assert [r.id for r in tokens.filter_trainable(df).collect()] == [1]
    with pytest.raises(ValueError):
        tokens.require_rows(tokens.filter_trainable(df).filter("id = 0"), "no rows left")


def test_reports(spark):
    df = features(spark, [(i, list(range(i)), 2) for i in range(1, 7)], 4).withColumn("split", F.lit("train"))
    assert tokens.truncation_report(df).first()[1:] == (2, 6)
    assert tokens.stage_counts(df).first()[1:] == (6, 4)


def test_padding(spark):
    rows = [(0, list(range(3)), 1), (1, list(range(9)), 1)]
    df = features(spark, rows, 512).withColumn("batch_id", F.lit(0))
    padded = tokens.pad_batches(df, 7).orderBy("id").collect()
    assert [len(r.input_ids) for r in padded] == [len(r.labels) for r in padded] == [len(r.attention_mask) for r in padded] == [16, 16]
    assert padded[0].input_ids == [0, 1, 2] + [7] * 13
    assert padded[0].attention_mask == [1] * 3 + [0] * 13 and padded[0].labels == [-100, 1, 2] + [-100] * 13
    assert [len(r.labels) for r in tokens.pad_batches(df, 0, 0).collect()] == [9, 9]


def test_batches(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 512).otherwise(F.col("id") % 50).cast("int").alias("length"))
    grouped = tokens.length_batches(df.repartition(6), "id", 16)
    arrival = tokens.arrival_batches(df, "id", 16)
    want = {r.id: n // 16 for n, r in enumerate(sorted(df.collect(), key=lambda r: (r.length, r.id)))}
    assert {r.id: r.batch_id for r in grouped.collect()} == want
    assert {r.id: r.batch_id for r in arrival.collect()} == {i: i // 16 for i in range(1000)}
    waste = lambda d: tokens.batch_report(d).agg(F.sum("padding")).first()[0]
    assert waste(grouped) < waste(arrival)
    assert tokens.batch_report(grouped).filter("padded_length % 8 <> 0").isEmpty()


TEXTS = [("Explain risk.", "", "It is é."), ("a b", "ctx", ""), ("x " * 600, "", "y")]


def records(spark):
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "id int, instruction string, input string, output string")


def test_prompt_is_a_prefix(spark):
    df = tokens.tokenize(records(spark), "finance", max_length=10_000)
    longer = tokens.tokenize(records(spark).withColumn("output", F.lit("other")), "finance", max_length=10_000)
    both = df.select("id", "prompt_len", F.expr("slice(full_ids, 1, prompt_len)").alias("p")).join(
        longer.select("id", F.expr("slice(full_ids, 1, prompt_len)").alias("q")), "id"
    )
    assert both.filter("p <> q or prompt_len < 50").isEmpty() and both.count() == 3
    assert tokens.tokenize(records(spark), "finance", max_length=64).filter("prompt_len <> 64").isEmpty()


def test_external_tokenizer(spark):
    by_word = tokens.external_tokenizer(lambda: lambda texts: [[len(w) for w in t.split()] for t in texts])
    df = tokens.tokenize(records(spark), "finance", "plain", tokenizer=by_word, max_length=10_000)
    plain = tokens.mask_labels(df, 10_000)
    assert tokens.filter_trainable(plain).count() >= 2
    from tallyloom.operators.records import build_messages
    from tallyloom.functions.templates import render_chat

    texts = {r.id: r.t for r in records(spark).select("id", render_chat(build_messages("finance"), "plain").alias("t")).collect()}
    assert {r.id: r.full_ids for r in df.collect()} == {i: [len(w) for w in t.split()] for i, t in texts.items()}


def test_filters_do_not_repeat_the_tokenizer(spark):
    df = tokens.filter_trainable(tokens.mask_labels(tokens.tokenize(records(spark))))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") <= 2  # one transform per use of the generated column's source
