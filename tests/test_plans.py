"""Whole runs over files, small enough to check by hand."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_requests import log
from test_sources import write

from tallyloom.plans import exports, request_reports, training_data


def read_named(folder, *names):
    assert sorted(f for f in os.listdir(folder) if not f.startswith(".")) == sorted(names)
    return [line for name in names for line in open(f"{folder}/{name}", encoding="utf-8").read().splitlines()]


def read_lines(path):
    found = [f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.startswith("part-") and not f.endswith(".crc")]
    return [line for f in sorted(found) for line in open(f, encoding="utf-8").read().splitlines()]


@pytest.mark.parametrize("lines", [True, False, None])
def test_read_instructions(spark, tmp_path, lines):
    sets = {
        "b c": [{"instruction": "i1", "input": {"z": 1, "a": [1, 2]}, "output": "o"}, {"prompt": "p", "answer": 7}],
        "a": [{"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "v"}]}],
    }
    dump = (lambda x: "\n".join(json.dumps(r) for r in x)) if lines else json.dumps
    paths = [write(f"{tmp_path}/{n}.json", dump(x)) for n, x in sets.items()]
    rows = training_data.read_instructions(spark, paths, lines).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        (0, "i1", json.dumps({"z": 1, "a": [1, 2]}, indent=2), "o", "b c.json"),
        (1, "p", "", "7", "b c.json"),
        (2, "u", "", "v", "a.json"),
    ]


def test_load_instructions(spark, tmp_path):
    many = [{"instruction": f"i{n}", "output": f"o{n}"} for n in range(60)]
    write(f"{tmp_path}/t.json", json.dumps(many))
    write(f"{tmp_path}/v.json", json.dumps(many[:5]))
    load = lambda **o: training_data.load_instructions(spark, o, str(tmp_path), "t.json", "v.json", lines=False)
    count = lambda df: {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert count(load()) == {"train": 60, "validation": 5}
    assert count(load(DATASET_FILES="t.json")) == {"train": 57, "validation": 3}
    assert count(load(DATASET_FILES="t.json", VALIDATION_SPLIT="0.5", MAX_TRAIN_SAMPLES="7")) == {"train": 7, "validation": 30}
    capped = load(MAX_TRAIN_SAMPLES="4", MAX_VALID_SAMPLES="2", SHUFFLE_DATASETS="no").filter("split = 'train'")
    assert sorted(r.instruction for r in capped.collect()) == ["i0", "i1", "i2", "i3"]


def test_training_features(spark):
    records = spark.createDataFrame([(i, f"i{i}", "", "o", "train") for i in range(5)], "id bigint, instruction string, input string, output string, split string")
    features = training_data.training_features(records, "finance")
    assert features.count() == 5 and {"input_ids", "labels", "length"} < set(features.columns)
    with pytest.raises(ValueError):
        training_data.training_features(records, "finance", max_length=3)


@pytest.mark.parametrize("mode", ["random", "head", "stride"])
def test_enrichment_subset(spark, tmp_path, mode):
    items = [{"instruction": f"i{n % 30}", "z": n, "input": {"b": 1, "a": "é"}} for n in range(50)] + ["5", 5, None, None]
    path = write(f"{tmp_path}/in.json", json.dumps(items))
    manifest = exports.enrichment_subset(spark, [path], f"{tmp_path}/out/sub.json", 20, mode=mode, chunk_size=8, dedupe=True)
    assert {r.label: r.rows for r in manifest.collect()} == {"part001": 8, "part002": 8, "part003": 4}
    got = [json.loads(x) for x in read_named(f"{tmp_path}/out", *[f"sub.part00{i}.json" for i in (1, 2, 3)])]
    unique = items[:30] + ["5", None]  # the number 5 has the text of the string "5"
    want = {"head": unique[:20], "stride": [unique[int(i * (32 / 20))] for i in range(20)]}
    assert len(got) == 20 and all(x in unique for x in got)
    assert mode == "random" or got == want[mode]
    assert mode != "random" or got != [x for x in unique if x in got]


def test_enrichment_keeps_everything(spark, tmp_path):
    path = write(f"{tmp_path}/in.jsonl", "\n".join(json.dumps({"a": i}) for i in range(30)))
    exports.enrichment_subset(spark, [path], f"{tmp_path}/out/all.jsonl", 0, mode="random", chunk_size=0)
    got = [json.loads(x)["a"] for x in read_named(f"{tmp_path}/out", "all.jsonl")]
    assert sorted(got) == list(range(30))


def test_exports(spark, tmp_path):
    items = [{"instruction": "i", "input": "", "output": {"k": 1, "a": [True]}}, {"instruction": {}, "input": " ", "output": 1.5}, {"instruction": " j ", "input": [1], "output": None}]
    path = write(f"{tmp_path}/d.json", json.dumps(items))
    exports.export_formats(spark, [path], "finance", f"{tmp_path}/d")
    shown = json.dumps(items[0]["output"], indent=2)
    alpaca = [json.loads(x) for x in read_lines(f"{tmp_path}/d_alpaca")]
    assert [tuple(a.values()) for a in alpaca] == [("i", "", shown), ("{}", "", "1.5"), ("j", json.dumps([1], indent=2), "")]
    talks = [json.loads(x)["conversations"] for x in read_lines(f"{tmp_path}/d_sharegpt")]
    assert [m["from"] for m in talks[0]] == ["system", "human", "gpt"] and talks[0][2]["value"] == shown
    assert ["Context / input data:" in t[1]["value"] for t in talks] == [False, True, True]


def test_calibration_set(spark):
    rows = [(i, json.dumps({"text": "a b c " * i})) for i in range(10)]
    df = spark.createDataFrame(rows, "id bigint, j string").select("id", F.parse_json("j").alias("record"))
    got = exports.calibration_set(df, rows=4, max_length=5).collect()
    assert {r.id: len(r.input_ids) for r in got} == {0: 0, 1: 3, 2: 5, 3: 5}


def test_run_report(spark, tmp_path):
    def results(texts):
        parts = [log(spark, t, level=lvl).withColumns({"total_time": F.lit(2.0), "output_tokens": F.lit(4).cast("bigint"), "tokens_per_sec": F.lit(4.0)}) for lvl, t in texts.items()]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return df.withColumns({"num_requests": F.lit(5), "max_tokens": F.lit(9), "temperature": F.lit(0.7)})

    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"
    first = request_reports.run_report(spark, results({1: "SSF", 2: "FFFS", 4: "S"}), out, ck).collect()
    assert [(r.level, r.requests_ok) for r in first] == [(1, 2)] and os.path.exists(ck) and not os.path.exists(out)
    # The second recording repeats the levels that are missing.
    second = request_reports.run_report(spark, results({1: "S", 2: "SS", 4: "FSS"}), out, ck).collect()
    assert sorted((r.level, r.requests_ok) for r in second) == [(1, 2), (2, 2), (4, 2)]
    assert not os.path.exists(ck) and os.path.exists(out)


def test_the_tokenizer_runs_once_a_row(spark):
    """Batches are made from the written features: their plan holds no tokenizer, and a row is tokenised once."""
    from tallyloom.operators import tokens

    runs_of = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            runs_of.add(len(texts))
            return [[1] * (len(t) % 7 + 1) for t in texts]

        return encode

    records = spark.createDataFrame([(i, f"i{i}", "", "o" * i, "train") for i in range(40)], "id bigint, instruction string, input string, output string, split string")
    masked = tokens.mask_labels(tokens.tokenize(records, tokenizer=tokens.external_tokenizer(load)))
    table = training_data.feature_table(masked, "id", "length", "input_ids", "attention_mask", "labels")
    padded = tokens.pad_batches(tokens.length_groups(table, "id", 4), 0)
    assert padded.count() == 40 and runs_of.value == 80  # prompt and whole text
    assert "Python" not in padded._jdf.queryExecution().executedPlan().toString()
