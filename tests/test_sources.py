import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.records import normalize
from tallyloom.sources import json_arrays, json_records, sinks
from tallyloom.sources.files import scratch_dir
from tallyloom.sources.lines import read_prompts
from tallyloom.sources.resolve import resolve_sources, split_entries

MIXED = [{"instruction": "a", "input": 1}, {"prompt": "b"}, "text", 5, None, [1], {"question": {"z": 1, "a": [True]}}]


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def base(path):
    return [os.path.basename(p) for p in path]


def test_scan_arrays(spark, tmp_path):
    files = [write(f"{tmp_path}/m.json", json.dumps(MIXED, indent=1)), write(f"{tmp_path}/e.json", "[]"), write(f"{tmp_path}/n.json", '[{"task":"é"}]')]
    rows = json_records.scan_arrays(spark, files).select("source_file", "pos", F.to_json("record").alias("j")).collect()
    got = {(r.source_file, r.pos): r.j for r in rows}
    assert len(got) == 8 and json.loads(got["n.json", 0]) == {"task": "é"}
    assert [json.loads(got["m.json", i]) if got["m.json", i] else None for i in range(7)] == MIXED


@pytest.mark.parametrize("text", ['{"a": 1}', "[1, 2", "3", '[1] {"b": 2}', "[1], [2]", "[1] x", "[1, [2]", '["a', "[1,,2]", "[1]]", '[{"a": 1}]\n[{"b": 2}', "x[1]"])
def test_scan_rejects_what_is_no_array(spark, tmp_path, text):
    with pytest.raises(Exception):
        json_records.scan_arrays(spark, [write(f"{tmp_path}/bad.json", text)]).collect()


TRICKY = ["", ",", "],[", '"', "\\", '\\",[', "a,b", {"k,[": ["]", {"x": [1, [2, "}"]]}], "": {}}, [], [[]], [1, [2, ","]], None, True, -1.5e300, "é\u0000\n\t", "\ufeff", "] [", {"a": "]\n["}]


@pytest.mark.parametrize("split", [211, 10**8])
def test_scan_arrays_of_any_form(spark, tmp_path, split):
    """Elements that hold commas, quotes, brackets and escapes, in files cut at any byte."""
    dump = lambda v, **k: json.dumps(v, ensure_ascii=k.pop("ascii", False), **k)
    forms = {
        "compact.json": (dump(TRICKY, separators=(",", ":")), TRICKY),
        "pretty.json": ("\ufeff \r\n" + dump(TRICKY, indent=3) + "\n\n", TRICKY),
        "escaped.json": (dump(TRICKY, ascii=True), TRICKY),
        "lines.json": ("\n".join(dump([t, t]) for t in TRICKY), [x for t in TRICKY for x in (t, t)]),
        "several.json": ("".join(dump(TRICKY[:i]) + " \t" for i in range(len(TRICKY))), [t for i in range(len(TRICKY)) for t in TRICKY[:i]]),
        "single.json": ("".join(dump([t]) for t in TRICKY), TRICKY),
        "empty.json": ("[ ]\n[]", []),
        "nothing.json": ("", []),
    }
    files = [write(f"{tmp_path}/{name}", text) for name, (text, _) in forms.items()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = json_records.scan_arrays(spark, files, keep_raw=True).select("source_file", "pos", "raw", F.to_json("record").alias("j")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for name, (_, want) in forms.items():
        mine = sorted((r for r in rows if r.source_file == name), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(want))), name
        assert [json.loads(r.raw) for r in mine] == want, name
        assert [json.loads(r.j) if r.j else None for r in mine] == want, name


def test_one_array_is_many_tasks(spark, tmp_path):
    path = write(f"{tmp_path}/wide.json", json.dumps([{"n": n, "t": "x,]" * 50} for n in range(4000)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", os.path.getsize(path) // 20)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        assert json_arrays._fragments(spark, [path]).rdd.getNumPartitions() >= 20
        rows = json_records.scan_arrays(spark, [path]).select("pos", F.expr("record:n::int").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(tuple(r) for r in rows) == [(n, n) for n in range(4000)]


def test_array_above_one_variant(spark, tmp_path):
    big = write(f"{tmp_path}/big.json", json.dumps([{"own": n, "instruction": "x" * 1_000_000} for n in range(140)]))
    rows = json_records.scan_records(spark, [big]).select("pos", F.expr("record:own::int").alias("own"), F.expr("length(record:instruction::string)").alias("n"))
    assert sorted(tuple(r) for r in rows.collect()) == [(n, n, 1_000_000) for n in range(140)]


def test_arrays_and_lines_are_told_apart(spark, tmp_path):
    files = [
        write(f"{tmp_path}/a.json", " \n" + json.dumps([{"prompt": f"a{n}"} for n in range(3)])),
        write(f"{tmp_path}/b.jsonl", "\n".join(json.dumps({"prompt": f"b{n}"}) for n in range(2))),
        write(f"{tmp_path}/e.json", ""),
    ]
    rows = json_records.in_file_order(spark, json_records.scan_records(spark, files), files).orderBy("id")
    assert [r.p for r in rows.select(F.expr("record:prompt::string").alias("p")).collect()] == ["a0", "a1", "a2", "b0", "b1"]


def test_scan_lines(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several byte ranges per file
    try:
        files = [write(f"{tmp_path}/{n}.jsonl", "".join(json.dumps({"prompt": f"{n}{i}"}) + "\n" for i in range(500))) for n in "ab"]
        rows = json_records.scan_lines(spark, files).select("source_file", "pos", F.expr("record:prompt::string").alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r.source_file, r.pos): r.p for r in rows} == {(f"{n}.jsonl", i): f"{n}{i}" for n in "ab" for i in range(500)}
    with pytest.raises(Exception):
        json_records.scan_lines(spark, [write(f"{tmp_path}/bad.jsonl", '{"a": 1}\n{bad\n')]).collect()


def test_prompts(spark, tmp_path):
    path = write(f"{tmp_path}/p.txt", " one \n\n\t\r\n two \nthree")
    assert sorted(r.prompt for r in read_prompts(spark, path).collect()) == ["one", "three", "two"]


def test_resolve(spark, tmp_path, monkeypatch):
    here, there = tmp_path / "cwd", tmp_path / "base"
    for p in ("b.json", "a.json", "sub/c.json", "sub/deep/d.json", "default.json", "valid.json", "a.txt"):
        write(f"{there}/{p}", "[]")
    write(f"{here}/a.json", "[]")
    monkeypatch.chdir(here)
    go = lambda **o: resolve_sources(spark, o, str(there), "default.json", "valid.json")

    s = go()
    assert (base(s.train), s.train_mode, base(s.validation), s.validation_mode) == (["default.json"], "default", ["valid.json"], "default")
    s = go(TRAIN_FILES="b.json, a.json\nb.json,", DATASET_FILES="x")
    assert base(s.train) == ["b.json", "a.json"] and "/cwd/" in s.train[1] and (s.train_mode, s.validation, s.validation_mode) == ("TRAIN_FILES", [], "auto_split")
    assert base(go(DATASET_GLOB="sub/**/*.json").train) == ["c.json", "d.json"]
    assert base(go(DATASET_GLOB=f"{there}/[ab].*").train) == ["a.json", "a.txt", "b.json"]
    assert base(go(DATASET_GLOB="*.json").train) == ["a.json"]  # the working folder comes first
    assert base(go(DATASET_FILES=f"{there}/*").train) == ["a.json", "a.txt", "b.json", "default.json", "valid.json"]
    s = go(TRAIN_FILE="b.json", TRAIN_FILES="")
    assert (base(s.train), s.train_mode, s.validation_mode) == (["b.json"], "TRAIN_FILE", "default")
    s = go(DATASET_FILES="b.json", VALID_FILE="a.json")
    assert (base(s.validation), s.validation_mode) == (["a.json"], "VALID_FILE")
    assert base(go(DATASET_DIR=str(there / "sub"), TRAIN_FILE="c.json", VALID_FILE="c.json").train) == ["c.json"]
    with pytest.raises(FileNotFoundError):
        go(TRAIN_FILES="nothing*.json")
    assert split_entries(" a ,\n b,,") == ["a", "b"]


def test_write_records(spark, tmp_path):
    path = f"{tmp_path}/new/dir"
    sinks.write_records(spark.createDataFrame([("é\n", 1)], "t string, i int"), path)
    text = "".join(open(f"{path}/{f}", encoding="utf-8").read() for f in os.listdir(path) if f.endswith(".json"))
    assert text == '{"t":"é\\n","i":1}\n'


def visible(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("."))


def numbered(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("é"), F.col("id")).alias("t")).repartition(4)


@pytest.mark.parametrize("pretty", [False, True])
def test_chunk_files(spark, tmp_path, pretty):
    folder = f"{tmp_path}/c"
    names = sinks.write_chunk_files(numbered(spark, 25), folder, "sub.set", ".json", "id", 10, pretty)
    assert names == visible(folder) == [f"sub.set.part00{i}.json" for i in (1, 2, 3)]
    read = []
    for name in names:
        text = open(f"{folder}/{name}", encoding="utf-8").read()
        want = [{"id": i, "t": f"é{i}"} for i in range(len(read), min(25, len(read) + 10))]
        if pretty:
            assert text == json.dumps(want, ensure_ascii=False, indent=2) + "\n"
        else:
            assert [json.loads(x) for x in text.splitlines()] == want
        read += want
    assert len(read) == 25
    # One file has no number, and those of the earlier output are gone; other files stay.
    write(f"{folder}/sub.set.notes.json", "{}")
    assert sinks.write_chunk_files(numbered(spark, 7), folder, "sub.set", ".json", "id", 10, pretty) == ["sub.set.json"]
    assert visible(folder) == ["sub.set.json", "sub.set.notes.json"]
    assert json_records.scan_records(spark, [f"{folder}/sub.set.json"]).count() == 7
    assert sinks.write_chunk_files(numbered(spark, 12), folder, "sub.set", ".json", "id", 0) == ["sub.set.json"]
    assert spark.read.json(f"{folder}/sub.set.json").count() == 12


def test_chunk_commit_stops_anywhere(spark, tmp_path, monkeypatch):
    """The commit is stopped before each of its moves and deletions in turn and run again."""
    done = sinks.commit_chunk_files
    for steps in range(6):
        folder = f"{tmp_path}/{steps}"
        monkeypatch.setattr(sinks, "commit_chunk_files", lambda *a: [])
        sinks.write_chunk_files(numbered(spark, 25), folder, "s", ".json", "id", 10)
        write(f"{folder}/s.part004.json", "old")
        write(f"{folder}/s.part002.json", "old")
        left = [steps]

        def stopping(real):
            def call(*args):
                if left[0] == 0:
                    raise KeyboardInterrupt
                left[0] -= 1
                return real(*args)

            return call

        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(sinks, "move", stopping(sinks.move))
            m.setattr(sinks, "delete", stopping(sinks.delete))
            done(spark, folder, "s", ".json")
            raise KeyboardInterrupt
        if os.path.exists(f"{folder}/s.staged"):
            done(spark, folder, "s", ".json")
        assert visible(folder) == [f"s.part00{i}.json" for i in (1, 2, 3)]
        assert sorted(r.id for r in spark.read.json(f"{folder}/s.part*.json").collect()) == list(range(25))


def test_checkpoint_writes_stop_anywhere(spark, tmp_path):
    path = f"{tmp_path}/run"
    at = lambda n: spark.createDataFrame([("m", i, float(i)) for i in range(n)], "model string, level bigint, tps double")
    levels = lambda: len(sinks.read_checkpoint(spark, path).first().completed)
    for n in (1, 2, 3, 4, 5):
        sinks.write_checkpoint(at(n), path, ["model"])
        assert levels() == n
    assert len(os.listdir(path)) == 1 + sinks.KEPT_SNAPSHOTS
    # A write that has written nothing, or some files but no marker.
    os.makedirs(f"{path}/snapshot-000000006")
    assert levels() == 5
    write(f"{path}/snapshot-000000006/part-00000.parquet", "half a file")
    assert levels() == 5
    sinks.write_checkpoint(sinks.read_checkpoint(spark, path).select("model", F.explode("completed").alias("level", "s")).select("model", F.col("level").cast("bigint"), "s.*"), path, ["model"])
    assert levels() == 5 and sorted(os.listdir(path))[-1] == "snapshot-000000006"


def test_results_and_checkpoint(spark, tmp_path):
    path, keep = f"{tmp_path}/results", scratch_dir(spark, "run")
    rows = [("org/a b", 4, 1.5), ("org/a b", 1, 2.5)]
    df = spark.createDataFrame(rows, "model string, level bigint, tps double")
    assert sinks.read_checkpoint(spark, keep) is None
    sinks.write_checkpoint(df, keep, ["model"])
    assert {k: v.tps for k, v in sinks.read_checkpoint(spark, keep).first().completed.items()} == {"1": 2.5, "4": 1.5}
    sinks.finish_run(spark, df, path, keep, ["model"])
    doc = json.loads("".join(open(f"{path}/{f}").read() for f in os.listdir(path) if f.endswith(".json")))
    assert doc == {"model": "org/a b", "file_name": "benchmark_results_org--a_b", "results": [{"level": 1, "tps": 2.5}, {"level": 4, "tps": 1.5}]}
    assert sinks.read_checkpoint(spark, keep) is None
