import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import fixed_values as fv
from tallyloom.functions.pretty import choose, exact_text, pretty_json
from tallyloom.functions.templates import render_chat, user_prompt
from tallyloom.functions.text import is_empty, is_falsy, strip, to_text
from tallyloom.operators import records
from tallyloom.operators.select import content_key


def variants(spark, values):
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, raw string").withColumn("record", F.parse_json("raw"))


def column(df, expr):
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_strip_equals_python(spark):
    texts = [chr(c) + "a b" + chr(c) for c in range(1, 0x3100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert column(df, strip(F.col("t"))) == [t.strip() for t in texts]


VALUES = [None, "", {}, [], 0, 0.0, False, "  ", "0", "{}", [None], {"a": None}, True, 1.5, "x"]


def test_empty_and_falsy_equal_python(spark):
    df = variants(spark, VALUES)
    assert column(df, is_empty(F.col("record"))) == [v is None or (type(v) in (str, dict, list) and not v) for v in VALUES]
    assert column(df, is_falsy(F.col("record"))) == [not v for v in VALUES]


def test_to_text(spark):
    df = variants(spark, [None, " \tx y\n", 0, True, {"b": 1, "a": "é"}, [1, "2"]])
    assert column(df, to_text(F.col("record"))) == ["", "x y", "0", "true", '{"a":"é","b":1}', '[1,"2"]']


def test_pretty_json_equals_python(spark):
    import random

    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(9 if depth < 4 else 6)
        if kind == 0:
            return rng.choice(["", "é", 'a"b', "\\", "},{", "a: [1, 2]", "\n\t", "/", "\u2028", "日本"])
        if kind == 1:
            return rng.choice([0, -7, 10**25, 123456])
        if kind == 2:
            return rng.choice([0.5, 1e16, 1.5e-7, 1e300, 12345678.9, 0.0001, 123456789012345.6, -2.5e-5, 1e22, 100.0, 2.5e-310])
        if kind < 6:
            return rng.choice([True, False, None])
        if kind == 6:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice("zyxabc") + str(i): value(depth + 1) for i in range(rng.randrange(4))}

    values = [value(0) for _ in range(200)] + [{}, [], [[]], [{}], {"a": {}}, [[], {}]]
    forms = [dict(), dict(separators=(",", ":")), dict(indent=5), dict(ensure_ascii=True)]
    texts = [json.dumps(v, **{"ensure_ascii": False, **rng.choice(forms)}) for v in values]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert column(df, pretty_json(F.col("t"))) == [json.dumps(v, ensure_ascii=False, indent=2) for v in values]
    plan = df.select(pretty_json(F.col("t")).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_chat_parts(spark):
    lists = [
        {"messages": [{"role": "User", "content": {"z": 1, "a": [True]}}, {"from": "human", "value": " x "}, {"role": "gpt", "text": [1.50]}, "no object", {"role": "user", "content": "", "text": "t"}]},
        {"messages": {}, "conversations": [{"speaker": "model", "content": "a"}]},
        {"messages": "text", "conversations": [{"role": "user", "content": "never"}]},
        {"messages": [], "conversations": None},
        [1],
    ]
    df = variants(spark, lists)
    parts = lambda roles: column(df, records.exact_chat_parts(F.col("record"), F.col("raw"), roles))
    asked = json.dumps({"z": 1, "a": [True]}, indent=2) + "\n\nx\n\nt"
    assert parts(fv.USER_ROLES) == [asked, "", "", "", ""]
    assert parts(fv.ASSISTANT_ROLES) == [json.dumps([1.5], indent=2), "a", "", "", ""]


def test_exact_text_keeps_order_and_indents(spark):
    df = variants(spark, [{"input": {"b": 1, "a": ["é"]}}, {"context": " s "}, {}])
    want = [json.dumps({"b": 1, "a": ["é"]}, ensure_ascii=False, indent=2), "s", ""]
    assert column(df, exact_text(choose(F.col("record"), fv.INPUT_KEYS), F.col("raw"))) == want


def test_alias_order(spark):
    df = variants(
        spark,
        [{"prompt": "p", "instruction": ""}, {"instruction": "  ", "prompt": "p"}, {"task": "t", "query": "q"}, {"other": 1}, {"prompt": 0}],
    )
    assert column(df, records.resolve_alias(F.col("record"), fv.INSTRUCTION_KEYS)) == ["p", "", "q", "", "0"]


def test_normalize(spark):
    user = {"role": "user", "content": "u"}
    df = variants(
        spark,
        [
            {"input": 0, "instruction": "i"},
            {"instruction": 0, "messages": [user]},
            {"messages": [{"role": "USER", "content": "a"}, {"from": "Gpt", "value": "b"}, {"role": "system", "text": "s"},
                          {"role": "tool", "content": "t"}, "noise", {"speaker": "human", "text": " c "}, {"role": "model", "content": {"k": 1}}]},
            {"messages": "text", "conversations": [user]},
            {"messages": [], "conversations": [user], "output": False},
            {"instruction": "own", "output": "o", "messages": [user]},
            {"messages": [{"role": " user", "content": "x"}, {"role": "", "from": "user", "content": 0, "value": "y"}]},
        ],
    ).withColumn("source_file", F.lit("f.json"))
    got = [tuple(r) for r in records.normalize(df, keep=("i",)).orderBy("i").drop("i").collect()]
    assert got == [
        ("i", "0", "", "f.json"),
        ("u", "", "", "f.json"),
        ("a\n\nc", "", 'b\n\n{"k":1}', "f.json"),
        ("", "", "", "f.json"),
        ("u", "", "", "f.json"),
        ("own", "", "o", "f.json"),
        ("y", "", "", "f.json"),
    ]


def test_chat_pairs_over_many_turns(spark):
    """Long conversations are put together from several segments."""
    n = 1000
    turns = spark.range(2 * n).select(
        (F.col("id") % 2).alias("conv_id"),
        F.floor(F.col("id") / 2).alias("turn"),
        F.when(F.floor(F.col("id") / 2) % 2 == 0, "User").otherwise("gpt").alias("role"),
        F.concat(F.lit(" "), F.floor(F.col("id") / 2).cast("string"), F.lit("\n")).alias("text"),
    ).repartition(7)
    rows = {r.conv_id: r for r in records.chat_pairs(turns).collect()}
    assert set(rows) == {0, 1}
    for r in rows.values():
        assert r.instruction == "\n\n".join(str(i) for i in range(0, n, 2))
        assert r.output == "\n\n".join(str(i) for i in range(1, n, 2))


def test_blank_context(spark):
    df = spark.createDataFrame([(0, "go", "  "), (1, "go", ""), (2, " go ", " c ")], "i int, ins string, inp string")
    texts = column(df, user_prompt(F.col("ins"), F.col("inp"), "finance", "export"))
    tail = fv.ANSWER_RULE.format(expert="an expert finance and market analysis assistant")
    assert texts[0] == "Instruction:\ngo\n\nContext / input data:\n" + tail
    assert texts[1] == "Instruction:\ngo" + tail
    assert texts[2] == "Instruction:\ngo\n\nContext / input data:\nc" + tail
    trained = column(df, user_prompt(F.col("ins"), strip(F.col("inp")), "finance", "train"))
    assert trained[0].startswith("Instruction:\ngo\n\nRespond as a finance and market analysis expert.")


def test_alpaca_and_sharegpt(spark):
    df = variants(spark, [{"instruction": " a ", "input": [], "output": None}, {"prompt": "p", "input": {"x": 1}, "output": "o"}])
    assert [tuple(r) for r in records.to_alpaca(df, keep=("i",)).orderBy("i").drop("i").collect()] == [("a", "", ""), ("", '{"x":1}', "o")]
    texts = spark.createDataFrame([("i", "", " o ")], "instruction string, input string, output string")
    said = records.to_sharegpt(texts, "cyber").first().conversations
    assert [m["from"] for m in said] == ["system", "human", "gpt"]
    assert said[0]["value"] == fv.SYSTEM_PROMPTS["cyber"] and said[2]["value"] == "o"


def test_calibration(spark):
    turn = {"role": "user", "content": "q"}
    df = variants(
        spark,
        [
            {"input": [turn], "output": "a", "messages": []},
            {"messages": [turn]},
            {"conversations": [{"from": "human", "value": "h"}, {"from": "system", "value": "s"}]},
            {"instruction": "i", "response": "r"},
            {"instruction": "i", "output": "", "response": "r"},
            {"instruction": "i"},
            {"text": "plain"},
        ],
    )
    plain = lambda m: render_chat(m, "plain")
    assert column(df, records.calibration_text(F.col("record"), plain)) == [
        "user: q\nassistant: a\n", "user: q\n", "user: h\nassistant: s\n", "user: i\nassistant: r\n", "user: i\nassistant: \n", "user: i\nassistant: \n", "plain",
    ]
    with pytest.raises(Exception, match=fv.CALIBRATION_ERROR):
        column(variants(spark, [{"other": 1}]), records.calibration_text(F.col("record"), plain))


def test_chatml(spark):
    df = spark.createDataFrame([(0, [("user", "q")])], "i int, m array<struct<role:string,content:string>>")
    assert column(df, render_chat(F.col("m"), "chatml", True)) == ["<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n"]


def test_multimodal(spark):
    texts = spark.createDataFrame([("i", "", "o")], "instruction string, input string, output string")
    m = texts.select(records.build_messages("cyber", multimodal=True).alias("m")).first().m
    assert [(x.role, x.content[0].type) for x in m] == [("system", "text"), ("user", "text"), ("assistant", "text")]


def test_content_key(spark):
    import hashlib

    df = variants(spark, [{"instruction": 0, "prompt": " p ", "input": {"b": 1, "a": 2}, "answer": "x"}, "  text ", None, [1]])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [digest('p\n---\n{"a":2,"b":1}\n---\nx'), digest("text"), digest(""), digest("[1]")]
    assert column(df, content_key(F.col("record"))) == want
