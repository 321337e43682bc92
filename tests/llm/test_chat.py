"""Chat formatting: layouts by fingerprints, reversible marks, the loss mask, and nulls, ties, repeated rows and empty tables."""

import random

from pyspark.sql import functions as F

from siltspark.llm import chat

RECORDS = [
    (1, '{"messages":[{"role":"system","content":"s"},{"content":"hi","role":"user"},{"role":"assistant","content":null}]}', "messages", [("system", "s"), ("user", "hi"), ("assistant", "")]),
    (2, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"},{"from":"tool","value":"t"}],"id":7}', "from-value", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    (3, '{"instruction":"do","output":"done"}', "instruction", [("user", "do"), ("assistant", "done")]),
    (4, '{"instruction":"do","input":"this","output":"done","source":"x"}', "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    (5, '{"instruction":"do","input":" ","output":"done","system":"be kind"}', "instruction", [("system", "be kind"), ("user", "do"), ("assistant", "done")]),
    (6, '{"prompt":"p","response":"r"}', "prompt-response", [("user", "p"), ("assistant", "r")]),
    (7, '{"completion":"c","prompt":"p","system":null}', "prompt-completion", [("system", ""), ("user", "p"), ("assistant", "c")]),
    (8, '{"prompt":[{"role":"user","content":"p"}],"response":"r"}', "prompt-messages", [("user", "p"), ("assistant", "r")]),
    (9, '{"role":"user","text":"t","turn":3}', "row", [("user", "t")]),
    (10, '{"prompt":"p","answer":"r"}', None, None), (11, "[1]", None, None), (12, None, None, None), (13, "not json", None, None), (14, '{"messages":"x"}', None, None),
]


def records(spark, rows, columns="chat_id long, j string"):
    return spark.createDataFrame(rows, columns).select("*", F.try_parse_json("j").alias("record")).drop("j")


def test_layouts(spark):
    df = records(spark, [r[:2] for r in RECORDS])
    got = {r.chat_id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df).collect()}
    assert got == {i: (layout, turns) for i, _, layout, turns in RECORDS}
    unknown = {r.paths: r.n for r in chat.unknown_layouts(df.union(df)).collect()}
    assert unknown == {"OBJECT<answer: , prompt: >": 2, "ARRAY<>": 2, "OBJECT<messages: >": 2, None: 4}


def test_declared_paths_are_those_of_records(spark):
    j = '{"b":{"c":1.5,"a":[true]},"a":[{"z":"x"},{"y":[[1]]}],"e":null}'
    paths = records(spark, [(1, j)]).select(chat.field_paths(F.col("record")).alias("p")).first().p
    assert paths == "OBJECT<a: ARRAY<OBJECT<y: ARRAY<ARRAY<>>, z: >>, b: OBJECT<a: ARRAY<>, c: >, e: >"
    assert chat.declared_paths(("b.c", "b.a[]", "a[].z", "e")) == "OBJECT<a: ARRAY<OBJECT<z: >>, b: OBJECT<a: ARRAY<>, c: >, e: >"


def test_marks_are_escaped_reversibly(spark):
    rng = random.Random(2)
    parts = ["<turn>", "</turn>", "<says>", "\\", "<", "turn>", "/turn>", "\n", "é😀", "says>", "\\\\", "user", "### Assistant:", "<\\turn>"]
    texts = [""] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(600)] + ["<turn>" * 30_000]
    rows = [(k % 40, k, rng.choice(texts[:50] + ["assistant"] * 40), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "chat_id long, position long, role string, text string").repartition(3).select("chat_id", "position", F.to_variant_object(F.struct("role", "text")).alias("record"))
    made = chat.format_chats(df)
    plain = made.select("formatted", "loss").collect()
    for r in plain:
        assert r.formatted.count("<turn>") == r.formatted.count("<says>") == r.formatted.count("</turn>\n") == r.formatted.count("</turn>")
    got = {r.chat_id: r for r in chat.read_chats(made).collect()}
    for c in range(40):
        want = [x[2:] for x in rows if x[0] == c]
        assert [tuple(t) for t in got[c].turns] == want and got[c].learned == [t for role, t in want if role == "assistant"]
    assert sorted(r.formatted_chars for r in got.values()) == sorted(len(r.formatted) for r in plain)


def test_nulls_ties_and_empty_tables(spark):
    row = lambda role, text: '{"role":%s,"text":%s}' % tuple("null" if x is None else f'"{x}"' for x in (role, text))
    rows = [(1, 2, row("assistant", "b")), (1, 1, row("user", None)), (1, None, row(None, "first")), (1, 2, row("assistant", "b")), (None, 1, row("user", "lone")), (2, 1, "{}"), (3, 1, '{"prompt":"p","response":"r"}'), (3, 0, row("system", "s"))]
    df = records(spark, rows, "chat_id long, position long, j string").withColumns({"turns": F.lit(1), "t": F.lit("x"), "Layout": F.lit(2)}).repartition(3)
    got = {r.chat_id: ([tuple(t) for t in r.turns], r.learned) for r in chat.read_chats(chat.format_chats(df.drop("turns", "Layout"))).collect()}
    assert got == {1: ([("", "first"), ("user", ""), ("assistant", "b"), ("assistant", "b")], ["b", "b"]), None: ([("user", "lone")], []), 3: ([("system", "s"), ("user", "p"), ("assistant", "r")], ["r"])}
    assert chat.format_chats(df).count() == 3
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.op13_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
