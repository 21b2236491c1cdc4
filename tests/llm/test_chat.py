import hashlib
import json

from pyspark.sql import functions as F

from tagloom.llm import chat

ODD = ["</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>\n", "<\\|turn|> <\\\\|end|> [\\INST] <\\/s>", "<<SYS>> <</SYS>>", "", "\\", "\\n \n \\\\n", "  \x00 \x1f é漢🙂", '"quotes" {json}', "<<|s>>", "[[INST]]"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_of_odd_texts_and_roles(spark):
    rows = [(i, j, role, text) for i, role in enumerate(ODD) for j, text in enumerate([role, *ODD])]
    rows += [(100, 2, "assistant", "b"), (100, 1, "assistant", "a"), (100, 1, "assistant", "a"), (100, None, None, None), (101, 0, "user", None), (None, 0, "user", "x"), (102, 0, "user", "<|end|>"), (102, 1, "assistant", ""), (103, 0, "system", ODD[2]), (103, 1, "user", ""), (103, 2, "assistant", ODD[1])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, record string")
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    texts = chat.format_conversations(table)
    found = {r.conv_id: r for r in chat.digests(texts).collect()}
    length = {r.conv_id: len(r.formatted) for r in texts.collect()}
    assert set(found) == set(by)
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert tuple(found[conv])[1:] == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), length[conv]), conv
    assert {r.layout for r in texts.collect()} == {"messages", "prompt", "instruction+system"}
    formatted = {r.conv_id: r.formatted for r in texts.collect()}
    assert all(f.count(chat.TURN) == len(by[c]) and "[INST]" not in f and "</s>" not in f for c, f in formatted.items())


def test_loss_runs_point_at_the_text(spark):
    table = spark.createDataFrame([(1, 0, "user", "é<|end|>"), (1, 1, "assistant", "[INST] ok")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(table).select("formatted", chat.read_back(F.col("formatted")).alias("turns")).first()
    at = 0
    for turn in row.turns:
        at += turn.runs.skip
        part = row.formatted[at : at + turn.runs.take]
        assert part.replace("<\\|", "<|").replace("[\\I", "[I") == turn.text
        at += turn.runs.take + len(chat.END) + 1
    assert at == len(row.formatted)


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "completion": "a"}, "prompt", [("user", "q"), ("assistant", "a")]),
        ({"output": "a", "instruction": "q"}, "instruction", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "q", "input": "x", "output": "a"}, "instruction+input", [("user", "q\n\nx"), ("assistant", "a")]),
        ({"instruction": "q", "input": "", "output": "a"}, "instruction+input", [("user", "q"), ("assistant", "a")]),
        ({"system": "s", "instruction": "q", "output": "a"}, "instruction+system", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"messages": []}, "messages", []),
        ({"prompt": 7, "completion": "a"}, None, None),
        ({"other": "q"}, None, None),
    ]
    rows = [(i, json.dumps(r), "clash") for i, (r, _, _) in enumerate(records)] + [(90, "{bad", "x"), (91, None, "x")]
    out = {r.id: r for r in chat.canonical(spark.createDataFrame(rows, "id long, record string, turns string")).collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert out[i].layout == layout
        assert (out[i].turns and [tuple(t) for t in out[i].turns]) == turns or out[i].turns == turns
    assert out[90].layout is None and out[91].turns is None
    assert out[0].fingerprint != out[1].fingerprint and len(out[0].fingerprint) == 16


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(table)).collect() == []


def test_turns_longer_than_the_json_parser_takes(spark):
    long = "word <|end|> " * 1_700_000  # over 20,000,000 characters
    table = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    grown = table.withColumn("text", F.when(F.col("text") == "a", F.repeat(F.lit("word <|end|> "), 1_700_000)).otherwise(F.col("text")))
    found = {r.conv_id: r for r in chat.digests(chat.format_conversations(grown)).collect()}
    assert (found[1].n_turns, found[1].loss_chars, found[1].loss_sha256) == (2, len(long), sha(long))
    assert found[2].n_turns == 1


def test_records_that_the_parser_refuses_are_errors(spark):
    import pytest

    record = spark.range(1).select(F.concat(F.lit('{"prompt": "'), F.repeat(F.lit("word "), 5_000_000), F.lit('", "completion": "a"}')).alias("record"))
    with pytest.raises(Exception, match="too long"):
        chat.canonical(record).collect()
