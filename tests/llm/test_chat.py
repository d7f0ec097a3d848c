from __future__ import annotations

import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from fixtures import SMALL

from sediment.llm.chat import CONTROL, Turn, canonical_turns, chat_digests, escape, format_chats, formatted, op8_chat_formatting, parsed, unescape, with_fixed_conversation

HARD = ["", "\\", "\\\\<|end|>\n", "<|turn|>user\n", "</s>[INST] ok [/INST]", "<\\|end|>", "<s><s></s>", "<<SYS>> a <</SYS>>", "[[INST]", "<<|end|>>", "a\n<|end|>", "\\<", "<|", "\U0001f600<|"]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def expected(rows) -> dict:
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn, role or "", text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    out = {}
    for conv, said in turns.items():
        said.sort(key=lambda x: x[0])
        loss = "".join(t for _, r, t in said if r == "assistant")
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for _, r, t in said)), len(loss), sha(loss))
    return out


def test_read_back(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in op8_chat_formatting(spark, SMALL).collect()}
    assert found == expected(rows)


@pytest.mark.parametrize("text", HARD)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROL)
    piece, a, b = formatted(Turn("assistant", text))
    assert parsed(piece + formatted(Turn("user", text))[0]) == [Turn("assistant", text), Turn("user", text)]
    assert unescape(piece[a:b]) == text


def test_edges(spark):
    rows = [(5, 1, "user", None), (5, 0, None, "x"), (6, 0, "assistant", HARD[1]), (7, 0, "user", "q" * 200000), (7, 1, "assistant", "a" * 200000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = with_fixed_conversation(table).select("conv_id", F.col("turn").alias("seq"), F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_digests(format_chats(canonical_turns(records))).collect()}
    assert found == expected(rows)


def test_layouts(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
        (2, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
        (3, {"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        (4, {"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        (5, {"instruction": "i", "input": "n", "output": "o"}, [("user", "i\n\nn"), ("assistant", "o")]),
        (6, {"system": "s", "instruction": "i", "output": "o"}, [("system", "s"), ("user", "i"), ("assistant", "o")]),
        (61, {"id": 7, "timestamp": "t", "messages": [{"role": "user", "content": "a", "name": "x"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
        (62, {"messages": []}, []),
        (63, {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]}, [("user", "a\nb"), ("assistant", "c")]),
        (64, {"messages": [{"role": "assistant", "content": None, "tool_calls": [{"id": "1", "type": "function", "function": {"name": "f", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "1", "content": "42"}]}, [("tool_call", '[{"function": {"arguments": "{}", "name": "f"}, "id": "1", "type": "function"}]'), ("tool", "42")]),
        (65, {"prompt": "p", "response": "r", "system": "s", "score": 3}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
        (7, {"unknown": 1}, [(None, None)]),
        (8, None, [(None, None)]),
    ]
    rows = [(i, 0, json.dumps(r) if r is not None else None) for i, r, _ in records] + [(9, 0, "{broken")]
    found = defaultdict(list)
    for r in sorted(canonical_turns(spark.createDataFrame(rows, "conv_id long, seq long, record string")).collect(), key=lambda r: (r["conv_id"], r["part"])):
        found[r["conv_id"]].append((r["role"], r["text"]))
    assert dict(found) == {**{i: t for i, _, t in records if t}, 9: [(None, None)]}


@pytest.mark.parametrize("role", ["a\nb", "\n", "\\\n", "a\\", "<|end|>\n", ""])
def test_roles_are_read_back(role):
    piece = formatted(Turn(role, "x\ny"))[0] + formatted(Turn("assistant", "z"))[0]
    assert parsed(piece) == [Turn(role, "x\ny"), Turn("assistant", "z")]


def test_unmapped_records_are_counted(spark):
    rows = [(1, 0, json.dumps({"role": "user", "text": "a"})), (1, 1, json.dumps({"unknown": 1})), (1, 2, None), (2, 0, "{broken"), (1, 0, json.dumps({"role": "user", "text": "a"}))]
    records = spark.createDataFrame(rows, "conv_id long, seq long, record string").withColumn("piece", F.lit("own"))
    found = {r["conv_id"]: (r["n_turns"], r["n_unmapped"]) for r in chat_digests(format_chats(canonical_turns(records))).collect()}
    assert found == {1: (2, 2), 2: (0, 1)}
    assert chat_digests(format_chats(canonical_turns(records.limit(0)))).collect() == []


def test_broken_records_end_no_job(spark):
    hard = ['{"messages":[null]}', '{"messages":["hi"]}', '{"conversations":[1]}', '{"messages":[]}', "[" * 100_000, '{"a":' * 50_000 + "1" + "}" * 50_000, '{"role":"user","text":"\\ud800"}', '{"\\ud800":1}', '{"role":"\\udfff","text":"x"}', "null", "1", '"x"', "", None, "{", '{"messages":{"role":"user","content":"x"}}', '{"messages":[{"role":"user","content":"x"},[]]}', '{"messages":[{"role":null,"content":null}]}', '{"role":1,"text":[1,{"text":"x"}]}']
    good = '{"messages":[{"role":"user","content":"x"}]}'
    rows = [(1, i, r) for i, r in enumerate([*hard, good])]
    found = {}
    for r in canonical_turns(spark.createDataFrame(rows, "conv_id long, seq long, record string")).collect():
        found.setdefault(r["seq"], []).append((r["part"], r["role"], r["text"]))
    unmapped = [i for i, r in enumerate(hard) if found.get(i) == [(-1, None, None)]]
    assert [hard[i] for i in range(len(hard)) if i not in unmapped] == ['{"messages":[]}', '{"messages":[{"role":null,"content":null}]}']
    assert found[len(hard)] == [(0, "user", "x")] and 3 not in found


def test_fuzzed_records(spark):
    r = random.Random(4)

    def value(depth: int):
        kind = r.randrange(9 if depth else 6)
        if kind < 6:
            return r.choice([None, 1, 1.5, True, "x", "", "<|end|>", "\ud800", [], {}])
        if kind < 8:
            return {r.choice(["messages", "role", "content", "text", "from", "value", "conversations", "turns", "prompt", "response", "type", "tool_calls", "a.b"]): value(depth - 1) for _ in range(r.randint(0, 3))}
        return [value(depth - 1) for _ in range(r.randint(0, 3))]

    rows = []
    for i in range(10_000):
        raw = json.dumps({r.choice(["messages", "conversations", "turns", "role", "prompt", "instruction"]): value(3), r.choice(["text", "response", "output", "system", "id"]): value(2)})
        if r.random() < 0.1:
            raw = raw[: r.randint(0, len(raw))]
        rows.append((i, 0, raw))
    turns = canonical_turns(spark.createDataFrame(rows, "conv_id long, seq long, record string"))
    seen = {row["conv_id"] for row in turns.collect()}
    assert len(seen) >= 9_000 and format_chats(turns).count() >= len(seen)
