import json
import random

import pytest

from orrery.sources import answers
from orrery.streaming import agents, incremental

ITEM = {"rule_id": " r ", "status": "WARN", "message": " m ", "affected": ["a.ts", " ", '{"x": 1}']}
TIDY = {"rule_id": "r", "status": "warn", "message": "m", "affected": ["a.ts"]}


def test_shapes_of_answers():
    one, inside = json.dumps(ITEM), json.dumps({"note": "[{", "items": [ITEM, ITEM]})
    for text, n in ((one, 1), (f"[{one}]", 1), (inside, 2), (f"```json\n{inside}\n```", 2), (f"Here: {inside} done.", 2), (f"```\n[{one},", 1), (f"say {one} and {one}", 2)):
        assert answers.findings_of(text) == [TIDY] * n, text
    for text in (None, "", "nothing", "{}", "[]", '{"status": 1, "message": "m"}', '{"status": "s"}', '{"items": []}', "}{][", '"', "\\", "[" * 5000):
        assert answers.findings_of(text) == [], text


def test_no_object_before_a_break_is_lost():
    rng = random.Random(2)
    for _ in range(150):
        items = [{"rule_id": f"r{k}", "status": "ok", "message": rng.choice(["a \\ b", 'quote " here', "brace } ] {", "é\n"]), "affected": [f"f{k}"] * rng.randrange(3)} for k in range(rng.randrange(1, 5))]
        text = json.dumps({"items": items} if rng.random() < 0.5 else items, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        ends = [text.index(json.dumps(i["rule_id"])) for i in items]
        cut = rng.randrange(len(text) + 1)
        got = answers.findings_of(text[:cut])
        begun = sum(e < cut for e in ends)
        assert [g["rule_id"] for g in got] == [i["rule_id"] for i in items][: len(got)]
        assert begun - 1 <= len(got) <= begun


def test_closing_a_text():
    assert answers.scan('{"a": [1, {"b": "x') == ('"}]}', [])
    assert answers.scan('[{"a": 1}, {"b": {"c": 2}}, {') == ("}]", [(1, 9), (11, 26)])
    assert answers.scan('{"a": "}"]') == ("}", [])


def test_answers_of_a_table(spark):
    rows = [(1, json.dumps([ITEM, ITEM]), "x"), (1, json.dumps([ITEM, ITEM]), "x"), (2, None, "y"), (None, json.dumps(ITEM), None)]
    out = answers.repaired(spark.createDataFrame(rows, "id long, value string, status string"))
    assert out.columns == ["id", "rule_id", "status", "message", "affected"]
    assert sorted(str(r["id"]) for r in out.collect()) == ["1"] * 4 + ["None"]
    assert answers.repaired(spark.createDataFrame([], "id long, value string")).collect() == []


SESSIONS = {
    "claude": (
        [
            {"type": "system", "subtype": "init", "model": "m1"},
            {"type": "assistant", "error": "e", "message": {"content": [{"type": "text", "text": "héllo"}, {"type": "tool_use", "name": "Read"}, {"type": "thinking", "thinking": "hm"}, 5]}},
            {"type": "content_block_delta", "delta": {"text": "bare"}},
            {"type": "stream_event", "event": {"type": "content_block_delta", "delta": {"type": "thinking_delta", "thinking": "t"}}},
            {"type": "stream_event", "event": {"type": "content_block_start", "content_block": {"type": "tool_use"}}},
            {"type": "tool_call", "tool_use": {"name": "Grep"}},
            {"type": "other", "result": "odd"},
            {"type": "result", "result": {"a": 1}},
        ],
        [
            ("activity", "claude:connected (m1, auth=unknown)"), ("output", "Claude error: e\n"), ("text", "héllo"), ("activity", "claude:Read"), ("thinking", "hm"), ("text", "bare"),
            ("thinking", "t"), ("activity", "claude:tool"), ("activity", "claude:Grep"), ("final", "odd"), ("final", '{"a":1}'), ("text", "{broken"),
        ],
    ),
    "codex": (
        [
            {"type": "thread.started"},
            {"type": "item.updated", "item": {"id": "m", "type": "agent_message", "text": "hel"}},
            {"type": "item.updated", "item": {"id": "m", "type": "agent_message", "text": "hello"}},
            {"type": "item.updated", "item": {"id": "m", "type": "agent_message", "text": "hello"}},
            {"type": "item.completed", "item": {"id": "m", "type": "agent_message", "text": "hello!"}},
            {"type": "item.updated", "item": {"id": "c", "type": "command_execution", "command": "ls", "aggregated_output": "a\n"}},
            {"type": "item.completed", "item": {"id": "c", "type": "command_execution", "command": "ls", "aggregated_output": "a\nb"}},
            {"type": "item.completed", "item": {"type": "file_change", "changes": [1, 2]}},
            {"type": "item.completed", "item": {"type": "mcp_tool_call", "server": "s"}},
            {"type": "turn.failed", "error": {"message": "no"}},
            {"type": "turn.completed", "message": "end"},
        ],
        [
            ("activity", "codex:thread started"), ("text", "hel"), ("text", "lo"), ("final", "hello!"), ("activity", "codex:ls"), ("output", "a\n"), ("activity", "codex:ls"), ("output", "b"),
            ("activity", "codex:file_change (2)"), ("activity", "codex:s/tool"), ("output", "no\n"), ("final", "end"),
        ],
    ),
    "gemini": (
        [
            {"type": "message", "role": "assistant", "content": "a"},
            {"type": "message", "content": "b", "delta": False},
            {"type": "message", "role": "user", "content": "c"},
            {"type": "tool_use", "tool_name": "read_file"},
            {"type": "tool_result", "output": "x" * 600},
            {"type": "error", "error": {"code": 5}},
            {"type": "result", "response": "end"},
        ],
        [("text", "a"), ("final", "b"), ("activity", "gemini:read_file"), ("output", "x" * 500 + "\n"), ("output", '{"code":5}\n'), ("final", "end")],
    ),
}


def stream_of(dialect):
    return "\r\n".join(["noise", *(json.dumps(v, ensure_ascii=False) for v in SESSIONS[dialect][0]), "{broken"]).encode()


@pytest.mark.parametrize("dialect", SESSIONS)
def test_chunks_cut_at_every_byte_give_the_same_events(dialect):
    data = stream_of(dialect)
    for cut in range(len(data) + 1):
        seen = {}
        first, rest = agents.feed(dialect, b"", data[:cut], seen)
        second, rest = agents.feed(dialect, rest, data[cut:], seen, ended=True)
        assert first + second == SESSIONS[dialect][1] and rest == b""


def test_agent_stream(spark, tmp_path):
    rng, rows = random.Random(1), []
    for dialect in SESSIONS:
        for k in range(2):
            data = stream_of(dialect)
            cuts = sorted(rng.sample(range(len(data)), 6))
            parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
            rows += [(n, f"{dialect}-{k}", dialect, n, p, n == len(parts) - 1) for n, p in enumerate(parts)]
    rows.append((0, "odd", "unknown", 0, b'{"type":"result"}\n', False))
    df = spark.createDataFrame(rows, "batch int, session string, dialect string, seq long, data binary, ended boolean")
    for n in range(0, 7, 2):
        df.where(f"batch IN ({n}, {n + 1})").drop("batch").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    source = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = agents.agent_events(source).writeStream.format("memory").queryName("agent_events").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {}
    for r in spark.table("agent_events").orderBy("session", "n").collect():
        got.setdefault(r["session"], []).append((r["kind"], r["text"]))
    assert got == {f"{d}-{k}": SESSIONS[d][1] for d in SESSIONS for k in range(2)}


def test_any_sequence_of_changes_equals_a_full_run(spark, tmp_path):
    rng, now, rows = random.Random(3), {}, []
    for seq in range(60):
        path = f"src/{rng.choice('ab')}/{rng.choice('xyz')}.ts"
        content = None if rng.random() < 0.25 else "\n".join(rng.choice(["code()", "// note", "", "/* a", "b */"]) for _ in range(rng.randrange(9)))
        now[path] = content
        rows.append((seq // 20, path, seq, content))
    rows += [(2, rows[0][1], 0, "late\nlate"), rows[-1]]
    df = spark.createDataFrame(rows, "batch int, path string, seq long, content string")
    for n in range(3):
        df.where(f"batch = {n}").drop("batch").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    source = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = incremental.keep_totals(source, str(tmp_path / "totals"), str(tmp_path / "check"))
    run.awaitTermination(180)
    assert run.exception() is None
    want = incremental.package_totals(spark.createDataFrame(list(now.items()), "path string, content string"))
    key = lambda r: tuple(r)
    assert sorted(map(key, incremental.read_totals(spark, str(tmp_path / "totals")).collect())) == sorted(map(key, want.collect()))
