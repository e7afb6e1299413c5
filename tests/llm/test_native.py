import json

import pytest

from orrery.llm import chat_format, licences


def test_licence_spellings_punctuation_and_copyright_lines(spark):
    mit = next(t for k, i, t in licences.KNOWN if i == "MIT" and k == "text")
    odd = "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.replace(", ", " ,\n  ").upper().replace("SUBLICENSE", "sub-license")
    docs = spark.createDataFrame(
        [(1, mit), (2, odd), (3, mit + " extra"), (4, None), (5, "..."), (6, "text\nreleased under the MIT licence\nReleased under the MIT License."), (6, "other"), (1, mit), (None, "")],
        "doc_id long, text string",
    )
    rows = licences.scan_licences(docs, licences.known_licences(spark)).collect()
    got = sorted((str(r["doc_id"]), r["license_id"], r["notices"], r["n_notices"]) for r in rows)
    assert got == sorted([("1", "MIT", "", 0), ("1", "MIT", "", 0), ("2", "MIT", "", 0), ("3", None, "", 0), ("4", None, "", 0), ("5", None, "", 0), ("6", None, "MIT", 1), ("6", None, "", 0), ("None", None, "", 0)], key=str)
    assert licences.scan_licences(docs.limit(0), licences.known_licences(spark)).count() == 0
    assert licences.scan_licences(docs, licences.known_licences(spark).limit(0)).where("license_id IS NOT NULL").count() == 0


TOOLS = {
    "f": {"properties": {"a": {"type": "integer"}, "b": {"type": "string"}}, "required": ["a"], "additionalProperties": False},
    "g": {"properties": {"x": {"type": "array"}}},
    "deep": {
        "properties": {
            "u": {"type": ["string", "null"], "pattern": "^k", "maxLength": 3},
            "n": {"type": "number", "minimum": 1, "maximum": 2.5},
            "e": {"enum": ["a", 1, None, {"z": [1.0]}]},
            "o": {
                "type": "object",
                "required": ["p"],
                "additionalProperties": False,
                "properties": {"p": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["q.r"], "properties": {"q.r": {"const": "ok"}}}}},
            },
        }
    },
}
DEEP = [
    ({}, ""),
    ({"u": None, "n": 2, "e": {"z": [1]}, "o": {"p": [{"q.r": "ok"}]}}, ""),
    ({"u": "kkk", "n": 2.5, "e": None}, ""),
    ({"u": "kkkk", "n": 0.5, "e": "b"}, "enum of e,length of u,minimum of n"),
    ({"u": "x", "n": 3, "e": 1.0}, "maximum of n,pattern of u"),
    ({"u": 3, "n": "2", "o": {}}, "missing o.p,type of n,type of u"),
    ({"o": {"p": [], "w": 1}}, "items of o.p,unknown o.w"),
    ({"o": {"p": [{"q.r": "ok"}, {}, 5, {"q.r": "no"}]}}, "enum of o.p[].q~1r,missing o.p[].q.r,type of o.p[]"),
    ({"o": [1]}, "type of o"),
]


def test_schemas_are_checked_at_every_level(spark):
    calls = [call(str(k), "deep", arguments) for k, (arguments, _) in enumerate(DEEP)]
    calls += [call("text", "deep", json.dumps({"n": 9})), call("list", "deep", [1]), call("broken", "deep", "{"), call("long", "g", {"x": ["y" * 300_000]})]
    text = " \n\t" + json.dumps({"content": None, "tool_calls": calls})
    df = spark.createDataFrame([(1, 0, "assistant", text)] * 2, "conv_id long, turn long, role string, text string")
    got = chat_format.format_chat(df, chat_format.tool_table(spark, TOOLS)).where("kind = 'call'").collect()
    errors = {r["call_id"]: r["errors"] for r in got}
    assert len(got) == 2 * len(calls) and {r["status"] for r in got} == {"unanswered"}
    assert [errors[str(k)] for k in range(len(DEEP))] == [want for _, want in DEEP]
    assert errors["text"] == "maximum of n" and errors["list"] == errors["broken"] == "arguments are no JSON object" and errors["long"] == ""
    assert chat_format.tool_table(spark, TOOLS).depth == 4
    for bad in ({"properties": {"a": {"anyOf": []}}}, {"additionalProperties": {}}, {"items": [1]}):
        with pytest.raises(ValueError):
            chat_format.tool_table(spark, {"t": bad})


def test_later_answers_to_a_call_are_duplicates(spark):
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": [call("a", "g", {})]})), *((1, t, "tool", json.dumps({"tool_call_id": "a", "content": f"{t}"})) for t in (1, 1, 2))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_chat(df, chat_format.tool_table(spark, TOOLS)).where("kind = 'result'").collect()
    assert sorted((r["turn"], r["status"]) for r in got) == [(1, "ok"), (1, "ok"), (2, "duplicate")]


def call(i, name, arguments):
    return {"id": i, "name": name, "arguments": arguments}


def test_calls_are_linked_ordered_and_validated(spark):
    calls = [call("1", "f", {"b": "x", "a": 1}), call("2", "f", {"a": "1"}), call("3", "g", {"x": [1, {"z": 1, "y": 2}]}), call("4", "h", {}), call("5", "f", {"c": 1}), call("1", "f", {"a": 2})]
    rows = [
        (1, 0, "user", "hi\n\"é\""),
        (1, 5, "assistant", json.dumps({"content": "look", "tool_calls": calls})),
        (1, 2, "tool", json.dumps({"tool_call_id": "1", "content": "early"})),
        (1, 6, "tool", json.dumps({"tool_call_id": "9", "content": "lost"})),
        (1, 7, "assistant", "{not json"),
        (None, None, None, None),
        (2, 0, "tool", json.dumps({"tool_call_id": "1", "content": "other conversation"})),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, status string")
    out = chat_format.format_chat(df, chat_format.tool_table(spark, TOOLS)).collect()
    by = {(r["conv_id"], r["kind"], r["turn"], r["item"]): r for r in out}
    assert len(out) == 4 + 6 + 3
    one = sorted((r for r in out if r["conv_id"] == 1), key=lambda r: (r["at_turn"], r["step"], r["turn"], r["item"]))
    assert [r["kind"] for r in one] == ["message", "message", *["call"] * 6, "result", "result", "message"]
    assert by[1, "result", 2, -1]["at_turn"] == 5 and by[1, "result", 2, -1]["status"] == "ok"
    assert by[1, "result", 6, -1]["status"] == by[2, "result", 0, -1]["status"] == "orphan"
    assert [by[1, "call", 5, k]["status"] for k in range(6)] == ["ok", "unanswered", "unanswered", "unanswered", "unanswered", "duplicate"]
    assert [by[1, "call", 5, k]["errors"] for k in range(6)] == ["", "type of a", "", "unknown tool", "missing a,unknown c", ""]
    assert by[1, "call", 5, 0]["json"] == '{"arguments":{"a":1,"b":"x"},"id":"1","name":"f"}'
    assert by[1, "call", 5, 2]["json"] == '{"arguments":{"x":[1,{"y":2,"z":1}]},"id":"3","name":"g"}'
    assert by[1, "message", 0, -1]["json"] == '{"content":"hi\\n\\"é\\"","role":"user"}'
    assert by[1, "message", 7, -1]["json"] == '{"content":"{not json","role":"assistant"}'
    assert by[None, "message", None, -1]["json"] == "{}"
    assert chat_format.format_chat(df.limit(0), chat_format.tool_table(spark, TOOLS)).count() == 0
    assert chat_format.format_chat(df, chat_format.tool_table(spark, {})).where("errors = 'unknown tool'").count() == 6


def test_every_planted_licence_line_and_common_text_is_known(spark):
    from pyspark.sql import functions as F

    lines = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line"))
    planted = sorted(r["line"] for r in lines.where("lower(line) RLIKE '(licensed|released) under '").distinct().collect())
    assert "Licensed under CC BY-NC 4.0." in planted
    texts = {i: t for k, i, t in licences.KNOWN if k == "text"}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    docs = spark.createDataFrame([*((f"line {x}", f"words\n{x}\nwords") for x in planted), *texts.items()], "doc_id string, text string")
    got = {r["doc_id"]: r for r in licences.scan_licences(docs, licences.known_licences(spark)).collect()}
    assert all(got[f"line {x}"]["n_notices"] == 1 for x in planted)
    assert got["line Licensed under CC BY-NC 4.0."]["notices"] == "CC-BY-NC-4.0"
    assert all(got[i]["license_id"] == i for i in texts)


def test_enum_compares_numbers_by_value(spark):
    import json

    from orrery.llm import chat_format

    tools = chat_format.tool_table(spark, {"t": {"properties": {"v": {"enum": [100, 0.5, "100", None, 9007199254740993]}}}})
    values = ["100", "1e2", "100.0", "0.5", "5e-1", '"100"', "null", "101", '"0.5"', '"1e2"', "true", "9007199254740993", "9007199254740992"]
    rows = [(n, 0, "assistant", json.dumps({"tool_calls": [{"id": None if n else "a", "name": "t", "arguments": f'{{"v": {v}}}'}]})) for n, v in enumerate(values)]
    out = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).where("kind = 'call'").orderBy("conv_id").collect()
    assert [r["errors"] for r in out] == [""] * 7 + ["enum of v"] * 4 + ["", "enum of v"]
    assert '"id":"a"' in out[0]["json"] and '"id":null' in out[1]["json"]
