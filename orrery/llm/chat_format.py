"""Chat formatting: link tool calls to their results, order, validate, serialise.

A message is plain text or JSON: an assistant message ``{"content", "tool_calls": [{"id",
"name", "arguments"}]}`` makes calls, a ``tool`` message ``{"tool_call_id", "content"}`` is a
result.  Calls and results are hash-joined by (conversation, id).  Order is a sort key per
row, not a rank, so a conversation of any length is never gathered: a message stands at its
turn, its calls follow it, and a result follows both its call and its own turn.

Schemas are flattened on the driver into rules by path (``.a.b``, ``.a[]``).  Arguments are
walked level by level in the row, as deep as the schemas go, and every value that has a rule
is checked against it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TOOLS = 5000
BLANKS = " \t\r\n"
CALLS = "content string, tool_calls array<struct<id:string,name:string,arguments:string>>"
RESULT = "tool_call_id string, content string"
#: JSON schema types and the variant types that satisfy them; whole numbers are integers too.
NUMBER = r"BIGINT|DOUBLE|FLOAT|DECIMAL.*"
TYPES = {"string": "STRING", "integer": "BIGINT", "number": NUMBER, "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
RULE = (
    "struct<types:string,whole:boolean,allowed:array<string>,minimum:double,maximum:double,min_length:int,max_length:int,"
    "pattern:string,min_items:int,max_items:int,required:array<string>,known:array<string>,closed:boolean>"
)
#: Keywords that are checked, and those that say nothing about a value; others are refused.
CHECKED = {
    "type", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "pattern", "minItems", "maxItems",
    "properties", "required", "additionalProperties", "items",
}
NOTES = {"title", "description", "default", "examples", "format", "$schema", "$id", "$comment", "deprecated"}


class Tools(NamedTuple):
    """``table`` is ``(tool, rules)``, ``depth`` the number of levels below the arguments that have rules."""

    table: DataFrame
    depth: int


def _step(name: str) -> str:
    return "." + name.replace("~", "~0").replace(".", "~1").replace("[", "~2")


def _canonical(value: Any) -> str:
    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def flatten_schema(schema: Mapping, path: str = "") -> Iterator[tuple[str, int, tuple]]:
    """``(path, level, rule)`` of a JSON schema and all schemas below it."""
    if refused := sorted(set(schema) - CHECKED - NOTES):
        raise ValueError(f"schema keywords that are not supported: {', '.join(refused)}")
    if not isinstance(schema.get("additionalProperties", True), bool) or not isinstance(schema.get("items", {}), Mapping):
        raise ValueError("additionalProperties must be true or false, items one schema")
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    allowed = [_canonical(v) for v in ([schema["const"]] if "const" in schema else schema.get("enum", []))]
    number = lambda k: None if schema.get(k) is None else float(schema[k])
    properties = schema.get("properties", {})
    yield path, path.count(".") + path.count("[]"), (
        f"^({'|'.join(TYPES[k] for k in kinds)})$" if kinds else None, "integer" in kinds, allowed if {"const", "enum"} & set(schema) else None,
        number("minimum"), number("maximum"), schema.get("minLength"), schema.get("maxLength"),
        schema.get("pattern"), schema.get("minItems"), schema.get("maxItems"),
        sorted(schema.get("required", [])), sorted(properties), schema.get("additionalProperties", True) is False,
    )
    for name, below in sorted(properties.items()):
        yield from flatten_schema(below, path + _step(name))
    if "items" in schema:
        yield from flatten_schema(schema["items"], path + "[]")


def tool_table(spark: SparkSession, tools: Mapping[str, Mapping]) -> Tools:
    """Rules of JSON schemas by tool name; at most ``MAX_TOOLS``, checked."""
    if len(tools) > MAX_TOOLS:
        raise ValueError(f"more than {MAX_TOOLS} tools")
    flat = {name: list(flatten_schema({"type": "object", **schema})) for name, schema in tools.items()}
    rows = [(name, {path: rule for path, _, rule in rules}) for name, rules in flat.items()]
    depth = max((level for rules in flat.values() for _, level, _ in rules), default=0)
    return Tools(spark.createDataFrame(rows, f"tool string, rules map<string,{RULE}>"), depth)


def _escaped(key: Column) -> Column:
    for old, new in (("~", "~0"), (".", "~1"), ("[", "~2")):
        key = F.replace(key, F.lit(old), F.lit(new))
    return F.concat(F.lit("."), key)


def _nodes(depth: int) -> Column:
    """All values below the variant ``args`` that have a rule in ``rules``, with their paths."""
    none = F.array().cast("array<struct<path:string,value:variant>>")

    def children(node: Column) -> Column:
        named = F.transform(
            F.map_entries(F.try_variant_get(node["value"], "$", "map<string,variant>")),
            lambda e: F.struct(F.concat(node["path"], _escaped(e["key"])).alias("path"), e["value"].alias("value")),
        )
        listed = F.transform(
            F.try_variant_get(node["value"], "$", "array<variant>"), lambda x: F.struct(F.concat(node["path"], F.lit("[]")).alias("path"), x.alias("value"))
        )
        return F.filter(F.coalesce(named, listed, none), lambda n: F.map_contains_key("rules", n["path"]))

    level = F.array(F.struct(F.lit("").alias("path"), F.col("args").alias("value")))
    every = [level]
    for _ in range(depth):
        level = F.flatten(F.transform(level, children))
        every.append(level)
    return F.concat(*every)


def _complaints(node: Column) -> Column:
    """What is wrong with one value, as an array of strings with nulls."""
    path, value, rule = node["path"], node["value"], F.element_at("rules", node["path"])
    named = F.when(path == "", "arguments").otherwise(F.substring(path, 2, 1 << 30))
    kind = F.schema_of_variant(value)
    number = F.when(F.regexp_like(kind, F.lit(f"^({NUMBER})$")), F.try_variant_get(value, "$", "double"))
    # Numbers are allowed by value, however they are written, as far as a double tells them apart.
    exact = F.when(F.abs(number) < float(1 << 53), True)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    items = F.size(F.try_variant_get(value, "$", "array<variant>"))
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    wrong = lambda test, what: F.when(test, F.concat(F.lit(f"{what} of "), named))
    below = lambda what: lambda k: F.concat(F.lit(f"{what} "), F.when(path == "", k).otherwise(F.concat(named, F.lit("."), k)))
    none = F.array().cast("array<string>")
    single = F.array(
        wrong(~(F.regexp_like(kind, rule["types"]) | (rule["whole"] & F.coalesce(number == F.floor(number), F.lit(False)))), "type"),
        wrong(~F.exists(rule["allowed"], lambda a: F.coalesce((a.try_cast("double") == number) & exact, a == F.to_json(value))), "enum"),
        wrong(number < rule["minimum"], "minimum"),
        wrong(number > rule["maximum"], "maximum"),
        wrong((F.length(text) < rule["min_length"]) | (F.length(text) > rule["max_length"]), "length"),
        wrong(~F.regexp_like(text, rule["pattern"]), "pattern"),
        wrong((items < rule["min_items"]) | (items > rule["max_items"]), "items"),
    )
    missing = F.coalesce(F.transform(F.array_except(rule["required"], keys), below("missing")), none)
    unknown = F.when(rule["closed"], F.transform(F.array_except(keys, rule["known"]), below("unknown")))
    return F.concat(single, missing, F.coalesce(unknown, none))


def _errors(nodes: str) -> Column:
    """Complaints about the arguments, sorted and distinct."""
    found = F.array_distinct(F.array_compact(F.flatten(F.transform(nodes, _complaints))))
    return (
        F.when(F.col("rules").isNull(), F.array(F.lit("unknown tool")))
        .when(F.col("args").isNull() | ~F.startswith(F.schema_of_variant("args"), F.lit("OBJECT")), F.array(F.lit("arguments are no JSON object")))
        .otherwise(F.array_sort(found))
    )


def format_chat(messages: DataFrame, tools: Tools, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message, call and result, as canonical JSON with its place.

    Columns: ``conv_id, kind (message, call, result), turn, item, call_id, at_turn, step,
    status, errors, json``.  Sorting a conversation by ``at_turn, step, turn, item`` is a
    topological order.  ``status`` is ``ok``; for calls ``unanswered`` or ``duplicate`` (a
    later call of the same id), for results ``orphan`` or ``duplicate`` (of a later turn than
    the first answer of the same id).  ``errors`` lists schema complaints, comma-joined.
    Keys are sorted, white space is dropped; a null id or name of a call is ``null``.

    Text that is no such JSON is content.  A null text is null content (left out of the
    JSON); null conversations, turns and roles stay null and link with nothing.  Repeated
    rows repeat: equal calls and equal answers have equal status.  ``tools`` comes from
    ``tool_table``.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    looks = F.startswith(F.ltrim("text", F.lit(BLANKS)), F.lit("{"))
    rows = rows.withColumn("made", F.when((F.col("role") == "assistant") & looks, F.from_json("text", CALLS)))
    rows = rows.withColumn("got", F.when((F.col("role") == "tool") & looks, F.from_json("text", RESULT)))
    has_calls, is_result = F.col("made.tool_calls").isNotNull(), F.col("got.tool_call_id").isNotNull()

    body = F.when(has_calls, F.col("made.content")).otherwise(F.col("text"))
    plain = rows.where(~is_result).select(
        "conv_id", F.lit("message").alias("kind"), "turn", F.lit(-1).alias("item"), F.lit(None).cast("string").alias("call_id"),
        F.col("turn").alias("at_turn"), F.lit(0).alias("step"), F.lit("ok").alias("status"), F.lit("").alias("errors"),
        F.to_json(F.struct(body.alias("content"), "role")).alias("json"),
    )

    calls = rows.where(has_calls).select("conv_id", "turn", F.posexplode("made.tool_calls").alias("item", "call"))
    calls = calls.select("conv_id", "turn", "item", F.col("call.id").alias("call_id"), F.col("call.name").alias("tool"), F.col("call.arguments").alias("raw"))
    results = rows.where(is_result).select("conv_id", "turn", F.col("got.tool_call_id").alias("call_id"), F.col("got.content").alias("content"))

    # Keys of the small sides are computed anew, so that a hot id is split as a skewed join.
    anew = F.concat("call_id", F.lit("")).alias("call_id")
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "item")).alias("first")).select("conv_id", anew, "first")
    answers = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("answered_at"), F.lit(True).alias("answered")).select("conv_id", anew, "answered_at", "answered")
    valid = F.try_parse_json("raw")
    checked = (
        calls.join(first, ["conv_id", "call_id"], "left")
        .join(answers, ["conv_id", "call_id"], "left")
        .join(F.broadcast(tools.table), "tool", "left")
        .withColumn("args", valid)
        .withColumn("nodes", _nodes(tools.depth))
        .withColumn("errors", F.array_join(_errors("nodes"), ","))
    )
    own = F.struct("turn", "item")
    status = F.when(F.col("first").isNotNull() & (own != F.col("first")), "duplicate").when(F.col("answered").isNull(), "unanswered").otherwise("ok")
    shown = F.coalesce(F.to_json("args"), F.to_json(F.struct(F.col("raw").alias("raw"))))
    quoted = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))
    call_json = F.concat(F.lit('{"arguments":'), F.coalesce(shown, F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("tool")), F.lit("}"))
    call_rows = checked.select(
        "conv_id", F.lit("call").alias("kind"), "turn", "item", "call_id", F.col("turn").alias("at_turn"), F.lit(1).alias("step"),
        status.alias("status"), "errors", call_json.alias("json"),
    )

    placed = results.join(first, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left")
    later = F.col("turn") > F.col("answered_at")
    result_rows = placed.select(
        "conv_id", F.lit("result").alias("kind"), "turn", F.lit(-1).alias("item"), "call_id",
        F.greatest("turn", "first.turn").alias("at_turn"), F.lit(2).alias("step"),
        F.when(F.col("first").isNull(), "orphan").when(later, "duplicate").otherwise("ok").alias("status"), F.lit("").alias("errors"),
        F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"))).alias("json"),
    )
    return plain.unionByName(call_rows).unionByName(result_rows)


def read_tools(text: str) -> dict[str, dict]:
    """Tool schemas from a JSON document ``{name: schema}``."""
    return json.loads(text)
