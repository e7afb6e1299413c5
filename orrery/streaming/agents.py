"""Event streams of command-line agents: chunks of output joined to lines, lines typed as events.

Three dialects write a JSON object a line.  A session's state is the unfinished line and the
texts that its items have shown so far, so that repeated snapshots give only what is new.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.session import ship_package

EVENT = "session string, n long, kind string, text string"
#: Characters of a tool's result that are shown.
SHOWN = 500
Event = tuple[str, str]


def at(value: Any, *path: str) -> Any:
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def text_at(value: Any, *paths: str) -> str | None:
    """The first of the dotted paths that is there, if it is a text."""
    found = next((x for x in (at(value, *p.split(".")) for p in paths) if x is not None), None)
    return found if isinstance(found, str) else None


def final(value: Any, *keys: str) -> list[Event]:
    """A final answer under the first key that is there; what is no text is shown as JSON."""
    for key in keys:
        if isinstance(value.get(key), str):
            return [("final", value[key])]
    return next(([("final", json.dumps(value[k], separators=(",", ":"), ensure_ascii=False))] for k in keys if k in value), [])


def delta(part: Any, bare: bool) -> list[Event]:
    """The text or thought of a block's delta; ``bare`` takes one without a type for text."""
    kind = text_at(part, "type") or ""
    if kind == "text_delta" or (bare and not kind):
        return [("text", t)] if (t := text_at(part, "text")) is not None else []
    return [("thinking", t)] if kind == "thinking_delta" and (t := text_at(part, "thinking")) is not None else []


def claude(value: dict, seen: dict[str, str]) -> list[Event]:
    kind = text_at(value, "type") or ""
    if kind == "system":
        model, auth = text_at(value, "model") or "unknown", text_at(value, "apiKeySource") or "unknown"
        return [("activity", f"claude:connected ({model}, auth={auth})")] if value.get("subtype") == "init" else []
    if kind == "assistant":
        out = [("output", f"Claude error: {e}\n")] if (e := text_at(value, "error")) is not None else []
        blocks = at(value, "message", "content")
        for block in blocks if isinstance(blocks, list) else []:
            shape = text_at(block, "type")
            if shape == "tool_use":
                out.append(("activity", f"claude:{text_at(block, 'name') or 'tool'}"))
            elif shape in ("text", "thinking") and (t := text_at(block, shape)) is not None:
                out.append((shape, t))
        return out
    if kind == "content_block_delta":
        return delta(value.get("delta"), True)
    if kind == "stream_event":
        inner = value.get("event")
        if text_at(inner, "type") == "content_block_delta":
            return delta(at(inner, "delta"), False)
        started = text_at(inner, "type") == "content_block_start" and text_at(inner, "content_block.type") == "tool_use"
        return [("activity", f"claude:{text_at(inner, 'content_block.name') or 'tool'}")] if started else []
    if kind in ("tool_use", "tool_call"):
        return [("activity", f"claude:{text_at(value, 'name', 'tool_use.name') or 'tool'}")]
    return final(value, "result") if kind == "result" or isinstance(value.get("result"), str) else []


def fresh(seen: dict[str, str], key: str, text: str) -> str:
    """What a snapshot adds to the one before; all of it where it does not go on from that."""
    before, seen[key] = seen.get(key, ""), text
    return text[len(before) :] if text.startswith(before) else text


def codex_item(kind: str, item: Any, seen: dict[str, str]) -> list[Event]:
    shape, key = text_at(item, "type") or "", text_at(item, "id") or ""
    named = text_at(item, "command", "name")
    if shape in ("agent_message", "message", "assistant_message"):
        text = text_at(item, "text", "content")
        if text is None:
            return []
        if kind == "item.completed":
            seen[key] = text
            return [("final", text)]
        return [("text", new)] if (new := fresh(seen, key, text)) else []
    if shape == "command_execution":
        out, shown, key = [("activity", f"codex:{named or 'command'}")], text_at(item, "aggregated_output"), f"{key}:output"
        if shown is not None and shown.startswith(seen.get(key, "")) and (new := fresh(seen, key, shown)):
            out.append(("output", new))
        return out
    if shape == "reasoning":
        return [("thinking", t)] if (t := text_at(item, "text")) is not None else []
    changes = at(item, "changes")
    said = {
        "mcp_tool_call": f"{text_at(item, 'server') or 'mcp'}/{text_at(item, 'tool') or 'tool'}",
        "file_change": f"file_change ({len(changes) if isinstance(changes, list) else 0})",
        "web_search": f"web_search:{text_at(item, 'query') or 'search'}",
        "tool_call": named or "tool",
        "function_call": named or "tool",
    }.get(shape)
    return [("activity", f"codex:{said}")] if said else []


def codex(value: dict, seen: dict[str, str]) -> list[Event]:
    kind = text_at(value, "type") or ""
    if kind in ("thread.started", "turn.started"):
        return [("activity", f"codex:{kind.replace('.', ' ')}")]
    if kind in ("item.started", "item.updated", "item.completed"):
        return codex_item(kind, value.get("item"), seen)
    if kind in ("thread.completed", "turn.completed", "agent_message"):
        paths = ("text",) if kind == "agent_message" else ("last_agent_message", "message")
        text = next((t for p in paths if (t := text_at(value, p)) is not None), None)
        return [("final", text)] if text is not None else []
    if kind in ("error", "turn.failed"):
        return [("output", f"{text_at(value, 'message', 'error.message') or 'Codex error'}\n")]
    return []


def gemini(value: dict, seen: dict[str, str]) -> list[Event]:
    kind = text_at(value, "type") or ""
    if kind == "message":
        text = text_at(value, "content", "delta")
        if not text or (text_at(value, "role") or "") not in ("assistant", ""):
            return []
        return [("final" if value.get("delta") is False else "text", text)]
    if kind in ("tool_use", "tool_call"):
        return [("activity", f"gemini:{text_at(value, 'tool_name', 'name') or 'tool'}")]
    if kind == "tool_result":
        return [("output", t[:SHOWN] + "\n")] if (t := text_at(value, "output", "content")) else []
    if kind == "result":
        return final(value, "response", "output", "result") if {"response", "output"} & value.keys() or isinstance(value.get("result"), str) else []
    if kind == "error":
        said = next((value[k] for k in ("error", "message") if k in value), None)
        return [("output", (json.dumps(said, separators=(",", ":"), ensure_ascii=False) if said is not None else "Gemini CLI error") + "\n")]
    return []


DIALECTS = {"claude": claude, "codex": codex, "gemini": gemini}


def line_events(dialect: str, line: str, seen: dict[str, str]) -> list[Event]:
    """Events ``(kind, text)`` of one line; ``seen`` is the state of the session's items.

    Lines that are no JSON are ignored, but one dialect shows those that begin like an object.
    """
    try:
        value = json.loads(line)
    except ValueError:
        return [("text", line)] if dialect == "claude" and line.lstrip().startswith("{") else []
    return DIALECTS[dialect](value, seen) if isinstance(value, dict) and dialect in DIALECTS else []


def feed(dialect: str, rest: bytes, data: bytes, seen: dict[str, str], ended: bool = False) -> tuple[list[Event], bytes]:
    """Events of all lines that ``data`` finishes after ``rest``, and the new rest; at the end the rest is a line too."""
    *lines, rest = (rest + data).split(b"\n")
    if ended:
        lines, rest = [*lines, rest], b""
    events: list[Event] = []
    for line in lines:
        events += line_events(dialect, line.decode("utf-8", "replace").rstrip("\r"), seen)
    return events, rest


def agent_events(chunks: DataFrame) -> DataFrame:
    """``(session, n, kind, text)`` of a stream ``(session, dialect, seq, data, ended)``; ``n`` numbers a session's events.

    Chunks of a session come in the order of ``seq``, cut anywhere, also within a character;
    ``ended`` marks the last one, after which the state goes.  Unknown dialects and null data give nothing.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, shown, n = state.get if state.exists else (b"", "{}", 0)
        rest, seen, out, over = bytes(rest), json.loads(shown), [], False
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            over = over or bool(row.ended)
            events, rest = feed(row.dialect, rest, bytes(row.data or b""), seen, bool(row.ended))
            out += events
        if over:
            state.remove()
        else:
            state.update((rest, json.dumps(seen), n + len(out)))
        if out:
            yield pd.DataFrame({"session": key[0], "n": range(n, n + len(out)), "kind": [k for k, _ in out], "text": [t for _, t in out]})

    ship_package(chunks.sparkSession)
    return chunks.groupBy("session").applyInPandasWithState(run, EVENT, "rest binary, seen string, n long", "append", GroupStateTimeout.NoTimeout)
