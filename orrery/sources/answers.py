"""Findings out of model answers: fences, broken and cut-off JSON.

A row's answer is read once from left to right.  The scan knows whether it is in a string and
which brackets are open, so at the end it knows what would close the text, and which
objects were whole before it broke off.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from orrery.session import ship_package

FINDING = "rule_id string, status string, message string, affected array<string>"
#: A string, closed or not, or a bracket.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("|\\?\Z)|[{}\[\]]', re.DOTALL)
CLOSERS = {"{": "}", "[": "]"}


def scan(text: str) -> tuple[str, list[tuple[int, int]]]:
    """What closes ``text``, and the spans of its outermost whole objects.

    A closing bracket that does not fit the innermost open one is passed over.
    """
    open_at: list[tuple[str, int]] = []
    whole: list[tuple[int, int]] = []
    quote = ""
    for m in TOKEN.finditer(text):
        token = m.group()
        if token[0] == '"':
            # A backslash at the very end would swallow the quote that closes the string.
            quote = "" if m.group(1) == '"' else '"'
        elif token in CLOSERS:
            open_at.append((token, m.start()))
        elif open_at and CLOSERS[open_at[-1][0]] == token:
            bracket, start = open_at.pop()
            if bracket == "{":
                while whole and whole[-1][0] > start:
                    whole.pop()
                whole.append((start, m.end()))
    return quote + "".join(CLOSERS[b] for b, _ in reversed(open_at)), whole


def unfenced(text: str) -> str:
    """The inside of a text that begins with a code fence."""
    if not text.startswith("```"):
        return text
    inside = text.partition("\n")[2] or text
    return inside[: inside.rfind("```")].strip() if "```" in inside else inside.strip()


def outer(text: str) -> str:
    """From the first brace to the last one; brackets where there is none."""
    start = next((text.find(c) for c in "{[" if c in text), -1)
    end = next((text.rfind(c) for c in "}]" if c in text), -1)
    return text[start : end + 1] if 0 <= start < end else ""


def as_findings(value: Any) -> list[dict]:
    """The findings of a parsed answer: under ``items``, a list, or one object; none if any of them has the wrong types."""
    if isinstance(value, dict) and isinstance(value.get("items"), list) and value["items"]:
        value = value["items"]
    rows = value if isinstance(value, list) else [value]
    made = []
    for row in rows:
        if not isinstance(row, dict):
            return []
        rule, affected = row.get("rule_id", ""), row.get("affected", [])
        texts = [rule, row.get("status"), row.get("message")]
        if not isinstance(affected, list) or not all(isinstance(x, str) for x in [*texts, *affected]):
            return []
        made.append({"rule_id": rule, "status": row["status"], "message": row["message"], "affected": affected})
    return made


def parsed(text: str) -> list[dict]:
    try:
        return as_findings(json.loads(text))
    except (ValueError, RecursionError):
        return []


def is_json(entry: str) -> bool:
    return entry.startswith(("{", "[", "```")) or '"items"' in entry


def tidy(rows: list[dict]) -> list[dict]:
    """Texts without blanks around them, statuses in lower case, no empty messages and no JSON among the affected."""
    out = []
    for r in rows:
        affected = [a.strip() for a in r["affected"]]
        row = {"rule_id": r["rule_id"].strip(), "status": r["status"].strip().lower(), "message": r["message"].strip(), "affected": [a for a in affected if a and not is_json(a)]}
        if row["message"]:
            out.append(row)
    return out


def findings_of(answer: str | None) -> list[dict]:
    """The findings of one answer; an empty list if there are none.

    Tried in turn: the text without its fence, its outermost braces, the text with all that is
    open closed, and at last every whole object in it that has a status and a message.
    """
    text = (answer or "").strip()
    inside = unfenced(text)
    for tried in dict.fromkeys((inside, outer(inside), inside + scan(inside)[0])):
        if tried and (rows := parsed(tried)):
            return tidy(rows)
    whole = [parsed(text[a:b]) for a, b in scan(text)[1]]
    return tidy([r for rows in whole for r in rows if r["message"].strip()])


def repaired(answers: DataFrame, value: str = "value") -> DataFrame:
    """``answers`` with a row for each finding of ``value``, as columns ``rule_id, status, message, affected`` in place of it.

    Null, empty and hopeless answers give no row; repeated answers give repeated rows.
    """
    kept = [c for c in answers.columns if c not in (value, "rule_id", "status", "message", "affected")]
    schema = ", ".join([*(f"`{c}` {answers.schema[c].dataType.simpleString()}" for c in kept), FINDING])
    columns = [*kept, "rule_id", "status", "message", "affected"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*row[:-1], *f.values()) for row in batch.itertuples(index=False, name=None) for f in findings_of(row[-1])]
            yield pd.DataFrame(rows, columns=columns)

    ship_package(answers.sparkSession)
    return answers.select(*kept, value).mapInPandas(run, schema)
