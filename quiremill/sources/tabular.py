"""CSV, TSV and JSON to document trees."""

from __future__ import annotations

import json

from quiremill.operators.render import markdown_table
from quiremill.operators.tree import Node, heading, table


def csv_rows(text: str, separator: str = ",") -> list[list[str]]:
    """Rows of quoted or plain fields; a quote switches anywhere, a doubled one within quotes is itself; blank rows go."""
    rows: list[list[str]] = []
    row: list[str] = []
    field: list[str] = []
    quoted = False
    at, end = 0, len(text)
    while at < end:
        c = text[at]
        if c == '"':
            if quoted and text[at + 1 : at + 2] == '"':
                field.append('"')
                at += 1
            else:
                quoted = not quoted
        elif c == separator and not quoted:
            row.append("".join(field))
            field = []
        elif c in "\r\n" and not quoted:
            if c == "\r" and text[at + 1 : at + 2] == "\n":
                at += 1
            rows.append([*row, "".join(field)])
            row, field = [], []
        else:
            field.append(c)
        at += 1
    if row or field:
        rows.append([*row, "".join(field)])
    return [r for r in rows if any(x.strip() for x in r)]


def parse_csv(content: bytes, name: str | None = None, mime: str | None = None) -> tuple[Node, dict[str, str]]:
    tabs = mime == "text/tab-separated-values" or (name or "").lower().endswith(".tsv")
    rows = csv_rows(content.decode("utf-8-sig", "replace"), "\t" if tabs else ",")
    meta = {"rows": str(max(0, len(rows) - 1)), "columns": str(len(rows[0]) if rows else 0)}
    return Node("document", [table(rows)] if rows else []), meta


def json_cell(value) -> str:
    """Nothing for null, compact JSON for objects and lists, numbers as scripts write them."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def key_union(rows: list[dict]) -> list[str]:
    """Keys of all objects, in the order in which they first come."""
    return list(dict.fromkeys(k for r in rows for k in r))


def parse_json(content: bytes, name: str | None = None) -> tuple[Node, dict[str, str]]:
    """A list of objects is a table, anything else a block of code; lines of objects count as a list."""
    text = content.decode("utf-8-sig", "replace")
    try:
        value = json.loads(text)
    except ValueError:
        lines = [x for x in text.splitlines() if x.strip()]
        if len(lines) < 2:
            raise
        value = [json.loads(x) for x in lines]
    if isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
        keys = key_union(value)
        rows = [keys, *([json_cell(x.get(k)) for k in keys] for x in value)]
        return Node("document", [table(rows)]), {"rows": str(len(value)), "columns": str(len(keys))}
    code = Node("code", value=json.dumps(value, indent=2, ensure_ascii=False), language="json")
    return Node("document", [heading(2, "JSON Data"), code]), {}


def table_markdown(rows: list[list[str]]) -> str:
    return markdown_table(rows)
