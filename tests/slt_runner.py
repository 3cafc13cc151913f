"""Runs SQL logic tests: `statement ok|error`, and `query [rowsort]` with expected rows after `----`."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

from larkspur.session import Engine


def show(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else repr(round(value, 6))
    if isinstance(value, Decimal):
        return f"{value.normalize():f}"
    return str(value)


def records(text: str) -> list[tuple[str, str, list[str]]]:
    """(head, SQL, expected rows)"""
    out = []
    for block in text.replace("\r", "").split("\n\n"):
        lines = [x for x in block.split("\n") if x.strip() and not x.startswith("#")]
        if not lines:
            continue
        body = lines[1:]
        cut = body.index("----") if "----" in body else len(body)
        out.append((lines[0], "\n".join(body[:cut]), [" ".join(x.split()) for x in body[cut + 1 :]]))
    return out


def run_file(engine: Engine, path: Path, base: Path) -> None:
    for head, sql, expected in records(path.read_text()):
        sql = sql.replace("{dir}", str(base))
        words = head.split()
        if words[:2] == ["statement", "error"]:
            try:
                engine.sql(sql).collect()
            except Exception:
                continue
            raise AssertionError(f"{path.name}: no error from {sql}")
        rows = [" ".join(show(v) for v in r) for r in engine.sql(sql).collect()]
        if words[0] == "query":
            if "rowsort" in words:
                rows, expected = sorted(rows), sorted(expected)
            assert rows == expected, f"{path.name}: {sql}\n{rows}\n{expected}"
