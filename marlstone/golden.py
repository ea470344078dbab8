"""Golden scripts: statements with the text that they must print.

Records are ``query`` or ``query rowsort``, SQL lines, ``----`` and the expected rows up to a
blank line; ``statement ok`` and SQL; and ``statement error <kind>`` and SQL.  ``#`` starts a
comment between records.  Cells are joined by one space, NULL prints as NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from .errors import SqlError
from .session import Session


@dataclass
class Record:
    line: int
    header: list[str]
    sql: str
    expected: list[str]


def read(text: str) -> list[Record]:
    out, lines, i = [], text.split("\n"), 0
    while i < len(lines):
        if not lines[i].strip() or lines[i].startswith("#"):
            i += 1
            continue
        start, header, sql, expected, into = i + 1, lines[i].split(), [], [], None
        i += 1
        while i < len(lines) and lines[i].strip():
            if lines[i] == "----" and into is None:
                into = expected
            else:
                (sql if into is None else into).append(lines[i])
            i += 1
        out.append(Record(start, header, "\n".join(sql), expected))
    return out


def cell(value) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else str(value)


def run(session: Session, text: str) -> int:
    """Run all records; the number run, or an AssertionError that names the line."""
    records = read(text)
    for r in records:
        where = f"line {r.line}: {r.sql}"
        if r.header[:2] == ["statement", "error"]:
            try:
                session.sql(r.sql)
            except SqlError as error:
                assert error.kind == r.header[2], f"{where}: {error.kind}"
                continue
            raise AssertionError(f"{where}: no error")
        result = session.sql(r.sql)
        if r.header[0] == "query":
            got = [" ".join(map(cell, row)) for row in result.rows()]
            want = r.expected
            if "rowsort" in r.header:
                got, want = sorted(got), sorted(want)
            assert got == want, f"{where}: {got} != {want}"
        else:
            assert r.header == ["statement", "ok"], where
    return len(records)
