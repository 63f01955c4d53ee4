"""Source files made from the rows of a table by a template, and SQL for what its parts are.

A template is text with fields `{sql}` and marked parts `[[name|text]]`, which may nest. The SQL of a field has to mean the same to Spark and to
DuckDB. As the length of every field is known to both, SQL tells each mark's place without reading the text as a program.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources.corpus import spread

_PARTS = re.compile(r"\[\[([\w-]+)\||(\]\])|\{([^{}]+)\}")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass
class Sheet:
    table: str
    file_id: str
    name: str
    template: str
    pieces: list[tuple[bool, str]] = field(default_factory=list)
    marks: list[tuple[str, int, int]] = field(default_factory=list)

    def __post_init__(self):
        at, open_ = 0, []
        for m in _PARTS.finditer(self.template):
            if m.start() > at:
                self.pieces.append((False, self.template[at : m.start()]))
            at = m.end()
            if m[1]:
                open_.append(len(self.marks))
                self.marks.append((m[1], len(self.pieces), -1))
            elif m[2]:
                k = open_.pop()
                self.marks[k] = (*self.marks[k][:2], len(self.pieces))
            else:
                self.pieces.append((True, m[3]))
        if at < len(self.template):
            self.pieces.append((False, self.template[at:]))

    def _text(self, low: int, high: int) -> str:
        parts = [f"CAST({p} AS STRING)" if sql else _quoted(p) for sql, p in self.pieces[low:high]]
        return "concat(" + ", ".join(parts or ["''"]) + ")"

    def _length(self, k: int) -> str:
        fixed = sum(len(p) for sql, p in self.pieces[:k] if not sql)
        return " + ".join([str(fixed), *(f"length(CAST({p} AS STRING))" for sql, p in self.pieces[:k] if sql)])

    def files(self, table: DataFrame) -> DataFrame:
        """file_id, name, content: a row for each row of the table."""
        parts = [F.expr(f"CAST({p} AS STRING)") if sql else F.lit(p) for sql, p in self.pieces]
        return spread(table).select(F.expr(f"CAST({self.file_id} AS BIGINT)").alias("file_id"), F.expr(f"CAST({self.name} AS STRING)").alias("name"), F.concat(*parts).alias("content"))

    def start(self, mark: str) -> str:
        """SQL for where the first part of this name starts."""
        return next(f"({self._length(a)})" for m, a, _ in self.marks if m == mark)

    def end(self, mark: str) -> str:
        return next(f"({self._length(b)})" for m, _, b in self.marks if m == mark)

    def asked(self, table: DataFrame, mark: str, **more: str) -> DataFrame:
        """file_id, offset and further columns (SQL): the place of a mark in every file."""
        return table.select(F.expr(f"CAST({self.file_id} AS BIGINT)").alias("file_id"), F.expr(f"CAST({self.start(mark)} AS INT)").alias("offset"), *(F.expr(v).alias(k) for k, v in more.items()))

    def rows(self, columns: dict[str, str] | None = None, only=None) -> str:
        """SQL of a row for each mark of each file: file_id, ord, kind (the mark's name), lit, start, end; columns by name instead."""
        out = []
        for i, (mark, a, b) in enumerate(self.marks):
            if only is not None and mark not in only:
                continue
            have = {
                "file_id": f"CAST({self.file_id} AS BIGINT)", "ord": f"CAST({i} AS INTEGER)", "kind": _quoted(mark), "lit": self._text(a, b),
                "start": f"CAST({self._length(a)} AS INTEGER)", "end": f"CAST({self._length(b)} AS INTEGER)",
            }
            wanted = columns or {k: k for k in have}
            out.append("SELECT " + ", ".join(f'{have[v]} AS "{k}"' for k, v in wanted.items()) + f" FROM {self.table}")
        return " UNION ALL ".join(out)

    def each(self, *rows: dict[str, str]) -> str:
        """SQL of given rows for each file; values are SQL, `start:mark` or `end:mark`."""

        def value(v: str) -> str:
            how, _, mark = v.partition(":")
            return f"CAST({self.start(mark) if how == 'start' else self.end(mark)} AS INTEGER)" if how in ("start", "end") and mark else v

        return " UNION ALL ".join(f"SELECT CAST({self.file_id} AS BIGINT) AS file_id, " + ", ".join(f'{value(v)} AS "{k}"' for k, v in r.items()) + f" FROM {self.table}" for r in rows)
