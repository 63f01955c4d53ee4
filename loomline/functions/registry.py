"""Functions that expressions may call, by name: builders from columns to a column."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import text

FUNCTIONS = {
    "lines": F.size, "strlen": F.length, "to_upper": F.upper, "to_lower": F.lower, "condense": text.condense, "abs": F.abs, "ceil": F.ceil, "floor": F.floor,
    "round": F.round, "sign": F.signum, "reverse": F.reverse, "concat_lines_of": lambda table, sep=None: F.array_join(table, ""),
    "url_decode": text.url_decode, "url_encode": text.path_encode, "ipow": lambda a, b: F.pow(a, b), "nmin": F.least, "nmax": F.greatest, "line_exists": lambda row: row.isNotNull(),
}


def register(name: str, builder) -> None:
    """Adds a function; builder takes and returns columns (a pandas UDF is such a builder)."""
    FUNCTIONS[name.lower()] = builder
