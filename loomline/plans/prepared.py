"""Prepared SQL: a statement with `?` places, its values bound as parameters, and result rows as text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import Catalog


@dataclass
class Prepared:
    """One SQL statement over a catalog's tables; Spark binds the values, so no text is pasted into the statement.

    Every table of the catalog that the statement may name becomes a temporary view of the session, replacing one of the same name.
    """

    catalog: Catalog
    statement: str

    def run(self, *values) -> DataFrame:
        """Values in the order of their places: text, whole numbers, floats, bytes or None. Empty bytes bind null."""
        for name in self.catalog.tables:
            if name in self.statement.lower():
                self.catalog.table(name).createOrReplaceTempView(name)
        bound = [None if isinstance(v, (bytes, bytearray)) and not v else bytes(v) if isinstance(v, bytearray) else v for v in values]
        return self.catalog.spark.sql(self.statement, args=bound) if bound else self.catalog.spark.sql(self.statement)


def execute(catalog: Catalog, statement: str, *values) -> DataFrame:
    """The rows of one statement."""
    return Prepared(catalog, statement).run(*values)


def as_text(df: DataFrame) -> DataFrame:
    """Every value as text: null is empty, bytes are lower-case hexadecimal, floats are in their shortest form."""

    def plain(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        return F.coalesce(F.lower(F.hex(value)) if kind == "binary" else value.cast("string"), F.lit("")).alias(name)

    return df.select(*(plain(*x) for x in df.dtypes))


def whole(text: Column) -> Column:
    """A text field as a whole number; null if it isn't one."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def real(text: Column) -> Column:
    """A text field as a float; null if it isn't one."""
    return F.when(text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), text.try_cast("double"))
