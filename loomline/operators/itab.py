"""Ordered tables: DataFrames with a hidden dense position, `__idx`, counted from 1.

Operations build new tables; nothing is collected. Positions are dense over any number of partitions: rows are
ranged by their order, written once, and each partition's count shifts the ones after it.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IDX = "__idx"
DEFAULTS = {"string": "", "int": 0, "bigint": 0, "smallint": 0, "tinyint": 0, "double": 0.0, "float": 0.0, "boolean": False}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets its own, once."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that broadcasts neither side: Catalyst guesses the rows that Python makes of a text by the text's compressed file, so it would send whole tables of them through the driver."""
    return left.join(right.hint("merge"), on, how)


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with a dense `__idx` along the order."""
    within = (1 << 33) - 1
    sorted_ = df.drop(IDX).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(sorted_.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row for each partition of the range: its size is the number of partitions.
    shift = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__shift"))
    joined = placed.join(F.broadcast(shift), "__part")
    return joined.withColumn(IDX, F.col("__shift") + F.col("__at").bitwiseAND(within) + 1).drop("__part", "__at", "__shift", "__n")


@dataclass
class Itab:
    """An internal table; every method that changes rows returns another."""

    df: DataFrame
    kind: str = "STANDARD"
    keys: list[str] = field(default_factory=list)
    unique: bool = False

    @classmethod
    def of(cls, df: DataFrame, order: list[str], **how) -> "Itab":
        """A table of df's rows in the order of the columns."""
        return cls(numbered(df, [F.col(f"`{c}`").asc_nulls_first() for c in order]), **how)

    @classmethod
    def empty(cls, spark: SparkSession, schema, **how) -> "Itab":
        return cls(spark.createDataFrame([], schema).withColumn(IDX, F.lit(0).cast("long")), **how)

    @property
    def rows(self) -> DataFrame:
        return self.df.drop(IDX)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != IDX]

    def _with(self, df: DataFrame) -> "Itab":
        return replace(self, df=df)

    def renumber(self) -> "Itab":
        return self._with(numbered(self.df, [F.col(IDX).asc()]))

    # READ TABLE
    def read_key(self, condition: Column) -> DataFrame:
        """The first row that satisfies the condition."""
        return self.df.filter(condition).orderBy(IDX).limit(1)

    def read_index(self, index: int | Column) -> DataFrame:
        return self.df.filter(F.col(IDX) == index)

    def exists(self, condition: Column) -> DataFrame:
        """One row with `found`, for TRANSPORTING NO FIELDS."""
        return self.df.filter(condition).limit(1).agg((F.count("*") > 0).alias("found"))

    # DELETE
    def delete_where(self, condition: Column) -> "Itab":
        return self._with(self.df.filter(~F.coalesce(condition, F.lit(False)))).renumber()

    def delete_index(self, index: int) -> "Itab":
        """The rows after the deleted one move up."""
        kept = self.df.filter(F.col(IDX) != index)
        return self._with(kept.withColumn(IDX, F.when(F.col(IDX) > index, F.col(IDX) - 1).otherwise(F.col(IDX))))

    def delete_adjacent(self, comparing: list[str] | None = None) -> "Itab":
        """Rows that equal the row before them in the compared columns go.

        The row before is found by its position, an equi-join that spreads over all partitions.
        """
        names = comparing or self.columns
        before = self.df.select((F.col(IDX) + 1).alias(IDX), F.struct(*names).alias("__before"))
        same = F.lit(True)
        for n in names:
            same = same & F.col(f"__before.{n}").eqNullSafe(F.col(n))
        joined = self.df.join(before, IDX, "left")
        return self._with(joined.filter(F.col("__before").isNull() | ~same).drop("__before")).renumber()

    # INSERT and APPEND
    def _size(self) -> int:
        return self.df.count()

    def append(self, rows: DataFrame, order: list[Column] | None = None) -> "Itab":
        """All rows of another table at the end, in their own order."""
        if IDX not in rows.columns:
            rows = numbered(rows, order or [F.lit(0)])
        size = self.df.agg(F.coalesce(F.max(IDX), F.lit(0)).alias("__n"))
        shifted = rows.crossJoin(F.broadcast(size)).withColumn(IDX, F.col(IDX) + F.col("__n")).drop("__n")  # one row: the length
        return self._with(self.df.unionByName(shifted, allowMissingColumns=True))

    def append_row(self, **values) -> "Itab":
        return self.append(self._row(values))

    def append_initial(self) -> "Itab":
        return self.append(self._row({}))

    def _row(self, values: dict) -> DataFrame:
        kinds = dict(self.rows.dtypes)
        values = {k.lower(): v for k, v in values.items()}
        out = []
        for name, kind in kinds.items():
            value = values.get(name.lower(), DEFAULTS.get(kind))
            out.append((value if isinstance(value, Column) else F.lit(value)).cast(kind).alias(name))
        return self.df.sparkSession.range(1).select(*out, F.lit(1).cast("long").alias(IDX))

    def insert(self, rows: DataFrame) -> "Itab":
        """INTO TABLE: a standard table gets the rows at its end, a sorted one in key order after equal keys; a unique key keeps the row that is there."""
        if self.unique and self.keys:
            rows = rows.join(self.df, self.keys, "left_anti")
        out = self.append(rows)
        if self.unique and self.keys:
            first = out.df.groupBy(*self.keys).agg(F.min(IDX).alias(IDX))
            out = out._with(out.df.join(first, [*self.keys, IDX], "left_semi")).renumber()
        return out.sort([(k, False) for k in self.keys]) if self.kind == "SORTED" and self.keys else out

    def insert_index(self, index: int, **values) -> "Itab":
        """The row takes the position; those at and after it move down."""
        moved = self.df.withColumn(IDX, F.when(F.col(IDX) >= index, F.col(IDX) + 1).otherwise(F.col(IDX)))
        return self._with(moved.unionByName(self._row(values).withColumn(IDX, F.lit(index).cast("long"))))

    # SORT, CLEAR, LOOP
    def sort(self, by: list[tuple[str, bool]] | None = None, descending: bool = False) -> "Itab":
        """Stable: rows of equal keys keep their order. Without columns the table key, or all columns, decide."""
        by = by or [(c, descending) for c in (self.keys or self.columns)]
        order = [F.col(f"`{c}`").desc_nulls_last() if d else F.col(f"`{c}`").asc_nulls_first() for c, d in by]
        return self._with(numbered(self.df.withColumnRenamed(IDX, "__was"), [*order, F.col("__was").asc()]).drop("__was"))

    def clear(self) -> "Itab":
        return self._with(self.df.limit(0))

    def loop(self, low: int | None = None, high: int | None = None, where: Column | None = None) -> DataFrame:
        """The rows a loop visits."""
        out = self.df
        if low is not None:
            out = out.filter(F.col(IDX) >= low)
        if high is not None:
            out = out.filter(F.col(IDX) <= high)
        return out if where is None else out.filter(where)

    def update(self, where: Column | None, **values: Column) -> "Itab":
        """ASSIGNING: the visited rows' components change in place."""
        test = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        kinds = dict(self.df.dtypes)
        return self._with(self.df.withColumns({k: F.when(test, v).otherwise(F.col(k)).cast(kinds[k]) for k, v in values.items()}))

    def groups(self, **keys: Column) -> DataFrame:
        """LOOP AT … GROUP BY: the groups' keys, size and first position; members are a join away, so no group is gathered in one row."""
        return self.df.groupBy(*(v.alias(k) for k, v in keys.items())).agg(F.count("*").alias("size"), F.min(IDX).alias("first"))

    def members(self, groups: DataFrame, where: Column | None = None, **keys: Column) -> DataFrame:
        """LOOP AT GROUP: the rows of the given groups, with the groups' columns."""
        mine = self.df.withColumns({f"__g_{k}": v for k, v in keys.items()})
        on = F.lit(True)
        for k in keys:
            on = on & mine[f"__g_{k}"].eqNullSafe(groups[k])
        out = mine.join(groups.select(*(groups[k] for k in keys)), on).drop(*(f"__g_{k}" for k in keys))
        return out if where is None else out.filter(where)

    def collect_row(self, by: list[str]) -> "Itab":
        """COLLECT over the whole table: numeric columns add up by the others (an extension)."""
        numeric = [c for c, t in self.rows.dtypes if c not in by and t.split("(")[0] in ("int", "bigint", "double", "float", "decimal")]
        out = self.df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in numeric), F.min(IDX).alias(IDX))
        return self._with(out).renumber()
