"""Running values along an ordered table, without a task that holds the table.

A segmented scan: rows are cut into blocks of BLOCK positions; each block's rows are scanned by themselves, each block gives one
row that says what it does to the state, these rows are scanned in turn, and every row's state is then put together from its block's
entry state and its place in the block. What a row does to the state must compose: keep it, replace it, add to it, take the larger or smaller
one (`running`, window functions only), multiply and add (`affine`), or move between finitely many states (`machine`).

Nulls: a null addend adds nothing, a null factor multiplies nothing, a null bound bounds nothing; a null that replaces the state is a state like another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .itab import checkpointed

BLOCK = 1 << 16
HOW = ("last", "sum", "max", "min")
_MERGE = {"max": F.greatest, "min": F.least}


def _block(at: str) -> Column:
    return F.floor(F.col(at) / BLOCK)


def _after(how: str, value: Column, segment: Window) -> Column:
    """The state after a row by the rows of its segment alone; a segment begins where the state is replaced."""
    if how == "last":
        return F.first(value).over(segment)
    return {"sum": F.sum, "max": F.max, "min": F.min}[how](value).over(segment)


def _merged(how: str, entry: Column, inside: Column) -> Column:
    """The state after rows that replace nothing, from the state before them."""
    if how == "last":
        return entry
    return entry + F.coalesce(inside, F.lit(0)) if how == "sum" else _MERGE[how](entry, inside)


def running(df: DataFrame, at: str, keep: Column, value: Column, how: str, start, out: str) -> DataFrame:
    """df with `out`, the state before each row; `at` numbers the rows.

    A row that keeps takes the state s to s + value (sum), the larger (max) or smaller (min) of both, or s itself (last); a row that doesn't keep makes it value.
    """
    kind = df.select((F.lit(start) + value if how == "sum" else F.coalesce(value, F.lit(start))).alias("v")).schema[0].dataType
    kind = T.LongType() if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)) else kind
    first = F.lit(start).cast(kind)
    rows = df.withColumn("__blk", _block(at)).withColumn("__keep", F.coalesce(keep, F.lit(True))).withColumn("__val", value.cast(kind))
    if how == "last":
        rows = rows.withColumn("__val", F.when(~F.col("__keep"), F.col("__val")))
    elif how == "sum":
        rows = rows.withColumn("__val", F.when(F.col("__keep"), F.coalesce("__val", F.lit(0).cast(kind))).otherwise(F.col("__val")))
    inside = Window.partitionBy("__blk").orderBy(at)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__seg", F.sum(F.when(F.col("__keep"), 0).otherwise(1)).over(upto))
    rows = rows.withColumn("__in", _after(how, F.col("__val"), Window.partitionBy("__blk", "__seg").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))
    rows = checkpointed(rows)  # read twice
    # One row for each block: their number is that of the rows over BLOCK, so one task may order them.
    blocks = rows.groupBy("__blk").agg(F.max_by(F.struct("__seg", "__in"), at).alias("s")).select("__blk", (F.col("s.__seg") == 0).alias("k"), F.col("s.__in").alias("v"))
    whole = Window.orderBy("__blk")
    blocks = blocks.withColumn("seg", F.sum(F.when(F.col("k"), 0).otherwise(1)).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    done = _after(how, F.when(F.col("k") & F.lit(how == "last"), None).otherwise(F.col("v")), Window.partitionBy("seg").orderBy("__blk").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("done", F.when(F.col("seg") == 0, _merged(how, first, done)).otherwise(done))
    blocks = blocks.select(F.col("__blk").alias("__b"), F.when(F.row_number().over(whole) == 1, first).otherwise(F.lag("done").over(whole)).alias("__entry"))
    joined = rows.join(blocks, F.col("__blk") == F.col("__b"))
    after = F.when(F.col("__seg") == 0, _merged(how, F.col("__entry"), F.col("__in"))).otherwise(F.col("__in"))
    joined = joined.withColumn("__after", after)
    before = F.when(F.row_number().over(inside) == 1, F.col("__entry")).otherwise(F.lag("__after").over(inside))
    return joined.withColumn(out, before).drop("__blk", "__b", "__keep", "__val", "__seg", "__in", "__entry", "__after")


def _replayed(df: DataFrame, at: str, step: Column, kind: str, compose: Callable, apply: Callable, start, out: str, state: str) -> DataFrame:
    """df with the state before each row, for steps that Python composes: a block's steps become one, then blocks are replayed from their entry states."""
    rows = checkpointed(df.withColumn("__blk", _block(at)).withColumn("__step", step.cast(kind)))
    # Blocks are groups of at most BLOCK rows: after a join by block a repartition may be dropped, and a block's rows then come to several tasks.

    def summed(group: pa.Table) -> pa.Table:
        total = None
        for s in group.sort_by(at)["__step"].to_pylist():
            total = s if total is None else compose(total, s)
        return pa.table([group["__blk"].slice(0, 1), pa.chunked_array([pa.array([total], group.schema.field("__step").type)])], names=["__b", "__total"])

    blocks = rows.select("__blk", at, "__step").groupBy("__blk").applyInArrow(summed, f"__b long, __total {kind}")

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = start
        for b in batches:
            got = []
            for total in b.column(1).to_pylist():
                got.append(s)
                s = apply(total, s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, _ARROW[state])], ["__b", "__entry"])

    # One row for each block, in order, in one task.
    entries = blocks.repartition(1).sortWithinPartitions("__b").mapInArrow(entered, f"__b long, __entry {state}")
    joined = rows.join(entries, F.col("__blk") == F.col("__b")).drop("__b")
    names = [c for c in joined.columns if c not in ("__blk", "__step", "__entry")]

    def replayed(group: pa.Table) -> pa.Table:
        group = group.sort_by(at)
        got, s = [], group["__entry"][0].as_py()
        for st in group["__step"].to_pylist():
            got.append(s)
            s = apply(st, s)
        return pa.table([*(group[c] for c in names), pa.chunked_array([pa.array(got, _ARROW[state])])], names=[*names, out])

    schema = T.StructType([*(joined.schema[c] for c in names), T.StructField(out, T._parse_datatype_string(state))])
    return joined.groupBy("__blk").applyInArrow(replayed, schema)


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}


def affine(df: DataFrame, at: str, factor: Column, addend: Column, start, out: str) -> DataFrame:
    """df with `out`, the state before each row; a row takes the state s to factor * s + addend. Whole numbers stay exact (and overflow is an error), others are doubles."""
    kinds = [df.select(c.alias("v")).schema[0].dataType for c in (factor, addend)]
    whole = all(isinstance(k, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType)) for k in kinds) and isinstance(start, int)
    state = "bigint" if whole else "double"
    step = F.array(F.coalesce(factor.cast(state), F.lit(1).cast(state)), F.coalesce(addend.cast(state), F.lit(0).cast(state)))
    return _replayed(df, at, step, f"array<{state}>", lambda p, q: [p[0] * q[0], q[0] * p[1] + q[1]], lambda p, s: p[0] * s + p[1], start, out, state)


def machine(df: DataFrame, at: str, following: list[Column], start: int, out: str) -> DataFrame:
    """df with `out`, the number of the state before each row; following[k] is the number of the state after a row that finds state k."""
    step = F.array(*(c.cast("int") for c in following))
    return _replayed(df, at, step, "array<int>", lambda p, q: [q[k] for k in p], lambda p, s: p[s], start, out, "int")
