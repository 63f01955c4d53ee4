"""Ordered tables with nulls, duplicates, one row and none."""

import pytest
from pyspark.sql import functions as F

from loomline.operators.itab import IDX, Itab
from loomline.plans.expressions import BindError
from loomline.plans.program import Program
from loomline.plans.select import Catalog, select

SCHEMA = "k int, v string"


def table(spark, rows, **how):
    return Itab(spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], f"{SCHEMA}, {IDX} long"), **how)


def rows(t):
    got = t.df.orderBy(IDX).collect()
    assert [r[IDX] for r in got] == list(range(1, len(got) + 1))
    return [(r.k, r.v) for r in got]


ROWS = [(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, None), (1, "a")]


def test_delete_keeps_rows_whose_condition_is_null(spark):
    assert rows(table(spark, ROWS).delete_where(F.col("k") == 1)) == [(None, "b"), (None, "b"), (2, None)]


def test_adjacent_duplicates_are_null_safe(spark):
    assert rows(table(spark, ROWS).delete_adjacent()) == [(1, "a"), (None, "b"), (2, None), (1, "a")]
    assert rows(table(spark, ROWS).delete_adjacent(["v"])) == [(1, "a"), (None, "b"), (2, None), (1, "a")]


def test_sort_is_stable(spark):
    assert rows(table(spark, [(2, "x"), (1, "y"), (2, "a"), (1, "b")]).sort([("k", True)])) == [(2, "x"), (2, "a"), (1, "y"), (1, "b")]


@pytest.mark.parametrize("start", [[], [(1, "a")]])
def test_append_and_initial(spark, start):
    t = table(spark, start).append_row(k=7).append_initial()
    assert rows(t) == [*start, (7, ""), (0, "")]


def test_insert_keeps_unique_keys_and_order(spark):
    t = table(spark, [(1, "a"), (3, "c")], kind="SORTED", keys=["k"], unique=True)
    assert rows(t.insert(t._row({"k": 2, "v": "b"}))) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(t.insert(t._row({"k": 3, "v": "z"}))) == [(1, "a"), (3, "c")]


def test_index_operations(spark):
    t = table(spark, [(1, "a"), (2, "b"), (3, "c")])
    assert rows(t.delete_index(2)) == [(1, "a"), (3, "c")]
    assert rows(t.insert_index(2, k=9, v="n")) == [(1, "a"), (9, "n"), (2, "b"), (3, "c")]
    assert t.read_index(9).count() == 0
    assert rows(t.clear()) == []


@pytest.mark.parametrize("body", ["x = x * x.", "x = w-k. n = n + x. APPEND VALUE #( k = x ) TO t.", "n = n + x. x = x + n."])
def test_a_loop_that_needs_an_order_is_refused(spark, body):
    with pytest.raises(BindError):
        Program(spark, Catalog(spark), {"t": table(spark, ROWS), "r": table(spark, ROWS), "x": 1, "n": 0}).run(f"LOOP AT t INTO DATA(w). {body} ENDLOOP.")


def test_a_moved_row_is_not_written_through_its_field_symbol(spark):
    state = Program(spark, Catalog(spark), {"t": table(spark, [(1, "a"), (2, "b")])}).run("APPEND INITIAL LINE TO t ASSIGNING FIELD-SYMBOL(<n>). <n>-k = 7. <n>-v = 'z'.")
    assert rows(state.variables["t"]) == [(1, "a"), (2, "b"), (7, "z")]
    with pytest.raises(BindError, match="moved"):
        state.run("SORT t BY k DESCENDING. <n>-k = 8.")


@pytest.mark.parametrize("section", ["TABLES t = t", "CHANGING c = x", "EXCEPTIONS e = 1"])
def test_sections_of_calls_that_are_not_run_are_refused(spark, section):
    from loomline.functions import registry

    name = sorted(registry.FUNCTIONS)[0]
    with pytest.raises(BindError, match=section.split()[0]):
        Program(spark, Catalog(spark)).run(f"CALL FUNCTION '{name}' EXPORTING a = 'x' IMPORTING b = y {section}.")


def test_control_flow_and_structures(spark):
    got = Program(spark, Catalog(spark)).run(
        "TYPES: BEGIN OF ty, a TYPE i, b TYPE string, END OF ty. DATA: lt TYPE STANDARD TABLE OF ty, n TYPE i. "
        "WHILE n < 3. n = n + 1. APPEND VALUE #( a = n b = |x{ n }| ) TO lt. ENDWHILE. CASE n. WHEN 3. DATA(z) = 'three'. WHEN OTHERS. z = 'no'. ENDCASE."
    )
    assert [(r.a, r.b) for r in got.variables["lt"].df.orderBy(IDX).collect()] == [(1, "x1"), (2, "x2"), (3, "x3")]
    assert got.variables["z"] == "three"


def test_select_reports_what_it_cannot_bind(spark):
    catalog = Catalog(spark, {"t": spark.createDataFrame([(1, "a")], "k int, v string")})
    for bad in ("SELECT nope FROM t INTO TABLE @x", "SELECT k SUM( v ) FROM t INTO TABLE @x", "SELECT SUM( MAX( k ) ) AS s FROM t INTO TABLE @x", "SELECT k FROM t WHERE k = @missing INTO TABLE @x"):
        with pytest.raises(ValueError):
            select(catalog, bad)
