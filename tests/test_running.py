"""Loops with running state against plain Python loops over the same rows, with blocks of a few rows."""

import pytest
from pyspark.sql import functions as F

from loomline.operators import scan
from loomline.operators.itab import IDX, Itab
from loomline.plans.expressions import BindError
from loomline.plans.program import Program
from loomline.plans.select import Catalog

ROWS = [(k, (k * k * 7 + k) % 11 - 4, "abcab"[(k * k) % 5]) for k in range(1, 41)]
OUT = "DATA: BEGIN OF g, k TYPE int8, n TYPE int8, END OF g. DATA r LIKE STANDARD TABLE OF g. "


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 7)


def ran(spark, source, rows=ROWS):
    df = spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], f"k long, v int, c string, {IDX} long").repartition(3)
    program = Program(spark, Catalog(spark, {}))
    program.variables["t"] = Itab(df)
    return program.run(source).variables


def rows_of(table):
    return [tuple(r) for r in table.df.orderBy(IDX).drop(IDX).collect()]


def test_running_sum_with_reset_and_appends_in_order(spark):
    got = ran(spark, OUT + "DATA s TYPE i. LOOP AT t INTO DATA(w). IF w-c = 'c'. s = 0. APPEND VALUE #( k = w-k n = -1 ) TO r. ENDIF. s = s + w-v. APPEND VALUE #( k = w-k n = s ) TO r. ENDLOOP.")
    want, s = [], 0
    for k, v, c in ROWS:
        if c == "c":
            s = 0
            want.append((k, -1))
        s += v
        want.append((k, s))
    assert rows_of(got["r"]) == want and got["s"] == s


def test_exit_cuts_what_follows_in_its_row(spark):
    got = ran(spark, "DATA: s TYPE i, n TYPE i, m TYPE i. LOOP AT t INTO DATA(w) WHERE v > 0. s = s + w-v. IF s > 30. m = w-k. EXIT. ENDIF. n = n + 1. ENDLOOP.")
    s = n = m = 0
    for k, v, _ in ROWS:
        if v > 0:
            s += v
            if s > 30:
                m = k
                break
            n += 1
    assert (got["s"], got["n"], got["m"]) == (s, n, m)


def test_exit_that_never_comes(spark):
    got = ran(spark, "DATA s TYPE i. LOOP AT t INTO DATA(w). s = s + w-v. IF s > 100000. EXIT. ENDIF. ENDLOOP.")
    assert got["s"] == sum(r[1] for r in ROWS)


@pytest.mark.parametrize(("how", "op", "start"), [("max", ">", -100), ("min", "<", 100)])
def test_records_and_their_rows(spark, how, op, start):
    got = ran(spark, f"DATA: m TYPE i, at TYPE int8, n TYPE i. m = {start}. LOOP AT t ASSIGNING FIELD-SYMBOL(<f>). IF <f>-v {op} m. m = <f>-v. at = <f>-k. n = n + 1. ENDIF. <f>-v = m. ENDLOOP.")
    m, at, n, want = start, 0, 0, []
    for k, v, c in ROWS:
        if (v > m) if how == "max" else (v < m):
            m, at, n = v, k, n + 1
        want.append((k, m, c))
    assert rows_of(got["t"]) == want and (got["m"], got["at"], got["n"]) == (m, at, n)


def test_functions_of_state_and_row(spark):
    got = ran(spark, OUT + "DATA m TYPE i. LOOP AT t INTO DATA(w). m = nmax( val1 = m val2 = w-v ). IF w-c = 'b'. m = 0. ENDIF. APPEND VALUE #( k = w-k n = m ) TO r. ENDLOOP.")
    m, want = 0, []
    for k, v, c in ROWS:
        m = max(m, v)
        m = 0 if c == "b" else m
        want.append((k, m))
    assert rows_of(got["r"]) == want


def test_states_that_conditions_choose(spark):
    got = ran(spark, "DATA: st TYPE string, n TYPE i. st = 'x'. LOOP AT t REFERENCE INTO DATA(r). CASE st. WHEN 'x'. IF r->v > 2. st = 'y'. ENDIF. WHEN 'y' OR 'q'. IF r->c = 'c'. st = 'z'. ELSEIF r->v < 0. st = 'x'. ENDIF. WHEN OTHERS. st = 'x'. ENDCASE. IF st = 'y'. n = n + 1. ENDIF. r->c = st. ENDLOOP.")
    st, n, want = "x", 0, []
    for k, v, c in ROWS:
        if st == "x":
            st = "y" if v > 2 else st
        elif st == "y":
            st = "z" if c == "c" else "x" if v < 0 else st
        else:
            st = "x"
        n += st == "y"
        want.append((k, v, st))
    assert rows_of(got["t"]) == want and (got["st"], got["n"]) == (st, n)


def test_multiplied_state_stays_exact(spark):
    got = ran(spark, OUT + "DATA h TYPE i. h = 1. LOOP AT t INTO DATA(w). h = h * 3. IF w-k > 20. h = 1. ENDIF. h = h - w-v. APPEND VALUE #( k = w-k n = h ) TO r. ENDLOOP.")
    h, want = 1, []
    for k, v, _ in ROWS:
        h = (1 if k > 20 else h * 3) - v
        want.append((k, h))
    assert rows_of(got["r"]) == want


def test_rows_that_repeat_the_one_before_are_deleted(spark):
    got = ran(spark, "DATA: last TYPE string, n TYPE i. LOOP AT t INTO DATA(w). CHECK w-v <> 0. IF w-c = last. DELETE t INDEX sy-tabix. CONTINUE. ENDIF. last = w-c. n = n + 1. ENDLOOP.")
    last, n, want = "", 0, []
    for k, v, c in ROWS:
        if v != 0:
            if c == last:
                continue
            last, n = c, n + 1
        want.append((k, v, c))
    assert rows_of(got["t"]) == want and (got["last"], got["n"]) == (last, n)
    assert [r[IDX] for r in got["t"].df.orderBy(IDX).collect()] == list(range(1, len(want) + 1))


def test_nulls_add_nothing_and_conditions_on_them_fail(spark):
    rows = [(1, None, "a"), (2, 5, None), (3, None, None), (4, 2, "a")]
    got = ran(spark, "DATA: s TYPE i, m TYPE i, n TYPE i, p TYPE i. p = 1. LOOP AT t INTO DATA(w). p = p * w-v. p = p + 1. s = s + w-v. IF w-v > m. m = w-v. ENDIF. IF w-c = 'a' AND s > 1. n = n + 1. ENDIF. ENDLOOP.", rows)
    assert (got["s"], got["m"], got["n"], got["p"]) == (7, 5, 1, (((1 + 1) * 5 + 1) + 1) * 2 + 1)


def test_loops_over_no_rows_change_nothing(spark):
    got = ran(spark, OUT + "DATA s TYPE i. s = 4. LOOP AT t INTO DATA(w) WHERE v > 99. s = s + w-v. APPEND VALUE #( k = w-k n = s ) TO r. IF s > 5. EXIT. ENDIF. ENDLOOP.")
    assert got["s"] == 4 and rows_of(got["r"]) == []


@pytest.mark.parametrize("body", ["s = s * s.", "IF s > 3. s = s + w-v. ENDIF.", "s = s + u. u = u + s.", "PERFORM x.", "DELETE r INDEX 1.", "w-v = s."])
def test_bodies_without_a_form_raise(spark, body):
    with pytest.raises(BindError):
        ran(spark, OUT + f"DATA: s TYPE i, u TYPE i. LOOP AT t INTO DATA(w). {body} IF s > 9. EXIT. ENDIF. ENDLOOP.")


def test_reductions_of_a_table(spark):
    got = ran(spark, "DATA(a) = REDUCE i( INIT x = -9 FOR w IN t NEXT x = nmax( val1 = x val2 = w-v ) ). DATA(b) = REDUCE string( INIT x = '>' FOR w IN t WHERE ( v > 3 ) NEXT x = x && w-c ). DATA(n) = REDUCE i( INIT x = 1 FOR w IN t WHERE ( v > 99 ) NEXT x = nmin( val1 = x val2 = w-v ) ).")
    assert (got["a"], got["b"], got["n"]) == (max(r[1] for r in ROWS), ">" + "".join(c for _, v, c in ROWS if v > 3), 1)


@pytest.mark.parametrize("step", ["x * w-v", "x / 2", "w-v - x", "w-v", "x + x", "x + w-v * x"])
def test_steps_that_are_no_monoid_raise(spark, step):
    with pytest.raises(BindError):
        ran(spark, f"DATA(a) = REDUCE i( INIT x = 1 FOR w IN t NEXT x = {step} ).")


def test_sizes_declarations_and_folded_scalars(spark):
    got = ran(spark, "DATA: n TYPE i, k TYPE i. n = lines( t ) + 1. WHILE k < 3. k = k + 1. ENDWHILE. FORM unused. CLEAR n. ENDFORM.")
    assert (got["n"], got["k"]) == (41, 3)


def test_no_task_holds_the_table(spark):
    """Rows of a scan are windowed by block; only one row for each block is ordered in one task."""
    df = spark.range(1, 101).select(F.col("id").alias(IDX), (F.col("id") % 5).alias("v"))
    out = scan.running(df, IDX, F.lit(True), F.col("v"), "sum", 0, "s")
    got = {r[IDX]: r.s for r in out.collect()}
    assert all(got[i] == sum(k % 5 for k in range(1, i)) for i in range(1, 101))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") > 0 and all("__blk" in line or "seg" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window"))
