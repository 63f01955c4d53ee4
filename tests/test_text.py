"""Parts of URLs, prepared statements and rows as text."""

import pytest

from loomline.functions import text
from loomline.plans.prepared import as_text, execute, real, whole
from loomline.plans.program import Program
from loomline.plans.select import Catalog


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "s string").select(build("s")).first()[0]


@pytest.mark.parametrize(
    ("part", "given", "want"),
    [
        ("path", "a/b?c;d e", "a/b%3Fc;d%20e"), ("segment", "a/b;c,d?e$", "a%2Fb%3Bc%2Cd%3Fe$"), ("query", "a b&c", "a+b%26c"), ("user", "u:p@h;1/?", "u%3Ap%40h;1%2F%3F"),
        ("fragment", "a(b)!*'?", "a(b)!*%27?"), ("host", "[::1]:80 /", "[::1]:80%20%2F"), ("zone", "e th0", "e%20th0"), ("path", "%24", "%2524"), ("host", "é", "%C3%A9"),
    ],
)
def test_escape(spark, part, given, want):
    assert one(spark, given, lambda c: text.escape(c, part)) == want


@pytest.mark.parametrize(
    ("part", "given", "want"),
    [
        ("query", "a+b%20", "a b "), ("path", "a+b%20", "a+b "), ("segment", "%zz", None), ("fragment", "%4", None), ("host", "a%25b", "a%b"), ("host", "a%41", None), ("host", "%C3%A9", "é"),
        ("host", "a b", None), ("zone", "e%20th%25%41", "e th%A"), ("zone", "%2F", None), ("zone", "%C3%A9", None), ("host", "a/b", None), ("host", "[::1]:80", "[::1]:80"), ("host", "", ""),
    ],
)
def test_unescape(spark, part, given, want):
    assert one(spark, given, lambda c: text.unescape(c, part)) == want


def test_unknown_part():
    with pytest.raises(ValueError):
        text.unescape("s", "port")
    with pytest.raises(KeyError):
        text.escape("s", "port")


def test_prepared(spark):
    catalog = Catalog(spark, {"t": spark.createDataFrame([(1, "x", bytearray(b"\x01\xff"), 0.5), (2, "it's", None, None)], "k int, s string, b binary, f double")})
    assert [r.k for r in execute(catalog, "SELECT k FROM t WHERE s = ?", "it's").collect()] == [2]
    assert execute(catalog, "SELECT k FROM t WHERE b = ?", b"").count() == 0
    assert execute(catalog, "SELECT ? IS NULL AS x", b"").first().x
    rows = as_text(execute(catalog, "SELECT * FROM t ORDER BY k"))
    assert [tuple(r) for r in rows.collect()] == [("1", "x", "01ff", "0.5"), ("2", "it's", "", "")]
    got = rows.select(whole(rows["k"]), whole(rows["f"]), real(rows["f"]), real(rows["s"])).collect()
    assert [tuple(r) for r in got] == [(1, None, 0.5, None), (2, None, None, None)]


def test_corresponding(spark):
    catalog = Catalog(spark, {"t": spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")})
    types = "TYPES: BEGIN OF s, b TYPE string, c TYPE i, END OF s, tt TYPE STANDARD TABLE OF s WITH EMPTY KEY. "
    state = Program(spark, catalog).run(types + "DATA u TYPE tt. SELECT a b FROM t INTO TABLE @DATA(r). u = CORRESPONDING #( r ). READ TABLE r INDEX 2 INTO DATA(w). DATA(v) = CORRESPONDING s( w ).")
    assert [tuple(x) for x in state.variables["u"].rows.orderBy("b").collect()] == [("x", 0), ("y", 0)]
    assert state.variables["v"] == {"b": "y", "c": 0}
