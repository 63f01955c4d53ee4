"""One test for each kind of construct: it parses without problems into the node kind it should."""

import pytest

from loomline.plans.lexer import tokenize
from loomline.plans.syntax import parse, parse_select

CASES = {
    "DATA lv TYPE i VALUE 5.": ["Data_Typed_Decl"],
    "DATA: a TYPE i, b TYPE string.": ["Data_Typed_Decl"] * 2,
    "DATA: BEGIN OF ls, a TYPE i, BEGIN OF inner, b TYPE string, END OF inner, END OF ls.": ["Data_Struct_Decl"],
    "DATA(x) = 5.": ["Data_Inline_Decl"],
    "DATA lt TYPE SORTED TABLE OF ty WITH UNIQUE KEY name.": ["Data_Typed_Decl"],
    "TYPES t TYPE HASHED TABLE OF x WITH UNIQUE KEY col1.": ["Types_Decl"],
    "CONSTANTS c TYPE i VALUE 1.": ["Const_Decl"],
    "FIELD-SYMBOLS: <a> TYPE any, <b> TYPE t.": ["Field_Symbol_Decl"] * 2,
    "CONTROLS tc TYPE TABLEVIEW USING SCREEN 100.": ["Controls_Decl"],
    "FORM f TABLES t USING VALUE(a) TYPE i CHANGING b. ENDFORM.": ["Form_Decl"],
    "REPORT z LINE-SIZE 80.": ["Report_Decl"],
    "INCLUDE zinc.": ["Include_Decl"],
    "MODULE m INPUT. a = 1. ENDMODULE.": ["Module_Decl"],
    "START-OF-SELECTION. a = 1.": ["Event_Block"],
    "AT SELECTION-SCREEN OUTPUT. a = 1.": ["Event_Block"],
    "CLASS c DEFINITION ABSTRACT INHERITING FROM b CREATE PRIVATE FOR TESTING. PUBLIC SECTION. INTERFACES i. METHODS: m, n RAISING cx. ENDCLASS.": ["Class_Def_Decl"],
    "CLASS c IMPLEMENTATION. METHOD i~m. a = 1. ENDMETHOD. ENDCLASS.": ["Class_Impl_Decl"],
    "INTERFACE i. METHODS m IMPORTING a TYPE i OPTIONAL. ENDINTERFACE.": ["Interface_Decl"],
    "IF a = 1 OR NOT ( b > 2 AND c IS INITIAL ). x = 1. ELSEIF d IS NOT BOUND. x = 2. ELSE. x = 3. ENDIF.": ["If_Stmt"],
    "CASE a. WHEN 1 OR 2. x = 1. WHEN OTHERS. x = 2. ENDCASE.": ["Case_Stmt"],
    "WHILE a < 5. a = a + 1. ENDWHILE.": ["While_Stmt"],
    "LOOP AT t INTO DATA(w) FROM 2 TO 5 WHERE a = 1. CHECK w-b CS 'x'. ENDLOOP.": ["Loop_Stmt"],
    "LOOP AT t ASSIGNING FIELD-SYMBOL(<f>) GROUP BY ( k = <f>-a n = GROUP SIZE ). LOOP AT GROUP <f> INTO DATA(m). ENDLOOP. ENDLOOP.": ["Loop_Stmt"],
    "LOOP AT SCREEN. MODIFY SCREEN. ENDLOOP.": ["Loop_Stmt"],
    "READ TABLE t WITH TABLE KEY a = 1 b = 'x' TRANSPORTING NO FIELDS.": ["Read_Table_Stmt"],
    "READ TABLE t INDEX 1 USING KEY k ASSIGNING <f>.": ["Read_Table_Stmt"],
    "READ REPORT p INTO t.": ["Read_Report_Stmt"],
    "DELETE t WHERE a = 1. DELETE t INDEX 2. DELETE ADJACENT DUPLICATES FROM t COMPARING a b.": ["Delete_Stmt"] * 3,
    "INSERT w INTO TABLE t. INSERT INTO db VALUES w. INSERT db FROM w. INSERT db FROM TABLE t.": ["Insert_Stmt"] * 4,
    "APPEND w TO t. APPEND INITIAL LINE TO t ASSIGNING <f>. APPEND LINES OF a TO b.": ["Append_Stmt"] * 3,
    "SORT t STABLE BY a DESCENDING b. CLEAR: a, b. CONDENSE a NO-GAPS.": ["Sort_Stmt", "Clear_Stmt", "Condense_Stmt"],
    "CALL FUNCTION 'F' EXPORTING a = 1 IMPORTING b = c EXCEPTIONS e = 1.": ["Call_Function_Stmt"],
    "CALL SCREEN 100. SET PF-STATUS 'X'. LEAVE PROGRAM.": ["Call_Screen_Stmt", "Set_Stmt", "Leave_Program_Stmt"],
    "MESSAGE e001(zz) WITH a b. MESSAGE 'text' TYPE 'I' DISPLAY LIKE 'E'.": ["Message_Stmt"] * 2,
    "AUTHORITY-CHECK OBJECT 'O' ID 'A' FIELD b ID 'C' DUMMY.": ["Authority_Check_Stmt"],
    "x = VALUE #( BASE y ( a = 1 ) FOR z IN t WHERE ( b = 2 ) ( a = z-a ) ).": ["Assign_Stmt"],
    "x = REDUCE i( INIT s = 0 FOR z IN t NEXT s = s + z-a ).": ["Assign_Stmt"],
    "x ?= NEW cl( a = 1 ). o->m( EXPORTING p = 1 ). y = itab[ 1 ]-a.": ["Assign_Stmt", "Expr_Stmt", "Assign_Stmt"],
    "x = |a{ b WIDTH = 5 ALIGN = RIGHT }{ |in{ c }| }d|.": ["Assign_Stmt"],
}


@pytest.mark.parametrize("source", CASES)
def test_construct(source):
    tree, errors = parse(source)
    assert errors == []
    assert [n.kind for _, n in tree.parts] == CASES[source]


def test_ranges_cover_their_text():
    source = "DATA é TYPE i.\nb = 'ü' & c.\n"
    tree, errors = parse(source)
    raw = source.encode()
    assert not errors
    assert [raw[n.start : n.end].decode() for _, n in tree.parts] == ["DATA é TYPE i.", "b = 'ü' & c."]


def test_recovery_keeps_the_other_statements():
    tree, errors = parse("a = 1. this is ( bad. b = 2.")
    assert [n.kind for _, n in tree.parts] == ["Assign_Stmt", "Bad_Decl", "Assign_Stmt"]
    assert len(errors) == 1


def test_endless_input_ends():
    for source in ("IF a = 1.", "CLASS c DEFINITION.", "DELETE ADJACENT DUPLICATES FROM t COMPARING", "x = VALUE #( ( a = ", "DATA: BEGIN OF s,", "SELECT a FROM", "|{"):
        _, errors = parse(source)
        assert errors


def test_precedence():
    q = parse_select("SELECT a FROM t WHERE a = 1 OR b = 2 AND c = 3 INTO TABLE @x")
    assert q.one("where")["op"] == "OR"


@pytest.mark.parametrize(
    "source, kinds",
    [
        ("* comment\nx", ["Comment", "Ident"]),
        ('x " rest', ["Ident", "Comment"]),
        ("##PRAGMA x", ["Comment", "Ident"]),
        ("/NS/NAME", ["Ident"]),
        ("a / b", ["Ident", "Slash", "Ident"]),
        ("a->b => c ?= 1.5 <> <=", ["Ident", "Arrow", "Ident", "StaticArrow", "Ident", "DownCast", "Number", "NotEqual", "LessEqual"]),
        ("|a{ b }c|", ["StringTemplate"]),
    ],
)
def test_tokens(source, kinds):
    assert [t.kind for t in tokenize(source)[0]][:-1] == kinds


def test_lexical_errors():
    assert "not closed" in tokenize("'abc\nx")[1][0][2]
    assert "UTF-8" in tokenize(b"a \xff b")[1][0][2]
    assert "NUL" in tokenize("a\0b")[1][0][2]
