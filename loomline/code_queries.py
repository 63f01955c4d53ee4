"""Registered queries of the code plane: source files are made from whole tables by templates, so SQL knows every part's place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import code
from .sheets import Sheet
from .sources import corpus

QUERIES, ORACLES = {}, {}


def _query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tokens -------------------------------------------------------------------------------------------------

TOKENS = Sheet(
    "part", "p_partkey", "'zp' || p_partkey",
    """[[Comment|* part {p_partkey}: it's DATA no more]]
[[Ident|DATA]] [[Ident|lv_{p_partkey}]] [[Ident|TYPE]] [[Ident|i]] [[Ident|VALUE]] [[Number|{p_size}]][[Period|.]] [[Comment|"tail | 'x']]
[[Ident|lv_s]] [[Equal|=]] [[String|'{p_brand}']][[String|'s . "x']] [[Ampersand|&]][[Ampersand|&]] [[StringTemplate||{p_name} \\| . |]][[Period|.]]
[[Ident|IF]] [[Ident|lv_{p_partkey}]] [[GreaterEqual|>=]] [[Number|3]] [[Ident|AND]] [[Ident|b]] [[NotEqual|<>]] [[Ident|lo]][[Arrow|->]][[Ident|m]][[LParen|(]] [[RParen|)]][[Period|.]]
  [[Ident|cl_{p_size}]][[StaticArrow|=>]][[Ident|go]][[LParen|(]] [[Number|{p_partkey}]] [[Star|*]] [[Number|2]] [[Minus|-]] [[Ident|y]][[Tilde|~]][[Ident|z]] [[RParen|)]][[Period|.]]
[[Ident|ENDIF]][[Period|.]]
""",
)


@_query("code_tokens", TOKENS.rows())
def _tokens(spark, sf_dir):
    return code.tokens(TOKENS.files(_table(spark, sf_dir, "part")))


# Nodes and symbols --------------------------------------------------------------------------------------

CODE = Sheet(
    "customer", "c_custkey", "'zc' || c_custkey",
    """[[File|[[Report_Decl|REPORT z{c_custkey}.]]
[[Data_Typed_Decl-a|DATA gv_a TYPE [[Ident|i]].]]
[[Const_Decl|CONSTANTS gc_b TYPE [[Ident|i]] VALUE [[Basic_Lit|{c_custkey}]].]]
TYPES: BEGIN OF [[Types_Struct_Decl|ty_line, [[Types_Decl|key TYPE [[Ident|i]]]], END OF ty_line]].
[[Form_Decl|FORM run_{c_nationkey} USING [[Form_Param|p_in TYPE [[Ident|i]]]].
  [[Data_Typed_Decl-x|DATA lv_{c_custkey} TYPE [[Ident|string]].]]
  [[Assign_Stmt|[[Ident|lv_{c_custkey}]] = [[Ident-use|p_in]].]]
  [[If_Stmt|IF [[Binary_Expr|[[Ident|gv_a]] = [[Basic_Lit|{c_custkey}]]]].
    [[Clear_Stmt|CLEAR [[Ident|gv_a]].]]
  ENDIF.]]
ENDFORM.]]
[[Class_Def_Decl|CLASS zcl DEFINITION.
  [[Class_Section|PUBLIC SECTION.
    CLASS-METHODS [[Method_Decl|make]].
    [[Attr_Decl|DATA attr TYPE [[Ident|i]].]]]]
ENDCLASS.]]
[[Data_Typed_Decl-lo|DATA lo TYPE [[Ref_Type|REF TO [[Ident|zcl]]]].]]
[[Data_Typed_Decl-gs|DATA gs TYPE [[Ident|ty_line]].]]
]]""",
)


def _code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table = _table(spark, sf_dir, "customer")
    return table, CODE.files(table)


@_query("code_nodes", "SELECT file_id, node_id, split_part(kind, '-', 1) AS kind, start, \"end\" FROM (" + CODE.rows({"file_id": "file_id", "node_id": "ord", "kind": "kind", "start": "start", "end": "end"}) + ")")
def _nodes(spark, sf_dir):
    return code.nodes(_code(spark, sf_dir)[1]).select("file_id", "node_id", "kind", "start", "end")


def _symbol(name: str, kind: str, type_: str, scope: int, mark: str) -> dict[str, str]:
    return {"name": name, "kind": f"'{kind}'", "type": f"'{type_}'", "scope_id": f"CAST({scope} AS INTEGER)", "start": f"start:{mark}", "end": f"end:{mark}"}


SYMBOLS = CODE.each(
    _symbol("'z' || c_custkey", "report", "Unknown", 0, "Report_Decl"), _symbol("'gv_a'", "variable", "Integer", 0, "Data_Typed_Decl-a"), _symbol("'gc_b'", "constant", "Integer", 0, "Const_Decl"),
    _symbol("'ty_line'", "struct_type", "Structure", 0, "Types_Struct_Decl"), _symbol("'key'", "field", "Integer", 1, "Types_Decl"), _symbol("'run_' || c_nationkey", "form", "Unknown", 0, "Form_Decl"),
    _symbol("'p_in'", "parameter", "Integer", 2, "Form_Param"), _symbol("'lv_' || c_custkey", "variable", "String", 2, "Data_Typed_Decl-x"), _symbol("'zcl'", "class", "Class", 0, "Class_Def_Decl"),
    _symbol("'make'", "method", "Unknown", 3, "Method_Decl"), _symbol("'attr'", "field", "Integer", 3, "Attr_Decl"), _symbol("'lo'", "variable", "Reference", 0, "Data_Typed_Decl-lo"),
    _symbol("'gs'", "variable", "Named", 0, "Data_Typed_Decl-gs"),
)


@_query("code_symbols", SYMBOLS)
def _symbols(spark, sf_dir):
    return code.symbols(_code(spark, sf_dir)[1]).select("file_id", "name", "kind", "type", "scope_id", "start", "end")


@_query("ide_node_at", CODE.each({"kind": "'Ident'", "name": "'p_in'", "start": "start:Ident-use", "end": "end:Ident-use"}))
def _node_at(spark, sf_dir):
    table, files = _code(spark, sf_dir)
    return code.node_at(code.nodes(files), CODE.asked(table, "Ident-use")).select("file_id", "kind", "name", "start", "end")


@_query("ide_enclosing", CODE.each({"depth": "CAST(1 AS INTEGER)", "kind": "'Form_Decl'", "name": "'run_' || c_nationkey", "start": "start:Form_Decl", "end": "end:Form_Decl"}))
def _enclosing(spark, sf_dir):
    table, files = _code(spark, sf_dir)
    return code.enclosing(code.nodes(files), CODE.asked(table, "Ident-use")).drop("offset")


@_query("ide_hover", CODE.each({"name": "'p_in'", "hover": "'(parameter) p_in TYPE i'"}, {"name": "'lv_' || c_custkey", "hover": "'(variable) lv_' || c_custkey || ' TYPE string'"}, {"name": "'gv_a'", "hover": "'(variable) gv_a TYPE i'"}, {"name": "'run_' || c_nationkey", "hover": "'FORM run_' || c_nationkey || ' using p_in type i'"}))
def _hover(spark, sf_dir):
    table, files = _code(spark, sf_dir)
    names = ("'P_IN'", "concat('lv_', c_custkey)", "'gv_a'", "concat('Run_', c_nationkey)", "'attr'")  # the last means nothing in a form
    asked = [CODE.asked(table, "Ident-use", name=n) for n in names]
    every = asked[0]
    for a in asked[1:]:
        every = every.unionByName(a)
    return code.hover_text(code.lookup(code.symbols_once(files), every)).select("file_id", "name", "hover")


def _item(label: str, item: str, detail: str) -> dict[str, str]:
    return {"label": label, "item": f"'{item}'", "detail": f"'{detail}'"}


@_query("ide_completion", CODE.each(_item("'gv_a'", "Variable", "i"), _item("'gc_b'", "Constant", "i"), _item("'gs'", "Variable", "ty_line"), *(_item(f"'{k}'", "Keyword", "") for k in ("GROUP BY", "GT", "GE")), _item("'lv_' || c_custkey", "Variable", "string"), *(_item(f"'{k}'", "Keyword", "") for k in ("LOOP", "LIKE", "LT", "LE", "LEAVE PROGRAM")), _item("'lo'", "Variable", "ref to zcl"), _item("'run_' || c_nationkey", "Function", "FORM"), *(_item(f"'{k}'", "Keyword", "") for k in ("RAISE", "RAISING", "RETURN", "RETURNING", "REF TO", "READ TABLE", "READ-ONLY", "REFRESH", "REPORT", "REDEFINITION"))))
def _completion(spark, sf_dir):
    table, files = _code(spark, sf_dir)
    every = None
    for mark, prefix in (("Ident-use", "'G'"), ("If_Stmt", "'l'"), ("Clear_Stmt", "'r'")):
        asked = CODE.asked(table, mark, prefix=prefix)
        every = asked if every is None else every.unionByName(asked)
    return code.completion(code.symbols_once(files), every).drop("offset")


@_query("ide_members", CODE.each(*({"name": f"'{n}'", "access": f"'{a}'", "label": f"'{m}'", "item": f"'{i}'"} for n, a, m, i in (("zcl", "=>", "make", "Method"), ("lo", "->", "make", "Method"), ("lo", "->", "attr", "Field"), ("gs", "-", "key", "Field")))))
def _members(spark, sf_dir):
    table, files = _code(spark, sf_dir)
    asked = table.select(F.col("c_custkey").cast("long").alias("file_id"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("access")) for n, a in (("ZCL", "=>"), ("lo", "->"), ("gs", "-"), ("gv_a", "-"))))).alias("x"))
    return code.members(code.symbols_once(files), asked.select("file_id", "x.*"))


# Duplicates ---------------------------------------------------------------------------------------------

TWICE = Sheet("orders", "o_orderkey", "'zo' || o_orderkey", "DATA gv TYPE i. DATA gv TYPE p.\nTYPES [[first|t_{o_custkey % 3} TYPE i]].\n[[second|TYPES t_0 TYPE string.]]\nFORM f.\n  DATA lv_{o_custkey % 2} TYPE i.\n  [[third|DATA LV_1 TYPE i.]]\nENDFORM.\n")


@_query("code_dup_symbols", f"""SELECT CAST(o_orderkey AS BIGINT) AS file_id, 'gv' AS name, CAST(16 AS INTEGER) AS start FROM orders
UNION ALL SELECT o_orderkey, 't_0', CAST({TWICE.start('second')} AS INTEGER) FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT o_orderkey, 'lv_1', CAST({TWICE.start('third')} AS INTEGER) FROM orders WHERE o_custkey % 2 = 1""")
def _twice(spark, sf_dir):
    return code.duplicate_symbols(code.symbols(TWICE.files(_table(spark, sf_dir, "orders")))).select("file_id", "name", "start")


@_query("code_dup_diagnostics", f"""SELECT CAST(o_orderkey AS BIGINT) AS file_id, CAST({TWICE.start('second')} AS INTEGER) AS start, 'Duplicate symbol ''t_0''' AS message FROM orders WHERE o_custkey % 3 = 0
UNION ALL SELECT o_orderkey, CAST({TWICE.start('third')} AS INTEGER), 'Duplicate symbol ''lv_1''' FROM orders WHERE o_custkey % 2 = 1""")
def _twice_diagnostics(spark, sf_dir):
    return code.diagnostics(TWICE.files(_table(spark, sf_dir, "orders"))).select("file_id", "start", "message")


@_query("code_merge_symbols", "WITH t AS (SELECT CAST(o_orderkey AS BIGINT) AS file_id, 'm_' || (o_orderkey % 5) AS name FROM orders) SELECT * FROM t UNION ALL SELECT CAST(2 * o_orderkey AS BIGINT), 'm_' || (o_orderkey % 7) FROM orders WHERE 'm_' || (o_orderkey % 7) NOT IN (SELECT name FROM t)")
def _merged(spark, sf_dir):
    key = F.col("o_orderkey").cast("long")
    target, source = (_table(spark, sf_dir, "orders").select((key * k).alias("file_id"), F.concat(F.lit("m_"), (key % n).cast("string")).alias("name")) for k, n in ((1, 5), (2, 7)))
    return code.merge_symbols(target, source)



# Includes -----------------------------------------------------------------------------------------------

ROOT = Sheet("customer", "1000000 + c_custkey", "concat('zc', c_custkey)", "DATA gv_first TYPE i.\nINCLUDE zn{c_nationkey}.\n[[there|DATA(gv_late) = gv_first.]]\n[[use|cl_n]]=>go( ).\n[[gone|INCLUDE zmissing{c_custkey % 40}.]]\n")
MIDDLE = Sheet("nation", "2000 + n_nationkey", "concat('zn', n_nationkey)", "INCLUDE zr{n_regionkey}.\n{CASE WHEN n_nationkey % 2 = 0 THEN 'CLASS cl_n DEFINITION. ENDCLASS.' ELSE 'DATA cl_n TYPE i.' END}\nINCLUDE ZN{n_nationkey}.\n")
LEAF = Sheet("region", "100 + r_regionkey", "concat('ZR', r_regionkey)", "CONSTANTS gc_{r_regionkey} TYPE i VALUE 1.\n")


def _project(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [s.files(_table(spark, sf_dir, s.table)) for s in (ROOT, MIDDLE, LEAF)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_DEEP = "customer JOIN nation ON c_nationkey = n_nationkey"
_CL = "CASE WHEN n_nationkey % 2 = 0 THEN 'class' ELSE 'variable' END"


@_query("code_project_symbols", f"""SELECT CAST(1000000 + c_custkey AS BIGINT) AS root_id, CAST(1000000 + c_custkey AS BIGINT) AS file_id, unnest(['gv_first', 'gv_late']) AS name, 'variable' AS kind FROM customer
UNION ALL SELECT 1000000 + c_custkey, 2000 + n_nationkey, 'cl_n', {_CL} FROM {_DEEP} UNION ALL SELECT 1000000 + c_custkey, 100 + n_regionkey, 'gc_' || n_regionkey, 'constant' FROM {_DEEP}
UNION ALL SELECT 2000 + n_nationkey, 2000 + n_nationkey, 'cl_n', {_CL} FROM nation UNION ALL SELECT 2000 + n_nationkey, 100 + n_regionkey, 'gc_' || n_regionkey, 'constant' FROM nation UNION ALL SELECT 100 + r_regionkey, 100 + r_regionkey, 'gc_' || r_regionkey, 'constant' FROM region""")
def _project_symbols(spark, sf_dir):
    return code.project_symbols(_project(spark, sf_dir)).select("root_id", "file_id", "name", "kind")


@_query("code_include_visible", f"""SELECT CAST(1000000 + c_custkey AS BIGINT) AS root_id, 'gv_first' AS name, CAST(1000000 + c_custkey AS BIGINT) AS file_id, 'variable' AS kind FROM customer
UNION ALL SELECT 1000000 + c_custkey, 'cl_n', 2000 + n_nationkey, {_CL} FROM {_DEEP} UNION ALL SELECT 1000000 + c_custkey, 'gc_' || n_regionkey, 100 + n_regionkey, 'constant' FROM {_DEEP}""")
def _visible(spark, sf_dir):
    asked = ROOT.asked(_table(spark, sf_dir, "customer"), "there").select(F.col("file_id").alias("root_id"), F.array("offset").alias("place"))
    return code.visible(_project(spark, sf_dir), asked).select("root_id", "name", "file_id", "kind")


@_query("code_static_access", f"SELECT CAST(1000000 + c_custkey AS BIGINT) AS file_id, CAST({ROOT.start('use')} AS INTEGER) AS start, CAST({ROOT.end('use')} AS INTEGER) AS \"end\" FROM customer WHERE c_nationkey % 2 = 1")
def _static(spark, sf_dir):
    found = code.project_diagnostics(_project(spark, sf_dir))
    return found.where("phase = 'project' and contains(message, '=>')").select("file_id", "start", "end")


@_query("code_missing_includes", f"SELECT CAST(1000000 + c_custkey AS BIGINT) AS file_id, CAST({ROOT.start('gone')} AS INTEGER) AS start, CAST({ROOT.end('gone')} AS INTEGER) AS \"end\", 'include ''zmissing' || (c_custkey % 40) || ''' not found' AS message FROM customer")
def _missing(spark, sf_dir):
    return code.missing_includes(_project(spark, sf_dir)).drop("phase")


# A ladder of diamonds for each nation: RUNGS files, each including two that include the next, so paths double from rung to rung.
RUNGS = 12
_TOP = Sheet("nation", "10000 * n_nationkey", "concat('zt', n_nationkey)", "DATA top_{n_nationkey} TYPE i.\nINCLUDE zl{n_nationkey}_0.\n[[end|DATA after TYPE i.]]\n")
_RUNG = [
    [
        Sheet("nation", f"10000 * n_nationkey + {10 * k + 1}", f"concat('zl', n_nationkey, '_{k}')", f"INCLUDE za{{n_nationkey}}_{k}.\nINCLUDE zb{{n_nationkey}}_{k}.\nDATA l{k} TYPE i.\n" if k < RUNGS else "CONSTANTS deep TYPE i VALUE 1.\n"),
        *(Sheet("nation", f"10000 * n_nationkey + {10 * k + 2 + i}", f"concat('z{c}', n_nationkey, '_{k}')", f"DATA {c}{k} TYPE i.\nINCLUDE zl{{n_nationkey}}_{k + 1}.\nDATA both{k} TYPE i.\n") for i, c in enumerate("ab") if k < RUNGS),
    ]
    for k in range(RUNGS + 1)
]


def _ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "nation")
    out = _TOP.files(table)
    for sheet in (s for rung in _RUNG for s in rung):
        out = out.unionByName(sheet.files(table))
    return out


def _first_of(top: str) -> str:
    """SQL of the first declarers that each ladder's top file sees."""
    rows = [("concat('top_', n_nationkey)", "0"), ("'after'", "0"), ("'deep'", f"{10 * RUNGS + 1}")]
    rows += [(f"'{c}{k}'", f"{10 * k + at}") for k in range(RUNGS) for c, at in (("l", 1), ("a", 2), ("b", 3), ("both", 2))]
    kind = lambda n: "constant" if n == "'deep'" else "variable"
    return " UNION ALL ".join(f"SELECT CAST({top} AS BIGINT) AS file_id, {n} AS name, CAST(10000 * n_nationkey + {at} AS BIGINT) AS declared_in, '{kind(n)}' AS kind FROM nation" for n, at in rows)


@_query("code_include_diamonds", _first_of("10000 * n_nationkey"))
def _diamonds(spark, sf_dir):
    tops = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 10000).cast("long").alias("file_id"))
    return code.first_declarers(_ladders(spark, sf_dir)).join(tops, "file_id", "left_semi").select("file_id", "name", "declared_in", "kind")


# Long files of which every line is asked. Only the first line has a field, so all places are fixed numbers and one length.
_LINES = 1200
LONG = Sheet("nation", "n_nationkey", "concat('zlong', n_nationkey)", "REPORT z{n_nationkey}.\n" + "".join(f"DATA lv_{k} TYPE [[Ident-{k}|i]].\n" if k % 4 else f"FORM f_{k}.\n  CLEAR [[Ident-{k}|lv_{k + 1}]].\nENDFORM.\n" for k in range(_LINES)))
_SHIFT = "length(CAST(n_nationkey AS STRING))"
_AT = [tuple(int(s.strip("()").split(" + ")[0]) for s in (LONG.start(f"Ident-{k}"), LONG.end(f"Ident-{k}"))) for k in range(_LINES)]
_VALUES = ", ".join(f"('{'i' if k % 4 else f'lv_{k + 1}'}', {a}, {b})" for k, (a, b) in enumerate(_AT))


@_query("ide_node_at_many", f"SELECT CAST(n_nationkey AS BIGINT) AS file_id, 'Ident' AS kind, v.name, CAST(v.a + {_SHIFT} AS INTEGER) AS start, CAST(v.b + {_SHIFT} AS INTEGER) AS \"end\" FROM nation, (VALUES {_VALUES}) v(name, a, b)")
def _node_at_many(spark, sf_dir):
    table = _table(spark, sf_dir, "nation")
    places = table.select(F.col("n_nationkey").cast("long").alias("file_id"), F.expr(_SHIFT).alias("shift"), F.explode(F.lit([a for a, _ in _AT])).alias("at"))
    return code.node_at(code.nodes(LONG.files(table)), places.select("file_id", (F.col("at") + F.col("shift")).cast("int").alias("offset"))).select("file_id", "kind", "name", "start", "end")


# Editor tokens ------------------------------------------------------------------------------------------

COLOURED = Sheet("supplier", "s_suppkey", "concat('zs', s_suppkey)", "* supplier\n[[k|CONSTANTS]] gc_{s_nationkey} TYPE i VALUE {s_suppkey}.\nDATA gv TYPE string.\n  gv = 'x' && gc_{s_nationkey}.\n")
_GC, _KEY = "length(CAST(s_nationkey AS VARCHAR)) + 3", "length(CAST(s_suppkey AS VARCHAR))"


def _colours() -> str:
    """SQL of the tokens line by line: column and length may depend on the row."""
    lines = (
        (("0", "10", "comment", 0),),
        (("0", "9", "keyword", 0), ("10", _GC, "variable", 5), (f"11 + {_GC}", "4", "keyword", 0), (f"18 + {_GC}", "5", "keyword", 0), (f"24 + {_GC}", _KEY, "number", 0)),
        (("0", "4", "keyword", 0), ("5", "2", "variable", 1), ("8", "4", "keyword", 0)),
        (("2", "2", "variable", 0), ("7", "3", "string", 0), ("14", _GC, "variable", 4)),
    )
    out = []
    for i, tokens in enumerate(lines):
        for k, (column, length, kind, bits) in enumerate(tokens):
            line = 0 if k else 1 if i else 0
            delta = f"({column}) - ({tokens[k - 1][0]})" if k else column
            out.append(f"SELECT CAST(s_suppkey AS BIGINT) AS file_id, CAST({line} AS INTEGER) AS delta_line, CAST({delta} AS INTEGER) AS delta_column, CAST({length} AS INTEGER) AS length, CAST({code.LEGEND.index(kind)} AS INTEGER) AS number, CAST({bits} AS INTEGER) AS modifiers FROM supplier")
    return " UNION ALL ".join(out)


@_query("ide_semantic_tokens", _colours())
def _semantic(spark, sf_dir):
    return code.semantic_tokens(COLOURED.files(_table(spark, sf_dir, "supplier"))).select("file_id", "delta_line", "delta_column", "length", "number", "modifiers")


# Index --------------------------------------------------------------------------------------------------

_PLACE = (
    "concat('/x/Package/%2FNS%2FP', p_size, '/Source Code Library/', CASE p_partkey % 4 WHEN 0 THEN concat('Includes/%2FNS%2FI', p_partkey, '.abap') WHEN 1 THEN concat('Programs/R', p_partkey, '/R', p_partkey, '.abap') "
    "WHEN 2 THEN concat('Programs/R', p_partkey, '/Includes/T', p_partkey, '.abap') ELSE concat('Function Groups/G', p_partkey, '/Function Modules/F', p_partkey, '.abap') END)"
)
_OBJECT = "CASE p_partkey % 4 WHEN 0 THEN '/NS/I' WHEN 1 THEN 'R' WHEN 2 THEN 'T' ELSE 'F' END || p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 'include' WHEN 1 THEN 'report' WHEN 2 THEN 'include' ELSE 'function_module' END AS kind"


def _objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return corpus.index(corpus.files_of(_table(spark, sf_dir, "part").select(F.expr(_PLACE).alias("path"), F.lit(b"REPORT x.").alias("content"))))


@_query("code_index", f"SELECT {_OBJECT} FROM part UNION ALL SELECT DISTINCT '/NS/P' || p_size, 'package' FROM part")
def _index(spark, sf_dir):
    return _objects(spark, sf_dir)[0].select("name", "kind")


@_query("code_index_edges", f"SELECT name, '/NS/P' || p_size AS parent FROM (SELECT p_size, {_OBJECT}, p_partkey FROM part) WHERE p_partkey % 4 < 2")
def _index_edges(spark, sf_dir):
    objects, edges, _ = _objects(spark, sf_dir)
    named = objects.select("id", "name")
    return edges.join(named.withColumnRenamed("id", "child_id"), "child_id").join(named.select(F.col("id").alias("parent_id"), F.col("name").alias("parent")), "parent_id").select("name", "parent")


@_query("code_index_errors", "SELECT 'R' || c_nationkey AS name, count(*) || ' root files' AS message FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def _index_errors(spark, sf_dir):
    path = F.expr("concat('/x/Package/P/Source Code Library/Programs/R', c_nationkey, '/', 'A', c_custkey, '.abap')")
    errors = corpus.index(corpus.files_of(_table(spark, sf_dir, "customer").select(path.alias("path"), F.lit(b"REPORT x.").alias("content"))))[2]
    return errors.select("name", "message")


# Scopes and chains ---------------------------------------------------------------------------------------

#: Marks are named `type-modifiers-number`: what the token at the mark has to be.
SHADOWED = Sheet(
    "customer", "c_custkey", "concat('zx', c_custkey)",
    """CONSTANTS [[variable-5-1|x]] TYPE i VALUE {c_custkey}.
DATA [[variable-1-2|gv_{c_nationkey}]] TYPE i.
CLASS [[class-1-3|zcl]] DEFINITION.
  PUBLIC SECTION.
    METHODS [[method-1-4|run]] IMPORTING [[parameter-1-5|i_x]] TYPE i.
    DATA [[property-1-6|attr]] TYPE i.
ENDCLASS.
CLASS [[class-0-7|zcl]] IMPLEMENTATION.
  METHOD [[method-0-8|run]].
    DATA [[variable-1-9|gv_{c_nationkey}]] TYPE string.
    [[property-0-10|attr]] = [[parameter-0-11|i_x]] + [[variable-4-12|x]].
  ENDMETHOD.
ENDCLASS.
FORM [[function-1-13|f_{c_custkey}]] USING [[parameter-1-14|p_in]] TYPE i.
  DATA [[variable-1-15|x]] TYPE i.
  [[variable-0-16|x]] = [[parameter-0-17|p_in]] + [[variable-0-18|gv_{c_nationkey}]].
  DATA [[variable-1-19|lo]] TYPE REF TO [[class-0-20|zcl]].
  [[variable-0-21|lo]]->[[method-0-22|run]]( [[variable-0-23|x]] ).
  [[variable-0-24|lo]]->[[property-0-25|attr]] = [[variable-0-26|x]].
ENDFORM.
[[variable-0-27|gv_{c_nationkey}]] = [[variable-4-28|x]].
""",
)


@_query("ide_scope_tokens", " UNION ALL ".join(SHADOWED.each({"start": f"start:{m}", "type": f"'{m.split('-')[0]}'", "modifiers": f"CAST({m.split('-')[1]} AS INTEGER)"}) for m, _, _ in SHADOWED.marks))
def _scope_tokens(spark, sf_dir):
    got = code.semantic_tokens(SHADOWED.files(_table(spark, sf_dir, "customer")))
    return got.where("type not in ('keyword', 'number')").select("file_id", "start", "type", "modifiers")


FAMILY = Sheet(
    "customer", "c_custkey", "concat('zf', c_custkey)",
    """TYPES: BEGIN OF ty_in, key TYPE i, k_{c_nationkey} TYPE string, END OF ty_in.
TYPES: BEGIN OF ty_line, inner TYPE ty_in, BEGIN OF deep, leaf TYPE REF TO zc_a, END OF deep, END OF ty_line.
INTERFACE zif. METHODS told. DATA note TYPE string. ENDINTERFACE.
CLASS zc_a DEFINITION. PUBLIC SECTION. INTERFACES zif. DATA base TYPE ty_line. METHODS make RETURNING VALUE(r) TYPE REF TO zc_c. CLASS-METHODS get RETURNING VALUE(r) TYPE ty_line. PRIVATE SECTION. DATA hidden TYPE i. ENDCLASS.
CLASS zc_b DEFINITION INHERITING FROM zc_a. PUBLIC SECTION. DATA middle TYPE i. DATA base_{c_nationkey} TYPE i. ENDCLASS.
CLASS zc_c DEFINITION INHERITING FROM zc_b. PUBLIC SECTION. DATA middle TYPE ty_in. DATA own TYPE REF TO zc_b. ENDCLASS.
CLASS zc_x DEFINITION INHERITING FROM zc_y. PUBLIC SECTION. DATA round TYPE i. ENDCLASS.
CLASS zc_y DEFINITION INHERITING FROM zc_x. PUBLIC SECTION. DATA trip TYPE i. ENDCLASS.
DATA lo TYPE i.
FORM f.
  DATA lo TYPE REF TO zc_c.
  DATA lx TYPE REF TO zc_x.
  [[here|CLEAR lo.]]
ENDFORM.
""",
)
#: Chains and the labels, items and types that end them; `{n}` is the file's number.
_CHAINS = (
    ("lo->make( )->own->base-inner-k", (("key", "Field", "i"), ("k_{n}", "Field", "string"))),
    ("x = LO->b", (("base", "Field", "ty_line"), ("base_{n}", "Field", "i"))),
    ("lo->middle-key", (("key", "Field", "i"),)),
    ("call( lo->own->make( a = ( 1 ) )->m", (("make", "Method", ""), ("middle", "Field", "ty_in"))),
    ("zc_c=>get( )-deep-leaf->t", (("told", "Method", ""),)),
    ("zc_b=>", (("get", "Method", ""),)),
    ("lx->", (("round", "Field", "i"), ("trip", "Field", "i"))),
    ("lo->hidden", ()), ("nobody->x", ()), ("lo->own->nothing->x", ()),
)


def _number(text: str, function: str) -> str:
    parts = [f"'{p}'" for p in text.split("{n}")]
    return f"{function}({', CAST(c_nationkey AS STRING), '.join(parts)})"


@_query("ide_chain", " UNION ALL ".join(f"SELECT CAST(c_custkey AS BIGINT) AS file_id, '{text}' AS text, {_number(label, 'concat')} AS label, '{item}' AS item, '{kind}' AS type_name FROM customer" for text, ends in _CHAINS for label, item, kind in ends))
def _chain(spark, sf_dir):
    table = _table(spark, sf_dir, "customer")
    asked = FAMILY.asked(table, "here").withColumn("text", F.explode(F.array(*(F.lit(t) for t, _ in _CHAINS))))
    return code.chain_members(code.symbols_once(FAMILY.files(table)), asked).drop("offset")
