"""Expression trees to Spark columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import registry, templates
from .syntax import Node


class BindError(ValueError):
    """A name or construct that can't be bound, with the byte it stands at."""

    def __init__(self, node: Node, message: str):
        super().__init__(f"{message} at byte {node.start}")
        self.node = node


@dataclass
class Scope:
    """What names mean: fields of the current row, host variables and lambda variables.

    field_of gives (column, type) of a field path or None; variables hold Python values, dicts as structures or Columns.
    """

    field_of: Callable[[list[str]], tuple[Column, str] | None] = lambda path: None
    variables: dict = field(default_factory=dict)
    locals: dict[str, Column] = field(default_factory=dict)
    aggregate: Callable[[Node], Column] | None = None
    target: T.DataType | None = None
    #: Rows of the internal table of a name, if it is one.
    size_of: Callable[[list[str] | None], int | None] = lambda path: None

    def with_local(self, name: str, value: Column) -> "Scope":
        return replace(self, locals=self.locals | {name.lower(): value})


def path_of(node: Node) -> list[str] | None:
    """The names of `a`, `a-b-c` and `t~c`; None for anything else."""
    if node.kind == "Ident":
        return [node["name"].lower()]
    if node.kind == "Selector_Expr" and node["op"] in ("-", "~"):
        left = path_of(node.one("left"))
        return left and [*left, node["name"].lower()]
    return None


def literal(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, dict):
        return F.struct(*(literal(v).alias(k) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return F.array(*map(literal, value))
    return F.lit(value)


def number(text: str):
    return Decimal(text) if "." in text else int(text)


def _find(scope: Scope, path: list[str], host: bool = False):
    """Column of a path: lambda variable, then field, then variable; host variables skip fields."""
    name = path[0]
    if name in scope.locals:
        out = scope.locals[name]
        for p in path[1:]:
            out = out[p]
        return out
    if not host:
        found = scope.field_of(path)
        if found is not None:
            return found[0]
    if name in scope.variables:
        value = scope.variables[name]
        for p in path[1:]:
            value = value[p]
        return literal(value)
    return None


def type_of(node: Node, scope: Scope) -> str:
    path = path_of(node)
    found = path and path[0] not in scope.locals and scope.field_of(path)
    if found:
        return found[1]
    if node.kind == "Basic_Lit":
        return "string" if node["type"] == "string" else "double" if "." in node["value"] else "int"
    if node.kind == "Binary_Expr" and node["op"] in "+-*/":
        return "double"
    if path and path[0] in scope.variables:
        value = scope.variables[path[0]]
        for p in path[1:]:
            value = value.get(p) if isinstance(value, dict) else None
        kinds = ((bool, "boolean"), ((int, float, Decimal), "double"), (list, "array"), ((str, type(None)), "string"))
        return next((kind for of, kind in kinds if isinstance(value, of)), "other")
    return "string"


def initial(column: Column, dtype: str) -> Column:
    """Null, or the default value of the type."""
    kind = dtype.split("(")[0]
    if kind in templates.NUMERIC:
        return column.isNull() | (column == 0)
    if kind == "string":
        return column.isNull() | (column == "")
    if kind.startswith("array"):
        return column.isNull() | (F.size(column) == 0)
    return column.isNull()


def _pattern(text: Column) -> Column:
    """A LIKE pattern from wildcards * and +; # takes the next character as it is."""
    out = F.regexp_replace(text, r"([\\%_])", r"\\$1")
    for mark, plain in (("\x01", "##"), ("\x02", "#*"), ("\x03", "#+")):
        out = F.replace(out, F.lit(plain), F.lit(mark))
    return F.translate(F.replace(out, F.lit("#"), F.lit("")), "*+\x01\x02\x03", "%_#*+")


def compare(op: str, left: Column, right: Column) -> Column:
    if op in ("=", "<>", "<", ">", "<=", ">="):
        return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]
    if op in ("CO", "CN", "CA", "NA"):
        rest = F.call_function("translate", left, right, F.lit(""))
        out = rest == "" if op in ("CO", "CN") else F.length(rest) < F.length(left)
    elif op in ("CS", "NS"):
        out = F.contains(left, right)
    else:
        out = F.call_function("like", left, right if op == "LIKE" else _pattern(right))
    return ~out if op in ("CN", "NA", "NS", "NP") else out


def column(node: Node, scope: Scope) -> Column:
    """The Spark column of an expression."""
    kind = node.kind
    if kind == "Basic_Lit":
        return F.lit(number(node["value"])) if node["type"] == "number" else F.lit(node["value"])
    if kind == "Paren_Expr":
        return column(node.one("inner"), scope)
    path = path_of(node)
    if path is not None:
        found = _find(scope, path)
        if found is None:
            if path[0] in ("abap_true", "abap_false"):
                return F.lit(path[0] == "abap_true")
            raise BindError(node, f"unknown name {'-'.join(path)}")
        return found
    if kind == "Unary_Expr":
        inner = node.one("operand")
        if node["op"] == "@":
            host = path_of(inner)
            found = host and _find(scope, host, host=True)
            if found is None:
                raise BindError(node, f"unknown host variable {host}")
            return found
        value = column(inner, scope)
        return ~value if node["op"] == "NOT" else -value if node["op"] == "-" else value
    if kind == "Binary_Expr":
        return _binary(node, scope)
    if kind == "Between_Expr":
        out = column(node.one("left"), scope).between(column(node.one("low"), scope), column(node.one("high"), scope))
        return ~out if node["negated"] else out
    if kind == "In_Expr":
        out = column(node.one("left"), scope).isin(*(column(x, scope) for x in node.all("item")))
        return ~out if node["negated"] else out
    if kind == "Predicate_Expr":
        return _predicate(node, scope)
    if kind == "String_Template_Expr":
        return _template(node, scope)
    if kind == "Call_Expr":
        if node["aggregate"]:
            if scope.aggregate is None:
                raise BindError(node, "an aggregate is not allowed here")
            return scope.aggregate(node)
        name = path_of(node.one("function"))
        if name == ["lines"] and len(node.all("arg")) == 1 and (size := scope.size_of(path_of(node.all("arg")[0]))) is not None:
            return F.lit(size)
        builder = name and registry.FUNCTIONS.get(name[-1])
        if builder is None:
            raise BindError(node, f"unknown function {name}")
        return builder(*(column(a.one("value") if a.kind == "Named_Arg" else a, scope) for a in node.all("arg")))
    if kind == "Index_Expr":
        table = column(node.one("left"), scope)
        index = node.all("index")
        if any(i.kind == "Named_Arg" for i in index):
            hit = F.filter(table, lambda x: _every([x[i["name"].lower()] == column(i.one("value"), scope) for i in index]))
            return F.try_element_at(hit, F.lit(1))
        return F.try_element_at(table, column(index[0], scope).cast("int"))
    if kind == "Selector_Expr":
        return column(node.one("left"), scope)[node["name"].lower()]
    if kind in ("Constructor_Expr", "New_Expr"):
        return _constructor(node, scope)
    raise BindError(node, f"{kind} has no value")


def _every(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _binary(node: Node, scope: Scope) -> Column:
    op, left, right = node["op"], column(node.one("left"), scope), column(node.one("right"), scope)
    if op == "AND":
        return left & right
    if op == "OR":
        return left | right
    if op == "&":
        return F.concat(left.cast("string"), right.cast("string"))
    if op in "+-*/":
        return {"+": left + right, "-": left - right, "*": left * right, "/": left / right}[op]
    if op == "MOD":
        return left % right
    if op == "DIV":
        return F.call_function("div", left, right)
    return compare(op, left, right)


def _predicate(node: Node, scope: Scope) -> Column:
    what, operand = node["predicate"], node.one("operand")
    value = column(operand, scope)
    if what == "INITIAL":
        out = initial(value, type_of(operand, scope))
    elif what == "NULL":
        out = value.isNull()
    elif what in ("BOUND", "ASSIGNED", "SUPPLIED", "REQUESTED"):
        out = value.isNotNull()
    else:
        raise BindError(node, f"IS {what} has no meaning for data")
    return ~out if node["negated"] else out


def _option(node: Node, scope: Scope) -> str:
    """An option's value: a bare word stands for itself."""
    if node.kind == "Ident" and scope.variables.get(node["name"].lower()) is None:
        return node["name"].upper()
    if node.kind == "Basic_Lit":
        return str(node["value"])
    path = path_of(node)
    value = path and scope.variables.get(path[0])
    if value is None or isinstance(value, Column):
        raise BindError(node, "a formatting option must be a constant")
    return str(value)


def _template(node: Node, scope: Scope) -> Column:
    parts = []
    for part in node.all("part"):
        if part.kind == "Basic_Lit":
            parts.append(F.lit(part["value"]))
            continue
        value = part.one("value")
        options = {k: _option(v, scope) for k, v in part["options"].items()}
        parts.append(templates.rendered(column(value, scope), type_of(value, scope), options))
    return F.concat(*parts) if parts else F.lit("")


def _struct(args: list[Node], scope: Scope) -> Column:
    if args and all(a.kind == "Named_Arg" for a in args):
        return F.struct(*(column(a.one("value"), scope).alias(a["name"].lower()) for a in args))
    if len(args) == 1:
        return column(args[0], scope)
    raise BindError(args[0], "expected named components")


def _loop(node: Node, scope: Scope) -> Column:
    """FOR v IN table WHERE ( … ) ( row ): filter, then transform."""
    table, name = column(node.one("table"), scope), node["name"]
    where, row = node.one("where"), node.one("row")
    if where is not None:
        table = F.filter(table, lambda x: F.coalesce(column(where, _in_row(scope, name, x)), F.lit(False)))
    if row is None:
        inner = node.one("for") or node.one("arg")
        if inner.kind == "For_Expr":
            return F.flatten(F.transform(table, lambda x: _loop(inner, scope.with_local(name, x))))
        return F.transform(table, lambda x: _struct([inner], scope.with_local(name, x)))
    return F.transform(table, lambda x: _struct(row.all("arg"), scope.with_local(name, x)))


def _in_row(scope: Scope, name: str, row: Column) -> Scope:
    """Inside WHERE a bare name is a component of the row."""
    inner = scope.with_local(name, row).with_local("table_line", row)

    def field_of(path: list[str]):
        if path[0] in scope.variables or scope.field_of(path) is not None:
            return scope.field_of(path)
        out = row
        for p in path:
            out = out[p]
        return out, "string"

    return replace(inner, field_of=field_of)


def _constructor(node: Node, scope: Scope) -> Column:
    word = node["word"] or "VALUE"
    if word in ("COND", "SWITCH"):
        on = node.one("on")
        out = None
        for when, then in zip(node.all("when"), node.all("then")):
            test = column(when, scope)
            test = test if on is None else column(on, scope) == test
            out = F.when(test, column(then, scope)) if out is None else out.when(test, column(then, scope))
        return out.otherwise(column(node.one("else"), scope)) if node.one("else") is not None else out
    if word == "REDUCE":
        init, step, where, name = node.one("init"), node.one("next"), node.one("where"), node["name"]
        table = column(node.one("table"), scope)
        if where is not None:
            table = F.filter(table, lambda x: F.coalesce(column(where, _in_row(scope, name, x)), F.lit(False)))
        start = column(init.one("value"), scope)
        start = start.cast("double") if node.one("type")["name"].lower() in ("f", "p", "decfloat34", "decfloat16") else start.cast("bigint") if node.one("type")["name"].lower() in ("i", "int8") else start
        return F.aggregate(table, start, lambda acc, x: column(step.one("value"), scope.with_local(name, x).with_local(init["name"], acc)).cast("double" if node.one("type")["name"].lower() in ("f", "p", "decfloat34", "decfloat16") else "bigint" if node.one("type")["name"].lower() in ("i", "int8") else "string"))
    if word == "FILTER":
        where = node.one("where")
        return F.filter(column(node.one("table"), scope), lambda x: F.coalesce(column(where, _in_row(scope, "table_line", x)), F.lit(False)))
    if word in ("CONV", "EXACT", "CAST", "REF"):
        value = column(node.all("arg")[0], scope)
        dtype = spark_type(node.one("type")["name"])
        return value if dtype is None or word in ("CAST", "REF") else value.cast(dtype) if word == "EXACT" else value.try_cast(dtype)
    pieces = []
    if (base := node.one("base")) is not None:
        pieces.append(column(base, scope))
    rows = [_struct(r.all("arg"), scope) for r in node.all("row")]
    if rows:
        pieces.append(F.array(*rows))
    pieces += [_loop(f, scope) for f in node.all("for")]
    if pieces:
        return F.concat(*pieces) if len(pieces) > 1 else pieces[0]
    return _struct(node.all("arg"), scope)


def spark_type(name: str) -> str | None:
    """The Spark type of an elementary type name."""
    return {
        "i": "int", "int4": "int", "int8": "bigint", "f": "double", "decfloat16": "decimal(16,4)", "decfloat34": "decimal(34,10)", "p": "decimal(15,2)",
        "string": "string", "c": "string", "n": "string", "d": "date", "t": "string", "x": "binary", "xstring": "binary",
    }.get(re.sub(r"\W", "", name.lower()))
