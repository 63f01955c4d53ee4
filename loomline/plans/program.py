"""Runs programs of ordered-table statements: each statement becomes DataFrame operations on the tables it names.

Scalars live on the driver as Python values or column expressions; tables are `Itab`s and never leave the cluster. Loop bodies are
translated when every statement in them is one of: assignment to a component of the loop's field symbol, APPEND or INSERT of an
expression, CHECK, IF around these, adding up a scalar, taking a scalar from the row (the last row counts), or LOOP AT GROUP over the groups of the loop
around it. A body that reads what it has assigned to a scalar, leaves the loop, deletes its row or appends more than once is compiled to a scan (`running`). Any
other body raises an error that names its place. Declarations of procedures and classes are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.itab import DEFAULTS, IDX, Itab, numbered
from .expressions import BindError, Scope, column, initial, path_of, spark_type
from .running import Running
from .select import Binder, Catalog
from .syntax import Node, parse


#: Tables that exist while a loop runs, and what stands before a group's components in rows of its members.
SELECTED, GROUPS, MEMBERS, GROUP = "__selected", "__groups", "__members", "__g_"


def schema_of(node: Node, types: dict[str, T.DataType | tuple]) -> tuple[T.DataType, dict]:
    """Spark type of a type expression, and what is known of it as a table (kind, keys, unique)."""
    if node.kind == "Table_Type":
        line, _ = schema_of(node.one("element"), types) if node.one("element") else (T.StringType(), {})
        return T.ArrayType(line), {"kind": node["table_kind"], "keys": [k.lower() for k in node["keys"] if k.lower() != "table_line"], "unique": node["unique"]}
    if node.kind == "Line_Type":
        got = types.get(path_of(node.one("table"))[-1])
        return (got[0].elementType if got else T.StringType()), {}
    if node.kind == "Ref_Type":
        return T.LongType(), {}
    path = path_of(node)
    if path and path[-1] in types:
        return types[path[-1]]
    name = spark_type(path[-1]) if path else None
    if name is None:
        raise BindError(node, f"unknown type {path}")
    return T._parse_datatype_string(name), {}


def struct_of(node: Node, types: dict) -> T.StructType:
    """A structure's Spark schema, nested structures included."""
    out = T.StructType()
    for part in node.all("component"):
        if part.all("component"):
            out.add(part["name"].lower(), struct_of(part, types))
            continue
        kind = schema_of(part.one("type"), types)[0] if part.one("type") else T.StringType()
        if isinstance(kind, T.DecimalType) and part["length"]:
            kind = T.DecimalType(min(38, 2 * int(part["length"]) - 1), int(part["decimals"] or 0))
        out.add(part["name"].lower(), kind, metadata={"length": int(part["length"])} if part["length"] else {})
    return out


@dataclass
class Program:
    """State of a run: variables by lower-cased name, declared types and the catalog."""

    spark: SparkSession
    catalog: Catalog
    variables: dict = field(default_factory=dict)
    types: dict = field(default_factory=dict)
    written: dict[str, DataFrame] = field(default_factory=dict)
    #: Field symbols outside loops: the table's name, the row's position and the table as it was then.
    bound: dict[str, tuple[str, int, Itab]] = field(default_factory=dict)
    #: Inside LOOP AT GROUP, the name of the group; its components are columns whose names begin with GROUP.
    group: str = ""

    def run(self, text: str) -> "Program":
        tree, errors = parse(text)
        if errors:
            raise ValueError(f"{errors[0][2]} at byte {errors[0][0]}")
        for _, node in tree.parts:
            self.step(node)
        return self

    def table(self, node: Node) -> Itab:
        path = path_of(node)
        got = path and self.variables.get(path[0])
        if not isinstance(got, Itab):
            raise BindError(node, f"{path} is no internal table")
        return got

    def scope(self, df: DataFrame | None = None, alias: str | None = None) -> Scope:
        """Names for a row of df: its components, the row itself under alias, and the variables."""
        kinds = {c.lower(): (c, t) for c, t in df.dtypes} if df is not None else {}
        plain = [c for c in kinds if c != IDX]

        def field_of(path: list[str]):
            if alias is not None and path[0] == alias:
                path = path[1:]
                if not path and plain == ["table_line"]:
                    return F.col("table_line"), kinds["table_line"][1]
                if not path:
                    return F.struct(*(c for c in plain if not c.startswith(GROUP))), "struct"
            elif self.group and path[0] == self.group:
                path = [GROUP + (path[1:] or ["table_line"])[0]]
            elif path == ["sy", "tabix"] and df is not None:
                path = [IDX]
            elif alias is not None and path[0] in self.variables:
                return None
            if path[0] == "table_line" and len(plain) == 1:
                path = [plain[0]]
            if path[0] not in kinds:
                return None
            name, kind = kinds[path[0]]
            return F.col(".".join(f"`{x}`" for x in (name, *path[1:]))), kind

        return Scope(field_of, {k: v for k, v in self.variables.items() if not isinstance(v, (Itab, DataFrame))}, size_of=self.size)

    def size(self, path: list[str] | None) -> int | None:
        """Rows of an internal table, else None."""
        table = self.variables.get(path[0]) if path and len(path) == 1 else None
        return table._size() if isinstance(table, Itab) else None

    def folded(self, node: Node) -> tuple | None:
        """(value,) of an expression of whole numbers, texts and truth values that needs no table and no rule of Spark's, else None."""
        if node.kind == "Paren_Expr":
            return self.folded(node.one("inner"))
        if node.kind == "Basic_Lit":
            return (int(node["value"]),) if node["type"] == "number" and "." not in node["value"] else (node["value"],) if node["type"] == "string" else None
        path = path_of(node)
        if path:
            value = self.variables.get(path[0])
            for p in path[1:]:
                value = value.get(p) if isinstance(value, dict) else None
            return (value,) if isinstance(value, (bool, int, str)) else None
        if node.kind == "Unary_Expr" and node["op"] in ("NOT", "-"):
            inner = self.folded(node.one("operand"))
            return inner and ((not inner[0],) if node["op"] == "NOT" and isinstance(inner[0], bool) else (-inner[0],) if node["op"] == "-" and type(inner[0]) is int else None)
        if node.kind != "Binary_Expr":
            return None
        left, right = self.folded(node.one("left")), self.folded(node.one("right"))
        if left is None or right is None or type(left[0]) is not type(right[0]):
            return None
        (a,), (b,), op = left, right, node["op"]
        if isinstance(a, bool):
            return {"AND": (a and b,), "OR": (a or b,)}.get(op)
        out = {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}.get(op)
        if out is not None:
            return (out,)
        if isinstance(a, int):
            out = {"+": a + b, "-": a - b, "*": a * b}.get(op)
            return (out,) if out is not None and abs(out) < 1 << 31 else None
        return (a + b,) if op == "&" else None

    def value(self, node: Node):
        """A scalar or structure: evaluated by Spark on one row, unless it is a literal."""
        if node.kind == "Basic_Lit":
            return int(node["value"]) if node["type"] == "number" and "." not in node["value"] else node["value"]
        path = path_of(node)
        if path and len(path) == 1 and path[0] in self.variables:
            return self.variables[path[0]]
        if (known := self.folded(node)) is not None:
            return known[0]
        got = self.spark.range(1).select(column(node, self.scope()).alias("v")).first().v
        return got.asDict(True) if isinstance(got, T.Row) else got

    # Statements
    def step(self, node: Node) -> None:
        rule = getattr(self, "_" + node.kind.lower(), None)
        if rule is None:
            raise BindError(node, f"{node.kind} can't run here")
        rule(node)

    def _report_decl(self, node: Node) -> None:
        pass

    #: Procedures and classes that nothing calls don't do anything.
    _form_decl = _module_decl = _class_def_decl = _class_impl_decl = _interface_decl = _event_block = _report_decl

    def _field_symbol_decl(self, node: Node) -> None:
        pass

    def _types_decl(self, node: Node) -> None:
        self.types[node["name"].lower()] = schema_of(node.one("type"), self.types)

    def _types_struct_decl(self, node: Node) -> None:
        self.types[node["name"].lower()] = (struct_of(node, self.types), {})

    def _data_typed_decl(self, node: Node) -> None:
        name = node["name"].lower()
        kind, how = schema_of(node.one("type"), self.types) if node.one("type") else (T.StringType(), {})
        if isinstance(kind, T.ArrayType):
            line = kind.elementType if isinstance(kind.elementType, T.StructType) else T.StructType().add("table_line", kind.elementType)
            self.variables[name] = Itab.empty(self.spark, line, **how)
        elif node.one("value") is not None:
            self.variables[name] = self.value(node.one("value"))
        elif isinstance(kind, T.StructType):
            self.variables[name] = {f.name: DEFAULTS.get(f.dataType.simpleString()) for f in kind.fields}
        else:
            self.variables[name] = DEFAULTS.get(kind.simpleString())

    _const_decl = _data_typed_decl

    def _data_struct_decl(self, node: Node) -> None:
        schema = struct_of(node, self.types)
        self.types[node["name"].lower()] = (schema, {})
        self.variables[node["name"].lower()] = {f.name: DEFAULTS.get(f.dataType.simpleString()) for f in schema.fields}

    _const_struct_decl = _data_struct_decl

    def _data_inline_decl(self, node: Node) -> None:
        self._put(node["name"], node.one("value"))

    def _assign_stmt(self, node: Node) -> None:
        target = path_of(node.one("target"))
        if node.one("target").kind == "Data_Inline_Decl":
            target = [node.one("target")["name"].lower()]
        if target is None:
            raise BindError(node, "can't assign to this")
        if target[0] in self.bound:
            name, at, table = self.bound[target[0]]
            if self.variables.get(name) is not table:
                raise BindError(node, f"the row of {target[0]} may have moved")
            component = target[1] if len(target) > 1 else table.columns[0]
            changed = table.update(F.col(IDX) == at, **{component: column(node.one("value"), self.scope())})
            self.variables[name], self.bound[target[0]] = changed, (name, at, changed)
        if len(target) > 1:
            self.variables[target[0]] = {**self.variables[target[0]], target[1]: self.value(node.one("value"))}
        else:
            self._put(target[0], node.one("value"))

    def _put(self, name: str, node: Node) -> None:
        name = name.lower()
        path = path_of(node)
        if path and isinstance(self.variables.get(path[0]), (Itab, DataFrame)):
            self.variables[name] = self.variables[path[0]]
            return
        if node.kind == "Constructor_Expr" and node["word"] in ("FILTER", "VALUE") and (self._names_table(node)):
            self.variables[name] = self._comprehension(node, self.variables.get(name))
            return
        if node.kind == "Constructor_Expr" and node["word"] == "REDUCE" and self._names_table(node):
            self.variables[name] = self._reduce(node)
            return
        if node.kind == "Constructor_Expr" and node["word"] == "CORRESPONDING":
            self.variables[name] = self._corresponding(node, self.variables.get(name))
            return
        value = self.value(node)
        old = self.variables.get(name)
        if isinstance(old, Itab) and isinstance(value, list):
            rows = self.spark.createDataFrame([(i + 1, *(tuple(r) if isinstance(r, (tuple, T.Row)) else (r,))) for i, r in enumerate(value)], T.StructType([T.StructField(IDX, T.LongType()), *old.rows.schema.fields]))
            value = replace(old, df=rows.select(*old.columns, IDX))
        self.variables[name] = value

    def _names_table(self, node: Node) -> bool:
        loop = node.one("for") or node
        path = loop.one("table") is not None and path_of(loop.one("table"))
        return bool(path) and isinstance(self.variables.get(path[0]), Itab)

    def _comprehension(self, node: Node, old) -> Itab:
        """VALUE FOR and FILTER over a table: filter and select, positions renumbered."""
        loop = node.one("for") or node
        table, alias = self.table(loop.one("table")), (loop["name"] or "table_line").lower()
        scope = self.scope(table.df, alias)
        df = table.df
        if loop.one("where") is not None:
            df = df.filter(column(loop.one("where"), scope))
        if loop.one("row") is not None:
            args = loop.one("row").all("arg")
            if args and args[0].kind == "Named_Arg":
                df = df.select(*(column(a.one("value"), scope).alias(a["name"].lower()) for a in args), IDX)
        out = Itab(df).renumber()
        return replace(old, df=out.df) if isinstance(old, Itab) and old.columns == out.columns else out

    def _corresponding(self, node: Node, old):
        """CORRESPONDING type( source ): the components of the type by name, initial where the source has none. `#` takes the target's type."""
        args, word = node.all("arg"), (node.one("type")["name"] or "#").lower() if node.one("type") else "#"
        path = path_of(args[0]) if len(args) == 1 else None
        source = self.variables.get(path[0]) if path else None
        if not isinstance(source, (Itab, dict)):
            raise BindError(node, "CORRESPONDING needs one table or structure")
        kind, how = self.types.get(word, (None, {}))
        if kind is None and word != "#":
            raise BindError(node, f"unknown type {word}")
        if isinstance(source, dict):
            into = {f.name: DEFAULTS.get(f.dataType.simpleString()) for f in kind.fields} if isinstance(kind, T.StructType) else old if isinstance(old, dict) else source
            return {n: source.get(n, into[n]) for n in into}
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            line = kind.elementType
        elif kind is None:
            line = (old if isinstance(old, Itab) else source).rows.schema
        else:
            raise BindError(node, "a table needs a table type with components")
        have = {c.lower(): c for c in source.columns}
        into = [(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(DEFAULTS.get(f.dataType.simpleString()))).cast(f.dataType).alias(f.name) for f in line.fields]
        moved = source.df.select(*into, IDX)
        return replace(old, df=moved) if isinstance(old, Itab) else Itab(moved, **how)

    def _reduce(self, node: Node):
        """REDUCE whose step is a monoid of its start and the row: adding and subtracting, nmax and nmin, AND, OR, and & in the order of the rows. Any other step is an error."""
        table, name = self.table(node.one("table")), node["name"].lower()
        step, init = node.one("next"), node.one("init")
        body, own = step.one("value"), [init["name"].lower()]
        scope = self.scope(table.df, name)
        df = table.df if node.one("where") is None else table.df.filter(column(node.one("where"), scope))
        start = self.value(init.one("value"))
        sides = [body.one("left"), body.one("right")] if body.kind == "Binary_Expr" else []
        mine = [path_of(x) == own for x in sides]
        args = [a.one("value") if a.kind == "Named_Arg" else a for a in body.all("arg")] if body.kind == "Call_Expr" else []
        others = [x for x in sides + args if path_of(x) != own]
        if len(others) == len(sides + args) or sides and len(others) != 1 or any(path_of(n) == own for x in others for n in x.walk()):
            raise BindError(node, "this step can't be reduced over a table")
        op = body["op"] if sides else (path_of(body.one("function")) or [""])[0]
        value = column(others[0], scope) if others else F.lit(None)
        if op == "+" or op == "-" and mine[0]:
            got = df.agg(F.sum(value)).first()[0] or 0
            return start + got if op == "+" else start - got
        if op in ("nmax", "nmin") and others:
            pick, most = (F.greatest, F.max) if op == "nmax" else (F.least, F.min)
            got = df.agg(most(pick(*(column(x, scope) for x in others)) if len(others) > 1 else value)).first()[0]
            return start if got is None else (max if op == "nmax" else min)(start, got)
        if op in ("AND", "OR"):
            got = df.agg((F.bool_and if op == "AND" else F.bool_or)(value)).first()[0]
            return start if got is None else (start and got) if op == "AND" else (start or got)
        if op == "&" and mine[0]:  # one value, however long: its parts meet when they are joined
            got = df.agg(F.array_sort(F.collect_list(F.struct(IDX, value.cast("string").alias("v")))).alias("a")).select(F.array_join(F.transform("a", lambda x: x["v"]), "")).first()[0]
            return f"{start}{got or ''}"
        raise BindError(node, "this step can't be reduced over a table")

    def _select_stmt(self, node: Node) -> None:
        frame = Binder(self.catalog, self.variables).frame(node)
        into = node.one("into")
        if into is None:
            raise BindError(node, "SELECT needs INTO here")
        target = into.one("operand") if into.kind == "Unary_Expr" else into
        name = (target["name"] or "").lower()
        primary = self.catalog.keys.get(node.one("from")["name"].lower(), [])
        if node.all("order") and primary and set(primary) <= set(frame.columns):  # the key decides between rows of equal order
            node.attrs["order_pk"] = True
            frame = Binder(self.catalog, self.variables).frame(node)
        ordered = bool(node.all("order") or node["order_pk"])

        def taken(frame: DataFrame, keys: list[str]) -> Itab:
            if not ordered:
                return Itab.of(frame, keys)
            # Ids grow along the order in which the statement has sorted the rows.
            return Itab(numbered(frame.withColumn("__was", F.monotonically_increasing_id()), [F.col("__was").asc()]).drop("__was"))

        if node.all("body"):
            rows = taken(frame if len(frame.columns) > 1 else frame.toDF("table_line"), [k for k in primary if k in frame.columns and len(frame.columns) > 1] or (frame.columns if len(frame.columns) > 1 else ["table_line"]))
            self.variables[SELECTED] = rows
            last = rows.df.orderBy(F.desc(IDX)).drop(IDX).first()
            self._spread(node.all("body"), SELECTED, name, False, F.lit(True))
            del self.variables[SELECTED]
            if last is not None:
                self.variables[name] = last.asDict(True) if len(last) > 1 else last[0]
            self.variables["sy"] = {"subrc": 0 if last is not None else 4}
        elif node["is_table"]:
            keys = [k for k in self.catalog.keys.get(node.one("from")["name"].lower(), []) if k in frame.columns] or frame.columns
            old = self.variables.get(name)
            if (node["into_kind"] or "").startswith("Corresponding") and isinstance(old, Itab):
                have = {c.lower(): c for c in frame.columns}
                frame = frame.select(*((F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.rows.schema.fields))
                keys = [k for k in keys if k in frame.columns] or frame.columns
            got = taken(frame, keys)
            self.variables[name] = old.append(got.df) if node["appending"] and isinstance(old, Itab) else got
        else:
            row = frame.first()
            self.variables[name] = row and (row.asDict(True) if len(row) > 1 else row[0])
            self.variables["sy"] = {"subrc": 0 if row else 4}

    def _read_table_stmt(self, node: Node) -> None:
        table = self.table(node.one("table"))
        if node["kind"] == "index":
            found = table.read_index(int(self.value(node.one("index"))))
        else:
            test = F.lit(True)
            for key in node.all("key"):
                name = key["name"].lower()
                name = table.columns[0] if name == "table_line" else name
                test = test & (F.col(name) == column(key.one("value"), self.scope()))
            found = table.read_key(test)
        row = found.first()
        self.variables["sy"] = {"subrc": 0 if row else 4, "tabix": row[IDX] if row else 0}
        into = node.one("into") or node.one("assigning")
        if into is not None and row is not None:
            values = {k: v for k, v in row.asDict(True).items() if k != IDX}
            name = (into["name"] or path_of(into)[0]).lower()
            self.variables[name] = values
            self.bound.pop(name, None)
            if node.one("assigning") is not None:
                self.bound[name] = (path_of(node.one("table"))[0], row[IDX], table)

    def _delete_stmt(self, node: Node) -> None:
        table = self.table(node.one("table"))
        name = path_of(node.one("table"))[0]
        if node["kind"] == "where":
            out = table.delete_where(column(node.one("where"), self.scope(table.df)))
        elif node["kind"] == "index":
            out = table.delete_index(int(self.value(node.one("index"))))
        elif node["kind"] == "adjacent":
            out = table.delete_adjacent([n["name"].lower() for n in node.all("comparing")] or None)
        else:
            raise BindError(node, "DELETE TABLE … FROM is not supported")
        self.variables[name] = out

    def _row_of(self, node: Node, table: Itab) -> dict:
        value = self.value(node)
        if isinstance(value, dict):
            return value
        return {table.columns[0]: value}

    def _insert_stmt(self, node: Node) -> None:
        kind = node["kind"]
        name = path_of(node.one("table"))[0]
        if kind in ("itab", "lines"):
            table = self.table(node.one("table"))
            source = node.one("source")
            rows = self.table(source).df if kind == "lines" else table._row(self._row_of(source, table))
            self.variables[name] = table.insert(rows)
        elif kind == "index":
            table = self.table(node.one("table"))
            self.variables[name] = table.insert_index(int(self.value(node.one("index"))), **self._row_of(node.one("source"), table))
        else:
            target = self.catalog.table(name)
            if kind == "db_table":
                rows = self.table(node.one("source")).rows
            else:
                rows = Itab(target.withColumn(IDX, F.lit(0)))._row(self._row_of(node.one("source"), Itab(target))).drop(IDX)
            self.written[name] = rows
            self.catalog.tables[name] = target.unionByName(rows.select(*target.columns))

    def _append_stmt(self, node: Node) -> None:
        table = self.table(node.one("table"))
        name = path_of(node.one("table"))[0]
        if node["kind"] == "initial":
            out = table.append_initial()
            if node.one("assigning") is not None:
                symbol = (node.one("assigning")["name"] or path_of(node.one("assigning"))[0]).lower()
                row = out.df.orderBy(F.desc(IDX)).first().asDict(True)
                self.bound[symbol] = (name, row.pop(IDX), out)
                self.variables[symbol] = row
        elif node["kind"] == "lines":
            out = table.append(self.table(node.one("source")).df)
        else:
            out = table.append_row(**self._row_of(node.one("source"), table))
        self.variables[name] = out

    def _sort_stmt(self, node: Node) -> None:
        default = bool(node["descending"])
        by = [(n["name"].lower(), default if n["descending"] is None else n["descending"]) for n in node.all("by")]
        self.variables[path_of(node.one("table"))[0]] = self.table(node.one("table")).sort(by or None, default)

    def _clear_stmt(self, node: Node) -> None:
        for operand in node.all("operand"):
            name = path_of(operand)[0]
            old = self.variables.get(name)
            self.variables[name] = old.clear() if isinstance(old, Itab) else {k: DEFAULTS.get(type(v).__name__, None) for k, v in old.items()} if isinstance(old, dict) else "" if isinstance(old, str) else 0

    def _condense_stmt(self, node: Node) -> None:
        for operand in node.all("operand"):
            name = path_of(operand)[0]
            parts = str(self.variables[name]).split(" ")
            self.variables[name] = ("" if node["no_gaps"] else " ").join(p for p in parts if p)

    def _if_stmt(self, node: Node) -> None:
        branches = [(node.one("condition"), node.all("then")), *((b.one("condition"), b.all("then")) for b in node.all("elseif"))]
        for test, body in branches:
            if self.value(test):
                break
        else:
            body = node.all("else")
        for n in body:
            self.step(n)

    def _case_stmt(self, node: Node) -> None:
        value = self.value(node.one("on"))
        for branch in node.all("branch"):
            if branch["others"] or value in [self.value(v) for v in branch.all("value")]:
                for n in branch.all("body"):
                    self.step(n)
                return

    def _while_stmt(self, node: Node) -> None:
        while self.value(node.one("condition")):
            for n in node.all("body"):
                self.step(n)

    def _call_function_stmt(self, node: Node) -> None:
        from ..functions import registry

        name = str(self.value(node.one("function"))).lower()
        if name not in registry.FUNCTIONS:
            raise BindError(node, f"unknown function {name}")
        for p in node.all("param"):
            if p["section"] not in ("EXPORTING", "IMPORTING"):
                raise BindError(node, f"{p['section'] or 'parameters without a section'} of CALL FUNCTION can't run here")
        args = [column(p.one("value"), self.scope()) for p in node.all("param") if p["section"] == "EXPORTING"]
        got = self.spark.range(1).select(registry.FUNCTIONS[name](*args).alias("v")).first().v
        for p in node.all("param"):
            if p["section"] == "IMPORTING":
                self.variables[path_of(p.one("value"))[0]] = got

    # Loops
    def _loop_stmt(self, node: Node) -> None:
        if node["screen"] or node["group"]:
            raise BindError(node, "this loop has no table result")
        name = path_of(node.one("table"))[0]
        table = self.table(node.one("table"))
        target = node.one("assigning") or node.one("into")
        alias = (target["name"] if target is not None else "").lower()
        assigning = node.one("assigning") is not None or bool(node["reference"])
        bound = lambda n: None if n is None else int(self.value(n))
        visited = F.lit(True)
        for low, test in ((bound(node.one("from")), F.col(IDX).__ge__), (bound(node.one("to")), F.col(IDX).__le__)):
            visited = visited if low is None else visited & test(low)
        if node.one("where") is not None:
            visited = visited & column(node.one("where"), self.scope(table.df))
        visited = F.coalesce(visited, F.lit(False))
        if node.all("key"):
            self._groups(node, table, alias, visited)
        elif node["reference"]:
            Running(self, node.all("body"), name, alias, True, visited).run()
        else:
            self._spread(node.all("body"), name, alias, assigning, visited)

    def _groups(self, node: Node, table: Itab, alias: str, visited: Column) -> None:
        """LOOP AT … GROUP BY: the body runs over the table of groups, in the order of their first rows."""
        scope = self.scope(table.df, alias)
        keys = node.all("key")
        named = {k["name"].lower(): k for k in keys} if keys[0].kind == "Named_Arg" else {"table_line": keys[0]}
        by = {n: column(k if k.kind != "Named_Arg" else k.one("value"), scope) for n, k in named.items() if not k["counts"]}
        rows = Itab(table.df.filter(visited))
        found = rows.groups(**by)
        groups = Itab(numbered(found, [F.col("first").asc()]))
        counts = {n: F.col("size") if k["counts"] == "SIZE" else F.col(IDX) for n, k in named.items() if k["counts"]}
        names = [n["name"] or path_of(n)[0] for n in node.all("into")]
        target = (names[-1] if len(names) > 1 or not alias else "").lower()
        self.variables[GROUPS] = Itab(groups.df.select(*by, *(v.alias(n) for n, v in counts.items()), IDX))
        self.members = (rows, by, target)
        self._spread(node.all("body"), GROUPS, target, False, F.lit(True))
        del self.variables[GROUPS]

    def _spread(self, body: list[Node], name: str, alias: str, assigning: bool, test: Column) -> None:
        """Runs a body over all visited rows at once; if its rounds depend on each other, as a scan."""
        nodes = [x for n in body for x in n.walk()]
        into = [path_of(n.one("table")) for n in nodes if n.kind in ("Append_Stmt", "Insert_Stmt")]
        ordered = any(n.kind in ("Expr_Stmt", "Case_Stmt", "Delete_Stmt") for n in nodes) or any(into.count(t) > 1 for t in into)
        written = {(path_of(n.one("target")) or [""])[0] for n in nodes if n.kind == "Assign_Stmt"} - {alias, ""}
        written |= {n.one("target")["name"].lower() for n in nodes if n.kind == "Assign_Stmt" and n.one("target").kind == "Data_Inline_Decl"}
        for n in nodes:
            if n.kind in ("If_Stmt", "Check_Stmt", "Elseif_Branch"):
                read = [n.one("condition")]
            elif n.kind == "Assign_Stmt":
                read = [n.one("value").one("right") if self._adds(n) else n.one("value")]
            else:
                read = [n.one("source")] if n.kind in ("Append_Stmt", "Insert_Stmt") else []
            for x in (x for r in read if r is not None for x in r.walk()):
                if (path_of(x) or [""])[0] in written:
                    ordered = True
        if ordered:
            if name in (GROUPS, MEMBERS):
                raise BindError(body[0], "this loop body has an order that can't be spread over a cluster")
            Running(self, body, name, alias, assigning, test).run()
            return
        self._body(body, name, alias, assigning, test)

    def _body(self, body: list[Node], name: str, alias: str, assigning: bool, test: Column) -> None:
        for n in body:
            table = self.variables[name]
            scope = self.scope(table.df, alias)
            if n.kind == "Check_Stmt":
                test = test & F.coalesce(column(n.one("condition"), scope), F.lit(False))
            elif n.kind == "If_Stmt":
                seen = F.lit(False)
                for condition, inner in [(n.one("condition"), n.all("then")), *((b.one("condition"), b.all("then")) for b in n.all("elseif"))]:
                    now = F.coalesce(column(condition, scope), F.lit(False))
                    self._body(inner, name, alias, assigning, test & ~seen & now)
                    seen = seen | now
                self._body(n.all("else"), name, alias, assigning, test & ~seen)
            elif n.kind == "Assign_Stmt" and assigning and (path_of(n.one("target")) or [""])[0] == alias:
                self.variables[name] = table.update(test, **{path_of(n.one("target"))[1]: column(n.one("value"), scope)})
            elif n.kind == "Assign_Stmt" and self._adds(n):
                target = path_of(n.one("target"))[0]
                got = table.df.filter(test).agg(F.sum(column(n.one("value").one("right"), scope))).first()[0]
                self.variables[target] = self.variables[target] + (got or 0)
            elif n.kind == "Assign_Stmt" and (n.one("target").kind == "Data_Inline_Decl" or len(path_of(n.one("target")) or []) == 1):
                target = (n.one("target")["name"] or path_of(n.one("target"))[0]).lower()
                last = table.df.filter(test).orderBy(F.desc(IDX)).select(column(n.one("value"), scope).alias("v")).first()
                if last is not None or target not in self.variables:
                    self.variables[target] = last and (last.v.asDict(True) if isinstance(last.v, T.Row) else last.v)
            elif n.kind == "Data_Inline_Decl":
                last = table.df.filter(test).orderBy(F.desc(IDX)).select(column(n.one("value"), scope).alias("v")).first()
                self.variables[n["name"].lower()] = last and (last.v.asDict(True) if isinstance(last.v, T.Row) else last.v)
            elif n.kind == "Loop_Stmt" and n["group"] and name == GROUPS:
                self._members(n, table, test)
            elif n.kind in ("Append_Stmt", "Insert_Stmt") and n["kind"] in ("row", "itab") and path_of(n.one("table"))[0] != name:
                other = self.table(n.one("table"))
                source = n.one("source")
                if path_of(source) == [alias]:
                    rows = table.df.filter(test).select(*(c for c in other.columns if c in table.columns), IDX)
                else:
                    rows = table.df.filter(test).select(column(source, scope).alias("r"), IDX).select("r.*", IDX)
                self.variables[path_of(n.one("table"))[0]] = other.append(numbered(rows.withColumnRenamed(IDX, "__was"), [F.col("__was").asc()]).drop("__was"))
            else:
                raise BindError(n, "this loop body has an order that can't be spread over a cluster")

    def _members(self, node: Node, groups: Itab, test: Column) -> None:
        """LOOP AT GROUP: the members of all visited groups at once, group by group, as rows with their group's components."""
        rows, by, name = self.members
        if path_of(node.one("table")) != [name]:
            raise BindError(node, "no such group")
        visited = groups.df.filter(test)
        mine = visited.select(*(F.col(c).alias(GROUP + c) for c in groups.columns), F.col(IDX).alias("__group"))
        of = rows.df.withColumns({f"__by_{n}": v for n, v in by.items()})
        on = F.lit(True)
        for n in by:
            on = on & of[f"__by_{n}"].eqNullSafe(mine[GROUP + n])
        joined = of.join(mine, on).drop(*(f"__by_{n}" for n in by)).withColumnRenamed(IDX, "__was")
        self.variables[MEMBERS] = Itab(numbered(joined, [F.col("__group").asc(), F.col("__was").asc()]).drop("__group", "__was"))
        target = node.one("into") or node.one("assigning")
        alias = (target["name"] or path_of(target)[0]).lower()
        self.group, was = name, self.group
        try:
            visited = F.lit(True)
            if node.one("where") is not None:
                visited = F.coalesce(column(node.one("where"), self.scope(self.variables[MEMBERS].df, alias)), F.lit(False))
            self._spread(node.all("body"), MEMBERS, alias, False, visited)
        finally:
            self.group = was
            del self.variables[MEMBERS]

    @staticmethod
    def _adds(node: Node) -> bool:
        value = node.one("value")
        return value.kind == "Binary_Expr" and value["op"] == "+" and path_of(value.one("left")) == path_of(node.one("target"))


__all__ = ["Program", "schema_of", "struct_of", "initial"]
