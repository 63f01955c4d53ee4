"""Binds SELECT statements to a catalog and builds their DataFrames; Catalyst plans the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .expressions import BindError, Scope, column, path_of
from .syntax import Node, parse_select

#: Primary keys of the tables that are known by name.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"],
    "embeddings": ["vec_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}


@dataclass
class Catalog:
    """Tables by name: DataFrames, or functions that give them when first asked."""

    spark: SparkSession
    tables: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=lambda: dict(KEYS))

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str) -> "Catalog":
        return cls(spark, {n: (lambda n=n: spark.read.parquet(f"{folder}/{n}.parquet")) for n in KEYS})

    def table(self, name: str) -> DataFrame:
        got = self.tables.get(name.lower())
        if got is None:
            return self.spark.table(name)
        return got if isinstance(got, DataFrame) else got()


@dataclass
class _Source:
    alias: str
    columns: dict[str, tuple[str, str]]  # lower-cased name: name, type


class Binder:
    def __init__(self, catalog: Catalog, variables: dict | None = None):
        self.catalog = catalog
        self.variables = {k.lower(): v for k, v in (variables or {}).items()}
        self.sources: list[_Source] = []

    def _source(self, node: Node) -> DataFrame:
        df = self.catalog.table(node["name"])
        alias = (node["alias"] or node["name"]).lower()
        self.sources.append(_Source(alias, {c.lower(): (c, t) for c, t in df.dtypes}))
        return df.alias(alias)

    def field_of(self, path: list[str]) -> tuple[Column, str] | None:
        if len(path) > 1:
            for s in self.sources:
                if s.alias == path[0] and path[1] in s.columns:
                    name, kind = s.columns[path[1]]
                    return F.col(".".join(f"`{x}`" for x in (s.alias, name, *path[2:]))), kind
        hits = [s for s in self.sources if path[0] in s.columns]
        if len(hits) > 1:
            raise ValueError(f"column {path[0]} is in several tables: {', '.join(s.alias for s in hits)}")
        if not hits:
            return None
        name, kind = hits[0].columns[path[0]]
        return F.col(".".join(f"`{x}`" for x in (hits[0].alias, name, *path[1:]))), kind

    def frame(self, q: Node) -> DataFrame:
        if q.one("from") is None:
            raise BindError(q, "SELECT needs FROM")
        scope = Scope(self.field_of, self.variables)
        df = self._source(q.one("from"))
        for join in q.all("join"):
            right = self._source(join.one("table"))
            if join.one("on") is None:
                raise BindError(join, "a join needs ON")
            df = df.join(right, column(join.one("on"), scope), join["type"])
        where = q.one("where")
        if q.one("entries") is not None:
            df, where = self._entries(df, q, where, scope)
        if where is not None:
            df = df.filter(column(where, scope))

        names, items = [], []
        hidden: dict[str, Column] = {}
        grouped = bool(q.all("group"))
        known: dict[str, Column] = {}

        def aggregate(node: Node) -> Column:
            word, arg = node["aggregate"], node.one("arg")
            if any(n["aggregate"] for n in arg.walk()):
                raise BindError(arg, "an aggregate of an aggregate")
            star = arg.kind == "Basic_Lit" and arg["type"] == "star"
            if star and word != "COUNT":
                raise BindError(node, f"{word}( * ) has no meaning")
            value = F.lit(1) if star else column(arg, Scope(self.field_of, self.variables))
            if node["distinct"]:
                out = {"COUNT": F.count_distinct, "SUM": F.sum_distinct}.get(word, lambda c: F.call_function(word.lower(), c))(value)
            else:
                out = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[word](value)
            key = f"{word}:{node['distinct']}:{'*' if star else str(value)}"
            name = hidden_names.setdefault(key, f"__agg{len(hidden_names)}")
            hidden[name] = out
            return F.col(name)

        hidden_names: dict[str, str] = {}
        inside = Scope(self.field_of, self.variables, aggregate=aggregate)
        for item in q.all("field"):
            if item.kind == "Basic_Lit" and item["type"] == "star":
                for s in self.sources:
                    for c, _ in s.columns.values():
                        names.append(c if sum(c.lower() in x.columns for x in self.sources) == 1 else f"{s.alias}_{c}")
                        items.append(F.col(f"`{s.alias}`.`{c}`"))
                continue
            value = column(item, inside)
            path = path_of(item)
            default = path[-1] if path else f"{item['aggregate'].lower()}_{(path_of(item.one('arg')) or ['all'])[-1]}" if item["aggregate"] else f"col{len(names) + 1}"
            names.append(item["alias"] or (self._case(path) if path else default))
            items.append(value)
        having = column(q.one("having"), inside) if q.one("having") is not None else None
        order = [(o, column(o, inside) if not self._is_output(o, names) else None) for o in q.all("order")]

        if grouped or hidden:
            keys = []
            for g in q.all("group"):
                at = f"__key{len(keys)}"
                keys.append(column(g, scope).alias(at))
                known[str(column(g, scope))] = F.col(at)
            df = df.groupBy(*keys).agg(*(v.alias(k) for k, v in hidden.items())) if hidden else df.select(*keys).distinct()
            fixed = []
            for node, value in zip(q.all("field"), items):
                fixed.append(self._grouped(node, value, known))
            items = fixed
            if having is not None:
                df = df.filter(self._rewrite(q.one("having"), known, aggregate))
            order = [(o, known.get(str(v)) if v is not None and not o["aggregate"] else v) for o, v in order]
        elif having is not None:
            df = df.filter(having)

        out = df.select(*(v.alias(n) for n, v in zip(names, items)), *(v.alias(f"__o{i}") for i, (o, v) in enumerate(order) if v is not None))
        if q["distinct"]:
            out = out.distinct()
        out = self._ordered(out, q, order, names)
        if q["single"]:
            out = out.limit(1)
        if q.one("limit") is not None:
            out = out.limit(self._count(q.one("limit")))
        return out.select(*(F.col(f"`{n}`") for n in names))

    def _case(self, path: list[str]) -> str:
        for s in self.sources:
            if path[-1] in s.columns:
                return s.columns[path[-1]][0]
        return path[-1]

    @staticmethod
    def _is_output(node: Node, names: list[str]) -> bool:
        return node.kind == "Ident" and node["name"].lower() in {n.lower() for n in names}

    def _grouped(self, node: Node, value: Column, known: dict[str, Column]) -> Column:
        if node["aggregate"]:
            return value
        got = known.get(str(value))
        if got is None:
            raise BindError(node, "neither grouped nor aggregated")
        return got

    def _rewrite(self, node: Node, known: dict[str, Column], aggregate) -> Column:
        """A condition over the grouped rows: fields must be grouping keys."""

        def field_of(path: list[str]):
            found = self.field_of(path)
            if found is None:
                return None
            got = known.get(str(found[0]))
            if got is None:
                raise BindError(node, f"{path[-1]} is not grouped")
            return got, found[1]

        return column(node, Scope(field_of, self.variables, aggregate=aggregate))

    def _ordered(self, df: DataFrame, q: Node, order: list, names: list[str]) -> DataFrame:
        """Nulls sort below all values, as an initial value would."""
        by = []
        for i, (node, value) in enumerate(order):
            if value is None:
                value = F.col(f"`{next(n for n in names if n.lower() == node['name'].lower())}`")
            else:
                value = F.col(f"__o{i}")
            by.append(value.desc_nulls_last() if node["descending"] else value.asc_nulls_first())
        if q["order_pk"]:
            keys = self.catalog.keys.get(q.one("from")["name"].lower())
            if not keys:
                raise BindError(q, "no primary key is known")
            by += [F.col(f"`{k}`").asc_nulls_first() for k in keys]
        return df.orderBy(*by) if by else df

    def _count(self, node: Node) -> int:
        if node.kind == "Basic_Lit":
            return int(node["value"])
        path = path_of(node.one("operand") if node.kind == "Unary_Expr" else node)
        value = path and self.variables.get(path[0])
        if not isinstance(value, int):
            raise BindError(node, "UP TO needs a number")
        return value

    def _entries(self, df: DataFrame, q: Node, where: Node | None, scope: Scope) -> tuple[DataFrame, Node | None]:
        """FOR ALL ENTRIES: a semi-join with the driver table. Rows don't multiply; an empty driver gives no rows."""
        node = q.one("entries")
        name = path_of(node.one("operand") if node.kind == "Unary_Expr" else node)[0]
        driver = self.variables.get(name)
        driver = getattr(driver, "df", driver)
        if not isinstance(driver, DataFrame):
            raise BindError(node, f"{name} is no internal table")
        terms, rest = [], None

        def split(n: Node) -> list[Node]:
            return split(n.one("left")) + split(n.one("right")) if n.kind == "Binary_Expr" and n["op"] == "AND" else [n]

        types = {c.lower(): (c, t) for c, t in driver.dtypes}
        used: set[str] = set()
        for term in split(where) if where is not None else []:
            paths = [path_of(n.one("operand")) for n in term.walk() if n.kind == "Unary_Expr" and n["op"] == "@"]
            if any(p and p[0] == name for p in paths):
                terms.append(term)
                used |= {types[p[1]][0] for p in paths if p and p[0] == name}
            else:
                rest = term if rest is None else Node("Binary_Expr", rest.start, term.end, {"op": "AND"}, [("left", rest), ("right", term)])
        # Only the columns that the condition names travel, renamed so that they can't clash.
        slim = driver.select(*(F.col(f"`{c}`").alias(f"__fae_{c}") for c in sorted(used) or driver.columns[:1]))
        value = {c.lower(): F.col(f"`__fae_{c}`") for c in used}
        condition = F.lit(True)
        bound = Scope(self.field_of, self.variables | {name: value})
        for term in terms:
            condition = condition & column(term, bound)
        return df.join(slim, condition, "left_semi"), rest


def select(catalog: Catalog, text: str, variables: dict | None = None, target=None) -> DataFrame:
    """The result of one SELECT. target is the schema of INTO CORRESPONDING FIELDS: its columns by name, null where the query has none."""
    q = parse_select(text)
    out = Binder(catalog, variables).frame(q)
    if target is not None and (q["into_kind"] or "").startswith("Corresponding"):
        have = {c.lower(): c for c in out.columns}
        out = out.select(*((F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields))
    return out
