"""Loop bodies with running state: what a row does to each scalar is compiled to a step that composes, and a scan finds every row's state.

The body is walked symbolically for one row. First it is found which scalars each scalar's next value depends on; then they are solved in that
order, each by the first form that fits: kept, replaced or added to (`scan.running`), the larger or smaller of it and a value, multiplied and added to
(`scan.affine`), or one of finitely many literals that any conditions choose (`scan.machine`). A scalar that is solved is a column like the row's own for those after it. At last
the body is walked once more with all states known: components, APPEND, INSERT, DELETE of the row and EXIT become DataFrame operations. EXIT ends the loop at the
least position at which its conditions hold. A body without such forms raises an error that names its place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scan
from ..operators.itab import IDX, Itab, checkpointed, numbered
from .expressions import BindError, Scope, column, path_of
from .syntax import Node

#: Literals that a scalar may take in turn, at most.
STATES = 32
_LESS, _MORE = ("<", "<=", "LT", "LE"), (">", ">=", "GT", "GE")


class NoForm(Exception):
    """The scalar's step doesn't have the form that is tried."""


def names_in(node: Node | None) -> set[str]:
    """Variables that an expression reads, and components as `alias-name`."""
    out: set[str] = set()
    for n in node.walk() if node is not None else ():
        path = path_of(n)
        if path:
            out |= {path[0], "-".join(path[:2])}
        elif n.kind == "Selector_Expr" and n["op"] == "->":
            out |= {f"{x}-{n['name'].lower()}" for x in (path_of(n.one("left")) or [""])[:1]}
    return out


def _same(a: Node, b: Node) -> bool:
    return a.kind == b.kind and a.attrs == b.attrs and len(a.parts) == len(b.parts) and all(x[0] == y[0] and _same(x[1], y[1]) for x, y in zip(a.parts, b.parts))


def _bare(node: Node) -> Node:
    while node.kind == "Paren_Expr":
        node = node.one("inner")
    return node


@dataclass
class Walk:
    """One symbolic pass: values of names in the row so far, and what has been met."""

    now: dict[str, Column]
    tainted: set[str] = field(default_factory=set)
    step: object = None
    appended: list = field(default_factory=list)
    deleted: Column | None = None
    left: Column | None = None
    stopped: Column | None = None
    #: The scalar whose changes may be told by comparing it, and what it has been compared with so far.
    own: str = ""
    compared: list[Node] = field(default_factory=list)


def _both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


class Running:
    def __init__(self, program, body: list[Node], name: str, alias: str, assigning: bool, visited: Column):
        self.program, self.body, self.name, self.alias, self.assigning = program, body, name, alias, assigning
        self.table: Itab = program.variables[name]
        self.df = self.table.df.withColumn("__on", visited)
        self.kinds = {c.lower(): t for c, t in self.table.df.dtypes}
        self.written: list[str] = []
        self._collect(body)

    # What the body assigns
    def target(self, node: Node) -> str:
        """The name that an assignment changes: a scalar, or alias-component."""
        if node.kind == "Data_Inline_Decl":
            return node["name"].lower()
        target = node.one("target")
        if target.kind == "Data_Inline_Decl":
            return target["name"].lower()
        path = path_of(target) or ([*(path_of(target.one("left")) or []), target["name"].lower()] if target.kind == "Selector_Expr" else None)
        if not path or len(path) > 2 or len(path) == 2 and path[0] != self.alias:
            raise BindError(node, "this target can't change in a loop with running state")
        if len(path) == 2 and not self.assigning:
            raise BindError(node, "the loop's row is a copy; ASSIGNING changes the table")
        return "-".join(path)

    def _collect(self, body: list[Node]) -> None:
        for n in (x for s in body for x in s.walk()):
            if n.kind == "Assign_Stmt" or n.kind == "Data_Inline_Decl" and n.one("value") is not None:
                t = self.target(n)
                if "-" not in t and t not in self.written:
                    self.written.append(t)
            elif n.kind == "Loop_Stmt":
                raise BindError(n, "this loop body has an order that can't be spread over a cluster")

    def _branches(self, n: Node) -> list[tuple[Node | None, list[Node]]]:
        if n.kind == "If_Stmt":
            return [(n.one("condition"), n.all("then")), *((b.one("condition"), b.all("then")) for b in n.all("elseif")), (None, n.all("else"))]
        return [(b, b.all("body")) for b in n.all("branch")]

    @staticmethod
    def _word(n: Node) -> str:
        return n["words"][0].upper() if n.kind == "Expr_Stmt" and len(n["words"]) == 1 else ""

    def _leaves(self, body: list[Node]) -> bool:
        return any(x.kind == "Check_Stmt" or self._word(x) == "CONTINUE" for n in body for x in n.walk())

    # Dependencies: whose states before the row a name's value depends on
    def dependencies(self) -> tuple[dict[str, set[str]], set[str]]:
        """For each scalar what its next value depends on, and what effects depend on."""
        deps: dict[str, set[str]] = {s: {s} for s in self.written}
        effects: set[str] = set()

        def of(node) -> set[str]:
            return set().union(*(deps.get(n, set()) for n in names_in(node)))

        def walk(body: list[Node], under: set[str], sure: bool) -> tuple[set[str], bool]:
            """Returns what the rest of the enclosing body depends on, and whether it is still reached for sure."""
            for n in body:
                word = self._word(n)
                if n.kind == "Check_Stmt":
                    under, sure = under | of(n.one("condition")), False
                elif word == "CONTINUE":
                    return under, False
                elif word == "EXIT":  # what follows it in the row is cut off when the body is carried out
                    effects.update(under)
                elif n.kind in ("If_Stmt", "Case_Stmt"):
                    seen, leaves = under | (of(n.one("on")) if n.kind == "Case_Stmt" else set()), False
                    for test, inner in self._branches(n):
                        if test is not None:
                            seen = seen | (of(test) if n.kind == "If_Stmt" else set().union(set(), *(of(v) for v in test.all("value"))))
                        got, whole = walk(inner, seen, False)
                        if self._leaves(inner):
                            leaves, under = True, under | got
                    sure = sure and not leaves
                elif n.kind == "Assign_Stmt" or n.kind == "Data_Inline_Decl":
                    t = self.target(n)
                    deps[t] = of(n.one("value")) | under | (set() if sure else deps.get(t, set()))
                elif n.kind in ("Append_Stmt", "Insert_Stmt", "Delete_Stmt"):
                    effects.update(under | of(n.one("source")))
                else:
                    raise BindError(n, "this statement can't run in a loop with running state")
            return under, sure

        walk(self.body, set(), True)
        for k, v in deps.items():
            if "-" in k:
                effects |= v
        return {s: deps[s] for s in self.written}, effects

    # Expressions
    def scope(self, w: Walk) -> Scope:
        def field_of(path: list[str]):
            if path[0] == self.alias:
                if len(path) == 1:
                    if list(self.kinds) == ["table_line", IDX]:
                        return w.now.get(f"{self.alias}-table_line", F.col("table_line")), self.kinds["table_line"]
                    return F.struct(*(w.now.get(f"{self.alias}-{c}", F.col(c)).alias(c) for c in self.kinds if c != IDX)), "struct"
                key = "-".join(path[:2])
                if path[1] not in self.kinds:
                    return None
                value = w.now.get(key, F.col(f"`{path[1]}`"))
                for p in path[2:]:
                    value = value[p]
                return value, self.kinds[path[1]]
            if path == ["sy", "tabix"]:
                return F.col(IDX), "bigint"
            if len(path) == 1 and path[0] in w.now:
                old = self.program.variables.get(path[0])
                return w.now[path[0]], "string" if isinstance(old, str) else "double"
            return None

        held = {k: v for k, v in self.program.variables.items() if not isinstance(v, (Itab, DataFrame)) and k not in self.written}
        return Scope(field_of, held)

    def value(self, node: Node, w: Walk) -> Column:
        if names_in(node) & w.tainted:
            raise NoForm
        return column(self._dotted(node), self.scope(w))

    def _dotted(self, node: Node) -> Node:
        """r->c of a loop with a reference means r-c."""
        if not any(n.kind == "Selector_Expr" and n["op"] == "->" for n in node.walk()):
            return node
        parts = [(r, self._dotted(c)) for r, c in node.parts]
        attrs = dict(node.attrs)
        if node.kind == "Selector_Expr" and node["op"] == "->" and path_of(node.one("left")) == [self.alias]:
            attrs["op"] = "-"
        out = Node(node.kind, node.start, node.end, attrs)
        out.parts = parts
        return out

    def test(self, node: Node, w: Walk) -> Column:
        return F.coalesce(self.value(node, w), F.lit(False))

    def _compares(self, w: Walk, node: Node | None) -> Column | None:
        """`x = s` or `x <> s` for the scalar that is being solved: when a row passes that may make it x.

        If nothing but x is assigned under or after such a test, it makes no difference to s: where it keeps s from becoming x, s is x. Only a null x isn't unequal.
        """
        test = _bare(node) if node is not None else None
        if not w.own or w.own not in w.tainted or test is None or test.kind != "Binary_Expr" or test["op"] not in ("=", "<>"):
            return None
        sides = [_bare(test.one("left")), _bare(test.one("right"))]
        for a, b in (sides, sides[::-1]):
            if path_of(a) == [w.own] and not names_in(b) & w.tainted:
                w.compared.append(b)
                return self.value(b, w).isNotNull() if test["op"] == "<>" else F.lit(True)
        return None

    # The symbolic pass
    def walk(self, w: Walk, known: set[str], assign=None, special=None) -> Walk:
        """known: scalars whose states are columns. assign(w, node, guard) takes assignments to the scalar that is being solved; special(w, node, guard) may take an IF whole."""
        effects = assign is None

        def matters(body: list[Node]) -> bool:
            for n in (x for s in body for x in s.walk()):
                if n.kind == "Assign_Stmt" or n.kind == "Data_Inline_Decl" and n.one("value") is not None:
                    if effects or self.target(n) in known or assign and assign(None, n, None):
                        return True
                if effects and (n.kind in ("Append_Stmt", "Insert_Stmt", "Delete_Stmt") or self._word(n)):
                    return True
            return False

        def go(body: list[Node], guard: Column | None, later: bool) -> Column | None:
            """Returns the condition under which the rest of the row's round still runs, as far as this body limits it; later: whether anything after the body matters."""
            alive: Column | None = None
            for k, n in enumerate(body):
                if not matters(body[k:]) and not (later and self._leaves(body[k:])):
                    break
                here = _both(guard, alive)
                word = self._word(n)
                if n.kind == "Check_Stmt":
                    met = self._compares(w, n.one("condition"))
                    alive = _both(alive, self.test(n.one("condition"), w) if met is None else met)
                elif word == "CONTINUE" or word == "EXIT" and effects:
                    if word == "EXIT":
                        met = F.lit(True) if here is None else here
                        w.stopped = met if w.stopped is None else w.stopped | met
                    return F.lit(False)
                elif word:
                    if word != "EXIT":
                        raise BindError(n, "this statement can't run in a loop with running state")
                elif n.kind in ("If_Stmt", "Case_Stmt"):
                    inner = [x for _, b in self._branches(n) for x in b]
                    if special and special(w, n, here):
                        continue
                    more = later or matters(body[k + 1 :])
                    if not matters(inner) and not (more and self._leaves(inner)):
                        continue
                    seen: Column | None = None
                    on = self.value(n.one("on"), w) if n.kind == "Case_Stmt" else None
                    for test, inside in self._branches(n):
                        compares = self._compares(w, test) if n.kind == "If_Stmt" else None
                        if compares is not None:
                            go(inside, _both(here, compares), False)
                            continue
                        if test is None or test.kind == "Case_Branch" and test["others"]:
                            met = None
                        elif n.kind == "If_Stmt":
                            met = self.test(test, w)
                        else:
                            met = F.lit(False)
                            for v in test.all("value"):
                                met = met | F.coalesce(on == self.value(v, w), F.lit(False))
                        this = met if seen is None else ~seen if met is None else ~seen & met
                        kept = go(inside, _both(here, this), more)
                        if kept is not None:
                            alive = _both(alive, kept if this is None else ~this | kept)
                        seen = this if seen is None else seen | (F.lit(True) if this is None else this)
                elif n.kind in ("Assign_Stmt", "Data_Inline_Decl"):
                    if assign and assign(None, n, None):
                        assign(w, n, here)
                    else:
                        self._set(w, n, here, known)
                elif effects:
                    self._effect(w, n, here)
            return alive

        go(self.body, None, False)
        return w

    def _set(self, w: Walk, n: Node, guard: Column | None, known: set[str]) -> None:
        t = self.target(n)
        if "-" not in t and t not in known:
            return
        if names_in(n.one("value")) & w.tainted or w.compared:
            w.tainted.add(t)
            return
        new = self.value(n.one("value"), w)
        if "-" in t:
            component = t.split("-")[1]
            new = new.cast(self.kinds[component])
            old = w.now.get(t, F.col(f"`{component}`"))
        else:
            old = w.now.get(t, F.lit(None))
        w.now[t] = new if guard is None else F.when(guard, new).otherwise(old)
        if guard is None:
            w.tainted.discard(t)

    def _effect(self, w: Walk, n: Node, guard: Column | None) -> None:
        met = F.lit(True) if guard is None else guard
        if n.kind == "Delete_Stmt":
            own = path_of(n.one("table")) == [self.name] and (n["kind"] == "index" and path_of(n.one("index")) == ["sy", "tabix"] or n["kind"] == "line" and path_of(n.one("line")) == [self.alias])
            if not own:
                raise BindError(n, "a loop may delete its own row only")
            w.deleted = met if w.deleted is None else w.deleted | met
            return
        into = (path_of(n.one("table")) or [""])[0]
        if n["kind"] not in ("row", "itab") or into == self.name:
            raise BindError(n, "this statement can't run in a loop with running state")
        w.appended.append((n, into, met, self.value(n.one("source"), w)))

    # Forms of a scalar's step
    def solve(self, s: str, known: set[str]) -> None:
        start = self.program.variables.get(s)
        out = f"__state_{s}"
        mine = lambda n: self.target(n) == s
        base = {k: F.col(f"__state_{k}") for k in known}
        on = F.col("__on")

        def fresh(**more) -> Walk:
            return Walk(dict(base), {s}, **more)

        def replaced(w: Walk, n: Node, guard: Column | None) -> Column:
            new = self.value(n.one("value"), w)
            if guard is None:
                w.tainted.discard(s)
                w.now[s] = new
            return new

        def when(guard, new, old):
            return new if guard is None else F.when(guard, new).otherwise(old)

        def linear(w: Walk | None, n: Node, guard: Column | None) -> bool:
            if w is None:
                return mine(n)
            (factor, addend, how), e = w.step, _bare(n.one("value"))
            if not all(_same(x, e) for x in w.compared):
                raise NoForm
            left, right = (_bare(x) if x is not None else None for x in (e.one("left"), e.one("right"))) if e.kind == "Binary_Expr" else (None, None)
            is_s = lambda x: x is not None and path_of(x) == [s]
            if is_s(e):
                return True
            if s in w.tainted and e.kind == "Binary_Expr" and e["op"] in "+-*/" and (is_s(left) or is_s(right) and e["op"] in "+*") and s not in names_in(right if is_s(left) else left):
                x = self.value(right if is_s(left) else left, w)
                if e["op"] in "*/":
                    x = F.coalesce(x, F.lit(1))
                    scaled = lambda c: c * x if e["op"] == "*" else c / x
                    w.step = (when(guard, scaled(factor), factor), when(guard, scaled(addend), addend), "affine")
                else:
                    x = F.coalesce(x, F.lit(0))
                    w.step = (factor, when(guard, addend + x if e["op"] == "+" else addend - x, addend), "affine" if how == "affine" else "sum")
                return True
            new = replaced(w, n, guard)
            if isinstance(start, (int, float)) or how != "last":
                w.step = (when(guard, F.lit(0), factor), when(guard, new, addend), how)
            else:
                w.step = (when(guard, F.lit(0), factor), when(guard, new, addend), "last")
            return True

        def extreme(how: str):
            larger, smaller = (_MORE, _LESS) if how == "max" else (_LESS, _MORE)
            call = {"max": "nmax", "min": "nmin"}[how]

            def bound(w: Walk, x: Column, guard: Column | None) -> None:
                keep, value = w.step
                w.step = (keep, when(guard, scan._MERGE[how](value, x), value))

            def special(w: Walk, n: Node, guard: Column | None) -> bool:
                if n.kind != "If_Stmt" or not any(mine(x) for y in n.all("then") for x in y.walk() if x.kind == "Assign_Stmt"):
                    return False
                test, sets = _bare(n.one("condition")), [x for x in n.all("then") if x.kind == "Assign_Stmt" and mine(x)]
                if test.kind != "Binary_Expr" or n.all("else") or n.all("elseif") or len(sets) != 1 or s not in names_in(test):
                    return False
                left, right, value = _bare(test.one("left")), _bare(test.one("right")), _bare(sets[0].one("value"))
                fits = path_of(right) == [s] and _same(left, value) and test["op"] in larger or path_of(left) == [s] and _same(right, value) and test["op"] in smaller
                if not fits:
                    raise NoForm
                bound(w, self.value(value, w), guard)
                return True

            def assign(w: Walk | None, n: Node, guard: Column | None) -> bool:
                if w is None:
                    return mine(n)
                e = _bare(n.one("value"))
                if e.kind == "Call_Expr" and path_of(e.one("function")) == [call]:
                    args = [_bare(a.one("value") if a.kind == "Named_Arg" else a) for a in e.all("arg")]
                    others = [a for a in args if path_of(a) != [s]]
                    if len(others) < len(args):
                        for a in others:
                            bound(w, self.value(a, w), guard)
                        return True
                keep, value = w.step
                new = replaced(w, n, guard)
                w.step = (when(guard, F.lit(False), keep), when(guard, new, value))
                return True

            return assign, special

        try:
            w = self.walk(fresh(step=(F.lit(1), F.lit(0) if isinstance(start, (int, float)) and not isinstance(start, bool) else F.lit(None), "last"), own=s), known, linear)
            factor, addend, how = w.step
            if how == "affine":
                self.df = scan.affine(self.df, IDX, F.when(on, factor).otherwise(1), F.when(on, addend).otherwise(0), start, out)
            else:
                keep = ~on | (factor == 1)
                self.df = scan.running(self.df, IDX, keep, F.when(on, addend), how, start, out)
            return
        except NoForm:
            pass
        for how in ("max", "min"):
            try:
                w = self.walk(fresh(step=(F.lit(True), F.lit(None))), known, *extreme(how))
                keep, value = w.step
                self.df = scan.running(self.df, IDX, ~on | keep, F.when(on, value), how, start, out)
                return
            except NoForm:
                pass
        self._machine(s, known, start, out, mine, base)

    def _machine(self, s: str, known: set[str], start, out: str, mine, base: dict[str, Column]) -> None:
        """The scalar's values are the literals that the body assigns; each row maps each of them to the next."""
        sets = [n for b in self.body for n in b.walk() if n.kind == "Assign_Stmt" and mine(n)]
        values = [start]
        for n in sets:
            e = _bare(n.one("value"))
            if path_of(e) == [s]:
                continue
            if e.kind != "Basic_Lit":
                raise BindError(n, f"{s} has no form that can be scanned")
            v = self.program.value(e)
            values += [] if v in values else [v]
        if len(values) > STATES or len({type(v) for v in values}) > 1:
            raise BindError(sets[0], f"{s} has no form that can be scanned")
        number = F.create_map(*(x for k, v in enumerate(values) for x in (F.lit(v), F.lit(k))))
        following = []
        try:
            for v in values:
                w = self.walk(Walk(base | {s: F.lit(v)}), known | {s})
                following.append(F.when(F.col("__on"), number[w.now[s]]).otherwise(number[F.lit(v)]))
        except NoForm:
            raise BindError(sets[0], f"{s} has no form that can be scanned") from None
        self.df = scan.machine(self.df, IDX, following, 0, out).withColumn(out, F.element_at(F.array(*map(F.lit, values)), F.col(out) + 1))

    # The loop
    def run(self) -> None:
        deps, effects = self.dependencies()
        # A scalar is scanned if its state before a row matters: to itself after the loop, to others or to an effect.
        needed = {s for s in self.written if s in deps[s]} | effects
        grown = True
        while grown:
            more = needed | {d for s in needed for d in deps[s]}
            grown, needed = more != needed, more
        known: set[str] = set()
        while len(known) < len(needed):
            ready = sorted(s for s in needed - known if deps[s] <= known | {s})
            if not ready:
                raise BindError(self.body[0], f"{', '.join(sorted(needed - known))} depend on each other")
            if ready[0] not in self.program.variables:
                raise BindError(self.body[0], f"{ready[0]} is read before it has a value")
            self.solve(ready[0], set(known))
            known.add(ready[0])
        df = checkpointed(self.df) if known else self.df
        w = self.walk(Walk({k: F.col(f"__state_{k}") for k in known}), set(self.written))
        on = F.col("__on")
        if w.stopped is not None:
            last = df.filter(on & w.stopped).agg(F.min(IDX)).first()[0]
            on = on if last is None else on & (F.col(IDX) <= last)
        self._finish(df, w, on)

    def _finish(self, df: DataFrame, w: Walk, on: Column) -> None:
        variables, kinds = self.program.variables, dict(self.table.df.dtypes)
        by_table: dict[str, list[DataFrame]] = {}
        for k, (n, into, met, source) in enumerate(w.appended):
            other = self.program.table(n.one("table"))
            rows = df.filter(on & met).select(source.alias("r"), F.col(IDX).alias("__was"), F.lit(k).alias("__k"))
            rows = rows.select("r.*", "__was", "__k") if isinstance(rows.schema["r"].dataType, T.StructType) else rows.withColumnRenamed("r", other.columns[0])
            have = {c.lower(): c for c in rows.columns}
            cast = [(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in other.rows.dtypes]
            by_table.setdefault(into, []).append(rows.select(*cast, "__was", "__k"))
        finals = {s: w.now[s] for s in self.written if s in w.now}
        row = df.filter(on).orderBy(F.desc(IDX)).select(*(c.alias(s) for s, c in finals.items())).first() if finals else None
        changed = {k.split("-")[1]: v for k, v in w.now.items() if "-" in k}
        if changed:
            df = df.withColumns({c: F.when(on, v).otherwise(F.col(f"`{c}`")).cast(kinds[c]) for c, v in changed.items()})
        if changed or w.deleted is not None:
            kept = df if w.deleted is None else df.filter(~(on & F.coalesce(w.deleted, F.lit(False))))
            out = self.table._with(kept.select(*self.table.df.columns))
            variables[self.name] = out.renumber() if w.deleted is not None else out
        for into, parts in by_table.items():
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            variables[into] = variables[into].append(numbered(rows, [F.col("__was").asc(), F.col("__k").asc()]).drop("__was", "__k"))
        if row is not None:
            for s, v in row.asDict(True).items():
                variables[s] = v
