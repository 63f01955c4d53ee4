"""Syntax trees and the parser of the dialect: declarations, statements, queries and expressions.

Every node has a kind, a byte range, attributes and children by role. The parser recovers at the end of a statement, so one bad
statement costs one Bad_Decl and one diagnostic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from .lexer import Token, tokenize


@dataclass
class Node:
    kind: str
    start: int = 0
    end: int = 0
    attrs: dict = field(default_factory=dict)
    parts: list[tuple[str, "Node"]] = field(default_factory=list)

    def add(self, role: str, node: "Node | None") -> "Node":
        if node is not None:
            self.parts.append((role, node))
            self.end = max(self.end, node.end)
        return self

    def all(self, role: str) -> list["Node"]:
        return [n for r, n in self.parts if r == role]

    def one(self, role: str) -> "Node | None":
        return next((n for r, n in self.parts if r == role), None)

    def __getitem__(self, key: str):
        return self.attrs.get(key)

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(n for _, n in reversed(node.parts))


class SyntaxProblem(Exception):
    def __init__(self, token: Token, message: str):
        super().__init__(f"{message} at byte {token.start}, found {token.text or token.kind!r}")
        self.token, self.message = token, message


COMPARE = {
    "Equal": "=", "NotEqual": "<>", "Less": "<", "Greater": ">", "LessEqual": "<=", "GreaterEqual": ">=",
    "EQ": "=", "NE": "<>", "LT": "<", "GT": ">", "LE": "<=", "GE": ">=",
    "CO": "CO", "CN": "CN", "CA": "CA", "NA": "NA", "CS": "CS", "NS": "NS", "CP": "CP", "NP": "NP",
}
AGGREGATES = ("SUM", "COUNT", "AVG", "MIN", "MAX")
CONSTRUCTORS = ("NEW", "VALUE", "CONV", "COND", "SWITCH", "REDUCE", "FILTER", "CORRESPONDING", "CAST", "REF", "EXACT")
TEMPLATE_OPTIONS = (
    "ALPHA", "DATE", "TIME", "WIDTH", "ALIGN", "PAD", "CASE", "SIGN", "EXPONENT", "DECIMALS", "ZERO", "NUMBER", "STYLE", "CURRENCY", "COUNTRY",
    "TIMESTAMP", "TIMEZONE",
)
EVENTS = ("START-OF-SELECTION", "END-OF-SELECTION", "INITIALIZATION", "TOP-OF-PAGE", "END-OF-PAGE", "LOAD-OF-PROGRAM")


class Parser:
    def __init__(self, source: str | bytes):
        tokens, errors = tokenize(source)
        self.source = source.decode("utf-8", "replace") if isinstance(source, bytes) else source
        self.errors = list(errors)
        self.tokens = [t for t in tokens if t.kind != "Comment"]
        self.i = 0
        self.chain: list[Token] | None = None

    # Tokens ---------------------------------------------------------------------------------------------

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.now
        self.i = min(self.i + 1, len(self.tokens) - 1)
        return t

    def touches(self, k: int = 0) -> bool:
        """Whether no space precedes the k-th next token."""
        j = min(self.i + k, len(self.tokens) - 1)
        return j > 0 and self.tokens[j - 1].end == self.tokens[j].start

    def compound(self) -> tuple[str, int]:
        """The word ahead with its hyphenated parts, as in FIELD-SYMBOLS, and how many tokens it has."""
        if self.now.kind != "Ident":
            return "", 0
        word, k = self.now.upper, 1
        while self.ahead(k).kind == "Minus" and self.ahead(k + 1).kind == "Ident" and self.touches(k) and self.touches(k + 1):
            word, k = f"{word}-{self.ahead(k + 1).upper}", k + 2
        return word, k

    def at(self, *words: str) -> bool:
        """Whether exactly these words come next; a word may be hyphenated."""
        keep = self.i
        for w in words:
            got, k = self.compound()
            if got != w:
                self.i = keep
                return False
            self.i = min(self.i + k, len(self.tokens) - 1)
        self.i = keep
        return True

    def skip(self, *words: str) -> bool:
        if not self.at(*words):
            return False
        for _ in words:
            self.i += self.compound()[1]
        return True

    def op(self, kind: str) -> bool:
        if self.now.kind == kind:
            self.take()
            return True
        return False

    def need(self, kind: str) -> Token:
        if self.now.kind != kind:
            raise SyntaxProblem(self.now, f"expected {kind}")
        return self.take()

    def word(self, *words: str) -> None:
        if not self.skip(*words):
            raise SyntaxProblem(self.now, f"expected {' '.join(words)}")

    def node(self, kind: str, /, **attrs) -> Node:
        return Node(kind, self.now.start, self.now.end, attrs)

    @staticmethod
    def of_token(kind: str, token: Token, /, **attrs) -> Node:
        """A node that begins with a token that has been taken."""
        return Node(kind, token.start, token.end, attrs)

    def close(self, node: Node) -> Node:
        node.end = max(node.end, self.tokens[self.i - 1].end if self.i else 0)
        return node

    def period(self, node: Node) -> Node:
        self.need("Period")
        return self.close(node)

    # Expressions ----------------------------------------------------------------------------------------

    def logic(self) -> Node:
        return self._binary(("OR",), lambda: self._binary(("AND",), self._not))

    def _not(self) -> Node:
        if self.at("NOT"):
            out = self.node("Unary_Expr", op="NOT")
            self.take()
            return self.close(out.add("operand", self._not()))
        return self.comparison()

    def _binary(self, words, inner) -> Node:
        left = inner()
        while self.now.upper in words:
            op = self.take().upper
            left = self.pair(op, left, inner())
        return left

    def pair(self, op: str, left: Node, right: Node) -> Node:
        return Node("Binary_Expr", left.start, right.end, {"op": op}, [("left", left), ("right", right)])

    def comparison(self) -> Node:
        left = self.expr()
        key = self.now.upper or self.now.kind
        negated = False
        if self.at("NOT") and self.ahead().upper in ("IN", "BETWEEN", "LIKE"):
            self.take()
            negated, key = True, self.now.upper
        if key == "BETWEEN":
            self.take()
            low = self.expr()
            self.word("AND")
            out = Node("Between_Expr", left.start, left.end, {"negated": negated}, [("left", left)])
            return self.close(out.add("low", low).add("high", self.expr()))
        if key == "LIKE":
            self.take()
            return self._maybe_not(self.pair("LIKE", left, self.expr()), negated)
        if key == "IN":
            self.take()
            out = Node("In_Expr", left.start, left.end, {"negated": negated}, [("left", left)])
            if self.op("LParen"):
                while not self.op("RParen"):
                    out.add("item", self.expr())
                    self.op("Comma")
            else:
                out.add("item", self.expr())
            return self.close(out)
        if key == "IS":
            self.take()
            negated = self.skip("NOT")
            what = self.take().upper
            out = Node("Predicate_Expr", left.start, left.end, {"predicate": what, "negated": negated}, [("operand", left)])
            if what == "INSTANCE":
                self.word("OF")
                out.add("class", self.primary())
            return self.close(out)
        if key in COMPARE:
            self.take()
            return self.pair(COMPARE[key], left, self.expr())
        return left

    def _maybe_not(self, node: Node, negated: bool) -> Node:
        return Node("Unary_Expr", node.start, node.end, {"op": "NOT"}, [("operand", node)]) if negated else node

    def expr(self) -> Node:
        left = self.additive()
        while self.now.kind == "Ampersand":
            self.take()
            self.op("Ampersand")
            left = self.pair("&", left, self.additive())
        return left

    def additive(self) -> Node:
        left = self.term()
        while self.now.kind in ("Plus", "Minus") and not (self.now.kind == "Minus" and self.touches() and self.touches(1) and self.ahead().kind == "Ident"):
            op = self.take().text
            left = self.pair(op, left, self.term())
        return left

    def term(self) -> Node:
        left = self.unary()
        while self.now.kind in ("Star", "Slash") or self.now.upper in ("MOD", "DIV"):
            op = self.take().text.upper()
            left = self.pair(op, left, self.unary())
        return left

    def unary(self) -> Node:
        if self.now.kind in ("Plus", "Minus"):
            out = self.node("Unary_Expr", op=self.now.text)
            self.take()
            return self.close(out.add("operand", self.unary()))
        return self.postfix(self.primary())

    def postfix(self, left: Node) -> Node:
        while True:
            kind, tight = self.now.kind, self.touches()
            if kind in ("Minus", "Arrow", "StaticArrow", "Tilde") and tight and self.touches(1) and self.ahead().kind in ("Ident", "Star"):
                op = self.take().text
                name = self.take()
                left = Node("Selector_Expr", left.start, name.end, {"op": op, "name": name.text}, [("left", left)])
            elif kind == "LParen" and tight:
                left = self.call(left)
            elif kind == "LBracket" and tight:
                self.take()
                out = Node("Index_Expr", left.start, left.end, {}, [("left", left)])
                while self.now.kind not in ("RBracket", "EOF", "Period"):
                    out.add("index", self.argument())
                self.need("RBracket")
                left = self.close(out)
            else:
                return left

    def call(self, left: Node) -> Node:
        self.need("LParen")
        out = Node("Call_Expr", left.start, left.end, {}, [("function", left)])
        while self.now.kind not in ("RParen", "EOF"):
            if self.now.upper in ("EXPORTING", "IMPORTING", "CHANGING", "RECEIVING", "EXCEPTIONS") and self.ahead().kind == "Ident":
                self.take()
            out.add("arg", self.argument())
            self.op("Comma")
        self.need("RParen")
        return self.close(out)

    def argument(self) -> Node:
        if self.now.kind == "Ident" and self.ahead().kind == "Equal":
            out = self.of_token("Named_Arg", t := self.take(), name=t.text)
            self.take()
            return self.close(out.add("value", self.expr()))
        return self.logic() if self.now.kind != "Star" else self.star()

    def star(self) -> Node:
        out = self.node("Basic_Lit", type="star", value="*")
        self.take()
        return out

    def field_symbol(self) -> Node | None:
        if self.now.kind == "Less" and self.ahead().kind == "Ident" and self.ahead(2).kind == "Greater" and self.touches(1) and self.touches(2):
            out = self.node("Ident", name=f"<{self.ahead().text}>")
            self.i += 3
            return self.close(out)
        return None

    def primary(self) -> Node:
        t = self.now
        if (symbol := self.field_symbol()) is not None:
            return symbol
        if t.kind == "At":
            out = self.node("Unary_Expr", op="@")
            self.take()
            return self.close(out.add("operand", self.inline() or self.postfix(self.primary())))
        if t.kind == "Number":
            out = self.of_token("Basic_Lit", t := self.take(), type="number", value=t.text)
            return out
        if t.kind == "String":
            out = self.of_token("Basic_Lit", t := self.take(), type="string", value=t.text[1:-1])
            while self.now.kind == "String" and self.touches():  # a doubled quote inside a string
                out.attrs["value"] += "'" + self.take().text[1:-1]
            return self.close(out)
        if t.kind == "StringTemplate":
            return self.template()
        if t.kind == "LParen":
            out = self.node("Paren_Expr")
            self.take()
            out.add("inner", self.logic())
            self.need("RParen")
            return self.close(out)
        if t.kind == "Hash":
            out = self.node("Ident", name="#")
            self.take()
            return out
        if t.kind == "Ident":
            if (inline := self.inline()) is not None:
                return inline
            if t.upper in CONSTRUCTORS and self.ahead().kind in ("Ident", "Hash") and not self.touches(1) and self.ahead(2).kind in ("LParen", "Minus", "StaticArrow"):
                return self.constructor()
            out = self.of_token("Ident", t := self.take(), name=t.text)
            return out
        raise SyntaxProblem(t, "unexpected token")

    def inline(self) -> Node | None:
        """DATA(x), FINAL(x) and FIELD-SYMBOL(<x>)."""
        word, k = self.compound()
        if word in ("DATA", "FINAL", "FIELD-SYMBOL") and self.ahead(k).kind == "LParen" and self.touches(k):
            out = self.node("Data_Inline_Decl", symbol=word == "FIELD-SYMBOL")
            self.i += k + 1
            name = self.field_symbol() or self.of_token("Ident", t := self.need("Ident"), name=t.text)
            out.attrs["name"] = name["name"]
            self.need("RParen")
            return self.close(out)
        return None

    def template(self) -> Node:
        t = self.take()
        out = Node("String_Template_Expr", t.start, t.end)
        body, i, plain = t.text[1:-1] if t.text.endswith("|") else t.text[1:], 0, ""
        escapes = {"n": "\n", "t": "\t", "r": "\r"}

        def flush(plain: str) -> str:
            if plain:
                out.parts.append(("part", Node("Basic_Lit", t.start, t.end, {"type": "string", "value": plain})))
            return ""

        while i < len(body):
            if body[i] == "\\" and i + 1 < len(body):
                plain += escapes.get(body[i + 1], body[i + 1])
                i += 2
            elif body[i] == "{":
                depth, j = 1, i + 1
                while j < len(body) and depth:
                    if body[j] == "'":
                        j = max(j, body.find("'", j + 1))
                    depth += {"{": 1, "}": -1}.get(body[j], 0)
                    j += 1
                plain = flush(plain)
                inner = Parser(body[i + 1 : j - 1])
                part = Node("Template_Part", t.start, t.end, {"options": {}})
                shift = t.start + 1 + len(body[: i + 1].encode())
                value = inner.expr()
                while inner.now.kind == "Ident" and inner.now.upper in TEMPLATE_OPTIONS:
                    option = inner.take().upper
                    inner.need("Equal")
                    part.attrs["options"][option] = inner.expr()
                if inner.now.kind != "EOF":
                    raise SyntaxProblem(t, f"unexpected {inner.now.text!r} in a string template")
                for n in (x for root in (value, *part.attrs["options"].values()) for x in root.walk()):
                    n.start, n.end = n.start + shift, n.end + shift
                out.parts.append(("part", part.add("value", value)))
                i = j
            else:
                plain += body[i]
                i += 1
        flush(plain)
        return out

    def constructor(self) -> Node:
        word = self.now.upper
        out = self.node("New_Expr" if word == "NEW" else "Constructor_Expr", word=word)
        self.take()
        out.add("type", self.postfix_type())
        self.need("LParen")
        body = {"COND": self._cond, "SWITCH": self._switch, "REDUCE": self._reduce, "FILTER": self._filter}.get(word, self._rows)
        body(out)
        self.need("RParen")
        return self.close(out)

    def postfix_type(self) -> Node:
        out = self.of_token("Ident", t := self.take(), name=t.text)
        while self.now.kind in ("Minus", "StaticArrow") and self.touches() and self.ahead().kind == "Ident":
            op = self.take().text
            name = self.take()
            out = Node("Selector_Expr", out.start, name.end, {"op": op, "name": name.text}, [("left", out)])
        return out

    def _rows(self, out: Node) -> None:
        """Rows, named and plain arguments, BASE and FOR of VALUE, NEW, CONV and the like."""
        if self.skip("BASE"):
            out.add("base", self.expr())
        while self.now.kind not in ("RParen", "EOF"):
            if self.at("FOR"):
                out.add("for", self.loop_expr())
            elif self.now.kind == "LParen":
                out.add("row", self.row())
            else:
                out.add("arg", self.argument())

    def row(self) -> Node:
        out = self.node("Value_Row_Expr")
        self.need("LParen")
        while self.now.kind not in ("RParen", "EOF"):
            out.add("arg", self.argument())
        self.need("RParen")
        return self.close(out)

    def loop_expr(self) -> Node:
        out = self.node("For_Expr")
        self.word("FOR")
        name = self.field_symbol() or self.of_token("Ident", t := self.need("Ident"), name=t.text)
        out.attrs["name"] = name["name"]
        self.word("IN")
        out.add("table", self.expr())
        if self.skip("WHERE"):
            out.add("where", self.logic())
        if self.now.kind == "LParen":
            out.add("row", self.row())
        elif self.at("FOR"):
            out.add("for", self.loop_expr())
        elif self.now.kind == "Ident" and self.ahead().kind == "Equal":
            out.add("arg", self.argument())
        return self.close(out)

    def _cond(self, out: Node) -> None:
        while self.skip("WHEN"):
            out.add("when", self.logic())
            self.word("THEN")
            out.add("then", self.expr())
        if self.skip("ELSE"):
            out.add("else", self.expr())

    def _switch(self, out: Node) -> None:
        out.add("on", self.expr())
        self._cond(out)

    def _reduce(self, out: Node) -> None:
        self.word("INIT")
        out.add("init", self.argument())
        self.word("FOR")
        out.attrs["name"] = self.need("Ident").text
        self.word("IN")
        out.add("table", self.expr())
        if self.skip("WHERE"):
            out.add("where", self.logic())
        self.word("NEXT")
        out.add("next", self.argument())

    def _filter(self, out: Node) -> None:
        out.add("table", self.expr())
        self.word("WHERE")
        out.add("where", self.logic())

    # Queries --------------------------------------------------------------------------------------------

    def select(self) -> Node:
        out = self.node("Select_Stmt", single=False, distinct=False, into_kind="Single")
        self.word("SELECT")
        out.attrs["single"] = self.skip("SINGLE")
        out.attrs["distinct"] = self.skip("DISTINCT")
        if not self.at("FROM"):
            self.fields(out)
        while self.now.kind not in ("Period", "EOF"):
            self.clause(out)
        self.period(out)
        if not out["single"] and not out["is_table"] and self._has_end("ENDSELECT", "SELECT"):
            self.block(out, "body", ("ENDSELECT",))
            self.word("ENDSELECT")
            self.period(out)
        return out

    def _has_end(self, end: str, again: str) -> bool:
        """Whether the loop is closed before another one like it begins."""
        for t in self.tokens[self.i :]:
            if t.upper == end:
                return True
            if t.upper in (again, "ENDFORM", "ENDMETHOD", "ENDCLASS"):
                return False
        return False

    def fields(self, out: Node) -> None:
        while self.now.kind in ("Ident", "Star", "At", "Number", "String") and self.now.upper not in ("FROM", "INTO", "WHERE", "GROUP", "HAVING", "ORDER", "UP", "FOR", "APPENDING", "INNER", "LEFT", "RIGHT", "JOIN"):
            item = self.star() if self.now.kind == "Star" else self.field_expr()
            if self.skip("AS"):
                item.attrs["alias"] = self.need("Ident").text
            out.add("field", self.close(item))
            self.op("Comma")

    def field_expr(self) -> Node:
        if self.now.upper in AGGREGATES and self.ahead().kind == "LParen" and self.touches(1):
            out = self.of_token("Call_Expr", t := self.take(), aggregate=t.upper)
            self.take()
            out.attrs["distinct"] = self.skip("DISTINCT")
            out.add("arg", self.star() if self.now.kind == "Star" else self.expr())
            self.need("RParen")
            return self.close(out)
        return self.expr()

    def sql_logic(self) -> Node:
        keep, self.unary = self.unary, self._sql_unary
        try:
            return self.logic()
        finally:
            self.unary = keep

    def _sql_unary(self) -> Node:
        if self.now.upper in AGGREGATES and self.ahead().kind == "LParen" and self.touches(1):
            return self.field_expr()
        return Parser.unary(self)

    def from_table(self) -> Node:
        out = self.of_token("Ident", t := self.need("Ident"), name=t.text)
        if self.skip("AS"):
            out.attrs["alias"] = self.need("Ident").text
        return self.close(out)

    def clause(self, out: Node) -> None:
        if self.skip("FROM"):
            out.add("from", self.from_table())
        elif self.skip("FIELDS"):
            self.fields(out)
        elif self.now.upper in ("INNER", "LEFT", "RIGHT", "JOIN"):
            join = self.node("Select_Join", type="inner")
            if self.now.upper != "JOIN":
                join.attrs["type"] = self.take().upper.lower()
                self.skip("OUTER")
            self.word("JOIN")
            join.add("table", self.from_table())
            if self.skip("ON"):
                join.add("on", self.sql_logic())
            out.add("join", self.close(join))
        elif self.skip("FOR", "ALL", "ENTRIES", "IN"):
            out.add("entries", self.primary())
        elif self.skip("WHERE"):
            out.add("where", self.sql_logic())
        elif self.skip("GROUP", "BY"):
            while self.now.kind == "Ident" and not self._clause_word():
                out.add("group", self.expr())
                self.op("Comma")
        elif self.skip("HAVING"):
            out.add("having", self.sql_logic())
        elif self.skip("ORDER", "BY"):
            if self.skip("PRIMARY", "KEY"):
                out.attrs["order_pk"] = True
            while self.now.kind == "Ident" and not self._clause_word():
                item = self.expr()
                item.attrs["descending"] = self.skip("DESCENDING")
                if not item["descending"]:
                    self.skip("ASCENDING")
                out.add("order", item)
                self.op("Comma")
        elif self.skip("UP", "TO"):
            out.add("limit", self.expr())
            self.word("ROWS")
        elif self.now.upper in ("INTO", "APPENDING"):
            out.attrs["appending"] = self.take().upper == "APPENDING"
            kind = "Corresponding" if self.skip("CORRESPONDING", "FIELDS", "OF") else "Plain"
            out.attrs["is_table"] = self.skip("TABLE")
            out.attrs["into_kind"] = {"Plain": "Table" if out["is_table"] else "Single", "Corresponding": "CorrespondingTable" if out["is_table"] else "Corresponding"}[kind]
            out.add("into", self.expr())
        else:
            raise SyntaxProblem(self.now, "unknown clause of SELECT")

    def _clause_word(self) -> bool:
        return self.now.upper in ("FROM", "WHERE", "GROUP", "HAVING", "ORDER", "UP", "INTO", "FOR", "FIELDS", "APPENDING", "INNER", "LEFT", "RIGHT", "JOIN")

    # Statements -----------------------------------------------------------------------------------------

    def parse(self) -> Node:
        out = Node("File", 0, 0)
        while self.now.kind != "EOF":
            out.parts += [("decl", n) for n in self.safely()]
        out.end = self.now.end
        return out

    def safely(self) -> list[Node]:
        start = self.i
        try:
            got = self.statement()
            return got if isinstance(got, list) else [got]
        except SyntaxProblem as e:
            self.errors.append((e.token.start, e.token.end, e.message))
        except RecursionError:
            self.errors.append((self.tokens[start].start, self.now.end, "nested too deeply"))
        bad = Node("Bad_Decl", self.tokens[start].start, self.tokens[start].end)
        self.i = max(self.i, start)
        while self.now.kind not in ("Period", "EOF"):
            self.take()
        self.op("Period")
        return [self.close(bad)]

    def block(self, out: Node, role: str, ends: tuple[str, ...]) -> None:
        while self.now.kind != "EOF" and self.compound()[0] not in ends:
            for n in self.safely():
                out.add(role, n)

    def statement(self) -> Node | list[Node]:
        from . import statements

        word, k = self.compound()
        rule = statements.RULES.get(word)
        if rule and not (self.ahead(k).kind in ("Equal", "Arrow", "StaticArrow") or self.ahead(k).kind == "LParen" and self.touches(k) and word not in ("DATA", "FINAL")):
            return rule(self)
        if word in ("DATA", "FINAL") or word == "FIELD-SYMBOL":
            return statements.inline_declaration(self)
        return statements.plain(self)


def parse(source: str | bytes) -> tuple[Node, list[tuple[int, int, str]]]:
    """The file's tree and its diagnostics as (start, end, message)."""
    parser = Parser(source)
    return parser.parse(), parser.errors


def parse_select(text: str) -> Node:
    """One SELECT statement; raises SyntaxProblem with its place."""
    parser = Parser(text if text.rstrip().endswith(".") else text + ".")
    out = parser.select()
    if parser.errors:
        raise ValueError(parser.errors[0][2])
    return out


def parse_logic(text: str) -> Node:
    return Parser(text).logic()
