"""Grammar of declarations and statements; RULES maps a statement's first word to its rule."""

from __future__ import annotations

from .syntax import EVENTS, Node, Parser, SyntaxProblem


def _name(p: Parser) -> str:
    """A declared name, with its hyphenated parts."""
    symbol = p.field_symbol()
    if symbol is not None:
        return symbol["name"]
    word, k = p.compound()
    if not k:
        raise SyntaxProblem(p.now, "expected a name")
    text = "".join(t.text for t in p.tokens[p.i : p.i + k])
    p.i += k
    return text


def inline_declaration(p: Parser) -> Node:
    target = p.inline()
    if target is None:
        return plain(p)
    p.need("Equal")
    target.add("value", p.logic())
    return p.period(target)


def plain(p: Parser) -> Node:
    """An assignment or an expression standing alone."""
    start = p.now.start
    left = p.expr()
    if p.now.kind in ("Equal", "DownCast"):
        op = p.take().text
        out = Node("Assign_Stmt", start, start, {"op": op}, [])
        out.add("target", left).add("value", p.logic())
        while p.op("Equal"):
            out.add("value", p.logic())
        return p.period(out)
    return p.period(Node("Expr_Stmt", start, start).add("expr", left))


# Types and data -----------------------------------------------------------------------------------------


def type_expr(p: Parser) -> Node:
    if p.at("REF", "TO"):
        out = p.node("Ref_Type")
        p.skip("REF", "TO")
        return p.close(out.add("target", p.postfix_type()))
    if p.at("LINE", "OF"):
        out = p.node("Line_Type")
        p.skip("LINE", "OF")
        return p.close(out.add("table", p.postfix_type()))
    kinds = [k for k in ("STANDARD", "SORTED", "HASHED", "ANY", "INDEX") if p.at(k, "TABLE")]
    if kinds or p.at("TABLE", "OF"):
        out = p.node("Table_Type", table_kind=(kinds or ["STANDARD"])[0], unique=False, keys=[], secondary={})
        if kinds:
            p.take()
        p.take()
        if p.skip("OF"):
            out.add("element", type_expr(p))
        while p.at("WITH") or p.at("INITIAL"):
            if p.skip("INITIAL", "SIZE"):
                p.expr()
                continue
            p.word("WITH")
            _key(p, out)
        return p.close(out)
    return p.postfix_type()


def _key(p: Parser, out: Node) -> None:
    if p.skip("EMPTY", "KEY") or p.skip("DEFAULT", "KEY"):
        return
    if p.skip("HEADER", "LINE"):
        return
    unique = p.skip("UNIQUE")
    if not unique:
        p.skip("NON-UNIQUE")
    hashed = p.skip("SORTED") or p.skip("HASHED")
    if unique and p.skip("DEFAULT", "KEY"):
        out.attrs["unique"] = True
        return
    p.word("KEY")
    named = hashed or p.ahead().upper == "COMPONENTS"
    name = _name(p) if named else None
    p.skip("COMPONENTS")
    columns = []
    while p.now.kind == "Ident" and not (p.at("WITH") or p.at("INITIAL") or p.at("VALUE") or p.at("READ-ONLY")):
        columns.append(_name(p))
    if name and name.lower() != "primary_key":
        out.attrs["secondary"][name.lower()] = columns
    else:
        out.attrs["unique"], out.attrs["keys"] = unique, columns


def _typing(p: Parser, out: Node) -> None:
    """TYPE, LIKE, LENGTH, DECIMALS, VALUE and READ-ONLY of one declared name."""
    if p.op("LParen"):
        out.attrs["length"] = p.need("Number").text
        p.need("RParen")
    while p.now.kind not in ("Comma", "Period", "EOF"):
        if p.skip("TYPE") or p.skip("LIKE"):
            out.add("type", type_expr(p))
        elif p.skip("LENGTH"):
            out.attrs["length"] = p.take().text
        elif p.skip("DECIMALS"):
            out.attrs["decimals"] = p.take().text
        elif p.skip("VALUE"):
            if p.skip("IS", "INITIAL"):
                out.attrs["initial"] = True
            else:
                out.add("value", p.expr())
        elif p.skip("READ-ONLY"):
            out.attrs["read_only"] = True
        elif p.skip("OPTIONAL"):
            out.attrs["optional"] = True
        elif p.skip("DEFAULT"):
            out.add("default", p.expr())
        elif p.skip("OCCURS"):
            p.expr()
        else:
            raise SyntaxProblem(p.now, "unexpected in a declaration")


def _declare(plain_kind: str, struct_kind: str, **attrs):
    """A rule for declarations that may be chained and hold structures; gives one node for each name."""

    def rule(p: Parser) -> list[Node]:
        first = p.now
        word, k = p.compound()
        inline = p.inline() if word in ("DATA", "FINAL") else None
        if inline is not None:
            p.need("Equal")
            inline.add("value", p.logic())
            return [p.period(inline)]
        p.i += k
        chained = p.op("Colon")
        out: list[Node] = []
        open_: list[Node] = []
        while True:
            if p.skip("BEGIN", "OF"):
                node = p.node(struct_kind, name="", chained=chained, **attrs)
                node.attrs["name"] = _name(p)
                open_.append(p.close(node))
            elif p.skip("END", "OF"):
                _name(p)
                if not open_:
                    raise SyntaxProblem(p.now, "END OF without BEGIN OF")
                done = p.close(open_.pop())
                (open_[-1].add("component", done) if open_ else out.append(done))
            elif p.now.kind not in ("Period", "EOF"):
                node = p.node(plain_kind, chained=chained, **attrs)
                node.attrs["name"] = _name(p)
                _typing(p, node)
                p.close(node)
                (open_[-1].add("component", node) if open_ else out.append(node))
            if p.op("Comma"):
                continue
            p.need("Period")
            if not open_:
                break
            if not p.skip(word):  # structures may also be spelled as one statement for each part
                raise SyntaxProblem(p.now, "structure is not closed")
            p.op("Colon")
        if out and not chained:  # one declaration is its whole statement; in a chain each is what stands between the commas
            out[0].start = first.start
            p.close(out[-1])
        return out

    return rule


def _field_symbols(p: Parser) -> list[Node]:
    p.i += p.compound()[1]
    p.op("Colon")
    out = []
    while True:
        node = p.node("Field_Symbol_Decl")
        node.attrs["name"] = _name(p)
        _typing(p, node)
        out.append(p.close(node))
        if not p.op("Comma"):
            p.need("Period")
            return out


def _controls(p: Parser) -> list[Node]:
    p.take()
    p.op("Colon")
    out = []
    while True:
        node = p.node("Controls_Decl")
        node.attrs["name"] = _name(p)
        p.word("TYPE")
        node.attrs["control"] = p.take().upper
        if p.skip("USING", "SCREEN"):
            node.add("screen", p.expr())
        out.append(p.close(node))
        if not p.op("Comma"):
            p.need("Period")
            return out


# Program structure --------------------------------------------------------------------------------------


def _form(p: Parser) -> Node:
    out = p.node("Form_Decl")
    p.take()
    out.attrs["name"] = _name(p)
    while p.now.upper in ("TABLES", "USING", "CHANGING", "RAISING"):
        section = p.take().upper
        while p.now.kind == "Ident" and p.now.upper not in ("TABLES", "USING", "CHANGING", "RAISING"):
            param = p.node("Form_Param", section=section)
            if p.at("VALUE") and p.ahead().kind == "LParen":
                p.i += 2
                param.attrs["name"], param.attrs["by_value"] = _name(p), True
                p.need("RParen")
            else:
                param.attrs["name"] = _name(p)
            if p.skip("TYPE") or p.skip("LIKE") or p.skip("STRUCTURE"):
                param.add("type", type_expr(p))
            out.add("param", p.close(param))
    p.need("Period")
    p.block(out, "body", ("ENDFORM",))
    p.word("ENDFORM")
    return p.period(out)


def _report(p: Parser) -> Node:
    out = p.node("Report_Decl")
    p.take()
    out.attrs["name"] = _name(p)
    while p.now.kind not in ("Period", "EOF"):
        p.take()
    return p.period(out)


def _include(p: Parser) -> Node:
    out = p.node("Include_Decl")
    p.take()
    out.attrs["name"] = _name(p)
    p.skip("IF", "FOUND")
    return p.period(out)


def _module(p: Parser) -> Node:
    out = p.node("Module_Decl")
    p.take()
    out.attrs["name"] = _name(p)
    out.attrs["direction"] = p.take().upper if p.now.upper in ("INPUT", "OUTPUT") else ""
    p.need("Period")
    p.block(out, "body", ("ENDMODULE",))
    p.word("ENDMODULE")
    return p.period(out)


def _event(p: Parser) -> Node:
    out = p.node("Event_Block")
    word, k = p.compound()
    p.i += k
    out.attrs["name"] = word
    if word == "AT":
        rest, k = p.compound()
        if rest not in ("SELECTION-SCREEN", "LINE-SELECTION", "USER-COMMAND"):
            raise SyntaxProblem(p.now, "expected SELECTION-SCREEN")
        out.attrs["name"] = f"AT {rest}"
        while p.now.kind not in ("Period", "EOF"):
            p.take()
    p.need("Period")
    stops = (*EVENTS, "AT", "FORM", "MODULE", "CLASS", "INTERFACE")
    p.block(out, "body", stops)
    return p.close(out)


def _class(p: Parser) -> Node:
    start = p.node("Class_Def_Decl")
    p.take()
    name = _name(p)
    if p.skip("IMPLEMENTATION"):
        out = Node("Class_Impl_Decl", start.start, start.end, {"name": name})
        p.need("Period")
        while not p.at("ENDCLASS") and p.now.kind != "EOF":
            if p.at("METHOD"):
                impl = p.node("Method_Impl")
                p.take()
                impl.attrs["name"] = _method_name(p)
                p.need("Period")
                p.block(impl, "body", ("ENDMETHOD",))
                p.word("ENDMETHOD")
                out.add("method", p.period(impl))
            else:
                for n in p.safely():
                    out.add("decl", n)
        p.word("ENDCLASS")
        return p.period(out)
    p.word("DEFINITION")
    out = start
    out.attrs |= {"name": name, "options": []}
    while p.now.kind not in ("Period", "EOF"):
        word, k = p.compound()
        if word == "INHERITING":
            p.i += k
            p.word("FROM")
            out.attrs["super"] = _name(p)
        elif k:
            out.attrs["options"].append(word)
            p.i += k
        else:
            p.take()
    p.need("Period")
    if {"LOAD", "DEFERRED"} & set(out.attrs["options"]):
        return p.close(out)
    _members(p, out, "ENDCLASS")
    return p.period(out)


def _method_name(p: Parser) -> str:
    text = _name(p)
    while p.now.kind in ("Tilde",):
        text += p.take().text + _name(p)
    return text


def _interface(p: Parser) -> Node:
    out = p.node("Interface_Decl")
    p.take()
    out.attrs |= {"name": _name(p), "options": []}
    while p.now.kind not in ("Period", "EOF"):
        out.attrs["options"].append(p.take().upper)
    p.need("Period")
    if {"LOAD", "DEFERRED"} & set(out.attrs["options"]):
        return p.close(out)
    _members(p, out, "ENDINTERFACE")
    return p.period(out)


def _members(p: Parser, out: Node, end: str) -> None:
    """Sections, attributes, methods, types and interfaces up to the end word; each member knows its visibility."""
    visibility = "PUBLIC"
    section = out
    while not p.at(end) and p.now.kind != "EOF":
        word, k = p.compound()
        if word in ("PUBLIC", "PROTECTED", "PRIVATE") and p.ahead().upper == "SECTION":
            visibility = word
            section = p.node("Class_Section", visibility=word)
            p.i += 2
            p.period(section)
            out.parts.append(("section", section))
            continue
        try:
            for n in _member(p, word, k, visibility):
                section.add("member", n)
        except SyntaxProblem as e:
            p.errors.append((e.token.start, e.token.end, e.message))
            while p.now.kind not in ("Period", "EOF"):
                p.take()
            p.op("Period")
    p.word(end)


def _member(p: Parser, word: str, k: int, visibility: str) -> list[Node]:
    if word in ("DATA", "CLASS-DATA", "CONSTANTS"):
        nodes = _declare("Attr_Decl", "Attr_Decl", visibility=visibility, static=word != "DATA", constant=word == "CONSTANTS")(p)
        return nodes
    if word == "TYPES":
        return RULES["TYPES"](p)
    if word in ("METHODS", "CLASS-METHODS"):
        return _methods(p, k, visibility, word == "CLASS-METHODS")
    if word == "INTERFACES":
        p.i += k
        p.op("Colon")
        out = p.node("Interfaces_Decl", names=[], visibility=visibility)
        while True:
            out.attrs["names"].append(_name(p))
            if not p.op("Comma"):
                return [p.period(out)]
    if word in ("ALIASES", "EVENTS", "CLASS-EVENTS"):
        while not p.op("Period"):
            p.take()
        return []
    raise SyntaxProblem(p.now, "unexpected in a class section")


def _methods(p: Parser, k: int, visibility: str, static: bool) -> list[Node]:
    p.i += k
    p.op("Colon")
    out = []
    sections = ("IMPORTING", "EXPORTING", "CHANGING", "RETURNING", "RAISING", "EXCEPTIONS")
    while True:
        node = p.node("Method_Decl", visibility=visibility, static=static, flags=[], raising=[])
        node.attrs["name"] = _method_name(p)
        while p.now.kind == "Ident":
            word, k = p.compound()
            if word in sections:
                p.i += k
                while p.now.kind == "Ident" and p.compound()[0] not in sections:
                    if word in ("RAISING", "EXCEPTIONS"):
                        node.attrs["raising"].append(_name(p))
                        continue
                    param = p.node("Method_Param", section=word)
                    if p.now.upper in ("VALUE", "REFERENCE") and p.ahead().kind == "LParen":
                        param.attrs["by_value"] = p.now.upper == "VALUE"
                        p.i += 2
                        param.attrs["name"] = _name(p)
                        p.need("RParen")
                    else:
                        param.attrs["name"] = _name(p)
                    if p.skip("TYPE") or p.skip("LIKE"):
                        param.add("type", type_expr(p))
                    if p.skip("OPTIONAL"):
                        param.attrs["optional"] = True
                    if p.skip("DEFAULT"):
                        param.add("default", p.expr())
                    node.add("param", p.close(param))
            elif p.skip("FOR", "TESTING"):
                node.attrs["flags"].append("FOR TESTING")
            else:
                node.attrs["flags"].append(word)
                p.i += k
        out.append(p.close(node))
        if not p.op("Comma"):
            p.need("Period")
            return out


# Control flow -------------------------------------------------------------------------------------------


def _if(p: Parser) -> Node:
    out = p.node("If_Stmt")
    p.take()
    out.add("condition", p.logic())
    p.need("Period")
    p.block(out, "then", ("ELSEIF", "ELSE", "ENDIF"))
    while p.at("ELSEIF"):
        branch = p.node("Elseif_Branch")
        p.take()
        branch.add("condition", p.logic())
        p.need("Period")
        p.block(branch, "then", ("ELSEIF", "ELSE", "ENDIF"))
        out.add("elseif", p.close(branch))
    if p.skip("ELSE"):
        p.need("Period")
        p.block(out, "else", ("ENDIF",))
    p.word("ENDIF")
    return p.period(out)


def _case(p: Parser) -> Node:
    out = p.node("Case_Stmt")
    p.take()
    out.add("on", p.expr())
    p.need("Period")
    while p.at("WHEN"):
        branch = p.node("Case_Branch", others=False)
        p.take()
        if p.skip("OTHERS"):
            branch.attrs["others"] = True
        else:
            branch.add("value", p.expr())
            while p.skip("OR"):
                branch.add("value", p.expr())
        p.need("Period")
        p.block(branch, "body", ("WHEN", "ENDCASE"))
        out.add("branch", p.close(branch))
    p.word("ENDCASE")
    return p.period(out)


def _while(p: Parser) -> Node:
    out = p.node("While_Stmt")
    p.take()
    out.add("condition", p.logic())
    p.need("Period")
    p.block(out, "body", ("ENDWHILE",))
    p.word("ENDWHILE")
    return p.period(out)


def _loop(p: Parser) -> Node:
    out = p.node("Loop_Stmt", no_fields=False, group=False, screen=False)
    p.word("LOOP", "AT")
    if p.skip("SCREEN"):
        out.attrs["screen"] = True
    else:
        out.attrs["group"] = p.skip("GROUP")
        out.add("table", p.expr())
    while p.now.kind not in ("Period", "EOF"):
        if p.skip("INTO"):
            out.add("into", p.expr())
        elif p.skip("ASSIGNING"):
            out.add("assigning", p.expr())
        elif p.skip("REFERENCE", "INTO"):
            out.attrs["reference"] = True
            out.add("into", p.expr())
        elif p.skip("FROM"):
            out.add("from", p.expr())
        elif p.skip("TO"):
            out.add("to", p.expr())
        elif p.skip("USING", "KEY"):
            out.attrs["using_key"] = _name(p)
        elif p.skip("WHERE"):
            out.add("where", p.logic())
        elif p.skip("TRANSPORTING", "NO", "FIELDS"):
            out.attrs["no_fields"] = True
        elif p.skip("GROUP", "BY"):
            if p.op("LParen"):
                while not p.op("RParen"):
                    key = p.node("Named_Arg", name=_name(p), counts="")
                    p.need("Equal")
                    for word in ("SIZE", "INDEX"):
                        if p.skip("GROUP", word):
                            key.attrs["counts"] = word
                    out.add("key", p.close(key if key["counts"] else key.add("value", p.expr())))
            else:
                out.add("key", p.expr())
        else:
            raise SyntaxProblem(p.now, "unknown clause of LOOP")
    p.need("Period")
    p.block(out, "body", ("ENDLOOP",))
    p.word("ENDLOOP")
    return p.period(out)


def _check(p: Parser) -> Node:
    out = p.node("Check_Stmt")
    p.take()
    return p.period(out.add("condition", p.logic()))


# Tables -------------------------------------------------------------------------------------------------


def _read(p: Parser) -> Node:
    if p.at("READ", "REPORT"):
        out = p.node("Read_Report_Stmt")
        p.skip("READ", "REPORT")
        out.add("program", p.expr())
        p.word("INTO")
        return p.period(out.add("into", p.expr()))
    out = p.node("Read_Table_Stmt", kind="", no_fields=False)
    p.word("READ", "TABLE")
    out.add("table", p.expr())
    while p.now.kind not in ("Period", "EOF"):
        if p.at("WITH", "KEY") or p.at("WITH", "TABLE", "KEY"):
            p.take()
            out.attrs["kind"] = "table_key" if p.skip("TABLE") else "key"
            p.word("KEY")
            if p.ahead().upper == "COMPONENTS":
                out.attrs["using_key"] = _name(p)
                p.skip("COMPONENTS")
            while p.now.kind == "Ident" and (p.ahead().kind == "Equal" or p.compound()[1] > 1):
                name = _name(p)
                part = p.node("Named_Arg", name=name)
                p.need("Equal")
                out.add("key", p.close(part.add("value", p.expr())))
        elif p.skip("INDEX"):
            out.attrs["kind"] = "index"
            out.add("index", p.expr())
        elif p.skip("USING", "KEY"):
            out.attrs["using_key"] = _name(p)
        elif p.skip("INTO"):
            out.add("into", p.expr())
        elif p.skip("ASSIGNING"):
            out.add("assigning", p.expr())
        elif p.skip("REFERENCE", "INTO"):
            out.add("into", p.expr())
        elif p.skip("TRANSPORTING", "NO", "FIELDS"):
            out.attrs["no_fields"] = True
        elif p.skip("BINARY", "SEARCH"):
            out.attrs["binary"] = True
        else:
            raise SyntaxProblem(p.now, "unknown clause of READ TABLE")
    return p.period(out)


def _delete(p: Parser) -> Node:
    out = p.node("Delete_Stmt", kind="")
    p.take()
    if p.skip("ADJACENT", "DUPLICATES", "FROM"):
        out.attrs["kind"] = "adjacent"
        out.add("table", p.expr())
        if p.skip("COMPARING"):
            if p.skip("ALL", "FIELDS"):
                return p.period(out)
            while p.now.kind == "Ident":
                out.add("comparing", p.node("Ident", name=_name(p)))
        return p.period(out)
    if p.skip("TABLE"):
        out.add("table", p.expr())
        p.word("FROM")
        out.attrs["kind"] = "line"
        return p.period(out.add("line", p.expr()))
    out.add("table", p.expr())
    if p.skip("WHERE"):
        out.attrs["kind"] = "where"
        out.add("where", p.logic())
    elif p.skip("INDEX"):
        out.attrs["kind"] = "index"
        out.add("index", p.expr())
    else:
        raise SyntaxProblem(p.now, "expected WHERE or INDEX")
    return p.period(out)


def _insert(p: Parser) -> Node:
    out = p.node("Insert_Stmt", kind="")
    p.take()
    if p.skip("INTO"):
        out.attrs["kind"] = "db_values"
        out.add("table", p.expr())
        p.word("VALUES")
        return p.period(out.add("source", p.expr()))
    if p.skip("LINES", "OF"):
        out.attrs["kind"] = "lines"
        out.add("source", p.expr())
        p.word("INTO", "TABLE")
        return p.period(out.add("table", p.expr()))
    first = p.expr()
    if p.skip("INTO", "TABLE"):
        out.attrs["kind"] = "itab"
        return p.period(out.add("source", first).add("table", p.expr()))
    if p.skip("INTO"):
        out.attrs["kind"] = "index"
        out.add("source", first).add("table", p.expr())
        p.word("INDEX")
        return p.period(out.add("index", p.expr()))
    if p.skip("FROM"):
        out.attrs["kind"] = "db_table" if p.skip("TABLE") else "db_row"
        return p.period(out.add("table", first).add("source", p.expr()))
    raise SyntaxProblem(p.now, "INSERT needs a target")


def _append(p: Parser) -> Node:
    out = p.node("Append_Stmt", kind="row")
    p.take()
    if p.skip("INITIAL", "LINE", "TO"):
        out.attrs["kind"] = "initial"
    elif p.skip("LINES", "OF"):
        out.attrs["kind"] = "lines"
        out.add("source", p.expr())
        p.word("TO")
    else:
        out.add("source", p.expr())
        p.word("TO")
    out.add("table", p.expr())
    if p.skip("ASSIGNING") or p.skip("REFERENCE", "INTO"):
        out.add("assigning", p.expr())
    return p.period(out)


def _sort(p: Parser) -> Node:
    out = p.node("Sort_Stmt", descending=None, stable=False)
    p.take()
    out.add("table", p.expr())

    def direction() -> bool | None:
        return True if p.skip("DESCENDING") else False if p.skip("ASCENDING") else None

    while p.now.kind not in ("Period", "EOF"):
        if p.skip("STABLE"):
            out.attrs["stable"] = True
        elif p.skip("BY"):
            while p.now.kind == "Ident":
                column = p.node("Ident", name=_name(p))
                column.attrs["descending"] = direction()
                out.add("by", p.close(column))
        elif (d := direction()) is not None:
            out.attrs["descending"] = d
        else:
            raise SyntaxProblem(p.now, "unknown clause of SORT")
    return p.period(out)


def _operands(kind: str):
    def rule(p: Parser) -> Node:
        out = p.node(kind)
        p.take()
        p.op("Colon")
        while True:
            out.add("operand", p.expr())
            if kind == "Condense_Stmt" and p.skip("NO-GAPS"):
                out.attrs["no_gaps"] = True
            if not p.op("Comma"):
                return p.period(out)

    return rule


# Calls, screens, messages -------------------------------------------------------------------------------


def _call(p: Parser) -> Node:
    if p.at("CALL", "FUNCTION"):
        out = p.node("Call_Function_Stmt")
        p.skip("CALL", "FUNCTION")
        out.add("function", p.expr())
        if p.skip("DESTINATION"):
            out.add("destination", p.expr())
        section = ""
        while p.now.kind not in ("Period", "EOF"):
            if p.now.upper in ("EXPORTING", "IMPORTING", "TABLES", "CHANGING", "EXCEPTIONS") and p.ahead().kind != "Equal":
                section = p.take().upper
                continue
            param = p.node("Call_Function_Param", section=section, name=_name(p))
            p.need("Equal")
            out.add("param", p.close(param.add("value", p.expr())))
        return p.period(out)
    if p.at("CALL", "SCREEN"):
        out = p.node("Call_Screen_Stmt")
        p.skip("CALL", "SCREEN")
        out.add("screen", p.expr())
    else:
        out = p.node("Expr_Stmt", generic=True)
    while p.now.kind not in ("Period", "EOF"):
        p.take()
    return p.period(out)


def _message(p: Parser) -> Node:
    out = p.node("Message_Stmt")
    p.take()
    if p.skip("ID"):
        out.add("id", p.expr())
    else:
        word = p.expr()
        out.add("text", word)
        if p.now.kind == "LParen":
            p.call(word)
    while p.now.kind not in ("Period", "EOF"):
        for key in ("TYPE", "NUMBER", "WITH", "INTO", "DISPLAY"):
            if p.at(key):
                p.take()
                if key == "DISPLAY":
                    p.word("LIKE")
                out.add(key.lower(), p.expr())
                while key == "WITH" and p.now.kind in ("Ident", "String", "Number", "StringTemplate") and p.now.upper not in ("INTO", "RAISING"):
                    out.add("with", p.expr())
                break
        else:
            if p.skip("RAISING"):
                out.attrs["raising"] = _name(p)
            else:
                raise SyntaxProblem(p.now, "unknown clause of MESSAGE")
    return p.period(out)


def _authority(p: Parser) -> Node:
    out = p.node("Authority_Check_Stmt")
    p.i += p.compound()[1]
    p.word("OBJECT")
    out.add("object", p.expr())
    while p.skip("ID"):
        out.add("id", p.expr())
        if not p.skip("DUMMY"):
            p.word("FIELD")
            out.add("field", p.expr())
    return p.period(out)


def _loose(kind: str, *words: str):
    """A statement whose words are kept but not broken down further."""

    def rule(p: Parser) -> Node:
        out = p.node(kind, words=[])
        if words:
            p.word(*words)
        while p.now.kind not in ("Period", "EOF"):
            out.attrs["words"].append(p.take().text)
        return p.period(out)

    return rule


def _select(p: Parser) -> Node:
    return p.select()


RULES = {
    "DATA": _declare("Data_Typed_Decl", "Data_Struct_Decl"), "STATICS": _declare("Data_Typed_Decl", "Data_Struct_Decl"),
    "TYPES": _declare("Types_Decl", "Types_Struct_Decl"), "CONSTANTS": _declare("Const_Decl", "Const_Struct_Decl"),
    "TABLES": _declare("Data_Typed_Decl", "Data_Struct_Decl"), "PARAMETERS": _loose("Expr_Stmt"), "SELECT-OPTIONS": _loose("Expr_Stmt"),
    "FIELD-SYMBOLS": _field_symbols, "CONTROLS": _controls, "FORM": _form, "REPORT": _report, "PROGRAM": _report, "INCLUDE": _include,
    "MODULE": _module, "CLASS": _class, "INTERFACE": _interface, "IF": _if, "CASE": _case, "WHILE": _while, "LOOP": _loop, "CHECK": _check,
    "READ": _read, "DELETE": _delete, "INSERT": _insert, "APPEND": _append, "SORT": _sort, "SELECT": _select,
    "CLEAR": _operands("Clear_Stmt"), "CONDENSE": _operands("Condense_Stmt"), "CALL": _call, "MESSAGE": _message, "AUTHORITY-CHECK": _authority,
    "SET": _loose("Set_Stmt", "SET"), "LEAVE": _loose("Leave_Program_Stmt", "LEAVE"), "MODIFY": _loose("Modify_Screen_Stmt", "MODIFY", "SCREEN"),
    "PERFORM": _loose("Expr_Stmt"), "WRITE": _loose("Expr_Stmt"), "EXIT": _loose("Expr_Stmt"), "RETURN": _loose("Return_Stmt", "RETURN"),
    "CONTINUE": _loose("Expr_Stmt"), "RAISE": _loose("Expr_Stmt"), "ASSIGN": _loose("Expr_Stmt"), "UNASSIGN": _loose("Expr_Stmt"),
    "AT": _event, **{e: _event for e in EVENTS},
}
