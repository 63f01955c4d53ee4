"""Code analytics: a corpus of source files as tables of tokens, nodes, symbols and diagnostics, and the editor's questions as queries on them.

Each file is read by one task, whole; everything after is relational. The input is a DataFrame with file_id, name and
content (text or bytes).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lexer import tokenize
from ..plans.syntax import Node, parse
from .chains import all_members, allowed, chained
from .containment import containing
from .include_graph import contributions, least_paths, meanings, summary
from .include_graph import visible as visible_names
from .itab import checkpointed, merged
from .symbols import Resolver

TOKENS = "file_id long, ord int, kind string, lit string, start int, end int"
NODES = "file_id long, node_id int, parent_id int, depth int, role string, ord int, kind string, name string, start int, end int, attrs string"
SYMBOLS = (
    "file_id long, ord int, scope_id int, parent_scope_id int, name string, kind string, start int, end int, type string, type_name string, "
    "visibility string, static boolean, is_chained boolean, child_scope_id int, detail string"
)
DIAGNOSTICS = "file_id long, phase string, start int, end int, message string"
INCLUDES = "file_id long, name string, start int, end int"


def _per_file(files: DataFrame, schema: str, rows) -> DataFrame:
    """rows(content) gives tuples without the file's id."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_id, content in zip(b.column(0), b.column(1)):
                got = [(file_id.as_py(), *r) for r in rows(content.as_py() or "")]
                for at in range(0, len(got), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got[at : at + 10_000]), types)], names)

    return files.select(F.col("file_id").cast("long").alias("file_id"), "content").mapInArrow(run, schema)


def tokens(files: DataFrame) -> DataFrame:
    return _per_file(files, TOKENS, lambda text: [(i, t.kind, t.text, t.start, t.end) for i, t in enumerate(tokenize(text)[0]) if t.kind != "EOF"])


def _flat(tree: Node) -> Iterator[tuple]:
    stack, count = [(tree, -1, 0, "", 0)], 0
    while stack:
        node, parent, depth, role, ord_ = stack.pop()
        attrs = {k: v for k, v in node.attrs.items() if isinstance(v, (str, bool, int, list)) and v not in ("", None, False, [])}
        yield count, parent, depth, role, ord_, node.kind, str(node["name"]).lower() if node["name"] else None, node.start, node.end, json.dumps(attrs, sort_keys=True)
        stack += [(n, count, depth + 1, r, k) for k, (r, n) in reversed(list(enumerate(node.parts)))]
        count += 1


def nodes(files: DataFrame) -> DataFrame:
    return _per_file(files, NODES, lambda text: _flat(parse(text)[0]))


def _resolved(text):
    tree, errors = parse(text)
    return Resolver().file(tree), errors


def symbols(files: DataFrame) -> DataFrame:
    def rows(text):
        for i, s in enumerate(_resolved(text)[0].symbols):
            yield i, s.scope, s.parent_scope, s.name, s.kind, s.start, s.end, s.type, s.type_name, s.visibility, s.static, s.chained, s.child_scope, s.detail

    return _per_file(files, SYMBOLS, rows)


def symbols_once(files: DataFrame) -> DataFrame:
    """symbols, written down: for questions that read them several times, as each reading would parse all files again."""
    return checkpointed(symbols(files))


def diagnostics(files: DataFrame) -> DataFrame:
    """Syntax and semantic problems of each file alone; `project_diagnostics` adds what includes bring."""

    def rows(text):
        got, errors = _resolved(text)
        yield from (("syntax", a, b, m) for a, b, m in errors)
        yield from (("semantic", a, b, m) for a, b, m in got.problems)

    return _per_file(files, DIAGNOSTICS, rows)


def includes(files: DataFrame) -> DataFrame:
    return _per_file(files, INCLUDES, lambda text: _resolved(text)[0].includes)


def duplicate_symbols(symbols_: DataFrame) -> DataFrame:
    """Each declaration of a name after the first in its scope."""
    w = Window.partitionBy("file_id", "scope_id", "name").orderBy("ord")
    return symbols_.withColumn("n", F.row_number().over(w)).where("n > 1").drop("n")


def current_symbols(symbols_: DataFrame) -> DataFrame:
    """The declaration that stands for each name: the last."""
    last = symbols_.groupBy("file_id", "scope_id", "name").agg(F.max("ord").alias("ord"))
    return merged(symbols_, last, ["file_id", "scope_id", "name", "ord"], "left_semi")


# Includes -----------------------------------------------------------------------------------------------


def include_edges(files: DataFrame) -> DataFrame:
    """file_id, included_id, name, start, end; included_id is null where the include is missing."""
    names = files.select(F.col("file_id").cast("long").alias("included_id"), F.lower("name").alias("name"))
    return includes(files).join(names, "name", "left").select("file_id", "included_id", "name", "start", "end")


def missing_includes(files: DataFrame) -> DataFrame:
    return include_edges(files).where("included_id is null").select("file_id", F.lit("project").alias("phase"), "start", "end", F.concat(F.lit("include '"), "name", F.lit("' not found")).alias("message"))


def expanded(files: DataFrame) -> DataFrame:
    """root_id, file_id, path: every file that a root reaches, with the places on the way to where it first stands.

    path orders declarations across files: an include's declarations stand where its statement does. A file already on its own
    way is not entered again, so cycles end.
    """
    edges = checkpointed(include_edges(files).where("included_id is not null").select("file_id", "included_id", "start"))
    return least_paths(files.select(F.col("file_id").cast("long").alias("file_id")), edges)


def project_symbols(files: DataFrame) -> DataFrame:
    """Global symbols of each root with its includes merged in, each at its first place: position, an array, orders them; the first of a name wins a merge."""
    own = symbols(files).where("scope_id = 0 and kind <> 'include'")
    every = expanded(files).join(own, "file_id").withColumn("position", F.concat("path", F.array("start")))
    return every.select("root_id", "file_id", "name", "kind", "type", "type_name", "start", "end", "position")


def visible_at(project: DataFrame, root_id: int, position: list[int]) -> DataFrame:
    """Global symbols that a root's place sees, from project_symbols: all whose first place is before it, the last of a name."""
    before = project.where((F.col("root_id") == root_id) & (F.col("position") < F.array(*map(F.lit, position))))
    return before.groupBy("name").agg(F.max_by(F.struct("file_id", "kind", "type", "type_name", "start"), "position").alias("s")).select("name", "s.*")


def merged_names(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each file's places bring (include_graph.contributions), and the include statements."""
    edges = checkpointed(include_edges(files).where("included_id is not null").select("file_id", "included_id", "start"))
    own = symbols(files).where("scope_id = 0 and kind <> 'include'")
    return contributions(files, own, edges), edges


def first_declarers(files: DataFrame) -> DataFrame:
    """file_id, name, declared_in, kind, start: for each file the first declaration of every name in it and its includes."""
    return summary(merged_names(files)[0]).select(F.col("of").alias("file_id"), "name", F.col("first.file_id").alias("declared_in"), F.col("first.kind").alias("kind"), F.col("first.start").alias("start"))


def visible(files: DataFrame, asked: DataFrame) -> DataFrame:
    """What every asked place (root_id, place) sees: root_id, place, name and the last declaration before it."""
    contributed, edges = merged_names(files)
    return visible_names(contributed, edges, asked).drop("end")


def merge_symbols(target: DataFrame, source: DataFrame) -> DataFrame:
    """Both tables' symbols; of a name in both, the target's."""
    return target.unionByName(source.join(target.select("name").distinct(), "name", "left_anti").select(*target.columns))


def static_uses(files: DataFrame) -> DataFrame:
    def rows(text):
        return ((name, a, b) for name, a, b, _ in _resolved(text)[0].uses)

    return _per_file(files, "file_id long, name string, start int, end int", rows)


def project_diagnostics(files: DataFrame) -> DataFrame:
    """Every file's own problems, missing includes, and uses of `=>` on names that another file of a root declares as something else."""
    contributed, edges = merged_names(files)
    bad = meanings(contributed, edges, static_uses(files)).where("kind not in ('class', 'interface')").select("file_id", "name", "start", "end").distinct()
    message = F.concat(F.lit("'"), "name", F.lit("' is no class or interface; '=>' needs one"))
    found = bad.select("file_id", F.lit("project").alias("phase"), "start", "end", message.alias("message"))
    return diagnostics(files).unionByName(missing_includes(files)).unionByName(found)


# The editor's questions ---------------------------------------------------------------------------------

ENCLOSING = ("Form_Decl", "Class_Def_Decl", "Class_Impl_Decl", "Interface_Decl", "Method_Impl", "Event_Block", "Module_Decl")


def node_at(nodes_: DataFrame, asked: DataFrame) -> DataFrame:
    """The deepest node around each asked place (file_id, offset)."""
    joined = containing(nodes_.select("file_id", "node_id", "depth", "kind", "name", "start", "end"), asked)
    top = joined.groupBy("file_id", "offset").agg(F.max_by(F.struct("node_id", "kind", "name", "start", "end"), F.struct("depth", "node_id")).alias("n"))
    return top.select("file_id", "offset", "n.*")


def enclosing(nodes_: DataFrame, asked: DataFrame) -> DataFrame:
    """All forms, classes, methods, events and modules around each asked place, outermost first."""
    return containing(nodes_.where(F.col("kind").isin(*ENCLOSING)), asked).select("file_id", "offset", "depth", "kind", "name", "start", "end")


def scopes_at(symbols_: DataFrame, asked: DataFrame) -> DataFrame:
    """file_id, offset, scope_id, rank: scopes that a place sees, innermost first; rank 0 is the innermost."""
    bodies = symbols_.where("child_scope_id >= 0 and kind in ('form', 'method_body', 'event', 'module', 'class', 'interface')").select("file_id", "start", "end", "child_scope_id")
    mine = containing(bodies, asked).select("file_id", "offset", F.col("child_scope_id").alias("scope_id"), (F.col("end") - F.col("start")).alias("size"))
    # A method's body sees its parameters and its class: both scopes stand above it.
    parents = symbols_.select("file_id", "scope_id", F.col("parent_scope_id").alias("parent")).distinct()
    known = mine.select("file_id", "offset", "scope_id", "size")
    for k in range(1, 4):  # the grammar nests no deeper: a method's body, its parameters, its class, the file
        up = merged(mine, parents, ["file_id", "scope_id"]).where("parent > 0").select("file_id", "offset", F.col("parent").alias("scope_id"), (F.col("size") + k).alias("size"))
        known, mine = known.unionByName(up), up
    global_ = asked.select("file_id", "offset", F.lit(0).alias("scope_id"), F.lit(2_000_000_000).alias("size"))
    best = known.unionByName(global_).groupBy("file_id", "offset", "scope_id").agg(F.min("size").alias("size"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("file_id", "offset").orderBy("size", "scope_id")) - 1).drop("size")


def lookup(symbols_: DataFrame, asked: DataFrame) -> DataFrame:
    """The symbol that a name (file_id, offset, name) means at its place; the innermost scope decides."""
    wanted = asked.withColumn("name", F.lower("name"))
    cand = merged(scopes_at(symbols_, asked.select("file_id", "offset").distinct()), current_symbols(symbols_), ["file_id", "scope_id"])
    hit = merged(wanted, cand, ["file_id", "offset", "name"])
    best = hit.groupBy("file_id", "offset", "name").agg(F.min_by(F.struct("kind", "type", "type_name", "scope_id", "start", "end", "detail", "child_scope_id", "static"), "rank").alias("s"))
    return best.select("file_id", "offset", "name", "s.*")


def hover_text(found: DataFrame) -> DataFrame:
    """found with `hover`: a line that describes the symbol."""
    typed = F.when(F.col("type_name") != "", F.concat(F.lit(" TYPE "), "type_name")).otherwise("")
    text = (
        F.when(F.col("kind") == "form", F.concat(F.lit("FORM "), "name", F.when(F.col("detail") != "", F.concat(F.lit(" "), "detail")).otherwise("")))
        .when(F.col("kind") == "method", F.concat(F.lit("METHOD "), "name", F.when(F.col("detail") != "", F.concat(F.lit(" "), "detail")).otherwise("")))
        .when(F.col("kind") == "class", F.concat(F.lit("CLASS "), "name", F.when(F.col("detail") != "", F.concat(F.lit(" INHERITING FROM "), "detail")).otherwise("")))
        .when(F.col("kind").isin("interface", "event", "module", "report", "include"), F.concat(F.upper("kind"), F.lit(" "), "name"))
        .otherwise(F.concat(F.lit("("), "kind", F.lit(") "), "name", typed))
    )
    return found.withColumn("hover", text)


#: The words that completion offers.
KEYWORDS = (
    "DATA", "TYPES", "CONSTANTS", "FIELD-SYMBOLS", "CONTROLS", "PARAMETERS", "SELECT-OPTIONS", "TABLES", "REPORT", "PROGRAM", "INCLUDE", "FORM", "ENDFORM", "PERFORM",
    "START-OF-SELECTION", "END-OF-SELECTION", "INITIALIZATION", "AT SELECTION-SCREEN", "TOP-OF-PAGE", "END-OF-PAGE", "FUNCTION", "ENDFUNCTION", "METHOD", "ENDMETHOD",
    "METHODS", "CLASS", "ENDCLASS", "INTERFACE", "ENDINTERFACE", "MODULE", "ENDMODULE", "DEFINITION", "IMPLEMENTATION", "IF", "ELSE", "ELSEIF", "ENDIF", "CASE", "WHEN",
    "ENDCASE", "DO", "ENDDO", "WHILE", "ENDWHILE", "LOOP", "ENDLOOP", "AT", "ENDAT", "CHECK", "EXIT", "CONTINUE", "RETURN", "SET PF-STATUS", "SET TITLEBAR",
    "SET CURSOR FIELD", "SET SCREEN", "SELECT", "ENDSELECT", "FROM", "INTO", "WHERE", "ORDER BY", "GROUP BY", "HAVING", "INSERT", "UPDATE", "MODIFY TABLE", "MODIFY SCREEN",
    "DELETE", "LEAVE PROGRAM", "CONDENSE", "APPEND", "COLLECT", "READ TABLE", "SORT", "CLEAR", "REFRESH", "FREE", "TRY", "CATCH", "CLEANUP", "ENDTRY", "RAISE", "RAISING",
    "WRITE", "FORMAT", "ULINE", "SKIP", "NEW-LINE", "TYPE", "LIKE", "REF TO", "VALUE", "OPTIONAL", "DEFAULT", "BEGIN OF", "END OF", "STRUCTURE", "USING", "CHANGING",
    "IMPORTING", "EXPORTING", "RETURNING", "EXCEPTIONS", "PUBLIC SECTION", "PRIVATE SECTION", "PROTECTED SECTION", "ABSTRACT", "FINAL", "STATIC", "READ-ONLY",
    "REDEFINITION", "INTERFACES", "MOVE", "MOVE-CORRESPONDING", "ASSIGN", "UNASSIGN", "CALL", "CALL SCREEN", "CALL FUNCTION", "CALL METHOD", "ASSERT", "MESSAGE", "NEW",
    "CREATE OBJECT", "INITIAL", "IS INITIAL", "IS NOT INITIAL", "IS BOUND", "IS ASSIGNED", "AND", "OR", "NOT", "EQ", "NE", "LT", "LE", "GT", "GE", "BETWEEN", "IN", "CO",
    "CN", "CA", "NA", "CS", "NS", "CP", "NP",
)
#: Words of a keyword's spelling, for semantic tokens; the constructors' words are keywords there, too.
_WORDS = tuple(sorted({w for k in KEYWORDS for w in k.replace("-", " ").split()} | {"CONV", "COND", "SWITCH", "REDUCE", "FILTER", "CORRESPONDING", "TABLE", "MODIFY", "BY"}))
#: Item kinds of completion by symbol kind.
ITEMS = {"variable": "Variable", "struct_variable": "Struct", "type": "Struct", "struct_type": "Struct", "constant": "Constant", "struct_constant": "Constant", "form": "Function", "method": "Method", "class": "Class", "interface": "Interface", "field": "Field", "parameter": "Variable", "field_symbol": "Variable", "module": "Function", "event": "Event", "include": "File", "report": "Module", "control": "Variable"}


def completion(symbols_: DataFrame, asked: DataFrame) -> DataFrame:
    """file_id, offset, label, item, detail: keywords and every symbol that the place sees and that begins with `prefix`."""
    spark = symbols_.sparkSession
    item = F.create_map(*(x for k, v in ITEMS.items() for x in (F.lit(k), F.lit(v))))
    seen = merged(scopes_at(symbols_, asked.select("file_id", "offset").distinct()), current_symbols(symbols_), ["file_id", "scope_id"])
    names = merged(asked, seen, ["file_id", "offset"]).where("startswith(name, lower(prefix)) and kind <> 'method_body'")
    one = names.groupBy("file_id", "offset", F.col("name").alias("label")).agg(F.min_by(F.struct("kind", "type_name"), "rank").alias("s"))
    words = spark.createDataFrame([(k,) for k in KEYWORDS], "label string")
    fixed = asked.join(F.broadcast(words), F.expr("startswith(label, upper(prefix))")).select("file_id", "offset", "label", F.lit("Keyword").alias("item"), F.lit("").alias("detail"))
    kind, type_ = F.col("s.kind"), F.col("s.type_name")
    detail = F.when(kind.isin("method", "class", "interface", "form", "report", "include", "event", "module"), F.upper(kind)).when(kind == "control", "CONTROLS").when(kind == "field_symbol", F.rtrim(F.concat(F.lit("FIELD-SYMBOL "), type_))).otherwise(type_)
    return one.select("file_id", "offset", "label", F.coalesce(item[kind], F.lit("Text")).alias("item"), detail.alias("detail")).unionByName(fixed)


def members(symbols_: DataFrame, asked: DataFrame) -> DataFrame:
    """file_id, name, access, label, item for asked (file_id, name, access); with an offset, the name is looked up at its place, else among the global ones.

    access `=>` gives a class's public static members, `->` the public members of the class a variable refers to, statics
    included, `-` the components of a structure or of a variable typed as one.
    """
    current = current_symbols(symbols_)
    wanted = asked.withColumn("name", F.lower("name"))
    if "offset" in asked.columns:
        found = lookup(symbols_, wanted.select("file_id", "offset", "name").distinct())
        base = merged(wanted, found.select("file_id", "offset", "name", "kind", "type_name", "child_scope_id"), ["file_id", "offset", "name"])
    else:
        base = merged(wanted, current.where("scope_id = 0").select("file_id", "name", "kind", "type_name", "child_scope_id"), ["file_id", "name"])
    target = F.regexp_replace("type_name", "^ref to ", "")
    named = current.where("scope_id = 0 and child_scope_id >= 0").select("file_id", F.col("name").alias("target"), F.col("child_scope_id").alias("target_scope"))
    linked = merged(base.withColumn("target", target), named, ["file_id", "target"], "left").withColumn("scope_id", F.when(F.col("child_scope_id") >= 0, F.col("child_scope_id")).otherwise(F.col("target_scope")))
    inner = all_members(symbols_, current).select("file_id", "scope_id", F.col("name").alias("label"), "kind", "visibility", "static")
    got = merged(linked.drop("kind"), inner, ["file_id", "scope_id"])
    fits = allowed(F.col("access"))
    item = F.create_map(*(x for k, v in ITEMS.items() for x in (F.lit(k), F.lit(v))))
    return got.where(fits).select("file_id", "name", "access", "label", item[F.col("kind")].alias("item"))


def chain_members(symbols_: DataFrame, asked: DataFrame) -> DataFrame:
    """file_id, offset, text, label, item, type_name: what could end the chain of accesses that ends each text (file_id, offset, text)."""
    current = current_symbols(symbols_)
    places = asked.select("file_id", "offset").distinct()
    cand = merged(scopes_at(symbols_, places), current.where("kind <> 'method_body'"), ["file_id", "scope_id"])
    seen = cand.groupBy("file_id", "offset", "name").agg(F.min_by(F.struct("kind", "type_name", "child_scope_id"), "rank").alias("s")).select("file_id", "offset", "name", "s.*")
    item = F.create_map(*(x for k, v in ITEMS.items() for x in (F.lit(k), F.lit(v))))
    return chained(symbols_, current, seen, asked).select("file_id", "offset", "text", "label", item[F.col("member")].alias("item"), "type_name")


#: Semantic token types and modifiers, in the order that their numbers follow.
LEGEND = (
    "namespace", "type", "class", "enum", "interface", "struct", "typeParameter", "parameter", "variable", "property", "enumMember", "event", "function", "method", "macro",
    "keyword", "modifier", "comment", "string", "number", "regexp", "operator",
)
MODIFIERS = ("declaration", "definition", "readonly", "static", "deprecated", "abstract", "async", "modification", "documentation", "defaultLibrary")
_TYPE_OF = {"variable": "variable", "struct_variable": "variable", "constant": "variable", "struct_constant": "variable", "type": "type", "struct_type": "struct", "class": "class", "interface": "interface", "form": "function", "method": "method", "parameter": "parameter", "field": "property", "field_symbol": "variable", "module": "function", "event": "event", "include": "namespace", "report": "namespace", "control": "variable"}


def token_positions(tokens_: DataFrame, files: DataFrame) -> DataFrame:
    """tokens with line and byte column: each token meets its line's start by an as-of window over both; the tokens pass through it whole, so they are read once."""
    from ..functions.text import line_starts

    lines = line_starts(files.select("file_id", F.col("content").cast("string").alias("text")), "file_id")
    marks = lines.select("file_id", "start", F.lit(-1).alias("ord"), "line", F.col("start").alias("line_start")).unionByName(tokens_, allowMissingColumns=True)
    w = Window.partitionBy("file_id").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.withColumn("line", F.last("line", True).over(w)).withColumn("line_start", F.last("line_start", True).over(w)).where("ord >= 0")
    return filled.select(*tokens_.columns, "line", (F.col("start") - F.col("line_start")).cast("int").alias("column"))


def delta_encoded(placed: DataFrame, key: str = "file_id") -> DataFrame:
    """placed (key, line, column) with delta_line and delta_column: differences to the token before; a column counts from 0 on another line."""
    w = Window.partitionBy(key).orderBy("line", "column")
    line = F.coalesce(F.lag("line").over(w), F.lit(0))
    column = F.when(F.col("line") == F.lag("line").over(w), F.col("column") - F.lag("column").over(w)).otherwise(F.col("column"))
    return placed.withColumn("delta_line", F.col("line") - line).withColumn("delta_column", column)


def selected_names(nodes_: DataFrame) -> DataFrame:
    """file_id, start, selected: names after `-`, `->`, `=>` and `~`, a method where it is called, else a property."""
    picked = nodes_.where("kind = 'Selector_Expr' and name is not null")
    return picked.select("file_id", (F.col("end") - F.octet_length("name")).alias("start"), F.when(F.col("role") == "function", "method").otherwise("property").alias("selected"))


def semantic_tokens(files: DataFrame) -> DataFrame:
    """file_id, ord, start, line, column, delta_line, delta_column, length, type, number, modifiers: tokens that carry meaning, in editor order.

    A name is what it declares, else a member if it is selected, else the symbol of its innermost scope. modifiers is a bit set by place in MODIFIERS: declaration where the
    symbol's own name stands in its declaration, readonly for constants, static for static members.
    """
    got = token_positions(tokens(files), files)
    every = symbols_once(files)
    # A declaration's name is the first token of that name at or after the declaration's start.
    declared = every.where("kind <> 'method_body'").select("file_id", "name", F.col("start").alias("from"), F.col("end").alias("to"), F.struct("kind", "static").alias("head"))
    idents = tokens(files).where("kind = 'Ident'").select("file_id", F.lower("lit").alias("name"), "start")
    heads = merged(declared, idents, ["file_id", "name"]).where(F.col("start").between(F.col("from"), F.col("to")))
    heads = heads.groupBy("file_id", "name", "from", "head").agg(F.min("start").alias("start")).groupBy("file_id", "start").agg(F.max_by("head", "from").alias("head"))
    places = merged(idents, every.select("file_id", "name").distinct(), ["file_id", "name"], "left_semi").withColumnRenamed("start", "offset")
    found = lookup(every, places).select("file_id", F.col("offset").alias("start"), F.struct("kind", "static").alias("found"))
    joined = got
    for more in (heads, found, selected_names(nodes(files))):
        joined = merged(joined, more, ["file_id", "start"], "left")
    meant = F.when(F.col("head").isNotNull(), F.col("head")).when(F.col("selected").isNull(), F.col("found"))
    kinds = F.create_map(*(x for k, v in (_TYPE_OF | {"method_body": "method"}).items() for x in (F.lit(k), F.lit(v))))
    joined = joined.withColumn("meant", meant).withColumn("named", F.col("kind") == "Ident")
    type_ = (
        F.when(F.col("kind") == "Comment", "comment").when(F.col("kind").isin("String", "StringTemplate"), "string").when(F.col("kind") == "Number", "number")
        .when(F.col("named") & F.col("meant").isNotNull() & kinds[F.col("meant.kind")].isNotNull(), kinds[F.col("meant.kind")])
        .when(F.col("named") & F.col("selected").isNotNull(), F.col("selected")).when(F.upper("lit").isin(*_WORDS), "keyword")
    )
    bits = F.when(F.col("head").isNotNull(), 1).otherwise(0) + F.when(F.col("meant.kind").isin("constant", "struct_constant"), 4).otherwise(0) + F.when(F.col("meant.static"), 8).otherwise(0)
    known = joined.withColumn("type", type_).withColumn("modifiers", F.when(F.col("named"), bits).otherwise(0)).where("type is not null")
    number = F.create_map(*(x for i, t in enumerate(LEGEND) for x in (F.lit(t), F.lit(i))))
    return delta_encoded(known).select("file_id", "ord", "start", "line", "column", "delta_line", "delta_column", F.length("lit").alias("length"), "type", number[F.col("type")].alias("number"), "modifiers")
