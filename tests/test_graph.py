"""Include graph, containment index, chains and scopes against plain Python and answers worked out by hand."""

import random

from pyspark.sql import functions as F

from loomline.operators import code, include_graph
from loomline.operators.containment import containing


def files_of(spark, texts):
    return spark.createDataFrame([(i, f"f{i}", t) for i, t in texts.items()], "file_id long, name string, content string")


def expansion(texts, root, seen=()):
    """(position, file, name) of every declaration by following every path."""
    out = []
    at = 0
    for line in texts[root].split("\n"):
        word = line.rstrip(".").split(" ")
        if word[0] == "DATA":
            out.append(((at,), root, word[1]))
        elif word[0] == "INCLUDE" and int(word[1][1:]) in texts and int(word[1][1:]) not in (*seen, root):
            out += [((at, *p), f, n) for p, f, n in expansion(texts, int(word[1][1:]), (*seen, root))]
        at += len(line) + 1
    return out


def graph(rng, n, cyclic):
    texts = {}
    for i in range(n):
        lines = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.5:
                to = rng.randrange(n) if cyclic else rng.randint(i + 1, n + 1)
                lines.append(f"INCLUDE f{to}.")
            else:
                lines.append(f"DATA n{rng.randrange(6)} TYPE i.")
        texts[i] = "\n".join(lines)
    return texts


def test_first_and_visible_names_equal_those_of_all_paths(spark):
    rng = random.Random(4)
    for cyclic in (False, True):
        texts = graph(rng, 7, cyclic)
        files = files_of(spark, texts)
        contributed, edges = code.merged_names(files)
        got = {(r.of, r.name): r.first.file_id for r in include_graph.summary(contributed).collect()}
        want = {}
        for i in texts:
            for position, f, n in sorted(expansion(texts, i)):
                want.setdefault((i, n), f)
        assert got == want
        if not cyclic:
            asked = [(i, [len(t.encode())]) for i, t in texts.items()] + [(i, [t.index("\n") + 1]) for i, t in texts.items() if "\n" in t]
            seen = {(r.root_id, tuple(r.place), r.name): (r.file_id, r.start) for r in include_graph.visible(contributed, edges, spark.createDataFrame(asked, "root_id long, place array<int>")).collect()}
            last = {}
            for i, place in asked:
                for position, f, n in sorted(expansion(texts, i)):
                    if position < tuple(place):
                        last[i, tuple(place), n] = (f, position[-1])
            assert seen == last


def test_diamonds_cost_their_edges(spark):
    """2**20 paths; rows are include statements times names."""
    texts, rungs = {}, 20
    for k in range(rungs):
        texts[3 * k] = f"INCLUDE f{3 * k + 1}.\nINCLUDE f{3 * k + 2}."
        texts[3 * k + 1] = texts[3 * k + 2] = f"INCLUDE f{3 * k + 3}."
    texts[3 * rungs] = "DATA deep TYPE i."
    contributed, edges = code.merged_names(files_of(spark, texts))
    assert contributed.count() == 1 + edges.count() == 1 + 4 * rungs
    assert {r.file_id for r in contributed.where("first.file_id = 60").collect()} == set(texts)


def test_a_place_inside_an_include_sees_what_its_root_declared(spark):
    texts = {0: "DATA a TYPE i.\nINCLUDE f1.\nDATA b TYPE i.", 1: "DATA c TYPE i.\nDATA a TYPE p.\nDATA d TYPE i."}
    contributed, edges = code.merged_names(files_of(spark, texts))
    asked = spark.createDataFrame([(0, [15, 15]), (0, [15, 40]), (0, [27])], "root_id long, place array<int>")
    got = {}
    for r in include_graph.visible(contributed, edges, asked).collect():
        got.setdefault(tuple(r.place), {})[r.name] = r.file_id
    assert got == {(15, 15): {"a": 0, "c": 1}, (15, 40): {"a": 1, "c": 1, "d": 1}, (27,): {"a": 1, "c": 1, "d": 1}}


def test_uses_are_judged_in_every_root(spark):
    texts = {0: "CLASS k DEFINITION. ENDCLASS.\nINCLUDE f2.", 1: "DATA k TYPE i.\nINCLUDE f2.", 2: "k=>go( ).", 3: "INCLUDE f2."}
    found = {(r.file_id, r.message) for r in code.project_diagnostics(files_of(spark, texts)).collect()}
    assert found == {(2, "'k' is no class or interface; '=>' needs one")}
    del texts[1]
    assert code.project_diagnostics(files_of(spark, texts)).count() == 0


def test_containment_equals_comparing_all(spark):
    rng = random.Random(7)
    ends = [(f, n, a := rng.choice([0, 1, 5, rng.randrange(5000)]), a + rng.choice([-1, 0, 1, 6, rng.randrange(4000)])) for f in (1, 2) for n in range(150)] + [(1, 999, 0, 2**31 - 2)]
    places = [(f, rng.randrange(9000)) for f in (1, 2, 3) for _ in range(60)] + [(1, 2**31 - 2), (1, 0)]
    got = containing(spark.createDataFrame(ends, "file_id long, n int, start int, end int"), spark.createDataFrame(places, "file_id long, offset int"))
    want = sorted((f, n, p) for f, n, a, b in ends for g, p in places if f == g and a <= p <= b)
    assert sorted((r.file_id, r.n, r.offset) for r in got.collect()) == want


def test_many_places_of_one_long_file(spark):
    text = "REPORT z.\n" + "".join(f"DATA v{k} TYPE i.\n" for k in range(5000))
    places = [(1, 10 + text[10:].find(f"v{k} ")) for k in range(0, 5000, 50)]
    got = code.node_at(code.nodes(files_of(spark, {1: text})), spark.createDataFrame(places, "file_id long, offset int")).collect()
    assert {(r.kind, r.name) for r in got} == {("Data_Typed_Decl", f"v{k}") for k in range(0, 5000, 50)}


def test_a_local_that_shadows_a_constant(spark):
    text = "CONSTANTS x TYPE i VALUE 1.\nFORM f.\n  DATA x TYPE i.\n  x = 2.\nENDFORM.\nx = 3.\n"
    got = {r.start: (r.type, r.modifiers) for r in code.semantic_tokens(files_of(spark, {1: text})).collect() if text[r.start : r.start + r.length] == "x"}
    at = [i for i in range(len(text)) if text[i] == "x" and not text[i - 1].isalnum() and not text[i + 1].isalnum()]
    assert [got[i] for i in at] == [("variable", 5), ("variable", 1), ("variable", 0), ("variable", 4)]


def test_members_of_a_local(spark):
    text = "TYPES: BEGIN OF ty, a TYPE i, b TYPE i, END OF ty.\nDATA gs TYPE i.\nFORM f.\n  DATA gs TYPE ty.\n  CLEAR gs.\nENDFORM.\n"
    asked = spark.createDataFrame([(1, text.index("CLEAR"), "GS", "-"), (1, text.index("FORM") - 1, "gs", "-")], "file_id long, offset int, name string, access string")
    assert sorted(r.label for r in code.members(code.symbols(files_of(spark, {1: text})), asked).collect()) == ["a", "b"]


def test_inheritance_in_circles_ends(spark):
    text = "".join(f"CLASS c{k} DEFINITION INHERITING FROM c{(k + 1) % 3}. PUBLIC SECTION. DATA a{k} TYPE i. ENDCLASS.\n" for k in range(3)) + "DATA lo TYPE REF TO c1.\n"
    asked = spark.createDataFrame([(1, len(text), "lo->"), (1, len(text), "lo->a2"), (1, len(text), "no chain")], "file_id long, offset int, text string")
    got = sorted((r.text, r.label) for r in code.chain_members(code.symbols(files_of(spark, {1: text})), asked).collect())
    assert got == [("lo->", "a0"), ("lo->", "a1"), ("lo->", "a2"), ("lo->a2", "a2")]


def test_graphs_of_nothing(spark):
    files = files_of(spark, {1: ""}).where("false")
    assert code.merged_names(files)[0].count() == 0 and code.expanded(files).count() == 0 and code.semantic_tokens(files).count() == 0
    assert containing(spark.createDataFrame([], "file_id long, start int, end int"), spark.createDataFrame([], "file_id long, offset int")).count() == 0
