"""Code analytics on the fixture corpus, against answers worked out by hand."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators import code
from loomline.sources import corpus
from loomline.streaming import messages

from .small_corpus import FIXTURE, fixture


def asked(spark, file, marker, **more):
    """One asked place: where the marker stands in a fixture file."""
    row = (sorted(FIXTURE).index(file) + 1, len(FIXTURE[file][: FIXTURE[file].index(marker)].encode()), *more.values())
    return spark.createDataFrame([row], "file_id long, offset int" + "".join(f", {k} string" for k in more))


def test_visible_before_the_place_only(spark):
    got = {r.name for r in code.visible_at(code.project_symbols(fixture(spark)), 4, [FIXTURE["zmain"].index("DATA(gv_four")]).collect()}
    assert {"gv_one", "gv_two", "gv_three", "gv_inc", "ty_line", "gs_line"} <= got
    assert not {"gv_four", "run"} & got


def test_problems(spark):
    got = {(r.file_id, r.message) for r in code.project_diagnostics(fixture(spark)).where("phase <> 'syntax'").collect()}
    assert got == {
        (2, "Duplicate symbol 't'"),
        (2, "include 'znowhere' not found"),
        (4, "'gv_four' is no class or interface; '=>' needs one"),
    }


def test_members_by_access(spark):
    got = {(r.name, r.label) for r in code.members(code.symbols(fixture(spark)), spark.createDataFrame([(1, "zcl", "=>"), (1, "lo", "->"), (3, "gs_line", "-")], "file_id long, name string, access string")).collect()}
    assert got == {("zcl", "make"), ("lo", "make"), ("lo", "run"), ("lo", "attr"), ("gs_line", "key"), ("gs_line", "name")}


def test_hover_and_node(spark):
    assert code.hover_text(code.lookup(code.symbols(fixture(spark)), asked(spark, "zmain", "p_in }", name="P_IN"))).first().hover == "(parameter) p_in TYPE i"
    assert {r.kind for r in code.enclosing(code.nodes(fixture(spark)), asked(spark, "zmain", "p_in }")).collect()} == {"Form_Decl"}


def test_semantic_tokens_decode_to_places(spark):
    rows = code.semantic_tokens(fixture(spark)).orderBy("file_id", "line", "column").collect()
    at = {}
    for r in rows:
        line, column = at.get(r.file_id, (0, 0))
        line, column = line + r.delta_line, r.delta_column + (column if r.delta_line == 0 and r.file_id in at else 0)
        assert (line, column) == (r.line, r.column)
        at[r.file_id] = line, column


def test_include_cycle_ends(spark):
    files = spark.createDataFrame([(1, "a", "INCLUDE b. DATA x TYPE i."), (2, "b", "INCLUDE a. DATA y TYPE i.")], "file_id long, name string, content string")
    got = {(r.root_id, r.file_id) for r in code.expanded(files).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (2, 1)}


def test_long_include_chains_are_followed_to_the_end(spark):
    rows = [(i, f"f{i}", f"INCLUDE f{i + 1}." if i < 55 else "DATA last TYPE i.") for i in range(1, 56)]
    files = spark.createDataFrame(rows, "file_id long, name string, content string")
    assert {r.file_id for r in code.expanded(files).where("root_id = 1").collect()} == set(range(1, 56))


def test_index_of_an_export(spark, tmp_path):
    base = tmp_path / "Package" / "%2FNS%2FPKG" / "Source Code Library"
    for name in ("Includes/%2FNS%2FINC.abap", "Programs/ZREP/ZREP.ABAP", "Programs/ZREP/Includes/ZTOP.abap", "Function Groups/ZFG/Function Modules/ZDO.abap", "Programs/ZREP/notes.txt"):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text("REPORT x.")
    files = corpus.read_folder(spark, str(tmp_path), recursive=True)
    objects, edges, errors = corpus.index(files)
    assert {(r.kind, r.name) for r in objects.collect()} >= {("include", "/NS/INC"), ("report", "ZREP"), ("include", "ZTOP"), ("function_module", "ZDO"), ("package", "/NS/PKG")}
    assert errors.count() == 0 and edges.count() >= 3
    corpus.write_index(str(tmp_path / "index"), files, objects, edges)
    assert spark.read.parquet(str(tmp_path / "index" / "src_file")).count() == 4


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=12), min_size=1, max_size=6))
def test_escapes_are_undone(spark, parts):
    df = spark.createDataFrame([(p,) for p in parts], "t string")
    for escape, undo in ((text.segment_escape, text.path_unescape), (text.query_escape, text.query_unescape), (text.path_encode, text.url_decode)):
        assert [r.x for r in df.select(undo(escape("t")).alias("x")).collect()] == parts


def test_strict_and_lenient_decoding(spark):
    row = spark.range(1).select(text.path_unescape(F.lit("%zz")).alias("s"), text.url_decode(F.lit("%zz%41")).alias("l"), text.filename_of(F.lit("file:///d%3A/x/Y.ABAP")).alias("n")).first()
    assert (row.s, row.l, row.n) == (None, "%zzA", "y")


def test_frames_survive_any_cut():
    whole = messages.frame({"id": 1}) + messages.frame({"text": "é"})
    for cut in range(len(whole)):
        assert len(list(messages.texts([whole[:cut], whole[cut:]]))) == 2


def test_message_gate(spark):
    rows = [(i, f'{{"jsonrpc":"2.0","id":"{i}","method":"{m}","params":"{{}}"}}') for i, m in enumerate(["textDocument/hover", "initialize", "textDocument/hover", "shutdown", "textDocument/hover"])]
    got = messages.answered(messages.parsed(spark.createDataFrame(rows, "seq long, body string")))
    assert [r.seq for r in got.orderBy("seq").collect()] == [1, 2]


def test_few_splits_are_dealt_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    one, many = spark.range(100).coalesce(1), spark.range(100).repartition(cores + 3)
    assert corpus.spread(one).rdd.getNumPartitions() == cores and corpus.spread(one).count() == 100
    assert corpus.spread(many) is many
