"""Framed logs as sources, and dispatch by keyed state, over every way of cutting them."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.streaming import dispatch, framed, messages


def body(client, seq, method, at=None, id_=True):
    return json.dumps({"client": client, "seq": seq, "at": 10**12 + (seq * 1000 if at is None else at), "id": seq if id_ else None, "method": method})


def log(folder, bodies, upto=None):
    folder.mkdir(exist_ok=True)
    data = b"".join(b"Content-Length: %d\r\n\r\n%s" % (len(b.encode()), b.encode()) for b in bodies)
    (folder / "a").write_bytes(data[:upto])
    return len(data)


def test_every_cut_gives_whole_frames_once(tmp_path):
    bodies = ["{}", "é" * 300, "Content-Length: 3\r\n\r\nabc", ""]
    whole = log(tmp_path / "x", bodies)
    reader = framed.LogStreamReader({"path": str(tmp_path / "x"), "chunk": "1"})
    for cut in range(0, whole + 1, 7):
        log(tmp_path / "x", bodies, cut)
        reader.known = {}
        middle = reader.latestOffset()
        first = [b for p in reader.partitions({}, middle) for _, _, b in reader.read(p)]
        log(tmp_path / "x", bodies)
        again = framed.LogStreamReader({"path": str(tmp_path / "x")})  # restarted: knows its checkpoint only
        rest = [b for p in again.partitions(middle, again.latestOffset()) for _, _, b in again.read(p)]
        assert first + rest == bodies


def test_a_frame_without_a_length_is_an_error(tmp_path):
    (tmp_path / "a").write_bytes(b"Nothing: 3\r\n\r\nabc")
    with pytest.raises(ValueError, match="byte 0"):
        framed.LogStreamReader({"path": str(tmp_path)}).latestOffset()


def test_batches_read_the_same_log(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"), F.col("id").alias("seq"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("body"))
    framed.write_log(rows, str(tmp_path / "log"), 0.5)
    half = framed.read_log(spark, str(tmp_path / "log"), stream=False, chunk=1000).count()
    framed.write_log(rows, str(tmp_path / "log"))
    got = framed.read_log(spark, str(tmp_path / "log"), stream=False, chunk=1000)
    assert 0 < half < 200 and sorted(len(r.body) for r in got.collect()) == list(range(200)) and got.rdd.getNumPartitions() > 3


def test_phases_and_errors():
    N, R, E = dispatch.NEW, dispatch.RUNNING, dispatch.ENDED
    assert dispatch.answer(N, "textDocument/hover", 1) == (N, dispatch.NOT_INITIALIZED)
    assert dispatch.answer(N, "initialize", 1) == (R, 0) and dispatch.answer(R, "initialize", 2) == (R, dispatch.INVALID)
    assert dispatch.answer(R, "no/such", 1) == (R, dispatch.UNKNOWN_METHOD) and dispatch.answer(R, "textDocument/didOpen", None) == (R, None)
    assert dispatch.answer(R, "shutdown", 1) == (E, 0) and dispatch.answer(E, "textDocument/hover", 1) == (E, dispatch.INVALID) and dispatch.answer(E, "exit", None) == (N, None)
    assert dispatch.answer(R, None, None) == (R, dispatch.PARSE_ERROR)
    assert json.loads(dispatch.error(3, dispatch.UNKNOWN_METHOD))["error"] == {"code": -32601, "message": "Method not found"} and json.loads(dispatch.notify("a", {}))["method"] == "a"


@pytest.mark.parametrize("cuts", [(None,), (200, 431, None)])
def test_replies_don_t_depend_on_batches(spark, tmp_path, cuts):
    talk = [(1, "initialize"), (2, "textDocument/hover"), (1, "textDocument/hover"), (2, "initialize"), (1, "shutdown"), (1, "textDocument/hover"), (2, "x"), (1, "exit"), (1, "initialize")]
    bodies = [body(c, i, m, id_=m != "exit") for i, (c, m) in enumerate(talk)] + [body(1, 9, "textDocument/hover", at=10_000_000)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for cut in cuts:
            log(tmp_path / "log", bodies, cut)
            out = dispatch.dispatched(dispatch.messages_of(framed.read_log(spark, str(tmp_path / "log"))), 60_000)
            messages.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "check"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.seq: r.code for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 0, 1: -32002, 2: 0, 3: 0, 4: 0, 5: -32600, 6: -32601, 8: 0, 9: -32002}
