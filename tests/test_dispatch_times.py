"""Dispatch of messages whose times go back."""

from loomline.streaming import dispatch, framed, messages

from .test_framed import body, log


def test_a_message_of_an_earlier_time_is_answered(spark, tmp_path):
    bodies = [body(1, 0, "initialize", at=10**9), body(2, 1, "initialize", at=0), body(1, 2, "textDocument/hover", at=0), body(2, 3, "shutdown", at=10**8)]
    cut = len(b"".join(b"Content-Length: %d\r\n\r\n%s" % (len(b.encode()), b.encode()) for b in bodies[:1]))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for upto in (cut, None):
            log(tmp_path / "log", bodies, upto)
            out = dispatch.dispatched(dispatch.messages_of(framed.read_log(spark, str(tmp_path / "log")), late=None), 60_000, timed=False)
            messages.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "check"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {r.seq: r.code for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: 0, 1: 0, 2: 0, 3: -32002}
