"""Requests of many clients answered one by one: keyed state instead of a look at all messages.

Each client is uninitialised, running or shut down. `initialize` starts it, `shutdown` ends its requests, `exit` makes it uninitialised again, and so does a pause longer
than `idle` in the messages' own times, whatever batches they come in. Every request gets one reply, a result or an error; notifications get none. A client's
messages are handled in the order of seq. With `late`, a message that comes more than that behind the newest one of an earlier batch is dropped by the watermark, and an
event-time timer drops the state of clients that have gone; without it, no message is dropped, whatever its time, and a phase and a time are kept for each client.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .messages import NOTIFICATIONS, REQUESTS

NEW, RUNNING, ENDED = range(3)
#: The protocol's error codes.
PARSE_ERROR, INVALID, UNKNOWN_METHOD, NOT_INITIALIZED = -32700, -32600, -32601, -32002
TEXTS = {PARSE_ERROR: "Parse error", INVALID: "Invalid request", UNKNOWN_METHOD: "Method not found", NOT_INITIALIZED: "Server not initialized"}
REPLIES = "client long, seq long, id long, method string, code int, reply string"
BODY = "client BIGINT, seq BIGINT, at BIGINT, id BIGINT, method STRING"


def reply(id_: int | None, result) -> str:
    return json.dumps({"jsonrpc": "2.0", "id": id_, "result": result}, separators=(",", ":"))


def error(id_: int | None, code: int) -> str:
    return json.dumps({"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": TEXTS[code]}}, separators=(",", ":"))


def notify(method: str, params) -> str:
    return json.dumps({"jsonrpc": "2.0", "method": method, "params": params}, separators=(",", ":"))


def answer(phase: int, method: str | None, id_: int | None) -> tuple[int, int | None]:
    """The next phase and the reply's code (0: a result), or none for a notification."""
    if method is None:
        return phase, PARSE_ERROR
    if method == "exit":
        return NEW, None
    if method in NOTIFICATIONS or id_ is None:
        return phase, None
    if method == "initialize":
        return (RUNNING, 0) if phase == NEW else (phase, INVALID)
    if phase != RUNNING:
        return phase, NOT_INITIALIZED if phase == NEW else INVALID
    if method == "shutdown":
        return ENDED, 0
    return phase, 0 if method in REQUESTS else UNKNOWN_METHOD


class Dispatcher(StatefulProcessor):
    def __init__(self, idle_ms: int, timed: bool = True):
        self.idle_ms, self.timed = idle_ms, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("client", "phase int, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        phase, last = self.state.get() if self.state.exists() else (NEW, None)
        got = pd.concat(list(rows)).sort_values("seq")  # one client's messages of one batch
        out = []
        for seq, at, id_, method in zip(got["seq"], got["at"], got["id"], got["method"]):
            id_ = None if pd.isna(id_) else int(id_)
            if last is not None and at - last > self.idle_ms:
                phase = NEW
            last = int(at)
            phase, code = answer(phase, None if pd.isna(method) else method, id_)
            if code is not None:
                out.append((key[0], int(seq), id_, method, code, reply(id_, {"capabilities": {}} if method == "initialize" else None) if code == 0 else error(id_, code)))
        self.state.update((phase, last))
        if self.timed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle_ms + 1)
        frame = pd.DataFrame(out, columns=["client", "seq", "id", "method", "code", "reply"])
        yield frame.astype({"client": "int64", "seq": "int64", "id": "Int64", "code": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def messages_of(bodies: DataFrame, late: str | None = "1 hour") -> DataFrame:
    """client, seq, at (ms), id, method and the event time of bodies; a body that is no message has no method. late: None keeps messages of any time."""
    m = F.from_json("body", BODY)
    rows = bodies.select(m.alias("m")).select("m.*").where("client is not null")
    rows = rows.withColumn("time", F.timestamp_millis("at"))
    return rows if late is None else rows.withWatermark("time", late)


def dispatched(messages: DataFrame, idle_ms: int, timed: bool = True) -> DataFrame:
    """The replies to a stream of messages_of(); timed: it has a watermark, by which the state of clients that have gone is dropped."""
    return messages.groupBy("client").transformWithStateInPandas(Dispatcher(idle_ms, timed), REPLIES, "Append", "EventTime" if timed else "None")
