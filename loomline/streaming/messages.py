"""Editor messages and documents as streams, and event-time operators over `events`."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.itab import shared_folder

MESSAGE = "jsonrpc STRING, id STRING, method STRING, params STRING"
OPENED = "textDocument STRUCT<uri: STRING, version: BIGINT, text: STRING>, contentChanges ARRAY<STRUCT<text: STRING>>, position STRUCT<line: INT, character: INT>"
REQUESTS = ("initialize", "shutdown", "textDocument/hover", "textDocument/completion", "textDocument/semanticTokens/full", "textDocument/diagnostic")
NOTIFICATIONS = ("textDocument/didOpen", "textDocument/didChange")


def frames(data: bytes) -> tuple[list[str], bytes]:
    """Bodies of all whole frames (headers with Content-Length, a blank line, the body) and the bytes left over."""
    out = []
    while (head := data.find(b"\r\n\r\n")) >= 0:
        sizes = [h.split(b":", 1)[1] for h in data[:head].split(b"\r\n") if h.lower().startswith(b"content-length:")]
        if not sizes:
            raise ValueError("a frame has no Content-Length")
        end = head + 4 + int(sizes[-1])
        if len(data) < end:
            break
        out.append(data[head + 4 : end].decode("utf-8"))
        data = data[end:]
    return out, data


def frame(message: dict) -> bytes:
    body = json.dumps(message, separators=(",", ":")).encode()
    return b"Content-Length: %d\r\n\r\n%s" % (len(body), body)


def parsed(bodies: DataFrame) -> DataFrame:
    """bodies (seq, body) with the message's fields; `valid` says whether the method is known."""
    m = F.from_json("body", MESSAGE)
    return bodies.select("seq", m.alias("m")).select("seq", "m.*").withColumn("valid", F.col("method").isin(*REQUESTS, *NOTIFICATIONS))


def answered(messages: DataFrame) -> DataFrame:
    """The requests that get an answer: those between initialize and shutdown, by arrival."""
    gate = messages.agg(F.min(F.when(F.col("method") == "initialize", F.col("seq"))).alias("first"), F.min(F.when(F.col("method") == "shutdown", F.col("seq"))).alias("last"))
    inside = (F.col("seq") >= F.col("first")) & (F.col("last").isNull() | (F.col("seq") < F.col("last")))
    return messages.crossJoin(F.broadcast(gate)).where(F.col("method").isin(*REQUESTS) & F.coalesce(inside, F.lit(False))).drop("first", "last")  # gate is one row


def document_versions(messages: DataFrame) -> DataFrame:
    """uri, version, text of every open and change (changes carry the whole text)."""
    p = F.from_json("params", OPENED)
    text = F.coalesce(F.element_at(p["contentChanges"], -1)["text"], p["textDocument"]["text"])
    return messages.where(F.col("method").isin(*NOTIFICATIONS)).select(p["textDocument"]["uri"].alias("uri"), p["textDocument"]["version"].alias("version"), text.alias("text"))


def latest(versions: DataFrame, key: str = "uri", version: str = "version", text: str = "text") -> DataFrame:
    """The text of the highest version for each document; works on batches and on streams in complete or update mode."""
    return versions.groupBy(key).agg(F.max_by(text, version).alias(text), F.max(version).alias(version))


def run_to_end(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All that is available now goes through the stream; its last result as a Parquet table in the folder that all executors share.

    A batch that is run again overwrites its own folder only, so a lost executor or driver leaves no rows twice.
    """
    if mode != "complete":
        raise ValueError("only complete mode gives the whole result with each batch")
    folder, last = f"{shared_folder(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}", []

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{batch}")
        last[:] = [batch]

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
    writer.start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{folder}/{last[0]}") if last else spark.createDataFrame([], stream.schema)


def run_to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """All that is available now goes to Parquet files, exactly once."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Every micro-batch goes to the handler, which dispatches by method."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table as a stream; its schema comes from the files that are there."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A pattern also takes tables of one file, which a streaming source doesn't read by their plain name.
    out = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parque[t]")
    zoneless = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return out.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else out


# Event time (extensions) --------------------------------------------------------------------------------


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return _counted(events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type"))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return _counted(events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def _counted(grouped) -> DataFrame:
    out = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def texts(batches: Iterator[bytes]) -> Iterator[str]:
    """Bodies from chunks of a byte stream, whatever their cuts."""
    rest = b""
    for chunk in batches:
        found, rest = frames(rest + chunk)
        yield from found
