"""Framed messages (Content-Length headers, a blank line, the body) in growing logs as a source of streams and batches.

A log is a folder of files that only grow. An offset is a byte place in each file, always at a frame's border: what is
not yet a whole frame waits for the next batch. Borders are found by reading headers and skipping bodies; partitions begin at borders at least `chunk` bytes
apart, so that a large backlog is read by many tasks. A restarted query goes on at the places of its checkpoint and gives each message once. Files are
opened through pyarrow's file systems, so a path is a local one or has a scheme that pyarrow knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

SCHEMA = "file string, at long, body string"
NAME, CHUNK, LONGEST_HEAD = "framed_log", 8 << 20, 1 << 16
END = b"\r\n\r\n"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def body_place(head: bytes, at: int) -> tuple[int, int] | None:
    """Offsets from `at` to where the body begins and ends, if the header is whole."""
    stop = head.find(END)
    if stop < 0:
        if len(head) >= LONGEST_HEAD:
            raise ValueError(f"no frame begins at byte {at}")
        return None
    sizes = [h.split(b":", 1)[1] for h in head[:stop].split(b"\r\n") if h.lower().startswith(b"content-length:")]
    if not sizes:
        raise ValueError(f"the frame at byte {at} has no Content-Length")
    return stop + len(END), stop + len(END) + int(sizes[-1])


def borders(f, start: int, size: int) -> Iterator[int]:
    """Ends of the whole frames from start on; bodies are skipped, not read."""
    at = start
    while at < size:
        f.seek(at)
        head = f.read(min(256, size - at))
        place = body_place(head, at)
        if place is None and size - at > len(head):
            f.seek(at)
            place = body_place(f.read(min(LONGEST_HEAD, size - at)), at)
        if place is None or at + place[1] > size:
            return
        at += place[1]
        yield at


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _Log:
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))

    def files(self) -> dict[str, int]:
        fs, path = opened(self.path)
        return {i.base_name: i.size for i in fs.get_file_info(pafs.FileSelector(path)) if i.is_file and not i.base_name.startswith((".", "_"))}

    def open(self, file: str):
        fs, path = opened(self.path)
        return fs.open_input_file(f"{path}/{file}")

    def ranges(self, file: str, start: int, end: int) -> Iterator[Range]:
        low = at = start
        with self.open(file) as f:
            for at in borders(f, start, end):
                if at - low >= self.chunk:
                    yield Range(file, low, at)
                    low = at
        if at > low:
            yield Range(file, low, at)

    def read(self, partition: Range) -> Iterator[tuple]:
        with self.open(partition.file) as f:
            at = partition.start
            for end in borders(f, at, partition.end):
                f.seek(at)
                frame = f.read(end - at)
                yield partition.file, at, frame[frame.find(END) + len(END) :].decode("utf-8", "replace")
                at = end


class LogReader(_Log, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for file, size in sorted(self.files().items()) for r in self.ranges(file, 0, size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _Log.read(self, partition) if partition.file else iter(())


class LogStreamReader(_Log, DataSourceStreamReader):
    """Offsets are {file: byte place}."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = dict(self.known)
        for file, size in self.files().items():
            with self.open(file) as f:
                for at in borders(f, out.get(file, 0), size):
                    out[file] = at
        self.known = out
        return dict(out)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = {**end, **{f: max(at, end.get(f, 0)) for f, at in self.known.items()}}
        return [r for file, to in sorted(end.items()) if to > start.get(file, 0) for r in self.ranges(file, start.get(file, 0), to)]

    def commit(self, end: dict) -> None:
        pass


class FramedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(dict(self.options))


def read_log(spark: SparkSession, folder: str, stream: bool = True, chunk: int = CHUNK) -> DataFrame:
    """file, at, body of every message of a log."""
    spark.dataSource.register(FramedLog)
    return (spark.readStream if stream else spark.read).format(NAME).option("chunk", str(chunk)).load(folder)


def write_log(messages: DataFrame, folder: str, share: float = 1.0) -> None:
    """Messages (file, seq, body) as files of frames in the order of seq; share < 1 leaves each file cut off after that part of its bytes.

    A file is written under another name and then renamed, so a task that is run again leaves no frame twice; a longer version of a file continues a shorter one.
    """
    size = F.octet_length("body")
    framed = messages.select("file", "seq", F.concat(F.lit("Content-Length: "), size.cast("string"), F.lit("\r\n\r\n"), "body").alias("frame"))
    # A window keeps each file's rows in one task and in order; a repartition after a join by file may be dropped, and its rows then come from several tasks.
    whole = Window.partitionBy("file").orderBy("seq", "frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = framed.select("file", F.floor(F.sum(F.octet_length("frame")).over(whole) * share).alias("most"), "frame")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        fs.create_dir(path)
        now, out, temp, left, done = None, None, "", 0, []

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(temp, f"{path}/{now}")
                done.append(now)

        for b in batches:
            for file, most, frame in zip(*(b.column(k).to_pylist() for k in range(3))):
                if file != now:
                    close()
                    now, left, temp = file, most, f"{path}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp)
                data = frame.encode()[:left]
                out.write(data)
                left -= len(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])

    rows.mapInArrow(written, "file string").count()
