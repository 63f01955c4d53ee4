"""Exact duplicates by a persistent digest index.

The index is a table of (digest, keep_id), bucketed and sorted by digest: one row for each distinct text so far. A
delivery of documents is digested in one pass, its equal texts are pre-aggregated to one row for each digest, those rows
are merged with the index by an anti-join on the buckets (the index isn't shuffled), and what is new is appended to
the same buckets. Texts never move; only digests do. Texts are equal when they are identical after lower-casing A-Z, told by
the SHA-256 of the lower-cased text.

Who stays: of a delivery's equal texts the row with the largest id, unless an earlier delivery kept one already. So deliveries
in falling order of ids give the same as one. A delivery has a name, and adding it again changes nothing: the row whose id the index holds for its text is
recognised, so a job that died after its append can simply be run again.

Rows: a null text counts as empty, and empty texts are equal texts like others; a null id is smaller than every id, and a row with one stays only if none of its equals in its
delivery has an id (it is recognised in a delivery of the same name only); of rows repeated with one id and text one stays. Very long texts are digested whole, in one read.
Groups of equal texts of any size are counted before they are shuffled; rows are joined with their groups by an
equi-join that Spark may split. An empty table gives an empty result. Extra columns aren't read; `keep` returns them as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, byte_texts

#: Rows of the first delivery that a bucket is sized for, and the bounds of the number of buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 8, 65_536
SCHEMA = "digest binary, keep_id long, delivery string"
#: Deliveries that `duplicates` cuts a table into.
PARTS = 2


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """row, doc_id, digest from row, doc_id, text."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hashlib.sha256(x.lower()).digest() for x in byte_texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["row", "doc_id", "digest"])

    return rows.mapInArrow(digested, "row long, doc_id long, digest binary")


class DigestIndex:
    """A folder that every executor shares: a bucketed Parquet table and its number of buckets."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._table = f"loomline_digests_{uuid.uuid4().hex}"
        self._about = f"{self.path}/about"
        self.buckets = self._read_about()
        if self.buckets:
            self._register()

    def _file(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._about)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read_about(self) -> int:
        path, fs = self._file()
        return json.loads(self.spark.read.text(self._about).first()[0])["buckets"] if fs.exists(path) else 0

    def _create(self, rows: int) -> None:
        self.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)))
        self.spark.range(1).select(F.lit(json.dumps({"buckets": self.buckets})).alias("value")).coalesce(1).write.text(self._about)
        self._register()

    def _register(self) -> None:
        self.spark.sql(f"CREATE TABLE {self._table} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")

    def close(self) -> None:
        """Forgets the session's name for the table; its files stay."""
        if self.buckets:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table}")

    def rows(self) -> DataFrame:
        """digest, keep_id, delivery of every text so far."""
        return self.spark.table(self._table) if self.buckets else self.spark.createDataFrame([], SCHEMA)

    def add(self, rows: DataFrame, delivery: str) -> None:
        """Appends the digests of rows (doc_id, digest) that the index doesn't hold yet, each with the largest id."""
        ws = Workspace(self.spark)
        # Written, as Spark would else join all rows before it groups them, and a large group of copies would meet in one task.
        groups = ws.save(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id")).withColumn("delivery", F.lit(delivery)))
        if not self.buckets:
            self._create(rows.count())
        new = self.unknown(groups)
        new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self._table)
        ws.drop(groups)

    def unknown(self, groups: DataFrame) -> DataFrame:
        """The rows (digest, …) whose digests the index doesn't hold; only they are shuffled."""
        return groups.repartition(self.buckets, "digest").join(self.rows().hint("merge"), "digest", "left_anti")


def decide(rows: DataFrame, index: DigestIndex, delivery: str) -> DataFrame:
    """row, doc_id, digest, keep_id, group_size, kept of rows that the index has taken in under that name; group_size counts rows of this table."""
    held = index.rows().hint("merge")
    # Rows that the index holds by id; they are dealt by text and id, so a large group of copies is spread.
    known = rows.join(held, (rows["digest"] == held["digest"]) & rows["doc_id"].eqNullSafe(held["keep_id"])).where(F.col("doc_id").isNotNull() | (F.col("delivery") == delivery))
    keepers = known.groupBy(rows["digest"]).agg(F.max("row").alias("keeper"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("group_size")).join(held.drop("delivery"), "digest").join(keepers, "digest", "left")
    return rows.join(groups.hint("merge"), "digest").select("row", "doc_id", "digest", "keep_id", "group_size", F.col("row").eqNullSafe(F.col("keeper")).alias("kept"))


def deliveries(rows: DataFrame, parts: int) -> list[Column]:
    """Conditions that cut rows into parts of about equal size by id, largest ids first; rows without an id come last."""
    cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.05)}, reverse=True) if parts > 1 else []
    id_, tops = F.col("doc_id"), [None, *cuts]
    out = [id_ >= low if top is None else (id_ >= low) & (id_ < top) for top, low in zip(tops, cuts)]
    return [*out, F.lit(True) if not cuts else (id_ < cuts[-1]) | id_.isNull()]


def duplicates(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, brought to a new index in so many deliveries, largest ids first."""
    ws = Workspace(docs.sparkSession)
    index = DigestIndex(docs.sparkSession, f"{ws.root}/index")
    rows = ws.save(digests(numbered(docs)))
    for part in deliveries(rows, parts):
        index.add(rows.where(part), "all")
    return decide(rows, index, "all").select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep(docs: DataFrame, index: DigestIndex, delivery: str) -> DataFrame:
    """The rows of docs that are new to the index, one of each text, with all their columns; the index has them afterwards."""
    ws = Workspace(docs.sparkSession)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    held = ws.save(docs.select(F.monotonically_increasing_id().alias("row"), whole))
    rows = ws.save(digests(held.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))))
    index.add(rows, delivery)
    return held.join(decide(rows, index, delivery).where("kept").select("row"), "row", "left_semi").select("doc.*")


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d
"""
