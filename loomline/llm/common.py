"""What several operators share: words, intermediate tables, components, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but these six ASCII blanks; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, one at a time; null is empty."""
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def folded_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased (bytes.lower() touches nothing else), cut at the six blanks."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def crc_third() -> Column:
    """crc32 of the id as text, modulo 3; a row without an id falls in class 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0)).cast("int")


class Workspace:
    """Intermediate tables under the shared folder that spark.checkpoint.dir names.

    Tables are written once and reread, which cuts lineage and survives lost executors. The
    folder is read from the session; only a local session without one gets a folder of its own.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        conf = spark.sparkContext.getConf()
        root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.loomline.scratch", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="loomline-")
            spark.conf.set("spark.loomline.scratch", root)
        self.root = f"{root.rstrip('/')}/loomline-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loomline_path = path  # for drop()
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later action reads."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._loomline_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal sets of pairs (up to hash collisions)."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def components(ws: Workspace, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of its component; only nodes with an edge appear.

    Alternating large-star and small-star steps; each is a partial aggregation to a node's least
    neighbour and an equi-join back, so no node's neighbours ever meet in one task.
    """
    now = ws.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = fingerprint(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        after = ws.save(small.where("a <> b").distinct())
        ws.drop(now)
        now, was, mark = after, mark, fingerprint(after)
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def running_sum(df: DataFrame, group: list[str], coarse: str, order: list, value: str, out: str) -> DataFrame:
    """Sum of value over the rows before this one in its group, by (coarse, order).

    coarse is an integer column that never falls along the order. Sums by (group, coarse) are
    small and give each part its offset; only rows of one part share a task.
    """
    parts = df.groupBy(*group, coarse).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*group).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    on = [df[c].eqNullSafe(parts[c]) for c in (*group, coarse)]
    joined = df.join(parts, on, "left").drop(*(parts[c] for c in (*group, coarse)))
    within = Window.partitionBy(*group, coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_offset")
