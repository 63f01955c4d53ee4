"""Quality by importance resampling.

Two hashed n-gram models, of target texts (labelled good) and of all raw texts, give each document the log ratio of its
likelihoods, at a temperature of its number of n-grams over CHUNK: the mean over its words and word pairs, times CHUNK. At temperature 1 (the plain sum) weights of long
documents would differ by hundreds and the sample would be decided by length; so every document weighs like a chunk of CHUNK n-grams. Gumbel noise, a function of id and seed, turns the top k of the perturbed
weights into a sample without replacement. The k-th key is found by counting in ever finer bins, not by sorting all rows in one task.

Both models cover all documents (the target all rows with the label). Rows: a null or empty text has weight 0; a null id is hashed as such; very long texts are read whole;
equal rows get equal keys. Just k rows are selected: ties at the k-th key are told apart by a hash of id and text, and rows equal in these by their
place. Empty tables give an empty result. Extra columns aren't read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, byte_texts, folded_words, word_hashes

BUCKETS, CHUNK, SHARE, SEED, SMOOTH = 1 << 14, 64, 0.5, 17, 1.0


def buckets(text: bytes) -> np.ndarray:
    """Hash buckets of a text's words and word pairs."""
    one = word_hashes(folded_words(text))
    with np.errstate(over="ignore"):
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ one[1:]
        two ^= two >> np.uint64(29)
        every = np.concatenate([one, two * np.uint64(0xBF58476D1CE4E5B9)])
    return (every >> np.uint64(64 - 14)).astype(np.int64)


def _counts(docs: DataFrame) -> np.ndarray:
    """n-grams by bucket over all rows; each task sends its BUCKETS sums, and sums are added before they reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text in byte_texts(b.column(0)):
                total += np.bincount(buckets(text), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in docs.select("text").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of id and text), row and log_weight for every row of docs."""
    raw, good = _counts(docs), _counts(target)
    ratio = np.log((good + SMOOTH * (raw + 1) / (raw.sum() + BUCKETS) * BUCKETS) / (good.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [float(ratio[x].mean() * CHUNK) if len(x := buckets(text)) else 0.0 for text in byte_texts(b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(w, pa.float64())], ["doc_id", "tie", "row", "log_weight"])

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(weigh, "doc_id long, tie long, row long, log_weight double")


def _kth(keys: DataFrame, k: int) -> tuple[float, int]:
    """The k-th largest value of the column key and how many of the rows that have just this value belong to the top k."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low < high:
        whole = isinstance(low, int)
        width = max(1, (high - low) // 1024 + 1) if whole else (high - low) / 1024
        if not whole and low + width == low:
            break
        apart = F.col("key").cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)") if whole else F.col("key") - low
        place = F.least(F.floor(apart / width).cast("long"), F.lit(1023).cast("long"))
        found = keys.where(F.col("key").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r.bin):  # 1024 bins at most
            if above + r.n >= k:
                low, high = r.low, r.high
                break
            above += r.n
    at_least = keys.where(F.col("key") > high).count()
    return high, k - at_least


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key, selected for every row of docs; share of the rows are selected."""
    ws = Workspace(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    uniform = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keys = ws.save(weights(docs, target.select(F.col("text").cast("string").alias("text"))).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))))
    k = round(keys.count() * share)
    if not k:
        return keys.select("doc_id", "log_weight", "key", F.lit(False).alias("selected"))
    above, tied = F.lit(False), F.lit(True)
    for name in ("key", "tie", "row"):
        edge, left = _kth(keys.where(tied).select(F.col(name).alias("key")), k)
        above, tied = above | (tied & (F.col(name) > edge)), tied & (F.col(name) == edge)
        if name == "row" or left == keys.where(tied).count():
            break
        k = left
    return keys.select("doc_id", "log_weight", "key", (above | tied).alias("selected"))
