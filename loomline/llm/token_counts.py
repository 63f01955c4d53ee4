"""Token counts by an exact length histogram.

Each whole text is encoded once; documents are counted by encoded length. Suffix sums over the histogram then
answer, for every context limit L that occurs as a length: how many documents and tokens are at or beyond it, how many tokens are
left when each document is cut at L, and which share of documents fits. The histogram has at most one row
for each distinct length; its running sums are made in parts of PART lengths, so no task holds it whole.

Rows: null and empty texts have length 0; ids and repeated rows don't matter, each row counts; an empty table gives an empty
histogram. Extra columns aren't read. Control strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, running_sum

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PART = 1024
#: Fixed pattern of the byte-level vocabulary: how a text is cut before merging.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> bytes:
    """The vocabulary file as the driver reads it; its size is fixed (under a megabyte), so closures carry it."""
    with open(path, "rb") as f:
        return f.read()


def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
    return tiktoken.Encoding("loomline", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """length: the encoded length of each row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            encode = encode or _encoding(sent.value).encode_ordinary
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(x)) if (x := v.as_py()) else 0 for v in b.column(0)], pa.int64())], ["length"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "length long")


def histogram(lengths_: DataFrame) -> DataFrame:
    """length, n_docs, docs_longer, docs_fitting, share_fitting, tokens, tokens_fitting, tokens_truncated for each length that occurs.

    docs_longer counts documents above the length, docs_fitting the others; tokens is the total of the length's own
    documents, tokens_fitting that of all that fit whole, tokens_truncated the total when every document is cut at the length.
    """
    ws = Workspace(lengths_.sparkSession)
    counts = ws.save(lengths_.groupBy("length").agg(F.count("*").alias("n_docs")))
    total = counts.agg(F.sum("n_docs")).first()[0] or 0
    parts = counts.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("part", F.floor(F.col("length") / PART)).withColumn("one", F.lit(1))
    docs = running_sum(parts, ["one"], "part", ["length"], "n_docs", "docs_below")
    both = running_sum(docs, ["one"], "part", ["length"], "tokens", "tokens_below")
    fitting = F.col("docs_below") + F.col("n_docs")
    whole = F.col("tokens_below") + F.col("tokens")
    longer = F.lit(total) - fitting
    return both.select(
        "length", "n_docs", longer.alias("docs_longer"), fitting.alias("docs_fitting"), (fitting / F.lit(max(total, 1))).alias("share_fitting"),
        "tokens", whole.alias("tokens_fitting"), (whole + longer * F.col("length")).alias("tokens_truncated"),
    )


def quantile(table: DataFrame, share: float) -> int | None:
    """The least length that at least this share of documents doesn't exceed."""
    return table.where(F.col("share_fitting") >= share).agg(F.min("length")).first()[0]


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at any limit, whether or not it occurs as a length."""
    below = table.where(F.col("length") <= limit).agg(F.max(F.struct("length", "tokens_fitting", "docs_longer"))).first()[0]
    if below is None:
        return limit * (table.agg(F.sum("n_docs")).first()[0] or 0)
    return below.tokens_fitting + limit * below.docs_longer
