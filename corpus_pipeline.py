"""Five stages from raw documents to a mixed corpus; each is written as Parquet and reread as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import decontaminate, mixing, near_dup, secrets, toxicity
from loomline.llm.common import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches the threshold go. Null and empty texts have scores, too; very long ones are read whole; equal texts go or stay together; all columns come back."""
    return toxicity.clean(docs, _table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of the smallest id stays; of rows with one id and text one. Null, blank and empty texts link with nothing and stay; very long ones are compared whole; all columns come back."""
    return near_dup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of any benchmark item go. Null and blank texts and items match nothing; very long texts are searched to their end; equal rows go or stay together; all columns come back."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become [SECRET]; no row goes. Null texts stay null; very long ones are scanned whole; equal texts are masked alike; all columns come back."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which the mix takes words stay, with size, source_size, target and taken. Null texts have no words and go; ties are told apart by ids and texts; all columns come back, those named like the new ones with an underscore before."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: No single SQL statement expresses the learned and the approximate stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: columns of documents with size, source_size, target and taken. An empty table gives an empty corpus."""
    ws = Workspace(spark)
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir))
    return docs
