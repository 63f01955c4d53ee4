"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of BLOCK words. Slot i has the golden-ratio point (i * STEP mod CYCLE) / CYCLE,
which falls into the cumulative targets of the sources: an interval join over CELLS equal cells, so no side is
broadcast and no source, however large, meets in one task. A slot's rank among those of its
source names the block that fills it: each source's documents, in the order of a digest of their ids, are one stream of words, cut
into equal blocks and gone through twice at most. The join of slots and blocks says how many words of each document
the mix takes. A source's words differ from its target by the sequence's discrepancy, about two blocks.

Rows: a null text has size 0; null sources are a source of their own, last in order; null ids and repeated
rows are rows of their own (equal rows may take unequal shares, the same ones on every run; of one id and size, a hash of the text tells rows apart). A source without words has the target 0.
Very long texts are streams of many blocks. The mix is made of whole slots, so what is left below half a slot, and a table of which all targets are below it, takes nothing. An empty
table gives an empty result. Other columns of the input aren't read; `mixed` returns them as they are, those named like a result column with underscores before their names. Sources are ranked in
one task, so their number, unlike that of their documents, has to fit there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Workspace, running_sum

WEIGHTS, SHARE, LIMIT = (3, 1, 2), 1.5, 2
#: CYCLE is prime and STEP is CYCLE divided by the golden ratio, so that points follow each other as multiples of it and products stay below 2**63.
BLOCK, CYCLE, STEP, CELL, CHUNK, SEED = 64, 2147483647, 1327217884, 1 << 16, 1 << 16, "mix-1"


def word_count(text):
    """Matches of WORD: the pieces between blanks, without the empty ones at the ends."""
    blanks = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    inner = F.trim(blanks)
    return F.when(text.isNull() | (inner == ""), F.lit(0)).otherwise(F.size(F.split(inner, " +"))).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target from source, source_size: a row for each source.

    A target is min(limit * size, weight * level) for the one level at which all add up to share of the total.
    """
    ranked = sizes.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights)).cast("int") + 1).cast("double")
    ranked = ranked.withColumn("w", weight).withColumn("most", F.col("source_size") * float(limit)).withColumn("ratio", F.col("most") / F.col("w"))
    before, whole = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("most").over(before), zero)
    ranked = ranked.withColumn("level", left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), zero)))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return ranked.select("source", "source_size", F.least("most", F.col("w") * level).alias("target"), "pos")


def schedule(spark, goals: DataFrame) -> DataFrame:
    """slot, source, rank: the order of the mix; rank numbers a source's slots from 0."""
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    all_ = goals.withColumn("_to", F.sum("target").over(Window.orderBy("pos"))).withColumn("_at", F.col("_to") - F.col("target"))
    point = lambda c: F.round(F.col(c) / F.lit(total or 1.0) * CYCLE).cast("long")
    parts = all_.where("target > 0").select("source", point("_at").alias("low"), point("_to").alias("high"))
    cells = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / CELL), F.floor(F.col("high") / CELL))))
    slots = spark.range(0, round(total / BLOCK)).select(F.col("id").alias("slot"), (F.col("id") % CYCLE * STEP % CYCLE).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / CELL))
    placed = slots.join(cells, (slots["cell"] == cells["cell"]) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "source")
    placed = placed.withColumn("one", F.lit(1).cast("long")).withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    return running_sum(placed, ["source"], "chunk", ["slot"], "one", "rank").select("slot", "source", "rank")


def _placed(ws: Workspace, rows: DataFrame) -> DataFrame:
    """Blocks of words of row, doc_id, source, size, each with its slot of the mix or none, and how many words of the document (words) stand in it."""
    goals = ws.save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    dealt = rows.withColumn("digest", digest).withColumn("part", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int"))
    streams = running_sum(dealt, ["source"], "part", ["digest", "doc_id", "size", "h"], "size", "at")
    known = goals.select(F.col("source").alias("_source"), "source_size", "target")
    streams = streams.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    first = F.col("at") + F.col("round") * F.col("source_size")
    pieces = streams.withColumn("round", F.explode(F.array(*(F.lit(k) for k in range(LIMIT))))).withColumn("low", first).withColumn("high", F.col("low") + F.col("size"))
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("low") / BLOCK), F.floor((F.col("high") - 1) / BLOCK)))
    pieces = pieces.withColumn("block", F.explode_outer(blocks))
    slots = schedule(rows.sparkSession, goals).select(F.col("source").alias("_source"), F.col("rank").alias("_rank"), "slot")
    joined = pieces.join(slots, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_rank")), "left")
    part = F.least("high", (F.col("block") + 1) * BLOCK) - F.greatest("low", F.col("block") * BLOCK)
    return joined.withColumn("words", part)


def _plan(ws: Workspace, rows: DataFrame) -> DataFrame:
    """row, doc_id, size, source_size, target, taken from row, doc_id, source, size."""
    joined = _placed(ws, rows)
    taken = F.coalesce(F.sum(F.when(F.col("_rank").isNotNull(), F.col("words"))), F.lit(0)).cast("long").alias("taken")
    return joined.groupBy("row", "doc_id", "size", "source_size", "target").agg(taken)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("h"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    ws = Workspace(docs.sparkSession)
    return _plan(ws, ws.save(_rows(docs))).drop("row")


def blocks(docs: DataFrame) -> DataFrame:
    """slot, at, source, doc_id, first, words: the mix itself as ranges of words. A range starts at word `at` of its slot and word `first` of its document, both from 0."""
    ws = Workspace(docs.sparkSession)
    placed = _placed(ws, ws.save(_rows(docs))).where("_rank is not null and words > 0")
    start = F.greatest("low", F.col("block") * BLOCK)
    return placed.select("slot", (start - F.col("block") * BLOCK).alias("at"), "source", "doc_id", (start - F.col("low")).alias("first"), "words")


ADDED = ("size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """docs with size, source_size, target and taken; documents of which the mix takes nothing go."""
    ws = Workspace(docs.sparkSession)
    names: list[str] = []
    for c in docs.columns:
        while c in ADDED or c in names or c != docs.columns[len(names)] and c in docs.columns:
            c = "_" + c
        names.append(c)
    text = F.col("text").cast("string")
    whole = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names))).alias("doc")
    kept = ws.save(docs.select(F.monotonically_increasing_id().alias("row"), word_count(text).alias("size"), F.xxhash64(text).alias("h"), whole))
    plan = _plan(ws, kept.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.source").cast("string").alias("source"), "size", "h"))
    return kept.join(plan.where("taken > 0").select("row", "source_size", "target", "taken"), "row").select("doc.*", *ADDED)


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1 AS pos FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][pos % 3 + 1] AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * 2 AS most FROM s),
v AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(most) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY most / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, pos, source_size, least(most, w * max(CASE WHEN level <= most / w THEN level END) OVER ()) AS target FROM v),
c AS (SELECT *, sum(target) OVER (ORDER BY pos) AS hi, sum(target) OVER () AS total FROM g),
b AS (SELECT source, CAST(round((hi - target) / total * {CYCLE}) AS BIGINT) AS low, CAST(round(hi / total * {CYCLE}) AS BIGINT) AS high FROM c WHERE target > 0),
p AS (SELECT i % {CYCLE} * {STEP} % {CYCLE} AS point FROM (SELECT unnest(range(CAST((SELECT round_even(sum(target) / {BLOCK}, 0) FROM g) AS BIGINT))) AS i)),
n AS (SELECT source, count(*) * {BLOCK} AS words FROM p JOIN b ON point >= low AND point < high GROUP BY source),
t AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT t.doc_id, t.size, g.source_size, g.target,
  CAST(greatest(least(start + t.size, coalesce(words, 0)) - start, 0) + greatest(least(start + t.size + g.source_size, coalesce(words, 0)) - start - g.source_size, 0) AS BIGINT) AS taken
FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source LEFT JOIN n ON t.source IS NOT DISTINCT FROM n.source
"""
