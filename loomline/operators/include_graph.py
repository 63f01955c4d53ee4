"""Includes as a graph: what each file's names come from, file by file instead of path by path.

Files are peeled in levels: a file is ready when all that it includes are. A ready file's summary has, for each name, the first and the last declaration as an
includer sees them, and goes once along each include statement into the files above. So rows are include statements times names, however many paths there are.

Files in cycles, or above one, never get ready. For them the least path (by places) from each to each is relaxed until nothing changes; a file isn't entered
again on its own way, and least paths never are. Of what such a file brings twice only its first place counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .itab import checkpointed, shared_folder

SYMBOL = "struct<file_id:bigint,kind:string,type:string,type_name:string,start:int,end:int>"
CONTRIBUTIONS = f"file_id long, at int, name string, first {SYMBOL}, last {SYMBOL}"


def levels(files: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id, level of every file that isn't in a cycle or above one; level 0 includes nothing."""
    spark = files.sparkSession
    ids = files.select(F.col("file_id").cast("long").alias("file_id"))
    links = checkpointed(edges.select("file_id", "included_id").distinct())
    waits = checkpointed(links.groupBy("file_id").agg(F.count("*").alias("n")))
    now = checkpointed(ids.join(waits, "file_id", "left_anti").distinct())
    out, level = now.withColumn("level", F.lit(0)), 0
    while not now.isEmpty():
        level += 1
        freed = links.join(now.select(F.col("file_id").alias("included_id")), "included_id").groupBy("file_id").agg(F.count("*").alias("c"))
        left = checkpointed(waits.join(freed, "file_id", "left").select("file_id", (F.col("n") - F.coalesce("c", F.lit(0))).alias("n")))
        waits, now = left.where("n > 0"), left.where("n = 0").select("file_id")
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return checkpointed(out) if level else spark.createDataFrame([], "file_id long, level int")


def least_paths(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """root_id, file_id, path: every file that a root (file_id) reaches, by its first place in the root's expansion."""
    ways = edges.select(F.col("file_id").alias("from_id"), "included_id", "start")
    best = roots.select(F.col("file_id").alias("root_id"), "file_id", F.array().cast("array<int>").alias("path"))
    moved = best
    while True:
        tried = moved.join(ways, moved["file_id"] == ways["from_id"]).select("root_id", F.col("included_id").alias("file_id"), F.concat("path", F.array("start")).alias("new"))
        tried = tried.groupBy("root_id", "file_id").agg(F.min("new").alias("new"))
        both = checkpointed(best.join(tried, ["root_id", "file_id"], "full").withColumn("better", F.col("new").isNotNull() & (F.col("path").isNull() | (F.col("new") < F.col("path")))))
        best = both.select("root_id", "file_id", F.when(F.col("better"), F.col("new")).otherwise(F.col("path")).alias("path"))
        moved = both.where("better").select("root_id", "file_id", F.col("new").alias("path"))
        if moved.isEmpty():
            return best


def contributions(files: DataFrame, own: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id, at, name, first, last: at each place of a file, each name that its declaration or include statement brings, with its first and last declaration there.

    own has the files' global symbols (file_id, name, kind, type, type_name, start, end), edges their include statements (file_id, included_id, start).
    """
    spark = files.sparkSession
    folder = f"{shared_folder(spark)}/includes-{uuid.uuid4().hex}"
    edges = checkpointed(edges.select("file_id", "included_id", "start").distinct())
    known = levels(files, edges)
    symbol = F.struct("file_id", "kind", "type", "type_name", "start", "end").cast(SYMBOL)
    mine = checkpointed(own.select("file_id", F.col("start").alias("at"), "name", symbol.alias("first"), symbol.alias("last")))
    mine.join(known, "file_id").write.partitionBy("level").parquet(folder)
    into = checkpointed(edges.join(known, "file_id").join(known.select(F.col("file_id").alias("included_id"), F.col("level").alias("from_level")), "included_id"))
    top = known.agg(F.max("level")).first()[0] or 0
    read = lambda level: spark.read.schema(f"{CONTRIBUTIONS}, level int").parquet(folder).where(F.col("level") == level).drop("level")
    for level in range(top):
        up = into.where(F.col("from_level") == level)
        summary(read(level)).join(up, F.col("of") == F.col("included_id")).select("file_id", F.col("start").alias("at"), "name", "first", "last", "level").write.mode("append").partitionBy("level").parquet(folder)
    done = spark.read.schema(f"{CONTRIBUTIONS}, level int").parquet(folder).drop("level")
    caught = files.select(F.col("file_id").cast("long").alias("file_id")).join(known, "file_id", "left_anti")
    if caught.isEmpty():
        return done
    # Files in cycles: what each reaches, at its first place.
    caught = checkpointed(caught)
    inner = edges.join(caught, "file_id").join(caught.select(F.col("file_id").alias("included_id")), "included_id", "left_semi")
    paths = least_paths(caught, inner)
    outer = edges.join(caught, "file_id").join(known.select(F.col("file_id").alias("included_id")), "included_id", "left_semi")
    below = summary(done).join(outer, F.col("of") == F.col("included_id")).select("file_id", F.col("start").alias("at"), "name", "first", "last")
    brought = mine.join(caught, "file_id", "left_semi").unionByName(below)
    placed = paths.join(brought, "file_id").withColumn("position", F.concat("path", F.array("at")))
    merged = placed.groupBy(F.col("root_id").alias("file_id"), F.element_at("position", 1).alias("at"), "name").agg(F.min_by("first", "position").alias("first"), F.max_by("last", "position").alias("last"))
    return done.unionByName(checkpointed(merged))


def summary(contributed: DataFrame) -> DataFrame:
    """of (a file), name, first, last as an includer of it sees them."""
    return contributed.groupBy(F.col("file_id").alias("of"), "name").agg(F.min_by("first", "at").alias("first"), F.max_by("last", "at").alias("last"))


def visible(contributed: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """root_id, place, name and the declaration that a place sees: the last one before it, of the innermost file that has one.

    A place is an array: the places of the include statements on the way from the root, then the place itself.
    """
    now = checkpointed(asked.select("root_id", "place").distinct().select("root_id", "place", F.col("root_id").alias("file_id"), F.lit(1).alias("depth")))
    found = None
    while not now.isEmpty():
        at = now.join(contributed, "file_id").where(F.col("at") < F.element_at("place", F.col("depth")))
        here = at.groupBy("root_id", "place", "name").agg(F.max(F.struct("depth", "at", "last")).alias("s"))
        found = here if found is None else found.unionByName(here)
        steps = edges.select("file_id", F.col("included_id").alias("next"), F.col("start").alias("at"))
        now = checkpointed(now.where(F.size("place") > F.col("depth")).join(steps, "file_id").where(F.col("at") == F.element_at("place", F.col("depth"))).select("root_id", "place", F.col("next").alias("file_id"), (F.col("depth") + 1).alias("depth")))
    if found is None:
        return asked.sparkSession.createDataFrame([], f"root_id long, place array<int>, name string, {SYMBOL[7:-1].replace(':', ' ')}")
    return found.groupBy("root_id", "place", "name").agg(F.max("s").alias("s")).select("root_id", "place", "name", "s.last.*")


def meanings(contributed: DataFrame, edges: DataFrame, uses: DataFrame) -> DataFrame:
    """file_id, name, start, end, kind: which kinds a name used at a place has by declarations of other files, over all roots that the file stands in.

    In its own file, else in each file that includes it, the last declaration before the place counts; files above are asked only where it has none.
    """
    other = contributed.select("file_id", "name", "at", F.col("last.file_id").alias("of"), F.col("last.kind").alias("kind"))
    asks = uses.select(F.col("file_id").alias("use_id"), "name", "start", "end", "file_id", F.col("start").alias("at_most")).distinct()
    asks = checkpointed(asks)
    seen, out = asks, None
    while not asks.isEmpty():
        hit = asks.join(other, ["file_id", "name"]).where("at < at_most and of <> use_id").groupBy("use_id", "name", "start", "end", "file_id", "at_most").agg(F.max_by("kind", "at").alias("kind"))
        hit = checkpointed(hit)
        got = hit.select(F.col("use_id").alias("file_id"), "name", "start", "end", "kind")
        out = got if out is None else out.unionByName(got)
        open_ = asks.join(hit.select("use_id", "name", "start", "end", "file_id", "at_most"), ["use_id", "name", "start", "end", "file_id", "at_most"], "left_anti")
        above = edges.select(F.col("file_id").alias("above_id"), F.col("included_id").alias("file_id"), F.col("start").alias("above_at"))
        up = open_.join(above, "file_id").select("use_id", "name", "start", "end", F.col("above_id").alias("file_id"), F.col("above_at").alias("at_most")).distinct()
        asks = checkpointed(up.join(seen, ["use_id", "name", "start", "end", "file_id", "at_most"], "left_anti"))
        seen = seen.unionByName(asks)
    return out.distinct()
