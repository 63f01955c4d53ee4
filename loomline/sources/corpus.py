"""Source-code corpora: reading exported package folders, and the index tables of files, objects and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

SUFFIX = "*.[aA][bB][aA][pP]"
FILES = "file_id BIGINT NOT NULL, path STRING NOT NULL, name STRING NOT NULL, extension STRING NOT NULL, content BINARY"
OBJECTS = "id BIGINT NOT NULL, name STRING NOT NULL, kind STRING NOT NULL, file_id BIGINT"
EDGES = "parent_id BIGINT NOT NULL, child_id BIGINT NOT NULL"
#: Schemas of the index tables are DDL strings.
#: Kinds of development objects.
KINDS = ("package", "include", "report", "function_group", "function_module", "class", "interface", "table", "structure", "data_element", "table_type")


def identity(path: Column) -> Column:
    """A stable id from what identifies an object."""
    return F.xxhash64(path)


def read_folder(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Source files of a folder, or of everything below it, as FILES rows."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", SUFFIX).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files_of(found.select("path", "content"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out to all of them: reading a file as a program costs far more than moving it. Larger scans aren't moved."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def files_of(raw: DataFrame) -> DataFrame:
    """FILES rows from path and content."""
    base = F.substring_index("path", "/", -1)
    return raw.select(
        identity(F.col("path")).alias("file_id"), "path", text.filename_of("path").alias("name"), F.lower(F.substring_index(base, ".", -1)).alias("extension"), "content",
    )


def classify(files: DataFrame) -> DataFrame:
    """file_id, path, kind, name, parent_kind, parent_name, package of each file of an export.

    The folders above a file say what it is: .../Package/<names>/Source Code Library/{Includes, Programs/<report>[/Includes],
    Function Groups/<group>[/Includes | /Function Modules]}. Names are percent-decoded, leniently.
    """
    after = F.split(F.element_at(F.split("path", "/Source Code Library/"), -1), "/")
    head = F.element_at(F.split("path", "/Source Code Library/"), 1)
    part = lambda k: F.try_element_at(after, F.lit(k))
    top, depth = part(1), F.size(after)
    kind = (
        F.when(top == "Includes", "include")
        .when((top == "Programs") & (depth == 3), "report")
        .when((top == "Programs") & (part(3) == "Includes"), "include")
        .when((top == "Function Groups") & (depth == 3), "function_group")
        .when((top == "Function Groups") & (part(3) == "Includes"), "include")
        .when((top == "Function Groups") & (part(3) == "Function Modules"), "function_module")
        .when(top == "Classes", "class")
        .when(top == "Interfaces", "interface")
    )
    owner = F.when(top.isin("Programs", "Function Groups") & (depth >= 3), text.url_decode(part(2)))
    own = F.when(kind.isin("report", "function_group"), owner).otherwise(text.url_decode(F.regexp_replace(F.element_at(after, -1), r"(?i)\.abap$", "")))
    inside = F.when(owner.isNotNull() & ~kind.isin("report", "function_group"), F.when(top == "Programs", "report").otherwise("function_group"))
    packages = F.transform(F.filter(F.split(F.regexp_replace(head, "^.*?/Package/", ""), "/"), lambda x: x != "Package"), text.url_decode)
    known = files.where(F.contains(F.col("path"), F.lit("/Source Code Library/")))
    return known.select("file_id", "path", kind.alias("kind"), own.alias("name"), inside.alias("parent_kind"), F.when(inside.isNotNull(), owner).alias("parent_name"), packages.alias("packages"))


def index(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects, edges and errors of an export.

    Parents are packages, reports and function groups. Of several root files of one report or group the last by path stands, and
    each such case is an error row.
    """
    rows = classify(files)
    package = F.array_join("packages", "/")
    key = lambda kind, name, at: identity(F.concat_ws("\x1f", kind, F.lower(name), at))
    own = rows.where("kind is not null").withColumn("package", package)
    named = own.withColumn("id", key(F.col("kind"), F.col("name"), F.concat_ws("/", "package", "parent_name")))
    best = named.groupBy("id").agg(F.max_by("file_id", "path").alias("file_id"), F.first("name").alias("name"), F.first("kind").alias("kind"), F.count("*").alias("files"))
    errors = best.where("files > 1").select("id", "name", "kind", F.format_string("%d root files", "files").alias("message"))
    chains = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("packages")), lambda n: F.slice("packages", F.lit(1), n))).alias("chain")).where(F.size("chain") > 0).distinct()
    at = lambda chain: key(F.lit("package"), F.element_at(chain, -1), F.array_join(chain, "/"))
    packages = chains.select(at(F.col("chain")).alias("id"), F.element_at("chain", -1).alias("name"), F.lit("package").alias("kind"), F.lit(None).cast("long").alias("file_id"))
    objects = best.select("id", "name", "kind", "file_id").unionByName(packages)
    within = chains.where(F.size("chain") > 1).select(at(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("parent_id"), at(F.col("chain")).alias("child_id"))
    parent = F.when(F.col("parent_kind").isNotNull(), key(F.col("parent_kind"), F.col("parent_name"), F.concat_ws("/", "package", F.lit(None).cast("string")))).otherwise(at(F.col("packages")))
    edges = named.select(parent.alias("parent_id"), F.col("id").alias("child_id")).where("parent_id is not null").unionByName(within).distinct()
    return objects, edges, errors


def broken_references(objects: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Foreign keys that lead nowhere: anti-joins in place of constraints."""
    ids = objects.select(F.col("id").alias("_id"))
    lost = objects.where("file_id is not null").join(files.select("file_id"), "file_id", "left_anti").select(F.lit("object.file_id").alias("reference"), F.col("file_id").alias("value"))
    for side in ("parent_id", "child_id"):
        gone = edges.join(ids, F.col(side) == F.col("_id"), "left_anti").select(F.lit(f"edge.{side}").alias("reference"), F.col(side).alias("value"))
        lost = lost.unionByName(gone)
    return lost


def write_index(folder: str, files: DataFrame, objects: DataFrame, edges: DataFrame, mode: str = "overwrite") -> None:
    """The index as Parquet tables."""
    for name, df in (("src_file", files), ("dev_object", objects), ("dev_object_edge", edges)):
        df.write.mode(mode).parquet(f"{folder}/{name}")


def read_report(files: DataFrame, program: str) -> DataFrame:
    """READ REPORT: the program's source text as an ordered table of lines."""
    found = files.where(F.lower("name") == program.lower())
    return found.select(F.posexplode(F.split(F.decode("content", "UTF-8"), "\n", -1)).alias("line", "source")).select((F.col("line") + 1).cast("long").alias("__idx"), "source")
