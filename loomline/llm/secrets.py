"""Secret scanning with multipart credential linking.

All on DataFrame functions. Each kind's pattern cuts the text (`split`) and gives its matches
(`regexp_extract_all`); the lengths of both, summed, place every match in code points.

Base kinds are reported by themselves. Weak candidates are parts of a credential that mean little
alone: account names, secret-looking strings and endpoints. They are reported only when a part of another
role lies in the same scope, that is not more than REACH code points away in the same text. The parts meet in an interval
join: each weak part is dealt to the cells of the text that its scope touches, and parts of one
cell and document are compared. A cell has REACH code points, so few parts share one whatever the document's length.

Rows: a null text is empty and has no spans; the digest of no spans is that of the empty string. A
null id, repeated rows and extra columns change nothing: spans depend on the text alone, and
every row is returned once. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Fixed patterns of the base kinds, in the order in which spans at one place are listed; with the characters they need.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
#: Fixed patterns of the weak parts: kind, role, pattern, a quick test without which it can't match, and what a match must hold.
WEAK = (
    ("account", "id", r"(?i)(?:user(?:name)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", r"(?i)(?:user|login|account|client_?id)", ()),
    ("opaque", "secret", r"[A-Za-z0-9+/_-]{32,}={0,2}", r"[A-Za-z0-9+/_-]{32}", ("[0-9]", "[A-Z]", "[a-z]")),
    ("endpoint", "endpoint", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x20\x09-\x0D\"'<>]{4,}", r"://", ()),
)
KINDS = (*BASE, *(x[0] for x in WEAK))
ROLE = {"assign": "secret", "access": "id", "hex": "secret"} | {x[0]: x[1] for x in WEAK}
REACH = 200
SPANS = "array<struct<start:int,ord:int,end:int>>"


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once: a lambda's body would evaluate it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(steps: Column, start: Column, order: int) -> Column:
    """Places of the matches of steps, the first gap beginning at start."""
    none = F.lit(None).cast(SPANS)
    empty = F.coalesce(none, F.array().cast(SPANS))

    def add(acc, x):
        at = acc["at"] + x["gap"]
        end = at + x["match"]
        span = F.struct(at.cast("int").alias("start"), F.lit(order).alias("ord"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(span)).cast(SPANS).alias("out"))

    return F.aggregate(steps, F.struct(start.cast("int").alias("at"), empty.alias("out")), add, lambda acc: acc["out"])


def _places(steps: Column, order: int) -> Column:
    """Running sums over parts of about the square root of the length, since an accumulated array is copied at each step."""
    width = F.ceil(F.sqrt(F.size(steps))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(steps) / width).cast("int") - 1), lambda k: F.slice(steps, k * width + 1, width))

    def joined(parts):
        sums = F.transform(parts, lambda part: F.struct(F.lit(0).alias("gap"), F.aggregate(part, F.lit(0), lambda a, x: a + x["gap"] + x["match"]).alias("match")))
        starts = _scan(sums, F.lit(0), 0)
        return F.flatten(F.zip_with(parts, starts, lambda part, at: _scan(part, at["start"], order)))

    return _let(parts, joined)


def spans(text: Column, pattern: str, order: int, quick: str | None = None, least: int = 0, holds: tuple = ()) -> Column:
    """The leftmost non-overlapping matches of the pattern; group 2 must have `least` characters, the match hold all of `holds`."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    good = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.length(x) >= least) if least else F.transform(found, lambda x: F.lit(True) if not holds else _all([x.rlike(h) for h in holds]))
    sizes = F.zip_with(found, good, lambda x, ok: F.struct(F.length(x).alias("match"), ok.alias("ok")))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), sizes, lambda gap, x: F.struct(gap.alias("gap"), x["match"].alias("match"), x["ok"].alias("ok")))

    def kept(steps):
        both = F.zip_with(_places(steps, order), steps, lambda span, x: F.struct(span.alias("span"), x["ok"].alias("ok")))
        return F.transform(F.filter(both, lambda x: x["ok"]), lambda x: x["span"]).cast(SPANS)

    return F.when(text.rlike(quick or pattern) & text.rlike(pattern), _let(steps, kept)).otherwise(F.array().cast(SPANS))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def base_spans(text: Column) -> Column:
    return F.concat(spans(text, ASSIGN, 0, least=6), spans(text, ACCESS, 1), spans(text, HEX, 2))


def weak_spans(text: Column) -> Column:
    return F.concat(*(spans(text, pattern, len(BASE) + i, quick, holds=holds) for i, (_, _, pattern, quick, holds) in enumerate(WEAK)))


def _role(order: Column) -> Column:
    return F.element_at(F.array(*(F.lit(ROLE[k]) for k in KINDS)), order + 1)


def linked(found: DataFrame) -> DataFrame:
    """doc_id, h, linked: the weak spans that have a part of another role in their scope; found has doc_id, h, base, weak."""
    some = found.where(F.size("weak") > 0).dropDuplicates(["doc_id", "h"])
    parts = some.select("doc_id", "h", F.explode(F.concat("base", "weak")).alias("x")).select("doc_id", "h", "x.*").withColumn("role", _role(F.col("ord")))
    cell = lambda c: F.floor(c / REACH).cast("int")
    weak = parts.where(F.col("ord") >= len(BASE)).withColumn("cell", F.explode(F.sequence(cell(F.col("start") - REACH), cell(F.col("end") + REACH)))).alias("w")
    other = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end"))))).alias("o")
    near = (F.col("o.start") <= F.col("w.end") + REACH) & (F.col("o.end") >= F.col("w.start") - REACH)
    # One part may match two kinds; what lies inside the candidate itself is no second part.
    apart = (F.col("o.start") >= F.col("w.end")) | (F.col("o.end") <= F.col("w.start"))
    on = F.col("w.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("w.h") == F.col("o.h")) & (F.col("w.cell") == F.col("o.cell")) & (F.col("w.role") != F.col("o.role")) & near & apart
    pairs = weak.join(other, on, "left_semi")
    return pairs.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "ord", "end")).cast(SPANS).alias("linked"))


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _joined_names(found: Column) -> Column:
    kind = lambda o: F.element_at(F.array(*map(F.lit, KINDS)), o + 1)
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda x: F.concat_ws(":", kind(x["ord"]), x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans, for every row of docs."""
    ws = Workspace(docs.sparkSession)
    found = ws.save(_text(docs).select("doc_id", F.xxhash64("text").alias("h"), base_spans(F.col("text")).alias("base"), weak_spans(F.col("text")).alias("weak")))
    more = linked(found).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "linked")
    both = found.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "base", F.coalesce("linked", F.array().cast(SPANS)).alias("linked"))
    count = lambda k: F.size(F.filter("base", lambda x: x["ord"] == k)).cast("long")
    return both.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(BASE)),
        F.sha2(_joined_names(F.col("base")), 256).alias("base_sha256"), _joined_names(F.concat("base", "linked")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by the mark; other columns and rows stay as they are."""
    ws = Workspace(docs.sparkSession)
    own = docs["text"]
    text = F.coalesce(own.cast("string"), F.lit(""))
    plain = _text(docs)
    found = plain.select("doc_id", F.xxhash64("text").alias("h"), base_spans(F.col("text")).alias("base"), weak_spans(F.col("text")).alias("weak")).where(F.size("weak") > 0)
    more = ws.save(linked(ws.save(found)))

    def cut(acc, x):
        skip = x["end"] <= acc["at"]
        piece = F.concat(F.substring(own, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.when(x["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    def masked(found):
        tail = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(own, acc["at"] + 1, F.length(own)))
        return F.aggregate(F.array_sort(found), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), cut, tail)

    on = docs["doc_id"].cast("long").eqNullSafe(more["doc_id"]) & (F.xxhash64(text) == more["h"])
    every = F.concat(base_spans(text), F.coalesce(more["linked"], F.array().cast(SPANS)))
    clean = _let(every, lambda found: F.when(F.size(found) > 0, masked(found)).otherwise(own))
    return docs.join(more, on, "left").select(*(clean.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns))
