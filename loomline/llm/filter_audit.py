"""How filters interact: what each removes, alone and in every order.

Every row gets the letters of the filters that it fails. A to D look at the row's own text (few words, few distinct words, many
capitals, a forbidden character); E fails rows whose text stands at a smaller doc_id anywhere in the table.

E is found by sorting. Rows are dealt by ranges of (fingerprint, doc_id) and sorted within each by fingerprint, full text and
doc_id, so equal texts are neighbours and a row is compared with its predecessor only; the other filters are counted in the same pass, once for
each run of equal texts. Copies that a range border cuts apart are settled afterwards: each range gives the least
doc_id of every text of its first and its last fingerprint, and its rows of those that failed nothing so far are compared with the least of all ranges by an
equi-join. A group of copies of any size is spread over ranges by doc_id; range borders are sampled from numbers, never from texts.

The masks of failures are then merged into additive counters by part (at most 32 masks by quality and toxicity for each part), and only these are
unfolded into orders and steps.

Rows: a null text is empty (it fails A; all null and empty texts are equal); a null doc_id is neither smaller nor larger than another, so such rows never fail E nor make others fail it, and
have no labels; rows repeated with one id and text don't make each other fail E and count one by one; a null part is the empty string. Labels
repeated for an id count as 1 if one of them is 1; null labels as 0. Very long texts are read whole. An empty table gives an empty result. Extra columns
aren't read; `doc_id`, `text` and the part column are taken by name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Workspace, byte_texts

FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 200, 50, 3
#: The characters that filter D forbids.
FORBIDDEN = b"#$%&*|"
_CAPITALS, _FORBIDDEN, _INSIDE = bytes(range(65, 91)), re.compile(rb"[#$%&*|]"), bytes(range(0x80, 0xC0))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: bytes) -> str:
    """The letters A to D that a text fails by itself."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INSIDE)) if not text.isascii() else len(text)
    out = "A" if n < FEWEST_WORDS else ""
    out += "B" if 100 * len(set(words)) < DISTINCT_SHARE * n else ""
    out += "C" if 100 * capitals > CAPITAL_SHARE * points else ""
    return out + ("D" if _FORBIDDEN.search(text) else "")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fp, text, doc_id: their failures so far, and what has to be settled across the borders of this range.

    A row with `text` (a digest) is open: it stands in the first or last fingerprint and didn't fail E in here. A row with `least` isn't a document
    but the least id of such a text.
    """
    names = ["doc_id", "part", "fails", "fp", "text", "least"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
    first = fp = text = None
    least, fails, seen = None, "", {}  # of the text at hand; seen: digests of the fingerprint at hand and their least ids
    held: dict[tuple, int] = {}  # its rows that don't fail E in here, counted

    def leasts() -> list[tuple]:
        return [(None, None, None, fp, d, low) for d, low in seen.items() if low is not None]

    def opened() -> list[tuple]:
        return [(i, part, f, fp, d, None) for (i, part, f, d), n in held.items() for _ in range(n)]

    for b in batches:
        out: list[tuple] = []
        for now, id_, part, new in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), byte_texts(b.column(3))):
            if now != fp:
                if fp is not None:
                    border = fp == first
                    out += leasts() + opened() if border else [(i, p, f, None, None, None) for (i, p, f, _), n in held.items() for _ in range(n)]
                first = now if fp is None else first
                fp, text, seen, held = now, None, {}, {}
            if new != text:
                text, least, fails, digest = new, None, own_failures(new), hashlib.sha256(new).digest()
                seen[digest] = None
            if id_ is not None and least is None:
                least = seen[digest] = id_
            if id_ is not None and id_ > least:
                out.append((id_, part, fails + "E", None, None, None))
            else:
                key = (id_, part, fails, digest)
                held[key] = held.get(key, 0) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    if fp is not None:
        out = leasts() + opened()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def failures(docs: DataFrame, part: str = "lang", ws: Workspace | None = None) -> DataFrame:
    """doc_id, part, fails of every row of docs; fails has the letters of its filters in order."""
    ws = ws or Workspace(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.monotonically_increasing_id().alias("salt"),
    )
    # The salt spreads rows that are repeated with one id and text.
    dealt = rows.withColumn("fp", F.xxhash64("text")).repartitionByRange("fp", "doc_id", "salt").sortWithinPartitions("fp", "text", "doc_id")
    seen = ws.save(dealt.select("fp", "doc_id", "part", "text").mapInArrow(_compared, "doc_id long, part string, fails string, fp long, text binary, least long"))
    least = seen.where("least is not null").groupBy("fp", "text").agg(F.min("least").alias("low"))
    again = F.col("doc_id") > F.col("low")
    settled = seen.where("text is not null and least is null").join(least, ["fp", "text"], "left").select("doc_id", "part", F.when(again, F.concat("fails", F.lit("E"))).otherwise(F.col("fails")).alias("fails"))
    return seen.where("text is null").select("doc_id", "part", "fails").union(settled)


def masks(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, good, toxic, n: the counters that add up over parts, tables and deliveries."""
    one = lambda c: F.max((F.col(c).cast("int") == 1).cast("int"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    marked = failed.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    return marked.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))


def unfold(counters: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and COUNTS from part, fails, good, toxic, n: a row for each part, order and step."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = counters.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*(F.lit(k + 1) for k in range(len(filters))))))
    letter = F.expr("substring(filter_order, step, 1)")
    fails, passed = F.contains("fails", letter), F.expr("translate(fails, substring(filter_order, 1, step - 1), '') = fails")
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    # Over all orders a filter comes first among the m that a row fails in one order of m.
    share = F.lit(factorial(len(filters))) / F.greatest(F.length("fails"), F.lit(1))
    sums = {
        "kept": n(passed & ~fails), "removed": n(passed & fails), "redundant": n(~passed & fails), "unique_fails": n(F.col("fails") == letter), "good_lost": n(passed & fails & (F.col("good") == 1)),
        "toxic_lost": n(passed & fails & (F.col("toxic") == 1)), "shapley": F.sum(F.when(fails, F.col("n") * share.cast("long")).otherwise(0)),
    }
    return steps.groupBy("part", "filter_order", "step").agg(*(sums[c].cast("long").alias(c) for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 120 orders of five steps for each part."""
    ws = Workspace(docs.sparkSession)
    return unfold(ws.save(masks(failures(docs, part, ws), labels)))


ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
f AS (
  SELECT doc_id, part, [len(words) < {FEWEST_WORDS}, 100 * len(list_distinct(words)) < {DISTINCT_SHARE} * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITAL_SHARE} * length(text),
    regexp_matches(text, '[{FORBIDDEN.decode()}]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS x FROM w),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, x, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY ALL),
p AS (
  SELECT [a, b, c, d, e] AS o FROM range(1, 6) t(a), range(1, 6) u(b), range(1, 6) v(c), range(1, 6) w(d), range(1, 6) y(e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (
  SELECT part, array_to_string(list_transform(o, lambda i: '{FILTERS}'[i]), '') AS filter_order, step, n, good, toxic, x[o[step]] AS fails, len(list_filter(o[1:step - 1], lambda i: x[i])) = 0 AS here, len(list_filter(x, lambda b: b)) AS m
  FROM m, p, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step))
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (WHERE here AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE here AND fails), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT here), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails AND m = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (WHERE here AND fails AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (WHERE here AND fails AND toxic), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(m, 1)) FILTER (WHERE fails), 0) AS BIGINT) AS shapley
FROM s GROUP BY part, filter_order, step
"""
