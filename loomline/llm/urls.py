"""URL filters: rules first, gradient-boosted trees for what no rule decides.

A rule is a host and a path prefix. It fits its host and all subdomains, if the url's path starts with the rule's; the
longest that fits decides. URLs that rules decide are the labelled ones: a bounded sample of them trains the trees on lexical features, and
all of them give the suffix statistics (share of blocked URLs by hashed host suffix, SUFFIXES cells). In training, a row's statistics leave out its own fold of URLs.

Rows: a null url, or one without `://`, has an empty host and path, which no rule fits; the trees decide on what there is. A
null page_id is returned as such, repeated rows once each. Without labelled URLs the trees allow everything. An empty table gives an empty
result; extra columns aren't read, so their names may clash with those of the result. Very long URLs are read whole. Equal URLs get equal verdicts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed rules: verdict, host, path prefix.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SAMPLE, SUFFIXES, TREES, DEPTH, RATE, BINS, FOLDS = 20_000, 512, 40, 3, 0.2, 32, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<verdict, rule> of the longest rule that fits, or null."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")))
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*fits)


def suffix_cells(host: str) -> tuple[int, int]:
    labels = host.split(".")
    return tuple(xxhash.xxh3_64_intdigest(".".join(labels[-k:])) % SUFFIXES for k in (1, 2))


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def features(url: str, host: str, path: str, shares: np.ndarray) -> list[float]:
    one, two = suffix_cells(host)
    tail = url[url.find("://") + 3 :] if "://" in url else url
    query = re.split("#", tail)[0].partition("?")[2]
    n = max(1, len(url))
    words = [w for w in re.split(r"[^A-Za-z]+", path) if w]
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host),
        host.count("-"), _entropy(host), _entropy(path), query.count("=") , len(query), float("#" in url), float(url.startswith("https")),
        max(map(len, host.split("."))), max(map(len, words), default=0), shares[one], shares[two], xxhash.xxh3_64_intdigest(words[0] if words else "") % 64,
    ]


@dataclass
class Trees:
    """Boosted regression trees on logistic loss; each is a full tree of DEPTH levels in arrays."""

    base: float
    column: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for column, cut, leaf in zip(self.column, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), column[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fits the trees by gradients and curvatures summed over quantile bins."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    empty = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        empty.base = -1.0
        return empty
    mean = np.clip(y.mean(), 0.01, 0.99)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    base = math.log(mean / (1 - mean))
    margin, columns, cuts, leafs = np.full(len(y), base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        column, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            here = np.flatnonzero(at == node)
            best = 1e-6
            if len(here) >= 4:
                total_g, total_h = g[here].sum(), h[here].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    left_g = np.cumsum(np.bincount(binned[here, j], g[here], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[here, j], h[here], len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, column[node], cut[node] = gain[k], j, e[k]
            at[here] = 2 * node + 1 + (x[here, column[node]] > cut[node])
        at -= inner
        leaf = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
        margin += leaf[at]
        columns.append(column), cuts.append(cut), leafs.append(leaf)
    return Trees(base, np.array(columns), np.array(cuts), np.array(leafs))


def _matrix(urls: list, hosts: list, paths: list, shares: np.ndarray) -> np.ndarray:
    rows = [features(u or "", h, p, shares) for u, h, p in zip(urls, hosts, paths)]
    return np.array(rows) if rows else np.zeros((0, 0))


def fold_of(url: str) -> int:
    return xxhash.xxh3_64_intdigest(url) % FOLDS


def shares_of(counts: np.ndarray) -> np.ndarray:
    """Share of blocked URLs by suffix cell from counts by verdict and cell."""
    return (counts[1] + 1) / (counts.sum(0) + 2)


def _suffix_counts(labelled: DataFrame) -> np.ndarray:
    """Labelled URLs by fold, verdict (1: block) and suffix cell; over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, 2, SUFFIXES), np.int64)
        for b in batches:
            for url, host, y in zip(*(b.column(i).to_pylist() for i in range(3))):
                for cell in suffix_cells(host):
                    total[fold_of(url), y, cell] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at], pa.int64())], ["cell", "n"])

    out = np.zeros(FOLDS * 2 * SUFFIXES, np.int64)
    for r in labelled.select("url", "host", "y").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(FOLDS, 2, SUFFIXES)


def fit(rows: list, counts: np.ndarray) -> Trees:
    """Trees for rows of url, host, path, y. A row's suffix shares leave out its own fold, so that its label doesn't leak into them."""
    without = [shares_of(counts.sum(0) - counts[f]) for f in range(FOLDS)]
    x = [features(r.url, r.host, r.path, without[fold_of(r.url)]) for r in rows]
    return grow(np.array(x) if x else np.zeros((0, 0)), np.array([r.y for r in rows], float))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    url = F.col("url").cast("string")
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = cut.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    labelled = ruled.where("fit is not null").select("url", "host", "path", (F.col("fit.verdict") == "block").cast("int").alias("y"))
    counts = _suffix_counts(labelled)
    shares = shares_of(counts.sum(0))
    rows = labelled.orderBy(F.xxhash64("url"), "url").limit(SAMPLE).collect()  # SAMPLE bounds what reaches the driver
    trees = fit(rows, counts)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls, hosts, paths, verdicts = (b.column(i).to_pylist() for i in (1, 2, 3, 5))
            open_ = [i for i, v in enumerate(verdicts) if v is None]
            if open_:
                margin = trees.margin(_matrix(*([c[i] for i in open_] for c in (urls, hosts, paths)), shares))
                for i, m in zip(open_, margin):
                    verdicts[i] = "block" if m > 0 else "allow"
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 2, 3, 4)), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    known = ruled.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))
    return known.mapInArrow(decide, "page_id long, host string, path string, rule string, verdict string")
