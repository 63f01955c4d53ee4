"""Nearest neighbours by largest inner product, with a hash-prefix forest.

Every tree hashes a vector to a string of BITS signs of random projections; a tree is the array of all rows sorted by it. The
rows that share a prefix with a query are one stretch of that array. A query descends in all trees to its
longest matches and then ascends in all of them together, one bit at a time, until the stretches hold its
budget of candidates: SHARE of the rows and FEWEST, and more than k in some tree. All candidates are scored exactly.
Hash strings see angles only, while long vectors at wider angles have large inner products, too. So the longest rows, about LONG of all, stand in no
tree and are candidates of every query; of equal lengths all are taken or none, and none if they are more than MOST_LONG of the rows.

Equal vectors are one row, with the k + 1 smallest of their ids: no others can be among a query's k best, as equal scores rank by id. So copies
neither fill a query's places nor use up its budget.

Sizes of prefixes come from one histogram of TREES * 2**BITS cells over all rows, whose size is fixed. It also cuts each
sorted array into runs of about RUN rows; a cell larger than that is dealt to several parts by a hash of the vector, and its
queries, too, in blocks. Queries meet just the runs that their stretches touch. No run, part or block grows with the data.

Vectors that are null, zero, of another length than most or hold null or non-finite components take no part, nor do rows without id; of rows with one
id, whose vectors may be equal or not, a query counts each id once and never its own. Fewer candidates than k: all of them. Ties rank by id. Very long vectors only make rows wider.
Empty tables give an empty result; extra columns aren't read, so their names may clash with those of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

TREES, BITS, SEED, RUN, QUERIES, SHARE, FEWEST, LONG, MOST_LONG = 48, 12, 7, 4096, 2048, 0.6, 1000, 0.1, 0.3


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, TREES * BITS))


def _cells(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The hash string of each row in each tree."""
    signs = (x @ planes > 0).reshape(len(x), TREES, BITS)
    return (signs * (1 << np.arange(BITS)[::-1])).sum(2).astype(np.int32)


def _valid(vectors: DataFrame, dim: int) -> DataFrame:
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("id").isNotNull() & (F.size(v) == dim) & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Forest:
    """Histogram of the trees' cells, sums over them and the cut into runs."""

    def __init__(self, counts: np.ndarray, copies: np.ndarray, rows: int, asked_share: float, k: int, longest: int = 0, long_ids: int = 0):
        self.sums = np.concatenate([np.zeros((TREES, 1), np.int64), np.cumsum(counts, 1)], 1)
        self.budget, self.k = FEWEST + int(SHARE * rows), k
        self.run = np.zeros(counts.shape, np.int32)  # of each cell
        parts, held_ids = [], []  # of each run; a run's ids, copies included, tell how often it is asked
        for t in range(TREES):
            held = RUN + 1  # a tree begins with a run of its own
            for c in range(1 << BITS):
                if held + counts[t, c] > RUN:
                    parts.append(0)
                    held_ids.append(0)
                    held = 0
                self.run[t, c] = len(parts) - 1
                held += counts[t, c]
                held_ids[-1] += copies[t, c]
                parts[-1] = max(1, -(-held // RUN))
        self.long_run = len(parts)
        if longest:  # the longest rows are the last run
            parts.append(-(-longest // RUN))
            held_ids.append(long_ids)
        self.parts = np.array(parts, np.int32)
        self.blocks = np.maximum(1, np.ceil(np.maximum(self.parts * RUN, held_ids) * asked_share / QUERIES)).astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(self.parts * self.blocks)])  # shards of a run: part * blocks + block

    def stretches(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest cell, plus one, of each tree's stretch for each query."""
        depth = np.full(len(cells), -1)
        trees = np.arange(TREES)[None, :]
        for d in range(BITS, -1, -1):
            low = cells >> (BITS - d) << (BITS - d)
            held = self.sums[trees, low + (1 << (BITS - d))] - self.sums[trees, low]
            depth[(depth < 0) & (held.sum(1) >= self.budget) & (held.max(1) > self.k)] = d
        width = (BITS - np.maximum(depth, 0))[:, None]
        low = cells >> width << width
        return low, low + (1 << width)


def _shards(batches: Iterator[pa.RecordBatch], forest: Forest, planes: np.ndarray, ask: bool) -> Iterator[pa.RecordBatch]:
    dim = len(planes)
    for whole in batches:
        for at in range(0, len(whole), 256):
            b = whole.slice(at, 256)
            mixed, x = b.column(2).to_numpy(), _matrix(b.column(1), dim)
            cells = _cells(x, planes)
            rows, shards, lows, highs = [], [], [], []
            long = np.zeros(len(b), bool) if ask else b.column(3).to_numpy(zero_copy_only=False)
            # The longest rows have cell 0 of a tree of their own.
            cells = np.concatenate([cells, np.zeros((len(b), 1), np.int32)], 1)
            if ask:
                low, high = forest.stretches(cells[:, :TREES])
                low, high = np.concatenate([low, cells[:, TREES:]], 1), np.concatenate([high, cells[:, TREES:] + 1], 1)
            for i in range(len(mixed)):
                for t in range(TREES + 1) if ask else (TREES,) if long[i] else range(TREES):
                    if t == TREES:
                        runs = range(forest.long_run, len(forest.parts))
                    else:
                        runs = range(forest.run[t, low[i, t]], forest.run[t, high[i, t] - 1] + 1) if ask else (forest.run[t, cells[i, t]],)
                    for r in runs:
                        parts, blocks = int(forest.parts[r]), int(forest.blocks[r])
                        mine = range(int(mixed[i]) % blocks, parts * blocks, blocks) if ask else range((p := int(mixed[i]) % parts) * blocks, (p + 1) * blocks)
                        for s in mine:
                            rows.append(i)
                            shards.append(int(forest.first[r]) + s)
                            lows.append(int(low[i, t]) if ask else int(cells[i, t]))
                            highs.append(int(high[i, t]) if ask else 0)
            taken = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), b.column(0).take(taken), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), b.column(1).take(taken)], ["shard", "id" if ask else "ids", "low", "high", "v"])


def _best(queries: pa.Table, rows: pa.Table, dim: int, k: int) -> pa.Table:
    """The k best ids of the shard's rows within each query's stretch."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not len(queries) or not len(rows):
        return schema.empty_table()
    cells = rows["low"].to_numpy()
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    x = _matrix(rows["v"].combine_chunks(), dim)[order]
    lists = rows["ids"].combine_chunks().take(pa.array(order))
    ids, held = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    first_id, of = np.concatenate([[0], np.cumsum(held)]), np.repeat(np.arange(len(x)), held)  # row of each id
    names, name = np.unique(ids, return_inverse=True)
    several = len(names) < len(ids)  # ids with several vectors
    q = _matrix(queries["v"].combine_chunks(), dim)
    asked = queries["id"].to_numpy()
    # Products of a matrix are off by rounding in proportion to the vectors' lengths.
    slack = 1e-12 * np.sqrt((x**2).sum(1).max() * (q**2).sum(1))
    low, high = np.searchsorted(cells, queries["low"].to_numpy()), np.searchsorted(cells, queries["high"].to_numpy())
    out: list[list[np.ndarray]] = [[], [], []]
    for first in range(0, len(q), 256):
        products = q[first : first + 256] @ x.T
        for i in range(first, min(first + 256, len(q))):
            a, b = first_id[low[i]], first_id[high[i]]
            if a >= b:
                continue
            near = products[i - first, of[a:b]]
            own = ids[a:b] == asked[i]
            near[own] = -np.inf
            best = near
            if several:
                best = np.full(len(names), -np.inf)
                np.maximum.at(best, name[a:b], near)
            least = np.partition(best, -k)[-k] if len(best) > k else -np.inf
            at = np.flatnonzero(~own & (near >= least - slack[i]))
            # Summed in one order for every row, so that equal vectors tie exactly.
            score = (x[of[a + at]] * q[i]).sum(1)
            ranked = np.lexsort((ids[a + at], -score))
            if several:
                ranked = ranked[np.sort(np.unique(ids[a + at[ranked]], return_index=True)[1])]
            ranked = ranked[:k]
            out[0].append(np.full(len(ranked), asked[i]))
            out[1].append(ids[a + at[ranked]])
            out[2].append(score[ranked])
    if not out[0]:
        return schema.empty_table()
    return pa.table([np.concatenate(c) for c in out], schema=schema)


def _once(good: DataFrame, rows: int, k: int) -> DataFrame:
    """v, ids, copies: each vector once with the k + 1 smallest of its ids and their number. Ids of one vector are first dealt to about sqrt(rows / k) groups, so none of them meets all of a vector's rows."""
    deal = F.pmod(F.xxhash64("id"), F.lit(max(32, math.isqrt(rows // (k + 1)))))
    dealt = good.groupBy("v", deal.alias("deal")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    dealt = dealt.select("v", F.slice("ids", 1, k + 1).alias("ids"), F.size("ids").alias("copies"))
    return dealt.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.sum("copies").alias("copies"))


def search(vectors: DataFrame, asked, asked_share: float, k: int = 20, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which asked (a condition on `id`) holds; asked_share is about the share of rows that are asked."""
    spark = vectors.sparkSession
    ws = Workspace(spark)
    plain = vectors.select(F.col(id_).cast("long").alias("id"), F.col(embedding).alias("v"))
    sizes = plain.where("v is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes.dim if sizes else 0
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = _valid(plain, dim)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
    rows = ws.save(_once(good, sizes["count"], k).withColumn("norm", norm))
    cut = rows.agg(F.percentile_approx("norm", 1 - LONG, 1000)).first()[0]
    if cut is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Lengths that differ by rounding only are equal.
    above, with_equal = (F.col("norm") > c for c in (cut * (1 + 1e-6), cut * (1 - 1e-6)))
    n = rows.agg(F.count("*"), F.count_if(above), F.sum(F.when(above, F.col("copies"))), F.count_if(with_equal), F.sum(F.when(with_equal, F.col("copies")))).first()
    long, longest, long_ids = (with_equal, *n[3:]) if n[3] <= MOST_LONG * n[0] else (above, *n[1:3])
    planes = _planes(dim)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, TREES << BITS), np.int64)
        for b in batches:
            if len(b):
                at = (_cells(_matrix(b.column(0), dim), planes) + (np.arange(TREES) << BITS)).ravel()
                total[0] += np.bincount(at, minlength=TREES << BITS)
                total[1] += np.bincount(at, np.repeat(b.column(1).to_numpy(), TREES), TREES << BITS).astype(np.int64)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(n[at], pa.int64()) for n in total)], ["cell", "n", "copies"])

    found = rows.where(~long).select("v", "copies").mapInArrow(count, "cell int, n long, copies long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies")).toArrow()
    counts = np.zeros((2, TREES << BITS), np.int64)
    counts[:, found["cell"].to_numpy()] = [found["n"].to_numpy(), found["copies"].to_numpy()]
    counts, copies = counts.reshape(2, TREES, 1 << BITS)
    forest = Forest(counts, copies, int(counts[0].sum()), asked_share, k, longest, long_ids or 0)
    kind = dict(plain.dtypes)["v"]
    index = rows.select("ids", "v", F.xxhash64("v").alias("mixed"), long.alias("long")).mapInArrow(lambda it: _shards(it, forest, planes, False), f"shard int, ids array<long>, low int, high int, v {kind}")
    queries = good.where(asked).distinct().select("id", "v", F.xxhash64("id", "v")).mapInArrow(lambda it: _shards(it, forest, planes, True), f"shard int, id long, low int, high int, v {kind}")
    local = queries.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(lambda a, b: _best(a, b, dim, k), "query_id long, vec_id long, score double")
    once = ws.save(local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
