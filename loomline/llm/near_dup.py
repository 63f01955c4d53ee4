"""Near-duplicate detection with bottom-k sketches from one hash function.

A document's set holds its distinct five-word shingles. One hash orders all shingles; the
smallest POOL values of a set are its retained values and the smallest SKETCH its sketch.

1. Equal sets collapse to one class (128-bit digest), so exact copies cost one row each.
2. Inverted lists: every retained value that two classes or more hold gets a list. By counting, two
   sets of Jaccard similarity 0.75 or more share at least `need` retained values (exactly for
   small sets, with probability above 1 - 1e-6 otherwise), so each class enters only the
   lists of its rarest values (prefix filter): a passage that very many documents share is
   used only by classes that consist of little else.
3. Near round, linear in the rows of the lists: each class enters the lists of its FIRST least values, dealt at random
   into blocks of BLOCK rows. A row names its likeliest partner and the centre of its block (the row most like all others); then every row of a long list
   meets the likeliest of the centres of all its blocks. The union sketch estimates each pair.
4. The best three pairs of a class are verified on full sets, rebuilt from the whole texts, and give components.
5. Only lists that still hold several components go on. There all pairs of rows in different components are compared, but none within the
   largest component: its blocks meet the other rows' blocks only. A forest round verifies, of each group of rows, just a heaviest
   spanning forest over its components; a last round verifies every remaining pair whose ends are still in different components, so no link that would join two
   components is lost. Sets of up to SKETCH shingles are decided by their sketches, so what is left to verify are links, and
   pairs of larger sets whose estimates are close to the threshold.

Rows: null or blank texts have an empty set and link with nothing. Very long texts are read whole; their sketches are as long as all others. Repeated rows and ties fall in the same
class. A row with a null id takes the smallest known id of its component; without any, null, and it is kept
only then. An empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, byte_texts, components, folded_words, word_hashes

WIDTH, POOL, BLOCK, NUM, DEN = 5, 32, 512, 75, 100
#: Sketch lengths of the near round and of the rounds after it, and lists that a class enters in the near round.
SHORT, SKETCH, FIRST = 64, 256, 4
PAIRS = "a binary, b binary, score int, hub boolean, salt long, v long"


def need(width: int) -> int:
    """So many of the smallest `width` values of a union are common to both sets if 3/4 of the union are: the binomial's mean less 5.2 deviations."""
    return int(width * NUM / DEN - 5.2 * (width * NUM / DEN * (1 - NUM / DEN)) ** 0.5)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer than five words make one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    one = word_hashes(words)
    width = min(WIDTH, len(one))
    with np.errstate(over="ignore"):
        out = np.full(len(one) - width + 1, 0x51ED270B7A0F + width, np.uint64)
        for i in range(width):
            out ^= one[i : len(one) - width + 1 + i]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out >> np.uint64(1))


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 1000):
            b = whole.slice(at, 1000)
            sizes, keys, pools, sketches = [], [], [], []
            for text in byte_texts(b.column(1)):
                s = shingle_hashes(folded_words(text))
                sizes.append(len(s))
                keys.append(set_key(s))
                pools.append(s[:POOL].astype(np.int64))
                sketches.append((s[:SKETCH] >> np.uint64(32)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(pools, pa.int64()), _lists(sketches, pa.int32())],
                ["doc_id", "h", "n", "key", "pool", "sketch"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 200):
            sets = [shingle_hashes(folded_words(x)) for x in byte_texts(whole.slice(at, 200).column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.binary()), _lists([s.astype(np.int64) for s in sets], pa.int64())], ["key", "hashes"])


def union_overlap(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """0 where the union sketch rules the threshold out, else 1 and the estimated similarity in thousandths. a, b: a sorted sketch a row, -1 beyond a set's end."""
    width = a.shape[1]
    both = np.sort(np.concatenate([a, b], 1), 1)
    real = both >= 0
    new = real.copy()
    new[:, 1:] &= both[:, 1:] != both[:, :-1]
    rank = np.cumsum(new, 1, dtype=np.int32)
    twice = real & ~new
    union = rank[:, -1]
    whole = (na <= width) & (nb <= width)  # then the sketches are the sets
    seen = np.where(whole, union, np.minimum(width, union))
    common = (twice & (rank <= seen[:, None])).sum(1)
    few = np.minimum(need(width), np.ceil(NUM / DEN * np.maximum(na, nb)))
    return np.where(whole, DEN * common >= NUM * union, common >= few) * (1000 * common // np.maximum(seen, 1) + 1)


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value that two rows of keys share; -1 pads."""
    both = np.sort(np.concatenate([a, b], 1), 1)
    same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)
    return both[np.arange(len(both)), same.argmax(1)]


def _rows(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    """A list column as a matrix padded with -1."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    out = np.full((len(column), width), -1, kind)
    out[np.arange(width)[None, :] < np.diff(ends)[:, None]] = values[ends[0] : ends[-1]]
    return out


def _overlaps(sketch: np.ndarray) -> np.ndarray:
    """Values in common of all rows of a block, from an incidence matrix made in strips."""
    values, where, count = np.unique(sketch, return_inverse=True, return_counts=True)
    shared = np.flatnonzero((count > 1) & (values >= 0))
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[where.reshape(sketch.shape)]
    row = np.broadcast_to(np.arange(len(sketch))[:, None], column.shape)[column >= 0]
    column = column[column >= 0]
    out = np.zeros((len(sketch), len(sketch)), np.float32)
    for low in range(0, len(shared), 4096):
        mine = (column >= low) & (column < low + 4096)
        hits = np.zeros((len(sketch), min(4096, len(shared) - low)), np.float32)
        hits[row[mine], column[mine] - low] = 1
        out += hits @ hits.T
    return out


def _pairs_of(batches: Iterator[pa.RecordBatch], way: str) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by list and blocks; each group is two blocks long at most. way: see _work()."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows >= 20_000:
            table = pa.Table.from_batches(held).combine_chunks()
            groups = _group_starts(table)
            if len(groups) > 2:
                yield from _work(table.slice(0, groups[-2]), groups[:-1], way)
                rest = table.slice(groups[-2])
                held, rows = rest.combine_chunks().to_batches(), len(rest)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from _work(table, _group_starts(table), way)


def _group_starts(table: pa.Table) -> np.ndarray:
    cols = [table[c].to_numpy() for c in ("v", "i", "j")]
    if not len(table):
        return np.array([0])
    new = np.zeros(len(table), bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(table))


def _joined(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches along the edges (x, y)."""
    low = np.arange(n)
    while True:
        now = low.copy()
        np.minimum.at(now, x, low[y])
        np.minimum.at(now, y, low[x])
        now = now[now]
        if (now == low).all():
            return low
        low = now


def heaviest_forest(x: np.ndarray, y: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a heaviest spanning forest: each node takes its best edge, joined nodes become one node, and again."""
    order = np.argsort(-score, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    label, live, chosen = np.arange(n), np.arange(len(order)), [np.zeros(0, np.int64)]
    while len(live := live[label[x[live]] != label[y[live]]]):
        best = np.full(n, len(order))
        np.minimum.at(best, label[x[live]], rank[live])
        np.minimum.at(best, label[y[live]], rank[live])
        edges = order[np.unique(best[best < len(order)])]
        chosen.append(edges)
        label = _joined(n, label[x[edges]], label[y[edges]])[label]
    return np.concatenate(chosen)


def _groups_pairs(starts, n, sketch, mine, across, comp, hub, way) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one group that the overlap of their sketches leaves, and their score; 0 if the union sketch has to tell it."""
    width = sketch.shape[1]
    found = [np.zeros((3, 0), np.int64)]
    for s, e in zip(starts[:-1], starts[1:]):
        if e - s < 2:
            continue
        if way == "hub":
            p, q = (x.ravel() for x in np.meshgrid(np.flatnonzero(~hub[s:e]), np.flatnonzero(hub[s:e]), indexing="ij"))
            p, q, known = p + s, q + s, np.zeros(len(p), np.int64)
        elif e - s <= 24:
            p, q = np.triu_indices(e - s, 1)
            p, q, known = p + s, q + s, np.zeros(len(p), np.int64)
        else:
            m = n[s:e]
            few = np.minimum(need(width), np.ceil(NUM / DEN * m))
            overlap = _overlaps(sketch[s:e])
            ok = np.triu(overlap >= np.maximum(few[:, None], few[None, :]), 1)
            ok &= comp[s:e, None] != comp[None, s:e]
            p, q = np.nonzero(ok)
            common = overlap[p, q].astype(np.int64)
            union = m[p] + m[q] - common
            whole = np.maximum(m[p], m[q]) <= width
            take = ~whole | (DEN * common >= NUM * union)
            p, q, known = p[take] + s, q[take] + s, (whole * (1000 * common // union + 1))[take]
        if across[s]:  # pairs within a block meet elsewhere
            take = mine[p] != mine[q]
            p, q, known = p[take], q[take], known[take]
        found.append(np.stack([p, q, known]))
    return tuple(np.concatenate(found, 1))


def _work(table: pa.Table, starts: np.ndarray, way: str) -> Iterator[pa.RecordBatch]:
    """way: near (each row's likeliest partner and centre, and the centre of each block of a long list), hub (each row's centre),
    forest (a forest over the components of each group), every (all pairs between components)."""
    if not len(table):
        return
    keys, n = table["key"].to_numpy(zero_copy_only=False), table["n"].to_numpy()
    width = SHORT if way in ("near", "hub") else SKETCH
    sketch = _rows(table["sketch"], width, np.int32)
    between = way in ("forest", "every")
    mine, across = table["block"].to_numpy(), (table["i"].to_numpy() != table["j"].to_numpy()) & between
    comp = np.unique(table["comp"].to_numpy(zero_copy_only=False).astype("S32"), return_inverse=True)[1] if between else np.arange(len(table))
    p, q, score = _groups_pairs(starts, n, sketch, mine, across, comp, table["hub"].to_numpy(zero_copy_only=False), way)
    ok = (DEN * np.minimum(n[p], n[q]) >= NUM * np.maximum(n[p], n[q])) & (keys[p] != keys[q]) & (comp[p] != comp[q])
    p, q, score = p[ok], q[ok], score[ok]
    step = 500_000 // width
    if between and len(p):  # a pair of several lists counts in the first of them
        own, v = _rows(table["own"], POOL, np.int64), table["v"].to_numpy()
        first = np.concatenate([_first_common(own[p[k : k + step]], own[q[k : k + step]]) == v[p[k : k + step]] for k in range(0, len(p), step)])
        p, q, score = p[first], q[first], score[first]
    open_ = np.flatnonzero(score == 0)
    for x in (open_[k : k + step] for k in range(0, len(open_), step)):
        score[x] = union_overlap(sketch[p[x]], sketch[q[x]], n[p[x]], n[q[x]])
    p, q, score = p[score > 0], q[score > 0], score[score > 0]
    if not len(p):
        return
    v, salt = table["v"].to_numpy(), table["salt"].to_numpy()
    group = np.searchsorted(starts, np.arange(len(table)), "right")
    hub, nominated = np.zeros(len(p), bool), np.zeros(0, np.int64)
    if way == "near":
        p, q, score = np.concatenate([p, q]), np.concatenate([q, p]), np.tile(score, 2)
        order = np.lexsort((q, -score, p))
        p, q, score = p[order], q[order], score[order]
        weight = np.bincount(p, score, len(table)).astype(np.int64)
        centre = np.lexsort((-weight, group))
        centre = centre[np.unique(group[centre], return_index=True)[1]]
        hub = centre[group[p] - 1] == q
        nominated = centre[(weight[centre] > 0) & (salt[centre] > 0)]
        take = (p != np.append(-1, p[:-1])) | hub
        p, q, score, hub = p[take], q[take], score[take], hub[take]
    elif way == "hub":
        hub[:] = True
    else:
        if way == "forest":
            node = np.unique(group * (comp.max() + 1) + comp, return_inverse=True)[1]
            take = heaviest_forest(node[p], node[q], score, len(table))
            p, q, score, hub = p[take], q[take], score[take], hub[take]
        low = keys[p] < keys[q]
        p, q = np.where(low, p, q), np.where(low, q, p)
    none = [None] * len(p)
    yield pa.RecordBatch.from_arrays([pa.array(keys[p], pa.binary()), pa.array(keys[q], pa.binary()), pa.array(score, pa.int32()), pa.array(hub), pa.array(salt[p], pa.int64()), pa.array(none, pa.int64())], ["a", "b", "score", "hub", "salt", "v"])
    if len(nominated):
        most = np.minimum(weight[nominated], 2**31 - 1)
        same = pa.array(keys[nominated], pa.binary())
        yield pa.RecordBatch.from_arrays([same, same, pa.array(most, pa.int32()), pa.array(np.ones(len(most), bool)), pa.array(salt[nominated], pa.int64()), pa.array(v[nominated], pa.int64())], ["a", "b", "score", "hub", "salt", "v"])


def _candidates(dealt: DataFrame, way: str) -> DataFrame:
    """What _work() makes of every group (v, i, j). salt is 0 in lists of one block, else it tells groups apart, so a row's pairs can be dealt by it."""
    columns = dealt.select("v", "i", "j", "block", "key", "n", "sketch", "comp", "own", "hub", F.when(F.col("blocks") > 1, F.shiftrightunsigned(F.xxhash64("v", "i", "j"), 1) + 1).otherwise(0).alias("salt"))
    return columns.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j").mapInArrow(lambda it: _pairs_of(it, way), PAIRS)


def _near(ws: Workspace, lists: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, salt: for each class its two likeliest partners and its likeliest centre. At most three rows for each row of the lists on the way."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    short = classes.select("key", "n", F.slice("sketch", 1, SHORT).alias("sketch"))
    dealt = lists.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", "v"), blocks).cast("int")).join(short, "key")
    bare = [F.lit(None).cast("binary").alias("comp"), F.array().cast("array<long>").alias("own")]
    dealt = dealt.select("v", F.col("block").alias("i"), F.lit(0).alias("j"), "block", "blocks", "key", "n", "sketch", *bare, F.lit(False).alias("hub"))
    near = ws.save(_candidates(dealt, "near"))
    # The likeliest centre of each long list is dealt to all its blocks.
    best = near.where("v is not null").groupBy("v").agg(F.max(F.struct("score", F.col("a").alias("key"))).alias("x")).select("v", "x.key")
    long = lists.groupBy("v").agg(F.first("size").alias("size")).select("v", blocks.alias("blocks")).where("blocks > 1")
    centres = best.join(long, "v").join(short, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    centres = centres.select("v", F.col("block").alias("i"), F.lit(0).alias("j"), "block", "blocks", "key", "n", "sketch", *bare, F.lit(True).alias("hub"))
    found = near.where("v is null").union(_candidates(dealt.where("blocks > 1").union(centres), "hub")).select("a", "score", "b", "salt", "hub")
    partners = F.slice(F.sort_array(F.collect_set(F.struct("score", "b", "salt")), False), 1, 2)
    centre = F.array_compact(F.array(F.max(F.when(F.col("hub"), F.struct("score", "b", "salt")))))
    pairs = found.groupBy("a").agg(F.concat(partners, centre).alias("x")).select("a", F.explode("x").alias("x")).select("a", "x.b", "x.salt")
    out = ws.save(pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("salt").alias("salt")))
    ws.drop(near)
    return out


def _several(ws: Workspace, lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components, with v's largest component."""
    named = lists.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root", "size")
    each = named.groupBy("v", "comp").agg(F.count("*").alias("c"))
    whole = each.groupBy("v").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    return ws.save(named.join(whole, "v"))


def _between(several: DataFrame, classes: DataFrame, way: str) -> DataFrame:
    """Pairs between components. The largest component's blocks meet the blocks of other rows only, those of other rows all blocks."""
    size, big, one = F.col("size"), F.col("comp") == F.col("top.comp"), F.col("size") <= BLOCK
    rest, most = F.ceil((size - F.col("top.c")) / BLOCK).cast("int"), F.ceil(F.col("top.c") / BLOCK).cast("int")
    hashed = F.xxhash64("key", "v")
    block = F.when(one, 0).when(big, rest + F.pmod(hashed, most).cast("int")).otherwise(F.pmod(hashed, rest).cast("int"))
    others = F.sequence(F.lit(0), F.when(one, 0).when(big, rest - 1).otherwise(rest + most - 1))
    dealt = several.withColumn("block", block).withColumn("blocks", F.when(one, 1).otherwise(rest + most)).withColumn("other", F.explode(others))
    dealt = dealt.select("v", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "blocks", "key", "comp", "own", F.lit(False).alias("hub"))
    found = _candidates(dealt.join(classes.select("key", "n", "sketch"), "key"), way)
    return found.groupBy("a", "b").agg(F.min("salt").alias("salt"))


def _verified(ws: Workspace, docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that reach the threshold on full sets, rebuilt from the documents that stand for the classes.

    Sets meet pairs by key and salt: a class of very many pairs has its set in as many places as groups its pairs come from.
    """
    places = pairs.select(F.explode(F.array("a", "b")).alias("key"), "salt").distinct()
    wanted = places.select("key").distinct().join(classes.select("key", "rep"), "key")
    texts = docs.join(wanted.select("rep").distinct(), docs["doc_id"].eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = ws.save(texts.mapInArrow(_full_sets, "key binary, hashes array<long>").dropDuplicates(["key"]))
    placed = places.join(sets, "key")
    one = pairs.join(placed.select(F.col("key").alias("a"), "salt", F.col("hashes").alias("x")), ["a", "salt"])
    two = one.join(placed.select(F.col("key").alias("b"), "salt", F.col("hashes").alias("y")), ["b", "salt"])
    common = F.size(F.array_intersect("x", "y"))
    two = two.select("a", "b", common.alias("common"), (F.size("x") + F.size("y") - common).alias("all"))
    out = ws.save(two.where(F.lit(DEN) * F.col("common") >= F.lit(NUM) * F.col("all")).select("a", "b"))
    ws.drop(sets)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (see the module for edge cases)."""
    return _resolved(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _resolved(docs: DataFrame) -> DataFrame:
    """near_duplicates() with h, a hash of the text."""
    ws = Workspace(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = ws.save(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(_sketches, "doc_id long, h long, n long, key binary, pool array<long>, sketch array<int>"))
    classes = ws.save(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("pool").alias("pool"), F.first("sketch").alias("sketch")))
    whole, rows = rows, ws.save(rows.select("doc_id", "h", "n", "key"))
    ws.drop(whole)

    held = classes.select("key", "n", F.explode("pool").alias("v"))
    shared = held.join(held.groupBy("v").agg(F.count("*").alias("size")).where("size > 1"), "v")
    least = F.least(F.lit(need(POOL)), F.ceil(F.col("n") * NUM / DEN)).cast("int")
    mine = shared.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("size", "v"))).alias("own"))
    prefix = mine.where(F.size("own") >= least).select("key", F.slice("own.v", F.lit(1), F.size("own") - least + 1).alias("own"))
    # In the near round a class stands in the lists of its least shared values, which near copies have in common, rare or not.
    every = mine.where(F.size("own") >= least).select("key", F.explode(F.slice(F.array_sort("own.v"), 1, FIRST)).alias("v"))
    near = ws.save(every.join(every.groupBy("v").agg(F.count("*").alias("size")).where("size > 1"), "v"))
    prefix = ws.save(prefix.select("key", "own", F.explode("own").alias("v")))
    lengths = prefix.groupBy("v").agg(F.count("*").alias("size")).where("size > 1")
    lists = ws.save(prefix.join(lengths, "v"))
    ws.drop(prefix)

    tried = _near(ws, near, classes)
    links = _verified(ws, docs, classes, tried)
    roots = ws.save(components(ws, links))
    ws.drop(near, links)
    for way in ("forest", "every"):
        several = _several(ws, lists, roots)
        if several.isEmpty():
            break
        pairs = ws.save(_between(several, classes, way).join(tried, ["a", "b"], "left_anti"))
        ws.drop(several)
        more = _verified(ws, docs, classes, pairs)
        tried, old = ws.save(tried.select("a", "b").union(pairs.select("a", "b"))), [tried, pairs]
        if not more.isEmpty():
            edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
            roots, was = ws.save(components(ws, edges)), roots
            old.append(was)
        ws.drop(more, *old)
    ws.drop(lists, tried)

    least = classes.select("key", "rep").join(roots.select(F.col("node").alias("key"), "root"), "key")
    ids = least.join(least.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("key", "component_id")
    named = ws.save(classes.select("key", "rep").join(ids, "key", "left").select("key", F.coalesce("component_id", "rep").alias("component_id")))
    ws.drop(classes, roots)
    full = rows.where("n > 0").join(named, "key").select("doc_id", "h", "n", "component_id")
    empty = rows.where("n = 0").select("doc_id", "h", "n", F.col("doc_id").alias("component_id"))
    every = full.union(empty)
    kept = F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id"))
    return every.select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep; of rows with one id and text, one stays."""
    ws = Workspace(docs.sparkSession)
    found = ws.save(_resolved(docs).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "kept"))
    gone = found.where("not kept").select("_id", "_h").distinct()
    twice = found.where("kept").groupBy("_id", "_h").count().where("count > 1").select("_id", "_h")

    def same(other: DataFrame):
        return docs["doc_id"].cast("long").eqNullSafe(other["_id"]) & (F.xxhash64(docs["text"]) == other["_h"])

    left = docs.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return left
    # Repeated rows are rare; only they are compared with each other.
    again = left.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same(twice), "left_anti").unionByName(again)
