"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by floor(RATE * m) edits. Cut into one piece more than
that, at least one piece of any such passage is unchanged, so all exact piece hits (one
Aho-Corasick automaton over the whole text) lead to every match, and a bit-parallel edit distance (Myers) over the hit's
surroundings verifies it. Nothing is sampled: the result equals that of comparing every item with every passage.

Both sides are lower-cased and runs of blanks become one; places are code points of that text. Items are broken into
blocks of about BLOCK characters; each block's pieces go to all tasks, so what is broadcast stays bounded however
many items there are, and every block sees all documents. Benchmarks of up to BLOCK characters are one block, so documents are read once; larger ones take a pass a block.

Rows: null and blank texts match nothing, nor do null or blank items; a null id is returned as such; repeated documents give
their rows again, items of equal id and text count once. Empty tables give an empty result. Extra columns aren't read, and
come back unchanged from `clean`. Very long texts are searched to their end. Of equally near passages the first counts. One rule holds for items of every length: a short item is found inside longer words, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, BLOCK = 0.08, 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the first of the passages of text that are nearest to the pattern; None beyond the budget."""
    m = len(pattern)
    places: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        places[ch] = places.get(ch, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best = (m, 0) if m <= budget else None
    for j, ch in enumerate(text):
        eq = places.get(ch, 0)
        down = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (mask & ~(across | plus))
        low = plus & across
        if up & top:
            score += 1
        elif low & top:
            score -= 1
        up, low = up << 1 & mask, low << 1 & mask
        plus, minus = low | (mask & ~(down | up)), up & down
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Items:
    """One block's items and the automaton over their pieces."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.items = [(i, t, int(rate * len(t))) for i, t in items if t]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            cuts = [len(t) * j // (budget + 1) for j in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item_id, distance, budget, start, end) of each item's nearest passage in the whole text."""
        body = normal(text)
        if not body or not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, at) in self.automaton.iter(body):
            for k, a in at:
                _, t, budget = self.items[k]
                low = max(0, end + 1 - size - a - budget)
                high = min(len(body), end + 1 - size - a + len(t) + budget)
                mine = windows.setdefault(k, [])
                # Hits on nearly one diagonal share a window; others stay apart, so a window is short.
                if mine and abs(mine[-1][0] - low) <= budget:
                    mine[-1] = [min(mine[-1][0], low), max(mine[-1][1], high)]
                else:
                    mine.append([low, high])
        out = []
        for k, mine in windows.items():
            item, t, budget = self.items[k]
            best = None
            for low, high in sorted(map(tuple, {tuple(w) for w in mine})):
                if best and best[0] == 0:
                    break
                found = myers(t, body[low:high], budget)
                if found is None or best and found[0] >= best[0]:
                    continue
                distance, end = found[0], low + found[1]
                back = myers(t[::-1], body[low:end][::-1], distance)
                start = end - back[1]
                best = (distance, start, end)
            if best:
                out.append((item, best[0], budget, best[1], best[2]))
        return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items, in blocks of about BLOCK characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    blocks = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK) + 1
    for k in range(blocks):
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        yield sorted(((r.item_id, normal(r.text)) for r in rows.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, budget, start, end: a row for each document row and item that it holds a passage of."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, budget int, start int, end int"
    out = None
    for items in _blocks(benchmark):

        def look(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            known = Items(items)
            for b in batches:
                ids = b.column(0)
                rows = [(ids[i].as_py(), *m) for i, x in enumerate(b.column(1)) for m in known.matches(x.as_py())]
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "distance", "budget", "start", "end"])

        part = docs.mapInArrow(look, schema)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a passage of any item."""
    at = docs.columns.index("text")
    for items in _blocks(benchmark):

        def kept(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            known = Items(items)
            for b in batches:
                yield b.filter(pa.array([not known.matches(x.as_py()) for x in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs
