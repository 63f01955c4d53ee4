"""Chat formatting by incremental black-box rendering.

A template is a function from turns to text of which nothing else is known. Successive prefixes of a conversation are
rendered; where one output continues the one before, the new part is the span of the new turn, and the text's place in
it follows from rendering the same turn, in its context if that matters, with an empty text. A template whose output does not continue the one
before rewrites history: the spans then come from what the final output keeps, and the conversation is flagged.

The template here marks each turn with control strings. A control string inside a text or role gets a backslash after
its first character, and a row of backslashes there one more, so no text holds a control string and
`unescape` undoes `escape` exactly.

Conversations are dealt by id and sorted within partitions by turn (nulls last), role and text, and stream through a task one by one; none
is larger than the conversation that has to be written; the work on one grows with the square of its turns, as every prefix is rendered. Null texts and roles are empty; a null conv_id is a conversation of its own; repeated
turns are turns; an empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Fixed strings: the controls of this template and of common others.
CONTROLS = (OPEN, MIDDLE, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
FIRSTS = sorted({c[0] for c in CONTROLS})


def _inside(slashes: str) -> re.Pattern:
    """A control's first character and the backslashes before its rest."""
    return re.compile("|".join(f"{re.escape(f)}{slashes}(?={'|'.join(re.escape(c[1:]) for c in CONTROLS if c[0] == f)})" for f in FIRSTS))


_ESCAPE, _UNESCAPE = _inside(r"\\*"), _inside(r"\\+")


def escape(text: str) -> str:
    # Most texts hold no first character of a control, and prefixes render them again and again.
    return _ESCAPE.sub(lambda m: m[0] + "\\", text) if any(f in text for f in FIRSTS) else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text) if any(f in text for f in FIRSTS) else text


def marked(turns: list[Turn]) -> str:
    """The template: role and text of each turn between controls."""
    return "".join(f"{OPEN}{escape(role)}{MIDDLE}{escape(text)}{CLOSE}\n" for role, text in turns)


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]]
    rewrites: bool


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def render(turns: list[Turn], template: Template = marked) -> Rendered:
    """The whole conversation, each turn's span in it and whether the template rewrites what it wrote before."""
    before, spans, rewrites = template([]), [], False
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        at = len(before)
        if not now.startswith(before):
            rewrites, at = True, _common(before, now)
            spans = [(min(a, at), min(b, at)) for a, b in spans]
        spans.append((at, len(now)))
        before = now
    return Rendered(before, spans, rewrites)


def text_span(turns: list[Turn], k: int, out: Rendered, template: Template = marked) -> tuple[int, int]:
    """Where the k-th turn's text stands in the output.

    If the turn's span is what the turn alone renders to, the place in that short output holds; else the turn is rendered where it
    stands, after the turns before it. The same rendering with an empty text is what surrounds the text, and one with a probe tells where it goes.
    """
    a, b = out.spans[k]
    role, text = turns[k]
    before, start = [], template([])
    if not template([(role, text)]).startswith(start) or template([(role, text)])[len(start) :] != out.text[a:b]:
        before, start = turns[:k], out.text[:a]
    empty, probe = template([*before, (role, "")]), template([*before, (role, "\x00")])
    low = _common(probe, empty)
    after = len(empty) - low
    return a + low - len(start), b - after


def read_back(out: Rendered) -> list[Turn]:
    """Roles and texts from the output alone, by the controls of `marked`."""
    turns = []
    for a, b in out.spans:
        body = out.text[a:b]
        role, _, rest = body[len(OPEN) :].partition(MIDDLE)
        turns.append((unescape(role), unescape(rest[: -len(CLOSE) - 1])))
    return turns


def summarise(turns: list[Turn], template: Template = marked, read: Callable[[Rendered], list[Turn]] = read_back) -> tuple:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites, mask, text: read back from the output by `read`, which belongs to the template."""
    out = render(turns, template)
    back = read(out)
    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode("utf-8", "surrogatepass")).hexdigest()
    mask, loss = [], []
    for k, (role, _) in enumerate(back):
        if role == "assistant":
            low, high = text_span(turns, k, out, template)
            mask.append((low, high))
            loss.append(unescape(out.text[low:high]))
    learned = "".join(loss)
    return len(back), digest, len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(out.text), out.rewrites, mask, out.text


def _stream(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"] + ["text", "loss_mask"] * texts
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()] + [pa.string(), pa.list_(pa.list_(pa.int64()))] * texts

    def rows() -> Iterator[tuple]:
        turns: list[Turn] = []
        last: object = rows
        for b in batches:
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if conv != last and turns:
                    yield (last, *summarise(turns))
                    turns = []
                last = conv
                turns.append((role or "", text or ""))
        if turns:
            yield (last, *summarise(turns))

    held, size = [], 0
    for r in rows():
        held.append((*r[:7], r[8], [list(x) for x in r[7]])[: len(names)])
        size += r[5] if texts else 100
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def format_conversations(conversations: DataFrame, texts: bool = True) -> DataFrame:
    """A row for each conversation; texts adds the formatted text and the loss mask (spans of code points in it)."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    schema += ", text string, loss_mask array<array<long>>" if texts else ""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = (F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"))
    dealt = turns.repartition(F.col("conv_id")).sortWithinPartitions(*order).select("conv_id", "role", "text")
    return dealt.mapInArrow(lambda it: _stream(it, texts), schema)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts consist of another template's controls."""
    probe = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").union(extra)
