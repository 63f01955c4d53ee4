"""Repair of conversation structure by cost layers.

A conversation is well-formed if its roles' initials are `(s?(ua)+)?`. Each row is kept (0), given another role (3) or
deleted (4), and rows without text may be inserted anywhere (3); rows that are blank or repeat an earlier one must go, and each truncated row that
doesn't costs 3 more. The cheapest edits are found in the manner of Wu and Manber: layer c holds, for each turn, the set of grammar
states from which the end is reached at a cost of exactly c, as bits, and each layer comes from the ones below it by shifts and masks.
The first layer that holds the start gives the cost; following its bits from the first turn on, always by the least edit letter that keeps the cost
(D, I, K, R), gives the audit that is least among the cheapest.

Turns are taken in blocks of BLOCK from the last one back: the layers of a block start from the least costs that each state has at the block's
end and run until every state has got its own at the block's beginning, which is a few layers beyond the block's own cost. So work grows with the turns, not with turns times
cost. Blocks of the same faults, initials and costs are reckoned once in a task (a bounded cache).

Rows are dealt by conversation and sorted by turn, role and text (nulls first), and a task holds one conversation at a time: its audit is one value and its hash
runs over all its texts, so a single conversation has to fit into one task. Texts of any length are read whole.

Rows: nulls in role and text become one space, a null turn stands first and is ignored by gaps, null conv_ids are one conversation. Repeated rows are duplicates of each other. A role
without any character has no initial: it can't be kept, and its pairs are illegal. Equal turns are ordered by role and text, so results don't depend on the order of the input. A conversation of which nothing is left after damage
has zeros and an empty audit. An empty table gives an empty result. Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLOCK, CACHE, LARGE_CACHE = 64, 1 << 13, 1 << 8
#: States: nothing yet, after a system row, after a user row, after an assistant row. A set of states has bit 1 << state.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS, ALL = (0, None, None, 0), 15
#: For each initial, which state leads to which; a row of a free role leads to user or assistant.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FREE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
PAIRS = frozenset(("su", "ua", "au"))
_BLANKS = " \t\n\x0b\x0c\r"


def _into(steps: dict[int, int]) -> list[int]:
    """For each set of states, those from which a step leads into it."""
    return [sum(1 << before for before, after in steps.items() if states >> after & 1) for states in range(ALL + 1)]


_INTO_FREE, _INTO = _into(FREE), {k: _into(v) for k, v in STEPS.items()}


def _kind(role: str, fault: str) -> str:
    """What the layers need to know of a row: x (must go), or its initial if it can be kept (else -), in capitals (else +) if it is truncated."""
    if fault in ("blank", "duplicate"):
        return "x"
    initial = role[:1]
    if fault == "truncated":
        return initial.upper() if initial in STEPS else "+"
    return initial if initial in STEPS else "-"


@lru_cache(maxsize=LARGE_CACHE)
def _layers(kinds: str, ends: tuple[int | None, ...], last: bool) -> tuple[list[list[int]], tuple[int, ...]]:
    """layers[c][i]: the states before turn i of the block from which the end is reached at exactly c; ends has the cost that each state has there. And the least cost of each state at the beginning."""
    n, layers, least = len(kinds), [], {}
    while len(least) < 4:
        c = len(layers)
        three = layers[c - 3] if c >= 3 else None
        four = layers[c - DELETE] if c >= DELETE else None
        six = layers[c - REROLE - CUT] if c >= REROLE + CUT else None
        now = [0] * (n + 1)
        now[n] = sum(1 << q for q in range(4) if ends[q] == c) | (_INTO_FREE[three[n]] if last and three else 0)
        for i in range(n - 1, -1, -1):
            kind, bits = kinds[i], 0
            if three:
                bits = _INTO_FREE[three[i]]
                if kind in "sua-":
                    bits |= _INTO_FREE[three[i + 1]]
                elif kind in "SUA":
                    bits |= _INTO[kind.lower()][three[i + 1]]
            if four:
                bits |= four[i + 1]
            if six and kind in "SUA+":
                bits |= _INTO_FREE[six[i + 1]]
            if kind in "sua":
                bits |= _INTO[kind][now[i + 1]]
            now[i] = bits
        layers.append(now)
        for q in range(4):
            if now[0] >> q & 1:
                least.setdefault(q, c)
    return layers, tuple(least[q] for q in range(4))


@lru_cache(maxsize=CACHE)
def _least(kinds: str, ends: tuple[int | None, ...], last: bool) -> tuple[int, ...]:
    return _layers(kinds, ends, last)[1]


@lru_cache(maxsize=CACHE)
def _trace(kinds: str, ends: tuple[int | None, ...], last: bool, state: int) -> tuple[str, tuple[str | None, ...], int]:
    """The least letters of the cheapest edits of a block from a state on, the role that each edit gives, and the state at the block's end."""
    layers, least = _layers(kinds, ends, last)
    i, c, n = 0, least[state], len(kinds)
    letters, roles = [], []

    def leads(cost: int, turn: int, to: int | None) -> bool:
        return to is not None and cost <= c and turn <= n and bool(layers[c - cost][turn] >> to & 1)

    while i < n or last and c > 0:
        kind = kinds[i] if i < n else ""
        extra, free = (CUT if kind in "SUA+" else 0), FREE[state]
        if kind and leads(DELETE, i + 1, state):
            step = ("D", None, DELETE, i + 1, state)
        elif leads(INSERT, i, free):
            step = ("I", ROLES[free], INSERT, i, free)
        elif kind.lower() in STEPS and leads(extra, i + 1, STEPS[kind.lower()].get(state)):
            step = ("K", None, extra, i + 1, STEPS[kind.lower()][state])
        else:
            step = ("R", ROLES[free], REROLE + extra, i + 1, free)
        letters.append(step[0])
        roles.append(step[1])
        c, i, state = c - step[2], step[3], step[4]
    return "".join(letters), tuple(roles), state


def cheapest(kinds: str) -> tuple[int, str, list[str | None]]:
    """The least cost, the least audit of that cost, and the role that each of its edits gives (none for D and K)."""
    blocks = [kinds[i : i + BLOCK] for i in range(0, len(kinds), BLOCK)] or [""]
    ends: tuple[int | None, ...] = ENDS
    base, plan = 0, []
    for k, block in reversed(list(enumerate(blocks))):
        last = k == len(blocks) - 1
        plan.append((block, ends, last))
        least = _least(block, ends, last)
        low = min(least)
        cost, base, ends = base + least[START], base + low, tuple(x - low for x in least)
    letters, roles, state = [], [], START
    for block, ends, last in reversed(plan):
        some, given, state = _trace(block, ends, last, state)
        letters.append(some)
        roles.extend(given)
    return cost, "".join(letters), roles


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text): blank, duplicate, truncated or none."""
    seen: set[bytes] = set()
    out = []
    for role, text in rows:
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
        body = text.rstrip(_BLANKS)
        out.append("blank" if not body else "duplicate" if digest in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add(digest)
    return out


def mend(rows: list[tuple[str, str]]) -> tuple[list[str], int, str, list[tuple[str, str, str, int | None]]]:
    """Faults, cost, audit and the repaired rows as (role, text, edit, place of the row that it was, if any)."""
    found = faults(rows)
    cost, audit, roles = cheapest("".join(_kind(role, fault) for (role, _), fault in zip(rows, found)))
    out, i = [], 0
    for letter, role in zip(audit, roles):
        if letter == "I":
            out.append((role, "", letter, None))
            continue
        if letter != "D":
            out.append((role or rows[i][0], rows[i][1], letter, i))
        i += 1
    return found, cost, audit, out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[int | None, str, str]]]]:
    """Each conversation with its living rows (turn, role, text); batches are sorted by conversation."""
    rows: list[tuple] = []
    last: object = _conversations
    for b in batches:
        for conv, turn, role, text, alive in zip(*(b.column(k).to_pylist() for k in range(5))):
            if conv != last and last is not _conversations:
                yield last, rows
                rows = []
            last = conv
            if alive:
                rows.append((turn, role, text))
    if last is not _conversations:
        yield last, rows


def _summary(rows: list[tuple[int | None, str, str]]) -> tuple:
    found, cost, audit, out = mend([r[1:] for r in rows])
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in PAIRS for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text, *_ in out).encode("utf-8", "surrogatepass")).hexdigest()
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest


def _batches(rows: Iterator[tuple], names: list[str], kinds: list, size=lambda r: 200) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _dealt(conversations: DataFrame) -> DataFrame:
    """Rows dealt by conversation and in order; rows that aren't alive only say that their conversation exists."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)  # noqa: E731
    alive = F.col("alive") if "alive" in conversations.columns else F.lit(True)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), alive.alias("alive"))
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def audited(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of conv_id, turn, role, text."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((conv, *_summary(rows)) for conv, rows in _conversations(batches)), names, kinds)

    return _dealt(conversations).mapInArrow(each, ", ".join(f"{c} long" for c in names[:7]) + ", audit string, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn, role, text, edit: the repaired conversations; inserted rows have no turn."""
    names, kinds = ["conv_id", "place", "turn", "role", "text", "edit"], [pa.int64()] * 3 + [pa.string()] * 3

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, rows in _conversations(batches):
            for place, (role, text, edit, was) in enumerate(mend([r[1:] for r in rows])[3]):
                yield conv, place, None if was is None else rows[was][0], role, text, edit

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows_of(batches), names, kinds, lambda r: 100 + 4 * len(r[4]))

    return _dealt(conversations).mapInArrow(each, "conv_id long, place long, turn long, role string, text string, edit string")


def damage(conversations: DataFrame) -> DataFrame:
    """The conversations with faults by crc32(`conv_id:turn`) % 20; dropped rows stay as rows that aren't alive."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"), (fate != 0).alias("alive"), F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.withColumn("copy", F.explode("copies")).drop("copy", "copies")


_FREE = "least(s0, s1, s3)"


def _plus(key: str, cost: str, letter: str) -> str:
    """A key is a cost of nine digits and the letters so far, so the least key is the cheapest with the least letters."""
    return f"(lpad(CAST(CAST(left({key}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{letter}')"


def _closed(n0: str, n1: str, n2: str, n3: str) -> str:
    """s0 to s3 after rows may have been inserted, from columns of these names."""
    user = f"least({n2}, {_plus(f'least({n0}, {n1}, {n3})', '3', 'I')})"
    return f"{n0} AS s0, {n1} AS s1, {user} AS s2, least({n3}, {_plus(user, '3', 'I')}) AS s3"


ORACLE = rf"""
WITH RECURSIVE c AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS fate FROM c),
d AS (
  SELECT g, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM k)),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS MATERIALIZED (
  SELECT *, left(role, 1) AS x, left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
s AS (
  SELECT g, CAST(0 AS BIGINT) AS i, {_closed("z", "v", "v", "v")} FROM (SELECT DISTINCT g, '000000000' AS z, CAST(NULL AS VARCHAR) AS v FROM c)
  UNION ALL
  SELECT g, i, {_closed("n0", "n1", "n2", "n3")} FROM (
    SELECT f.g, f.i, {_plus("s0", "4", "D")} AS n0,
      least({_plus("s1", "4", "D")}, CASE WHEN stays AND x = 's' THEN {_plus("s0", "extra", "K")} END) AS n1,
      least({_plus("s2", "4", "D")}, CASE WHEN stays AND x = 'u' THEN {_plus(_FREE, "extra", "K")} END, CASE WHEN stays THEN {_plus(_FREE, "3 + extra", "R")} END) AS n2,
      least({_plus("s3", "4", "D")}, CASE WHEN stays AND x = 'a' THEN {_plus("s2", "extra", "K")} END, CASE WHEN stays THEN {_plus("s2", "3 + extra", "R")} END) AS n3
    FROM s JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra FROM f) f ON f.g = s.g AND f.i = s.i + 1)),
b AS (SELECT g, arg_max(least(s0, s3), i) AS key FROM s GROUP BY g),
e AS (SELECT g, p, substr(key, 9 + p, 1) AS e FROM (SELECT *, unnest(range(1, length(key) - 8)) AS p FROM b)),
t AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER w AS i, count(*) FILTER (WHERE e <> 'D') OVER w AS place FROM e WINDOW w AS (PARTITION BY g ORDER BY p)),
r AS (SELECT t.g, p, e, place, f.role, f.text, max(CASE WHEN place = 1 AND e = 'K' AND x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY t.g) AS shift FROM t LEFT JOIN f ON f.g = t.g AND f.i = t.i AND e <> 'I' WHERE e <> 'D'),
h AS (SELECT g, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS made FROM r GROUP BY g),
n AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(left(key, 9) AS BIGINT) AS cost, substr(key, 10) AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM c) a JOIN b ON b.g = a.g LEFT JOIN h ON h.g = a.g LEFT JOIN n ON n.g = a.g
"""
