"""Filter audit, exact duplicates and conversation repair on edge cases and against plain Python."""

import hashlib
import re
from collections import Counter
from itertools import permutations, product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import exact_dedup, filter_audit, repair

from .helpers import BASE, LONG, TEXTS, documents

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Filter audit


def plain_failures(rows):
    """(doc_id, letters) of each row by comparing every pair."""
    out = []
    for i, t, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = "A" if len(words) < 200 else ""
        fails += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else ""
        fails += "D" if re.search("[#$%&*|]", t) else ""
        fails += "E" if any(j is not None and i is not None and j < i and (u or "") == t for j, u, *_ in rows) else ""
        out.append((i, fails))
    return out


AUDITED = [
    *TEXTS, (20, BASE, "a"), (21, "x " * 300, "a"), (22, "x " * 300, "b"), (23, "ÄÖ ÜA " * 100, "b"), (24, "a | b", "c"), (24, "a | b", "c"), (25, "a | b", None),
    (30, " ".join(f"v{k}" for k in range(250)) + " é", "a"), (31, " ".join(f"v{k}" for k in range(250)), "a"), (-5, "", "b"), (None, "a | b", "c"),
]


def test_failures_of_small_documents(spark):
    got = filter_audit.failures(documents(spark, AUDITED)).collect()
    assert Counter((r.doc_id, r.fails) for r in got) == Counter(plain_failures(AUDITED))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_copies_that_range_borders_cut_apart(spark, parts):
    rows = [(i, f"text {i % 3} | {'w ' * (i % 2)}", "s") for i in range(120)] + [(i, "one large group", "s") for i in range(500, 620)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = filter_audit.failures(documents(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((r.doc_id, r.fails) for r in got) == Counter(plain_failures(rows))


def test_colliding_fingerprints_of_one_border(spark):
    """Two texts under one fingerprint, in two ranges: each is compared with itself only."""
    import pyarrow as pa

    def ran(rows):
        batch = pa.RecordBatch.from_arrays([pa.array([7] * len(rows)), pa.array([r[0] for r in rows]), pa.array(["p"] * len(rows)), pa.array([r[1] for r in rows])], ["fp", "doc_id", "part", "text"])
        return [r for b in filter_audit._compared(iter([batch])) for r in b.to_pylist()]

    first, second = ran([(1, "x"), (3, "x"), (2, "y")]), ran([(5, "x"), (6, "y"), (8, "y"), (9, "z")])
    rows = first + second
    least = {}
    for r in rows:
        if r["least"] is not None:
            least[r["text"]] = min(least.get(r["text"], 99), r["least"])
    got = {r["doc_id"]: "E" in r["fails"] or r["text"] is not None and r["doc_id"] > least[r["text"]] for r in rows if r["least"] is None}
    assert got == {1: False, 3: True, 2: False, 5: True, 6: True, 8: True, 9: False}


def test_audit_counts_every_order(spark):
    rows = [r for r in AUDITED if r[0] is not None]
    labels = [(1, 1, 0), (20, 1, 1), (22, 0, 1), (24, 1, 0), (24, 0, 1), (25, None, None), (None, 1, 1), (999, 1, 1)]
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "source").collect()}
    fails, sources = plain_failures(rows), [s or "" for *_, s in rows]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    assert len(got) == 120 * 5 * len(set(sources))
    removed = Counter()
    for order in permutations("ABCDE"):
        for (_, f), s in zip(fails, sources):
            first = next((x for x in order if x in f), None)
            removed[s, first] += 1
    for part in set(sources):
        mine = [x for x, s in zip(fails, sources) if s == part]
        for order in ("ABCDE", "EDCBA", "CAEBD"):
            left = list(mine)
            for k, letter in enumerate(order):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                r = got[part, order, k + 1]
                assert (r.kept, r.removed, r.redundant) == (len(left), len(gone), sum(letter in f for _, f in mine) - len(gone))
                assert r.unique_fails == sum(f == letter for _, f in mine) and r.shapley == removed[part, letter]
                assert (r.good_lost, r.toxic_lost) == (sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, []), labels).count() == 0


def test_counters_add_up(spark):
    """Counters of two halves of a corpus, with no copies across them, give the counters of the whole."""
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    halves = [[(i, f"{h} {i} " + "w " * i, "s") for i in range(h * 10, h * 10 + 5)] for h in (1, 2)]
    whole = filter_audit.unfold(filter_audit.masks(filter_audit.failures(documents(spark, halves[0] + halves[1])), labels))
    parts = [filter_audit.masks(filter_audit.failures(documents(spark, h)), labels) for h in halves]
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, filter_audit.unfold(parts[0].unionByName(parts[1])).collect()))


# Exact duplicates


def plain_duplicates(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        spent = False
        for i in ids:
            kept = i == keep and not spent
            spent = spent or kept
            out[i, keep, len(ids), kept, sha] += 1
    return out


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_duplicates_of_small_documents(spark, parts):
    rows = [*TEXTS, (50, "É", "a"), (51, "é", "a"), (52, LONG.upper(), "a"), *((i, BASE.title(), "z") for i in range(100, 160))]
    got = exact_dedup.duplicates(documents(spark, rows), parts)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == plain_duplicates(rows)


def test_duplicates_of_nothing(spark):
    assert exact_dedup.duplicates(documents(spark, [])).count() == 0


def test_an_index_is_kept_and_reopened(spark, tmp_path):
    def index():
        return exact_dedup.DigestIndex(spark, str(tmp_path / "index"))

    first = [(1, "one", "s"), (2, "ONE", "s"), (3, None, "s"), (None, "two", "s"), (4, "three", "s"), (4, "three", "s")]
    second = [(9, "One", "s"), (5, "four", "s"), (None, "two", "s"), (None, "five", "s"), (8, "four", "s")]
    kept = lambda rows, name: Counter((r.doc_id, r.text, r.key) for r in exact_dedup.keep(documents(spark, rows), index(), name).collect())
    assert kept(first, "monday") == Counter([(2, "ONE", None), (3, None, None), (None, "two", None), (4, "three", None)])
    # A delivery that is brought again, as after a lost driver, keeps the same rows and adds nothing.
    assert kept(first, "monday") == Counter([(2, "ONE", None), (3, None, None), (None, "two", None), (4, "three", None)])
    assert index().rows().count() == 4
    assert kept(second, "tuesday") == Counter([(None, "five", None), (8, "four", None)])
    assert index().rows().count() == 6
    assert exact_dedup.keep(documents(spark, second), index(), "tuesday").columns == documents(spark).columns


def test_the_index_is_joined_without_a_shuffle(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))
    index.add(exact_dedup.digests(exact_dedup.numbered(documents(spark))), "a")
    new = index.unknown(spark.createDataFrame([(b"1", 1)], "digest binary, keep_id long"))
    plan = new._jdf.queryExecution().executedPlan().toString()
    rows, held = plan[plan.index("SortMergeJoin") :].rsplit("Sort [digest", 1)
    assert rows.count("Exchange") == 1 and "Bucketed: true" in held and "Exchange" not in held


# Conversation repair


def plain_repair(rows):
    """Cost and audit by trying every edit, dearest no more than deleting all."""
    grammar = re.compile("s?(ua)*u?")
    found = repair.faults(rows)
    best = []

    def go(i, out, made, audit, cost):
        if cost > 4 * len(rows) or not grammar.fullmatch(out):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            best.append((cost, audit, "\n".join(made)))
        for role in ("user", "assistant"):
            go(i, out + role[0], [*made, f"{role}:"], audit + "I", cost + 3)
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, out, made, audit + "D", cost + 4)
            if found[i] not in ("blank", "duplicate"):
                extra = 3 * (found[i] == "truncated")
                if role:
                    go(i + 1, out + role[0], [*made, f"{role}:{text}"], audit + "K", cost + extra)
                for to in ("user", "assistant"):
                    go(i + 1, out + to[0], [*made, f"{to}:{text}"], audit + "R", cost + 3 + extra)

    go(0, "", [], "", 0)
    return min(best)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["a.", "b!", "c", " ", "a. \n"])), max_size=4))
def test_repairs_equal_those_of_trying_everything(rows):
    _, cost, audit, out = repair.mend(rows)
    assert (cost, audit, "\n".join(f"{r}:{t}" for r, t, *_ in out)) == plain_repair(rows)


@settings(max_examples=60, deadline=None)
@given(st.text("suaSUAx-+", max_size=40))
def test_blocks_don_t_change_repairs(kinds):
    whole = repair.cheapest(kinds)
    for size in (1, 3, 7):
        was, repair.BLOCK = repair.BLOCK, size
        try:
            assert repair.cheapest(kinds) == whole
        finally:
            repair.BLOCK = was


def test_long_conversations_take_time_in_proportion():
    kinds = "suaSuaxau" * 3000
    cost, audit, roles = repair.cheapest(kinds)
    assert len(audit) == len(roles) and sum(c != "I" for c in audit) == len(kinds) and 0 < cost < 4 * len(kinds)


def turns(spark, rows):
    schema = "conv_id long, turn long, role string, text string, cost long, alive2 string"
    return spark.createDataFrame([(*r, 1, "x") for r in rows], schema)


def test_repair_of_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."),
        (2, None, "assistant", "First."), (2, 5, "user", "cut"), (2, 5, "user", "cut"), (2, 9, None, None),
        (None, 0, "system", "S."), (None, 1, "user", "U?"),
        (3, 0, "user", " \n"), (4, 0, "", "No role."), (5, 0, "user", "x" * 200_000 + "!"),
    ]
    got = {r.conv_id: r for r in repair.audited(turns(spark, rows)).collect()}
    assert (got[1].cost, got[1].audit) == (0, "KK") and got[1].repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    two = got[2]
    assert (two.gaps, two.blank, two.duplicate, two.truncated, two.illegal) == (9 - 5 + 1 - 2, 1, 1, 1, 2)
    assert (two.cost, two.audit) == plain_repair([("assistant", "First."), ("user", "cut"), ("user", "cut"), (" ", " ")])[:2]
    assert (got[None].cost, got[None].audit) == (3, "KKI") and (got[3].cost, got[3].audit) == (4, "D") and got[3].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[4].cost, got[4].audit) == (4, "D") and (got[5].cost, got[5].audit) == (3, "KI")
    rows_out = [(r.role, r.text, r.edit, r.turn) for r in repair.repaired(turns(spark, rows)).where("conv_id is null").orderBy("place").collect()]
    assert rows_out == [("system", "S.", "K", 0), ("user", "U?", "K", 1), ("assistant", "", "I", None)]
    assert repair.audited(turns(spark, [])).count() == 0


def test_damage_by_every_fate(spark):
    from zlib import crc32

    rows = [(c, t, "assistant", f"Text {t}. End!") for c, t in product(range(40), (0, 1))]
    got = repair.damage(turns(spark, rows)).collect()
    want = Counter()
    for c, t, role, text in rows:
        fate = crc32(f"{c}:{t}".encode()) % 20
        row = (c, t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text, fate != 0)
        want[row] += 2 if fate == 3 else 1
    assert Counter((r.conv_id, r.turn, r.role, r.text, r.alive) for r in got) == want
    gone = [c for c in range(40) if all(crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0, 1))]
    out = {r.conv_id: r for r in repair.audited(repair.damage(turns(spark, rows))).collect()}
    assert set(out) == set(range(40)) and all(out[c].audit == "" and out[c].cost == 0 for c in gone)
    everything = [(1, t, "user", "x.") for t in range(400) if crc32(f"1:{t}".encode()) % 20 == 0]
    lone = repair.audited(repair.damage(turns(spark, everything))).collect()
    assert [(r.conv_id, r.gaps, r.cost, r.audit, r.repaired_sha256) for r in lone] == [(1, 0, 0, "", hashlib.sha256(b"").hexdigest())]
