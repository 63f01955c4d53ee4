"""Toxicity by weak supervision.

1. Voters. Words and stems (`stem*`) are mined from a bounded sample of labelled rows. None has to be reliable: a term says something of a text if it
   stands there more often than its rate in clean rows makes likely (its surprise, a bound of the Poisson tail's logarithm), and it is taken
   if surprised rows are toxic more often than rows at large, beyond chance. Two tiers of terms (mostly toxic, or less so) make three voters each, by how
   surprising all of a tier's terms are together; a seed list in four languages is another. Pattern voters look at several marked words
   together, their density, disguised spelling and shouting. A voter fires or doesn't.
2. A generative label model explains how often each pattern of votes occurs over ALL documents
   (a histogram of 2**VOTERS cells at most): a class prior, for each class each voter's rate of firing,
   and couplings for pairs of voters that stay correlated within a class. EM over the exact
   distribution; the sample's labels anchor the classes.
3. A linear classifier is trained on the posterior labels of the sample's rows.

Labels of rows whose crc32(doc_id as text) mod 3 is 1 are never read, and no label, language, source
or id enters a score. SAMPLE labelled ids, with REPEATS rows each at most, are what the lexicon and the classifier are fitted on; the lexicon has no other bound.
Copies (rows of equal sketches) count once when terms are mined, and a word counts once in a text for each word that it follows, so repeated lines aren't evidence. A term whose
rows are near copies of each other is a mark of that text and isn't taken.

Very long texts and very long words are read whole, in time in proportion to their length. Rows: a null or empty text has no votes and gets the score of such; a null id isn't held out; in all other steps repeated rows and
labels count as often as they stand there, and rows get equal scores. Without labels the seed list votes alone. An empty table gives an empty
result. Extra columns aren't read, and come back unchanged from `clean`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, crc_third

#: The bounds of the labelled ids that are fitted on and of the rows of one id; values of a text's sketch, by which copies are told.
SAMPLE, REPEATS, ALIKE = 8000, 4, 64
#: Rows whose terms are held at once.
SLICE = 64
#: From which surprise on a term marks a text; the voters' bars for the sums of a tier; how toxic the first tier's marked rows are at least; the least number of toxic rows.
MARKED, BARS, TIER, FEWEST = 4.0, (4.0, 7.0, 12.0), 0.95, 3
LEXICONS, THRESHOLD = 2 * len(BARS), 0.7
#: Lengths of the stems that are tried.
STEMS = (4, 5, 6, 7)
#: Plain insults.
SEEDS = (
    "idiot", "moron", "stupid", "loser", "scum", "imbecile", "bastard", "asshole", "bitch", "fuck", "fucking", "fucker", "shit", "cunt", "whore", "slut", "retard", "dickhead",
    "arschloch", "dummkopf", "hurensohn", "schlampe", "wichser", "missgeburt", "connard", "connasse", "salope", "merde", "enculé", "crétin",
    "idiota", "imbécil", "estúpido", "puta", "mierda", "cabrón", "gilipollas",
)
WORD = re.compile(r"[^\W\d_]+")
#: Starts where a run of letters starts, so a long run is read once.
DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]*+[013457@$][\w@$]*+")
PLAIN = str.maketrans("013457@$", "oleastas")
SHOUT = re.compile(r"!!!|\b[A-Z]{4,}(?: [A-Z]{3,}){2}")
VOTERS = LEXICONS + 5
PATTERNS = 1 << VOTERS


def surprise(count: float, expected: float) -> float:
    """A bound of -log P(at least `count`) where `expected` is the mean of a Poisson count."""
    return count * math.log(count / expected) - count + expected if count > expected else 0.0


@dataclass
class Term:
    """A word or `stem*`, how often it stands in a clean row's word, and its tier."""

    text: str
    rate: float = 1e-6
    tier: int = 0


@dataclass
class Model:
    terms: list[Term | str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    posterior: np.ndarray = field(default_factory=lambda: np.zeros(PATTERNS))

    def __post_init__(self):
        self.terms = [Term(t) if isinstance(t, str) else t for t in self.terms]
        self.words = [t.text for t in self.terms]
        self.at = {w: i for i, w in enumerate(self.words) if not w.endswith("*")}
        self.stems = [(k, at) for k in STEMS if (at := {w[:-1]: i for i, w in enumerate(self.words) if w.endswith("*") and len(w) == k + 1})]
        self.seeds = frozenset(SEEDS)

    def look(self, text: str) -> tuple[list[int], int, float]:
        """The terms that mark a whole text, its pattern of votes and the logarithm of its length in words."""
        tokens = WORD.findall(text.lower())
        seen = set(tokens)
        of = {w: [self.at[w]] for w in seen & self.at.keys()}
        for k, at in self.stems:
            for w in seen:
                if len(w) > k and w[:k] in at:
                    of.setdefault(w, []).append(at[w[:k]])
        counts: Counter = Counter()
        if of:
            pairs = set(zip(["", *tokens], tokens))
            for _, w in pairs:
                for i in of.get(w, ()):
                    counts[i] += 1
            size = len(pairs)
        seeds = len(seen & self.seeds)
        hidden = {w for x in DISGUISED.findall(text) if (w := x.lower().translate(PLAIN)) in self.at or w in self.seeds}
        sums, found = [0.0, 0.0], []
        for i, n in counts.items():
            much = surprise(n, self.terms[i].rate * size)
            if much >= MARKED / 2:
                sums[self.terms[i].tier] += much
            if much >= MARKED:
                found.append(i)
        votes = 0
        for tier in (0, 1):
            for k, bar in enumerate(BARS):
                votes |= (sums[tier] >= bar) << (tier * len(BARS) + k)
        # Words of one stem are several.
        sure = any(self.terms[i].tier == 0 for i in found)
        marked = len({w for w, ids in of.items() if sure and any(self.terms[i].tier == 0 for i in ids)} | seen & self.seeds)
        fired = (seeds > 0, marked >= 2, marked * 50 >= len(tokens) > 0, len(hidden) > 0, SHOUT.search(text) is not None)
        for k, x in enumerate(fired):
            votes |= x << (LEXICONS + k)
        return sorted(found), votes, math.log1p(len(tokens))

    def matrix(self, found: list, votes: np.ndarray, length: np.ndarray) -> np.ndarray:
        x = np.zeros((len(votes), len(self.terms) + VOTERS + 2))
        for i, row in enumerate(found):
            x[i, row] = 1
        n = len(self.terms)
        x[:, n : n + VOTERS] = votes[:, None] >> np.arange(VOTERS) & 1
        x[:, -2] = length / 10
        x[:, -1] = 1
        return x

    def scores(self, found: list, votes: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.matrix(found, votes, length) @ self.weights, -30, 30)))

    def texts(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        found, votes, length = zip(*(self.look(x.as_py() or "") for x in column))
        return self.scores(found, np.array(votes), np.array(length))


def _sample(ws: Workspace, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, terms (with their counts), n (words), sketch, text of at most SAMPLE labelled rows outside the held-out third."""
    allowed = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where((crc_third() != 1) & F.col("toxic").isin(0, 1))
    few = allowed.orderBy(F.xxhash64("doc_id"), "toxic").limit(SAMPLE)
    # The limit bounds the side that is sent to all executors, and REPEATS the rows of an id.
    rows = docs.join(F.broadcast(few.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))), "doc_id")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= REPEATS).select("toxic", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            terms, sizes, sketch = [], [], []
            for x in b.column(1):
                tokens = WORD.findall((x.as_py() or "").lower())
                pairs = set(zip(["", *tokens], tokens))
                counts: Counter = Counter()
                for _, w in pairs:
                    counts[w] += 1
                    for k in STEMS:
                        if len(w) > k:
                            counts[f"{w[:k]}*"] += 1
                terms.append([{"term": t, "k": k} for t, k in sorted(counts.items())])
                sizes.append(len(pairs))
                sketch.append(sorted(xxhash.xxh3_64_intdigest(w.encode()) >> 1 for w in set(tokens))[:ALIKE])
            kind = pa.list_(pa.struct([("term", pa.string()), ("k", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, kind), pa.array(sizes, pa.int32()), pa.array(sketch, pa.list_(pa.int64())), b.column(1)], ["toxic", "terms", "n", "sketch", "text"])

    return ws.save(rows.mapInArrow(words, "toxic int, terms array<struct<term:string,k:int>>, n int, sketch array<long>, text string"))


def _alike(sketches: list[set]) -> float:
    """Median similarity of neighbours among a word's documents: high if they are near copies of each other."""
    pairs = zip(sketches, sketches[1:])
    return float(np.median([len(a & b) / max(1, len(a | b)) for a, b in pairs])) if len(sketches) > 1 else 1.0


def _distinct(sample: DataFrame) -> DataFrame:
    """toxic, terms, n, sketch of each distinct sketch, so that copies are evidence once; toxic if half of the copies are labelled so."""
    return sample.groupBy("sketch").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"), F.max_by(F.struct("terms", "n"), F.xxhash64("text")).alias("s")).select("sketch", "toxic", "s.*")


def _divergence(k: float, n: float, prior: float) -> float:
    """n times the divergence of k / n from the prior."""
    q = k / n
    return n * ((q * math.log(q / prior) if q else 0.0) + ((1 - q) * math.log((1 - q) / (1 - prior)) if q < 1 else 0.0))


def mine(ws: Workspace, sample: DataFrame) -> list[Term]:
    """Terms whose marked rows are toxic more often than rows at large, beyond chance; copies count once."""
    totals = {bool(r.toxic): (r.rows, r.words) for r in sample.groupBy("toxic").agg(F.count("*").alias("rows"), F.sum("n").alias("words")).collect()}
    bad, all_ = totals.get(True, (0, 0))[0], sum(r for r, _ in totals.values())
    if bad < 5 or bad == all_:
        return []
    prior, words = bad / all_, max(1, totals[False][1])
    each = sample.select("toxic", "n", F.xxhash64("sketch").alias("h"), F.explode("terms").alias("t")).select("toxic", "n", "h", "t.*")
    # Only terms of several toxic rows can pass; the others aren't looked at in clean rows.
    often = each.where("toxic = 1").groupBy("term").count().where(F.col("count") >= FEWEST).select("term")
    each = each.join(often, "term", "left_semi")
    rates = each.groupBy("term").agg(((F.sum(F.when(F.col("toxic") == 0, F.col("k")).otherwise(0)) + 0.5) / words).alias("rate"))
    mean = F.col("rate") * F.col("n")
    much = F.when(F.col("k") > mean, F.col("k") * F.log(F.col("k") / mean) - F.col("k") + mean).otherwise(0.0)
    marked = ws.save(each.join(rates, "term").where(much >= MARKED).select("term", "rate", "toxic", "h"))
    found = marked.groupBy("term", "rate").agg(F.sum("toxic").alias("k"), F.count("*").alias("n")).where(F.col("k") >= FEWEST)
    rows = [r for r in found.collect() if r.k > prior * r.n]  # of the bounded sample
    sure = math.log(max(len(rows), 1))  # about one of them may pass by luck
    evidence = {r.term: _divergence(r.k, r.n, prior) for r in rows}
    strong = sorted((r for r in rows if evidence[r.term] > sure), key=lambda r: (-evidence[r.term], -len(r.term.rstrip("*")), r.term))
    if not strong:
        return []
    numbers = sample.sparkSession.createDataFrame([(r.term, i) for i, r in enumerate(strong)], "term string, i int")
    of: dict[int, list[tuple]] = {i: [] for i in range(len(strong))}
    hits = marked.where("toxic = 1").join(numbers, "term").groupBy("h").agg(F.collect_list("i").alias("terms"))
    for r in sorted(sample.select("sketch", F.xxhash64("sketch").alias("h")).join(hits, "h").select("sketch", "terms").collect(), key=lambda r: r.sketch):  # near copies are neighbours
        doc = tuple(r.sketch)
        for i in r.terms:
            of[i].append(doc)
    covered: Counter = Counter()
    out: list[Term] = []
    for i, r in enumerate(strong):
        stem, docs = r.term.rstrip("*"), of[i]
        new = sum(covered[d] < 3 for d in docs)
        # A stem and its words are one term; a term that marks what others mark thrice adds nothing.
        kin = any(c.text.endswith("*") and stem.startswith(c.text[:-1]) or r.term.endswith("*") and c.text.startswith(stem) for c in out)
        if kin or new < max(1, 0.1 * len(docs)) or _alike([set(d) for d in docs]) >= 0.4:
            continue
        covered.update(docs)
        out.append(Term(r.term, r.rate, 0 if r.k >= TIER * r.n else 1))
    return out


def _fitted(theta: np.ndarray, terms: np.ndarray, goal: np.ndarray, steps: int = 6, ridge: float = 1e-4) -> np.ndarray:
    """Newton steps to the parameters whose expected terms are `goal`; halved until they gain, as votes of one tier imply each other."""

    def gain(t: np.ndarray) -> float:
        e = terms @ t
        return float(goal @ t - np.log(np.exp(e - e.max()).sum()) - e.max() - ridge / 2 * t @ t)

    best = gain(theta)
    for _ in range(steps):
        e = terms @ theta
        p = np.exp(e - e.max())
        p /= p.sum()
        mean = p @ terms
        cov = (terms * p[:, None]).T @ terms - np.outer(mean, mean)
        move = np.linalg.solve(cov + (ridge + 1e-6) * np.eye(len(cov)), goal - mean - ridge * theta)
        for k in range(12):
            tried = np.clip(theta + move / 2**k, -30, 30)
            if (now := gain(tried)) > best:
                break
        else:
            break
        theta, best = tried, now
    return theta


def label_model(histogram: dict[int, int], anchors: dict[tuple[int, int], int], rounds: int = 40) -> np.ndarray:
    """P(toxic | votes) for every pattern, from unlabelled pattern counts and labelled ones."""
    bits = (np.arange(PATTERNS)[:, None] >> np.arange(VOTERS) & 1).astype(float)
    free = np.zeros(PATTERNS)
    for p, c in histogram.items():
        free[p] += c
    fixed = np.zeros((2, PATTERNS))
    for (y, p), c in anchors.items():
        fixed[y, p] += c
    prior = np.clip((fixed[1].sum() + 1) / (fixed.sum() + 20), 1e-4, 0.9)
    # Labelled rows weigh as much as all others together, so that the classes don't drift to other groups of rows.
    fixed *= max(1.0, free.sum() / max(fixed.sum(), 1.0))
    known = fixed.sum(1, keepdims=True)
    # Voters fire on toxic rows more often than on others until the counts say otherwise.
    before = np.array([[0.01], [0.1]])
    rates = (fixed @ bits + before * 4) / (known + 4)
    pairs: list[tuple[int, int]] = []
    terms, theta = bits, np.log(np.clip(rates, 1e-4, 1 - 1e-4) / (1 - np.clip(rates, 1e-4, 1 - 1e-4)))
    post = np.zeros(PATTERNS)
    for step in range(rounds):
        energy = theta @ terms.T
        like = energy - np.log(np.exp(energy - energy.max(1, keepdims=True)).sum(1, keepdims=True)) - energy.max(1, keepdims=True)
        odds = like[1] - like[0] + math.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        share = fixed + free * np.stack([1 - post, post])
        prior = np.clip((share[1].sum() + 1) / (share.sum() + 20), 1e-4, 0.9)
        mass = share / np.maximum(share.sum(1, keepdims=True), 1e-9)
        if step == 8:  # couplings of the pairs that stay correlated within a class
            for y in (0, 1):
                mean = mass[y] @ bits
                cov = (bits * mass[y][:, None]).T @ bits - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                corr = np.triu(cov / np.outer(sd, sd), 1)
                pairs += [(i, j) for i, j in zip(*np.nonzero(abs(corr) > 0.15))]
            pairs = sorted(set(pairs))
            if pairs:
                terms = np.concatenate([bits, np.stack([bits[:, i] * bits[:, j] for i, j in pairs], 1)], 1)
                theta = np.concatenate([theta, np.zeros((2, len(pairs)))], 1)
        # The belief that voters tell toxic rows counts like four rows of each class.
        held = np.where(np.arange(terms.shape[1]) < VOTERS, before, before**2)
        size = share.sum(1, keepdims=True)
        goal = (mass @ terms * size + held * 4) / (size + 4)
        for y in (0, 1):
            theta[y] = _fitted(theta[y], terms, goal[y])
    return post


def _logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels of rows that stand `count` times each."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (count * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (count * (y - p)) - ridge * w)
        w += np.clip(step, -4, 4)
        if abs(step).max() < 1e-6:
            break
    return w


def _features(docs: DataFrame, model: Model) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [model.look(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], ["doc_id", "found", "votes", "length"])

    return docs.mapInArrow(look, "doc_id long, found array<int>, votes int, length double")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The fitted model, and the features of every row of docs (a table in the shared folder)."""
    ws = Workspace(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = _sample(ws, docs, labels)
    terms = mine(ws, ws.save(_distinct(sample)))
    model = Model(terms)
    features = ws.save(_features(docs, model))
    histogram = {r[0]: r[1] for r in features.groupBy("votes").count().collect()}
    known = _features(sample.select(F.col("toxic").cast("long").alias("doc_id"), "text"), model).groupBy("doc_id", "found", "votes", "length").count().collect()
    anchors: Counter = Counter()
    for r in known:
        anchors[int(r.doc_id), r.votes] += r[-1]
    model.posterior = label_model(histogram, anchors)
    found, votes, length, count = ([r[k] for r in known] for k in (1, 2, 3, 4))
    if not known:  # no labels: the patterns that occur stand for the documents
        votes = list(histogram)
        found, length, count = [[] for _ in votes], [5.0] * len(votes), [1] * len(votes)
    votes = np.array(votes, np.int64)
    if len(votes):
        model.weights = _logistic(model.matrix(found, votes, np.array(length)), model.posterior[votes], np.array(count, float))
    else:
        model.weights = np.zeros(len(model.words) + VOTERS + 2)
    return model, features


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model, features = fit(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                s = model.scores(b.column(1).to_pylist(), b.column(2).to_numpy(), b.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    out = features.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", (crc_third() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score reaches the threshold."""
    model, _ = fit(docs, labels)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.texts(b.column(at)) < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
