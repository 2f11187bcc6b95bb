"""Toxicity by weak supervision: many voters, a label model over their votes, a linear classifier.

Voters are word lists, patterns of writing, and word beginnings that labelled rows tell apart.  A
generative model of the votes of all documents estimates, without labels, how often each voter
speaks on toxic and on other texts and which voters follow each other; its posteriors label a
bounded sample, on which a logistic regression over words and word beginnings is trained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.texts import GOLDEN, mix, prefix_hashes, slices, span_hashes, stored, words

# Word lists of the fixed voters; more are learnt from labelled rows.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons moronic imbecile stupid dumb dumbass fool brainless cretin",
    "worth": "loser losers worthless pathetic useless nobody failure",
    "filth": "trash scum garbage filth filthy vermin parasite",
    "disgust": "disgusting disgrace vile repulsive revolting",
    "ridicule": "clown clowns joker laughable buffoon",
    "swearing": "fuck fucking shit bitch bastard asshole crap damn",
    "french": "idiote imbécile crétin connard salaud ordure minable débile abruti pourriture",
    "spanish": "idiota imbécil estúpido estúpida basura inútil asqueroso asquerosa patético payaso",
    "german": "dummkopf trottel abschaum versager widerlich erbärmlich wertlos arschloch schwachkopf",
}
SECOND_PERSON = "you your you're yours u tu vous toi usted ustedes vosotros du ihr dich euch"
PATTERNS = ("addressed", "shouting", "exclaiming", "masked", "silent")
BEGINNINGS = (3, 4, 5, 6, 7, 8)
# Bounds of the samples: texts of each label, and of each side of the posterior.
LABELLED_TEXTS = 4_000
TRAINING_TEXTS = 4_000
MAX_LEARNT = 64
PRECISION = 0.98
TRUSTED = 0.8
MAX_FEATURES = 4_096
PASSES = 8
FOLLOWS = 0.3
THRESHOLD = 0.7
_WHOLE = np.uint64(0x5851F42D4C957F2D)
_FILTER = 1 << 20


def word_hashes(text: str) -> np.ndarray:
    """Whole-word hashes of the words of a list."""
    data = np.frombuffer(text.encode(), np.uint8)
    low, starts, stops, _ = words(data, np.array([0, len(data)]))
    return np.unique(mix(span_hashes(prefix_hashes(low), starts, stops) + _WHOLE))


class Marks:
    """Which of a set of hashes occur where in a slice of texts."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.sieve = np.zeros(_FILTER, bool)
        self.sieve[(self.hashes & np.uint64(_FILTER - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes``, places in the set) of those that are in the set."""
        at = np.flatnonzero(self.sieve[(hashes & np.uint64(_FILTER - 1)).astype(np.int64)])
        if not len(at):
            return at, at
        own = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[own] == hashes[at]
        return at[same], own[same]


def features(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes): beginnings of words from short to long, at last whole words."""
    hashes = prefix_hashes(low)
    for size in BEGINNINGS:
        word = np.flatnonzero(stops - starts >= size)
        yield word, span_hashes(hashes, starts[word], starts[word] + size)
    yield np.arange(len(starts)), mix(span_hashes(hashes, starts, stops) + _WHOLE)


def found(marks: Marks, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(word numbers, places in the set) of all occurrences in a slice, and its words."""
    cut = words(data, offsets)
    if not len(cut[1]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), cut
    hits = []
    for word, hashes in features(*cut[:3]):
        at, own = marks.find(hashes)
        hits.append((word[at], own))
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]), cut


@dataclass
class Voters:
    """Sets of hashes, one a voter; the patterns of writing vote after them.

    ``trust`` is how often a word voter is taken to be right before its votes are counted.  The last
    pattern speaks where no word voter does, and so for clean texts.
    """

    names: list[str] = field(default_factory=list)
    sets: list[np.ndarray] = field(default_factory=list)
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        self.anchors = len(self.names)
        table = sorted({int(h) for s in self.sets for h in s})
        self.marks = Marks(np.array(table, np.uint64))
        place = {h: i for i, h in enumerate(table)}
        self.members = np.zeros((len(table), len(self.sets)), bool)
        for v, s in enumerate(self.sets):
            self.members[[place[int(h)] for h in s], v] = True
        self.second = Marks(word_hashes(SECOND_PERSON))

    @property
    def size(self) -> int:
        return len(self.names) + len(PATTERNS)

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """0 or 1 per row of a slice and voter."""
        n = len(offsets) - 1
        out = np.zeros((n, self.size), np.uint8)
        word, place, (low, starts, stops, at) = found(self.marks, data, offsets)
        row = np.searchsorted(at, word, "right") - 1
        for v in range(len(self.names)):
            out[row[self.members[place, v]], v] = 1
        out[:, -1] = ~out[:, :self.anchors].any(1)
        if not len(starts):
            return out
        whole = mix(span_hashes(prefix_hashes(low), starts, stops) + _WHOLE)
        you, _ = self.second.find(whole)
        if len(you) and len(word):
            # a second person among the three words before or after a marked word of the same text
            next_you = np.searchsorted(you, word)
            for step in (-1, 0):
                other = you[np.clip(next_you + step, 0, len(you) - 1)]
                near = (np.abs(other - word) <= 3) & (np.searchsorted(at, other, "right") - 1 == row)
                out[row[near], self.anchors] = 1

        def per_row(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[offsets[1:]] - total[offsets[:-1]]

        capital = per_row((data >= 65) & (data <= 90))
        letters = capital + per_row((data >= 97) & (data <= 122))
        out[:, self.anchors + 1] = (letters >= 20) & (capital * 2 > letters)
        twice = np.zeros(len(data), bool)
        twice[:-1] = (data[:-1] == 33) & (data[1:] == 33)
        out[:, self.anchors + 2] = per_row(twice) > 0
        sign = np.isin(data, np.frombuffer(b"*#@$%&", np.uint8))
        run = np.zeros(len(data), bool)
        run[:-2] = sign[:-2] & sign[1:-1] & sign[2:]
        out[:, self.anchors + 3] = per_row(run) > 0
        return out


def bounded(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """Of each value of ``group`` the ``limit`` rows (h, ...) of the smallest hash ``h``; two groups at most."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    share = F.col("h") / F.lit(2.0 ** 64) + 0.5
    # hashes are uniform, so the smallest lie in the lowest part of their range
    low = rows.join(F.broadcast(sizes), group).where(share * F.col("size") <= 4 * limit)
    place = F.row_number().over(Window.partitionBy(group).orderBy("h"))
    return low.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def mined(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The word voters, as sets of hashes, and the trust in each.

    They are ``LEXICONS``, and word beginnings and words that tell labelled texts apart, each alone:
    among at most ``LABELLED_TEXTS`` labelled documents of each label, by smallest hash of the key,
    those whose texts are toxic for a share of at least ``PRECISION``, and more of them than chance
    explains, shortest beginnings first, one of those that mark the same texts.  ``labels``: id,
    toxic; keys with both labels teach nothing.  Trust is the share of toxic texts among those that
    hold a word of the list, with two texts more that are nine tenths toxic.
    """
    known = labels.where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("id").agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    sampled = bounded(known.select("id", "toxic", F.xxhash64("id").alias("h")), "toxic", LABELLED_TEXTS)
    chosen = stored(sampled.select("id", "toxic", "size"), "labelled")
    # a sampled text stands for as many of its label as there are
    stands = {r.toxic: r.size / r.taken for r in chosen.groupBy("toxic").agg(
        F.first("size").alias("size"), F.count("*").alias("taken")).collect()}
    weight = [float(stands.get(y, 1.0)) for y in (0, 1)]
    texts = docs.join(F.broadcast(chosen), "id").where(F.length("text") > 0).groupBy(
        F.xxhash64("text").alias("h")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"),
                                           F.min("text").alias("text")).where("toxic = most")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            low, starts, stops, at = words(data, offsets)
            if not len(starts):
                continue
            row = np.repeat(np.arange(rows.num_rows), np.diff(at))
            parent = np.zeros(len(starts), np.uint64)
            parts = []
            for word, hashes in features(low, starts, stops):
                parts.append(np.stack([row[word].astype(np.uint64), hashes, parent[word]], 1))
                parent[word] = hashes
            distinct = np.unique(np.concatenate(parts), axis=0)
            own = distinct[:, 0].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            kin = np.zeros(rows.num_rows, np.uint64)
            kin[own[first]] = np.minimum.reduceat(mix(distinct[:, 1] + GOLDEN), first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct[:, 1].copy().view(np.int64)), pa.array(distinct[:, 2].copy().view(np.int64)),
                 pa.array(kin[own].view(np.int64)), rows.column("toxic").take(pa.array(own))],
                names=["feature", "parent", "h", "toxic"])

    # near copies mostly share the least hash of their features, and count as one text
    marked = texts.select("h", F.col("toxic").cast("long").alias("toxic"), "text").mapInArrow(
        work, "feature long, parent long, h long, toxic long").distinct()
    seen = stored(marked.groupBy("feature", "parent").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.bit_xor("h").alias("texts")), "features")
    base = max(1e-3, texts.agg(F.avg("toxic")).first()[0] or 0.5)
    share = F.col("t") * weight[1] / (F.col("t") * weight[1] + F.col("c") * weight[0])
    surely = (share >= PRECISION) & (F.col("t") * -math.log(min(base, 0.9)) >= math.log(1e6))
    good = seen.where(surely)
    first = good.join(good.select(F.col("feature").alias("parent")).distinct(), "parent", "left_anti")
    one = first.groupBy("texts").agg(F.max(F.struct("t", "feature")).alias("m")).select("m.t", "m.feature")
    best = one.orderBy(F.desc("t"), "feature").limit(MAX_LEARNT).collect()
    learnt = [np.array([r.feature], np.int64).view(np.uint64) for r in best]
    lists = [word_hashes(text) for text in LEXICONS.values()]
    held = {r.feature: (r.t * weight[1], r.c * weight[0]) for r in seen.where(F.col("feature").isin(
        [int(h) for own in [*lists, *learnt] for h in own.view(np.int64)])).groupBy("feature").agg(
        F.max("t").alias("t"), F.max("c").alias("c")).collect()}
    sets, trust = [], []
    for own in [*lists, *learnt]:
        counts = np.array([held.get(int(h), (0.0, 0.0)) for h in own.view(np.int64)])
        # a word of a list that labelled texts speak against, as it means something else there, has no voice
        kept = (counts[:, 0] + 1.8) / (counts.sum(1) + 2) >= TRUSTED
        sets.append(own[kept])
        total = counts[kept].sum(0)
        trust.append((total[0] + 1.8) / (total.sum() + 2))
    return sets, np.clip(trust, 0.01, 0.99)


@dataclass
class LabelModel:
    """Class balance, how often voters speak in each class, and which voter each one follows.

    ``follows[v]`` is the voter that v depends on besides the class, -1 for none; ``speaks[y, p, v]``
    is the probability that v speaks in class y if the voter it follows does (p = 1) or not.
    """

    balance: float
    follows: np.ndarray
    speaks: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of class 1; voters that keep silent are no evidence."""
        parent = np.where(self.follows >= 0, votes[:, self.follows], 0)
        odds = np.full(len(votes), math.log(self.balance / (1 - self.balance)))
        ratio = np.log(self.speaks[1]) - np.log(self.speaks[0])
        odds += np.where(votes > 0, np.take_along_axis(ratio, parent, 0), 0).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def refit(together: np.ndarray, totals: np.ndarray, trust: np.ndarray) -> LabelModel:
    """Model from expected counts: ``together[y, i, j]`` of two voters speaking, ``totals[y]`` of texts.

    Dependencies are the maximum spanning forest of the voters by the share of a voter's entropy that
    the other explains inside the classes (a tree-augmented model); below ``FOLLOWS`` there is no
    edge, so that voters who agree because both see the class stay evidence for it.
    """
    k = together.shape[1]
    alone = together[:, range(k), range(k)]
    n = totals.sum() + 2
    joint = np.zeros((2, 2, 2, k, k))
    joint[:, 1, 1] = together
    joint[:, 1, 0] = alone[:, :, None] - together
    joint[:, 0, 1] = alone[:, None, :] - together
    joint[:, 0, 0] = totals[:, None, None] - alone[:, :, None] - alone[:, None, :] + together
    joint = np.maximum(joint, 0) + 0.25
    size = joint.sum((1, 2), keepdims=True)
    p = joint / size
    gain = (joint * np.log(p / (p.sum(1, keepdims=True) * p.sum(2, keepdims=True)))).sum((0, 1, 2))
    own, other = p.sum(2, keepdims=True), p.sum(1, keepdims=True)
    free = np.minimum(-(size * own * np.log(own)).sum((0, 1, 2)), -(size * other * np.log(other)).sum((0, 1, 2)))
    gain = gain / free
    np.fill_diagonal(gain, -1)
    gain[-1], gain[:, -1] = -1, -1  # the silence of all is made of the others and follows none
    follows = np.full(k, -1)
    linked = np.zeros(k, bool)
    best, source = np.full(k, FOLLOWS), np.full(k, -1)
    for _ in range(k):
        nearest = int(np.argmax(np.where(linked, -1, best)))
        follows[nearest] = source[nearest]
        linked[nearest] = True
        closer = ~linked & (gain[nearest] > best)
        best[closer], source[closer] = gain[nearest][closer], nearest
    speaks = np.zeros((2, 2, k))
    for v in range(k):
        u = follows[v]
        prior = np.array([1 - trust[v], trust[v]])
        rate = (alone[:, v] + prior) / (totals + 1)
        speaks[:, :, v] = rate[:, None]
        if u >= 0:
            # beside the voter it follows it is news only as far as the classes are seen to differ
            usual = together[:, u, v].sum() / max(alone[:, u].sum(), 1e-9)
            speaks[:, 1, v] = (together[:, u, v] + 2 * usual) / (alone[:, u] + 2)
            speaks[:, 0, v] = (np.maximum(alone[:, v] - together[:, u, v], 0) + prior) / (
                np.maximum(totals - alone[:, u], 0) + 1)
    return LabelModel(float((totals[1] + 1) / n), follows, np.clip(speaks, 1e-6, 1 - 1e-6))


def fit_labels(patterns: DataFrame, voters: Voters) -> LabelModel:
    """Expectation maximisation over ``patterns`` (votes, n) of all documents.

    Every pass is a Spark job that adds up expected counts per task; only size * size numbers of
    each class reach the driver.  It starts from the most trusted word voter that speaks.
    """
    size, anchors = voters.size, voters.anchors
    trust = np.concatenate((voters.trust, np.full(size - anchors, 0.5)))
    model: LabelModel | None = None
    for _ in range(PASSES):
        now = model

        def count(batches: Iterator[pa.RecordBatch], now: LabelModel | None = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, size * size + 1))
            for batch in batches:
                raw = b"".join(batch.column(0).to_pylist())
                votes = np.frombuffer(raw, np.uint8).reshape(-1, size)
                n = batch.column(1).to_numpy().astype(float)
                q = (np.maximum(0.02, (votes[:, :anchors] * trust[:anchors]).max(1, initial=0)) if now is None
                     else now.posterior(votes.astype(np.int64)))
                for y, share in enumerate((1 - q, q)):
                    weight = (n * share)[:, None]
                    total[y, :-1] += (votes.T.astype(float) @ (votes * weight)).ravel()
                    total[y, -1] += weight.sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

        sums = patterns.mapInArrow(count, "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(
            F.sum("col").alias("s")).collect()
        total = np.zeros(2 * (size * size + 1))
        for r in sums:
            total[r.pos] = r.s
        total = total.reshape(2, -1)
        before, model = model, refit(total[:, :-1].reshape(2, size, size), total[:, -1], trust)
        if before is not None and np.abs(before.speaks - model.speaks).max() < 1e-4:
            break
    return model


@dataclass
class Classifier:
    """Weights of words and word beginnings; a text's score is the sum over its distinct ones."""

    hashes: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, data: np.ndarray, offsets: np.ndarray, marks: Marks) -> np.ndarray:
        word, place, cut = found(marks, data, offsets)
        row = np.searchsorted(cut[3], word, "right") - 1
        pairs = np.unique(row * len(self.hashes) + place) if len(word) else np.zeros(0, np.int64)
        total = np.bincount(pairs // max(1, len(self.hashes)), self.weights[pairs % max(1, len(self.hashes))],
                            len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -50, 50)))


def train(sample: DataFrame) -> Classifier:
    """Logistic regression on ``sample`` (h, q, weight, text), a bounded number of texts.

    Features are the ``MAX_FEATURES`` words and beginnings whose share of toxic posterior differs most
    from the mean, measured in standard errors; texts count with their weight for both labels.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            low, starts, stops, at = words(data, offsets)
            row = np.repeat(np.arange(rows.num_rows), np.diff(at)).astype(np.uint64)
            parts = [np.stack([row[w], h], 1) for w, h in features(low, starts, stops)] if len(starts) else []
            pairs = np.unique(np.concatenate(parts), axis=0) if parts else np.zeros((0, 2), np.uint64)
            ends = np.searchsorted(pairs[:, 0], np.arange(rows.num_rows + 1).astype(np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pairs[:, 1].copy().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("h"), rows.column("q"), rows.column("weight"), lists], names=["h", "q", "weight", "marks"])

    rows = stored(sample.mapInArrow(distinct, "h long, q double, weight double, marks array<long>"), "training")
    whole = rows.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("q")).alias("t"),
                     F.max("q").alias("most")).first()
    base = min(max((whole.t or 0.0) / (whole.n or 1.0), 1e-6), 1 - 1e-6)
    if not whole.n or whole.most < 0.5:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), math.log(base / (1 - base)))
    counts = rows.select("q", "weight", F.explode("marks").alias("mark")).groupBy("mark").agg(
        F.count("*").alias("texts"), F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("q")).alias("t"))
    error = F.sqrt(F.col("n") * base * (1 - base))
    strength = F.abs(F.col("t") - F.col("n") * base) / error
    best = counts.where("texts >= 3").select("mark", strength.alias("s")).orderBy(F.desc("s"), "mark").limit(MAX_FEATURES)
    hashes = np.sort(np.array([r.mark for r in best.collect()], np.int64).view(np.uint64))
    if not len(hashes):
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), math.log(base / (1 - base)))
    place = {int(h): i for i, h in enumerate(hashes.view(np.int64))}
    size = len(hashes)

    @F.udf(VectorUDT())
    def vector(marks: list[int]):
        own = sorted(place[m] for m in marks if m in place)
        return Vectors.sparse(size, own, [1.0] * len(own))

    taught = rows.select("q", "weight", vector("marks").alias("features"))
    both = stored(taught.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("weight") * F.col("q")).alias("w")),
        F.struct(F.lit(0.0).alias("label"), (F.col("weight") * (1 - F.col("q"))).alias("w")))).alias("x")).select(
        "features", "x.label", "x.w").where("w > 0"), "examples")
    fitted = LogisticRegression(weightCol="w", regParam=2e-5, elasticNetParam=0.5, maxIter=60,
                                standardization=False).fit(both)
    weights = fitted.coefficients.toArray()
    kept = np.flatnonzero(weights)
    return Classifier(hashes[kept], weights[kept], float(fitted.intercept))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text",
        toxic: str = "toxic") -> tuple[Classifier, LabelModel, Voters]:
    """Voters, label model and classifier from ``docs`` and ``labels``.

    ``learn`` says of a row of docs or labels, by its key, whether labels may be learnt from it, and
    only such documents train the classifier; the label model counts the votes of all documents and
    sees no label.  Labels other than 0 and 1, null keys and texts without words teach nothing.
    """
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), learn.alias("learn"))
    taught = labels.where(learn).select(F.col(doc_id).alias("id"), F.col(toxic).alias("toxic"))
    sets, trust = mined(narrow.where("learn").select("id", "text"), taught)
    names = [*LEXICONS, *[f"learnt {i}" for i in range(len(sets) - len(LEXICONS))]]
    voters = Voters(names, sets, trust)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            votes = voters.votes(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [rows.column("h"), rows.column("learn"), pa.array([v.tobytes() for v in votes], pa.binary())],
                names=["h", "learn", "votes"])

    voted = stored(narrow.select(F.xxhash64("text").alias("h"), "learn", "text").mapInArrow(
        vote, "h long, learn boolean, votes binary"), "votes")
    patterns = stored(voted.groupBy("votes").agg(F.count("*").alias("n")), "vote-patterns")
    model = fit_labels(patterns, voters)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, voters.size)
            q = model.posterior(votes.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q)], names=["h", "q"])

    texts = voted.where("learn").groupBy("h").agg(F.min("votes").alias("votes")).mapInArrow(judge, "h long, q double")
    sides = stored(texts.withColumn("side", F.col("q") >= 0.5), "posteriors")
    chosen = bounded(sides, "side", TRAINING_TEXTS)
    taken = stored(chosen.withColumn("weight", F.col("size") / F.count("*").over(Window.partitionBy("side")))
                   .select("h", "q", "weight"), "training-keys")
    sample = narrow.where("learn").withColumn("h", F.xxhash64("text")).join(F.broadcast(taken), "h").groupBy(
        "h").agg(F.first("q").alias("q"), F.first("weight").alias("weight"), F.min("text").alias("text"))
    return train(sample), model, voters


def score(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """The key, ``score`` and ``predicted`` of every whole text.

    Null and empty texts have the score of a text without marks; repeated rows each give a row;
    other columns are not looked at; no documents give no rows.  Map only; a slice of texts or one
    text is in memory.
    """
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(classifier.hashes)
        for rows, data, offsets in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(classifier.scores(data, offsets, marks))], names=["id", "score"])

    out = narrow.mapInArrow(work, f"id {kind}, score double")
    return out.select(F.col("id").alias(doc_id), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
