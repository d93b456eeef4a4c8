"""Operator 6: toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled texts is indexed by all its terms, words cut to six letters. A term's weight is its logarithmic frequency times its
inverse document frequency times a factor of the label, PLAIN plus the term's correlation with the label over the sample, so
that two texts are alike first of all by words that tell the classes apart; no term is left out. The postings of a term
are cut into blocks of BLOCK examples and keep the largest weight of each block, so a query adds up an upper bound for
every block, opens the blocks of the highest bounds, and then all whose bound exceeds the K-th best similarity found: the
K nearest are exact. The ROWS terms of most weight in all examples have rows of weights in place of postings; what they add up
to is known for all examples at once, and its largest value is part of a block's bound. The nearest vote by their
similarities, and a logistic curve fitted on votes of the sampled texts among the others turns the vote into a score. The
nearest examples are returned as evidence.

Defined results: null and empty texts, and texts without any term of the sample, have no neighbour and get the curve's value
at a vote of 0; equal similarities are ranked by the example's place in the index; without labels of both classes the score
is the share of toxic labels (0 without any); repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import crc_is, keyed_text, labelled_sample, logistic, one_blas_thread, short_batches, sigmoid, table

BLOCK, K = 1024, 15
#: Factor of a term that says nothing of the label; its correlation with the label is added.
PLAIN = 0.05
#: Similarity that is added to the denominator of a vote, so that faint neighbours weigh little.
FAINT = 0.2
#: Bounds of the fit: labelled texts a class, and characters of a text that may be among them.
PER_CLASS, LONGEST = 3000, 50_000
#: Blocks that are opened before the rest is judged by its bounds.
FIRST_BLOCKS = 2
#: Terms with rows of weights; texts, and terms of theirs, that are searched at once.
ROWS, AT_ONCE, TERMS_AT_ONCE = 1000, 64, 10_000
#: Postings that are added up at a time.
POSTINGS = 1 << 17
#: Terms: words in lower case, cut to their first six letters, which joins inflected and compound forms.
WORD = re.compile(r"(\w{1,6})\w*")


def bag_of(text: str) -> dict[str, int]:
    """Terms of a text and how often each occurs."""
    return Counter(WORD.findall(text.lower()))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] numbers, then the same of the next, and so on."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


class BlockMaxIndex:
    """Inverted index over sparse vectors (terms, weights) of at most a few thousand examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, rows: int = ROWS):
        self.size = len(vectors)
        self.blocks = -(-self.size // BLOCK)
        of = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        docs = np.repeat(np.arange(self.size), [len(t) for t, _ in vectors])
        order = np.lexsort((docs, of))
        docs, of, weights = docs[order], of[order], np.concatenate([np.zeros(0), *(w for _, w in vectors)])[order]
        frequent = np.argsort(-np.bincount(of, weights**2, terms), kind="stable")[:rows]
        #: the row of a term, or -1
        self.row = np.full(terms, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), self.blocks * BLOCK), np.float32)
        rare = self.row[of] < 0
        self.rows[self.row[of[~rare]], docs[~rare]] = weights[~rare]
        self.docs, of, self.weights = docs[rare].astype(np.int32), of[rare], weights[rare].astype(np.float32)
        block = self.docs // BLOCK
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (block[1:] != block[:-1])]) if len(of) else np.zeros(0, np.int64)
        #: an entry is a rare term in a block: its block, its first posting, their number, their largest weight
        self.block, self.first, self.count = (x.astype(np.int32) for x in (block[first], first, np.diff(np.r_[first, len(of)])))
        self.top = np.maximum.reduceat(self.weights, first) if len(of) else np.zeros(0)
        self.begin = np.searchsorted(of[first], np.arange(terms + 1))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """For each query, the k examples of largest positive similarity: (similarity, example), best first, ties by example."""
        if not self.size:
            return [[] for _ in queries]
        m, width = len(queries), self.blocks * BLOCK
        known = np.zeros((m, len(self.rows)), np.float32)
        of = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms, weights = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        row = self.row[terms]
        known[of[row >= 0], row[row >= 0]] = weights[row >= 0]
        of, terms, weights = of[row < 0], terms[row < 0], weights[row < 0]
        got = (known @ self.rows).astype(float)
        held = self.begin[terms + 1] - self.begin[terms]
        entry, own, of = ranges(self.begin[terms], held), np.repeat(weights, held), np.repeat(of, held)
        cell = of * self.blocks + self.block[entry]
        bound = np.bincount(cell, own * self.top[entry], m * self.blocks).reshape(m, -1) + got.reshape(m, -1, BLOCK).max(2)

        def open_blocks(some: np.ndarray) -> None:
            chosen = np.flatnonzero(some.ravel()[cell])
            ends = np.cumsum(self.count[entry[chosen]], dtype=np.int64)
            cuts = np.searchsorted(ends, np.arange(POSTINGS, ends[-1] + POSTINGS, POSTINGS)) if len(ends) else []
            for mine in np.split(chosen, cuts):  # so many postings at a time, however long the texts are
                if len(mine):
                    count = self.count[entry[mine]].astype(np.int64)
                    at = ranges(self.first[entry[mine]].astype(np.int64), count)
                    low, high = of[mine[0]] * width, (of[mine[-1]] + 1) * width  # entries go by query
                    got.ravel()[low:high] += np.bincount(self.docs[at] + np.repeat(of[mine] * width - low, count), self.weights[at] * np.repeat(own[mine], count), high - low)

        def kth(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            seen = np.where(np.repeat(some, BLOCK, 1), got, 0)
            return seen, np.partition(seen, -k, 1)[:, -k] if k <= width else np.zeros(m)

        first = np.zeros((m, self.blocks), bool)
        np.put_along_axis(first, np.argsort(-bound, 1, kind="stable")[:, :FIRST_BLOCKS], True, 1)
        first &= bound > 0
        open_blocks(first)
        rest = ~first & (bound > 0) & (bound >= kth(first)[1][:, None] - 1e-6)
        open_blocks(rest)
        seen, least = kth(first | rest)
        out = []
        for s, low in zip(seen, least, strict=True):
            best = np.flatnonzero(s > max(0.0, low - 1e-6))
            out.append(sorted(zip((-s[best]).round(6).tolist(), best.tolist(), strict=True))[:k])
        return [[(-s, d) for s, d in near] for near in out]


def correlations(bags: Iterable[dict[str, int]], labels: list[int]) -> dict[str, tuple[float, float]]:
    """Term -> (inverse document frequency, size of its correlation with the label) over the sample, for every term.

    One text of a class is added to those without the term and one to those with it, so a term of one text says little.
    """
    n, toxic = len(labels), sum(labels)
    df, among = Counter(), Counter()
    for bag, y in zip(bags, labels, strict=True):
        df.update(bag.keys())
        if y:
            among.update(bag.keys())
    out = {}
    for term, d in df.items():
        a, b = among[term] + toxic / n, d - among[term] + 1 - toxic / n
        c, e = toxic + 1 - a, n - toxic + 1 - b
        phi = (a * e - b * c) / ((a + b) * (c + e) * (a + c) * (b + e)) ** 0.5
        out[term] = float(np.log((1 + n) / (1 + d)) + 1), abs(float(phi))
    return out


class ToxicityModel:
    def __init__(self, sample: list[tuple[str, int, int]], counts: tuple[int, int]):
        total = sum(counts)
        self.constant = counts[1] / total if total else 0.0
        self.fitted = {y for _, y, _ in sample} == {0, 1}
        if not self.fitted:
            return
        known = correlations((bag_of(t) for t, _, _ in sample), [y for _, y, _ in sample])
        names = sorted(known)
        self.term = {w: i for i, w in enumerate(names)}
        self.factor = np.array([known[w][0] * (PLAIN + known[w][1]) for w in names])
        vectors = [self.vector(t) for t, _, _ in sample]
        # alike examples side by side make block bounds tight: by class, then by the heaviest terms
        heavy = [sorted(t[np.argsort(-w, kind="stable")[:3]].tolist()) for t, w in vectors]
        order = sorted(range(len(sample)), key=lambda i: (sample[i][1], heavy[i], i))
        self.labels, self.ids = np.array([sample[i][1] for i in order], float), [sample[i][2] for i in order]
        self.index = BlockMaxIndex([vectors[i] for i in order], len(names))
        # each sampled text votes among the others
        votes = np.array([self.vote([(s, d) for s, d in near if d != place][:K]) for place, near in enumerate(self.nearest([vectors[i] for i in order], K + 1))])
        y = self.labels
        weight = np.where(y == 1, counts[1] / total / y.mean(), counts[0] / total / (1 - y.mean()))
        self.slope, self.intercept = logistic(votes, y, weight)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit weights of those terms of a text that the sample holds; others are left out."""
        bag = bag_of(text)
        t = np.fromiter(map(self.term.get, bag, repeat(-1)), np.int64, len(bag))
        known = t >= 0
        t, c = t[known], np.fromiter(bag.values(), np.int64, len(bag))[known]
        if not len(t):
            return t, np.zeros(0)
        w = (1 + np.log(c)) * self.factor[t]
        return t, w / np.sqrt((w * w).sum())

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """The k nearest of each, searched in groups of bounded terms, so memory does not follow long texts but for a single one."""
        out, group, held = [], [], 0
        for v in vectors:
            if group and (held + len(v[0]) > TERMS_AT_ONCE or len(group) == AT_ONCE):
                out += self.index.search(group, k)
                group, held = [], 0
            group.append(v)
            held += len(v[0])
        return out + (self.index.search(group, k) if group else [])

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Similarity-weighted share of toxic neighbours; FAINT damps the vote of distant ones."""
        return sum(s for s, d in near if self.labels[d]) / (sum(s for s, _ in near) + FAINT)

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        if not self.fitted:
            return np.full(len(texts), self.constant), [""] * len(texts)
        own = {t: i for i, t in enumerate(dict.fromkeys(texts))}  # equal texts are searched once
        found = self.nearest([self.vector(t) for t in own], K)
        near = [found[own[t]] for t in texts]
        votes = np.array([self.vote(x) for x in near])
        return sigmoid(votes * self.slope + self.intercept), [",".join(f"{self.ids[d]}:{int(self.labels[d])}:{s:.3f}" for s, d in x[:3]) for x in near]


def fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """Learns from labels of crc32(doc_id) mod 5 other than 0."""
    return ToxicityModel(*labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", lambda key: crc_is(key, 5, 0), PER_CLASS, LONGEST))


def scored(docs: DataFrame, model: ToxicityModel, at_least: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, evidence (three nearest as doc_id:label:similarity); the index is bounded by the sample."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        one_blas_thread()
        for b in batches:
            s, why = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= at_least).astype("int32")), pa.array(why, pa.string())], ["doc_id", "score", "predicted", "evidence"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, score double, predicted int, evidence string")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels of crc32(doc_id) mod 5 = 0 are held out."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(spark, docs, sf_dir)).select("doc_id", crc_is(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "evidence")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, at_least: float = 0.5) -> DataFrame:
    """The rows of docs that are not predicted toxic, columns untouched: rows pass through, so null or repeated ids are safe."""
    short_batches(spark)
    shared = spark.sparkContext.broadcast(fit(spark, docs, sf_dir))
    place = docs.columns.index("text")

    def run(batches):
        one_blas_thread()
        for b in batches:
            s, _ = shared.value.score([t or "" for t in b.column(place).to_pylist()])
            yield b.filter(pa.array(s < at_least))

    return docs.mapInArrow(run, docs.schema)
