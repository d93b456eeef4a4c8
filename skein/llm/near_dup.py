"""Operator 5: near-duplicates by chosen paths, a recursive set similarity join.

A document is its set of five-word shingles. COORDINATES minwise tokens of the set, one byte of each, are its sketch; two
sets of similarity s agree in a share s of them (and by chance in 1/256 of the rest). TREES independent trees send a document
to the node of one whole minwise token each. A node of up to SMALL documents is compared exhaustively. In a larger one
PIVOTS_OF_NODE pivots are compared with all; where few documents are outside the largest group that they join, these are
compared with the whole node, which finds all that exhaustive comparison would. Any other node is branched by one further
token, and by a second one with such a probability that a pair at the threshold has one common child on average, so work
does not grow from level to level, while less similar pairs part. A pair at 0.85 meets in the first node of none of the
trees with probability 6e-9; branched nodes lose more, so they are branched again and again by other tokens until the
computed share of pairs that all trees miss (`missed`) is MISS at the depth that was reached.

All of a node of up to NODE_ROWS documents (80 bytes each) happens in one task, in memory. Larger nodes are first dealt in
shards and branched by joins, by the same rules, until their children have that size.

Comparisons on sketches (AGREE of COORDINATES bytes, which a pair of similarity 0.85 misses with probability 1e-8, and the
exact bound on set sizes) only say which documents belong in one cluster. Links are confirmed on full sets within clusters:
a small cluster in one task; in a large one, shards of its documents meet rounds of pivots, FIRST_PIVOTS at first and
MORE_PIVOTS times as many in each further round, chosen among those outside the largest component so far, until none is
outside that has not met all. So every link between different components has been looked for, whatever the size.
Documents of equal sets form one class, which takes part once.

Nothing that follows the corpus reaches the driver; groups meet in one task only where their size is bounded. Texts of
documents without a candidate are not shuffled: a bitmap of fixed size over the wanted ids leaves them out.

Defined results: words are as in shingles.py; null and empty texts have size 0 and no link; fewer than five words are one
shingle; rows that repeat a doc_id are linked by their own texts; a null doc_id gets the component of its class if it has
any other member, else null, and is kept only in the latter case; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import BATCH_ROWS, id_place, keyed_text, marked, scratch, short_batches, table
from skein.llm.shingles import common, mix, shingle_sets
from skein.operators.components import connected_components
from skein.plans.storage import release

TREES, COORDINATES, AGREE = 10, 48, 24
#: Share of pairs at the threshold that all trees together may miss, by computation.
MISS = 1e-4
#: Documents of a node that are compared in one go with those of others; of a node that is compared exhaustively.
FEW, SMALL = 8, 1500
#: Documents of a node that one task takes; of a larger one that a shard takes.
NODE_ROWS, NODE_SHARD = 50_000, 20_000
#: Pivots of a larger node (60 at most); comparisons of rows outside their largest group with all that take place at once.
PIVOTS_OF_NODE, AT_ONCE = 32, 4_000_000
#: Documents and shingles of a cluster, or of a shard of a larger one, that one task takes.
CLUSTER, CLUSTER_SHINGLES = 400, 2_000_000
#: Pivots of a large cluster in the first round; the factor from round to round; pivots that meet a shard at a time.
FIRST_PIVOTS, MORE_PIVOTS, PIVOT_BLOCK = 64, 32, 400
#: Postings that are added up at a time.
POSTINGS = 1 << 20

_SEED = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_FACTOR = mix(_SEED) | np.uint64(1)


def tokens(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a nonempty set."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14)]
        for k in range(COORDINATES):
            out[k] = min(out[k], ((part ^ _SEED[k]) * _FACTOR[k]).min())
    return mix(out)


def sketch(found: np.ndarray) -> np.ndarray:
    """One byte of each token."""
    return (found >> np.uint64(56)).astype(np.uint8)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), roots (the trees' whole tokens), sketch."""
    short_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist())
            found = [tokens(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if t is None else t[:TREES].astype(np.int64).tolist() for t in found], pa.list_(pa.int64())),
                    pa.array([None if t is None else sketch(t).tobytes() for t in found], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "roots", "sketch"],
            )

    return keyed_text(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, roots array<long>, sketch binary")


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def alike(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows of sketches may be of sets that similar: enough equal bytes, and sizes that allow it."""
    return ((a == b).sum(1) >= AGREE) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


class Overlaps:
    """Links of one set with many, on full sets, by an inverted index over the shingles of the many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(every, kind="stable")
        self.of = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        every = every[order]
        self.first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        self.shingles, self.count = every[self.first], np.diff(np.r_[self.first, len(every)])

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """The places of the sets with 100 * intersection >= percent * union."""
        if not len(self.shingles):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        at = at[self.shingles[at] == s]
        ends, both, low = np.cumsum(self.count[at]), np.zeros(len(self.sizes), np.int64), 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + POSTINGS, "right")))
            first, count = self.first[at[low:high]], self.count[at[low:high]]
            places = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
            both += np.bincount(self.of[places], minlength=len(self.sizes))
            low = high
        return np.flatnonzero(100 * both >= percent * (len(s) + self.sizes - both))


class Forest:
    """Union-find over what it is asked about."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[y]
            x = self.up[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups of rows with equal first `keys` columns, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(k)[-1] for k in range(keys)]
        at = b.num_rows - 1
        while at > 0 and all(b.column(k)[at - 1] == v for k, v in enumerate(last)):
            at -= 1
        if at == 0 and held and all(held[-1].column(k)[-1] == v for k, v in enumerate(last)):
            held.append(b)  # one group goes on through all of the batch
            continue
        if held or at:
            yield pa.Table.from_batches([*held, b.slice(0, at)])
        held = [b.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def second(percent: int) -> float:
    """Probability of a second branch: a pair at the threshold then has one common child on average."""
    return 100 / percent - 1


@lru_cache(maxsize=4096)
def missed(percent: int, depth: int, repeats: int) -> float:
    """Computed probability that a pair at the threshold has no common last node, with `repeats` branchings of each root.

    All trees draw on one sketch, so this is a mean over the binomial number of tokens in which the pair agrees.
    """
    s, two, total = percent / 100, second(percent), 0.0
    for k in range(COORDINATES + 1):
        a, lost = k / COORDINATES, 0.0
        for _ in range(depth):
            one = 1 - a + a * lost
            lost = (1 - two) * one + two * one * one
        total += comb(COORDINATES, k) * s**k * (1 - s) ** (COORDINATES - k) * (1 - a * (1 - lost**repeats)) ** TREES
    return total


def enough(percent: int, depth: int, repeats: int) -> bool:
    """Whether the computed share of missed pairs is MISS at most, or near what the roots alone miss."""
    return repeats > 0 and missed(percent, depth, repeats) <= max(MISS, 2 * missed(percent, 0, 1))


class Node:
    """The documents of one root in memory; joins the alike ones."""

    def __init__(self, key: int, ids: list[bytes], n: np.ndarray, s: np.ndarray, percent: int, small: int = SMALL, at_once: int = AT_ONCE):
        self.key, self.ids, self.n, self.s, self.percent, self.small, self.at_once = key, ids, n, s, percent, small, at_once
        self.part = np.arange(len(ids))
        self.joins: list[tuple[bytes, bytes]] = []

    def meet(self, k: int, rows: np.ndarray) -> None:
        """Compare document k with rows, but for those that are in its group already."""
        rows = rows[self.part[rows] != self.part[k]]
        hit = rows[alike(self.s[rows], self.n[rows], self.s[k], self.n[k], self.percent)]
        if len(hit):
            parts, first = np.unique(self.part[hit], return_index=True)
            self.joins += [(self.ids[k], self.ids[j]) for j in hit[first].tolist()]
            self.part[np.isin(self.part, parts)] = self.part[k]

    def outside(self, rows: np.ndarray, met: np.ndarray) -> np.ndarray:
        """Those outside the largest group that have not met all rows."""
        parts, count = np.unique(self.part[rows], return_counts=True)
        left = rows[self.part[rows] != parts[count.argmax()]]
        return left[~np.isin(left, met)]

    def exhaust(self, rows: np.ndarray, left: np.ndarray) -> None:
        for k in left.tolist():
            if (self.part[rows] == self.part[rows[0]]).all():
                return
            self.meet(k, rows)

    def grow(self, rows: np.ndarray, used: frozenset[int], rng: np.random.Generator) -> int:
        """Find the alike ones among rows; returns the branchings of the deepest node."""
        if len(rows) <= self.small:
            self.exhaust(rows, rows)
            return 0
        met: list[int] = []
        left = rows
        while len(left) and len(met) < PIVOTS_OF_NODE:
            k = int(left[rng.integers(len(left))])
            met.append(k)
            self.meet(k, rows)
            left = self.outside(rows, np.array(met))
        free = [t for t in range(COORDINATES) if t not in used]
        if len(left) * len(rows) <= self.at_once or not free:
            self.exhaust(rows, left)
            return 0
        depth = 0
        for t in rng.choice(free, min(len(free), 1 + int(rng.random() < second(self.percent))), replace=False).tolist():
            order = rows[np.argsort(self.s[rows, t], kind="stable")]
            cuts = np.flatnonzero(np.diff(self.s[order, t])) + 1
            for child in np.split(order, cuts):
                if len(child) > 1:
                    depth = max(depth, 1 + self.grow(child, used | {t}, rng))
        return depth

    def run(self) -> list[tuple[bytes, bytes]]:
        repeats = depth = 0
        while not enough(self.percent, depth, repeats):
            rng = np.random.default_rng([self.key & 0xFFFFFFFF, repeats])
            depth = max(depth, self.grow(np.arange(len(self.ids)), frozenset(), rng))
            repeats += 1
        return self.joins


def compare_nodes(rows: DataFrame, percent: int) -> DataFrame:
    """rows: node, digest, n, sketch, nodes of NODE_ROWS rows at most. (a, b): a spanning forest of the alike ones of each node."""

    small, at_once = SMALL, AT_ONCE

    def run(batches):
        for t in groups(batches, 1):
            node, ids = t.column(0).to_numpy(), t.column(1).to_pylist()
            n, s = t.column(2).to_numpy(), _sketches(t.column(3))
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[start, len(node)])
            few = np.repeat(size <= FEW, size)
            forest, kept = Forest(), []
            for d in range(1, FEW):
                i = np.flatnonzero((node[:-d] == node[d:]) & few[:-d])
                i = i[alike(s[i], n[i], s[i + d], n[i + d], percent)]
                kept += [(ids[x], ids[x + d]) for x in i.tolist() if forest.join(x, x + d)]
            for at, m in zip(start[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
                kept += Node(int(node[at]), ids[at : at + m], n[at : at + m], s[at : at + m], percent, small, at_once).run()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.binary()), pa.array([y for _, y in kept], pa.binary())], ["a", "b"])

    dealt = rows.select("node", "digest", "n", "sketch").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(run, "a binary, b binary")


def compare_fixed(rows: DataFrame, fixed: DataFrame, percent: int) -> DataFrame:
    """Compare the rows of each (node, shard) with its fixed rows; both: node, shard, digest, n, sketch.

    Returns the rows' node, digest, n and sketch; mask, the fixed ones (of the first 63, by digest) that may be linked with
    the row; and likes, the part of them that a spanning forest of the shard needs.
    """

    def run(batches):
        for t in groups(batches, 2):
            node, shard, pinned = t.column(0).to_numpy(), t.column(1).to_numpy(), np.array(t.column(2).to_pylist(), bool)
            ids, n, s = t.column(3).to_pylist(), t.column(4).to_numpy(), _sketches(t.column(5))
            start = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (shard[1:] != shard[:-1])]).tolist()
            mask, likes = np.zeros(len(node), np.int64), [[] for _ in ids]
            for at, end in zip(start, [*start[1:], len(node)], strict=True):
                first, forest = at + int(pinned[at:end].sum()), Forest()
                for k in range(at, first):
                    hit = first + np.flatnonzero(alike(s[first:end], n[first:end], s[k], n[k], percent))
                    if k - at < 63:
                        mask[hit] |= 1 << (k - at)
                    for j in hit.tolist():
                        if ids[j] != ids[k] and forest.join(ids[j], ids[k]):
                            likes[j].append(ids[k])
            got = t.select([0, 3, 4, 5]).append_column("mask", pa.array(mask)).append_column("likes", pa.array(likes, pa.list_(pa.binary())))
            yield from got.filter(pa.array(~pinned)).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)

    cols = ["digest", "n", "sketch"]
    both = rows.select("node", "shard", F.lit(False).alias("pinned"), *cols).unionByName(fixed.select("node", "shard", F.lit(True).alias("pinned"), *cols))
    dealt = both.repartition("node", "shard").sortWithinPartitions("node", "shard", F.desc("pinned"), "digest")
    return dealt.mapInArrow(run, "node long, digest binary, n long, sketch binary, mask long, likes array<binary>")


def _sharded(rows: DataFrame) -> DataFrame:
    """Adds the shard of a row in its node of `size` rows."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("digest", F.lit(3)), F.ceil(F.col("size") / NODE_SHARD)))


def _in_all_shards(rows: DataFrame) -> DataFrame:
    return rows.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / NODE_SHARD) - 1)))


def node_states(tried: DataFrame) -> DataFrame:
    """node, size, reach, outside: the pivots (as bits) of the largest group that rows join, and the rows outside it."""
    masks = tried.groupBy("node", "mask").agg(F.count("*").alias("rows")).groupBy("node").agg(F.sum("rows").alias("size"), F.collect_list(F.struct("mask", "rows")).alias("masks"))

    def grown(start):
        take = lambda reach, m: F.when(reach.bitwiseAND(m["mask"]) != 0, reach.bitwiseOR(m["mask"])).otherwise(reach)
        return F.aggregate(F.sequence(F.lit(1), F.lit(PIVOTS_OF_NODE)), start, lambda reach, _: F.aggregate("masks", reach, take))

    reaches = F.transform(F.array(*(F.lit(1 << k).cast("long") for k in range(PIVOTS_OF_NODE))), grown)
    held = lambda reach: F.aggregate("masks", F.lit(0).cast("long"), lambda n, m: n + F.when(reach.bitwiseAND(m["mask"]) != 0, m["rows"]).otherwise(F.lit(0).cast("long")))
    best = masks.select("node", "size", "masks", F.explode(reaches).alias("reach")).select("node", "size", "reach", held(F.col("reach")).alias("held"))
    return best.groupBy("node", "size").agg(F.max_by("reach", F.struct("held", "reach")).alias("reach"), F.max("held").alias("held")).select("node", "size", "reach", (F.col("size") - F.col("held")).alias("outside"))


def branch(spark: SparkSession, large: DataFrame, percent: int, repeat: int) -> tuple[int, list[DataFrame]]:
    """Links of nodes of more than NODE_ROWS rows (node, digest, n, sketch, size), branched by joins; and the deepest level."""
    edges, level = [], 0
    while True:
        pivots = large.groupBy("node", F.pmod(F.xxhash64("node", "digest"), F.lit(PIVOTS_OF_NODE)).alias("salt")).agg(F.min(F.struct("digest", "n", "sketch", "size")).alias("p")).select("node", "p.*")
        tried = scratch(spark, compare_fixed(_sharded(large), _in_all_shards(pivots), percent), "tried")
        edges.append(tried.select(F.col("digest").alias("a"), F.explode("likes").alias("b")))
        states = scratch(spark, node_states(tried), "states")
        alone = F.col("mask").bitwiseAND(F.col("reach")) == 0
        last = level == COORDINATES - TREES
        few = F.lit(True) if last else F.col("outside") * F.col("size") <= NODE_SHARD * NODE_SHARD
        near = tried.join(states.where((F.col("outside") > 0) & few), "node")
        edges.append(compare_fixed(_sharded(near), _in_all_shards(near.where(alone)), percent).select(F.col("digest").alias("a"), F.explode("likes").alias("b")))
        deep = tried.join(states.where(~few), "node")
        if last or deep.isEmpty():
            return level, edges
        level += 1
        span = COORDINATES - TREES
        first = F.pmod(F.xxhash64("node", F.lit(level), F.lit(repeat)), F.lit(span))
        step = F.lit(1) + F.pmod(F.xxhash64("node", F.lit(-level), F.lit(repeat)), F.lit(span - 1))
        one, two = (F.xxhash64("node", F.lit(repeat), t, F.substring(F.col("sketch"), (t + 1).cast("int"), F.lit(1))) for t in (F.pmod(first + k * step, F.lit(span)) + TREES for k in range(2)))
        twice = F.pmod(F.xxhash64("node", F.lit("second"), F.lit(repeat)), F.lit(10_000)) < round(10_000 * second(percent))
        children = scratch(spark, deep.select(F.explode(F.when(twice, F.array(one, two)).otherwise(F.array(one))).alias("node"), "digest", "n", "sketch"), "branches")
        sizes = children.groupBy("node").agg(F.count("*").alias("size"))
        edges.append(compare_nodes(children.join(sizes.where(F.col("size").between(2, NODE_ROWS)), "node"), percent))
        large = scratch(spark, children.join(sizes.where(F.col("size") > NODE_ROWS), "node"), "large")
        if large.isEmpty():
            return level, edges


def candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) between classes that may be linked; classes: digest, n, roots, sketch."""
    spark = classes.sparkSession
    placed = classes.select(F.posexplode("roots").alias("tree", "token"), "digest", "n", "sketch").select(F.xxhash64("tree", "token").alias("node"), "digest", "n", "sketch")
    large = scratch(spark, placed.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > NODE_ROWS), "large-nodes")
    if large.isEmpty():
        return compare_nodes(placed, percent)
    edges = [compare_nodes(placed.join(large, "node", "left_anti"), percent)]
    rows = scratch(spark, placed.join(large, "node"), "large-rows")
    depth = repeats = 0
    while not enough(percent, depth, repeats):
        reached, found = branch(spark, rows, percent, repeats)
        depth, repeats = max(depth, reached), repeats + 1
        edges += found
    return reduce(DataFrame.unionByName, edges)


def confirm_clusters(members: DataFrame, percent: int) -> DataFrame:
    """members: cluster, digest, text, clusters of bounded size. (digest, root): classes and the smallest class they reach."""

    def run(batches):
        for t in groups(batches, 1):
            key, ids = t.column(0).to_pylist(), t.column(1).to_pylist()
            sets = shingle_sets(t.column(2).to_pylist())
            sketches = np.stack([sketch(tokens(s)) if len(s) else np.zeros(COORDINATES, np.uint8) for s in sets])
            sizes = np.array([len(s) for s in sets])
            forest, at = Forest(), 0
            known = [digest(s) == d for s, d in zip(sets, ids, strict=True)]
            while at < len(key):
                end = at
                while end < len(key) and key[end] == key[at]:
                    end += 1
                for i in range(at + 1, end):
                    if known[i]:
                        for j in (at + np.flatnonzero(alike(sketches[at:i], sizes[at:i], sketches[i], sizes[i], percent))).tolist():
                            if known[j] and forest.find(ids[i]) != forest.find(ids[j]) and linked(sets[i], sets[j], percent):
                                forest.join(ids[i], ids[j])
                at = end
            own = sorted({d for d, k in zip(ids, known, strict=True) if k})
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([forest.find(d) for d in own], pa.binary())], ["digest", "root"])

    dealt = members.select("cluster", "digest", "text").repartition("cluster").sortWithinPartitions("cluster", "digest")
    return dealt.mapInArrow(run, "digest binary, root binary")


def confirm_shards(members: DataFrame, fixed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between fixed rows and the members of the same shard, as many as a spanning forest of the shard needs.

    members, fixed: cluster, shard, digest, text; a shard has a bounded number of members and of fixed rows.
    """

    def run(batches):
        pins: list[tuple[bytes, np.ndarray]] = []
        here, forest, overlaps = None, Forest(), None
        for b in batches:
            out = []
            cols = [c.to_pylist() for c in b.columns]
            for cluster, shard, pinned, d, s in zip(*cols[:4], shingle_sets(cols[4]), strict=True):
                if (cluster, shard) != here:
                    here, pins, forest, overlaps = (cluster, shard), [], Forest(), None
                if digest(s) != d:
                    continue
                if pinned:
                    pins.append((d, s))
                    continue
                if overlaps is None:
                    overlaps, pins = Overlaps([q for _, q in pins]), [(p, None) for p, _ in pins]
                for k in overlaps.linked(s, percent).tolist():
                    if pins[k][0] != d and forest.join(pins[k][0], d):
                        out.append((d, pins[k][0]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["a", "b"])

    both = members.select("cluster", "shard", F.lit(False).alias("pinned"), "digest", "text").unionByName(fixed.select("cluster", "shard", F.lit(True).alias("pinned"), "digest", "text"))
    dealt = both.repartition("cluster", "shard").sortWithinPartitions("cluster", "shard", F.desc("pinned"), "digest")
    return dealt.mapInArrow(run, "a binary, b binary")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cluster, digest, size, shingles, text for each class of `wanted` (first, digest, cluster, size, shingles).

    A class is read at its smallest doc_id; classes whose rows have none are read by the digest of their sets.
    """
    spark = docs.sparkSession
    out = ["cluster", "digest", "size", "shingles", "text"]
    named = wanted.where("first IS NOT NULL")
    texts = keyed_text(docs).withColumnRenamed("doc_id", "first").where("first IS NOT NULL")
    maybe = marked(texts, id_place(F.col("first")), named.select(id_place(F.col("first")).alias("place"))).where("_marked").drop("_marked")
    found = maybe.join(named.hint("merge"), "first").select(*out)
    nameless = wanted.where("first IS NULL")
    if nameless.isEmpty():
        return found
    short_batches(spark)

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), b.column(1)], ["digest", "text"])

    own = keyed_text(docs).where("doc_id IS NULL").mapInArrow(run, "digest binary, text string").groupBy("digest").agg(F.first("text").alias("text"))
    return found.unionByName(own.join(nameless, "digest").select(*out))


def components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; links: 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    every = scratch(spark, sketched(docs), "sketches")
    classes = scratch(spark, every.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("n"), F.count("*").alias("copies"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch")), "classes")
    near = connected_components(candidate_edges(classes.select("digest", F.col("n"), "roots", "sketch"), percent))
    clusters = scratch(spark, near.select(F.col("node").alias("digest"), F.col("component").alias("cluster")).join(classes.select("digest", "first", "n"), "digest"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    wanted = scratch(spark, clusters.join(sizes, "cluster").select("first", "digest", "cluster", "size", "shingles"), "wanted")
    members = scratch(spark, texts_of(docs, wanted), "members")
    one_task = (F.col("size") <= CLUSTER) & (F.col("shingles") <= CLUSTER_SHINGLES)
    roots = confirm_clusters(members.where(one_task), percent)
    large = members.where(~one_task)
    if not large.isEmpty():
        roots = roots.unionByName(large_roots(spark, large, percent))
    roots = scratch(spark, roots.distinct(), "roots")
    release(spark, members, wanted, clusters)
    first = roots.join(classes.select("digest", "first"), "digest").groupBy("root").agg(F.min("first").alias("component_id"))
    of = scratch(spark, classes.select("digest", "first", "copies").join(roots.join(first, "root").select("digest", "component_id"), "digest", "left").select("digest", "copies", F.coalesce("component_id", "first").alias("component_id")), "components")
    # fewer than `parts` classes can each hold more than a share of 1 / parts of the rows, so this broadcast is bounded
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = F.col("copies") > max(every.count() // parts, 16)
    looked = every.select("doc_id", "n_shingles", "digest").join(F.broadcast(of.where(many).select("digest", F.col("component_id").alias("_hot"))), "digest", "left")
    rest = looked.where("_hot IS NULL").join(of.where(~many).select("digest", "component_id"), "digest", "left")
    placed = rest.select("doc_id", "n_shingles", "component_id").unionByName(looked.where("_hot IS NOT NULL").select("doc_id", "n_shingles", F.col("_hot").alias("component_id")))
    out = placed.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def large_roots(spark: SparkSession, large: DataFrame, percent: int) -> DataFrame:
    """(digest, root) of clusters that no single task takes, by rounds of pivots against shards."""
    shards = F.ceil(F.greatest(F.col("size") / CLUSTER, F.col("shingles") / CLUSTER_SHINGLES)).cast("int")
    rows = large.withColumn("shards", F.greatest(shards, F.lit(1))).withColumn("shard", F.pmod(F.xxhash64("digest"), F.col("shards")).cast("int"))
    own = rows.select("cluster", "digest").distinct()
    left, met, links, most = own, None, None, FIRST_PIVOTS
    while True:
        # the smallest digest of each of `most` salts, or all where that is not many more
        few = left.groupBy("cluster").agg((F.count("*") <= 4 * most).alias("few"))
        salt = F.when(F.col("few"), F.xxhash64("digest")).otherwise(F.pmod(F.xxhash64("digest", F.lit(most)), F.lit(most)))
        pivots = scratch(spark, left.join(few, "cluster").groupBy("cluster", salt.alias("salt")).agg(F.min("digest").alias("digest")).select("cluster", "digest"), "pivots")
        met = pivots if met is None else met.unionByName(pivots)
        block = F.pmod(F.xxhash64("digest", F.lit(2)), F.ceil(F.col("pivots") / PIVOT_BLOCK)).cast("int").alias("block")
        blocks = pivots.groupBy("cluster").agg(F.count("*").alias("pivots"))
        fixed = rows.join(pivots, ["cluster", "digest"], "left_semi").join(blocks, "cluster").withColumn("block", block)
        every = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("pivots") / PIVOT_BLOCK) - 1).cast("int")))
        key = F.concat_ws("/", "shard", "block")
        everywhere = fixed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("shard", key)
        found = scratch(spark, confirm_shards(rows.join(blocks, "cluster").withColumn("block", every).withColumn("shard", key), everywhere, percent), "links")
        links = found if links is None else links.unionByName(found)
        joined = scratch(spark, connected_components(links), "joined")
        parts = own.join(joined.select(F.col("node").alias("digest"), "component"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
        largest = parts.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
        # the largest component needs nothing more among its own, and pivots have met every shard
        left = scratch(spark, parts.join(largest, "cluster").where("component <> largest").select("cluster", "digest").join(met.select("digest"), "digest", "left_anti"), "left")
        if left.isEmpty():
            return joined.select(F.col("node").alias("digest"), F.col("component").alias("root"))
        most *= MORE_PIVOTS


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component at a similarity of 0.85."""
    return components(table(spark, sf_dir, "documents"), 85)


def without_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their component at percent; columns untouched."""
    kept = components(docs, percent).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("_kept_id")), "left_semi")
