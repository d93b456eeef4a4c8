"""Operator 8: passages of a benchmark in documents, by SimHash of item-sized windows.

An item is a row of words; in a document every window of as many words is compared with it. A window's fingerprint is the
64-bit SimHash of its five-word shingles (weighted by how often each occurs). Four tables, one for each block of 16 bits,
hold every item under all block values within BLOCK_RADIUS bits of its own, so one look-up a block finds every item within
RADIUS bits of a window (one of four blocks must be within a quarter of the distance). What is found is verified by the
exact weighted Jaccard similarity of the shingles, which must reach `similar`.

Windows without any shingle of the benchmark cannot be similar, so only those around such shingles are fingerprinted. One
pass over the documents looks every place up in a bitmap of the benchmark's shingles (BITS bits, two for each, whatever the
benchmark's size; wrong hits cost work only) and emits the documents that hit, as word numbers. Their hits meet the
benchmark's shingles in a join; each such document then goes to the blocks of about ITEMS items that it shares a shingle
with, in shards of about SHARD documents. The benchmark itself never reaches the driver. RADIUS is 23 bits: at the threshold
of 0.8 two fingerprints differ by 9.7 bits on average with a deviation of 2.9.

Defined results: null and empty texts and items match nothing; items of fewer than five words are one shingle, the whole
sequence, and match where exactly these words stand; of several windows that match an item in a document the most similar,
then the first, is reported; equal items each report; repeated rows each report, null ids too; extra columns are ignored;
texts of any length are read whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import id_place, keyed_text, marked, scratch, short_batches, table
from skein.llm.shingles import WIDTH, sequences_of, shingles_of, words_of

ITEMS, SHARD = 250, 500
SIMILAR = 0.8
BLOCK_BITS, BLOCK_RADIUS = 16, 5
RADIUS = 4 * (BLOCK_RADIUS + 1) - 1
#: Bits of the map of the benchmark's shingles; its parts hold 32768 each.
BITS = 1 << 25


def fingerprint(shingles: np.ndarray, weights: np.ndarray) -> int:
    """64-bit SimHash of weighted shingles."""
    bits = (shingles[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    votes = ((bits.astype(np.int64) * 2 - 1) * weights[:, None]).sum(0)
    return int((np.uint64(1) << np.flatnonzero(votes > 0).astype(np.uint64)).sum(dtype=np.uint64))


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller weights over the sum of the larger ones."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def near_blocks() -> np.ndarray:
    """All 16-bit numbers of at most BLOCK_RADIUS set bits."""
    return np.array([sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)], np.int64)


class Benchmark:
    """Items of a block of the benchmark (their word numbers) with their shingles and, by length, their multi-index tables."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids, self.lengths, self.bags = [i for i, _ in items], [len(w) for _, w in items], [Counter(shingles_of(w).tolist()) for _, w in items]
        self.prints = [fingerprint(np.array(list(g), np.uint64), np.array(list(g.values()))) for g in self.bags]
        self.by_length: dict[int, list[int]] = defaultdict(list)
        holders: dict[int, set[int]] = defaultdict(set)
        self.short: dict[int, list[int]] = defaultdict(list)  # number of the whole sequence -> items of fewer than five words
        for i, n in enumerate(self.lengths):
            if n < WIDTH:
                self.short[next(iter(self.bags[i]))].append(i)
                continue
            self.by_length[n].append(i)
            for s in self.bags[i]:
                holders[s].add(n)
        self.holders = {s: sorted(v) for s, v in holders.items()}  # shingle -> lengths of the items that hold it
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def table(self, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block of bits: sorted block values within BLOCK_RADIUS of an item's, and these items; made when asked."""
        if length not in self.tables:
            near, items = near_blocks(), np.array(self.by_length[length], np.int32)
            prints = np.array([self.prints[i] for i in items], np.uint64)
            blocks = []
            for k in range(64 // BLOCK_BITS):
                own = (prints >> np.uint64(BLOCK_BITS * k)).astype(np.uint16)
                values = (own[:, None] ^ near.astype(np.uint16)[None, :]).ravel()
                order = np.argsort(values, kind="stable")
                blocks.append((values[order], np.repeat(items, len(near))[order]))
            self.tables[length] = blocks
        return self.tables[length]

    def candidates(self, print_: int, length: int) -> set[int]:
        """Items of a length whose fingerprint is within RADIUS bits."""
        found: set[int] = set()
        for k, (values, items) in enumerate(self.table(length)):
            v = np.uint16(print_ >> (BLOCK_BITS * k) & 0xFFFF)
            a, b = values.searchsorted(v, "left"), values.searchsorted(v, "right")
            if a < b:
                found.update(items[a:b].tolist())
        return {i for i in found if (self.prints[i] ^ print_).bit_count() <= RADIUS}

    def matches(self, words: np.ndarray, places: list[int], numbers: list[int], similar: float) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, end) of a document, from the places of what may be shingles of the benchmark."""
        best: dict[int, tuple[float, int, int]] = {}

        def offer(i: int, s: float, start: int, length: int) -> None:
            if s >= similar and (i not in best or (s, -start) > (best[i][0], -best[i][1])):
                best[i] = (s, start, start + length)

        starts: dict[int, set[int]] = defaultdict(set)
        for p, number in zip(places, numbers, strict=True):
            for length in self.holders.get(number, ()):
                starts[length].update(range(max(0, p - length + WIDTH), min(p, len(words) - length) + 1))
            for i in self.short.get(number, ()):
                offer(i, 1.0, p, self.lengths[i])
        shingles = shingles_of(words) if starts else None
        for length, places_ in starts.items():
            for start in sorted(places_):
                window = Counter(shingles[start : start + length - WIDTH + 1].tolist())
                print_ = fingerprint(np.fromiter(window, np.uint64, len(window)), np.fromiter(window.values(), np.int64, len(window)))
                for i in self.candidates(print_, length):
                    offer(i, weighted_similarity(window, self.bags[i]), start, length)
        return [(self.ids[i], *x) for i, x in sorted(best.items())]


def shaped(benchmark: DataFrame) -> DataFrame:
    """item_id, words (64-bit numbers), numbers (of the distinct shingles) of each item with an id and a word."""

    def run(batches):
        for b in batches:
            words, ends = words_of(b.column(1).to_pylist())
            own = [words[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            distinct = [np.unique(shingles_of(w)).view(np.int64) for w in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w.tobytes() for w in own], pa.binary()), pa.array(distinct, pa.list_(pa.int64()))], ["item_id", "words", "numbers"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    return items.mapInArrow(run, "item_id long, words binary, numbers array<long>").where(F.length("words") > 0)


def slots(number: Column) -> Column:
    """The two places of a number in the bitmap."""
    return F.array(F.pmod(number, F.lit(BITS)), F.pmod(F.shiftrightunsigned(number, 32), F.lit(BITS)))


def sieve(items: DataFrame) -> bytes:
    """The bitmap of all numbers of the items; its size is BITS / 8 bytes, whatever their number."""
    place = items.select(F.explode("numbers").alias("x")).distinct().select(F.explode(slots(F.col("x"))).alias("x")).select((F.col("x") + 1).alias("x"))
    parts = place.groupBy(F.bitmap_bucket_number("x").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = bytearray(BITS // 8)
    for r in parts.collect():  # BITS / 32768 rows at most
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = r["bits"]
    return bytes(out)


def suspects(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key, words, places, numbers of each row that hits the bitmap; one pass over the documents."""
    spark = docs.sparkSession
    short_batches(spark)
    bits = spark.sparkContext.broadcast(sieve(items))
    short = sorted(r["n"] for r in items.where(F.length("words") < 8 * WIDTH).select((F.length("words") / 8).cast("int").alias("n")).distinct().collect())  # four at most

    def run(batches):
        known, mask = np.frombuffer(bits.value, np.uint8), np.uint64(BITS - 1)

        def maybe(numbers):
            def held(x):
                return known[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1

            at = np.flatnonzero(held(numbers & mask))
            return at[held((numbers[at] >> np.uint64(32)) & mask) > 0]

        for b in batches:
            words, ends = words_of(b.column(1).to_pylist())
            every = [(n, x, maybe(x)) for n in (*short, WIDTH) if len(x := sequences_of(words, n))]  # also across texts; left out below
            rows = []
            for k, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                mine = [(x, at[np.searchsorted(at, a) : np.searchsorted(at, z - n + 1)]) for n, x, at in every if z - a >= n]
                if any(len(at) for _, at in mine):
                    rows.append((k, words[a:z].tobytes(), np.concatenate([at - a for _, at in mine]), np.concatenate([x[at] for x, at in mine]).view(np.int64)))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(2).take(at), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                ["doc_id", "text_key", "words", "places", "numbers"],
            )

    keyed = keyed_text(docs).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, words binary, places array<long>, numbers array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, end_word, text_key): one row for each item found in a row of docs."""
    spark = docs.sparkSession
    items = scratch(spark, shaped(benchmark), "items")
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(items.count() / ITEMS))).cast("int")
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), blocks).cast("int"))
    rows = scratch(spark, suspects(docs, items).withColumn("uid", F.monotonically_increasing_id()), "suspects")  # the ids are fixed by writing
    shared = items.select("block", F.explode("numbers").alias("number")).distinct()
    hits = rows.select("uid", F.explode(F.array_distinct("numbers")).alias("number")).join(shared, "number").select("uid", "block").distinct()
    hits = scratch(spark, hits, "hits")
    shards = hits.groupBy("block").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    given = items.join(shards, "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    met = rows.join(hits.join(shards, "block"), "uid").withColumn("shard", F.pmod(F.xxhash64("uid"), "shards").cast("int"))
    none = F.array().cast("array<long>")
    both = given.select("block", "shard", F.lit(True).alias("item"), F.col("item_id").alias("id"), F.lit(None).cast("long").alias("text_key"), "words", none.alias("places"), none.alias("numbers")).unionByName(
        met.select("block", "shard", F.lit(False).alias("item"), F.col("doc_id").alias("id"), "text_key", "words", "places", "numbers")
    )

    def run(batches):
        here, items_, known = None, [], None
        for b in batches:
            out = []
            for block, shard, is_item, id_, key, words, places, numbers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block, shard) != here:
                    here, items_, known = (block, shard), [], None
                words = np.frombuffer(words, np.uint64)
                if is_item:
                    items_.append((id_, words))
                    continue
                if known is None:
                    known = Benchmark(items_)
                out += [(id_, *m, key) for m in known.matches(words, places, np.array(numbers, np.int64).view(np.uint64).tolist(), similar)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "end_word", "text_key"])

    dealt = both.repartition("block", "shard").sortWithinPartitions("block", "shard", F.desc("item"))
    return dealt.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, end_word long, text_key long")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document; documents without any have no row."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that hold no benchmark item, columns untouched; null and repeated ids are told apart by their texts.

    Rows outside a bitmap of fixed size over what was found pass without a shuffle.
    """
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_found_id"), F.col("text_key").alias("_found_key")).distinct()
    found = scratch(spark, found, "leaks")
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    seen = marked(docs, id_place(key), found.select(id_place(F.col("_found_key")).alias("place")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_found_id")) & (key == F.col("_found_key"))
    left = seen.where("_marked").join(found, same, "left_anti")
    return seen.where("NOT _marked").unionByName(left).select(*docs.columns)

