"""Operator 9: language by expectation-maximisation over n-gram likelihoods.

Character trigrams, bigrams and letters of a bounded sample of labelled texts give every language a smoothed trigram
model. A document is a mixture: each word has a likelihood under each language, and expectation-maximisation finds the
shares of the languages that make the document likeliest. Languages are added greedily while the penalised likelihood
(BIC, one parameter a language) grows. The language with the largest share is the prediction and its share the score.

The sample is taken in one pass over ids, languages and lengths and counted where the texts are; the driver gets counts of
trigram buckets by language only (at most BUCKETS a language). There may be up to LANGUAGES languages; a column with more
is refused with an error, as the model would not fit into a worker.

Defined results: a null text, an empty one and one without a letter are `und` with score 0; equal shares go to the
language first in order; a corpus without labels predicts `und` throughout; repeated rows are predicted alike; extra
columns are ignored. Texts of any length are read whole, in pieces of PIECE words that add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import crc_is, keyed_text, short_batches, table

#: Bounds of the fit: texts and characters a language (a first text counts whatever its length; longer than LONGEST ones
#: only follow the others), and languages.
PER_LANGUAGE, CHARACTERS, LONGEST, LANGUAGES = 1200, 8_000_000, 20_000, 2000
BUCKETS = 1 << 16
ROUNDS, ENOUGH = 30, 1e-4
#: Characters that are read at a time.
PIECE = 1 << 20

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def word_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams over the words of a text, each word between two marks, and where each word begins among them."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    is_letter = letters()[c]
    c = np.concatenate([[0], np.where(is_letter, c, 0), [0]])
    inside = c > 0
    kept = inside | np.r_[False, inside[:-1]] | np.r_[inside[1:], False]  # letters and one mark at either side
    c = c[kept]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = ((c[:-2] * 0x9E3779B1 + c[1:-1] * 0x85EBCA77 + c[2:] * 0xC2B2AE3D) >> 7) & (BUCKETS - 1)
    real = c[1:-1] > 0  # a trigram for each letter, with what stands beside it
    start = (c[:-2] == 0) & real
    return gram[real], np.flatnonzero(start[real])


def model_of(names: list[str], counts: np.ndarray) -> dict:
    """Log-likelihoods of the trigram buckets by language, smoothed towards what all languages share; counts: BUCKETS x names."""
    counts = counts.astype(np.float64) if len(names) else np.zeros((BUCKETS, 1))
    shared = counts.sum(1) + 0.01
    shared /= shared.sum()
    out = np.empty(counts.shape, np.float32)
    for k in range(counts.shape[1]):
        out[:, k] = np.log((counts[:, k] + 200 * shared) / (counts[:, k].sum() + 200))
    return {"names": names, "log": out}


def fit(sample: list[tuple[str, str]]) -> dict:
    """The model of texts and their languages that are at hand."""
    names = sorted({lang for _, lang in sample})
    counts = np.zeros((BUCKETS, len(names)), np.int64)
    for text, lang in sample:
        counts[:, names.index(lang)] += np.bincount(word_grams(text)[0], minlength=BUCKETS)
    return model_of(names, counts)


def mixture(log_words: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
    """Shares of the chosen languages and the log-likelihood, from the words' log-likelihoods (words x languages)."""
    rows = log_words[:, chosen].astype(float)
    top = rows.max(1)
    like = np.exp(rows - top[:, None])
    share = np.full(len(chosen), 1 / len(chosen))
    for _ in range(ROUNDS if len(chosen) > 1 else 0):
        part = like * share
        part /= part.sum(1)[:, None]
        now = part.mean(0)
        done = np.abs(now - share).max() < ENOUGH
        share = now
        if done:
            break
    return share, float((np.log(like @ share) + top).sum())


def predict(text: str, model: dict) -> tuple[str, float]:
    names, log = model["names"], model["log"]
    if not names or not text:
        return "und", 0.0
    found = []
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end].isalpha():  # a piece ends between words
            end += 1
        grams, start = word_grams(text[at:end])
        if len(start):
            found.append(np.add.reduceat(log[grams], start))
        at = end
    if not found:
        return "und", 0.0
    words = np.concatenate(found)
    total = words.sum(0, dtype=float)
    best = int(np.argmax(total))
    chosen, share, value = [best], np.ones(1), float(total[best])
    penalty = 0.5 * np.log(len(words)) + 1
    # a language can only help where it beats the chosen ones on a word
    while len(chosen) < len(names):
        lead = words[:, chosen].max(1)
        gain = np.maximum(words - lead[:, None], 0).sum(0)
        gain[chosen] = -1
        nxt = int(np.argmax(gain))
        if gain[nxt] <= penalty:
            break
        s, v = mixture(words, [*chosen, nxt])
        if v - value <= penalty:
            break
        chosen, share, value = [*chosen, nxt], s, v
    k = min(range(len(chosen)), key=lambda i: (-round(float(share[i]), 9), chosen[i]))
    return names[chosen[k]], float(min(1.0, share[k]))


def sampled(docs: DataFrame, lang: str = "lang") -> tuple[list[str], DataFrame]:
    """The languages, and (doc_id, lang) of the sample: outside the held-out third, in hash order of doc_id a language.

    Rows of a common language are thinned by the hash, to three times what is wanted, before they are ranked.
    """
    known = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.length(F.col("text").cast("string")).cast("long").alias("size"))
        .where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~crc_is(F.col("doc_id"), 3, 1))
        .select("doc_id", "lang", "size", (F.col("size") > LONGEST).alias("long"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("place"))
    )
    counts = known.groupBy("lang", "long").agg(F.count("*").alias("n")).limit(2 * LANGUAGES + 1).collect()
    names = sorted({r["lang"] for r in counts})
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in column {lang}")
    thin = docs.sparkSession.createDataFrame([(r["lang"], r["long"], min(1 << 30, 3 * PER_LANGUAGE * (1 << 30) // r["n"])) for r in counts], "lang string, long boolean, most long")
    order = W.partitionBy("lang").orderBy("long", "place", "doc_id")
    ranked = known.join(F.broadcast(thin), (known["lang"].eqNullSafe(thin["lang"])) & (known["long"] == thin["long"])).where("place <= most").select("doc_id", known["lang"], "size", known["long"], "place")
    first = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PER_LANGUAGE)
    held = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return names, first.withColumn("held", held).where((F.col("held") <= CHARACTERS) | (F.col("rank") == 1)).select("doc_id", "lang").distinct()


def learned(docs: DataFrame) -> dict:
    """The model of a table's labelled sample; texts of repeated ids all count."""
    names, picked = sampled(docs)
    if not names:
        return model_of([], np.zeros((BUCKETS, 0)))
    short_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            langs = b.column(1).to_pylist()
            sums: dict[str, np.ndarray] = {}
            for text, lang in zip(b.column(0).to_pylist(), langs, strict=True):
                for at in range(0, len(text), PIECE):
                    got = np.bincount(word_grams(text[at : at + PIECE])[0], minlength=BUCKETS)
                    sums[lang] = sums[lang] + got if lang in sums else got
            for lang, got in sums.items():
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], ["lang", "bucket", "n"])

    texts = keyed_text(docs).join(F.broadcast(picked), "doc_id").select("text", "lang")  # PER_LANGUAGE ids a language at most
    counted = texts.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(names)), np.int64)
    place = {n: i for i, n in enumerate(names)}
    counts[counted.column("bucket").to_numpy(), [place[x] for x in counted.column("lang").to_pylist()]] = counted.column("n").to_numpy()
    return model_of(names, counts)


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for each row; the model is BUCKETS x languages floats, 0.25 MB a language."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = [predict(t, shared.value) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; rows of crc32(doc_id) mod 3 = 1 are held out."""
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, learned(docs)).select("doc_id", crc_is(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
