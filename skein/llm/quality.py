"""Operator 1: quality by compression against dictionaries of good and of bad text.

Two zstandard dictionaries are trained, one from texts labelled good and one from texts labelled bad. A text is cut into
blocks of BLOCK bytes, every block is compressed with either dictionary, and the difference of the two total sizes,
divided by the bytes of the text, goes through a logistic curve fitted on labelled texts that no dictionary has seen. Blocks keep
the dictionaries in reach over the whole of a long text; PRIOR_BYTES of average text, added to every text, keep very
short ones near the average.

Defined results: null and empty texts have the average difference and get the curve's value there; a corpus without labels of both
classes scores the share of good labels (0.5 without any); repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import crc_is, keyed_text, labelled_sample, logistic, short_batches, sigmoid, table

BLOCK, DICT_BYTES, LEVEL, PRIOR_BYTES = 2048, 112 * 1024, 3, 100
#: Bounds of the fit: labelled texts a class, and characters of a text that may be among them.
PER_CLASS, LONGEST = 3000, 50_000


def blocks(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


@lru_cache(maxsize=4)
def coders(bad: bytes, good: bytes) -> tuple[zstd.ZstdCompressor, ...]:
    out = []
    for raw in (bad, good):
        d = zstd.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))
    return tuple(out)


def sizes(text: str, bad: bytes, good: bytes) -> tuple[int, int]:
    """Bytes of the whole text, and how many more it takes with the bad dictionary than with the good one."""
    b, g = coders(bad, good)
    n = more = 0
    for x in blocks(text):
        n += len(x)
        more += len(b.compress(x)) - len(g.compress(x))
    return n, more


def difference(texts: list[str], bad: bytes, good: bytes, average: float = 0.0) -> np.ndarray:
    """(bytes with the bad dictionary - bytes with the good one) / bytes, drawn to the average where a text is short."""
    s = np.array([sizes(t, bad, good) for t in texts], float).reshape(-1, 2)
    return (s[:, 1] + PRIOR_BYTES * average) / np.maximum(s[:, 0] + PRIOR_BYTES, 1e-9)


def train(texts: list[str]) -> bytes:
    """A dictionary from whole blocks of the texts; raw content where the trainer has too little to work on."""
    parts = [x for t in texts for x in blocks(t)]
    try:
        return zstd.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstd.ZstdError:
        return b"".join(parts)[-DICT_BYTES:]


def fit(sample: list[tuple[str, int, int]], counts: tuple[int, int]) -> dict:
    """Dictionaries from two texts of three, the curve from the third; class weights restore the label table's shares."""
    rest, held = [x[:2] for i, x in enumerate(sample) if i % 3], [x[:2] for i, x in enumerate(sample) if i % 3 == 0]
    seen = {y for _, y in rest} & {y for _, y in held}
    total = sum(counts)
    if seen != {0, 1}:
        share = counts[1] / total if total else 0.5
        return {"constant": share}
    bad, good = (train([t for t, y in rest if y == k]) for k in (0, 1))
    y = np.array([v for _, v in held], float)
    weight = np.where(y == 1, counts[1] / total / y.mean(), counts[0] / total / (1 - y.mean()))
    average = float(np.average(difference([t for t, _ in held], bad, good), weights=weight))
    slope, intercept = logistic(difference([t for t, _ in held], bad, good, average), y, weight)
    return {"bad": bad, "good": good, "average": average, "slope": max(0.0, slope), "intercept": intercept}


def score(texts: list[str], model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    return sigmoid(difference(texts, model["bad"], model["good"], model["average"]) * model["slope"] + model["intercept"])


def scored(docs: DataFrame, model: dict, at_least: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for each row; the model (two dictionaries of at most DICT_BYTES) travels as a broadcast."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = score(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= at_least).astype("int32"))], ["doc_id", "score", "predicted"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; labels of crc32(doc_id) mod 4 = 2 are held out."""
    docs, reserved = table(spark, sf_dir, "documents"), lambda key: crc_is(key, 4, 2)
    model = fit(*labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", reserved, PER_CLASS, LONGEST))
    return scored(docs, model).select("doc_id", reserved(F.col("doc_id")).alias("held_out"), "score", "predicted")
