"""Helpers shared by the training-data operators: input shaping, scratch tables, label samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.storage import scratch, shared_folder

__all__ = ["BATCH_ROWS", "crc_is", "id_place", "keyed_text", "labelled_sample", "logistic", "marked", "one_blas_thread", "scratch", "shared_folder", "short_batches", "sigmoid", "table"]

#: Rows per Arrow batch handed to Python; keeps a worker's memory a few MB above its longest text.
BATCH_ROWS = 512
#: Bits of a map of keys: 4 MB, however many keys there are.
ID_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, opened by Spark's own reader so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty; every other column, clashing or not, is left behind."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; texts are long, so the default of 10,000 rows is too many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_place(key: Column) -> Column:
    """A key's place in a bitmap of ID_BITS bits, from 1."""
    return F.pmod(F.xxhash64(key), F.lit(ID_BITS)) + 1


def marked(df: DataFrame, place: Column, wanted: DataFrame) -> DataFrame:
    """df with _marked: whether its place is one of wanted's (column `place`). Other keys may share a place.

    The map is broadcast: at most ID_BITS / 32768 rows of 4 KB, however many places are wanted.
    """
    bits = wanted.groupBy(F.bitmap_bucket_number("place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (at % 8 + 1).cast("int"))
    looked = df.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket", "left")
    return looked.withColumn("_marked", F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop("_bucket", "_bits")


def crc_is(key: Column, modulus: int, remainder: int) -> Column:
    """crc32(key as text) mod modulus = remainder; a null key counts as false."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, reserved: Callable[[Column], Column], per_class: int, longest: int) -> tuple[list[tuple[str, int, int]], tuple[int, int]]:
    """A bounded sample of (text, label, doc_id) and the full counts of both classes.

    At most per_class documents a class, taken in hash order of doc_id from the rows that `reserved` does not hold out,
    of texts of at most `longest` characters (both are documented parameters of the fit; scoring reads whole texts).
    A doc_id with contradictory labels is not used; repeated rows count once. The ids are broadcast: 2 * per_class at most.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~reserved(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("y = 0").orderBy(*order).limit(per_class).unionByName(known.where("y = 1").orderBy(*order).limit(per_class))
    rows = (
        keyed_text(docs).where(F.length("text") <= longest).join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy(*order)
    )
    return [(r["text"], r["y"], r["doc_id"]) for r in rows.collect()], (counts.get(0, 0), counts.get(1, 0))


def logistic(x, y, weight):
    """One-feature logistic regression by damped Newton steps with a weak ridge; returns (slope, intercept)."""
    import numpy as np

    scale = float(np.std(x)) or 1.0
    z, w = np.stack([np.asarray(x) / scale, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + 1e-3 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def one_blas_thread() -> None:
    """Products of matrices in this worker use its own core only; its neighbours' tasks have the others. Without the known
    library nothing changes but speed."""
    import ctypes
    from pathlib import Path

    import numpy as np

    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
