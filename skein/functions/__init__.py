"""Column functions that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Leading articles that names lose, one after another in this order.
ARTICLES = ["the ", "a ", "an ", "les ", "des ", "le ", "la ", "l'", "l'", "un ", "une ", "du ", "de ", "d'", "d'"]


def normal_name(name: Column) -> Column:
    """Trimmed lower-case name without leading articles; each article is taken off once, in the listed order."""
    return reduce(lambda c, a: F.regexp_replace(c, f"^{a}", ""), ARTICLES, F.lower(F.trim(name)))


def with_normal_name(df: DataFrame, name: str, out: str) -> DataFrame:
    """df with the normal form of a name, composed (NFC) first; only names beyond ASCII pass through Python for that."""
    plain = F.coalesce(F.col(name).rlike(r"^[\x00-\x7f]*$"), F.lit(True))

    def run(batches):
        import unicodedata

        import pyarrow as pa

        for b in batches:
            at = b.schema.get_field_index(name)
            whole = pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*b.columns, whole], schema=b.schema.append(pa.field("_nfc", whole.type)))

    composed = df.where(~plain).mapInArrow(run, StructType([*df.schema.fields, StructField("_nfc", StringType())]))
    return df.where(plain).withColumn("_nfc", F.col(name)).unionByName(composed).withColumn(out, normal_name(F.col("_nfc"))).drop("_nfc")


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long float arrays; null where either has no length."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def valid_at(chapter: int, start: Column, end: Column, half_open: bool = False) -> Column:
    """Whether an interval with an optional end holds at a chapter; closed unless half_open."""
    return (start <= chapter) & (end.isNull() | ((end > chapter) if half_open else (end >= chapter)))


def not_later(chapter: Column, most: int | None) -> Column:
    """The spoiler guard: unknown chapters pass, and so does everything without a limit."""
    return F.lit(True) if most is None else chapter.isNull() | (chapter <= most)
