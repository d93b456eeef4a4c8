"""Plug points: what a user brings in place of a model.

A Scorer gives pairs of texts a number, an Embedder a text a vector, an Extractor a chapter its entities; each works on whole
Arrow columns, so a model is loaded once in a worker. The defaults need no model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: (left texts, right texts) -> scores; texts -> vectors; texts -> rows (entity_type, name, start, end) of each text.
Scorer = Callable[[list[str], list[str]], list[float]]
Embedder = Callable[[list[str]], list[list[float]]]
Extractor = Callable[[list[str]], list[list[tuple[str, str, int, int]]]]


def scored(pairs: DataFrame, scorer: Scorer, left: str = "a", right: str = "b", out: str = "rank") -> DataFrame:
    """pairs with a scorer's column; null texts count as empty."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x, y = ([t or "" for t in b.column(b.schema.get_field_index(c)).to_pylist()] for c in (left, right))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scorer(x, y), pa.float64())], schema=b.schema.append(pa.field(out, pa.float64())))

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField(out, DoubleType())]))


def embedded(texts: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """key, vector, error of (key, text), in batches of a fixed size; a batch that fails is marked with its error and skipped."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys, all_texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            vectors, errors = [], []
            for at in range(0, len(all_texts), batch):
                part = all_texts[at : at + batch]
                try:
                    got, why = embedder(part), [None] * len(part)
                except Exception as e:  # noqa: BLE001 a model's error is data here
                    got, why = [None] * len(part), [f"{type(e).__name__}: {e}"] * len(part)
                vectors += got
                errors += why
            yield pa.RecordBatch.from_arrays([keys, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["key", "vector", "error"])

    return texts.select("key", "text").mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, vector array<float>, error string")


def rule_extractor(texts: list[str]) -> list[list[tuple[str, str, int, int]]]:
    """Entities of the default patterns: what a marked-up chapter names outright."""
    from skein.operators.facts import facts

    return [[(kind, fields["name"], a, b) for _, kind, fields, _, a, b in facts(t) if "name" in fields] for t in texts]


def extracted(chapters: DataFrame, keys: list[str], extractor: Extractor = rule_extractor) -> DataFrame:
    """keys, entity_type, name, start, end of each entity that an extractor finds in `text`."""
    from skein.operators.chapters import read_each

    return read_each(chapters, "text", lambda t: extractor([t])[0], "entity_type string, name string, start int, end int", keys)


@dataclass
class Session:
    """The plugs of one application."""

    scorer: Scorer | None = None
    embedder: Embedder | None = None
    extractor: Extractor = field(default=rule_extractor)
