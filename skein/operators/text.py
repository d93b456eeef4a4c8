"""Segmentation and rule-based reading of text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.chapters import BOX_MARK, SCENE_MARK, SPEECH


def sentences(text: Column) -> Column:
    """Number of non-blank parts between sentence ends."""
    return F.size(F.filter(F.split(text, r"[.!?]+(\s|$)"), lambda s: F.trim(s) != ""))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def paragraph_kind(text: Column, heading: Column | None = None) -> Column:
    """header (where a heading's element says so), scene_break, blue_box, dialogue or narration, in this precedence."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    speech = t.rlike(f"^[{SPEECH}]") | (t.startswith('"') & ~t.startswith('""'))
    kind = F.when(t.rlike(SCENE_MARK), "scene_break").when(t.rlike(BOX_MARK), "blue_box").when(speech, "dialogue").otherwise("narration")
    return kind if heading is None else F.when(heading, "header").otherwise(kind)


def chapter_number(raw: Column) -> Column:
    """Digits, or number words one to twenty; prologue 0, epilogue 9999, anything else 0."""
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    known = F.create_map(*[F.lit(x) for i, w in enumerate(words, 1) for x in (w, i)], F.lit("epilogue"), F.lit(9999), F.lit("prologue"), F.lit(0))
    key = F.lower(F.trim(raw))
    return F.coalesce(F.when(key.rlike("^[0-9]+$"), key.try_cast("int")), known[key], F.lit(0))


def capitalised(text: Column) -> Column:
    """Distinct runs of a capital and two small letters or more, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]{2,})"), F.lit(1))))


def new_names(paragraphs: DataFrame, back: int = 3) -> DataFrame:
    """Per paragraph, how many capitalised names none of the `back` paragraphs before it holds."""
    w = W.partitionBy("doc_id").orderBy("position").rowsBetween(-back, -1)
    named = paragraphs.select("doc_id", "position", capitalised(F.col("text")).alias("names"))
    return named.select("doc_id", "position", F.size(F.array_except("names", F.flatten(F.collect_list("names").over(w)))).cast("long").alias("fresh"))


def routes(text: Column, passes: dict[str, tuple[str, int]], least: int) -> Column:
    """Passes whose keywords occur often enough; short texts take all. Comma-joined in the given order."""
    counted = [F.when(F.regexp_count(text, F.lit(p)) >= n, F.lit(name)) for name, (p, n) in passes.items()]
    return F.when(F.length(text) < least, ",".join(passes)).otherwise(F.concat_ws(",", *counted))


def name_is_bad(name: Column, pronouns: list[str]) -> Column:
    """Why a name is no entity, or null: pronoun, short, long, parenthetical, lower case."""
    return (
        F.when(F.lower(name).isin(pronouns), "pronoun").when(F.length(name) <= 1, "short").when(F.length(name) > 80, "long")
        .when(name.rlike(r"^\(.*\)$"), "parenthetical").when(name.rlike(r"^[a-z]+$"), "lower_case")
    )


def mentions(paragraphs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, position, term, hits): words of a small dictionary in paragraphs, by an equi-join on single words."""
    words = paragraphs.select("doc_id", "position", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("term"))
    return words.join(terms, "term").groupBy("doc_id", "position", "term").agg(F.count("*").alias("hits"))


def spans(paragraphs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, position, term, start, end): phrases, longest first, at word borders, not overlapping; terms are few."""
    import re

    ordered = sorted({t.lower() for t in terms if len(t) >= 2}, key=lambda t: (-len(t), t))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, ordered)) + r")(?!\w)", re.I) if ordered else None
        for f in frames:
            rows = [(d, p, m[0].lower(), m.start(), m.end()) for d, p, t in zip(f["doc_id"], f["position"], f["text"], strict=True) if pattern for m in pattern.finditer(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "position", "term", "start", "end"])

    return paragraphs.select("doc_id", "position", "text").mapInPandas(run, "doc_id long, position int, term string, start long, end long")


def grounded(claims: DataFrame) -> DataFrame:
    """claims: claim, start, text. Alignment and confidence of a quoted passage against its text."""
    at = F.substring("text", F.col("start") + 1, F.length("claim")) == F.col("claim")
    found = F.instr(F.col("text"), F.col("claim"))
    kind = F.when(at, "exact").when(found > 0, "fuzzy").otherwise("unaligned")
    sure = F.when(at, 1.0).when(found > 0, 0.7).otherwise(0.3)
    return claims.withColumn("alignment", kind).withColumn("confidence", sure).withColumn("found", F.when(at, F.col("start")).when(found > 0, found - 1).otherwise(-1).cast("long"))
