"""Keyed upserts: MERGE of typed entities and of their links, by a policy for each column.

A batch is reduced to a row a key in input order (`seq`) before it meets the state in one full outer join, so both sides join
one to one and a hot key is combined before the shuffle.

Policies: first (set on create), last (set on match too), longest (replaced by a strictly longer text), largest, union (of
arrays, in order of first occurrence), named (last value that is not empty, else the first), total (values add up), count.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _reduced(column: str, policy: str) -> Column:
    c, seq = F.col(column), F.col("seq")
    longer = F.struct(F.length(F.coalesce(c, F.lit(""))), -seq)
    # aliases of one key in order: (place in the input, place in the array)
    ordered = F.array_sort(F.flatten(F.collect_list(F.transform(c, lambda x, i: F.struct(seq.alias("s"), i.alias("i"), x.alias("x"))))) if policy == "union" else F.array())
    return {
        "first": lambda: F.min_by(c, seq), "last": lambda: F.max_by(c, seq), "longest": lambda: F.max_by(c, longer), "largest": lambda: F.max(c),
        "union": lambda: F.array_distinct(F.transform(ordered, lambda x: x.x)), "total": lambda: F.sum(c), "count": lambda: F.count("*"),
        "named": lambda: F.coalesce(F.max_by(c, F.when(c != "", seq)), F.min_by(c, seq)),
    }[policy]().alias(column)


def _merged(column: str, policy: str) -> Column:
    old, new = F.col(f"o.{column}"), F.col(f"n.{column}")
    known = F.col("o._there").isNotNull()
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<string>")
    return {
        "first": lambda: F.when(known, old).otherwise(new), "last": lambda: F.when(F.col("n._there").isNotNull(), new).otherwise(old),
        "longest": lambda: F.when(~known | (size(new) > size(old)), new).otherwise(old), "largest": lambda: F.greatest(old, new),
        "union": lambda: F.array_union(F.coalesce(old, none), F.coalesce(new, none)),
        "total": lambda: F.coalesce(old + new, old, new), "count": lambda: F.coalesce(old + new, old, new),
        "named": lambda: F.when(~known | (F.coalesce(new, F.lit("")) != ""), new).otherwise(old),
    }[policy]().alias(column)


def reduced(rows: DataFrame, key: list[str], policies: dict[str, str]) -> DataFrame:
    """One row a key of a batch with the column `seq`."""
    return rows.groupBy(*key).agg(*(_reduced(c, p) for c, p in policies.items()))


def merge(state: DataFrame | None, batch: DataFrame, key: list[str], policies: dict[str, str]) -> DataFrame:
    """The state after a batch; null keys name no entity and are left out."""
    for k in key:
        batch = batch.where(F.col(k).isNotNull())
    new = reduced(batch, key, policies)
    if state is None:
        return new
    o, n = state.withColumn("_there", F.lit(1)).alias("o"), new.withColumn("_there", F.lit(1)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    return o.join(n, on, "full_outer").select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in key), *(_merged(c, p) for c, p in policies.items()))


#: The key of each entity type beside its book, and what an upsert does with each column.
ENTITIES: dict[str, tuple[list[str], dict[str, str]]] = {
    "Character": (["name"], {"aliases": "union", "description": "longest", "confidence": "largest", "chapter": "first"}),
    "Skill": (["name"], {"description": "longest", "rank": "named", "confidence": "first"}),
    "Class": (["name"], {"description": "first", "rank": "first"}),
    "Title": (["name"], {"description": "first", "rank": "first"}),
    "Event": (["name", "chapter"], {"description": "first", "kind": "first", "confidence": "first"}),
    "Location": (["name"], {"description": "longest", "kind": "first", "confidence": "largest"}),
    "Object": (["name"], {"description": "first", "kind": "first", "rank": "first", "confidence": "first"}),
    "Creature": (["name"], {"description": "first", "kind": "first", "confidence": "first"}),
    "Faction": (["name"], {"description": "first", "kind": "first", "confidence": "first"}),
    "Concept": (["name"], {"description": "longest", "kind": "first", "confidence": "largest"}),
    "BlueBox": (["chapter", "place"], {"description": "last", "kind": "last"}),
    "StatBlock": (["owner", "chapter"], {"description": "last", "value": "last"}),
    "QuestObjective": (["name"], {"description": "first", "rank": "last", "owner": "first", "chapter": "first"}),
    "Achievement": (["name"], {"description": "longest", "rank": "first"}),
    "Bloodline": (["name"], {"description": "longest", "kind": "first"}),
    "Profession": (["name"], {"description": "longest", "rank": "named"}),
    "Church": (["name"], {"description": "longest", "kind": "first"}),
    "NarrativeSequence": (["name"], {"description": "longest", "kind": "first", "chapter": "first"}),
    "Prophecy": (["name"], {"description": "longest", "rank": "first", "chapter": "first"}),
    "Setting": (["name"], {"description": "longest", "kind": "first"}),
    "CharacterFeature": (["owner", "kind", "name"], {"description": "longest", "chapter": "first"}),
    "NarrativeRole": (["owner", "kind"], {"description": "longest", "chapter": "first"}),
    "TextualFeature": (["kind", "chapter"], {"description": "last", "value": "last"}),
    "NarrativeUnit": (["name", "chapter"], {"description": "first"}),
    "PsychologicalState": (["owner", "name", "chapter"], {"description": "longest", "confidence": "first"}),
    "Summary": (["name"], {"description": "last"}),
    "Community": (["name"], {"description": "last", "rank": "last", "value": "last"}),
    "Book": (["name"], {"description": "first", "rank": "last"}),
    "Chapter": (["chapter"], {"name": "last", "value": "last"}),
}

#: Links of an upsert by relation: from, to, and what is kept of the chapter and the value.
LINKS: dict[str, tuple[str, str, dict[str, str]]] = {
    "MENTIONED_IN": ("name", "chapter", {}),
    "HAS_TITLE": ("owner", "name", {"chapter": "first"}),
    "PARTICIPATES_IN": ("owner", "name", {}),
    "OCCURS_AT": ("name", "place", {}),
    "LOCATION_PART_OF": ("name", "kind", {}),
    "POSSESSES": ("owner", "name", {"chapter": "first"}),
    "HAS_STAT": ("owner", "name", {"value": "total", "chapter": "first"}),
    "HAS_STAT_BLOCK": ("owner", "chapter", {}),
    "GIVES_QUEST": ("owner", "name", {}),
    "EARNED": ("owner", "name", {"chapter": "first"}),
    "HAS_BLOODLINE": ("owner", "name", {"chapter": "first"}),
    "HAS_STATE": ("owner", "name", {"chapter": "first"}),
}


def merge_links(state: DataFrame | None, batch: DataFrame, rel: str) -> DataFrame:
    """book, src, rel, dst and the kept columns (seq where none is); rows with an empty end make no link."""
    src, dst, policies = LINKS[rel]
    ends = batch.select("book", F.col(src).cast("string").alias("src"), F.lit(rel).alias("rel"), F.col(dst).cast("string").alias("dst"), "seq", *policies)
    return merge(state, ends.where((F.col("src") != "") & (F.col("dst") != "")), ["book", "src", "rel", "dst"], policies or {"seq": "first"})


def relations(rows: DataFrame, most_long: int = 30, most_marks: int = 4) -> DataFrame:
    """(book, src, rel, dst): first chapter as valid_from, chapter of the last later occurrence, occurrences.

    A type of more than `most_long` characters or `most_marks` underscores is no relation and goes.
    """
    fit = rows.where((F.length("rel") <= most_long) & (F.length("rel") - F.length(F.replace("rel", F.lit("_"), F.lit(""))) <= most_marks))
    out = fit.groupBy("book", "src", "rel", "dst").agg(F.min_by("chapter", "seq").alias("valid_from"), F.max_by("chapter", "seq").alias("last_seen"), F.count("*").alias("occurrences"))
    return out.withColumn("last_seen", F.when(F.col("occurrences") > 1, F.col("last_seen")))


def skill_intervals(rows: DataFrame) -> DataFrame:
    """(book, owner, name, rank, valid_from, valid_to): the first encounter opens an interval without a rank; each later
    chapter with a rank closes the open one the chapter before and opens another."""
    key = ["book", "owner", "name"]
    first = W.partitionBy(*key).orderBy("chapter", "seq")
    met = rows.where("owner <> ''").withColumn("nth", F.row_number().over(first)).withColumn("start", F.min("chapter").over(W.partitionBy(*key)))
    opened = met.where((F.col("nth") == 1) | ((F.col("rank") != "") & (F.col("chapter") > F.col("start"))))
    once = opened.groupBy(*key, F.col("chapter").alias("valid_from")).agg(F.min_by(F.when(F.col("nth") > 1, F.col("rank")), "seq").alias("rank"))
    return once.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy(*key).orderBy("valid_from")) - 1).select(*key, "rank", "valid_from", "valid_to")


def class_intervals(rows: DataFrame) -> DataFrame:
    """(book, owner, name, valid_from, valid_to): a class holds until the chapter before its owner shows another one.

    A class that has been closed does not open again. A chapter with several classes ends each of the earlier ones.
    """
    who = ["book", "owner"]
    named = rows.where("owner <> ''")
    chapters = named.groupBy(*who, "chapter").agg(F.when(F.countDistinct("name") == 1, F.min("name")).alias("only"))
    order = W.partitionBy(*who).orderBy("chapter")
    turned = chapters.withColumn("turn", F.when(F.col("only").isNull() | ~F.col("only").eqNullSafe(F.lag("only").over(order)), 1).otherwise(0)).withColumn("run", F.sum("turn").over(order))
    runs = turned.groupBy(*who, "run").agg(F.min("chapter").alias("first")).withColumn("other", F.lead("first").over(W.partitionBy(*who).orderBy("run")))
    marked = turned.join(runs, [*who, "run"]).select(*who, "chapter", F.struct(F.lead("chapter").over(order).alias("chapter"), F.lead("only").over(order).alias("only"), F.lead("other").over(order).alias("other")).alias("next"))
    held = named.groupBy(*who, "name").agg(F.min("chapter").alias("chapter"))
    end = F.when(F.col("next.only").eqNullSafe(F.col("name")), F.col("next.other")).otherwise(F.col("next.chapter"))
    return held.join(marked, [*who, "chapter"]).select(*who, "name", F.col("chapter").alias("valid_from"), (end - 1).alias("valid_to"))


def level_intervals(changes: DataFrame) -> DataFrame:
    """(book, owner, level, valid_from, valid_to): a level holds until the chapter before the first later change to a higher one.

    changes: book, owner, level, chapter, seq. A character's changes are read backwards in one sorted stream that holds only the
    levels that are still to be met, so memory does not follow their number.
    """

    def run(batches: Iterator):
        import pyarrow as pa

        here, stack = None, []  # (level, chapter) of later changes, ever higher
        for b in batches:
            ends = []
            for book, owner, level, chapter in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if (book, owner) != here:
                    here, stack = (book, owner), []
                while stack and stack[-1][0] <= level:
                    stack.pop()
                ends.append(stack[-1][1] - 1 if stack else None)
                stack.append((level, chapter))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(ends, pa.int32())], ["book", "owner", "level", "valid_from", "seq", "valid_to"])

    rows = changes.where("owner <> '' AND level IS NOT NULL").select(F.col("book").cast("long"), "owner", F.col("level").cast("long").alias("level"), F.col("chapter").cast("int").alias("chapter"), F.col("seq").cast("long"))
    dealt = rows.repartition("book", "owner").sortWithinPartitions("book", "owner", F.desc("chapter"), F.desc("seq"))
    found = dealt.mapInArrow(run, "book long, owner string, level long, valid_from int, seq long, valid_to int")
    return found.groupBy("book", "owner", "level", "valid_from").agg(F.min_by("valid_to", "seq").alias("valid_to"))


def level_ledger(changes: DataFrame) -> DataFrame:
    """(book, owner, chapter, name, action, value_delta, value_after): a row a level change, last wins a chapter; delta only if
    the old level is known."""
    rows = changes.where("owner <> ''").select("book", "owner", "chapter", F.lit("level").alias("name"), F.lit("gain").alias("action"), F.when((F.col("old") != 0) & (F.col("level") != 0), F.col("level") - F.col("old")).alias("value_delta"), F.col("level").alias("value_after"), "seq")
    return rows.groupBy("book", "owner", "chapter", "name", "action").agg(F.max_by("value_delta", "seq").alias("value_delta"), F.max_by("value_after", "seq").alias("value_after"))


def mentions_store(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each occurrence, never merged, its text cut to 200 characters; and of each (book, chapter) the count and a JSON summary."""
    edges = rows.select("book", "chapter", "entity_type", "entity", "start", "end", F.left("text", F.lit(200)).alias("mention_text"))
    row = F.struct("start", "end", "entity_type", "entity")
    summary = rows.groupBy("book", "chapter").agg(F.count("*").alias("mention_count"), F.to_json(F.array_sort(F.collect_list(row))).alias("mention_data"))
    return edges, summary


def sequence_chain(rows: DataFrame) -> DataFrame:
    """(book, sequence, src, dst): consecutive events of each sequence in order of first chapter and name."""
    events = rows.groupBy("book", "sequence", "name").agg(F.min("chapter").alias("chapter"))
    order = W.partitionBy("book", "sequence").orderBy("chapter", "name")
    return events.withColumn("dst", F.lead("name").over(order)).where("dst IS NOT NULL").select("book", "sequence", F.col("name").alias("src"), "dst")


def grants(rows: DataFrame, at_least: float = 0.7) -> DataFrame:
    """(book, src, label, dst): skills granted by a named source of a known type with enough confidence, once each."""
    label = {"item": "Object", "object": "Object", "class": "Class", "bloodline": "Bloodline"}
    kinds = F.create_map(*(F.lit(x) for pair in label.items() for x in pair))
    fit = rows.where((F.col("confidence") >= at_least) & F.col("source_type").isin(*label) & (F.col("source") != ""))
    return fit.select("book", F.col("source").alias("src"), kinds[F.col("source_type")].alias("label"), F.col("skill").alias("dst")).distinct()


def social_relations(rows: DataFrame) -> DataFrame:
    """Hyper-edges: (book, node, rel, participant); a relation of two participants or more is a node with a link a participant.

    rows: book, name, participants array, cause. The cause, if any, is linked as CAUSED_BY.
    """
    who = F.array_distinct(F.filter("participants", lambda p: p != ""))
    fit = rows.withColumn("who", who).where(F.size("who") >= 2)
    linked = fit.select("book", F.col("name").alias("node"), F.lit("INVOLVED_IN").alias("rel"), F.explode("who").alias("participant"))
    return linked.unionByName(fit.where("cause <> ''").select("book", F.col("name").alias("node"), F.lit("CAUSED_BY").alias("rel"), F.col("cause").alias("participant"))).distinct()


def shared_characters(rows: DataFrame) -> DataFrame:
    """(name, book): characters of a series that stand in more than one of its books, linked to one common node."""
    known = rows.select("name", "book").distinct()
    several = known.groupBy("name").agg(F.count("*").alias("books")).where("books > 1")
    return known.join(several, "name")


def labelled(rows: DataFrame, labels: dict[str, str], default: str) -> DataFrame:
    """Adds the label of an entity by its sub type; unknown ones are of the default label."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return rows.withColumn("label", F.coalesce(known[F.lower(F.trim("sub_type"))], F.lit(default)))


def patched(rows: DataFrame, patches: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """rows with the given values of allowed columns; other columns of a patch are ignored, and so are nulls."""
    cols = [c for c in allowed if c in patches.columns]
    p = patches.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in cols))
    joined = rows.join(p, F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in rows.columns))


def detached(nodes: DataFrame, edges: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that are left when nodes are deleted with their edges."""
    return nodes.where(~F.col("id").isin(ids)), edges.where(~F.col("src").isin(ids) & ~F.col("dst").isin(ids))
