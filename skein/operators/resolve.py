"""Names: normal forms, exact and fuzzy duplicates, closure and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import with_normal_name
from skein.operators.components import connected_components
from skein.plans.storage import scratch


def exact(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with the first of its key as canonical: an aggregate and a join, so a key of many rows is no hot window."""
    first = rows.groupBy(key).agg(F.min(order).alias("canonical"), F.count("*").alias("size"))
    return rows.join(first, key).select(order, "canonical", "size")


def _bits(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * twice the longest common subsequence over both lengths."""
    return 100.0 * 2 * _bits(a, b) / (len(a) + len(b)) if a or b else 100.0


def part_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any part of the longer one of at most its length."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    m = len(a)
    return max(ratio(a, b[max(0, at) : at + m]) for at in range(1 - m, len(b)))


def _parts(name: str) -> list[str]:
    """Words of letters and digits in ASCII, lower case."""
    return "".join(c if c.isalnum() else " " for c in name.lower() if ord(c) < 128).split()


def sorted_ratio(a: str, b: str) -> float:
    x, y = _parts(a), _parts(b)
    return ratio(" ".join(sorted(x)), " ".join(sorted(y))) if x and y else 0.0


def set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words, and these with the rest of either name."""
    x, y = set(_parts(a)), set(_parts(b))
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 100.0
    first, second = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(ratio(first, second), *((ratio(both, first), ratio(both, second)) if both else (0.0,)))


def likeness(a: str, b: str) -> int:
    """The best of four ratios, 0 to 100."""
    return max(round(f(a, b)) for f in (ratio, part_ratio, sorted_ratio, set_ratio))


def shared_grams(least: int) -> float:
    """The part of the shorter name's length that pairs of at least this likeness share in pairs of characters (less one).

    Of a name of m characters, each word between two marks, an alignment at ratio r with w characters of the other leaves
    r (m + w) / 2 matched; what is not matched breaks two pairs, what is inserted one, and the ends of a part two more. The
    worst w is r m / (2 - r). Words are whole in the other two ratios, so their order breaks none.
    """
    r = (least - 0.5) / 100  # scores are rounded
    w = r / (2 - r)
    return 1 - ((2 - 1.5 * r) + (1 - 1.5 * r) * w)


def _grams(form: Column) -> Column:
    """Numbered pairs of neighbouring characters, each word between two marks: (pair, how often it stood before)."""
    words = F.filter(F.split(form, " "), lambda w: w != "")
    marked = F.transform(words, lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    pairs = F.flatten(F.transform(marked, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    return F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda h: h == g)).cast("string")))


def fuzzy_pairs(names: DataFrame, least: int = 85, group: str | None = None) -> DataFrame:
    """(a, b, score) of distinct normal names, a < b, whose best of four ratios is at least `least`; with a group column,
    (group, a, b, score) of names of one group.

    Candidates share a pair of characters among so many of the shorter name's rarest ones that none can be missed
    (`shared_grams`); names of one character meet the names that hold it. Candidates are then scored in full.
    """
    own = F.lit("") if group is None else F.col(group).cast("string")
    n = with_normal_name(names.select(own.alias("_g"), "name"), "name", "normal").select("_g", F.col("normal").alias("name")).where("name <> ''").distinct()
    forms = F.array_distinct(F.array(F.col("name"), F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " ")), F.trim(F.regexp_replace(F.regexp_replace(F.lower("name"), r"[^\x00-\x7f]", ""), "[^a-z0-9]+", " "))))
    form = n.select("_g", "name", F.explode(forms).alias("form")).where("form <> ''").withColumn("m", F.length("form"))
    grams = form.select("_g", "name", "form", "m", F.explode(_grams(F.col("form"))).alias("gram"))
    df = grams.groupBy("_g", "gram").agg(F.countDistinct("name").alias("df"))
    ranked = grams.join(df, ["_g", "gram"]).withColumn("place", F.row_number().over(W.partitionBy("_g", "name", "form").orderBy("df", "gram")))
    ranked = scratch(names.sparkSession, ranked, "grams")
    shares = F.greatest(F.lit(1), F.ceil(F.col("m") * shared_grams(least) - 1 - 1e-9)).cast("int")
    asking = ranked.where(F.col("place") <= F.col("m") + 1 - shares + 1).select("_g", F.col("name").alias("x"), F.col("m").alias("mx"), "gram")
    met = asking.join(ranked.select("_g", F.col("name").alias("y"), F.col("m").alias("my"), "gram"), ["_g", "gram"]).where("x <> y AND mx <= my")
    one = n.where(F.length("name") == 1).select("_g", F.col("name").alias("x"), F.col("name").alias("gram")).join(n.select("_g", F.col("name").alias("y"), F.explode(F.array_distinct(F.split("name", ""))).alias("gram")), ["_g", "gram"]).where("x <> y")
    pairs = met.select("_g", "x", "y").unionByName(one.select("_g", "x", "y")).select("_g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            left, right = b.column(1).to_pylist(), b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([likeness(x, y) for x, y in zip(left, right, strict=True)], pa.int32())], ["_g", "a", "b", "score"])

    out = pairs.mapInArrow(run, "_g string, a string, b string, score int").where(F.col("score") >= least)
    return out.drop("_g") if group is None else out.withColumnRenamed("_g", group)


def tiers(pairs: DataFrame, definite: int = 95) -> tuple[DataFrame, DataFrame]:
    """Merges (alias, canonical): definite pairs, the longer name counts, of equal lengths the first; and candidates for review."""
    first = F.length("a") >= F.length("b")
    sure = pairs.where(F.col("score") >= definite).select(*(c for c in pairs.columns if c not in ("a", "b", "score")), F.when(first, F.col("b")).otherwise(F.col("a")).alias("alias"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("canonical"))
    return sure, pairs.where(F.col("score") < definite)


def exact_aliases(rows: DataFrame) -> DataFrame:
    """(name, canonical): of names (name, ord) with one normal form the first by ord is canonical; names that are it are left out."""
    form = with_normal_name(rows.select("name", "ord"), "name", "normal")
    first = form.groupBy("normal").agg(F.min_by("name", "ord").alias("canonical"))
    return form.join(first, "normal").where("name <> canonical").select("name", "canonical").distinct()


def reviewed(pairs: DataFrame, merge: float = 0.7, escalate: float = 0.4, sure: float = 0.8) -> DataFrame:
    """Candidates with `fate` by a scorer's column `rank` (0 to 1): merge, escalate, drop; what is escalated is merged by the
    names' own score where the next tier has none to give."""
    fate = F.when(F.col("rank") > merge, "merge").when(F.col("rank") >= escalate, F.when(F.col("score") / 100 >= sure, "merge").otherwise("escalate")).otherwise("drop")
    return pairs.withColumn("fate", fate)


def dedup(rows: DataFrame, least: int = 85, definite: int = 95) -> DataFrame:
    """(entity_type, alias, canonical) in lower case of names (entity_type, name, ord), type by type: equal normal forms, then
    definite fuzzy pairs, then reviewed candidates, closed transitively. Canonical names are never aliases."""
    form = with_normal_name(rows.select("entity_type", "name", "ord"), "name", "normal")
    first = form.groupBy("entity_type", "normal").agg(F.min_by("name", "ord").alias("canonical"))
    sure, rest = tiers(fuzzy_pairs(rows.select("entity_type", "name"), least, "entity_type"), definite)
    merged = reviewed(rest.withColumn("rank", F.col("score") / 100)).where("fate = 'merge' AND rank >= 0.9").select("entity_type", F.col("a").alias("alias"), F.col("b").alias("canonical"))
    tag = lambda c: F.concat_ws("\u0001", "entity_type", c)
    closed = closure(sure.unionByName(merged).select(tag("alias").alias("a"), tag("canonical").alias("b")))
    roots = closed.select(F.element_at(F.split("name", "\u0001"), 1).alias("entity_type"), F.element_at(F.split("name", "\u0001"), 2).alias("normal"), F.element_at(F.split("canonical", "\u0001"), 2).alias("root"))
    known = form.join(roots, ["entity_type", "normal"], "left").withColumn("root", F.coalesce("root", "normal")).join(first.select("entity_type", F.col("normal").alias("root"), "canonical"), ["entity_type", "root"])
    out = known.select("entity_type", F.lower(F.trim("name")).alias("alias"), F.lower(F.trim("canonical")).alias("canonical")).where("alias <> canonical").distinct()
    return out


def per_chapter(new: DataFrame, existing: DataFrame, low: int = 90, high: int = 99) -> DataFrame:
    """(name, canonical): new names (name) with the best existing one (name) by shared words, from `low` to `high`.

    Candidates share a word, without which the ratio of the words' sets cannot be that high but for misspelt words, which
    `fuzzy_pairs` finds.
    """
    words = lambda df, out: df.select(F.col("name").alias(out), F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: w != ""))).alias("word"))
    met = words(new, "name").join(words(existing, "canonical"), "word").where("name <> canonical").select("name", "canonical").distinct()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([round(set_ratio(x, y)) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.int32())], ["name", "canonical", "score"])

    scored = met.mapInArrow(run, "name string, canonical string, score int").where(F.col("score").between(low, high))
    return scored.groupBy("name").agg(F.max_by("canonical", F.struct("score", "canonical")).alias("canonical"), F.max("score").alias("score"))


def closure(pairs: DataFrame) -> DataFrame:
    """(name, canonical) by connected components of merged pairs."""
    return connected_components(pairs).select(F.col("node").alias("name"), F.col("component").alias("canonical"))


def rename(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace a name by its canonical one; names without alias stay."""
    a = aliases.select(F.col("name").alias("_from"), F.col("canonical").alias("_to"))
    return rows.join(a, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def lookup(names: DataFrame, registry: DataFrame, least: int = 3) -> DataFrame:
    """Registry entry of a name: exact, else by alias, else by its normal form of at least `least` characters; registry:
    canonical, aliases array."""
    formed = with_normal_name(registry.select("canonical"), "canonical", "k")
    by_name = registry.select(F.lower(F.trim("canonical")).alias("k"), F.col("canonical").alias("c"), F.lit(1).alias("way"))
    by_alias = registry.select(F.explode("aliases").alias("k"), F.col("canonical").alias("c"), F.lit(2).alias("way")).withColumn("k", F.lower(F.trim("k")))
    by_form = formed.select("k", F.col("canonical").alias("c"), F.lit(3).alias("way")).where(F.length("k") >= least)
    ways = by_name.unionByName(by_alias).unionByName(by_form).groupBy("k", "way").agg(F.min("c").alias("c"))
    asked = with_normal_name(names.select("name").distinct(), "name", "form_of")
    keys = asked.select("name", F.explode(F.array(F.struct(F.lower(F.trim("name")).alias("k"), F.lit(False).alias("form")), F.struct(F.col("form_of").alias("k"), F.lit(True).alias("form")))).alias("x")).select("name", "x.*").where(~F.col("form") | (F.length("k") >= least))
    hit = keys.join(ways, "k").where("way < 3 OR form").groupBy("name").agg(F.min_by("c", F.struct("way", "c")).alias("canonical"))
    return names.select("name").distinct().join(hit, "name", "left")


def within_words(entries: DataFrame, order: list, words: str, budget: int) -> DataFrame:
    """Entries in order while their running words stay in a budget; stops for good at the first that does not fit."""
    w = W.partitionBy("book").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return entries.withColumn("used", F.sum(words).over(w)).where(F.col("used") <= budget)
