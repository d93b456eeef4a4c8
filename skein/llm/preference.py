"""Operator 4 [native]: preference formatting of chosen and rejected conversations.

The longest common turn prefix of the two conversations of a pair is rendered once as the prompt; what follows in either
becomes a completion, with a mask that trains on the assistant's words only. A turn is rendered as
`<|role|>` newline, text, `<|end|>` newline; `<|` inside a text becomes `< |`, so that no text can pass for markup.

A mask is the row of segments of a completion, `length:flag` in code points, joined by commas: a turn's header is never
trained, its text with the end mark is if the role is assistant. The lengths of a mask add up to the completion.

`conversations` holds no verdicts. The registered query makes a pair of each conversation: chosen as it is, and rejected with
its last answer replaced by the last answer of its neighbour (2k and 2k + 1 are neighbours), so that a pair shares all turns
before. `formatted` itself takes any pairs.

Defined results: turns go by turn, then role, then text, repeated rows stay; a null role is `unknown`, a null text empty, a
null turn comes first; rows without conversation are in no pair; without a neighbour, or one that answers, nothing replaces
the answer; a conversation without an answer gets the neighbour's at its end; a pair of one side has an empty other one; of equal conversations all turns are prompt and both completions are empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table

END = "<|end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn.role, F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn.text, F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.length(_header(t)).cast("string"), F.lit(":0,"), F.length(_body(t)).cast("string"), F.when(t.role == "assistant", ":1").otherwise(":0"))), ",")


def _row() -> Column:
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "<\\|", "< |")
    return F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), clean.alias("text"), "conv_id")


def rendered(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen_id, rejected_id, a and b, the ordered turns of both sides. Prompt, completions and masks."""
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x.role == y.role) & (x.text == y.text), F.lit(False)))
    first_other = F.array_position(same, False)
    shared = pairs.withColumn("n", F.when(first_other > 0, first_other - 1).otherwise(F.greatest(F.size("a"), F.size("b"))).cast("int"))

    def after(side: str) -> Column:
        return F.when(F.col("n") >= F.size(side), F.slice(side, 1, 0)).otherwise(F.slice(F.col(side), F.col("n") + 1, F.size(side)))

    cut = shared.select("pair_id", "n", "chosen_id", "rejected_id", F.slice(F.col("a"), F.lit(1), F.col("n")).alias("p"), after("a").alias("a"), after("b").alias("b"))
    return cut.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("prompt_turns"), _render(F.col("p")).alias("prompt"),
        _render(F.col("a")).alias("chosen"), _mask(F.col("a")).alias("chosen_mask"), _render(F.col("b")).alias("rejected"), _mask(F.col("b")).alias("rejected_mask"),
    )


def formatted(turns: DataFrame) -> DataFrame:
    """turns: pair_id, chosen boolean, conv_id, turn, role, text. One row a pair; one shuffle, by pair."""
    pairs = turns.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("chosen", _row().alias("t")))).alias("all"))
    side = lambda wanted: F.transform(F.filter("all", lambda x: x.chosen == wanted), lambda x: x.t)
    sides = pairs.select("pair_id", side(True).alias("a"), side(False).alias("b"))
    first = lambda s: F.get(s, F.lit(0)).getField("conv_id")
    return rendered(sides.select("pair_id", first("a").alias("chosen_id"), first("b").alias("rejected_id"), "a", "b"))


def answered(turns: DataFrame) -> DataFrame:
    """Pairs of each conversation with itself under its neighbour's last answer; one shuffle, by neighbours."""
    both = turns.where("conv_id IS NOT NULL").withColumn("conv_id", F.col("conv_id").cast("long")).groupBy(F.floor(F.col("conv_id") / 2).alias("k")).agg(F.sort_array(F.collect_list(_row())).alias("all"))
    side = lambda r: F.filter("all", lambda t: F.pmod(t.conv_id, F.lit(2)) == r)
    sides = both.select(side(0).alias("x"), side(1).alias("y")).select(F.explode(F.array(F.struct(F.col("x").alias("own"), F.col("y").alias("other")), F.struct(F.col("y").alias("own"), F.col("x").alias("other")))).alias("s")).select("s.*").where(F.size("own") > 0)
    answers = F.filter("other", lambda t: t.role == "assistant")
    before = F.size("own") - F.array_position(F.reverse(F.transform("own", lambda t: t.role == "assistant")), True).cast("int")
    cut = sides.withColumn("reply", F.slice(answers, F.greatest(F.size(answers), F.lit(1)), F.lit(1))).withColumn("b", F.concat(F.slice("own", F.lit(1), before), "reply"))
    own = F.get("own", F.lit(0)).getField("conv_id")
    return cut.select(own.alias("pair_id"), own.alias("chosen_id"), F.get("reply", F.lit(0)).getField("conv_id").alias("rejected_id"), F.col("own").alias("a"), "b")


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and the same with its neighbour's last answer."""
    return rendered(answered(table(spark, sf_dir, "conversations")))


_SIDE = "list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) FILTER (conv_id % 2 = {side})"
_SHOWN = "array_to_string(list_transform({x}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '')"
_MASKED = "array_to_string(list_transform({x}, lambda t: CAST(length(t.role) + 5 AS VARCHAR) || ':0,' || CAST(length(t.text) + 8 AS VARCHAR) || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END), ',')"
ORACLE = f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
    g AS (SELECT min(conv_id) FILTER (conv_id % 2 = 0) AS i, min(conv_id) FILTER (conv_id % 2 = 1) AS j,
                 coalesce({_SIDE.format(side=0)}, []) AS x, coalesce({_SIDE.format(side=1)}, []) AS y FROM c GROUP BY conv_id // 2),
    h AS (SELECT i AS own, j AS other, x AS a, list_filter(y, lambda t: t.role = 'assistant') AS z FROM g UNION ALL SELECT j, i, y, list_filter(x, lambda t: t.role = 'assistant') FROM g),
    r AS (SELECT own, CASE WHEN len(z) > 0 THEN other END AS other, a, a[1:coalesce(list_max(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant')) - 1, len(a))] || z[len(z):len(z)] AS b FROM h WHERE len(a) > 0),
    n AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: i > len(a) OR i > len(b) OR a[i] <> b[i])) - 1, len(a)) AS k FROM r),
    s AS (SELECT own, other, k, a[1:k] AS p, a[k + 1:] AS x, b[k + 1:] AS y FROM n)
    SELECT own AS pair_id, own AS chosen_id, other AS rejected_id, k AS prompt_turns, {_SHOWN.format(x="p")} AS prompt, {_SHOWN.format(x="x")} AS chosen,
           {_MASKED.format(x="x")} AS chosen_mask, {_SHOWN.format(x="y")} AS rejected, {_MASKED.format(x="y")} AS rejected_mask
    FROM s"""
