"""Operator 2 [native]: secret scans with an incremental ledger of content-addressed blobs.

Every version of every document is addressed by the SHA-256 of its text. The ledger holds, for each blob, which rules in
which version have read it and what they found; a scan reads only blobs with a (rule, version) pair that the ledger lacks,
each distinct blob once, and findings are joined back to every path that holds the blob.

Spark's regular expressions give no positions, so a text is both split at a rule's matches and asked for them; running sums
of the lengths of the parts between and of the matches are the offsets, in code points.

Defined results: null texts are empty blobs and have no spans; overlapping spans of different kinds all stay; equal texts
share one blob and each row gets its findings; rows with a null key are kept; extra columns are ignored; long texts are
scanned whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import keyed_text, shared_folder, table


@dataclass(frozen=True)
class Rule:
    """kind in spans; version, raised with each change of the pattern; group whose length has a least value."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules in their listed order. Runs of hexadecimal digits and of key letters are maximal either way, so their
#: least length stands in the pattern; a failing assignment still uses up its text, so its value is measured afterwards.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, rules array<string>, spans array<struct<start, rank, end, kind>>) for what ledger lacks.

    versions: (doc_id, text). A blob that no rule has still to read gives no row. Texts are dealt once, by blob, after equal
    texts have been joined in each input partition; offsets and spans are made where the blob already is.
    """
    blobs = versions.select(F.sha2("text", 256).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    tags = [f"{r.kind}@{r.version}" for r in rules]
    if ledger is None:
        blobs = blobs.withColumn("due", F.array(*map(F.lit, tags)))
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        due = F.array_except(F.array(*map(F.lit, tags)), F.coalesce("seen", F.array().cast("array<string>")))
        blobs = blobs.join(seen, "blob", "left").withColumn("due", due).where(F.size("due") > 0).drop("seen")

    def read(rule: Rule, tag: str, rank: int) -> Column:
        wanted = F.array_contains("due", tag) & F.col("text").rlike(rule.pattern)
        parts = F.transform(F.split("text", rule.pattern, -1), F.length)
        hits = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        values = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.least else hits
        one = F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), parts.alias("gap"), F.transform(hits, F.length).alias("hit"), F.transform(values, lambda v: F.length(v) >= rule.least).alias("good"))
        return F.when(wanted, one)

    found = blobs.select("blob", "due", F.filter(F.array(*(read(r, t, k) for k, (r, t) in enumerate(zip(rules, tags, strict=True)))), lambda x: x.isNotNull()).alias("kinds"))
    each = found.select("blob", "due", F.explode_outer("kinds").alias("k")).select(
        "blob", "due", F.col("k.rank").alias("rank"), F.col("k.kind").alias("kind"), F.posexplode_outer(F.arrays_zip("k.gap", "k.hit", "k.good")).alias("place", "x")
    )
    here = W.partitionBy("blob", "rank").orderBy("place")
    end = F.sum(F.col("x.gap") + F.coalesce("x.hit", F.lit(0))).over(here.rowsBetween(W.unboundedPreceding, 0))
    spans = each.withColumn("end", end).withColumn("span", F.when(F.col("x.good"), F.struct((F.col("end") - F.col("x.hit")).alias("start"), "rank", "end", "kind")))
    return spans.groupBy("blob").agg(F.first("due").alias("rules"), F.sort_array(F.collect_list("span")).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans) for every path, from all ledger rows, old and new; spans of rules in other versions are left out.

    A blob's rows are merged before the join; its copies may be a large share of all rows, so only found blobs join.
    """
    paths = versions.select("doc_id", F.sha2("text", 256).alias("blob"))
    tag = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, f"{r.kind}@{r.version}")))
    current = F.filter("spans", lambda s: F.coalesce(F.array_contains("rules", tag[s.kind]), F.lit(False)))
    rows = ledger.where(F.size("spans") > 0).select("blob", current.alias("spans")).where(F.size("spans") > 0)
    hits = rows.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return paths.join(hits, "blob", "left")


def extend(path: str, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at `path` lacks, append the new rows, and return the whole ledger. A missing path is an empty one.

    Rows are only ever added: a run that is lost and repeated adds the same findings again, which `findings` merges.
    """
    spark = versions.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
    scan(versions, rules, known).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans: even ids are a first set of versions, the rest a second one that meets the first one's ledger."""
    versions = keyed_text(table(spark, sf_dir, "documents"))
    path = f"{shared_folder(spark)}/skein-secrets-{uuid.uuid4().hex}"
    first = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    extend(path, versions.where(first))
    found = findings(versions, extend(path, versions.where(~first)))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)

    def joined(kinds: tuple[str, ...]) -> Column:
        kept = F.filter("spans", lambda s: s.kind.isin(*kinds)) if kinds else F.col("spans")
        return F.coalesce(F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ","), F.lit(""))

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("spans", lambda s: s.kind == kind)), F.lit(0)).cast("long")

    some = F.when(F.col("spans").isNull(), 0)
    base = ("assign", "access", "hex")
    return found.select("doc_id", *(some.otherwise(count(k)).cast("long").alias(f"n_{k}") for k in base), F.sha2(joined(base), 256).alias("base_sha256"), joined(()).alias("spans"))


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _oracle() -> str:
    one = """
      SELECT n, {rank} AS rank, '{kind}' AS kind, hits, gaps, vals FROM (
        SELECT n, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps,
               regexp_extract_all(text, '{pattern}', {group}) AS vals FROM d)"""
    kinds = (("assign", _ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))
    least = " ".join(f"WHEN '{k}' THEN {m}" for k, _, _, m in kinds)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
    m AS ({" UNION ALL ".join(one.format(rank=i, kind=k, pattern=p, group=g) for i, (k, p, g, _) in enumerate(kinds))}),
    e AS (SELECT n, rank, kind, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1:len(hits)]) AS gap FROM m WHERE len(hits) > 0),
    s AS (SELECT n, rank, kind, val, length(hit) AS size, sum(length(gap) + length(hit)) OVER (PARTITION BY n, rank ORDER BY i) AS stop FROM e),
    k AS (SELECT n, rank, kind, stop - size AS start, stop FROM s WHERE length(val) >= CASE kind {least} END),
    g AS (SELECT n, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
                 string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY start, rank) AS spans FROM k GROUP BY n)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (n)"""


ORACLE = _oracle()
