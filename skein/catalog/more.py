"""The tiers of deduplication together, the registry, writers, listings and the rest of the small surface."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein import sources as S
from skein.catalog.registered import query
from skein.catalog.texts import PARTS, SAID, told
from skein.catalog.upserts import X, extraction
from skein.operators import chapters as C
from skein.operators import facts as K
from skein.operators import graph as G
from skein.operators import reads as R
from skein.operators import resolve as N
from skein.plans.storage import shared_folder
from skein.sources import store


def _variants(spark, d):
    """Part names with articles, reordered words and misspelt ones, under two types."""
    p = S.read(spark, d, "part")
    m = F.col("p_partkey") % 5
    words = F.split("p_name", " ")
    name = F.when(m == 0, F.concat(F.lit("The "), "p_name")).when(m == 1, F.array_join(F.reverse(words), " ")).when(m == 2, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name"))
    return p.select(F.when(F.col("p_partkey") % 2 == 0, "item").otherwise("place").alias("entity_type"), name.alias("name"), F.col("p_partkey").alias("ord"))


@query()
def dedup_pipeline(spark, d):
    """Exact, fuzzy and reviewed tiers of each type; alias to canonical in lower case. A test holds the tiers."""
    return N.dedup(_variants(spark, d))


@query()
def chapter_dedup(spark, d):
    """Names of the second half of the parts against those of the first, as a chapter's against the registry."""
    v = _variants(spark, d)
    return N.per_chapter(v.where("ord % 2 = 1").select("name").distinct(), v.where("ord % 2 = 0").select("name").distinct())


@query("SELECT p_name AS name, min(p_partkey) AS canonical FROM part GROUP BY 1 HAVING count(*) > 1")
def exact_alias_map(spark, d):
    """Names under one normal form, and the part that has it first."""
    p = S.read(spark, d, "part").select(F.concat(F.lit("The "), "p_name", F.lit(" #"), "p_partkey").alias("name"), F.col("p_partkey").alias("ord"), "p_name")
    firsts = N.exact_aliases(p.select(F.col("p_name").alias("name"), "ord"))
    repeated = p.groupBy("p_name").agg(F.min("ord").alias("canonical"), F.count("*").alias("n")).where("n > 1")
    return repeated.join(firsts, repeated["p_name"] == firsts["name"], "left_anti").select(F.col("p_name").alias("name"), "canonical")


@query("SELECT book, name, used FROM (SELECT s_nationkey AS book, s_name AS name, CAST(sum(3) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM supplier) WHERE used <= 9")
def registry_context(spark, d):
    """Entries of the registry in order while their words stay in a budget."""
    s = S.read(spark, d, "supplier").select(F.col("s_nationkey").alias("book"), F.col("s_name").alias("name"), "s_acctbal", "s_suppkey", F.lit(3).alias("words"))
    return N.within_words(s, [F.desc("s_acctbal"), "s_suppkey"], "words", 9).select("book", "name", "used")


@query(f"WITH {PARTS}, c AS (SELECT book, count(DISTINCT chapter) AS chapters, count(*) AS chunks, count(*) FILTER (sort <= 4) AS regex_matches FROM p GROUP BY 1) SELECT * FROM c")
def ingest_counts(spark, d):
    t = told(spark, d)
    chapters = t.groupBy("book").agg(F.count("*").alias("chapters"))
    chunks = C.read_each(t, "text", lambda x: [(i,) for i, _ in enumerate(C.paragraphs(x))], "position int", ["book", "chapter"]).groupBy("book").agg(F.count("*").alias("chunks"))
    matches = K.extracted(t, ["book", "chapter"]).groupBy("book").agg(F.count("*").alias("regex_matches"))
    return chapters.join(chunks, "book").join(matches, "book")


@query(f"WITH {PARTS} SELECT book, chapter, count(*) AS regex_matches FROM p WHERE sort <= 4 GROUP BY ALL")
def regex_match_store(spark, d):
    """Matches written by book, read back, as one JSON row a chapter."""
    path = f"{shared_folder(spark)}/skein-matches-{uuid.uuid4().hex}"
    store.replace_books(store.matches_json(K.extracted(told(spark, d), ["book", "chapter"]), ["book", "chapter"]), path)
    rows = spark.read.parquet(path)
    ok = F.size(F.from_json("regex_json", "array<struct<pattern: string, start: int>>")) == F.col("regex_matches")
    return rows.where(ok).select(F.col("book").cast("long").alias("book"), "chapter", "regex_matches")


@query(f"WITH {PARTS} SELECT book, book || '-ch' || chapter AS id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM p WHERE book = 0 GROUP BY book, chapter UNION ALL SELECT book, book || '-ch' || chapter, 'again' FROM p WHERE book = 1 GROUP BY book, chapter")
def chapter_store(spark, d):
    """Chapters written by book; a book that is written again replaces its own partition only."""
    path = f"{shared_folder(spark)}/skein-chapters-{uuid.uuid4().hex}"
    t = told(spark, d).withColumn("id", store.chapter_id(F.col("book"), F.col("chapter")))
    store.replace_books(t, path)
    store.replace_books(t.where("book = 1").withColumn("text", F.lit("again")), path)
    return spark.read.parquet(path).select(F.col("book").cast("long").alias("book"), "id", "text")


@query("SELECT c_custkey AS id, left(c_name, 6) AS shown, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END AS rating FROM customer WHERE c_custkey % 3 <> 0")
def feedback_rows(spark, d):
    """Ratings of one or minus one, with the payload cut."""
    c = S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.left("c_name", F.lit(6)).alias("shown"), F.when(F.col("c_custkey") % 3 == 0, 5).when(F.col("c_custkey") % 2 == 0, 1).otherwise(-1).alias("rating"))
    return store.feedback(c)


@query(f"WITH {X} SELECT chapter, count(*) AS total, count(*) FILTER (kind = 'click') AS skills, count(DISTINCT name) AS names FROM x GROUP BY 1")
def extraction_totals(spark, d):
    x = extraction(spark, d)
    return x.groupBy("chapter").agg(F.count("*").alias("total"), F.count(F.when(F.col("kind") == "click", 1)).alias("skills"), F.countDistinct("name").alias("names"))


@query("SELECT n_name AS project, count(DISTINCT c_custkey) AS files, CAST(coalesce(sum(o), 0) AS BIGINT) AS books FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def project_stats(spark, d):
    """Files of a project and books of its files, each branch aggregated before it is joined."""
    n, c, o = (S.read(spark, d, t) for t in ("nation", "customer", "orders"))
    books = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("books"))
    files = c.join(books, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("files"), F.coalesce(F.sum("books"), F.lit(0)).alias("books"))
    return n.join(files, "n_nationkey", "left").select(F.col("n_name").alias("project"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("books", F.lit(0)).alias("books"))


@query("SELECT r_name AS type, string_agg(n_name, ',' ORDER BY n_name) AS allowed, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def ontology_enums(spark, d):
    """Allowed values of each type, as the ontology's JSON schema lists them."""
    n, r = S.read(spark, d, "nation"), S.read(spark, d, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("type")).agg(F.array_sort(F.collect_set("n_name")).alias("enum"))
    schema = F.to_json(F.struct("type", "enum"))
    back = rows.select(F.from_json(schema, "type string, enum array<string>").alias("s")).select("s.*")
    return back.select("type", F.array_join("enum", ",").alias("allowed"), F.size("enum").cast("long").alias("n"))


@query(f"WITH {PARTS}, a AS (SELECT DISTINCT book, chapter FROM p WHERE sort = 4 AND contains(text, '+7 Strength')) SELECT book, chapter, count(*) AS regex_matches FROM p JOIN a USING (book, chapter) WHERE sort <= 4 GROUP BY ALL")
def selective_reextraction(spark, d):
    """Only chapters that a new pattern touches are extracted again."""
    touched = K.impact(told(spark, d), [r"^\+7\s+strength$"])
    return K.extracted(touched, ["book", "chapter"]).groupBy("book", "chapter").agg(F.count("*").alias("regex_matches"))


@query(f"WITH {X}, s AS (SELECT book, chapter, seq, {SAID} AS text FROM x) SELECT book, chapter, CAST(sum(len(regexp_split_to_array(trim(text), '\\s+'))) AS BIGINT) AS words, count(*) AS paragraphs FROM s GROUP BY ALL")
def chapter_words(spark, d):
    rows = C.read_each(told(spark, d), "text", lambda t: [(len(p.split()),) for p, _, _ in C.paragraphs(t)], "words int", ["book", "chapter"])
    return rows.groupBy("book", "chapter").agg(F.sum("words").alias("words"), F.count("*").alias("paragraphs"))


@query()
def rule_extraction(spark, d):
    """Entities of the default extractor; a test holds it by hand."""
    from skein.plugins import extracted

    return extracted(told(spark, d), ["book", "chapter"])


@query()
def scored_candidates(spark, d):
    """Fuzzy candidates under a plugged-in scorer and what becomes of each; a test holds the thresholds."""
    from skein.plugins import scored

    pairs = N.tiers(N.fuzzy_pairs(_variants(spark, d).select("name"), 85))[1]
    return N.reviewed(scored(pairs, lambda x, y: [N.set_ratio(a, b) / 100 for a, b in zip(x, y, strict=True)]))


@query()
def communities(spark, d):
    """Communities at three resolutions of nations that trade, by local moves that raise modularity; a test holds the objective."""
    o, li = S.read(spark, d, "orders").select("o_custkey", "o_orderkey"), S.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    c, s = S.read(spark, d, "customer").select("c_custkey", "c_nationkey"), S.read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    met = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    from skein.plans.storage import scratch

    pairs = scratch(spark, met.select(F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b")), "trade")
    out = None
    for level, resolution in enumerate((1.0, 0.5, 0.1)):
        one = G.named_communities(G.communities(pairs, resolution), "trade", level).withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT n_nationkey AS id, 'Community of ' || n_name || ' and others (3 members)' AS summary FROM nation")
def community_summaries(spark, d):
    """The template that stands in for a model: the first name and the number of members."""
    n = S.read(spark, d, "nation")
    return R.template_summary(n.select(F.col("n_nationkey").alias("id"), F.array("n_name", F.lit("others"), F.lit("more")).alias("names")), 2)


@query("""WITH c AS (SELECT n_regionkey AS version, CASE n_nationkey % 5 WHEN 0 THEN 'add_entity_type' WHEN 1 THEN 'add_regex' WHEN 2 THEN 'add_property' WHEN 3 THEN 'add_relationship' ELSE 'rename' END AS kind, CASE n_nationkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'genre' ELSE 'series' END AS layer, n_name AS target FROM nation),
    p AS (SELECT *, CASE kind WHEN 'add_entity_type' THEN CASE layer WHEN 'core' THEN '1' WHEN 'genre' THEN '2' ELSE '3' END WHEN 'add_regex' THEN '0' WHEN 'add_property' THEN '4' WHEN 'add_relationship' THEN '4' END AS phase FROM c)
    SELECT version, coalesce(string_agg(DISTINCT phase, ',' ORDER BY phase), '') AS phases, coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (kind IN ('add_entity_type', 'add_property')), '') AS types, count(*) FILTER (kind = 'add_regex') AS new_patterns FROM p GROUP BY 1""")
def impact_scope(spark, d):
    n = S.read(spark, d, "nation")
    pick = lambda m, *v: F.element_at(F.array(*map(F.lit, v)), F.col("n_nationkey") % m + 1)
    changes = n.select(F.col("n_regionkey").alias("version"), pick(5, "add_entity_type", "add_regex", "add_property", "add_relationship", "rename").alias("change_type"), pick(3, "core", "genre", "series").alias("layer"), F.col("n_name").alias("target"))
    return K.impact_scope(changes)


@query("""SELECT c_custkey, CAST(c_custkey % 40 + 1 AS INT) AS number, c_name AS title, 0 AS place, CAST(length('Chapter ' || (c_custkey % 40 + 1) || ': ' || c_name || chr(10) || repeat('word ', 120)) - 1 AS INT) AS size FROM customer
    UNION ALL SELECT c_custkey, 9999, '', 1, CAST(length('Chapter epilogue' || chr(10) || repeat('more ', 130)) - 1 AS INT) FROM customer""")
def split_chapters(spark, d):
    """Books of two headed chapters and a part that is too short to be one."""
    c = S.read(spark, d, "customer")
    one = F.concat(F.lit("Chapter "), F.col("c_custkey") % 40 + 1, F.lit(": "), "c_name", F.lit("\n"), F.repeat(F.lit("word "), F.lit(120)))
    text = F.concat(one, F.lit("\nChapter epilogue\n"), F.repeat(F.lit("more "), F.lit(130)), F.lit("\n7. Note\nshort"))
    read = lambda t: [(n, title, place, len(x)) for place, (n, title, x, _) in enumerate(C.chapters(t))]
    return C.read_each(c.select("c_custkey", text.alias("text")), "text", read, "number int, title string, place int, size int", ["c_custkey"])


@query("SELECT n_nationkey, 'Chapter ' || (n_nationkey + 1) AS title, CAST(n_nationkey + 1 AS INT) AS number, 600 AS size FROM nation")
def split_markdown(spark, d):
    """Markdown with a chapter, a deeper heading within it and an empty section."""
    n = S.read(spark, d, "nation")
    head = F.concat(F.lit("Chapter "), F.col("n_nationkey") + 1)
    text = F.concat(F.lit("## "), head, F.lit("\n"), F.repeat(F.lit("a"), F.lit(590)), F.lit("\n\n## Notes"), F.lit("\n# Empty\nx\n"))
    read = lambda t: [(title, number, len(x)) for number, title, x, _ in C.markdown_chapters(t)]
    return C.read_each(n.select("n_nationkey", text.alias("text")), "text", read, "title string, number int, size int", ["n_nationkey"])
