"""Reads of the graph, of books and of characters, retrieval arms, and small operators, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import sources as S
from skein.catalog.core import BM25_DOCS, BOTH, DENSE, EDGES, NODES, _bm25_docs, _dense, _top_sql
from skein.catalog.registered import query
from skein.catalog.texts import PARTS, parts, told
from skein.catalog.upserts import X, extraction
from skein.operators import export as E
from skein.operators import graph as G
from skein.operators import reads as R
from skein.operators import retrieval as V
from skein.operators import upserts as U

LABELLED = f"{NODES}, {EDGES}"


def _samples(keys: str, value: str, table: str, n: int) -> str:
    return f"SELECT {keys}, string_agg({value}, ',' ORDER BY {value}) AS samples FROM (SELECT DISTINCT {keys}, {value} FROM {table} WHERE {value} IS NOT NULL QUALIFY dense_rank() OVER (PARTITION BY {keys} ORDER BY {value}) <= {n}) GROUP BY {keys}"


# --- profiles ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {NODES}, m AS (SELECT *, CASE WHEN length(id) % 3 = 0 THEN 0.5 END AS confidence FROM n), s AS ({_samples('label', 'name', 'm', 5)})
    SELECT label, count(*) AS n, round(avg(coalesce(confidence, 1.0))::DOUBLE, 2) AS confidence, any_value(samples) AS samples, CASE WHEN label IN ('Region', 'Nation') THEN 'core' ELSE 'induced' END AS layer FROM m LEFT JOIN s USING (label) GROUP BY label""")
def entity_profile(spark, d):
    nodes = S.nodes(spark, d).withColumn("confidence", F.when(F.length("id") % 3 == 0, 0.5))
    return R.entity_profile(nodes, {"Region": "core", "Nation": "core"})


@query(f"""WITH {EDGES}, k AS (SELECT rel, chapter, split_part(src, ':', 1) AS s, split_part(dst, ':', 1) AS d FROM e)
    SELECT rel, count(*) AS n, bool_or(chapter IS NOT NULL) AS temporal, array_to_string(list_sort(list_distinct(list(s)))[1:3], ',') AS src_types, array_to_string(list_sort(list_distinct(list(d)))[1:3], ',') AS dst_types FROM k GROUP BY 1""")
def relation_profile(spark, d):
    return R.relation_profile(S.edges(spark, d))


@query(f"""WITH {EDGES}, k AS (SELECT split_part(src, ':', 1) AS src_label, rel, split_part(dst, ':', 1) AS dst_label, src || '>' || dst AS pair FROM e), c AS (SELECT src_label, rel, dst_label, count(*) AS n FROM k GROUP BY ALL),
    s AS (SELECT src_label, rel, dst_label, string_agg(pair, ',' ORDER BY pair) AS samples FROM (SELECT DISTINCT * FROM k QUALIFY dense_rank() OVER (PARTITION BY src_label, rel, dst_label ORDER BY pair) <= 2) GROUP BY ALL) SELECT * FROM c JOIN s USING (src_label, rel, dst_label)""")
def schema_triple_samples(spark, d):
    return R.triple_samples(S.edges(spark, d))


@query(f"WITH {LABELLED} SELECT (SELECT count(*) FROM n) AS entities, (SELECT count(DISTINCT label) FROM n) AS entity_types, (SELECT count(*) FROM e) AS relations, (SELECT count(DISTINCT rel) FROM e) AS relation_types, round((SELECT count(*) FROM e) / greatest((SELECT count(*) FROM n), 1)::DOUBLE, 1) AS relations_per_entity")
def ontology_stats(spark, d):
    return R.ontology_stats(S.nodes(spark, d), S.edges(spark, d))


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_nationkey < 20) AS total FROM customer WHERE c_nationkey < 20 ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 200 OFFSET 5")
def entity_page_total(spark, d):
    rows = S.read(spark, d, "customer").where("c_nationkey < 20")
    return R.page(rows, [F.desc_nulls_first("c_acctbal"), "c_custkey"], 5000, 5).select("c_custkey", "c_name", "total")


@query(f"WITH {LABELLED}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT n.id, label, coalesce(degree, 0) AS degree, round(greatest(3.0, 2 * sqrt(coalesce(degree, 0) + 1)), 2) AS size FROM n LEFT JOIN g USING (id)")
def client_graph_stats(spark, d):
    return R.client_stats(S.nodes(spark, d), S.edges(spark, d))


@query(f"WITH {EDGES} SELECT split_part(src, ':', 1) AS src_label, split_part(dst, ':', 1) AS dst_label, count(*) AS n, array_to_string(list_sort(list_distinct(list(rel))), ',') AS relations FROM e GROUP BY 1, 2")
def schema_edges(spark, d):
    return R.schema_edges(S.edges(spark, d))


@query("SELECT 'count' AS what, event_type AS sub_type, NULL AS label, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'promoted', event_type, CASE event_type WHEN 'click' THEN 'Ability' ELSE 'Place' END, count(*) FROM events WHERE event_type IN ('click', 'view') GROUP BY 2")
def sub_type_promotion(spark, d):
    counts, up = R.promoted(S.read(spark, d, "events").select(F.col("event_type").alias("sub_type")), {"click": "Ability", "view": "Place"})
    return counts.select(F.lit("count").alias("what"), "sub_type", F.lit(None).cast("string").alias("label"), "n").unionByName(up.groupBy("sub_type", "label").agg(F.count("*").alias("n")).select(F.lit("promoted").alias("what"), "sub_type", "label", "n"))


@query("SELECT asked, count(*) AS n FROM (SELECT unnest(['minor', 'moderate', 'major', 'critical', 'odd']) AS asked, CASE o_orderpriority WHEN '1-URGENT' THEN 'arc_defining' WHEN '2-HIGH' THEN 'Major' WHEN '3-MEDIUM' THEN 'moderate' WHEN '5-LOW' THEN 'minor' ELSE 'none' END AS level FROM orders) WHERE CASE asked WHEN 'odd' THEN true WHEN 'minor' THEN level <> 'none' WHEN 'moderate' THEN level IN ('moderate', 'Major', 'arc_defining') WHEN 'major' THEN level IN ('Major', 'arc_defining') ELSE level = 'arc_defining' END GROUP BY 1")
def significance_filter(spark, d):
    p = F.col("o_orderpriority")
    level = F.when(p == "1-URGENT", "arc_defining").when(p == "2-HIGH", "Major").when(p == "3-MEDIUM", "moderate").when(p == "5-LOW", "minor").otherwise("none")
    rows, out = S.read(spark, d, "orders").select(level.alias("level")), None
    for asked in ("minor", "moderate", "major", "critical", "odd"):
        one = rows.where(R.significant(F.col("level"), asked)).groupBy(F.lit(asked).alias("asked")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {NODES} SELECT * FROM (SELECT 'any' AS way, id, name FROM n WHERE contains(lower(name), 'an') ORDER BY length(name), name, id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'label', id, name FROM n WHERE contains(lower(name), 'an') AND label = 'Nation' ORDER BY name, id LIMIT 20)")
def contains_search(spark, d):
    n = S.nodes(spark, d)
    return R.by_name(n, "AN").select(F.lit("any").alias("way"), "id", "name").unionByName(R.by_name(n, "an", "Nation").select(F.lit("label").alias("way"), "id", "name"))


@query(f"""WITH {NODES}, s AS (SELECT *, CAST(regexp_matches(lower(name), '(^|[^\\p{{L}}\\p{{N}}])cold') AS INT) + CAST(regexp_matches(lower(name), '(^|[^\\p{{L}}\\p{{N}}])anv') AS INT) AS score FROM n) SELECT id, name, score FROM s WHERE score > 0 ORDER BY score DESC, length(name), name, id LIMIT 20""")
def fulltext_search(spark, d):
    return R.searched(S.nodes(spark, d), "Cold anv").select("id", "name", "score")


@query(f"WITH {NODES} SELECT label, count(*) AS n FROM n GROUP BY 1")
def first_labels(spark, d):
    labels = F.array(F.lit("Entity"), F.col("label"), F.lit("Thing"))
    return S.nodes(spark, d).groupBy(R.first_label(labels, ["Entity"]).alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT split_part(src, ':', 1) AS label, rel, count(*) AS n FROM e WHERE split_part(src, ':', 1) NOT IN ('Region', 'Order') AND rel NOT IN ('IN_REGION') GROUP BY ALL")
def structural_exclusion(spark, d):
    e = S.edges(spark, d).withColumn("label", G.label_of(F.col("src")))
    return e.where(~F.col("label").isin("Region", "Order") & ~F.col("rel").isin("IN_REGION")).groupBy("label", "rel").agg(F.count("*").alias("n"))


# --- books and chapters -----------------------------------------------------------------------------------------------

MENTIONS = "m AS (SELECT book, chapter, name AS entity, kind AS entity_type, CAST(k AS INT) AS start, CAST(k + length(name) AS INT) AS stop FROM x)"


def _mentions(spark, d):
    return extraction(spark, d).select("book", "chapter", F.col("name").alias("entity"), F.col("kind").alias("entity_type"), F.col("k").alias("start"), (F.col("k") + F.length("name")).alias("end"))


def _chapters(spark, d):
    return told(spark, d).withColumn("title", F.concat(F.lit("Day "), "chapter")).withColumn("words", F.size(F.split(F.trim("text"), r"\s+")))


def _chunks(spark, d):
    return parts(spark, d).select("book", "chapter", F.col("seq").alias("position"), "text")


@query(f"""WITH {PARTS}, {MENTIONS}, o AS (SELECT owner AS entity, count(*) AS r FROM x GROUP BY 1), h AS (SELECT DISTINCT book, chapter, owner AS entity FROM x), c AS (SELECT book, chapter, count(*) AS chunks FROM s GROUP BY ALL),
    t AS (SELECT book, chapter, count(*) AS entities, coalesce(CAST(sum(r) AS BIGINT), 0) AS relations FROM h LEFT JOIN o USING (entity) GROUP BY ALL) SELECT book, chapter, 'Day ' || chapter AS title, chunks, entities, relations FROM c JOIN t USING (book, chapter)""")
def chapter_listing(spark, d):
    x = extraction(spark, d)
    return R.chapter_listing(_chapters(spark, d).select("book", "chapter", "title"), _chunks(spark, d), x.select("book", "chapter", F.col("owner").alias("entity")), x.select(F.col("owner").alias("src"), F.col("name").alias("dst")))


@query(f"WITH {X}, {MENTIONS} SELECT book, chapter, entity_type, count(DISTINCT entity) AS n FROM m GROUP BY ALL")
def chapter_entity_types(spark, d):
    return R.chapter_types(_mentions(spark, d))


@query(f"""WITH {PARTS}, t AS (SELECT book, chapter, len(regexp_split_to_array(trim(string_agg(text, chr(10) || chr(10) ORDER BY seq)), '\\s+')) AS words FROM p GROUP BY ALL), c AS (SELECT book, count(*) AS chapters, CAST(sum(words) AS BIGINT) AS words FROM t GROUP BY 1),
    k AS (SELECT book, count(*) AS chunks FROM p GROUP BY 1), r AS (SELECT book, count(*) AS matches FROM p WHERE sort <= 4 GROUP BY 1) SELECT * FROM c JOIN k USING (book) JOIN r USING (book)""")
def book_stats(spark, d):
    return R.book_stats(_chapters(spark, d), _chunks(spark, d), parts(spark, d).where("sort <= 4"))


@query("SELECT n_regionkey AS series, count(*) AS books, string_agg(n_name, ' / ' ORDER BY n_nationkey, n_name) AS titles FROM nation GROUP BY 1")
def series_rollup(spark, d):
    return R.series(S.read(spark, d, "nation").select(F.col("n_regionkey").alias("series"), F.col("n_nationkey").alias("place"), F.col("n_name").alias("title")))


@query("SELECT a.n_name AS book, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name")
def other_books(spark, d):
    return R.other_books(S.read(spark, d, "nation").select(F.col("n_name").alias("book"), F.col("n_regionkey").alias("series")))


@query(f"""WITH {X}, {MENTIONS} SELECT DISTINCT ON (book, chapter, start, stop) book, chapter, start, stop AS "end", entity, entity_type FROM m ORDER BY book, chapter, start, stop, CASE entity_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, entity""")
def chapter_annotations(spark, d):
    return R.annotations(_mentions(spark, d), ["purchase", "click"])


@query(f"""WITH {PARTS}, {MENTIONS}, a AS (SELECT book, chapter, array_to_string(list_sort(list_distinct(list(entity))), ',') AS entities FROM m GROUP BY ALL)
    SELECT book, chapter, position, '[Para.' || position || '] (' || CASE WHEN sort = 5 THEN 'dialogue) [Mara]' ELSE 'narration)' END || ': ' || text AS line, entities FROM p JOIN a USING (book, chapter)""")
def reader_context(spark, d):
    from pyspark.sql import Window as W

    rows = parts(spark, d).withColumn("position", (F.row_number().over(W.partitionBy("book", "chapter").orderBy("seq")) - 1).cast("long"))
    shaped = rows.select("book", "chapter", "position", "text", F.when(F.col("sort") == 5, "dialogue").otherwise("narration").alias("kind"), F.when(F.col("sort") == 5, "Mara").alias("speaker"))
    return R.reader_context(shaped, _mentions(spark, d))


@query("SELECT 'missing' AS what, count(*) AS n, 0.0::DOUBLE AS total FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT 'after', count(*), 0.0 FROM embeddings WHERE vec_id % 6 = 3")
def unembedded_rows(spark, d):
    """Rows without a vector, and those that are left when half of them are written back."""
    v = S.read(spark, d, "embeddings")
    rows = v.select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"))
    done = R.written_back(rows, v.where("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    count = lambda df, what: R.unembedded(df).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n", F.lit(0.0).alias("total"))
    return count(rows, "missing").unionByName(count(done, "after"))


@query(f"WITH {NODES}, {EDGES} SELECT label || ': ' || name || CASE WHEN label = 'Nation' THEN '. A land' ELSE '' END AS text FROM n UNION ALL SELECT src || ' ' || replace(rel, '_', ' ') || ' ' || dst || CASE WHEN chapter IS NULL THEN '' ELSE ': month ' || chapter END FROM e")
def embedding_texts(spark, d):
    n = S.nodes(spark, d).select(R.entity_text(F.col("label"), F.col("name"), F.when(F.col("label") == "Nation", "A land")).alias("text"))
    context = F.when(F.col("chapter").isNotNull(), F.concat(F.lit("month "), "chapter"))
    return n.unionByName(S.edges(spark, d).select(R.relation_text(F.col("src"), F.col("rel"), F.col("dst"), context).alias("text")))


@query("SELECT doc_id AS key, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN NULL ELSE 'no words' END AS error, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 64 ELSE -1 END AS size FROM documents")
def embedding_batch(spark, d):
    rows = S.read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return R.embedded(rows).select("key", "error", F.coalesce(F.size("vector"), F.lit(-1)).alias("size"))


# --- characters -------------------------------------------------------------------------------------------------------

OWNED = f"""{X}, g AS (SELECT owner, chapter, seq, CASE WHEN kind = 'purchase' THEN 'level' ELSE 'stat' END AS category, kind AS name, CAST(CASE WHEN kind = 'purchase' THEN k ELSE value END AS BIGINT) AS value FROM x WHERE owner <> ''),
    h AS (SELECT owner, name, min(chapter) AS valid_from, CASE WHEN length(name) % 2 = 0 THEN min(chapter) + 9 END AS valid_to FROM x WHERE owner <> '' GROUP BY owner, name), y AS (SELECT * FROM h WHERE valid_from <= 15 AND (valid_to IS NULL OR valid_to > 15))"""


def _owned(spark, d):
    x = extraction(spark, d).where("owner <> ''")
    bought = F.col("kind") == "purchase"
    ledger = x.select("owner", "chapter", "seq", F.when(bought, "level").otherwise("stat").alias("category"), F.col("kind").alias("name"), F.when(bought, F.col("k").cast("long")).otherwise(F.col("value")).alias("value"))
    held = x.groupBy("owner", "name").agg(F.min("chapter").alias("valid_from")).withColumn("valid_to", F.when(F.length("name") % 2 == 0, F.col("valid_from") + 9))
    return ledger, held


@query(f"""WITH {OWNED}, l AS (SELECT owner, arg_max(value, seq) AS level, arg_max(chapter, seq) AS since FROM g WHERE category = 'level' AND chapter <= 15 GROUP BY 1), t AS (SELECT owner, name, CAST(sum(value) AS BIGINT) AS v FROM g WHERE category = 'stat' AND chapter <= 15 GROUP BY ALL),
    s AS (SELECT owner, string_agg(name || '=' || v, ',' ORDER BY name || '=' || v) AS stats FROM t GROUP BY 1), k AS (SELECT owner, string_agg(name, ',' ORDER BY name) FILTER (starts_with(name, 'click')) AS skills, string_agg(name, ',' ORDER BY name) FILTER (starts_with(name, 'view')) AS classes, string_agg(name, ',' ORDER BY name) FILTER (starts_with(name, 'purchase')) AS items FROM y GROUP BY 1),
    i AS (SELECT owner, string_agg(name, ',' ORDER BY name) AS titles FROM h WHERE starts_with(name, 'error') AND valid_from <= 15 GROUP BY 1), c AS (SELECT owner, CAST(count(*) FILTER (chapter = 15) AS BIGINT) AS changes_here, count(*) AS changes FROM g WHERE chapter <= 15 GROUP BY 1)
    SELECT c.owner, changes_here, changes, level, since, coalesce(stats, '') AS stats, coalesce(skills, '') AS skills, coalesce(classes, '') AS classes, coalesce(titles, '') AS titles, coalesce(items, '') AS items FROM c LEFT JOIN l USING (owner) LEFT JOIN s USING (owner) LEFT JOIN k USING (owner) LEFT JOIN i USING (owner)""")
def character_sheets(spark, d):
    ledger, held = _owned(spark, d)
    of = lambda kind: held.where(F.col("name").startswith(kind))
    return R.sheets(ledger, of("click"), of("view"), of("error").select("owner", "name", F.col("valid_from").alias("chapter")), of("purchase"), 15)


@query(f"""WITH {OWNED}, a AS (SELECT owner, name AS active_class FROM y WHERE starts_with(name, 'view') QUALIFY row_number() OVER (PARTITION BY owner ORDER BY valid_from DESC, name DESC) = 1),
    t AS (SELECT owner, name, row_number() OVER (PARTITION BY owner ORDER BY valid_from, name) AS r FROM y WHERE starts_with(name, 'click')), s AS (SELECT owner, string_agg(name, ',' ORDER BY r) AS top_skills FROM t WHERE r <= 5 GROUP BY 1) SELECT owner, active_class, top_skills FROM a FULL JOIN s USING (owner)""")
def character_cards(spark, d):
    _, held = _owned(spark, d)
    return R.cards(held.where(F.col("name").startswith("click")), held.where(F.col("name").startswith("view")), 15)


def _story(spark, d):
    """Nodes and edges of characters: skills, classes, titles, events and each other."""
    x = extraction(spark, d).where("owner <> ''")
    rel = F.element_at(F.array(*map(F.lit, ("HAS_SKILL", "HAS_CLASS", "HAS_TITLE", "PARTICIPATES_IN", "MENTIONED_IN"))), F.col("k") % 5 + 1)
    edges = x.groupBy(F.col("owner").alias("src"), rel.alias("rel"), F.col("name").alias("dst")).agg(F.min("chapter").alias("chapter"))
    friends = x.groupBy(F.col("owner").alias("src"), F.concat(F.lit("user "), F.col("k") % 20).alias("dst")).agg(F.min("chapter").alias("chapter")).select("src", F.lit("KNOWS").alias("rel"), "dst", "chapter")
    people = x.select(F.col("owner").alias("id")).distinct().select("id", F.lit("Character").alias("label"), F.initcap("id").alias("name"), F.array(F.concat(F.lit("aka "), "id")).alias("aliases"))
    things = x.select(F.col("name").alias("id")).distinct().select("id", F.lit("Thing").alias("label"), F.col("id").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return people.unionByName(things), edges.unionByName(friends)


STORY = f"""{X}, o AS (SELECT * FROM x WHERE owner <> ''), e AS (SELECT owner AS src, CASE k % 5 WHEN 0 THEN 'HAS_SKILL' WHEN 1 THEN 'HAS_CLASS' WHEN 2 THEN 'HAS_TITLE' WHEN 3 THEN 'PARTICIPATES_IN' ELSE 'MENTIONED_IN' END AS rel, name AS dst, min(chapter) AS chapter FROM o GROUP BY ALL
    UNION ALL SELECT owner, 'KNOWS', 'user ' || (k % 20), min(chapter) FROM o GROUP BY ALL), n AS (SELECT DISTINCT owner AS id, 'Character' AS label, 'User ' || split_part(owner, ' ', 2) AS name FROM o UNION ALL SELECT DISTINCT name, 'Thing', name FROM o)"""


@query(f"""WITH {STORY}, b AS (SELECT src AS a, rel, dst AS b, chapter FROM e WHERE rel <> 'MENTIONED_IN' UNION ALL SELECT dst, rel, src, chapter FROM e WHERE rel <> 'MENTIONED_IN')
    SELECT CASE rel WHEN 'HAS_SKILL' THEN 'skills' WHEN 'HAS_CLASS' THEN 'classes' WHEN 'HAS_TITLE' THEN 'titles' WHEN 'PARTICIPATES_IN' THEN 'events' ELSE 'relationships' END AS section, n.name, rel, chapter FROM b JOIN n ON n.id = b.b WHERE a = 'user 7'""")
def character_profile(spark, d):
    return R.profile(*_story(spark, d), "aka user 7")


@query(f"""WITH {NODES}, {EDGES}, {BOTH}, w AS (SELECT rel, direction, n.name AS other FROM b JOIN n ON n.id = b.b WHERE a = (SELECT id FROM n WHERE label = 'Nation' AND name = (SELECT n_name FROM nation WHERE n_nationkey = 3)) ORDER BY rel, direction, other LIMIT 100)
    SELECT rel, direction, count(*) AS n, string_agg(other, ',' ORDER BY other) AS names FROM w GROUP BY 1, 2""")
def wiki_page(spark, d):
    name = S.read(spark, d, "nation").where("n_nationkey = 3").first()["n_name"]
    return R.wiki(S.nodes(spark, d), S.edges(spark, d), "Nation", name.lower())


# --- graph ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {NODES}, {EDGES}, f AS (SELECT id FROM n WHERE label IN ('Nation', 'Region', 'Customer') ORDER BY id LIMIT 120), g AS (SELECT src, rel, dst FROM e WHERE (chapter IS NULL OR chapter <= 400) AND src IN (SELECT id FROM f) AND dst IN (SELECT id FROM f) ORDER BY src, rel, dst LIMIT 600)
    SELECT 'node' AS what, id AS src, NULL AS rel, NULL AS dst FROM f UNION ALL SELECT 'edge', src, rel, dst FROM g""")
def book_subgraph(spark, d):
    nodes, edges = R.book_subgraph(S.nodes(spark, d).where(F.col("label").isin("Nation", "Region", "Customer")), S.edges(spark, d), 400, 120)
    none = F.lit(None).cast("string")
    return nodes.select(F.lit("node").alias("what"), F.col("id").alias("src"), none.alias("rel"), none.alias("dst")).unionByName(edges.select(F.lit("edge").alias("what"), "src", "rel", "dst"))


@query(f"WITH {STORY} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM e WHERE src <> dst GROUP BY 1, 2")
def simple_graph(spark, d):
    return R.simple_edges(_story(spark, d)[1])


@query("SELECT n_regionkey AS parent, string_agg(n_name, chr(10) ORDER BY length(n_name) DESC, n_nationkey) AS summary FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY 1")
def child_summaries(spark, d):
    n = S.read(spark, d, "nation")
    return R.child_summaries(n.select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("id"), F.length("n_name").alias("members"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("summary")))


@query("""WITH c AS (SELECT DISTINCT p_name AS name, substr(p_name, 1, 3) || 'x' AS alias FROM part), o AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'the ' || p_name WHEN 1 THEN left(p_name, length(p_name) - 2) WHEN 2 THEN 'zzz' ELSE substr(p_name, 1, 3) || 'x' END AS given FROM part),
    d AS (SELECT id, min(name) AS character FROM o JOIN c ON regexp_replace(given, '^(the|a) ', '') IN (name, alias) GROUP BY 1), h AS (SELECT id, name, length(given) * 1.0 / greatest(length(name), length(given)) AS overlap FROM o JOIN c ON contains(name, given) OR contains(given, name) OR contains(alias, given) WHERE length(given) > 2 AND id NOT IN (SELECT id FROM d))
    SELECT id, character, 'article' AS way FROM d UNION ALL SELECT id, arg_min(name, (-overlap, name)), 'held' FROM h WHERE overlap > 0.5 GROUP BY id""")
def orphan_resolution(spark, d):
    p = S.read(spark, d, "part")
    c = p.select(F.lit(1).alias("book"), F.col("p_name").alias("name"), F.array(F.concat(F.substring("p_name", 1, 3), F.lit("x"))).alias("aliases")).distinct()
    m = F.col("p_partkey") % 4
    given = F.when(m == 0, F.concat(F.lit("the "), "p_name")).when(m == 1, F.left("p_name", F.length("p_name") - 2)).when(m == 2, "zzz").otherwise(F.concat(F.substring("p_name", 1, 3), F.lit("x")))
    return R.orphans_resolved(p.select(F.col("p_partkey").alias("id"), F.lit(1).alias("book"), given.alias("given")), c)


INFER = f"""{X}, st AS (SELECT event_id AS id, owner, chapter, CASE WHEN event_id % 3 = 0 THEN 'c' END AS cause FROM x WHERE kind = 'view'), pa AS (SELECT DISTINCT owner, name || ' ' || chapter AS event FROM x WHERE kind = 'click'),
    ev AS (SELECT DISTINCT name || ' ' || chapter AS event, chapter FROM x WHERE kind = 'click'), sq AS (SELECT 'arc ' || n_nationkey AS sequence, CAST(n_nationkey + 1 AS INT) AS first, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey + 4 AS INT) END AS last FROM nation),
    so AS (SELECT event_id AS id, chapter, CASE WHEN event_id % 2 = 0 THEN 'c' END AS cause FROM x WHERE kind = 'error'), ro AS (SELECT DISTINCT 'role ' || owner AS id, owner FROM x), wi AS (SELECT event, sequence FROM ev JOIN sq ON chapter >= first AND (last IS NULL OR chapter <= last))"""


@query(f"""WITH {INFER}, r AS (SELECT id AS src, sequence, count(*) AS n FROM ro JOIN pa USING (owner) JOIN wi USING (event) GROUP BY ALL)
    SELECT * FROM (SELECT 'FOLLOWS_STATE' AS rel, CAST(id AS VARCHAR) AS src, CAST(lead(id) OVER (PARTITION BY owner ORDER BY chapter, id) AS VARCHAR) AS dst FROM st) WHERE dst IS NOT NULL
    UNION ALL SELECT 'STATE_TRIGGERED_BY', CAST(id AS VARCHAR), min(event) FROM st JOIN pa USING (owner) JOIN ev USING (event, chapter) WHERE cause IS NULL GROUP BY id UNION ALL SELECT 'SEQUENCED_IN', event, sequence FROM wi
    UNION ALL SELECT 'RELATIONSHIP_CAUSED_BY', CAST(id AS VARCHAR), min(event) FROM so JOIN ev USING (chapter) WHERE cause IS NULL GROUP BY id UNION ALL SELECT 'ROLE_IN_SEQUENCE', src, arg_min(sequence, (-n, sequence)) FROM r GROUP BY src""")
def inferred_edges(spark, d):
    x = extraction(spark, d)
    event = F.concat_ws(" ", "name", "chapter")
    clicks = x.where("kind = 'click'")
    n = S.read(spark, d, "nation").select(F.concat(F.lit("arc "), "n_nationkey").alias("sequence"), (F.col("n_nationkey") + 1).alias("first"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") + 4).alias("last"))
    states = x.where("kind = 'view'").select("event_id", "owner", "chapter", F.when(F.col("event_id") % 3 == 0, "c").alias("cause")).withColumnRenamed("event_id", "id")
    out = R.inferred(
        states, clicks.select("owner", event.alias("event")).distinct(), clicks.select(event.alias("event"), "chapter").distinct(), n,
        x.where("kind = 'error'").select(F.col("event_id").alias("id"), "chapter", F.when(F.col("event_id") % 2 == 0, "c").alias("cause")), x.select(F.concat(F.lit("role "), "owner").alias("id"), "owner").distinct(),
    )
    return out.select("rel", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))


@query(f"""WITH {PARTS}, {MENTIONS}, b AS (SELECT DISTINCT entity FROM m WHERE length(entity) % 2 = 1 ORDER BY entity LIMIT 200), t AS (SELECT DISTINCT entity, left(text, 12) AS t FROM m JOIN b USING (entity) JOIN p USING (book, chapter)),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS r FROM t) SELECT entity, string_agg(t, '|' ORDER BY r) AS passages FROM r WHERE r <= 3 GROUP BY 1""")
def description_passages(spark, d):
    m = _mentions(spark, d)
    e = m.select("entity").distinct().withColumn("description", F.when(F.length("entity") % 2 == 0, "known").otherwise(" "))
    return R.passages(e, m.select("book", "chapter", "entity").distinct(), _chunks(spark, d), size=12)


@query(f"WITH {X} SELECT name AS event, chapter, CASE WHEN trim(description) <> '' THEN description ELSE name END AS proposition, count(*) AS n FROM x GROUP BY ALL")
def narrative_units(spark, d):
    return R.narrative_units(extraction(spark, d).select(F.col("name").alias("event"), "chapter", "description")).groupBy("event", "chapter", "proposition").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'protagonist' WHEN 'MACHINERY' THEN 'major' ELSE 'minor' END AS significance, count(*) AS n FROM customer GROUP BY ALL")
def role_significance(spark, d):
    s = F.col("c_mktsegment")
    role = F.when(s == "BUILDING", " Protagonist").when(s == "MACHINERY", "antagonist").otherwise("friend")
    return S.read(spark, d, "customer").groupBy("c_mktsegment", R.role_significance(role).alias("significance")).agg(F.count("*").alias("n"))


@query(f"WITH {STORY} SELECT owner AS name, CAST(count(DISTINCT book) AS INT) AS books FROM x GROUP BY 1 HAVING count(DISTINCT book) > 1")
def series_entities(spark, d):
    return U.shared_characters(extraction(spark, d).select(F.col("owner").alias("name"), "book")).select("name", F.col("books").cast("int").alias("books")).distinct()


@query(f"WITH {NODES}, {EDGES} SELECT * FROM n WHERE id = 'Part:5' UNION ALL SELECT src || '>' || dst, rel, NULL FROM e WHERE src = 'Customer:7'")
def node_and_edge_detail(spark, d):
    n = S.nodes(spark, d).where("id = 'Part:5'")
    return n.unionByName(S.edges(spark, d).where("src = 'Customer:7'").select(F.concat_ws(">", "src", "dst").alias("id"), F.col("rel").alias("label"), F.lit(None).cast("string").alias("name")))


@query("WITH s AS (SELECT o_custkey % 2 = 0 AS even, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def works_cross(spark, d):
    """Every character with every work of its book: an equality join on the book."""
    return S.read(spark, d, "customer").join(S.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey")


@query("SELECT vec_id, CAST(unnest(range(1, 65)) AS INT) AS place, unnest(embedding) + unnest(list_reverse(embedding)) AS total FROM embeddings")
def positional_zip(spark, d):
    e = S.read(spark, d, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))).alias("place", "z"))
    return e.select("vec_id", (F.col("place") + 1).alias("place"), (F.col("z.a") + F.col("z.b")).alias("total"))


# --- retrieval --------------------------------------------------------------------------------------------------------

GROUND = "gr AS (SELECT 'k' || label AS entity, vec_id AS doc_id, CAST(vec_id % 30 AS INT) AS chapter FROM embeddings)"
ARM = f"""{DENSE}, {GROUND}, en AS (SELECT query_id, 'k' || i.label AS entity, max(round(score, 6)) AS score FROM v JOIN embeddings i ON i.vec_id = v.doc_id GROUP BY ALL), fe AS (SELECT * FROM en WHERE score > 0.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) <= 5),
    ga AS (SELECT query_id, doc_id, max(score) AS score FROM fe JOIN gr USING (entity) WHERE chapter <= 20 GROUP BY ALL), gs AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM ga QUALIFY rank <= 30)"""


def _graph_arm(spark, d):
    v = S.read(spark, d, "embeddings")
    items = v.select(F.col("vec_id").alias("doc_id"), "embedding", F.concat(F.lit("k"), "label").alias("entity"))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    entities = V.dense_groups(items, asked, "entity").withColumn("score", F.round("score", 6))
    return R.graph_arm(entities, v.select(F.concat(F.lit("k"), "label").alias("entity"), F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 30).alias("chapter")), 20)


@query(f"WITH {ARM} SELECT query_id, doc_id, score, rank FROM gs")
def graph_arm(spark, d):
    return _graph_arm(spark, d)


@query(f"""WITH {ARM}, {BM25_DOCS}, lx AS ({_top_sql('s', 30)}), dn AS ({_top_sql('v', 30)}), z AS (SELECT query_id, doc_id, CAST(sum(CAST(p AS DECIMAL(38, 12))) AS DOUBLE) AS score FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS p FROM lx UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM dn
    UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) FROM gs) GROUP BY ALL), r AS ({_top_sql('z', 15)}) SELECT * FROM r""")
def three_arm_retrieve(spark, d):
    return V.fuse([(V.top(_bm25_docs(spark, d), 30), 1.0), (V.top(_dense(spark, d, 30), 30), 1.0), (_graph_arm(spark, d), 0.5)], 15)


@query(f"""WITH {EDGES}, u AS (SELECT DISTINCT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), q AS (SELECT s_suppkey AS query_id, 'Supplier:' || s_suppkey AS entity FROM supplier WHERE s_suppkey % 20 = 0),
    n AS (SELECT query_id, entity, b AS via FROM q JOIN u ON a = entity), f AS (SELECT query_id, via, CASE WHEN max(CASE WHEN u.b IS NOT NULL AND u.b <> entity THEN 1 ELSE 0 END) = 1 THEN 0.5 ELSE 1.0 END AS score FROM n LEFT JOIN u ON u.a = via GROUP BY ALL),
    g AS (SELECT 'Part:' || p_partkey AS via, p_partkey % 500 AS doc_id FROM part) SELECT query_id, doc_id, via, CAST(score AS DOUBLE) AS score FROM f JOIN g USING (via) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, via) <= 30""")
def hop_arm(spark, d):
    asked = S.read(spark, d, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("Supplier:"), "s_suppkey").alias("entity"))
    ground = S.read(spark, d, "part").select(F.concat(F.lit("Part:"), "p_partkey").alias("entity"), (F.col("p_partkey") % 500).alias("doc_id"))
    return R.hop_arm(asked, S.edges(spark, d), ground)


@query(f"WITH {DENSE}, r AS (SELECT query_id, doc_id, score FROM v JOIN embeddings i ON i.vec_id = v.doc_id WHERE i.label <> 3 AND round(score, 9) > 0.5 AND (i.vec_id % 30 <= 20 OR i.vec_id % 7 = 0)), t AS ({_top_sql('r', 5)}) SELECT * FROM t")
def relation_vectors(spark, d):
    """The five nearest edges over 0.5, none of an excluded type or of a later chapter; undated ones pass."""
    v = S.read(spark, d, "embeddings")
    fit = v.where("label <> 3").where((F.col("vec_id") % 30 <= 20) | (F.col("vec_id") % 7 == 0)).select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return V.top(V.dense(fit, asked, 5).where("score > 0.5"), 5)


@query("SELECT n_nationkey AS id, n_name AS summary FROM nation WHERE n_nationkey % 4 <> 0 ORDER BY n_regionkey, length(n_name) DESC, n_nationkey LIMIT 5")
def community_search(spark, d):
    n = S.read(spark, d, "nation")
    return R.community_arm(n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("summary"), F.col("n_regionkey").alias("level"), F.length("n_name").alias("members"))).select("id", "summary")


@query(f"""WITH {BM25_DOCS}, c AS ({_top_sql('s', 30)}), ws AS (SELECT query_id, doc_id, list_filter(list_distinct(regexp_split_to_array(lower(b.text), '[^\\p{{L}}\\p{{N}}]+')), lambda x: x <> '') AS q, list_filter(list_distinct(regexp_split_to_array(lower(d.text), '[^\\p{{L}}\\p{{N}}]+')), lambda x: x <> '') AS t
    FROM c JOIN benchmark b ON b.item_id = c.query_id JOIN documents d USING (doc_id)), r AS (SELECT query_id, doc_id, round(len(list_intersect(q, t)) / greatest(len(q), 1)::DOUBLE, 6) AS rerank FROM ws)
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, doc_id) AS INT) AS rank FROM r QUALIFY rank <= 5""")
def reranked(spark, d):
    b = S.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    c = V.top(_bm25_docs(spark, d), 30).drop("rank", "score").join(b, "query_id").join(S.read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return R.reranked(c).select("query_id", "doc_id", "rerank", "rank")


@query(f"""WITH {EDGES}, {BOTH}, g AS (SELECT a AS entity, count(DISTINCT b) AS degree FROM b WHERE a <> b GROUP BY 1), q AS (SELECT s_suppkey AS query_id, 'Supplier:' || s_suppkey AS entity FROM supplier WHERE s_suppkey % 20 = 0),
    f AS (SELECT query_id, entity, direction || ' ' || rel || ' ' || b AS t, row_number() OVER (PARTITION BY query_id, entity ORDER BY rel, direction, b) AS r FROM q JOIN b ON a = entity)
    SELECT query_id, entity, degree, round(degree / (SELECT max(degree) FROM g)::DOUBLE, 6) AS importance, string_agg(t, ';' ORDER BY r) AS edges FROM f JOIN g USING (entity) WHERE r <= 30 GROUP BY ALL""")
def knowledge_lookup(spark, d):
    asked = S.read(spark, d, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("Supplier:"), "s_suppkey").alias("entity"))
    return R.knowledge(asked, S.nodes(spark, d), S.edges(spark, d))


@query(f"""WITH {BM25_DOCS}, c AS ({_top_sql('s', 5)}), p AS (SELECT query_id, string_agg('[Ch.' || (doc_id % 9) || ', p.' || doc_id || '] ' || coalesce(text, ''), chr(10) ORDER BY doc_id % 9, doc_id) AS p FROM c JOIN documents USING (doc_id) GROUP BY 1)
    SELECT query_id, md5(left('Passages:' || chr(10) || p || chr(10) || 'Entities:' || chr(10) || 'item ' || query_id || ': a thing r1; r2; r3; r4; r5', 12000)) AS digest, least(length(p) + length('Passages:' || chr(10) || chr(10) || 'Entities:' || chr(10) || 'item ' || query_id || ': a thing r1; r2; r3; r4; r5'), 12000) AS size FROM p""")
def context_assembly(spark, d):
    best = V.top(_bm25_docs(spark, d), 5).join(S.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    e = best.select("query_id").distinct().select("query_id", F.concat(F.lit("item "), "query_id").alias("entity"), F.lit("a thing").alias("description"), F.array(*(F.lit(f"r{k}") for k in range(1, 8))).alias("edges"))
    out = R.context(best.select("query_id", (F.col("doc_id") % 9).alias("chapter"), F.col("doc_id").alias("position"), "text"), e)
    return out.select("query_id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("size"))


@query(f"""WITH {BM25_DOCS}, a AS ({_top_sql('s', 30)}), {DENSE}, c AS ({_top_sql('v', 30)}), z AS (SELECT query_id, doc_id, CAST(sum(CAST(p AS DECIMAL(38, 12))) AS DOUBLE) AS score FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS p FROM a UNION ALL SELECT query_id, doc_id, 0.4::DOUBLE / (60 + rank) FROM c) GROUP BY ALL), r AS ({_top_sql('z', 10)}) SELECT * FROM r""")
def multi_hop_merge(spark, d):
    """What the second hop finds weighs 0.4."""
    return V.fuse([(V.top(_bm25_docs(spark, d), 30), 1.0), (V.top(_dense(spark, d, 30), 30), 0.4)], 10)


@query(f"WITH {BM25_DOCS}, r AS ({_top_sql('s', 10)}) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 30, doc_id) AS INT) AS place FROM r")
def temporal_sort(spark, d):
    """For a question about time the passages go by chapter and place."""
    from pyspark.sql import Window as W

    best = V.top(_bm25_docs(spark, d), 10)
    return best.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("doc_id") % 30, "doc_id")).alias("place"))


# --- exports ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {LABELLED} SELECT 'CREATE (:' || label || ' {{"id":"' || id || '","name":"' || name || '"}});' AS line FROM n
    UNION ALL SELECT 'MATCH (a {{name: "' || src || '"}}), (b {{name: "' || dst || '"}}) CREATE (a)-[:' || rel || CASE WHEN chapter IS NULL THEN '' ELSE ' {{"chapter":' || chapter || '}}' END || ']->(b);' FROM e""")
def export_cypher(spark, d):
    return E.statements(S.nodes(spark, d), S.edges(spark, d))


@query(f"""WITH {LABELLED}, l AS (SELECT 0 AS part, '{{"@context":{{"@vocab":"https://schema.org/"}},"@graph":[' AS line UNION ALL SELECT 1, '{{"@type":"' || label || '","name":"' || name || '"' || CASE WHEN label = 'Nation' THEN ',"description":"a land"' ELSE '' END || '}}' FROM n
    UNION ALL SELECT 2, '{{"@type":"Relationship","source":"' || src || '","predicate":"' || rel || '","target":"' || dst || '"}}' FROM e UNION ALL SELECT 3, ']}}') SELECT CAST(part AS INT) AS part, line FROM l""")
def export_json_ld(spark, d):
    nodes = S.nodes(spark, d).withColumn("summary", F.when(F.col("label") == "Nation", "a land"))
    return E.json_ld(nodes, S.edges(spark, d), {"@vocab": "https://schema.org/"})


@query(f"""WITH {LABELLED} SELECT 'entities' AS file, 0 AS part, 'name,type,summary' AS line UNION ALL SELECT 'entities', 1, '"' || replace(name, '"', '""') || '","' || label || '",""' FROM n UNION ALL SELECT 'relationships', 0, 'source,relationship,target' UNION ALL SELECT 'relationships', 1, '"' || src || '","' || rel || '","' || dst || '"' FROM e""")
def export_csv_files(spark, d):
    return E.csv_files(S.nodes(spark, d).withColumn("summary", F.lit(None).cast("string")), S.edges(spark, d))


# --- small things -----------------------------------------------------------------------------------------------------


@query("SELECT n_name AS name, 'Nation' AS entity_type, n_nationkey AS ord FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'Late', n_nationkey FROM nation WHERE n_nationkey % 2 = 1")
def coverage_merge(spark, d):
    n = S.read(spark, d, "nation")
    found = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit("Nation").alias("entity_type"), F.col("n_nationkey").alias("ord"))
    more = n.select(F.upper("n_name").alias("name"), F.lit("Late").alias("entity_type"), (F.col("n_nationkey") + 100).alias("ord")).unionByName(n.select(F.col("n_name").alias("name"), F.lit("Late").alias("entity_type"), F.col("n_nationkey").alias("ord")))
    return R.coverage(found, more)


@query("SELECT o_orderkey AS id, 'Customer ' || (o_custkey % 9) || ',nobody' AS participants FROM orders")
def resolved_participants(spark, d):
    o = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.concat(F.lit("C"), F.col("o_custkey") % 9), F.lit("nobody")).alias("participants"))
    aliases = spark.createDataFrame([(f"c{k}", f"Customer {k}") for k in range(9)], "name string, canonical string")
    return R.resolved_participants(o, aliases, "participants").withColumn("participants", F.array_join("participants", ","))


@query("SELECT 'type' AS what, r_name AS name, CASE WHEN r_regionkey < 3 THEN 'core' ELSE 'induced' END AS layer FROM region UNION ALL SELECT 'relation', n_name, CASE WHEN n_nationkey < 3 THEN 'core' ELSE 'new' END FROM nation WHERE n_nationkey < 3 OR n_regionkey <> 2")
def ontology_extension(spark, d):
    """Types and relations induced at run time; a relation to a type that nobody knows goes."""
    r, n = S.read(spark, d, "region"), S.read(spark, d, "nation")
    types = r.where("r_regionkey < 3").select(F.col("r_name").alias("name"), F.lit("core").alias("layer"))
    relations = n.where("n_nationkey < 3").select(F.col("n_name").alias("name"), F.lit("x").alias("src"), F.lit("y").alias("dst"), F.lit("core").alias("layer"))
    given = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("src"), F.when(F.col("n_regionkey") == 2, "nothing").otherwise(F.col("r_name")).alias("dst"), F.lit("new").alias("layer"))
    t, rel = R.extended(types, relations, r.select(F.col("r_name").alias("name")), given)
    return t.select(F.lit("type").alias("what"), "name", "layer").unionByName(rel.select(F.lit("relation").alias("what"), "name", "layer"))


@query("""SELECT n_name AS name, 0 AS layer, CASE WHEN n_nationkey % 2 = 0 THEN 'later' ELSE 'first' END AS description, CASE WHEN n_nationkey % 2 = 0 THEN 'a=2,b=1,c=3' ELSE 'a=1,b=1' END AS properties, CASE WHEN n_nationkey % 2 = 0 THEN 'u,v' ELSE 'u' END AS constraints FROM nation""")
def ontology_layers(spark, d):
    """Two layers of an ontology: the second overrides a property, adds one and a constraint, and replaces the description."""
    n = S.read(spark, d, "nation")
    one = n.select(F.col("n_name").alias("name"), F.lit("first").alias("description"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")).alias("properties"), F.array(F.lit("u")).alias("constraints"))
    two = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit("later").alias("description"), F.create_map(F.lit("a"), F.lit("2"), F.lit("c"), F.lit("3")).alias("properties"), F.array(F.lit("v")).alias("constraints"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda x: F.concat_ws("=", x.key, x.value)), ",")
    return R.layered([one, two]).select("name", "layer", "description", shown.alias("properties"), F.array_join("constraints", ",").alias("constraints"))


@query(f"WITH {PARTS}, t AS (SELECT book * 1000 + chapter AS chapter, length(string_agg(text, chr(10) || chr(10) ORDER BY seq)) // 4 AS n FROM p GROUP BY book, p.chapter) SELECT chapter, round((2 * n * 2.5 + 500 * 10.0) / 1e6, 6)::DOUBLE AS cost FROM t")
def chapter_costs(spark, d):
    return R.chapter_cost(told(spark, d).select((F.col("book") * 1000 + F.col("chapter")).alias("chapter"), "text"), 2.5, 10.0, 500)


@query("""SELECT event_type AS model, count(*) AS n, round(CAST(sum(CAST(round(round(value) * CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 2.0 WHEN 'purchase' THEN 4.0 ELSE 9.0 END / 1e6, 6) AS DECIMAL(20, 6))) AS DOUBLE), 6) AS cost FROM events GROUP BY 1""")
def model_costs(spark, d):
    """Prices by exact name, by the longest part of the name, or the default."""
    e = S.read(spark, d, "events")
    shown = F.when(F.col("event_type") == "view", "view-2024").when(F.col("event_type") == "purchase", "big-purchase-x").otherwise(F.col("event_type"))
    used = R.priced(e.select("event_type", shown.alias("model"), F.round("value").alias("tokens")), [("click", 1.0), ("view", 2.0), ("purchase", 4.0), ("pur", 7.0)], 9.0)
    return used.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("cost").cast("decimal(20,6)")).cast("double"), 6).alias("cost"))


@query("""WITH r AS (SELECT l_shipdate, l_orderkey, l_linenumber, l_returnflag AS chapter, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_linestatus = 'O') - 1 AS place, greatest(1, count(*) OVER (PARTITION BY l_returnflag) // 10) AS step, l_linestatus = 'O' AS inferable FROM lineitem),
    s AS (SELECT * FROM r WHERE place % step = 0 AND place // step < 10) SELECT chapter, count(*) AS facts, CAST(sum(CAST(inferable AS INT)) AS BIGINT) AS inferable, round(sum(CAST(inferable AS INT)) / count(*)::DOUBLE, 3) AS score FROM s GROUP BY ROLLUP (chapter)""")
def mine_scores(spark, d):
    """Ten facts a chapter at even steps, and how many can be inferred."""
    li = S.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("chapter"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"), (F.col("l_linestatus") == "O").alias("inferable"))
    return R.mine_scores(R.sampled_evenly(li, "chapter", ["ord", "inferable"], 10))


@query("SELECT n_nationkey AS id, 'a fact of ' || n_name AS fact FROM nation UNION ALL SELECT n_nationkey, 'another of ' || n_name FROM nation")
def fact_lines(spark, d):
    text = F.concat(F.lit("1. a fact of "), "n_name", F.lit("\n short\n- another of "), "n_name", F.lit("\n3) one too many here"))
    return S.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.explode(R.fact_lines(text, 2)).alias("fact"))


@query(f"WITH {LABELLED} SELECT 'node' AS what, label AS type, count(*) AS n FROM n WHERE label IN ('Nation', 'Region') GROUP BY 2 UNION ALL SELECT 'edge', rel, count(*) FROM e WHERE rel = 'IN_REGION' GROUP BY 2")
def extraction_reset(spark, d):
    nodes, edges = R.after_deletes(S.nodes(spark, d), S.edges(spark, d), ["Nation", "Region"])
    return G.label_counts(nodes, edges).withColumnRenamed("kind", "what")


@query("SELECT n_nationkey AS id, n_name AS title, CASE WHEN n_nationkey % 3 = 0 THEN '<p>' || n_name || '</p>' ELSE 'old' END AS html FROM nation")
def xhtml_backfill(spark, d):
    n = S.read(spark, d, "nation")
    stored = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit("old").alias("html"))
    return R.backfilled(stored, n.where("n_nationkey % 3 = 0").select(F.concat(F.lit(" "), F.lower("n_name")).alias("title"), F.concat(F.lit("<p>"), "n_name", F.lit("</p>")).alias("html")))


@query()
def clustered_names(spark, d):
    """Part names merged by type until nothing changes; a test holds the rules."""
    p = S.read(spark, d, "part").select(F.col("p_brand").alias("entity_type"), F.col("p_name").alias("name"))
    return R.clustered(p, spark.createDataFrame([], "src string, dst string"))[0]


# --- streams ----------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, count(*) AS turns, CAST(min(turn) FILTER (r <= 20) AS BIGINT) AS first_kept, CAST(least(count(*), 20) AS INT) AS kept, count(*) // 5 AS summaries FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) GROUP BY 1")
def stream_conversation_memory(spark, d):
    from skein import streaming as ST

    memory = ST.finish(ST.conversation_memory(ST.table(spark, d, "conversations").select("conv_id", "turn", "role")), "update")
    return memory.groupBy("conv_id").agg(*(F.max_by(c, "turns").alias(c) for c in memory.columns if c != "conv_id"))


@query("SELECT event_id, 'negative' AS reason FROM events WHERE event_id % 9 = 4 AND event_id % 2 = 0")
def dead_letter_retry(spark, d):
    """Rows that fail go to a queue with their reason; those that have been done since are not tried again."""
    from skein import streaming as ST

    e = S.read(spark, d, "events").select("event_id", "event_type")
    _, queue = ST.dead_letters(e, F.col("event_id") % 9 != 4, F.lit("negative"))
    done = e.where("event_id % 2 = 1").select("event_id")
    return ST.retried(queue, done, "event_id long, event_type string", "event_id").select("event_id", F.lit("negative").alias("reason"))


@query(f"WITH {X}, r AS (SELECT lower(trim(name)) AS name, min(chapter) AS first_chapter, max(chapter) AS last_seen, count(*) AS occurrences FROM x GROUP BY 1) SELECT * FROM r")
def registry_fold(spark, d):
    """The registry that a chapter-at-a-time fold carries: three batches of chapters, one upsert each."""
    x = extraction(spark, d).select(F.lower(F.trim("name")).alias("name"), "seq", F.col("chapter").alias("first_chapter"), F.col("chapter").alias("last_seen"), F.lit(1).cast("long").alias("occurrences"))
    state, policies = None, {"first_chapter": "first", "last_seen": "last", "occurrences": "total"}
    for low, high in ((0, 10), (10, 20), (20, 99)):
        state = U.merge(state, x.where((F.col("first_chapter") > low) & (F.col("first_chapter") <= high)), ["name"], policies)
    return state
