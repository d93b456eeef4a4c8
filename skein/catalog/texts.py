"""Text structure, facts and checks: on documents, and on chapters written from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import sources as S
from skein.catalog.core import LINES
from skein.catalog.registered import query
from skein.catalog.upserts import X, extraction
from skein.operators import chapters as C
from skein.operators import facts as K

#: Chapters of a book: a paragraph an event, of nine kinds.
SAID = """CASE event_id % 9 WHEN 0 THEN '[Skill Acquired: ' || name || ' - ' || 'r' || (k % 5) || ']' WHEN 1 THEN 'Level: ' || k || ' -> ' || (k + 1) WHEN 2 THEN 'Class: ' || name || ' (tier ' || k || ')'
    WHEN 3 THEN '[Title earned: ' || name || ']' WHEN 4 THEN '+' || (k % 10 + 1) || ' Strength' WHEN 5 THEN '"Go now," dit Mara Ilen. We ran.' WHEN 6 THEN 'The next morning Jorun looked at the sky! He walked on?' WHEN 7 THEN '***'
    ELSE 'Belka thought of ' || name || '.' END"""
PARTS = f"{X}, s AS (SELECT book, chapter, seq, {SAID} AS text, event_id % 9 AS sort FROM x), p AS (SELECT *, row_number() OVER (PARTITION BY book, chapter ORDER BY seq) - 1 AS position FROM s)"
KIND = "CASE sort WHEN 0 THEN 'blue_box' WHEN 3 THEN 'blue_box' WHEN 5 THEN 'dialogue' WHEN 7 THEN 'scene_break' ELSE 'narration' END"


def parts(spark, d):
    return extraction(spark, d).select("book", "chapter", "seq", F.expr(SAID).alias("text"), (F.col("event_id") % 9).alias("sort"))


def told(spark, d):
    """(book, chapter, text): paragraphs in order with blank lines between."""
    return C.full_text(parts(spark, d), ["book", "chapter"], "seq", "\n\n")


def paragraphs(spark, d):
    """(doc_id = book * 1000 + chapter, position, text, kind) read back from the chapters' texts."""
    read = lambda t: [(i, p, C.kind_of(p)) for i, (p, _, _) in enumerate(C.paragraphs(t))]
    return C.read_each(told(spark, d), "text", read, "position int, text string, kind string", ["book", "chapter"]).withColumn("doc_id", F.col("book") * 1000 + F.col("chapter"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CAST(doc_id AS INT) WHEN 1 THEN 7 WHEN 2 THEN 0 WHEN 3 THEN 9999 WHEN 4 THEN 20 ELSE 0 END AS number FROM documents")
def chapter_numbers(spark, d):
    from skein.operators.text import chapter_number

    i = F.col("doc_id")
    raw = F.when(i % 6 == 0, F.concat(F.lit(" "), i.cast("string"))).when(i % 6 == 1, " SEVEN ").when(i % 6 == 2, "Prologue").when(i % 6 == 3, "epilogue").when(i % 6 == 4, "twenty").otherwise("forty")
    return S.read(spark, d, "documents").select("doc_id", chapter_number(raw).alias("number"))


@query(f"WITH {PARTS} SELECT book, chapter, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM p GROUP BY ALL")
def chapter_text(spark, d):
    return told(spark, d)


@query(f"""WITH {PARTS}, n AS (SELECT book, chapter, position, text, {KIND} AS kind, CAST(sum(length(text) + 2) OVER (PARTITION BY book, chapter ORDER BY position) AS BIGINT) AS stop,
    max(position) OVER (PARTITION BY book, chapter) AS last FROM p) SELECT book, chapter, position, text, kind, stop - length(text) - 2 AS start, CASE WHEN position = last THEN stop - 2 ELSE stop - 2 END AS stop FROM n""")
def paragraph_offsets(spark, d):
    read = lambda t: [(i, p, C.kind_of(p), a, b) for i, (p, a, b) in enumerate(C.paragraphs(t))]
    return C.read_each(told(spark, d), "text", read, "position long, text string, kind string, start long, stop long", ["book", "chapter"])


@query(f"""WITH {PARTS} SELECT book, chapter, position, {KIND} AS kind, CASE WHEN sort = 5 THEN 'Mara Ilen' END AS speaker, CASE sort WHEN 5 THEN 2 WHEN 6 THEN 2 ELSE 1 END AS sentences, len(regexp_split_to_array(trim(text), '\\s+')) AS words FROM p""")
def markdown_paragraphs(spark, d):
    rows = C.read_each(told(spark, d), "text", C.markdown_paragraphs, "position long, kind string, text string, start int, stop int, speaker string, sentences int, words long", ["book", "chapter"])
    return rows.select("book", "chapter", "position", "kind", "speaker", "sentences", "words")


@query(f"WITH {PARTS} SELECT book, chapter, position, 'Mara Ilen' AS speaker FROM p WHERE sort = 5")
def speakers(spark, d):
    from pyspark.sql import Window as W

    rows = parts(spark, d).withColumn("position", (F.row_number().over(W.partitionBy("book", "chapter").orderBy("seq")) - 1).cast("long"))
    return rows.select("book", "chapter", "position", F.regexp_extract("text", C.SPEAKER, 1).alias("speaker")).where("speaker <> ''")


BOXES = f"""{PARTS}, b AS (SELECT *, CASE WHEN position - lag(position) OVER w - 1 > 1 THEN 1 ELSE 0 END AS new FROM p WHERE sort IN (0, 3) WINDOW w AS (PARTITION BY book, chapter ORDER BY position)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY book, chapter ORDER BY position) AS run FROM b)"""


@query(f"""WITH {BOXES} SELECT book * 1000 + chapter AS doc_id, CAST(min(position) AS INT) AS first, CAST(max(position) AS INT) AS last, count(*) AS paragraphs, string_agg(text, chr(10) ORDER BY position) AS text,
    CASE WHEN count(DISTINCT sort) = 2 THEN 'mixed' WHEN min(sort) = 0 THEN 'skill_acquisition' ELSE 'title' END AS box_type FROM r GROUP BY book, chapter, run""")
def blue_boxes(spark, d):
    return C.blue_boxes(paragraphs(spark, d).select("doc_id", "position", "text", "kind"))


@query(f"""WITH {PARTS} SELECT book, chapter, CASE sort WHEN 0 THEN 'skill_acquired' WHEN 1 THEN 'level_up' WHEN 2 THEN 'class_obtained' WHEN 3 THEN 'title_earned' ELSE 'stat_increase' END AS pattern, count(*) AS n,
    CAST(sum(length(text) - CASE sort WHEN 1 THEN 0 ELSE 0 END) AS BIGINT) AS characters FROM p WHERE sort <= 4 GROUP BY ALL""")
def regex_facts(spark, d):
    """Matches by pattern; those of titles end with their bracket, all others with their line."""
    rows = K.extracted(told(spark, d), ["book", "chapter"])
    return rows.groupBy("book", "chapter", "pattern").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("characters"))


@query(f"WITH {PARTS}, f AS (SELECT book, chapter, seq, name FROM x WHERE event_id % 9 = 3) SELECT book, chapter, string_agg(name, ',' ORDER BY seq) AS titles, count(*) AS n FROM f GROUP BY ALL")
def regex_fact_fields(spark, d):
    rows = K.extracted(told(spark, d), ["book", "chapter"]).where("pattern = 'title_earned'")
    named = F.transform(F.array_sort(F.collect_list(F.struct("start", F.col("fields")["name"].alias("name")))), lambda x: x["name"])
    return rows.groupBy("book", "chapter").agg(F.array_join(named, ",").alias("titles"), F.count("*").alias("n"))


@query(f"""WITH {PARTS} SELECT book, chapter, CASE sort WHEN 1 THEN 'progression' WHEN 2 THEN 'labeled_value' WHEN 4 THEN 'stat_gain' ELSE 'bracketed' END AS shape, count(*) AS n FROM p WHERE sort <= 4 GROUP BY ALL""")
def structural_shapes(spark, d):
    rows = C.read_each(told(spark, d), "text", K.shapes, "shape string, text string, start int, stop int", ["book", "chapter"])
    return rows.groupBy("book", "chapter", "shape").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 1 THEN true ELSE (length(t) - length(replace(t, chr(10), '')) > 5 AND len(l) > 10 AND len(list_filter(l, lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) < 80)) > len(l) * 0.8) END AS boilerplate
    FROM (SELECT doc_id, coalesce(text, '') AS t, string_split(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), chr(10)) AS l FROM documents)""")
def boilerplate_pages(spark, d):
    i = F.col("doc_id") % 4
    name = F.when(i == 0, "OEBPS/toc.xhtml").otherwise("OEBPS/part1.xhtml")
    head = F.when(i == 1, "Table of  Contents").otherwise("A Day")
    return S.read(spark, d, "documents").select("doc_id", C.is_boilerplate(name, head, F.coalesce("text", F.lit(""))).alias("boilerplate"))


@query("""SELECT doc_id, doc_id % 5 = 0 OR (len(l) > 5 AND len(list_filter(l, lambda x: starts_with(x, 'chapter'))) * 1.0 / greatest(len(l), 1) > 0.4) AS skipped FROM (SELECT doc_id,
    list_filter(list_transform(string_split(CASE WHEN doc_id % 5 = 1 THEN replace(coalesce(text, ''), chr(10), chr(10) || 'Chapter 1' || chr(10)) ELSE coalesce(text, '') END, chr(10)), lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '') AS l FROM documents)""")
def non_content_chapters(spark, d):
    i = F.col("doc_id") % 5
    t = F.coalesce("text", F.lit(""))
    listed = F.when(i == 1, F.replace(t, F.lit("\n"), F.lit("\nChapter 1\n"))).otherwise(t)
    return S.read(spark, d, "documents").select("doc_id", C.is_no_chapter(F.when(i == 0, " Sommaire").otherwise("One"), listed).alias("skipped"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '"aha" I said ' ELSE 'Mira felt it. Jon knew. Mira knew. ' END || coalesce(text, '') AS t FROM documents),
    q AS (SELECT doc_id, t, list_sum(list_transform(regexp_extract_all(t, '"[^"]{2,}"'), lambda x: length(x))) AS quoted FROM t)
    SELECT doc_id, round_even(coalesce(quoted, 0) * 1.0 / length(t), 3)::DOUBLE AS dialogue_ratio, CASE WHEN regexp_matches(t, '\\bI\\s+(said|thought|felt|knew|saw|heard|wondered)\\b') THEN '(first-person)' ELSE 'Mira' END AS pov, 1 AS scene_count FROM q""")
def chapter_style(spark, d):
    i = F.col("doc_id") % 3
    t = F.concat(F.when(i == 0, '"aha" I said ').otherwise("Mira felt it. Jon knew. Mira knew. "), F.coalesce("text", F.lit("")))
    return S.read(spark, d, "documents").select("doc_id", *C.style(t))


@query(f"""WITH {PARTS}, c AS (SELECT book * 1000 + chapter AS doc_id, count(*) FILTER (sort = 8) AS thinkers, count(*) FILTER (sort = 7 AND position > 0) AS breaks FROM p GROUP BY book, chapter)
    SELECT doc_id, 'pov' AS feature, 'Belka' AS value FROM c WHERE thinkers > 0 UNION ALL SELECT doc_id, 'pacing', 'some' FROM c""")
def textual_features(spark, d):
    """Rows of the style of each chapter; here with the value of pacing as found or not."""
    styled = told(spark, d).select((F.col("book") * 1000 + F.col("chapter")).alias("doc_id"), *C.style(F.col("text")))
    rows = C.style_rows(styled, "doc_id").where("feature <> 'dialogue_density'")
    return rows.withColumn("value", F.when(F.col("feature") == "pacing", F.when(F.col("value").cast("int") >= 1, "some").otherwise("none")).otherwise(F.col("value")))


@query("""WITH RECURSIVE s(doc_id, t, k, start, stop) AS (SELECT doc_id, coalesce(text, ''), 0, 0, CASE WHEN length(coalesce(text, '')) <= 300 THEN length(coalesce(text, '')) ELSE 300 END FROM documents
    UNION ALL SELECT doc_id, t, k + 1, stop, least(stop + 300, length(t)) FROM s WHERE stop < length(t)) SELECT doc_id, count(*) AS segments, CAST(sum(stop - start) AS BIGINT) AS characters FROM (SELECT doc_id, start, stop FROM s) GROUP BY doc_id""")
def text_segments(spark, d):
    """Texts without line ends cut to 300 characters."""
    docs = S.read(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    rows = C.read_each(docs, "text", lambda t: C.segments(t, 300), "position int, part string, start int", ["doc_id"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum(F.length("part")).alias("characters"))


@query()
def chapter_chunks(spark, d):
    """Chunks of the chapters written from events; tests hold the chunker by hand and by its rules."""
    return C.read_each(told(spark, d), "text", C.chunks, "position int, chunk string, start int, stop int, tokens int, scene_break boolean", ["book", "chapter"])


@query(f"WITH {PARTS}, b AS (SELECT book, chapter, count(*) FILTER (sort = 6 AND position > 0) AS jumps FROM p GROUP BY ALL) SELECT book, chapter, jumps FROM b")
def scene_boundaries(spark, d):
    """Of the scenes found in each chapter, those at a jump in time."""
    rows = C.read_each(told(spark, d), "text", lambda t: [(t[a : a + 16],) for a in C.scenes(t)], "begins string", ["book", "chapter"])
    jumps = rows.where("begins = 'The next morning'").groupBy("book", "chapter").agg(F.count("*").alias("jumps"))
    return told(spark, d).select("book", "chapter").join(jumps, ["book", "chapter"], "left").fillna(0, ["jumps"])


@query()
def html_paragraphs(spark, d):
    """Typed paragraphs of every page; a test holds them by hand."""
    return C.read_each(S.read(spark, d, "pages"), "html", C.html_paragraphs, "position int, kind string, text string, start int, stop int, speaker string, sentences int, words int", ["page_id"])


@query()
def router_passes(spark, d):
    """Passes and hints of every document; a test counts the words by a plain expression."""
    docs = S.read(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 10 == 0).alias("has_facts"))
    return K.routed(docs).select("doc_id", "passes", "hints")


ENTITIES = """SELECT lower(name) AS canonical, name, kind AS entity_type, [upper(left(kind, 1)) || 'x' || k, ' a '] AS aliases FROM (SELECT DISTINCT event_type || ' ' || (CAST(json_extract_string(props, '$.k') AS INT) % 10) AS name, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k FROM events)"""


@query(f"WITH {PARTS} SELECT s.book, s.chapter, x.name AS entity, x.kind AS entity_type, 'direct_name' AS way, count(*) AS n FROM s JOIN x USING (seq) WHERE s.sort IN (0, 2, 3, 8) GROUP BY ALL")
def detected_mentions(spark, d):
    """Names of things found in the chapters as whole words."""
    x = extraction(spark, d).select(F.col("name").alias("canonical"), "name", F.col("kind").alias("entity_type"), F.array(F.concat(F.upper(F.left("kind", F.lit(1))), F.lit("x"), F.col("k") % 10), F.lit(" a ")).alias("aliases")).distinct()
    return K.mentioned(told(spark, d), ["book", "chapter"], x).groupBy("book", "chapter", "entity", "entity_type", "way").agg(F.count("*").alias("n"))


@query(f"""WITH {PARTS}, o AS (SELECT *, CAST(sum(length(text) + 2) OVER (PARTITION BY book, chapter ORDER BY position) AS BIGINT) - 2 AS stop FROM p)
    SELECT book, chapter, position, CASE position % 3 WHEN 0 THEN 'exact' WHEN 1 THEN CASE WHEN sort = 7 THEN 'fuzzy' ELSE 'fuzzy' END ELSE 'unaligned' END AS alignment FROM o WHERE sort = 6 AND position % 3 <> 1""")
def grounded_quotes(spark, d):
    """Quotes said to be where they are, or that stand nowhere."""
    rows = C.read_each(told(spark, d), "text", lambda x: [(i, p, a, b) for i, (p, a, b) in enumerate(C.paragraphs(x))], "position long, quote string, start int, stop int", ["book", "chapter"])
    asked = rows.where("quote LIKE 'The next morning%' AND position % 3 <> 1").withColumn("quote", F.when(F.col("position") % 3 == 2, "§§§§§§§§§§§§§§§§§§").otherwise(F.col("quote")))
    return K.grounded(asked, told(spark, d), ["book", "chapter"]).select("book", "chapter", "position", "alignment")


@query(f"""WITH {X}, m AS (SELECT book, chapter, name AS entity, (event_id % 50) * 10 AS start, (event_id % 50) * 10 + length(name) AS stop FROM x), c AS (SELECT unnest(range(0, 6)) AS position)
    SELECT book, chapter, entity, CAST(position AS INT) AS position, count(*) AS n FROM m, c WHERE start >= position * 90 AND stop <= position * 90 + 110 GROUP BY ALL""")
def derived_grounding(spark, d):
    """Mentions in overlapping chunks of 110 characters that begin every 90."""
    x = extraction(spark, d)
    m = x.select("book", "chapter", F.col("name").alias("entity"), (F.col("event_id") % 50 * 10).alias("start"), (F.col("event_id") % 50 * 10 + F.length("name")).alias("end"))
    chunks = x.select("book", "chapter").distinct().withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("chunk_start", F.col("position") * 90).withColumn("chunk_end", F.col("position") * 90 + 110)
    return K.derived_grounding(m, chunks).groupBy("book", "chapter", "entity", "position").agg(F.count("*").alias("n"))


NOISE = """SELECT * FROM (VALUES ('Il', 'character', 'pronoun'), ('n/a', 'item', 'garbage'), ('x', 'skill', 'short'), ('Forest (implied)', 'location', 'parenthetical'), ('le guerrier', 'character', 'unnamed'), ('The Stranger', 'character', 'unnamed'),
    ('Jake''s girlfriend', 'character', 'unnamed'), ('Mira', 'character', NULL), ('ash', 'character', 'lower_case'), ('mira', 'character', NULL), ('une épée', 'item', 'unnamed'), ('sword', 'item', 'lower_case'), ('Sunblade', 'item', NULL), ('la forêt', 'location', 'unnamed'),
    ('Ashford', 'location', NULL), ('magic', 'concept', 'general'), ('Magic', 'concept', 'general'), ('Soulweave', 'concept', NULL), ('the soldiers', 'faction', 'unnamed'), ('Order of Ash', 'faction', NULL), ('he walked away', 'event', 'unnamed'), ('Fall of Ash', 'event', NULL),
    ('skill with swords', 'skill', 'unnamed'), ('leap', 'skill', 'lower_case'), ('maîtrise de l''épée', 'skill', 'unnamed'), ('rat', 'creature', 'lower_case'), ('wyrm', 'creature', NULL)) AS t(name, kind, reason)"""


@query(f"WITH n AS ({NOISE}) SELECT name, kind, reason, count(*) AS n FROM n, nation GROUP BY ALL")
def entity_noise(spark, d):
    """Names of each type and why they are rejected, once for each nation."""
    import re

    rows = [(a.replace("''", "'"), b) for a, b in re.findall(r"\('((?:[^']|'')*)', '(\w+)', (?:'\w+'|NULL)\)", NOISE)]
    listed = F.array(*(F.struct(F.lit(a).alias("name"), F.lit(b).alias("kind")) for a, b in rows))
    names = S.read(spark, d, "nation").select(F.explode(listed).alias("x")).select("x.name", "x.kind")
    return names.withColumn("reason", K.rejected(F.col("name"), F.col("kind"))).groupBy("name", "kind", "reason").agg(F.count("*").alias("n"))


VERIFIED = f"""WITH {PARTS}, t AS (SELECT book, chapter, lower(string_agg(text, chr(10) || chr(10) ORDER BY seq)) AS text FROM p GROUP BY ALL),
    e AS (SELECT x.book * 1000 + x.chapter AS chapter, seq, CASE k % 6 WHEN 0 THEN 'Belka' WHEN 1 THEN 'Guard' WHEN 2 THEN 'Belka rises' WHEN 3 THEN 'Quill Zzyx' WHEN 4 THEN 'sky' ELSE name END AS name,
        CASE k % 6 WHEN 0 THEN 'character' WHEN 1 THEN 'character' WHEN 2 THEN 'event' WHEN 3 THEN 'item' WHEN 4 THEN 'setting' ELSE 'character_feature' END AS entity_type, k % 6 AS sort, t.text AS body, x.name AS own FROM x JOIN t ON x.book = t.book AND x.chapter = t.chapter)
    SELECT chapter, seq, name, CASE sort WHEN 0 THEN CASE WHEN contains(body, 'belka') THEN NULL ELSE 'name_not_in_text' END WHEN 1 THEN 'name_not_in_text' WHEN 2 THEN 'name_not_in_text' WHEN 3 THEN 'name_not_in_text'
        WHEN 4 THEN CASE WHEN contains(body, 'sky') THEN NULL ELSE 'name_not_in_text' END ELSE CASE WHEN contains(body, lower(own)) THEN 'golem_missing_character_ref' ELSE 'name_not_in_text' END END AS reason FROM e WHERE sort <> 2"""


@query(VERIFIED)
def verified_entities(spark, d):
    x = extraction(spark, d)
    m = F.col("k") % 6
    pick = lambda *v: F.element_at(F.array(*(F.lit(a) if isinstance(a, str) else a for a in v)), m + 1)
    e = x.select((F.col("book") * 1000 + F.col("chapter")).alias("chapter"), "seq", pick("Belka", "Guard", "Belka rises", "Quill Zzyx", "sky", F.col("name")).alias("name"), pick("character", "character", "event", "item", "setting", "character_feature").alias("entity_type"), F.lit("").alias("character"), F.lit("").alias("role_type"), F.array().cast("array<string>").alias("participants"), m.alias("sort"))
    c = told(spark, d).select((F.col("book") * 1000 + F.col("chapter")).alias("chapter"), "text")
    out = K.verified(e, c, spark.createDataFrame([("belka",), ("Jorun",)], "name string"))
    return out.where("sort <> 2").select("chapter", "seq", "name", "reason")


@query("""WITH r AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'knows' WHEN 1 THEN 'HAS_SKILL' WHEN 2 THEN 'a very long relation that nobody would write' WHEN 3 THEN 'A B C D E F G' ELSE 'Lives In' END AS rel FROM supplier)
    SELECT k, rel, replace(upper(rel), ' ', '_') AS type FROM r WHERE k % 5 IN (0, 1, 4)""")
def relation_types(spark, d):
    m = F.col("s_suppkey") % 5
    rel = F.element_at(F.array(*map(F.lit, ("knows", "HAS_SKILL", "a very long relation that nobody would write", "A B C D E F G", "Lives In"))), (m + 1).cast("int"))
    return K.clean_relation_types(S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), rel.alias("rel")))


@query("SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'LIVES_IN' WHEN 1 THEN 'MEMBER_OF' ELSE 'odd one' END AS rel FROM supplier")
def coerced_types(spark, d):
    m = F.col("s_suppkey") % 3
    raw = F.when(m == 0, "lives in").when(m == 1, "Member-Of ").otherwise("odd one")
    return S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), K.coerced(raw, ["LIVES_IN", "MEMBER_OF"], raw).alias("rel"))


@query("""SELECT 'customer ' || c_custkey AS source, 'nation ' || c_nationkey AS target, CASE WHEN c_custkey % 2 = 0 THEN 'IN_NATION' ELSE 'FREE' END AS rel FROM customer WHERE c_custkey % 2 = 1 OR c_nationkey % 5 <> 0 OR c_custkey % 7 = 0""")
def domain_range(spark, d):
    """Relations whose ends have allowed types; every fifth nation is of another type, every seventh customer's is unknown."""
    c = S.read(spark, d, "customer")
    missing = F.col("c_custkey") % 7 == 0
    rel = c.select(F.concat(F.lit("customer "), "c_custkey").alias("source"), F.when(missing, F.concat(F.lit("lost "), "c_nationkey")).otherwise(F.concat(F.lit("nation "), "c_nationkey")).alias("target"), F.when(F.col("c_custkey") % 2 == 0, "IN_NATION").otherwise("FREE").alias("rel"), F.concat(F.lit("nation "), "c_nationkey").alias("shown"))
    n = S.read(spark, d, "nation").select(F.concat(F.lit("Nation "), "n_nationkey").alias("name"), F.when(F.col("n_nationkey") % 5 == 0, "Cloud").otherwise("Nation").alias("entity_type"))
    people = c.select(F.concat(F.lit("customer "), "c_custkey").alias("name"), F.lit("customer").alias("entity_type"))
    rules = spark.createDataFrame([("IN_NATION", ["customer"], ["nation"])], "rel string, from_types array<string>, to_types array<string>")
    return K.typed_relations(rel, n.unionByName(people), rules).select("source", F.col("shown").alias("target"), "rel")


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 0")
def ontology_fields(spark, d):
    c = S.read(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_name")).alias("c_name"))
    return K.valid_fields(c, ["c_name"], {"c_mktsegment": ["BUILDING", "MACHINERY"]}).drop("c_name")


@query("SELECT a.n_name AS a, b.n_name AS b, a.n_regionkey <> b.n_regionkey AS disjoint FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def disjoint_types(spark, d):
    n = S.read(spark, d, "nation")
    pairs = n.alias("a").join(n.alias("b"), F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    apart = pairs.where("a.n_regionkey <> b.n_regionkey").select(F.col("b.n_name").alias("a"), F.col("a.n_name").alias("b"))
    return K.disjoint(pairs.select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b")), apart)


@query("""SELECT doc_id, CAST(doc_id % 90 AS INT) AS chapter, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 7 AS INT) END AS position FROM documents UNION ALL SELECT doc_id, 3, NULL FROM documents""")
def answer_citations(spark, d):
    i = F.col("doc_id")
    text = F.concat(F.lit("So it is [Ch."), i % 90, F.when(i % 2 == 0, F.concat(F.lit(", p."), i % 7)).otherwise(""), F.lit("] and [Ch. 3]. See [p.4]."))
    return S.read(spark, d, "documents").select("doc_id", F.explode(K.citations(text)).alias("c")).select("doc_id", "c.*")


@query("""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents) SELECT doc_id, count(*) AS claims FROM s WHERE len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 4 GROUP BY 1""")
def answer_claims(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.explode(K.claims(F.coalesce("text", F.lit("")))).alias("c")).groupBy("doc_id").agg(F.count("*").alias("claims"))


@query("""WITH l AS (SELECT vec_id, embedding[1]::DOUBLE * 9 AS c, embedding[2]::DOUBLE * 9 AS e, embedding[3]::DOUBLE * 9 AS n FROM embeddings)
    SELECT vec_id, round((exp(e) + exp(n) * 0.5) / (exp(c) + exp(e) + exp(n)), 9) AS score, exp(c) / (exp(c) + exp(e) + exp(n)) > 0.5 AS contradicts FROM l""")
def entailment_scores(spark, d):
    c, e, n = (F.col("embedding")[i].cast("double") * 9 for i in range(3))
    return S.read(spark, d, "embeddings").select("vec_id", *K.entailment(c, e, n)).withColumn("score", F.round("score", 9))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 6 WHEN 2 THEN CAST(p_size AS INT) WHEN 3 THEN 0 END AS tier FROM part")
def tier_numbers(spark, d):
    m = F.col("p_partkey") % 5
    raw = F.when(m == 0, " d-grade").when(m == 1, "S rank").when(m == 2, F.concat(F.lit("Tier "), "p_size")).when(m == 3, "f").otherwise("???")
    return S.read(spark, d, "part").select("p_partkey", K.tier(raw).alias("tier"))


@query(f"WITH {PARTS} SELECT DISTINCT book, chapter FROM p WHERE sort = 4 AND contains(text, '+7 Strength')")
def pattern_impact(spark, d):
    return K.impact(told(spark, d), [r"^\+7\s+strength$"]).select("book", "chapter")


@query("""SELECT n_nationkey, replace(replace(n_name, '+', '\\+'), '(', '\\(') || ' OR "two words" OR a\\:b' AS q FROM nation""")
def search_phrases(spark, d):
    return S.read(spark, d, "nation").select("n_nationkey", K.fulltext_query(F.array("n_name", F.lit("two words"), F.lit("a:b"))).alias("q"))


@query("SELECT o_orderkey, CAST(o_custkey AS INT) AS answer FROM orders")
def generated_json(spark, d):
    """A model's answer: bare, in a fence, or with words around it."""
    body = F.concat(F.lit('{"answer": '), "o_custkey", F.lit("}"))
    raw = F.when(F.col("o_orderkey") % 3 == 0, body).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body, F.lit(" Done.")))
    return S.read(spark, d, "orders").select("o_orderkey", K.parsed_json(raw, "answer int").getField("answer").alias("answer"))


@query(f"WITH {LINES} SELECT doc_id, CAST(max(position) AS INT) + 1 AS lines, string_agg(text, chr(10) ORDER BY position) AS text FROM p GROUP BY 1 HAVING trim(string_agg(text, chr(10) ORDER BY position), ' ') <> ''")
def full_document_text(spark, d):
    rows = S.lines(spark, d)
    return C.full_text(rows, ["doc_id"]).join(rows.groupBy("doc_id").agg((F.max("position") + 1).alias("lines")), "doc_id")
