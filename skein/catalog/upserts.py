"""Typed upserts on the events table, read as what an extraction found chapter by chapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import sources as S
from skein.catalog.core import EDGES, NODES
from skein.catalog.registered import query
from skein.operators import upserts as U

#: Rows of an extraction: book, chapter, seq (input order) and the columns that typed upserts take.
X = """x AS (SELECT user_id % 2 AS book, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) + 1 AS chapter, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1) * 100000000 + event_id AS seq, event_id, event_type || ' ' || (CAST(json_extract_string(props, '$.k') AS INT) % 10) AS name,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE 'user ' || (user_id % 20) END AS owner, left(props, CAST(json_extract_string(props, '$.k') AS INT) % 12) AS description,
    (CAST(json_extract_string(props, '$.k') AS INT) % 10) / 10.0 AS confidence, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'r' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) END AS rank,
    CAST(round(value) AS BIGINT) AS value, 'p' || (event_id % 7) AS place, ['a' || (CAST(json_extract_string(props, '$.k') AS INT) % 5), 'b' || (event_id % 3)] AS aliases FROM events)"""


def extraction(spark, d):
    """The same rows in Spark; of each type of entity."""
    k = F.get_json_object("props", "$.k").cast("int")
    chapter = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1
    return S.read(spark, d, "events").select(
        (F.col("user_id") % 2).alias("book"), chapter.alias("chapter"), F.col("event_type").alias("kind"), k.alias("k"), (chapter.cast("long") * 100000000 + F.col("event_id")).alias("seq"), "event_id",
        F.concat("event_type", F.lit(" "), k % 10).alias("name"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("user "), F.col("user_id") % 20)).alias("owner"),
        F.left("props", k % 12).alias("description"), ((k % 10) / 10).alias("confidence"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("r"), k % 3)).alias("rank"),
        F.round("value").cast("long").alias("value"), F.concat(F.lit("p"), F.col("event_id") % 7).alias("place"), F.array(F.concat(F.lit("a"), k % 5), F.concat(F.lit("b"), F.col("event_id") % 3)).alias("aliases"),
    )


_SQL = {
    "first": "arg_min({c}, seq)", "last": "arg_max({c}, seq)", "longest": "arg_max({c}, length({c}) * 100000000000 - seq)", "largest": "max({c})", "count": "count(*)", "total": "CAST(sum({c}) AS BIGINT)",
    "union": "array_to_string(list_sort(list_distinct(flatten(list({c})))), ',')", "named": "coalesce(arg_max({c}, seq) FILTER ({c} <> ''), arg_min({c}, seq))",
}


def _entity_query(label: str) -> None:
    key, policies = U.ENTITIES[label]
    cols = ", ".join(f"{_SQL[p].format(c=c)} AS {c}" for c, p in policies.items())
    sql = f"WITH {X}, r AS (SELECT book, {', '.join(key)}, {cols} FROM x GROUP BY book, {', '.join(key)}) SELECT * FROM r"

    def run(spark, d):
        rows = extraction(spark, d)
        state = U.merge(None, rows.where("chapter <= 12"), ["book", *key], policies)
        out = U.merge(state, rows.where("chapter > 12"), ["book", *key], policies)
        return out.withColumn("aliases", F.array_join(F.array_sort("aliases"), ",")) if "aliases" in policies else out

    run.__doc__ = f"Upsert of {label} in two batches, by its policies."
    name = "".join("_" + c.lower() if c.isupper() else c for c in label).strip("_")
    query(sql, f"upsert_{name}")(run)


for _label in U.ENTITIES:
    _entity_query(_label)


def _links_sql() -> str:
    parts = []
    for rel, (src, dst, policies) in U.LINKS.items():
        kept = [_SQL[policies[c]].format(c=c) if c in policies else "NULL" for c in ("chapter", "value")]
        parts.append(f"SELECT book, CAST({src} AS VARCHAR) AS src, '{rel}' AS rel, CAST({dst} AS VARCHAR) AS dst, CAST({kept[0]} AS INT) AS chapter, CAST({kept[1]} AS BIGINT) AS value FROM x WHERE CAST({src} AS VARCHAR) <> '' AND CAST({dst} AS VARCHAR) <> '' GROUP BY book, {src}, {dst}")
    return f"WITH {X} " + " UNION ALL ".join(parts)


@query(_links_sql())
def upsert_links(spark, d):
    """The links of all upserts, in two batches: what is kept of chapter and value goes by the relation."""
    rows, out = extraction(spark, d), None
    for rel in U.LINKS:
        state = U.merge_links(None, rows.where("chapter <= 12"), rel)
        one = U.merge_links(state, rows.where("chapter > 12"), rel)
        for c, t in (("chapter", "int"), ("value", "long")):
            one = one.withColumn(c, F.col(c).cast(t) if c in one.columns else F.lit(None).cast(t))
        one = one.select("book", "src", "rel", "dst", "chapter", "value")
        out = one if out is None else out.unionByName(one)
    return out


REL = "CASE k % 4 WHEN 0 THEN 'ALLY_OF' WHEN 1 THEN 'A_VERY_LONG_TYPE_THAT_NOBODY_WOULD_WRITE' WHEN 2 THEN 'A_B_C_D_E_F' ELSE 'KNOWS' END"


@query(f"""WITH {X}, r AS (SELECT book, owner AS src, {REL} AS rel, name AS dst, chapter, seq FROM x)
    SELECT book, src, rel, dst, arg_min(chapter, seq) AS valid_from, CASE WHEN count(*) > 1 THEN arg_max(chapter, seq) END AS last_seen, count(*) AS occurrences FROM r WHERE rel IN ('ALLY_OF', 'KNOWS') GROUP BY ALL""")
def upsert_relationships(spark, d):
    rows = extraction(spark, d).select("book", F.col("owner").alias("src"), F.expr(REL).alias("rel"), F.col("name").alias("dst"), "chapter", "seq")
    return U.relations(rows)


@query(f"""WITH {X}, s AS (SELECT book, owner, name, rank, chapter, seq, row_number() OVER (PARTITION BY book, owner, name ORDER BY seq) AS nth, min(chapter) OVER (PARTITION BY book, owner, name) AS start FROM x WHERE owner <> ''),
    o AS (SELECT book, owner, name, chapter AS valid_from, first(CASE WHEN nth > 1 THEN rank END ORDER BY seq) AS rank FROM s WHERE nth = 1 OR (rank <> '' AND chapter > start) GROUP BY ALL)
    SELECT book, owner, name, rank, valid_from, CAST(lead(valid_from) OVER (PARTITION BY book, owner, name ORDER BY valid_from) - 1 AS INT) AS valid_to FROM o""")
def upsert_skill_intervals(spark, d):
    return U.skill_intervals(extraction(spark, d))


@query(f"""WITH {X}, h AS (SELECT book, owner, name, min(chapter) AS valid_from FROM x WHERE owner <> '' GROUP BY ALL)
    SELECT h.*, CAST((SELECT min(chapter) - 1 FROM x WHERE x.book = h.book AND x.owner = h.owner AND x.name <> h.name AND x.chapter > h.valid_from) AS INT) AS valid_to FROM h""")
def upsert_class_intervals(spark, d):
    return U.class_intervals(extraction(spark, d))


@query(f"""WITH {X}, c AS (SELECT book, owner, CAST(k AS BIGINT) AS level, chapter, seq FROM x WHERE owner <> '' AND kind = 'purchase'),
    e AS (SELECT c.*, (SELECT arg_min(y.chapter, y.seq) - 1 FROM c y WHERE y.book = c.book AND y.owner = c.owner AND y.seq > c.seq AND y.level > c.level) AS stop FROM c)
    SELECT book, owner, level, chapter AS valid_from, CAST(first(stop ORDER BY seq) AS INT) AS valid_to FROM e GROUP BY book, owner, level, chapter""")
def upsert_level_intervals(spark, d):
    return U.level_intervals(extraction(spark, d).where("kind = 'purchase'").withColumn("level", F.col("k")))


@query(f"""WITH {X}, c AS (SELECT book, owner, chapter, CAST(k AS INT) AS level, k % 5 AS old, seq FROM x WHERE owner <> '' AND kind = 'purchase'),
    w AS (SELECT *, row_number() OVER (PARTITION BY book, owner, chapter ORDER BY seq DESC) AS r FROM c)
    SELECT book, owner, chapter, 'level' AS name, 'gain' AS action, CASE WHEN old <> 0 AND level <> 0 THEN level - old END AS value_delta, level AS value_after FROM w WHERE r = 1""")
def upsert_level_ledger(spark, d):
    rows = extraction(spark, d).where("kind = 'purchase'").select("book", "owner", "chapter", F.col("k").alias("level"), (F.col("k") % 5).alias("old"), "seq")
    return U.level_ledger(rows)


@query(f"""WITH {X}, m AS (SELECT book, chapter, kind AS entity_type, name AS entity, k AS start, k + length(name) AS stop, repeat(name, 40) AS text FROM x)
    SELECT book, chapter, count(*) AS mention_count, CAST(sum(length(left(text, 200))) AS BIGINT) AS characters, md5(string_agg(start || ':' || stop || ':' || entity_type || ':' || entity, ',' ORDER BY start, stop, entity_type, entity)) AS digest FROM m GROUP BY ALL""")
def upsert_mentions(spark, d):
    rows = extraction(spark, d).select("book", "chapter", F.col("kind").alias("entity_type"), F.col("name").alias("entity"), F.col("k").alias("start"), (F.col("k") + F.length("name")).alias("end"), F.repeat("name", F.lit(40)).alias("text"))
    edges, summary = U.mentions_store(rows)
    size = edges.groupBy("book", "chapter").agg(F.sum(F.length("mention_text")).alias("characters"))
    told = F.transform(F.from_json("mention_data", "array<struct<start: int, end: int, entity_type: string, entity: string>>"), lambda m: F.concat_ws(":", m.start, m.end, m.entity_type, m.entity))
    return summary.join(size, ["book", "chapter"]).select("book", "chapter", "mention_count", "characters", F.md5(F.array_join(told, ",")).alias("digest"))


@query(f"""WITH {X}, e AS (SELECT book, place AS sequence, name, min(chapter) AS chapter FROM x GROUP BY ALL)
    SELECT * FROM (SELECT book, sequence, name AS src, lead(name) OVER (PARTITION BY book, sequence ORDER BY chapter, name) AS dst FROM e) WHERE dst IS NOT NULL""")
def upsert_sequence_chain(spark, d):
    return U.sequence_chain(extraction(spark, d).withColumnRenamed("place", "sequence"))


@query(f"""WITH {X}, p AS (SELECT book, owner AS source, CASE k % 5 WHEN 0 THEN 'item' WHEN 1 THEN 'class' WHEN 2 THEN 'bloodline' WHEN 3 THEN 'object' ELSE 'rumour' END AS source_type, name AS skill, confidence FROM x)
    SELECT DISTINCT book, source AS src, CASE source_type WHEN 'class' THEN 'Class' WHEN 'bloodline' THEN 'Bloodline' ELSE 'Object' END AS label, skill AS dst FROM p WHERE confidence >= 0.7 AND source_type <> 'rumour' AND source <> ''""")
def upsert_grants(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("item", "class", "bloodline", "object", "rumour"))), F.col("k") % 5 + 1)
    return U.grants(extraction(spark, d).select("book", F.col("owner").alias("source"), kind.alias("source_type"), F.col("name").alias("skill"), "confidence"))


@query(f"""WITH {X}, p AS (SELECT DISTINCT book, name AS node, owner AS participant, CASE WHEN k % 3 = 0 THEN '' ELSE place END AS cause, event_id FROM x),
    s AS (SELECT book, 'meeting ' || (event_id // 3) AS node, list_distinct(list(participant) FILTER (participant <> '')) AS who, first(cause ORDER BY event_id) AS cause FROM p GROUP BY book, event_id // 3)
    SELECT book, node, 'INVOLVED_IN' AS rel, unnest(who) AS participant FROM s WHERE len(who) >= 2 UNION ALL SELECT book, node, 'CAUSED_BY', cause FROM s WHERE len(who) >= 2 AND cause <> ''""")
def upsert_social_relations(spark, d):
    x = extraction(spark, d).withColumn("cause", F.when(F.col("k") % 3 == 0, "").otherwise(F.col("place")))
    met = x.groupBy("book", F.floor(F.col("event_id") / 3).alias("m")).agg(F.collect_list("owner").alias("participants"), F.min_by("cause", "event_id").alias("cause"))
    return U.social_relations(met.select("book", F.concat(F.lit("meeting "), "m").alias("name"), "participants", "cause"))


@query(f"WITH {X}, n AS (SELECT DISTINCT name || place AS name, book FROM x), m AS (SELECT name, count(*) AS books FROM n GROUP BY 1 HAVING count(*) > 1) SELECT n.name, n.book, books FROM n JOIN m USING (name)")
def upsert_shared_characters(spark, d):
    return U.shared_characters(extraction(spark, d).select(F.concat("name", "place").alias("name"), "book"))


GENRE = {"click": "Ability", "view": "Place", "purchase": "Artifact"}


@query(f"WITH {X} SELECT CASE kind WHEN 'click' THEN 'Ability' WHEN 'view' THEN 'Place' WHEN 'purchase' THEN 'Artifact' ELSE 'GenreEntity' END AS label, kind AS sub_type, count(*) AS n FROM x GROUP BY ALL")
def upsert_genre_entities(spark, d):
    rows = U.labelled(extraction(spark, d).select(F.concat(F.lit(" "), F.upper("kind")).alias("sub_type")), GENRE, "GenreEntity")
    return rows.groupBy("label", F.lower(F.trim("sub_type")).alias("sub_type")).agg(F.count("*").alias("n"))


@query(f"""WITH {X}, t AS (SELECT lower(trim(name)) AS name, CASE kind WHEN 'error' THEN 'Event' WHEN 'view' THEN 'Location' WHEN 'click' THEN 'Skill' ELSE 'Character' END AS label, book, chapter, seq, description, confidence FROM x)
    SELECT label, book, name, count(*) AS occurrences, min(chapter) AS first_chapter, max(confidence) AS confidence, arg_max(description, length(description) * 100000000000 - seq) AS description FROM t GROUP BY ALL""")
def upsert_dispatch(spark, d):
    """One mixed batch: names lower-cased and trimmed, sub types mapped to labels, each label upserted by its own key."""
    label = F.create_map(*(F.lit(x) for p in {"error": "Event", "view": "Location", "click": "Skill"}.items() for x in p))
    rows = extraction(spark, d).withColumn("label", F.coalesce(label[F.col("kind")], F.lit("Character"))).withColumn("name", F.lower(F.trim(F.concat(F.lit(" "), F.upper("name")))))
    shaped = rows.select("label", "book", "name", "seq", F.lit(1).alias("occurrences"), F.col("chapter").alias("first_chapter"), "confidence", "description")
    return U.merge(None, shaped, ["label", "book", "name"], {"occurrences": "count", "first_chapter": "first", "confidence": "largest", "description": "longest"})


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 7 <> 3")
def entity_patch(spark, d):
    """A patch may set the name but not the balance; deleted rows go."""
    c = S.read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    patches = c.where("c_custkey % 10 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return U.patched(c, patches, "c_custkey", ["c_name", "c_mktsegment"]).where("c_custkey % 7 <> 3")


@query(f"WITH {NODES}, {EDGES} SELECT 'node' AS kind, count(*) AS n FROM n WHERE id NOT IN ('Nation:3', 'Supplier:1') UNION ALL SELECT 'edge', count(*) FROM e WHERE src NOT IN ('Nation:3', 'Supplier:1') AND dst NOT IN ('Nation:3', 'Supplier:1')")
def entity_delete(spark, d):
    nodes, edges = U.detached(S.nodes(spark, d), S.edges(spark, d), ["Nation:3", "Supplier:1"])
    return nodes.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "n").unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "n"))


RENAMED = {"IN_NATION": "LIVES_IN", "CONTAINS": "HOLDS"}


@query(f"WITH {EDGES} SELECT CASE rel WHEN 'IN_NATION' THEN 'LIVES_IN' WHEN 'CONTAINS' THEN 'HOLDS' ELSE rel END AS rel, count(*) AS n, count(DISTINCT src) AS sources FROM e GROUP BY 1")
def relation_renames(spark, d):
    """A migration: edge types take new names, others stay."""
    new = F.create_map(*(F.lit(x) for p in RENAMED.items() for x in p))
    return S.edges(spark, d).withColumn("rel", F.coalesce(new[F.col("rel")], F.col("rel"))).groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))
