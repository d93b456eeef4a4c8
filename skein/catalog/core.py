"""The registered queries: each operator on the driver's tables, with the same in DuckDB's SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import sources as S
from skein import streaming as ST
from skein.catalog.registered import query
from skein.functions import ARTICLES, not_later, with_normal_name
from skein.operators import export as X
from skein.operators import graph as G
from skein.operators import resolve as N
from skein.operators import retrieval as R
from skein.operators import temporal as T
from skein.operators import text as P
from skein.operators.chapters import BOX_MARK, SCENE_MARK, SPEECH, chunks, read_each
from skein.plans.storage import shared_folder

LEDGER = """l AS (SELECT user_id AS character, event_type AS category, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS name,
    CAST(round(value) AS BIGINT) AS delta, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) + 1 AS chapter, event_id AS ord FROM events)"""
SPANS = """v AS (SELECT character, category, chapter, arg_max(name, ord) AS name FROM l GROUP BY ALL), u AS (SELECT *, lag(name) OVER w AS before, row_number() OVER w AS nth FROM v WINDOW w AS (PARTITION BY character, category ORDER BY chapter)),
    i AS (SELECT character, category, name, chapter AS valid_from, CAST(lead(chapter) OVER (PARTITION BY character, category ORDER BY chapter) - 1 AS INT) AS valid_to FROM u WHERE nth = 1 OR name <> before)"""
NODES = " UNION ALL ".join(
    f"SELECT '{label}:' || {key} AS id, '{label}' AS label, CAST({name} AS VARCHAR) AS name FROM {t}"
    for t, label, key, name in (("region", "Region", "r_regionkey", "r_name"), ("nation", "Nation", "n_nationkey", "n_name"), ("customer", "Customer", "c_custkey", "c_name"), ("supplier", "Supplier", "s_suppkey", "s_name"), ("part", "Part", "p_partkey", "p_name"), ("orders", "Order", "o_orderkey", "o_orderkey"))
)
NODES = f"n AS ({NODES})"
EDGES = """e AS (SELECT 'Nation:' || n_nationkey AS src, 'IN_REGION' AS rel, 'Region:' || n_regionkey AS dst, CAST(NULL AS INT) AS chapter FROM nation
    UNION ALL SELECT 'Customer:' || c_custkey, 'IN_NATION', 'Nation:' || c_nationkey, NULL FROM customer
    UNION ALL SELECT 'Supplier:' || s_suppkey, 'IN_NATION', 'Nation:' || s_nationkey, NULL FROM supplier
    UNION ALL SELECT 'Customer:' || o_custkey, 'PLACED', 'Order:' || o_orderkey, CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS INT) FROM orders
    UNION ALL SELECT 'Order:' || l_orderkey, 'CONTAINS', 'Part:' || l_partkey, NULL FROM lineitem
    UNION ALL SELECT DISTINCT 'Part:' || l_partkey, 'SUPPLIED_BY', 'Supplier:' || l_suppkey, CAST(NULL AS INT) FROM lineitem)"""
BOTH = "b AS (SELECT src AS a, rel, dst AS b, 'out' AS direction FROM e UNION ALL SELECT dst, rel, src, 'in' FROM e)"
LINES = "p AS (SELECT doc_id, CAST(i - 1 AS INT) AS position, t[i] AS text FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)))"


def normal_sql(x: str) -> str:
    out = f"lower(trim(nfc_normalize({x})))"
    for a in ARTICLES:
        out = "regexp_replace({}, '^{}', '')".format(out, a.replace("'", "''"))
    return out


# --- state in time ----------------------------------------------------------------------------------------------------


@query(f"WITH {LEDGER} SELECT character, category, name, CAST(coalesce(sum(delta), 0) AS BIGINT) AS value, max(chapter) AS last_chapter FROM l WHERE chapter <= 15 GROUP BY ALL")
def stat_ledger_asof(spark, d):
    return T.stat_ledger(S.ledger(spark, d), 15)


@query(f"WITH {LEDGER} SELECT character, chapter, ord, category, name, delta FROM l WHERE chapter <= 15 QUALIFY row_number() OVER (PARTITION BY character ORDER BY chapter DESC, ord DESC) = 1")
def level_asof(spark, d):
    return T.latest(S.ledger(spark, d), 15)


@query(f"WITH {LEDGER} SELECT character, chapter, category, name, arg_max(delta, ord) AS delta, max(ord) AS ord FROM l GROUP BY ALL")
def ledger_keyed_last_wins(spark, d):
    return T.last_wins(S.ledger(spark, d), ["character", "chapter", "category", "name"])


@query(f"WITH {LEDGER} SELECT * FROM l WHERE character = (SELECT min(character) FROM l) ORDER BY chapter, ord LIMIT 20 OFFSET 20")
def progression_page(spark, d):
    ledger = S.ledger(spark, d)
    one = ledger.join(F.broadcast(ledger.agg(F.min("character").alias("character"))), "character", "left_semi")
    return T.page(one, ["chapter", "ord"], 20, 20)


@query(f"""WITH {LEDGER}, c AS (SELECT character, category, name, CAST(coalesce(sum(delta) FILTER (chapter <= 10), 0) AS BIGINT) AS before, CAST(coalesce(sum(delta) FILTER (chapter <= 20), 0) AS BIGINT) AS after
    FROM l WHERE chapter <= 20 GROUP BY ALL) SELECT *, after - before AS change FROM c WHERE after <> before""")
def state_compare(spark, d):
    return T.compare(S.ledger(spark, d), 10, 20)


@query(f"""WITH {LEDGER} SELECT character, coalesce(string_agg(DISTINCT CAST(name AS VARCHAR), ',' ORDER BY CAST(name AS VARCHAR)) FILTER (category = 'purchase'), '') AS gained,
    coalesce(string_agg(DISTINCT CAST(name AS VARCHAR), ',' ORDER BY CAST(name AS VARCHAR)) FILTER (category = 'error'), '') AS lost
    FROM l WHERE chapter > 10 AND chapter <= 20 AND category IN ('purchase', 'error') GROUP BY character""")
def gained_lost(spark, d):
    return T.gained_lost(S.ledger(spark, d), 10, 20, "purchase", "error")


@query(f"WITH {LEDGER}, {SPANS} SELECT * FROM i")
def scd2_intervals(spark, d):
    return T.intervals(S.ledger(spark, d))


@query(f"WITH {LEDGER}, {SPANS} SELECT * FROM i WHERE valid_from <= 12 AND (valid_to IS NULL OR valid_to >= 12)")
def valid_at_closed(spark, d):
    return T.holding(T.intervals(S.ledger(spark, d)), 12)


@query(f"WITH {LEDGER}, {SPANS} SELECT * FROM i WHERE valid_from <= 12 AND (valid_to IS NULL OR valid_to > 12)")
def valid_at_half_open(spark, d):
    return T.holding(T.intervals(S.ledger(spark, d)), 12, half_open=True)


@query(f"""WITH {LEDGER}, t AS (SELECT character FROM l GROUP BY 1 ORDER BY count(*) DESC, character LIMIT 5)
    SELECT CAST(m AS INT) AS at, character, count(DISTINCT category) AS categories, count(DISTINCT name) AS names, count(*) AS changes
    FROM l JOIN t USING (character), unnest([10, 20, 30]) AS u(m) WHERE chapter <= m GROUP BY ALL""")
def state_snapshots(spark, d):
    return T.snapshots(S.ledger(spark, d), 10, 30, 5)


@query(f"WITH {LEDGER} SELECT * FROM (SELECT character, ord AS src, lead(ord) OVER (PARTITION BY character ORDER BY chapter, ord) AS dst FROM l) WHERE dst IS NOT NULL")
def consecutive_pairs(spark, d):
    return T.consecutive(S.ledger(spark, d))


ISLANDS = """d AS (SELECT DISTINCT character, category, chapter FROM l), f AS (SELECT *, CASE WHEN chapter - lag(chapter) OVER w > 1 THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY character, category ORDER BY chapter)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY character, category ORDER BY chapter) AS run FROM f),
    s AS (SELECT character, category, min(chapter) AS first, max(chapter) AS last, count(*) AS chapters FROM r GROUP BY character, category, run)"""


@query(f"WITH {LEDGER}, {ISLANDS} SELECT * FROM s")
def islands(spark, d):
    return T.islands(S.ledger(spark, d))


@query(f"WITH {LEDGER}, {ISLANDS} SELECT l.character, s.category AS sequence, l.category, count(*) AS changes FROM l JOIN s ON l.character = s.character AND l.chapter BETWEEN s.first AND s.last AND s.chapters >= 3 GROUP BY ALL")
def interval_join_sequence(spark, d):
    ledger = S.ledger(spark, d)
    met = T.within(ledger, T.islands(ledger).where("chapters >= 3"))
    return met.groupBy("character", "sequence", "category").agg(F.count("*").alias("changes"))


@query(f"""WITH {LEDGER}, {SPANS}, x AS (SELECT character, category, max(chapter) AS ended_at FROM l WHERE category = 'error' GROUP BY ALL)
    SELECT i.character, i.category, i.name, valid_from, CASE WHEN valid_to IS NULL AND ended_at >= valid_from THEN ended_at ELSE valid_to END AS valid_to FROM i LEFT JOIN x USING (character, category)""")
def relation_ends(spark, d):
    ledger = S.ledger(spark, d)
    ends = ledger.where("category = 'error'").groupBy("character", "category").agg(F.max("chapter").alias("ended_at"))
    return T.keep_open(T.intervals(ledger), ends)


_BATCH = """SELECT character, category, max_by('k' || name, length('k' || name) * 1000 + name) AS description, max(name) / 10.0 AS confidence, list_sort(list_distinct(list('k' || name))) AS aliases,
    min(chapter) AS first_chapter, count(*) AS occurrences FROM l WHERE {} GROUP BY ALL"""


@query(f"""WITH {LEDGER}, a AS ({_BATCH.format('chapter <= 10')}), z AS ({_BATCH.format('chapter > 10 AND chapter <= 20')})
    SELECT coalesce(a.character, z.character) AS character, coalesce(a.category, z.category) AS category,
           CASE WHEN coalesce(length(z.description), -1) > coalesce(length(a.description), -1) THEN z.description ELSE a.description END AS description,
           CAST(greatest(a.confidence, z.confidence) AS DOUBLE) AS confidence, array_to_string(list_sort(list_distinct(coalesce(a.aliases, []) || coalesce(z.aliases, []))), ',') AS aliases,
           coalesce(a.first_chapter, z.first_chapter) AS first_chapter, CAST(coalesce(a.occurrences, 0) + coalesce(z.occurrences, 0) AS BIGINT) AS occurrences
    FROM a FULL JOIN z ON a.character = z.character AND a.category = z.category""")
def upsert_merge(spark, d):
    rows = S.ledger(spark, d).select("character", "category", "chapter", F.concat(F.lit("k"), "name").alias("description"), (F.col("name") / 10).alias("confidence"), F.array(F.concat(F.lit("k"), "name")).alias("aliases"), F.col("chapter").alias("first_chapter"), F.lit(1).cast("long").alias("occurrences"))
    empty = rows.where("false")
    old = T.upsert(empty, rows.where("chapter <= 10"), ["character", "category"])
    return T.upsert(old, rows.where("chapter > 10 AND chapter <= 20"), ["character", "category"]).withColumn("aliases", F.array_join("aliases", ","))


@query(f"WITH {LEDGER} SELECT category, count(*) AS n FROM l WHERE ord % 7 <> 3 AND (chapter IS NULL OR chapter <= 12) GROUP BY 1")
def batch_rollback(spark, d):
    """Rows of one batch (ord mod 7 = 3) are taken back, and the spoiler guard holds at chapter 12."""
    kept = S.ledger(spark, d).withColumn("batch_id", F.col("ord") % 7).where("batch_id <> 3").where(not_later(F.col("chapter"), 12))
    return kept.groupBy("category").agg(F.count("*").alias("n"))


# --- graph ------------------------------------------------------------------------------------------------------------


@query(f"WITH {NODES}, {EDGES} SELECT 'node' AS kind, label AS type, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', rel, count(*) FROM e GROUP BY ALL")
def graph_stats(spark, d):
    return G.label_counts(S.nodes(spark, d), S.edges(spark, d))


@query(f"WITH {EDGES} SELECT split_part(src, ':', 1) AS src_label, rel, split_part(dst, ':', 1) AS dst_label, count(*) AS n, bool_or(chapter IS NOT NULL) AS temporal FROM e GROUP BY ALL")
def schema_triples(spark, d):
    return G.triples(S.edges(spark, d))


@query(f"""WITH {EDGES}, {BOTH}, g AS (SELECT a AS id, count(DISTINCT b) AS degree FROM b WHERE a <> b GROUP BY 1)
    SELECT id, degree, round(CAST(degree AS DOUBLE) / (SELECT max(degree) FROM g), 6) AS importance FROM g""")
def degree_importance(spark, d):
    return G.degrees(S.edges(spark, d))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 3 ORDER BY c_name, c_custkey LIMIT 10 OFFSET 10")
def entity_page(spark, d):
    rows = S.read(spark, d, "customer").where("c_nationkey = 3").select("c_custkey", "c_name", "c_acctbal")
    return T.page(rows, ["c_name", "c_custkey"], 10, 10)


@query(f"WITH {EDGES}, {BOTH} SELECT rel, direction, b AS id FROM b WHERE a = 'Nation:3'")
def neighbours_1hop(spark, d):
    return G.neighbours(S.edges(spark, d), "Nation:3")


@query(f"WITH {EDGES}, {BOTH}, u AS (SELECT DISTINCT a, b FROM b) SELECT y.b AS id, count(*) AS ways FROM u x JOIN u y ON x.b = y.a WHERE x.a = 'Supplier:5' AND y.b <> 'Supplier:5' GROUP BY 1")
def two_hop_paths(spark, d):
    return G.two_hops(S.edges(spark, d), "Supplier:5")


def _ego(depth: int) -> str:
    return f"""WITH RECURSIVE {EDGES}, {BOTH}, u AS (SELECT DISTINCT a, b FROM b), r(id, hops) AS (SELECT 'Nation:3', 0 UNION SELECT u.b, hops + 1 FROM r JOIN u ON u.a = r.id WHERE hops < {depth})
        SELECT id, CAST(min(hops) AS INT) AS hops FROM r GROUP BY 1"""


@query(_ego(2))
def ego_2hop(spark, d):
    return G.ego(S.edges(spark, d), "Nation:3", 2)


@query(_ego(3))
def ego_3hop(spark, d):
    return G.ego(S.edges(spark, d), "Nation:3", 3)


@query(f"""WITH {NODES}, {EDGES}, k AS (SELECT id FROM n WHERE label IN ('Customer', 'Order')) SELECT dst, src, rel, chapter FROM e
    WHERE (chapter IS NULL OR chapter <= 390) AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def subgraph_at(spark, d):
    return G.subgraph(S.edges(spark, d), S.nodes(spark, d).where(F.col("label").isin("Customer", "Order")), 390)


@query("""SELECT CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS INT) AS chapter, count(DISTINCT o_orderkey) AS events, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1""")
def timeline(spark, d):
    o = S.read(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")).alias("chapter"))
    met = o.join(S.read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("chapter").agg(F.countDistinct("o_orderkey").alias("events"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query(f"WITH {NODES}, {EDGES} SELECT * FROM n WHERE label = 'Order' AND id NOT IN (SELECT src FROM e WHERE rel = 'CONTAINS')")
def orphan_nodes(spark, d):
    return G.orphans(S.nodes(spark, d), S.edges(spark, d), "CONTAINS", "Order")


@query("""WITH m AS (SELECT lower(trim(CAST(c_nationkey AS VARCHAR))) AS name, 'Customer' AS label, 2 AS p FROM customer UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 'Supplier', 1 FROM supplier)
    SELECT name, count(DISTINCT label) AS labels, arg_min(label, p) AS winner FROM m GROUP BY 1 HAVING count(DISTINCT label) > 1""")
def cross_type_names(spark, d):
    c = S.read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("name"), F.lit("Customer").alias("label"))
    s = S.read(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("name"), F.lit("Supplier").alias("label"))
    return G.shared_names(c.unionByName(s), ["Supplier", "Customer"])


@query(f"""WITH {EDGES}, k AS (SELECT *, split_part(src, ':', 1) AS s, split_part(dst, ':', 1) AS d FROM e WHERE rel IN ('IN_NATION', 'PLACED'))
    SELECT rel, src, dst, 'domain' AS broken FROM k WHERE s <> 'Customer' UNION ALL SELECT rel, src, dst, 'range' FROM k WHERE d <> CASE rel WHEN 'PLACED' THEN 'Order' ELSE 'Nation' END""")
def type_violations(spark, d):
    rules = spark.createDataFrame([("IN_NATION", "Customer", "Nation"), ("PLACED", "Customer", "Order")], "rel string, src_label string, dst_label string")
    return G.violations(S.edges(spark, d), rules)


@query(f"WITH {EDGES} SELECT src, rel, dst, min(chapter) AS valid_from, max(chapter) AS last_seen, count(*) AS occurrences FROM e GROUP BY src, rel, dst")
def consolidate_edges(spark, d):
    return G.consolidate(S.edges(spark, d))


@query(f"""WITH {EDGES}, m AS (SELECT CASE src WHEN 'Nation:4' THEN 'Nation:3' ELSE src END AS src, rel, CASE dst WHEN 'Nation:4' THEN 'Nation:3' ELSE dst END AS dst, chapter FROM e)
    SELECT DISTINCT * FROM m WHERE src <> dst""")
def merge_entities(spark, d):
    return G.merge_entity(S.edges(spark, d), "Nation:4", "Nation:3")


@query(f"""WITH {EDGES}, h AS (SELECT DISTINCT src, dst FROM e WHERE rel = 'IN_NATION'), m AS (SELECT src, dst, 'Relation:' || left(sha256(src || '|' || dst), 16) AS node FROM h)
    SELECT src, rel, dst FROM e WHERE rel <> 'IN_NATION' UNION ALL SELECT src, 'INVOLVED_IN', node FROM m UNION ALL SELECT dst, 'INVOLVED_IN', node FROM m""")
def reify_relations(spark, d):
    return G.reify(S.edges(spark, d), "IN_NATION")


@query("SELECT event_type || CAST(json_extract_string(props, '$.k') AS INT) AS type, count(*) AS n FROM events GROUP BY 1 HAVING NOT (count(*) = 1 AND length(type) > 8)")
def rare_type_prune(spark, d):
    typed = S.read(spark, d, "events").select(F.concat("event_type", F.get_json_object("props", "$.k").cast("int")).alias("type"))
    return G.rare_types(typed, 8).groupBy("type").agg(F.count("*").alias("n"))


PAIRS = f"""{EDGES}, c AS (SELECT DISTINCT src, dst FROM e WHERE rel = 'CONTAINS'),
    q AS (SELECT x.src AS a, y.src AS b, count(*) AS shared FROM c x JOIN c y ON x.dst = y.dst AND x.src <> y.src WHERE CAST(split_part(x.src, ':', 2) AS BIGINT) % 20 = 0 GROUP BY ALL)"""


@query(f"WITH {PAIRS} SELECT a, b, shared FROM q")
def co_contained(spark, d):
    return G.co_members(S.edges(spark, d), "CONTAINS", F.substring_index("src", ":", -1).cast("long") % 20 == 0)


@query("""WITH m AS (SELECT o_custkey AS child, l_suppkey AS parent, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT child, arg_min(parent, -n * 1000000 + parent) AS parent, max(n) AS votes FROM m GROUP BY 1""")
def hierarchy_vote(spark, d):
    o, li = S.read(spark, d, "orders").select("o_custkey", "o_orderkey"), S.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return G.parents_by_vote(o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("child"), F.col("l_suppkey").alias("parent")))


@query()
def communities_lpa(spark, d):
    """Label propagation on customers and suppliers that trade, in four rounds; a brute-force test holds it."""
    o, li = S.read(spark, d, "orders").select("o_custkey", "o_orderkey"), S.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    return G.spread_labels(pairs, 4)


# --- names ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS canonical, count(*) OVER (PARTITION BY h) AS size FROM (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents)")
def exact_dedup_docs(spark, d):
    rows = S.read(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    return N.exact(rows, "h", "doc_id")


@query(f"SELECT DISTINCT p_name AS name, {normal_sql('''CASE p_partkey % 3 WHEN 0 THEN 'The ' WHEN 1 THEN 'de la ' ELSE 'E' || chr(769) || 'le ' END || p_name''')} AS normal, p_partkey % 3 AS variant FROM part")
def normalise_names(spark, d):
    k = F.col("p_partkey") % 3
    prefix = F.when(k == 0, "The ").when(k == 1, "de la ").otherwise("E\u0301le ")
    rows = S.read(spark, d, "part").select(F.col("p_name").alias("name"), F.concat(prefix, "p_name").alias("given"), k.alias("variant"))
    return with_normal_name(rows, "given", "normal").select("name", "normal", "variant").distinct()


def _names(spark, d):
    return S.read(spark, d, "part").select(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("the "), "p_name")).otherwise(F.col("p_name")).alias("name"))


@query()
def fuzzy_pairs(spark, d):
    """Names whose best of four ratios is 85 or more; a test holds them against all pairs."""
    return N.fuzzy_pairs(_names(spark, d), 85)


@query()
def fuzzy_tiers(spark, d):
    """Merges of the definite tier and candidates of the other."""
    sure, rest = N.tiers(N.fuzzy_pairs(_names(spark, d), 85))
    return sure.select("alias", "canonical", F.lit("merge").alias("fate")).unionByName(rest.select(F.col("a").alias("alias"), F.col("b").alias("canonical"), F.lit("review").alias("fate")))


@query()
def alias_closure(spark, d):
    """Canonical names of the fuzzy pairs' components; a test holds it against a union-find."""
    return N.closure(N.tiers(N.fuzzy_pairs(_names(spark, d), 85))[0].select(F.col("alias").alias("a"), F.col("canonical").alias("b")))


@query("SELECT a.n_name AS name, coalesce(r.r_name, a.n_name) AS renamed FROM nation a LEFT JOIN region r ON a.n_regionkey = r.r_regionkey AND a.n_nationkey % 2 = 0")
def apply_aliases(spark, d):
    n, r = S.read(spark, d, "nation"), S.read(spark, d, "region")
    aliases = n.where("n_nationkey % 2 = 0").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("canonical"))
    return N.rename(n.select("n_name", F.col("n_name").alias("renamed")), "renamed", aliases).select(F.col("n_name").alias("name"), "renamed")


@query("SELECT DISTINCT 'The ' || c_name AS name, c_name AS canonical FROM customer UNION SELECT DISTINCT 'alias ' || c_custkey, c_name FROM customer")
def registry_lookup(spark, d):
    c = S.read(spark, d, "customer")
    registry = c.select(F.col("c_name").alias("canonical"), F.array(F.concat(F.lit("Alias "), "c_custkey")).alias("aliases"))
    names = c.select(F.concat(F.lit("The "), "c_name").alias("name")).unionByName(c.select(F.concat(F.lit("alias "), "c_custkey").alias("name")))
    return N.lookup(names, registry)


# --- retrieval --------------------------------------------------------------------------------------------------------


def _bm25_sql(docs: str, queries: str, k1: float) -> str:
    words = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"
    return f"""w AS (SELECT doc_id, {words} AS w FROM ({docs})), asked AS (SELECT DISTINCT query_id, unnest({words}) AS term FROM ({queries})),
        t AS (SELECT count(*) AS n, avg(len(w)) AS average FROM w), post AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM w),
        tf AS (SELECT term, doc_id, size, count(*) AS tf FROM post WHERE term IN (SELECT term FROM asked) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        s AS (SELECT query_id, doc_id, CAST(sum(CAST(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * size / average)) AS DECIMAL(38, 12))) AS DOUBLE) AS score
              FROM tf JOIN df USING (term) JOIN asked USING (term), t GROUP BY ALL)"""


def _top_sql(table: str, k: int) -> str:
    return f"SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS INT) AS rank FROM {table} QUALIFY rank <= {k}"


BM25_DOCS = _bm25_sql("SELECT doc_id, coalesce(text, '') AS text FROM documents", "SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0", 1.2)


def _bm25_docs(spark, d):
    docs = S.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = S.read(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25(docs, asked, 1.2, 0.75)


@query(f"WITH {_bm25_sql('SELECT p_partkey AS doc_id, p_name AS text FROM part', 'SELECT p_partkey AS query_id, p_name AS text FROM part WHERE p_partkey % 20 = 0', 1.5)}, r AS ({_top_sql('s', 5)}) SELECT * FROM r")
def bm25_names(spark, d):
    part = S.read(spark, d, "part")
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    return R.bm25_top(docs, docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 1.5, 0.75, 5)


@query(f"WITH {BM25_DOCS}, r AS ({_top_sql('s', 10)}) SELECT * FROM r")
def bm25_docs_topk(spark, d):
    return R.top(_bm25_docs(spark, d), 10)


DENSE = """v AS (SELECT q.vec_id AS query_id, i.vec_id AS doc_id, list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) /
    (sqrt(list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))) AS score
    FROM embeddings i, embeddings q WHERE q.vec_id % 20 = 0 AND i.vec_id <> q.vec_id)"""


def _dense(spark, d, k, asked="vec_id % 20 = 0"):
    v = S.read(spark, d, "embeddings")
    return R.dense(v.select(F.col("vec_id").alias("doc_id"), "embedding"), v.where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k)


@query(f"WITH {DENSE}, r AS ({_top_sql('v', 5)}) SELECT * FROM r")
def dense_topk(spark, d):
    return R.top(_dense(spark, d, 5), 5)


RRF = f"""{BM25_DOCS}, {DENSE}, lx AS ({_top_sql('s', 30)}), dn AS ({_top_sql('v', 30)}),
    z AS (SELECT query_id, doc_id, CAST(sum(CAST(p AS DECIMAL(38, 12))) AS DOUBLE) AS score FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS p FROM lx UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) FROM dn) GROUP BY ALL)"""


@query(f"WITH {RRF}, r AS ({_top_sql('z', 15)}) SELECT * FROM r")
def hybrid_retrieve(spark, d):
    return R.fuse([(R.top(_bm25_docs(spark, d), 30), 1.0), (R.top(_dense(spark, d, 30), 30), 0.5)], 15)


BM25_LABELS = _bm25_sql("SELECT vec_id AS doc_id, 'k' || label AS text FROM embeddings", "SELECT vec_id AS query_id, 'k' || label AS text FROM embeddings", 1.5)


@query(f"""WITH {BM25_LABELS}, {DENSE.replace("q.vec_id % 20 = 0 AND ", "")},
    lx AS ({_top_sql('s', 5)}), dn AS ({_top_sql('v', 5)}), b AS (SELECT max(score) AS best FROM lx),
    x AS (SELECT least(query_id, doc_id) AS a, greatest(query_id, doc_id) AS b, max(score / best) AS l FROM lx, b GROUP BY ALL), y AS (SELECT least(query_id, doc_id) AS a, greatest(query_id, doc_id) AS b, max(score) AS l FROM dn GROUP BY ALL)
    SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, round(greatest(coalesce(x.l, 0.0), coalesce(y.l, 0.0)), 6) AS score FROM x FULL JOIN y ON x.a = y.a AND x.b = y.b WHERE round(greatest(coalesce(x.l, 0.0), coalesce(y.l, 0.0)), 6) >= 0.3""")
def hybrid_candidates(spark, d):
    docs = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("k"), "label").alias("text"))
    lexical = R.top(R.bm25(docs, docs.withColumnRenamed("doc_id", "query_id"), 1.5, 0.75), 5)
    return R.both_arms(lexical, R.top(_dense(spark, d, 5, "true"), 5), 0.3)


@query()
def near_dup_vectors(spark, d):
    """Of each query's 20 nearest, those not nearer than 0.8 to a better one; a test holds it against a plain loop."""
    best = R.top(_dense(spark, d, 20), 20).join(S.read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return R.without_near(best, 0.8)


@query(f"""WITH {BM25_DOCS}, r AS ({_top_sql('s', 10)}), u AS (SELECT query_id, doc_id, rank, length(text) AS size, CAST(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM r JOIN documents USING (doc_id))
    SELECT * FROM u WHERE used <= 12000""")
def context_budget(spark, d):
    best = R.top(_bm25_docs(spark, d), 10).join(S.read(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("size")), "doc_id")
    return R.within_budget(best, "size", 12000).select("query_id", "doc_id", "rank", "size", "used")


# --- text -------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+(\\s|$)'), lambda s: trim(s, ' ') <> '')) AS INT) AS sentences, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS tokens FROM documents")
def sentence_count(spark, d):
    t = F.coalesce("text", F.lit(""))
    return S.read(spark, d, "documents").select("doc_id", P.sentences(t).alias("sentences"), P.token_estimate(t).cast("long").alias("tokens"))


@query(f"""WITH {LINES} SELECT doc_id, CASE WHEN regexp_matches(t, '{SCENE_MARK}') THEN 'scene_break' WHEN regexp_matches(t, '{BOX_MARK}') THEN 'blue_box' WHEN regexp_matches(t, '^[{SPEECH}]') OR (starts_with(t, '"') AND NOT starts_with(t, '""')) THEN 'dialogue' ELSE 'narration' END AS kind, count(*) AS n
    FROM (SELECT doc_id, regexp_replace(CASE position % 9 WHEN 0 THEN '[Level up] ' || text WHEN 1 THEN '[odd] ' || text WHEN 2 THEN ' ** ' WHEN 3 THEN '--' WHEN 4 THEN '"' || text WHEN 5 THEN '""' || text WHEN 6 THEN '«' || text ELSE text END, '^\\s+|\\s+$', '', 'g') AS t FROM p) GROUP BY ALL""")
def paragraph_kinds(spark, d):
    shown = "CASE position % 9 WHEN 0 THEN '[Level up] ' || text WHEN 1 THEN '[odd] ' || text WHEN 2 THEN ' ** ' WHEN 3 THEN '--' WHEN 4 THEN '\"' || text WHEN 5 THEN '\"\"' || text WHEN 6 THEN '«' || text ELSE text END"
    return S.lines(spark, d).groupBy("doc_id", P.paragraph_kind(F.expr(shown)).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, c AS (SELECT doc_id, position, list_distinct(regexp_extract_all(text, '([A-Z][a-z]{{2,}})', 1)) AS names FROM p),
    k AS (SELECT doc_id, position, names, flatten(list(names) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS old FROM c)
    SELECT doc_id, position, CAST(len(list_filter(names, lambda x: NOT list_contains(coalesce(old, []), x))) AS BIGINT) AS fresh FROM k""")
def scene_windows(spark, d):
    return P.new_names(S.lines(spark, d))


_PASSES = {"characters": (" (?:[Tt]he|der|le) ", 20), "systems": ("[0-9]+", 2), "events": ("[!?]", 3)}


@query(
    "SELECT doc_id, CASE WHEN length(t) < 2000 THEN '" + ",".join(_PASSES) + "' ELSE concat_ws(',', "
    + ", ".join(f"CASE WHEN len(regexp_extract_all(t, '{p}')) >= {n} THEN '{name}' END" for name, (p, n) in _PASSES.items())
    + ") END AS routes FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
)
def router_flags(spark, d):
    return S.read(spark, d, "documents").select("doc_id", P.routes(F.coalesce("text", F.lit("")), _PASSES, 2000).alias("routes"))


@query("""WITH w AS (SELECT unnest(string_split(coalesce(text, ''), ' ')) AS name FROM documents) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN lower(name) IN ('he', 'she', 'it') THEN 'pronoun' WHEN length(name) <= 1 THEN 'short'
    WHEN length(name) > 80 THEN 'long' WHEN regexp_matches(name, '^\\(.*\\)$') THEN 'parenthetical' WHEN regexp_matches(name, '^[a-z]+$') THEN 'lower_case' END AS reason FROM w) GROUP BY 1""")
def filter_names(spark, d):
    words = S.read(spark, d, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("name"))
    return words.groupBy(P.name_is_bad(F.col("name"), ["he", "she", "it"]).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, t AS (SELECT unnest(['the', 'idiot', 'password', 'der']) AS term), w AS (SELECT doc_id, position, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM p)
    SELECT doc_id, position, term, count(*) AS hits FROM w JOIN t USING (term) GROUP BY ALL""")
def mentions_in_docs(spark, d):
    terms = spark.createDataFrame([("the",), ("idiot",), ("password",), ("der",)], "term string")
    return P.mentions(S.lines(spark, d), terms)


@query(f"""WITH {LINES}, w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM p)
    SELECT term, count(*) AS mentions, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM w WHERE term <> '' GROUP BY 1 HAVING count(*) >= 50""")
def mention_summary(spark, d):
    words = S.lines(spark, d).select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''")
    return words.groupBy("term").agg(F.count("*").alias("mentions"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("mentions >= 50")


@query()
def chunk_documents(spark, d):
    """Every document in chunks, its lines as paragraphs."""
    docs = S.read(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return read_each(docs, "text", chunks, "position int, chunk string, start int, stop int, tokens int, scene_break boolean", ["doc_id"])


@query()
def mention_spans(spark, d):
    return P.spans(S.lines(spark, d), ["the", "of the", "der", "worthless"])


@query("""WITH c AS (SELECT doc_id, left(text, 20) AS claim, CAST(doc_id % 3 AS BIGINT) AS start, text FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, start, CASE WHEN substr(text, start + 1, length(claim)) = claim THEN 'exact' WHEN instr(text, claim) > 0 THEN 'fuzzy' ELSE 'unaligned' END AS alignment,
    CASE WHEN substr(text, start + 1, length(claim)) = claim THEN 1.0 WHEN instr(text, claim) > 0 THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence,
    CASE WHEN substr(text, start + 1, length(claim)) = claim THEN start WHEN instr(text, claim) > 0 THEN instr(text, claim) - 1 ELSE -1 END AS found FROM c""")
def ground_claims(spark, d):
    c = S.read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.left("text", F.lit(20)).alias("claim"), (F.col("doc_id") % 3).cast("long").alias("start"), "text")
    return P.grounded(c).select("doc_id", "start", "alignment", "confidence", "found")


@query("""SELECT conv_id, turn, role, CAST(length(text) AS INT) AS size, turn % 5 = 0 AS summarise FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20""")
def conversation_window(spark, d):
    c = S.read(spark, d, "conversations")
    return G.top_of_each(c, ["conv_id"], [F.desc("turn")], 20).select("conv_id", "turn", "role", F.length("text").alias("size"), (F.col("turn") % 5 == 0).alias("summarise"))


# --- exports and costs ------------------------------------------------------------------------------------------------


@query(f"""WITH {NODES} SELECT '"' || id || '","' || label || '","' || replace(coalesce(name, ''), '"', '""') || '"' AS line FROM n""")
def export_csv(spark, d):
    return X.csv_lines(S.nodes(spark, d))


@query(f"""WITH {NODES}, {EDGES} SELECT 'CREATE (:' || label || ' {{id: ''' || id || '''}})' AS line FROM n UNION ALL SELECT 'MATCH (a {{id: ''' || src || '''}}), (b {{id: ''' || dst || '''}}) CREATE (a)-[:' || rel || ']->(b)' FROM e""")
def export_statements(spark, d):
    return X.statement_lines(S.nodes(spark, d), S.edges(spark, d))


@query(f"""WITH {NODES} SELECT '{{"@id":"' || id || '","@type":"' || label || '","name":"' || name || '"}}' AS line FROM n""")
def export_json(spark, d):
    return X.json_lines(S.nodes(spark, d))


@query("""WITH u AS (SELECT user_id % 5 AS book, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) + 1 AS chapter, event_type AS model, CAST(round(value) AS BIGINT) AS tokens FROM events),
    c AS (SELECT *, tokens * CASE model WHEN 'click' THEN 2.5 WHEN 'view' THEN 1.0 ELSE 10.0 END AS cost FROM u WHERE model IN ('click', 'view', 'purchase'))
    SELECT book, chapter, model, CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(CAST(cost AS DECIMAL(38, 6))) AS DOUBLE) / 1e6, 4) AS cost FROM c GROUP BY GROUPING SETS ((book, chapter), (book), (model), ())""")
def cost_rollup(spark, d):
    usage = S.ledger(spark, d).select((F.col("character") % 5).alias("book"), "chapter", F.col("category").alias("model"), F.col("delta").alias("tokens"))
    prices = spark.createDataFrame([("click", 2.5), ("view", 1.0), ("purchase", 10.0)], "model string, price double")
    return X.costs(usage, prices)


# --- streams ----------------------------------------------------------------------------------------------------------


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE), 3) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return ST.finish(ST.windows(ST.events(spark, d), "1 day"), "complete")


@query("""SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE), 3) AS total
    FROM (SELECT unnest([date_trunc('day', ts) + to_hours(CAST(hour(ts) // 12 * 12 AS BIGINT)), date_trunc('day', ts) + to_hours(CAST(hour(ts) // 12 * 12 - 12 AS BIGINT))]) AS s, event_type, value FROM events) GROUP BY ALL""")
def stream_sliding(spark, d):
    return ST.finish(ST.windows(ST.events(spark, d), "1 day", "12 hours"), "complete")


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM r GROUP BY user_id, run""")
def stream_session(spark, d):
    return ST.finish(ST.sessions(ST.events(spark, d), "6 hours"), "complete")


@query("SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 60 THEN 'done' ELSE 'progress' END AS state FROM events GROUP BY 1")
def stream_progress(spark, d):
    return ST.finish(ST.progress(ST.events(spark, d), 60), "complete")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def stream_ledger(spark, d):
    import uuid

    target = f"{shared_folder(spark)}/skein-ledger-{uuid.uuid4().hex}"
    ST.ledger_last_wins(ST.events(spark, d), target)
    return ST.ledger(spark, target).select("user_id", "event_type", "event_id", "value")
