"""Operators that SQL cannot say, by hand and against plain forms."""

import random
from collections import Counter, defaultdict

from conftest import DATA
from pyspark.sql import functions as F

from skein import plugins
from skein import streaming as ST
from skein.catalog import QUERIES
from skein.operators import graph as G
from skein.operators import reads as R
from skein.operators import resolve as N
from skein.operators import upserts as U
from skein.sources import store


def modularity(edges, of, resolution):
    m, inside, degree = len(edges), Counter(), Counter()
    for a, b in edges:
        degree[of[a]] += 1
        degree[of[b]] += 1
        inside[of[a]] += of[a] == of[b]
    return sum(inside[c] / m - resolution * (degree[c] / (2 * m)) ** 2 for c in degree)


def test_communities_raise_modularity(spark):
    r = random.Random(1)
    cliques = [[f"{g}{i}" for i in range(6)] for g in "abc"]
    edges = [(x, y) for c in cliques for i, x in enumerate(c) for y in c[:i]] + [("a0", "b0"), ("b1", "c1")]
    got = {x.id: x.community for x in G.communities(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len({got[x] for x in cliques[0]}) == 1 and len(set(got.values())) == 3
    noisy = edges + [(r.choice(sum(cliques, [])), r.choice(sum(cliques, []))) for _ in range(12)]
    noisy = [(a, b) for a, b in noisy if a != b]
    for resolution in (1.0, 0.5):
        of = {x.id: x.community for x in G.communities(spark.createDataFrame(noisy, "a string, b string"), resolution).collect()}
        now = modularity(noisy, of, resolution)
        assert now > modularity(noisy, {x: x for x in of}, resolution) and now >= modularity(noisy, dict.fromkeys(of, 1), resolution) - 1e-9
    named = G.named_communities(spark.createDataFrame(list(got.items()), "id string, community string"), "x", 1).collect()
    assert {n.community for n in named} == {f"x:comm:L1:{k}" for k in range(3)} and len(named) == 18
    assert G.communities(spark.createDataFrame([], "a string, b string")).count() == 0


def test_upserts_in_any_batches_agree(spark):
    rows = [(k % 3, f"n{k % 5}", k, "d" * (k * 7 % 5), (k * 3 % 10) / 10, [f"a{k % 4}", f"b{k % 2}"], "" if k % 2 else f"r{k}", k, 1) for k in range(40)]
    cols = "book int, name string, seq long, description string, confidence double, aliases array<string>, rank string, value int, occurrences int"
    df = spark.createDataFrame(rows, cols)
    policies = {"description": "longest", "confidence": "largest", "aliases": "union", "rank": "named", "value": "total", "occurrences": "count"}
    whole = {(r.book, r.name): r for r in U.merge(None, df, ["book", "name"], policies).collect()}
    for cut in (1, 17, 39):
        state = U.merge(None, df.where(F.col("seq") < cut), ["book", "name"], policies)
        assert {(r.book, r.name): r for r in U.merge(state, df.where(F.col("seq") >= cut), ["book", "name"], policies).collect()} == whole
    one = [r for r in rows if r[0] == 1 and r[1] == "n1"]
    assert whole[1, "n1"].aliases == list(dict.fromkeys(a for r in one for a in r[5])) and whole[1, "n1"].value == sum(r[7] for r in one)
    longest = max(len(r[3]) for r in one)
    assert whole[1, "n1"].description == next(r[3] for r in one if len(r[3]) == longest)
    assert U.merge(None, df.where("false"), ["book", "name"], policies).count() == 0


def test_intervals_by_hand(spark):
    rows = [(1, "u", "bow", "", 1, 1), (1, "u", "bow", "B", 1, 2), (1, "u", "bow", "", 3, 3), (1, "u", "bow", "A", 5, 4), (1, "", "bow", "S", 6, 5)]
    got = sorted((r.valid_from, r.valid_to, r["rank"]) for r in U.skill_intervals(spark.createDataFrame(rows, "book int, owner string, name string, rank string, chapter int, seq int")).collect())
    assert got == [(1, 4, None), (5, None, "A")]
    rows = [(1, "u", "scout", 1, 1), (1, "u", "scout", 2, 2), (1, "u", "mage", 4, 3), (1, "u", "scout", 6, 4), (1, "u", "sage", 6, 5)]
    got = {r.name: (r.valid_from, r.valid_to) for r in U.class_intervals(spark.createDataFrame(rows, "book int, owner string, name string, chapter int, seq int")).collect()}
    assert got == {"scout": (1, 3), "mage": (4, 5), "sage": (6, None)}
    rows = [(1, "u", 3, 1, 1), (1, "u", 2, 2, 2), (1, "u", 5, 4, 3), (1, "u", 4, 5, 4), (1, "u", None, 6, 5)]
    got = {r.level: (r.valid_from, r.valid_to) for r in U.level_intervals(spark.createDataFrame(rows, "book int, owner string, level int, chapter int, seq int")).collect()}
    assert got == {3: (1, 3), 2: (2, 3), 5: (4, None), 4: (5, None)}


def test_dedup_tiers(spark):
    rows = [("person", n, i) for i, n in enumerate(["Jon Smith", "The Jon Smith", "smith jon", "Mara Ash", "Mara Ashe", "Bo", "Li"])] + [("place", "Jon Smith", 20)]
    got = {(r.entity_type, r.alias): r.canonical for r in N.dedup(spark.createDataFrame(rows, "entity_type string, name string, ord int")).collect()}
    assert got["person", "the jon smith"] == "jon smith" and got["person", "smith jon"] in ("jon smith",) and not any(k[0] == "place" for k in got)
    assert not set(got.values()) & {a for _, a in got}
    fates = {r.a: r.fate for r in N.reviewed(spark.createDataFrame([("x", "y", 90, 0.9), ("p", "q", 90, 0.5), ("m", "n", 70, 0.5), ("r", "s", 90, 0.1)], "a string, b string, score int, rank double")).collect()}
    assert fates == {"x": "merge", "p": "merge", "m": "escalate", "r": "drop"}
    new, old = spark.createDataFrame([("jon adam smith",), ("zed",)], "name string"), spark.createDataFrame([("jon smyth adam",), ("smith",)], "name string")
    assert [(r.name, r.canonical) for r in N.per_chapter(new, old, 80, 99).collect()] == [("jon adam smith", "jon smyth adam")]


def test_clusters_rename_edges(spark):
    names = spark.createDataFrame([("p", n) for n in ["Jon Smith", "Smith Jon", "Mara", "Bo", "Li", "Ash"]] + [("q", "Jon"), ("q", "Jonn")], "entity_type string, name string")
    edges = spark.createDataFrame([("jon smith", "smith jon"), ("Smith Jon", "mara"), ("jon smith", "mara")], "src string, dst string")
    alias, left = R.clustered(names, edges)
    pairs = {(r.name, r.canonical) for r in alias.collect()}
    assert len(pairs) == 1 and {x for p in pairs for x in p} == {"jon smith", "smith jon"}
    assert {(r.src.lower(), r.dst) for r in left.collect()} == {(next(iter(pairs))[1], "mara")}


def test_near_vectors_are_left_out_by_rank(spark):
    import numpy as np

    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    unit = {k: v / np.sqrt(v @ v) for k, v in rows.items()}
    got = defaultdict(list)
    for r in QUERIES["near_dup_vectors"](spark, DATA).collect():
        got[r.query_id].append((r["rank"], r.doc_id))
    for q in sorted(got)[:8]:
        order = sorted((-round(float(unit[q] @ v), 6), k) for k, v in unit.items() if k != q)[:20]
        kept = []
        for _, k in order:
            if all(unit[k] @ unit[j] <= 0.8 for j in kept):
                kept.append(k)
        assert [d for _, d in sorted(got[q])] == kept


def test_ledger_rewrites_touched_buckets_only(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("user_id long, event_type string, event_id long, value double")
    source, target = tmp_path / "in", f"file://{tmp_path}/ledger"
    for n, rows in enumerate([[(u, "x", u, 1.0) for u in range(40)], [(1, "x", 100, 5.0), (2, "x", 0, 9.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        ST.ledger_last_wins(spark.readStream.schema(schema).parquet(f"file://{source}"), target)
        assert n == 0 or sum(f"batch={n}/" in p for p in ST.current_buckets(spark, target).values()) <= 2
    got = {r.user_id: r.value for r in ST.ledger(spark, target).collect()}
    assert got[1] == 5.0 and got[2] == 1.0 and len(got) == 40


def test_plugs(spark):
    pairs = spark.createDataFrame([("a b", "b a"), (None, "x")], "a string, b string")
    assert sorted(r["rank"] for r in plugins.scored(pairs, lambda x, y: [N.set_ratio(p, q) / 100 for p, q in zip(x, y, strict=True)]).collect()) == [0.0, 1.0]

    def fragile(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    got = {r.key: (r.vector, r.error) for r in plugins.embedded(spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "key int, text string").coalesce(1), fragile, 1).collect()}
    assert got == {1: ([2.0], None), 2: (None, "ValueError: no"), 3: ([0.0], None)}
    rows = plugins.extracted(spark.createDataFrame([(1, "[Skill Acquired: Leap] and Class: Archer (D)")], "book int, text string"), ["book"]).collect()
    assert [(r.entity_type, r.name) for r in rows] == [("Skill", "Leap"), ("Class", "Archer")]


def test_store_replaces_books(spark, tmp_path):
    path = f"file://{tmp_path}/books"
    store.replace_books(spark.createDataFrame([(1, "a"), (2, "b")], "book int, text string"), path)
    store.replace_books(spark.createDataFrame([(2, "c")], "book int, text string"), path)
    assert {(r.book, r.text) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    store.drop_book(spark, path, 1)
    assert {(r.book, r.text) for r in spark.read.parquet(path).collect()} == {(2, "c")}


def test_dead_letters_and_memory(spark):
    ok, bad = ST.dead_letters(spark.createDataFrame([(1, "a"), (2, None)], "id int, t string"), F.col("t").isNotNull(), F.lit("empty"))
    assert ok.count() == 1 and [(r.reason, r.payload) for r in bad.collect()] == [("empty", '{"id":2}')]
    assert ST.retried(bad, spark.createDataFrame([(2,)], "id int"), "id int, t string", "id").count() == 0


def test_registry_names_meet_by_form(spark):
    registry = spark.createDataFrame([("Mara Ash", ["The Bold"]), ("It", None)], "canonical string, aliases array<string>")
    names = spark.createDataFrame([("the mara ash",), (" THE bold",), ("the it",), ("nobody",)], "name string")
    assert {r.name: r.canonical for r in N.lookup(names, registry).collect()} == {"the mara ash": "Mara Ash", " THE bold": "Mara Ash", "the it": None, "nobody": None}


def test_similar_types_get_a_parent(spark):
    from skein.operators.facts import twins

    known = spark.createDataFrame([("Skill", [1.0, 0.0]), ("Place", [0.0, 1.0])], "type string, vector array<float>")
    found = spark.createDataFrame([("Talent", [0.9, 0.1]), ("Odd", [1.0, 1.0])], "type string, vector array<float>")
    assert {r.type: r.parent for r in twins(found, known).collect()} == {"Talent": "Skill", "Odd": None}
