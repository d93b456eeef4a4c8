"""What larger and odder tables showed: each would have failed before its change."""

import os
import shutil

import duckdb
from conftest import DATA, same
from pyspark.sql import functions as F

from skein import streaming as ST
from skein.catalog import ORACLES, QUERIES
from skein.operators import reads as R


def test_a_text_with_words_has_a_vector(spark):
    import zlib

    seen, pair = {}, None
    for k in range(10_000):
        h = zlib.crc32(f"w{k}".encode())
        if (h % 64, 1 - (h >> 31)) in seen:
            pair = f"{seen[h % 64, 1 - (h >> 31)]} W{k}"
            break
        seen[h % 64, h >> 31] = f"w{k}"
    texts = [pair, " ", "　 \x1c", "\x0b", " \t\n\f\r", "", None]
    got = {r.key: r for r in R.embedded(spark.createDataFrame(list(enumerate(texts)), "key long, text string")).collect()}
    assert [got[k].error for k in range(7)] == [None] * 4 + ["no words"] * 3
    assert all(abs(sum(x * x for x in got[k].vector) - 1) < 1e-6 for k in range(4))


def test_conversations_in_a_folder_of_files(spark, tmp_path):
    at = str(tmp_path)
    rows = spark.read.parquet(f"{DATA}/conversations.parquet")
    odd = spark.range(45).select(F.lit(10**9).alias("conv_id"), (F.col("id") * 7 % 45).cast("int").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    bare = spark.range(3).select(F.lit(10**9 + 1).alias("conv_id"), F.lit(None).cast("int").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    every = rows.unionByName(odd.select(*(F.col(c).cast(rows.schema[c].dataType) for c in rows.columns))).unionByName(bare.select(*(F.col(c).cast(rows.schema[c].dataType) for c in rows.columns)))
    every.repartition(5).write.parquet(f"{at}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet/*.parquet'")
    same(QUERIES["stream_conversation_memory"](spark, at), con, ORACLES["stream_conversation_memory"])


def test_conversations_over_several_batches_and_frames(spark, tmp_path):
    at = str(tmp_path / "turns")
    os.mkdir(at)
    for k in range(3):
        part = str(tmp_path / f"part{k}")
        spark.range(30).select(F.lit(1).cast("long").alias("conv_id"), ((F.col("id") * 11 % 30) * 3 + k).alias("turn"), F.lit("user").alias("role")).coalesce(1).write.parquet(part)
        shutil.copy(next(f.path for f in os.scandir(part) if f.name.endswith(".parquet")), f"{at}/{k}.parquet")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        turns = spark.readStream.schema("conv_id long, turn long, role string").option("maxFilesPerTrigger", 1).parquet(at)
        got = ST.finish(ST.conversation_memory(turns), "update").orderBy("turns").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert [r.turns for r in got] == [30, 60, 90]
    assert tuple(got[-1]) == (1, 90, 70, 20, 18)


def test_groups_of_a_search_leave_few_rows(spark, monkeypatch):
    import numpy as np

    from skein.operators import retrieval as V

    monkeypatch.setattr(V, "ITEM_SHARD", 60)
    monkeypatch.setattr(V, "SCORES_AT_ONCE", 500)
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(300).select("vec_id", "embedding", F.concat(F.lit("k"), F.nullif("label", F.lit(3))).alias("entity"))
    rows = [(r.vec_id, r.entity, np.array(r.embedding, float)) for r in v.collect()]
    odd = spark.createDataFrame([(90001, [0.0] * 64, "k1"), (90002, None, "k1")], "vec_id long, embedding array<float>, entity string")
    items = v.unionByName(odd).withColumnRenamed("vec_id", "doc_id")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {(r.query_id, r.entity): r.score for r in V.dense_groups(items, asked, "entity").collect()}
    every = {}
    for q, _, x in rows:
        for i, m, y in rows:
            if q % 20 == 0 and i != q:
                every[q, m] = max(every.get((q, m), -2), x @ y / np.sqrt((x @ x) * (y @ y)))
    assert got.keys() == every.keys() and all(abs(got[k] - every[k]) < 1e-9 for k in every)


def test_graph_arm_takes_the_first_chunks_of_an_entity(spark):
    entities = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.7), (2, "b", 0.8), (2, "c", 0.4)], "query_id long, entity string, score double")
    ground = spark.createDataFrame([(e, i, i % 5) for e, first in (("a", 90), ("b", 0)) for i in range(first, first + 60)] * 2, "entity string, doc_id long, chapter int")
    arm = R.graph_arm(entities, ground, 3, k=50)
    got = {q: [(r.doc_id, r.score) for r in sorted(arm.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2)}
    a, b = [i for i in range(90, 150) if i % 5 <= 3], [i for i in range(60) if i % 5 <= 3]
    assert got == {1: [(i, 0.9) for i in a] + [(i, 0.7) for i in b[:2]], 2: [(i, 0.8) for i in b]}
    plan = arm._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Join")[-1]


def test_spans_of_a_long_chapter_are_told_apart_at_once():
    import random
    import time

    from skein.operators import facts as K

    r = random.Random(5)
    for _ in range(400):
        taken, spans = bytearray(12), []
        for _ in range(4):
            a = r.randint(0, 12)
            b = r.randint(a, 12)
            assert K.touches(taken, a, b) == any(x <= a < y or x < b <= y for x, y in spans)
            K.take(taken, a, b)
            spans.append((a, b))
    text = "[Some thing here]\n\nLevel: 1 -> 2\n\n+3 Strength\n\n" * 15_000
    begin = time.time()
    assert len(K.shapes(text)) == 45_000 and len(K.facts(text)) == 45_000 and time.time() - begin < 20


def test_quotes_of_a_long_chapter_share_its_text(spark):
    import random
    import time

    from skein.operators import facts as K

    r = random.Random(6)
    for _ in range(300):
        text, q = ("".join(r.choices("abcde ", k=r.randint(0, n))) for n in (30, 12))
        q = (q + r.choice(["", "xx"])).strip()
        assert K.Grounder(text).like(q) == (K.part_ratio(q, text) > 80)
    text = "The next morning he walked on.\n\n" * 40_000
    rows = [(1, k, "The next morning he walked on." if k % 2 else "§" * 18, 32 * k, 32 * k + 30) for k in range(2000)]
    quotes = spark.createDataFrame(rows, "book long, position long, quote string, start int, stop int")
    begin = time.time()
    got = K.grounded(quotes, spark.createDataFrame([(1, text)], "book long, text string"), ["book"]).collect()
    assert {(r.position, r.alignment) for r in got} == {(k, "exact" if k % 2 else "unaligned") for k in range(2000)} and time.time() - begin < 60


def test_checked_names_carry_no_text(spark):
    from skein.operators import facts as K

    rows = [(1, "character", "Mara", "", ""), (1, "character", "mara", None, ""), (None, "item", "Mara", "", ""), (1, "item", None, "", ""), (2, "item", "Red Tower", "", ""), (1, "event", "Red Tower falls", "", ""), (1, "narrative_role", "old", "Jo", ""), (1, "narrative_role", "old", " Belka ", "")]
    e = spark.createDataFrame([(*r, []) for r in rows], "chapter int, entity_type string, name string, character string, role_type string, participants array<string>")
    out = K.verified(e, spark.createDataFrame([(1, "Old Mara and belka saw the red wall, tower of stone.")], "chapter int, text string"), spark.createDataFrame([("jorun",)], "name string"))
    got = sorted((str(r.chapter), str(r.name), str(r.character), str(r.reason)) for r in out.collect())
    assert got == sorted([("1", "Mara", "", "None"), ("1", "mara", "None", "None"), ("None", "Mara", "", "name_not_in_text"), ("1", "None", "", "empty_name"), ("2", "Red Tower", "", "name_not_in_text"), ("1", "Red Tower falls", "", "None"), ("1", "old", "Jo", "golem_character_not_found"), ("1", "old", " Belka ", "None")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_text") and not any("_text" in line and "_row" in line for line in plan.splitlines())


def test_copies_of_names_share_their_scores(spark, monkeypatch):
    import random

    from skein.operators import retrieval as V

    r = random.Random(8)
    names = [(k, " ".join(r.choices(["red", "blue", "Ring", "bolt", "rod", "hot"], k=r.randint(0, 3)))) for k in range(900)] + [(900, None)]
    docs = spark.createDataFrame(names, "doc_id long, text string")
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    plain = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert plain(V.bm25_top(docs, asked, 1.5, 0.75, 5)) == plain(V.top(V.bm25(docs, asked, 1.5, 0.75), 5))
    held = []
    monkeypatch.setattr(V, "bm25", lambda *a: held.append(a))
    assert QUERIES["bm25_names"](spark, DATA).count() and not held
