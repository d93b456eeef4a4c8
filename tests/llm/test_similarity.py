import random
import re
from collections import Counter

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import decontaminate, near_dup, shingles


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def bag(ws):
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)] if ws else [])


def plain_components(rows, percent):
    sets, up = {d: set(bag(words(t))) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in ids}


def crowd():
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(base[:i] + ["X%d" % i] + base[i + 1 :])) for i in range(60)]
    rows += [(100 + i, " ".join(base[:40] + [f"u{i}_{k}" for k in range(60)])) for i in range(60)]
    return rows + [(200, None), (201, ""), (202, "two words"), (203, "Two  WORDS"), (204, "two"), (205, "long " * 30_000), (206, "long " * 29_000)]


def test_components_equal_brute_force(spark, monkeypatch):
    rows = crowd()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, digest string")
    expected = plain_components(rows, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(docs).collect()}
    assert got == expected
    for name, value in (("SMALL", 5), ("AT_ONCE", 20), ("NODE_SHARD", 7), ("CLUSTER", 6), ("FIRST_PIVOTS", 2), ("MORE_PIVOTS", 3), ("PIVOT_BLOCK", 2)):
        monkeypatch.setattr(near_dup, name, value)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(docs).collect()} == expected
    monkeypatch.setattr(near_dup, "NODE_ROWS", 12)
    monkeypatch.setattr(near_dup, "MISS", 0.05)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(docs).collect()} == expected
    assert near_dup.components(docs.where("false")).count() == 0


def chains(many, length):
    """Rows of versions that move on by four words: each is linked with the one before and the one after it only."""
    return [(100 * c + i, " ".join(f"c{c}w{k}" for k in range(4 * i, 4 * i + 100))) for c in range(many) for i in range(length)]


def test_chains_in_large_clusters_equal_brute_force(spark, monkeypatch):
    for name, value in (("CLUSTER", 6), ("FIRST_PIVOTS", 2), ("MORE_PIVOTS", 4)):
        monkeypatch.setattr(near_dup, name, value)
    rows = chains(40, 12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows, 85)


def test_a_long_chain_is_one_component(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 100))) for i in range(500)]
    got = near_dup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 500


def families(percent, many, r):
    """Pairs at the threshold that all share a passage: many roots hold all documents, so their nodes must be branched."""
    passage = [f"p{k}" for k in range(80)]
    rows = []
    for i in range(many):
        own = [f"u{i}_{k}" for k in range(120)]
        edit = 12 if percent == 85 else 17
        rows += [(2 * i, passage + own), (2 * i + 1, passage + own[:-edit] + [f"v{i}_{k}" for k in range(edit)])]
    return [(d, " ".join(ws)) for d, ws in rows]


def test_branched_nodes_keep_their_recall():
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        assert abs((1 + near_dup.second(percent)) * percent / 100 - 1) < 1e-12
        # 4000 documents in 2000 pairs right at the threshold; each root keeps those that share its token
        passage, sets = rng.integers(1, 1 << 62, 90, dtype=np.uint64), []
        for _ in range(2000):
            own = rng.integers(1, 1 << 62, 110, dtype=np.uint64)
            moved = {80: 22, 85: 16}[percent]
            sets += [np.unique(np.r_[passage, own]), np.unique(np.r_[passage, own[moved:], rng.integers(1, 1 << 62, moved, dtype=np.uint64)])]
        found = np.stack([near_dup.tokens(s) for s in sets])
        sketches, n = near_dup.sketch(found[0:]), np.array([len(s) for s in sets])
        joined, deepest = set(), 0
        for tree in range(near_dup.TREES):
            for token in np.unique(found[:, tree]).tolist():
                rows = np.flatnonzero(found[:, tree] == np.uint64(token))
                if len(rows) > 1:
                    node = near_dup.Node(token, rows.tolist(), n[rows], sketches[rows], percent, small=40, at_once=400)
                    deepest = max(deepest, node.grow(np.arange(len(rows)), frozenset(), np.random.default_rng(0)))
                    joined |= {(a // 2, b // 2) for a, b in node.run()}
        assert deepest >= 2 and all(near_dup.linked(sets[2 * i], sets[2 * i + 1], percent) for i in range(2000))
        assert sum((i, i) in joined for i in range(2000)) >= 1998


def test_branched_roots_of_documents_equal_brute_force(spark, monkeypatch):
    for name, value in (("SMALL", 10), ("AT_ONCE", 20)):
        monkeypatch.setattr(near_dup, name, value)
    for percent in (80, 85):
        rows = families(percent, 60, random.Random(1))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
        assert got == plain_components(rows, percent)


def test_components_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(7, text), (7, text), (3, text.upper()), (None, text), (None, "alone in here"), (7, "other text")], "doc_id long, text string")
    got = near_dup.components(docs).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got if r.n_shingles == 26) == [("3", 3, True), ("7", 3, False), ("7", 3, False), ("None", 3, False)]
    assert {(r.component_id, r.kept) for r in got if r.n_shingles == 1} == {(None, True), (7, True)}


def test_a_class_of_null_ids_only_links_its_neighbours(spark):
    rows = [(d, " ".join(f"w{k}" for k in range(i, i + 60))) for d, i in ((5, 0), (None, 4), (9, 8))]
    got = near_dup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {5} and sum(r.kept for r in got) == 1


def test_shingles_do_not_depend_on_stretches(monkeypatch):
    text = " ".join(f"Word{k % 97}\t{k}" for k in range(4000))
    whole = shingles.shingle_sets([text, "a b", None])
    monkeypatch.setattr(shingles, "STRETCH", 64)
    parts = shingles.shingle_sets([text, "a b", None])
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    assert len(whole[0]) == len(bag(words(text))) and len(whole[1]) == 1 and not len(whole[2])


def plain_leaks(docs, items, similar=0.8):
    out = {}
    for d, t in docs:
        ws = words(t)
        for i, text in items:
            iw = words(text)
            for a in range(len(ws) - len(iw) + 1 if iw else 0):
                x, g = bag(ws[a : a + len(iw)]), bag(iw)
                both = sum((x & g).values())
                s = both / (sum(x.values()) + sum(g.values()) - both)
                if s >= similar and s > out.get((d, i), (0,))[0]:
                    out[d, i] = (s, a, a + len(iw))
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    item = [f"b{k}" for k in range(60)]
    edited = item[:30] + ["zz"] + item[31:]
    items = [(1, " ".join(item)), (2, "tiny item"), (3, ""), (4, None), (5, " ".join(item[:20])), (6, "tiny  ITEM")]
    docs = [(1, "x y " + " ".join(item).upper() + " z"), (2, " ".join(edited)), (3, None), (4, ""), (5, "a tiny item"), (6, " ".join(item[:40])), (7, "clean " * 9000), (8, " ".join(item * 3))]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = plain_leaks(docs, items)
    for at_once in (250, 2):
        monkeypatch.setattr(decontaminate, "ITEMS", at_once)
        monkeypatch.setattr(decontaminate, "SHARD", at_once)
        got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.end_word) for r in decontaminate.contaminated(df, bench).collect()}
        assert got == expected
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0 and decontaminate.contaminated(df.where("false"), bench).count() == 0


def test_leaks_of_many_items(spark):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 3, 4, 6, 12, 30])))) for i in range(5000)]
    docs = []
    for d in range(60):
        ws = rng.choices(vocabulary, k=rng.randint(3, 120))
        for i in rng.sample(range(5000), 2):
            at = rng.randrange(len(ws))
            ws[at:at] = words(items[i][1])
        docs.append((d, " ".join(ws)))
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.end_word) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    known = {}
    for i, t in items:
        for s in bag(words(t)):
            known.setdefault(s, set()).add(i)
    expected = {}
    for d, t in docs:
        ws = words(t)
        near = set().union(*(known.get(tuple(ws[a : a + n]), set()) for n in (2, 3, 4, 5) for a in range(len(ws) - n + 1)))
        expected |= plain_leaks([(d, t)], [items[i] for i in near])
    assert got == expected and len(got) >= 120


def test_leaks_of_repeated_and_null_ids(spark):
    item = " ".join(f"b{k}" for k in range(20))
    docs = spark.createDataFrame([(1, item, 0), (1, item, 0), (1, "clean text", 0), (None, "x " + item, 0), (None, None, 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (None, item)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.contaminated(docs, bench).collect()) == ["1", "1", "None"]


def test_leaks_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    shared = {s for _, t in items for s in bag(words(t))}
    near = [(d, t) for d, t in docs if len(words(t)) < 400 or shared & set(bag(words(t)))]
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.end_word) for r in decontaminate.op8_decontaminate(spark, DATA).collect()}
    assert got == plain_leaks(near, items)  # the rest shares no shingle with any item


def test_pipeline_equals_its_parts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    from skein.llm import toxicity

    left = {r.doc_id: rows[r.doc_id] for r in toxicity.op6_toxicity(spark, DATA).collect() if not r.predicted}
    last = {}
    for d in sorted(left):
        last[re.sub("[A-Z]", lambda m: m[0].lower(), left[d] or "")] = d
    left = {d: left[d] for d in last.values()}
    left = {d: t for d, t in left.items() if plain_components(list(left.items()), 80)[d][1] == d} if len(left) < 60 else {d: left[d] for d, (_, c) in plain_components(list(left.items()), 80).items() if c == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    shared = {s for _, t in items for s in bag(words(t))}
    leaks = {d for d, _ in plain_leaks([(d, t) for d, t in left.items() if shared & set(bag(words(t)))], items)}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(left) - leaks
    assert len(corpus_pipeline.STAGES) == 5 and all(r.n_tokens >= 0 for r in got)


def test_every_stage_meets_odd_rows(spark, tmp_path):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    near = [f"w{k}" for k in range(60)]
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "Same text here", "en", "s", 1), (3, "same TEXT here", "en", "s", 1), (None, "same text here", None, None, None), (5, " ".join(near), "en", "s", 5),
        (6, " ".join([*near[:-2], "x", "y"]), "en", "s", 5), (7, "before " + item + " after", "en", "s", 5), (None, "alone and null " * 6, None, None, None), (9, "long words " * 40_000, "de", "s", 3),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    clash = docs.withColumn("digest", F.lit("x")).withColumn("cluster", F.lit(1)).withColumn("score", F.lit(2)).withColumn("_kept", F.lit(3)).withColumn("words", F.lit("w")).withColumn("place", F.lit(4))
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    want = {
        "exact dedup": ["2", "3", "3", "5", "6", "7", "9", "None"], "near-duplicates": None, "decontamination": sorted(str(r[0]) for r in rows if r[0] != 7),
    }
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, clash):
            out = stage(spark, df, DATA)
            assert name == "pieces" or out.columns == df.columns
            got = ids(out)
            assert want.get(name) is None or got == want[name], name
            if name == "near-duplicates":
                assert "6" not in got and {"1", "2", "5", "7", "9"} <= set(got)
            if name == "pieces":
                assert len(got) == len(rows)
        assert stage(spark, docs.where("false"), DATA).count() == 0


def test_components_of_the_table_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA[:-5]}0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets, holders = {d: set(bag(words(t))) for d, t in rows}, {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    for percent in (85, 80):
        up = {d: d for d in sets}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for d, s in sets.items():
            for e, both in Counter(e for x in s for e in holders[x] if e < d).items():
                if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                    up[max(find(d), find(e))] = min(find(d), find(e))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(docs, percent).collect()}
        assert got == {d: (len(s), find(d)) for d, s in sets.items()}
