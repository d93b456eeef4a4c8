import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from skein.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    same(QUERIES[name](spark, DATA), con, ORACLES[name])


def test_communities_by_plain_votes(spark):
    from collections import Counter, defaultdict

    from skein.operators.graph import spread_labels

    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    links = defaultdict(set)
    for x, y in pairs:
        links[x].add(y)
        links[y].add(x)
    labels = {x: x for x in links}
    for _ in range(3):
        votes = {x: Counter(labels[y] for y in links[x]) for x in links}
        labels = {x: min(v, key=lambda k: (-v[k], k)) for x, v in votes.items()}
    got = spread_labels(spark.createDataFrame(pairs, "a string, b string"), 3).collect()
    assert {r.id: r.community for r in got} == labels


def test_components_by_union_find(spark):
    import random

    from skein.operators.components import connected_components

    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5), (None, 3)]
    up = list(range(500))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            up[max(find(a), find(b))] = min(find(a), find(b))
    ends = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    for one_task in (0, 300_000):
        got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
        assert got == {x: find(x) for x in ends}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors_by_loop(spark):
    from skein.operators.retrieval import without_near

    rows = [(1, k, k, [float(k % 3), 1.0, k / 10]) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, rank int, embedding array<float>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    kept = []
    for _, d, _, v in rows:
        if all(cos(v, w) <= 0.9 for _, w in kept):
            kept.append((d, v))
    assert sorted(r.doc_id for r in without_near(df, 0.9).collect()) == [d for d, _ in kept]


def test_spans_are_exact_and_apart(spark):
    from skein.operators.text import spans

    rows = [(1, 0, "The Red Tower and the red tower's Tower; retower")]
    got = spans(spark.createDataFrame(rows, "doc_id long, position int, text string"), ["tower", "the red tower", "x"]).orderBy("start").collect()
    assert [(r.term, rows[0][2][r.start : r.end].lower()) for r in got] == [("the red tower",) * 2, ("the red tower",) * 2, ("tower",) * 2]


def test_alias_closure(spark):
    from skein.operators.resolve import closure

    got = closure(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")).collect()
    assert {r.name: r.canonical for r in got} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_interval_modes_differ_at_their_end(spark):
    from skein.operators.temporal import holding

    spans = spark.createDataFrame([(1, 5), (5, None), (3, 4)], "valid_from int, valid_to int")
    assert holding(spans, 5).count() == 2
    assert holding(spans, 5, half_open=True).count() == 1
    assert spans.where(F.col("valid_to").isNull()).count() == 1


def test_fuzzy_pairs_equal_all_pairs(spark):
    import random

    from skein.functions import with_normal_name
    from skein.operators import resolve as N

    r = random.Random(11)
    words = ["ashen", "blade", "of", "the", "north", "king", "o'neil", "a", "jo", "smith", "smyth", "éclair", "ii", "x", "grey", "gray-wolf"]
    names = {" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(160)} | {"b", "ab", "zab", "jon smith", "smith jon", "Jon  Smith", "abc", "xabcx", "123 4", "1234"}
    for n in list(names)[:60]:
        k = r.randrange(len(n))
        names.add(n[:k] + r.choice("aeiou") + n[k + 1 :])
    got = {(x.a, x.b): x.score for x in N.fuzzy_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    form = {x.normal for x in with_normal_name(spark.createDataFrame([(n,) for n in names], "name string"), "name", "normal").collect()} - {""}
    expected = {(a, b): s for a in form for b in form if a < b and (s := N.likeness(a, b)) >= 85}
    assert got == expected and len(expected) > 100


def test_the_four_ratios():
    from skein.operators import resolve as N

    assert N.ratio("abcd", "abed") == 75 and N.part_ratio("smith", "jon smith") == 100 and N.sorted_ratio("jon smith", "Smith, Jon") == 100
    assert N.set_ratio("jon smith", "jon adam smith") == 100 and N.set_ratio("jon", "adam") < 50 and N.likeness("", "a") == 0


def test_dense_search_equals_all_cosines(spark, monkeypatch):
    import numpy as np

    from skein.operators import retrieval as R

    monkeypatch.setattr(R, "ITEM_SHARD", 60)
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(300)
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in v.collect()]
    odd = spark.createDataFrame([(90001, [0.0] * 64), (90002, None)], "vec_id long, embedding array<float>")
    items = v.select("vec_id", "embedding").unionByName(odd).select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = items.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id").withColumnRenamed("embedding", "vector")
    got = {}
    for r in R.top(R.dense(items, asked, 7), 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for q, x in rows:
        if q % 20 == 0:
            every = sorted((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 6), i) for i, y in rows if i != q)[:7]
            assert [(d, s) for _, d, s in sorted(got[q])] == [(i, -s) for s, i in every]


def test_names_beyond_ascii_are_composed(spark):
    from skein.functions import with_normal_name

    df = spark.createDataFrame([("Les Étoiles", 1), ("la DE the Tour", 2), (None, 3), ("L'an d'or", 4)], "name string, normal_of int")
    assert {r.normal_of: r.normal for r in with_normal_name(df, "name", "normal").collect()} == {1: "étoiles", 2: "the tour", 3: None, 4: "an d'or"}
