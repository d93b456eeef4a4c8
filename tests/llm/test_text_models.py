import random
import time
import zlib

import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import html_text, language, pieces, quality, toxicity


def held_rows(spark, got, modulus, remainder):
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == spark.read.parquet(f"{DATA[:-5]}0.01/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % modulus == remainder) for d, r in rows.items())
    return rows


LARGER = DATA[:-5] + "0.01"


def test_quality_on_held_out_labels(spark):
    rows = held_rows(spark, quality.op1_quality(spark, LARGER), 4, 2)
    labels = [(r.quality, rows[r.doc_id]) for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(y == p.predicted for y, p in labels) / len(labels) > 0.85
    assert all(0 <= p.score <= 1 and p.predicted == int(p.score >= 0.7) for p in rows.values())


def test_toxicity_on_held_out_labels(spark):
    rows = held_rows(spark, toxicity.op6_toxicity(spark, LARGER), 5, 0)
    labels = [(r.toxic, rows[r.doc_id]) for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert area(labels) > 0.95 and sum(p.predicted for y, p in labels if y) >= 0.7 * sum(y for y, _ in labels)
    assert sum(not p.evidence for p in rows.values()) <= 2  # texts without any word of the sample


def area(labels):
    """Probability that a row of label 1 has the higher score, ties by half."""
    ones, zeros = [p.score for y, p in labels if y], [p.score for y, p in labels if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_toxicity_equals_plain_cosine(spark):
    """Neighbours, votes and scores of the table against sums over all pairs of texts and examples."""
    import math

    import numpy as np

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(spark, docs, DATA)
    place = {d: i for i, d in enumerate(model.ids)}
    texts = {r.doc_id: r.text for r in docs.collect()}

    def unit(text):
        v = {model.term[w]: (1 + math.log(c)) * model.factor[model.term[w]] for w, c in toxicity.bag_of(text or "").items() if w in model.term}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    examples = [unit(texts[d]) for d in model.ids]
    assert len(model.term) == len({w for d in model.ids for w in toxicity.bag_of(texts[d])})
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, DATA).collect()}
    for d, text in texts.items():
        v = unit(text)
        near = sorted((-round(sum(x * e.get(t, 0) for t, x in v.items()), 9), i) for i, e in enumerate(examples))[: toxicity.K]
        sims = [(-s, i) for s, i in near if s < 0]
        vote = sum(s for s, i in sims if model.labels[i]) / (sum(s for s, _ in sims) + toxicity.FAINT)
        assert abs(got[d].score - 1 / (1 + np.exp(-(vote * model.slope + model.intercept)))) < 1e-5
        assert not sims or abs(float(got[d].evidence.split(",")[0].split(":")[2]) - sims[0][0]) < 0.002
    assert set(place) <= set(texts)


def test_language_on_held_out_rows(spark):
    rows = held_rows(spark, language.op9_language(spark, LARGER), 3, 1)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    held = [d for d, r in rows.items() if r.held_out]
    assert sum(truth[d] == rows[d].lang_pred for d in held) / len(held) > 0.97


def test_language_equals_plain_mixture(spark):
    """Predictions of the table against a mixture over all subsets of the languages by plain sums."""
    import math
    from itertools import combinations

    import numpy as np

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.learned(docs)
    got = {r.doc_id: r for r in language.op9_language(spark, DATA).collect()}
    rows = docs.collect()
    known = [(r.text, r.lang) for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    assert model["names"] == sorted({lang for _, lang in known})
    assert np.array_equal(model["log"], language.fit(known)["log"])  # the sample is the whole of so small a table
    for r in rows[:60]:
        grams, start = language.word_grams(r.text or "")
        if not len(start):
            assert got[r.doc_id].lang_pred == "und"
            continue
        words = np.add.reduceat(model["log"][grams], start).astype(float)
        best = None
        for n in range(1, len(model["names"]) + 1):
            for chosen in combinations(range(len(model["names"])), n):
                like, share = np.exp(words[:, chosen] - words.max(1)[:, None]), np.full(n, 1 / n)
                for _ in range(300 if n > 1 else 0):
                    part = like * share
                    share = (part / part.sum(1)[:, None]).mean(0)
                value = np.log(like @ share).sum() - (n - 1) * (0.5 * math.log(len(words)) + 1)
                if best is None or value > best[0] + 1e-9:
                    best = value, [model["names"][i] for i in chosen], share
        assert got[r.doc_id].lang_pred == best[1][int(np.argmax(best[2]))] and abs(got[r.doc_id].score - best[2].max()) < 0.02


def test_three_hundred_languages(spark):
    r = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    stock = {f"l{k:03}": ["".join(r.choices(alphabet, k=6)) for _ in range(12)] for k in range(300)}
    rows = [(i, " ".join(r.choices(stock[f"l{i % 300:03}"], k=40)), f"l{i % 300:03}") for i in range(1500)]
    rows += [(5000, "word " * 10_000, "long"), (5001, None, "gone"), (5002, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learned(docs)
    learnable = {lang for d, text, lang in rows if lang and text and zlib.crc32(str(d).encode()) % 3 != 1}
    assert learnable <= set(model["names"]) and len(learnable) > 295
    got = {x.doc_id: x.lang_pred for x in language.predicted(docs, model).collect()}
    assert sum(got[d] == lang for d, _, lang in rows[:1500]) > 1470 and got[5001] == "und"
    assert language.learned(docs.where("false"))["names"] == [] and language.predicted(docs.where("false"), model).count() == 0


def test_models_meet_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x " * 100_000, 5), (2, "", 5)], "doc_id long, text string, score int")
    q = quality.scored(docs, quality.fit([], (0, 0))).collect()
    t = toxicity.scored(docs, toxicity.ToxicityModel([], (0, 0))).collect()
    lang = language.predicted(docs, language.fit([("der die und das", "de"), ("the and of", "en")])).collect()
    assert [r.score for r in q] == [0.5] * 4 and [r.score for r in t] == [0.0] * 4
    assert [r.lang_pred for r in lang if r.doc_id != None] == ["und"] * 3  # noqa: E711
    assert language.predict("123 !?", language.fit([("abc", "a")])) == ("und", 0.0)
    assert quality.scored(docs.where("false"), quality.fit([], (0, 0))).count() == 0


def test_block_max_search_is_exact():
    import numpy as np

    r = random.Random(1)
    vectors = [{t: r.random() for t in r.sample(range(40), r.randint(0, 8))} for _ in range(1700)]
    rows = [(np.array(sorted(v), np.int64), np.array([v[t] for t in sorted(v)])) for v in vectors]
    for dense in (0, 5, 40):
        index = toxicity.BlockMaxIndex(rows, 40, dense)
        queries = [{t: r.random() for t in r.sample(range(40), r.randint(0, 9))} for _ in range(60)]
        got = index.search([(np.array(list(q), np.int64), np.array(list(q.values()))) for q in queries], 15)
        for q, near in zip(queries, got, strict=True):
            every = sorted((-round(sum(w * v.get(t, 0) for t, w in q.items()), 6), i) for i, v in enumerate(vectors))
            assert np.allclose([s for s, _ in near], [-s for s, _ in every[:15] if s < 0], atol=3e-6) and len(near) == min(15, sum(s < 0 for s, _ in every))
    assert toxicity.BlockMaxIndex([], 3).search([(np.array([1]), np.array([1.0]))], 5) == [[]]


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


PARTS = st.lists(st.sampled_from([" ", "  ", "a", "the", "▁", "\t", "\n", "é", "\x00", "𝒳", "日本", "<s>", "ing", "ING", "\xa0", "22", "́", "    ", "re", "\r", "<0x41>", "İ"]), max_size=20).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.one_of(PARTS, st.text(max_size=40)))
def test_pieces_equal_the_library(sp, text):
    text = text.encode("utf-8", "ignore").decode()
    coder = pieces.from_model(pieces.model_path())
    ids = sp.encode(text)
    assert coder.encode(text) == ids
    assert "".join(t for _, t in coder.code_parts(text))[1:] == sp.decode(ids) == coder.decode(ids)


def test_pieces_of_the_table_and_long_texts(spark, sp):
    coder = pieces.from_model(pieces.model_path())
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect():
        assert coder.encode(r.text) == sp.encode(r.text)
    for text in (" " * 3000, "a" * 5000, "ab " * 4000, "\n" * 2000):
        assert coder.encode(text) == sp.encode(text)
    rng = random.Random(2)
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/=") for _ in range(1_000_000))
    begin = time.time()
    assert coder.encode(run) == sp.encode(run) and time.time() - begin < 30
    twice = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, None, "z")], "doc_id long, text string, n_tokens string")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in pieces.coded(twice).collect())
    assert got[0] == got[1] and got[2][1] == 0 and pieces.coded(twice.where("false")).count() == 0
    for _ in range(500):
        ids = [rng.randrange(3, 259) if rng.random() < 0.5 else rng.randrange(32000) for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == sp.decode(ids)


LONG = "some prose of an article that goes on for more than a few words and ends in a full stop. " * 2
SAID = LONG.strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><nav><a href=x>Home</a></nav><div class='ad'>buy this now</div><article><header><h1>A &lt;b&gt; &amp;amp;</h1></header><p>One<br>two\n three.<p><b>Four</p><div id=comments><p>a reader says</div></article><script>var t='</p>'</script><footer>&copy; us", "A <b> &amp;\nOne two three.\nFour"),
        # nothing in an article goes for a word in a name that is none of a menu, notice or advert
        (f"<article><h1>T</h1><section id='legal-history'><p>{LONG}</p></section><p class='tags'>a b</p><p data-id='share'>x y</p></article>", f"T\n{SAID}\na b\nx y"),
        # rows of links go, a link among prose stays, and so does a list of words
        (f"<article><p>{LONG}</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>{LONG}</p><p><a href=3>lone link</a></p><ul><li>red<li>blue</ul></article>", f"{SAID}\n{SAID}\nlone link\nred\nblue"),
        # pages without an article: prose and what stands beside it
        (f"<div><h1>Title here</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><ul><li>one<li>two</ul><p>{LONG}</p></div><div class=cookie-banner>{LONG}</div><footer>x</footer>", f"Title here\n{SAID}\nShort.\n{SAID}\none\ntwo\n{SAID}"),
        (f"<ul><li><a href=1>Home</a><li><a href=2>News</a></ul><h1>Title</h1><p>{LONG}<p>{LONG}<div id=comments><p>{LONG}</div>", f"Title\n{SAID}\n{SAID}"),
        (f"<div class='site-header'>Our paper</div><form>{LONG}</form><aside>{LONG}</aside><p>{LONG}</p>", SAID),
        # beside an article, a notice without a mark goes, an article's own header stays
        (f"<div>We use some files on your device.</div><article><div class='post-header'><h1>Hi</h1></div><p>short one</p><div class='comment-list'><p>{LONG}</p></div></article>", "Hi\nshort one"),
        ("", ""), (None, ""), ("<!-- never closed <p>text", ""),
    ],
)
def test_pages_by_hand(html, text):
    assert html_text.main_text(html) == text


def test_long_pages_are_read_whole():
    assert html_text.main_text("<p>" + "word " * 100_000).count(" ") == 99_999


def test_block_features_decide(spark):
    """The same blocks with and without links, in the same containers, are judged differently."""
    for body in ("<article><p>{p}</p>{x}{x}{x}</article>", "<div><p>{p}</p>{x}{x}{x}<p>{p}</p></div>"):
        plain = html_text.main_text(body.format(p=LONG, x="<p>see this and that</p>"))
        links = html_text.main_text(body.format(p=LONG, x="<p><a href=x>see this and that</a></p>"))
        assert plain.count("see this") == 3 and links.count("see this") < 3


def test_pages_of_the_table_equal_their_articles(spark):
    import re
    from html import unescape

    for r in html_text.op10_html(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + LONG, 1), (1, "u", "<p>" + LONG, 1), (None, None, None, 1), (2, "v", "", 1)], "page_id long, url string, html string, text int")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extracted(pages).collect())
    assert got == [("1", SAID, len(SAID)), ("1", SAID, len(SAID)), ("2", "", 0), ("None", "", 0)]
    assert html_text.extracted(pages.where("false")).count() == 0


def test_equal_languages_go_to_the_first():
    model = language.fit([("aba aba", "b"), ("aba aba", "a")])
    assert language.predict("aba aba", model)[0] == "a" and language.predict("", model) == ("und", 0.0)


def test_quality_equals_plain_sizes(spark):
    """The scores of the table from sizes that a new compressor for each block gives, and the curve written out."""
    import math

    import zstandard as zstd

    from skein.llm.common import crc_is, labelled_sample

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.fit(*labelled_sample(docs, spark.read.parquet(f"{DATA}/labels.parquet"), "quality", lambda key: crc_is(key, 4, 2), quality.PER_CLASS, quality.LONGEST))
    got = {r.doc_id: r.score for r in quality.op1_quality(spark, DATA).collect()}

    def size(block, dictionary):
        return len(zstd.ZstdCompressor(level=quality.LEVEL, dict_data=zstd.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False, write_checksum=False).compress(block))

    off = 0
    for r in docs.collect()[:60]:
        raw = (r.text or "").encode()
        parts = [raw[i : i + quality.BLOCK] for i in range(0, len(raw), quality.BLOCK)]
        more = sum(size(x, model["bad"]) - size(x, model["good"]) for x in parts)
        x = (more + quality.PRIOR_BYTES * model["average"]) / (len(raw) + quality.PRIOR_BYTES)
        off = max(off, abs(got[r.doc_id] - 1 / (1 + math.exp(-(x * model["slope"] + model["intercept"])))))
    assert off < 0.02  # a dictionary that is digested beforehand may code a block by a few bytes otherwise


def test_runs_of_spaces_and_tied_scores_are_backtracked(sp):
    """Every chunk goes by compatible neighbours, which equals merging also where scores are tied or out of order."""
    coder = pieces.from_model(pieces.model_path())
    seen = []
    coder_chunk = coder.backtrack
    coder.backtrack = lambda text: seen.append(text) or coder_chunk(text)
    try:
        for n in range(2, 90):
            for word in ("", "the", "é日x", "\n", "<s>", "İng"):
                assert coder.encode(" " * n + word) == sp.encode(" " * n + word)
                assert pieces.SPACE * (n + 1) + word in seen
    finally:
        del coder.backtrack
    rng = random.Random(3)
    for _ in range(60):
        letters = f"ab{pieces.SPACE}"
        made = sorted({"".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(rng.randint(3, 40))})
        names = [f"<0x{b:02X}>" for b in range(256)] + list(letters) + made
        own = pieces.MergePieces(names, [-float(rng.randint(0, 6)) for _ in names], list(range(256)), set(), -1)
        for _ in range(60):
            text = "".join(rng.choices(f"abc{pieces.SPACE}", k=rng.randint(1, 30)))
            assert own.backtrack(text) == own.merge(text)


def test_digests_of_texts_are_of_decoded_ids(spark, monkeypatch):
    import hashlib

    docs = spark.createDataFrame([(1, "a\n  b é𝒳")], "doc_id long, text string")
    coder = pieces.from_model(pieces.model_path())
    plain, asked = coder.decode, []
    monkeypatch.setattr(coder, "decode", lambda ids: asked.append(ids) or plain(ids), raising=False)
    run = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f) or self)
    pieces.coded(docs)
    import pyarrow as pa

    batch = next(run[0](iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a\n  b é𝒳"]})])))
    assert [list(map(int, ids)) for ids in asked] == [coder.encode("a\n  b é𝒳")]
    assert batch.column(3).to_pylist() == [hashlib.sha256(plain(asked[0]).encode()).hexdigest()]


def test_a_word_is_backtracked_once_whatever_stands_beside_it(sp, monkeypatch):
    """Texts are parted where no piece holds both neighbours, and only the ids of a whole text are decoded."""
    coder, seen, joined = pieces.from_model.__wrapped__(pieces.model_path()), [], []
    chunk, join = coder.backtrack, coder.join
    monkeypatch.setattr(coder, "backtrack", lambda text: seen.append(text) or chunk(text), raising=False)
    monkeypatch.setattr(coder, "join", lambda ids: joined.append(ids) or join(ids), raising=False)
    text = 'thshing thshing, "thshing" thshing.\nthshing!! thshing\tthshing?é (thshing) thshing日thshing'
    assert coder.encode(text) == sp.encode(text) and not joined
    assert sorted(x for x in seen if "thshing" in x) == ["thshing", f"{pieces.SPACE}thshing"]
    assert len(seen) == len(set(seen)) and coder.decode(coder.encode(text)) == text and len(joined) == 1


def test_parted_texts_have_the_ids_of_the_whole():
    rng, space, cuts = random.Random(5), pieces.SPACE, 0
    for k in range(120):
        made = sorted({("" if rng.random() < 0.6 else space * rng.randint(1, 2)) + "".join(rng.choices(rng.choice(["abd", "de", "f", "g-]^"]), k=rng.randint(1, 4))) for _ in range(rng.randint(3, 40))} | ({"a" + space} if k % 10 == 0 else set()))
        names = [f"<0x{b:02X}>" for b in range(256)] + sorted({*"abdefg-]^", space}) + [n for n in made if len(n) > 1]
        own = pieces.MergePieces(names, [-float(rng.randint(0, 9)) for _ in names], list(range(256)), set(), -1, k % 3 > 0)
        for _ in range(60):
            text = "".join(rng.choices("abcdefgh-]^\né  ", k=rng.randint(1, 30)))
            whole = own.merge((space if k % 3 else "") + text.replace(" ", space))
            assert own.encode(text) == [i for n in whole for i in ([own.ids[n]] if n in own.ids else n.encode())]
            cuts += len(own.code_chunks(text)) > 1
    assert cuts > 1000
