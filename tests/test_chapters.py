"""Chapters, scenes, chunks and facts by hand and by their rules."""

import io
import random
import re
import zipfile

from conftest import DATA

from skein.operators import chapters as C
from skein.operators import facts as K

BODY = "It was a quiet place and nobody came by for a long while. " * 4


def test_chapters_of_a_text():
    text = f"Chapter One: The Start\n{BODY}\n\nCh. 2\n{BODY}{BODY}{BODY}\n\nEpilogue\nshort"
    got = C.chapters(text)
    assert [(n, t) for n, t, _, _ in got] == [(1, "The Start")]  # the second heading is too near
    far = f"Chapter One: The Start\n{BODY * 3}\n\nCh. 2 - Later\n{BODY * 3}\nChapter 3\ntoo near and too short"
    assert [(n, t) for n, t, _, _ in C.chapters(far)] == [(1, "The Start"), (2, "Later")]
    assert all(far[a:].lstrip().startswith(b[:20]) for _, _, b, a in C.chapters(far))
    assert C.chapters("just words") == [(1, "", "just words", 0)] and C.chapters(" \n") == []
    marked = f"# Prologue\n{BODY}\n## Notes\n{BODY}\n## Chapter 4: Four\n{BODY}\n# Tiny\nshort\n"
    assert [(n, t) for n, t, _, _ in C.chapters(marked)] == [(1, "Prologue"), (4, "Chapter 4: Four")]


def test_markdown_paragraphs_and_kinds():
    text = '# Head\n\n***\n\n[Skill Acquired: Leap]\n\n« Go, » dit Jorun Ash. Now!\n\n"Stay."\n\nPlain words here.\n\n\n'
    got = C.markdown_paragraphs(text)
    assert [k for _, k, *_ in got] == ["header", "scene_break", "blue_box", "dialogue", "dialogue", "narration"]
    assert all(text[a:b] == p for _, _, p, a, b, *_ in got) and got[3][5] == "Jorun Ash" and got[3][6] == 2 and got[5][7] == 3
    assert [C.kind_of(x) for x in ("**", "--", "——", "*-*", "[odd one]", "[level 3]", '""x', '"x', "—x", "⁂")] == ["scene_break", "scene_break", "scene_break", "narration", "narration", "blue_box", "narration", "dialogue", "dialogue", "scene_break"]


def test_html_paragraphs_by_hand():
    html = "<body><div><p>One <b>two</b></p><p>***</p></div><blockquote><p>inside</p> a quote</blockquote><ul><li><p>item</p></li></ul><div>plain</div><h2>Head</h2><p> </p><script>x</script><p>« Oui » dit Mara.</p>"
    got = C.html_paragraphs(html)
    assert [(k, t) for _, k, t, *_ in got] == [("narration", "Onetwo"), ("scene_break", "***"), ("narration", "insidea quote"), ("narration", "item"), ("narration", "plain"), ("header", "Head"), ("dialogue", "« Oui » dit Mara.")]
    assert [a for _, _, _, a, *_ in got][:3] == [0, 7, 11] and got[-1][5] == "Mara"
    assert C.html_paragraphs("") == []


def test_paragraph_offsets_hold():
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice(["a", "b c", "\n", "\n\n", " ", "\n \n", "x."]) for _ in range(r.randint(0, 30)))
        got = C.paragraphs(text)
        assert all(text[a:b].strip() == p and p for p, a, b in got)
        assert "".join(re.sub(r"\s", "", p) for p, _, _ in got) == re.sub(r"\s", "", text)


def test_scenes_by_hand():
    text = "Start here.\n\n***\n\nMore.\n\nThe next morning they left.\n\nHe went. In the end.\n\nBack at the camp."
    assert [text[a : a + 8] for a in C.scenes(text)] == ["More.\n\nT", "The next", "Back at "]
    names = "\n\n".join(["Jorun ate.", "Jorun ran.", "The sun. Jorun sat.", "Mirella came.", "Mirella and Jorun."])
    assert [names[a : a + 7] for a in C.scenes(names)] == ["Mirella"]
    assert C.scenes("") == [] and C.scenes("***") == [] and C.segments("") == [(0, "", 0)]
    assert C.segments("ab\ncd\nef", 5) == [(0, "ab\ncd", 0), (1, "\nef", 5)] and C.segments("abc\ndef", 5) == [(0, "abc\n", 0), (1, "def", 4)]


def chunk_rules(text, size, overlap, least):
    got, parts = C.chunks(text, size, overlap, least), C.paragraphs(text)
    assert [c[0] for c in got] == list(range(len(got))) and not (got and got[0][5])
    starts = {a for _, a, _ in parts}
    whole = sum(C.tokens(p) for p, _, _ in parts)
    if whole >= least and not any(C.tokens(p) > size for p, _, _ in parts):
        seen = set()
        for _, chunk, a, b, _, _ in got:
            assert a in starts
            held = [p for p, x, y in parts if a <= x and y <= b]
            assert chunk == "\n\n".join(held)
            seen |= set(range(a, b))
        assert all(set(range(x, y)) <= seen for _, x, y in parts)  # nothing is lost
        for one, two in zip(got, got[1:], strict=False):
            shared = [p for p, x, y in parts if two[2] <= x and y <= one[3]]
            assert sum(map(C.tokens, shared)) <= overlap
    return got


def test_chunks_keep_their_rules():
    r = random.Random(3)
    for _ in range(150):
        text = "\n\n".join(r.choice(["The next morning. ", "Jorun. ", "Mirella saw it. ", "***", ""]) + "word " * r.randint(0, 30) for _ in range(r.randint(0, 25)))
        chunk_rules(text, r.choice([40, 80]), r.choice([0, 10, 30]), r.choice([8, 20]))


def test_chunks_by_hand():
    word = "abcd" * 10  # ten tokens
    text = "\n\n".join([word] * 7)
    got = C.chunks(text, 30, 10, 15)
    assert [c[4] for c in got] == [30, 30, 30] and [c[2] for c in got] == [0, 84, 168] and got[-1][3] == len(text)
    assert C.chunks(word, 30, 10, 15) == [] and C.chunks(" \n", 30, 10, 15) == []
    tail = C.chunks("\n\n".join([word] * 4), 30, 0, 15)
    assert len(tail) == 1 and tail[0][4] == C.tokens("\n\n".join([word] * 4))  # the small rest joins the chunk before
    long = ". ".join(["x" * 39] * 9) + "."
    parts = C.chunks(long, 30, 10, 5)
    assert len(parts) == 3 and [p[0] for p in parts] == [0, 1, 2] and all(p[4] <= 30 for p in parts)
    scene = "\n\n".join([word, word, "The next morning " + word, word])
    got = C.chunks(scene, 100, 0, 20)
    assert [c[5] for c in got] == [False, True] and got[1][1].startswith("The next")


def test_facts_by_hand():
    text = "[Skill Acquired: Leap - Rare]\n[Ability Learned: Dash (Epic)]\nLevel: 3 -> 4\nClass: Archer (D-grade)\n[Title earned: Bold]\n+5 Strength\nEvolution done -> Drake\n[Bloodline Awakened: Ash]\nProfession Obtained: Smith (2)\n[Blessing of Mother received now]\n[Something else here]\n[x]"
    got = K.facts(text)
    assert all(text[a:b] == raw for _, _, _, raw, a, b in got)
    by = {}
    for name, _, fields, *_ in got:
        by.setdefault(name, []).append(fields)
    assert by["skill_acquired"] == [{"name": "Leap", "rank": "Rare"}, {"name": "Dash", "rank": "Epic"}] and by["level_up"] == [{"old_value": "3", "new_value": "4"}]
    assert by["class_obtained"] == [{"name": "Archer", "tier_info": "D-grade"}] and by["stat_increase"] == [{"value": "5", "stat_name": "Strength"}] and by["evolution"] == [{"target": "Drake"}]
    assert {"content": "Something else here"} in by["blue_box_generic"] and not any("Leap" in f["content"] for f in by["blue_box_generic"])
    assert [s for s, *_ in K.shapes("[abcdef]\n+5 Might\n3 -> 4\nHP: 9\nLevel: 1 => 2")] == ["bracketed", "stat_gain", "progression", "labeled_value", "progression"]
    specs = [{"name": "a", "entity_type": "T", "regex": r"<(?P<name>\w+)>", "examples": ["<x>", "<y>", "<z>", "<w>", "no"]}, {"name": "b", "entity_type": "T", "regex": "(", "examples": ["("]}, {"name": "c", "entity_type": "T", "regex": "x", "examples": []}, {"name": "d", "entity_type": "T", "regex": "q", "examples": ["q", "r"]}]
    assert [p.name for p in K.valid_patterns(specs)] == ["a"] and K.facts("see <Ash>", K.valid_patterns(specs))[0][2] == {"name": "Ash"}
    assert [p.name for p in K.loaded_patterns({"x": {"pattern": "(", "entity_type": "T"}, "y": {"pattern": "a(b)", "entity_type": "T", "captures": {"name": 1}}})] == ["y"]


def test_mentions_by_hand():
    terms = K.search_terms([("mara ash", "Mara", "character", ["the Ash", " x "]), ("ash", "Ash", "place", []), ("", "no", "x", [])])
    text = "Mara met the ash. MARA ASH and Ashes, marathon."
    got = sorted(K.mentions(text, terms), key=lambda m: m[4])
    assert [(e, t, w) for e, _, t, w, _, _ in got] == [("mara ash", "Mara", "direct_name"), ("mara ash", "the ash", "alias"), ("mara ash", "MARA ASH", "direct_name")]
    assert all(text[a:b] == t for _, _, t, _, a, b in got)


def test_grounding_by_hand():
    text = "The quick brown fox jumps over the lazy dog."
    assert K.ground("quick brown", 4, 15, text) == ("exact", 1.0, 4, 15) and K.ground("lazy dog", 0, 3, text) == ("fuzzy", 0.7, 35, 43)
    assert K.ground("quick brawn fox", 0, 0, text)[:2] == ("fuzzy", 0.5) and K.ground("§§§§§§", 0, 2, text)[:2] == ("unaligned", 0.3)


def test_router_counts_equal_a_plain_expression(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(9001, "skill " + "é" * 3000 + " compétence battle", None, None, None), (9002, None, None, None, None)], docs.schema)
    rows = docs.unionByName(extra).selectExpr("doc_id", "text", "doc_id % 10 = 0 AS has_facts")
    for r in K.routed(rows).collect():
        t = r.text or ""
        n = {k: len(re.findall(r"\b(?:" + w + r")\b", t, re.I)) for k, (_, w) in K.SIGNALS.items()}
        passes = ["characters"] + ["systems"] * (n["systems"] >= 1 or r.has_facts) + ["events"] * (n["events"] >= 2) + ["lore"] * (n["lore"] >= 3) + ["events"] * (n["events"] == 1)
        assert r.passes == ("characters,systems,events,lore" if len(t) < 2000 else ",".join(passes))


def test_verification_reasons(spark):
    text = "Mara kills the wolf in the old tower. Jorun the guard wept near stone hall."
    rows = [
        (1, "character", "", "", "", []), (1, "item", "Silver Sword", "", "", []), (1, "character", "guard", "", "", []), (1, "event", "mara", "", "", []), (1, "event", "Mara kills", "", "", []), (1, "item", "Jorun", "", "", []),
        (1, "psychological_state", "wept", " ", "", []), (1, "narrative_role", "wept", "nobody here", "", []), (1, "narrative_role", "wept", "Mara", "Brave", []), (1, "social_relationship", "wolf", "", "", ["a"]), (1, "social_relationship", "kills the wolf", "", "", ["a", "b"]),
        (1, "setting", "tower", "", "", []), (1, "character_feature", "wolf", "Mara", "", []), (1, "location", "old tower", "", "", []), (1, "item", "stone tower", "", "", []),
    ]
    e = spark.createDataFrame(rows, "chapter int, entity_type string, name string, character string, role_type string, participants array<string>")
    c = spark.createDataFrame([(1, text)], "chapter int, text string")
    known = spark.createDataFrame([("mara",), ("jorun ",)], "name string")
    got = {(r.entity_type, r.name, r.character, len(r.participants)): r.reason for r in K.verified(e, c, known).collect()}
    want = ["empty_name", "name_not_in_text", "generic_role_as_character", "event_named_after_character", "event_starts_with_character", "known_character_wrong_type", "golem_missing_character_ref", "golem_character_not_found", "golem_role_is_trait", "golem_insufficient_participants", "golem_sr_looks_like_event", "golem_setting_is_location", None, None, None]
    assert [got[(t, n, w, len(p))] for _, t, n, w, _, p in rows] == want


def test_boxes_are_typed(spark):
    rows = [(1, 0, "[Skill Acquired: A]", "blue_box"), (1, 2, "Level 1 -> 2", "blue_box"), (1, 5, "[Title earned: B]", "blue_box"), (1, 6, "x", "narration"), (2, 0, "+3 Wisdom", "blue_box")]
    got = sorted((r.doc_id, r.first, r.last, r.box_type) for r in C.blue_boxes(spark.createDataFrame(rows, "doc_id int, position int, text string, kind string")).collect())
    assert got == [(1, 0, 2, "mixed"), (1, 5, 5, "title"), (2, 0, 0, "stat_block")]


def epub(chapters, cover=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, (n, _) in enumerate(chapters))
        z.writestr("OEBPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Ash</dc:title><dc:creator>A. Writer</dc:creator><dc:language>en</dc:language><meta name="calibre:series" content="Embers"/><meta name="calibre:series_index" content="2"/><meta name="cover" content="cov"/></metadata><manifest>{items}<item id="css" href="s.css" media-type="text/css"/><item id="cov" href="c.jpg" media-type="image/jpeg"/></manifest><spine>{"".join(f"<itemref idref=&quot;c{i}&quot;/>".replace("&quot;", chr(34)) for i in range(len(chapters)))}</spine></package>')
        for n, html in chapters:
            z.writestr(f"OEBPS/{n}", html)
        z.writestr("OEBPS/s.css", "p { margin: 0 }")
        z.writestr("OEBPS/c.jpg", b"image")
    return out.getvalue()


def test_files_become_chapters(spark, tmp_path):
    from skein.sources import files

    html = f"<html><body><h1>Chapter 5: Five</h1><p>{BODY}</p></body></html>"
    (tmp_path / "a.epub").write_bytes(epub([("toc.xhtml", f"<h1>Contents</h1><p>{BODY * 2}</p>"), ("one.xhtml", html), ("two.xhtml", f"<p>{BODY}</p>"), ("tiny.xhtml", "<p>x</p>")]))
    (tmp_path / "b.txt").write_bytes(f"Chapter 1\n{BODY * 3}\nChapter 1\n{BODY * 3}".encode() + b"\xff")
    (tmp_path / "c.doc").write_bytes(b"?")
    (tmp_path / "d.epub").write_bytes(b"no zip")
    got = files.ingested(spark, f"file://{tmp_path}").collect()
    rows = sorted((r.path.rsplit("/", 1)[1], r.number, r.title) for r in got if r.error is None)
    assert rows == [("a.epub", 2, ""), ("a.epub", 5, "Chapter 5: Five"), ("b.txt", 1, ""), ("b.txt", 2, "")]
    assert sorted(r.path.rsplit("/", 1)[1] for r in got if r.error is not None) == ["c.doc", "d.epub"]
    meta = {r.path.rsplit("/", 1)[1]: r for r in files.metadata(spark, f"file://{tmp_path}").collect()}
    assert meta["a.epub"].title == "Ash" and meta["a.epub"].series == "Embers" and meta["a.epub"].series_index == 2.0 and meta["a.epub"].cover == "OEBPS/c.jpg" and meta["a.epub"].css == "p { margin: 0 }"
