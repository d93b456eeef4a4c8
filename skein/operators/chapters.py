"""Structure of chapters: headings, paragraphs with offsets, scenes, chunks, boxes and measures of style.

Where a text has to be read in order (offsets, folds), a function takes one text and `read_each` runs it over a column in Arrow
batches, one row in, many out; the rest are column expressions.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------------

#: Headings of chapters.
HEADINGS = [
    re.compile(r"^\s*(?:chapter|chapitre)\s+(\d+|[a-z]+)(?:\s*[:\-–—]\s*(.+?))?$", re.I | re.M),
    re.compile(r"^\s*ch\.?\s*(\d+)(?:\s*[:\-–—]\s*(.+?))?$", re.I | re.M),
    re.compile(r"^(\d{1,4})\.\s+(.+?)$", re.M),
]
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
#: Kinds of paragraphs.
SCENE_MARK = r"^(\*\s*\*\s*\*|[*]{2,5}|[-]{2,5}|[—–]{2,5}|~{2,5}|[#]{2,5}|⁂)$"
BOX_MARK = r"(?i)^\[(Skill|Level|New Title|Title|Class|Compétence|Niveau|Titre|Classe|Profession|Bloodline|Quest|Achievement|System|Warning|Evolution|Stat|Status|Notification)\b"
SPEECH = "«“”—–"
#: Verbs after a quotation that name its speaker.
SAID = "dit murmura chuchota cria hurla demanda répondit souffla grommela lança s['’]exclama ajouta reprit continua expliqua affirma soupira gémit ordonna suggéra protesta marmonna annonça déclara interrogea confirma rétorqua proposa insista objecta admit concéda précisa observa".split()
SPEAKER = r'[»”"]\s*(?:' + "|".join(SAID) + r")(?:-t-(?:il|elle|on))?\s+([A-ZÀ-Ž][a-zà-ž]+(?:\s+[A-ZÀ-Ž][a-zà-ž]+)?)"
#: What begins a scene.
DIVIDER = re.compile(r"^[ \t]*(?:\*\s*\*\s*\*|---+|===+|~~~+|#{1,3}\s*$|[◆●■▪])[ \t]*$", re.M)
TIME_JUMP = re.compile(
    r"(?:^|\n)\s*(?:(?:The\s+)?(?:next|following)\s+(?:morning|day|evening|night|week|hour)"
    r"|(?:Three|Two|Four|Five|Six|Seven|Several|A\s+few|Many)\s+(?:days?|hours?|weeks?|months?|minutes?|years?)\s+(?:later|passed|went\s+by)"
    r"|(?:Hours?|Days?|Weeks?|Months?|Minutes?)\s+(?:later|passed)|When\s+(?:they|he|she|it|we|I)\s+(?:arrived|returned|woke|finally)|By\s+the\s+time"
    r"|(?:Much|Some\s+time|A\s+long\s+time|Not\s+long)\s+later|It\s+was(?:n't)?\s+(?:long|until|nearly|almost|well\s+past)"
    r"|Dawn\s+(?:broke|came|arrived)|(?:Morning|Night|Dusk|Twilight)\s+(?:came|fell|arrived|found))",
    re.I,
)
MOVED = re.compile(
    r"(?:^|\n)\s*(?:Back\s+(?:at|in|inside|outside)\s+(?:the|his|her|their)|(?:In|Inside|Outside|Beneath|Above|Beyond|Across|Within)\s+the\s+"
    r"|(?:They|He|She|I|We)\s+(?:entered|stepped\s+into|arrived\s+at|reached|approached)"
    r"|The\s+(?:room|hall|cave|dungeon|forest|city|camp|tent|tower|castle|village)\s+(?:was|looked|felt|smelled))",
    re.I,
)
SUBJECT = re.compile(r"(?:^|(?<=\.\s)|(?<=\n))([A-Z][a-z]{2,})")
NO_NAMES = frozenset(
    "The This That These Those There Then They Their What When Where Which While Who Why How His Her Its Our She But And For Not With From Into After Before Between Under Over Just Only Every Each Some Any "
    "All Most Many Much Such Very Still Even Now Here Back Down Once Soon Already Something Nothing Everything Everyone Someone Nobody Anything However Perhaps Maybe Another Without Within Beyond Above Below Around".split()
)
#: Sizes of chunks in tokens.
CHUNK, OVERLAP, LEAST = 1000, 100, 200
#: Pages and titles that are no chapters.
SKIPPED_FILES = r"(?i)(?:^|/)(?:toc|nav|cover|copyright|colophon|title(?:page)?|dedication|about|also[-_]by|acknowledgment|appendix|index|glossary|author[-_]note|frontmatter|backmatter|halftitle)(?:\.x?html?)?$"
SKIPPED_HEADS = r"(?i)^\s*(?:sommaire|table\s+(?:of\s+contents|des\s+mati[eè]res)|contents|copyright|couverture|cover|d[eé]dicace|remerciements|acknowledgments?|also\s+by|about\s+the\s+author|glossaire|glossary|titre|title\s*page|table\s+of\s+contents)\s*$"
NO_CHAPTERS = ["sommaire", "table des matières", "table of contents", "couverture", "cover", "copyright", "mentions légales", "colophon", "dédicace", "dedication", "remerciements", "acknowledgements", "préface", "preface", "avant-propos"]
#: What a box tells.
BOX_LEVEL, BOX_SKILL, BOX_TITLE = r"(?i)Level.*?(?:→|->|\d+\s*to\s*\d+)", r"(?i)(?:Skill|Ability)\s+(?:Acquired|Learned|Obtained)", r"(?i)Title\s+(?:earned|obtained|acquired)"
BOX_STAT = r"(?i)[+-]\d+\s+(?:Strength|Agility|Perception|Endurance|Vitality|Toughness|Wisdom|Intelligence|Willpower|Free\s+Points)"
#: Style.
FIRST_PERSON = r"\bI\s+(?:said|thought|felt|knew|saw|heard|wondered)\b"
THINKER = r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\s+(?:thought|felt|wondered|realized|knew|mused)\b"
SCENE_GAP = r"(?:\n\s*\n\s*(?:\*\s*\*\s*\*|---+|===+|~~~+)\s*\n|\n\s*\n\s*\n)"

BLANK = re.compile(r"\n\s*\n")
BLOCKS, HEADS = frozenset("p h1 h2 h3 h4 h5 h6 div blockquote li".split()), frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


# --- one text at a time -----------------------------------------------------------------------------------------------


def read_each(df: DataFrame, text: str, read: Callable[[str], Iterable[tuple]], schema: str, keys: list[str]) -> DataFrame:
    """The rows that `read` finds in each text (null as empty), with the row's keys before them."""
    from pyspark.sql.types import StructType

    found = StructType.fromDDL(schema)
    out = StructType([df.schema[k] for k in keys] + found.fields)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(out)
        for b in batches:
            own = [b.column(k).to_pylist() for k in range(len(keys))]
            rows = [(*(c[i] for c in own), *r) for i, t in enumerate(b.column(len(keys)).to_pylist()) for r in read(t or "")]
            cols = list(zip(*rows, strict=True)) or [[]] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, shape, strict=True)], schema=shape)

    return df.select(*keys, text).mapInArrow(run, out)


def number_of(raw: str) -> int:
    """Digits, or number words one to twenty; epilogue 9999; anything else 0."""
    raw = raw.strip().lower()
    return int(raw) if raw.isdigit() else 9999 if raw == "epilogue" else NUMBERS.index(raw) + 1 if raw in NUMBERS else 0


def markdown_chapters(text: str) -> list[tuple[int, str, str, int]]:
    """(number, title, text, offset) by headings of one to three marks that look like a chapter's or are of the first level."""
    heads = [m for m in re.finditer(r"^(#{1,3})\s+(.*?)$", text, re.M) if m[1] == "#" or any(h.match(m[2].strip()) for h in HEADINGS)]
    out: list[tuple[int, str, str, int]] = []
    for m, after in zip(heads, [*(n.start() for n in heads[1:]), len(text)], strict=False):
        line_end = text.find("\n", m.start(), after)
        body = text[line_end:after].strip() if line_end >= 0 else ""
        if len(body) >= 100:
            title = m[2].strip()
            told = [number_of(x[1]) for h in HEADINGS if (x := h.match(title))]
            out.append((next((n for n in told if n > 0), len(out) + 1), title, body, m.start()))
    return out


def chapters(text: str) -> list[tuple[int, str, str, int]]:
    """(number, title, text, offset): by Markdown headings, else by headings of any of three forms more than 500 characters
    apart; parts of fewer than 100 characters go; a text without headings is one chapter; an empty one has none."""
    if not text.strip():
        return []
    if marked := markdown_chapters(text):
        return marked
    marks: list[re.Match] = []
    for m in sorted((m for h in HEADINGS for m in h.finditer(text)), key=lambda m: m.start()):
        if not marks or m.start() - marks[-1].start() > 500:
            marks.append(m)
    if not marks:
        return [(1, "", text.strip(), 0)]
    out = []
    for place, (m, after) in enumerate(zip(marks, [*(n.start() for n in marks[1:]), len(text)], strict=True), 1):
        body = text[m.start() : after].strip()
        if len(body) >= 100:
            out.append((number_of(m[1]) or place, (m[2] or "").strip() if m.re.groups > 1 else "", body, m.start()))
    return out


def kind_of(text: str, head: bool = False) -> str:
    """header, scene_break, blue_box, dialogue or narration, in this precedence."""
    t = text.strip()
    if head:
        return "header"
    if re.match(SCENE_MARK, t):
        return "scene_break"
    if re.match(BOX_MARK, t):
        return "blue_box"
    return "dialogue" if t[:1] in tuple(SPEECH) or t.startswith('"') and not t.startswith('""') else "narration"


def speaker_of(text: str) -> str | None:
    return m[1] if (m := re.search(SPEAKER, text)) else None


def sentence_count(text: str) -> int:
    return sum(1 for s in re.split(r"[.!?]+(?:\s|$)", text) if s.strip())


def markdown_paragraphs(text: str) -> list[tuple[int, str, str, int, int, str | None, int, int]]:
    """(index, kind, text, start, end, speaker, sentences, words) of parts between blank lines."""
    out, at = [], 0
    for part in re.split(r"\n\n+", text):
        if block := part.strip():
            at = text.find(block, at)
            if block.startswith("#"):
                kind = "header"
            elif re.match(r"^[*\-_]{3,}$|^\*\s\*\s\*$", block):
                kind = "scene_break"
            elif re.match(BOX_MARK, block):
                kind = "blue_box"
            else:
                kind = "dialogue" if block[0] in SPEECH + '"' else "narration"
            out.append((len(out), kind, block, at, at + len(block), speaker_of(block) if kind == "dialogue" else None, sentence_count(block), len(block.split())))
            at += len(block)
    return out


class _Tree(HTMLParser):
    """Block elements in document order with their text nodes; end tags close up to the last open element of their name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # tag, holds a block other than a div, texts, parent's tag
        self.found: list[list] = []

    def handle_starttag(self, tag, attrs):
        node = [tag, False, [], self.open[-1][0] if self.open else ""]
        if tag in BLOCKS:
            self.found.append(node)
            if tag != "div":
                for above in self.open:
                    above[1] = True
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if data.strip() and not any(n[0] in ("script", "style") for n in self.open):
            for n in self.open:
                if n[0] in BLOCKS:
                    n[2].append(data.strip())


def html_paragraphs(html: str) -> list[tuple[int, str, str, int, int, str | None, int, int]]:
    """(index, kind, text, start, end, speaker, sentences, words) of block elements; what is right inside a quotation or a list
    item goes with it, a wrapper around other blocks is none; offsets run over the texts with one character between."""
    tree, out, at = _Tree(), [], 0
    tree.feed(html)
    tree.close()
    for tag, wraps, texts, parent in tree.found:
        if parent in ("blockquote", "li") or tag == "div" and wraps or not (text := "".join(texts)):
            continue
        kind = kind_of(text, tag in HEADS)
        out.append((len(out), kind, text, at, at + len(text), speaker_of(text) if kind == "dialogue" else None, sentence_count(text), len(text.split())))
        at += len(text) + 1
    return out


def paragraphs(text: str) -> list[tuple[str, int, int]]:
    """(stripped text, start of the part, start of the blank line after it) of the parts between blank lines."""
    gaps = [m.span() for m in BLANK.finditer(text)]
    starts, ends = [0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(text)]
    return [(p, a, b) for a, b in zip(starts, ends, strict=True) if (p := text[a:b].strip())]


def _begin(text: str, at: int) -> int:
    """Where the paragraph around a place begins: the first character after the last empty line before it."""
    line = text.rfind("\n\n", 0, at)
    low = line + 2 if line >= 0 else 0
    m = re.compile(r"[^\n\r \t]").search(text, low)
    return m.start() if m else low


def shifts(parts: list[tuple[str, int, int]], back: int = 3) -> set[int]:
    """Starts of paragraphs whose first subject is a name that none of the `back` paragraphs before holds, though they hold some."""
    if len(parts) <= back:
        return set()
    subjects = [SUBJECT.findall(p) for p, _, _ in parts]
    names = [set(s) - NO_NAMES for s in subjects]
    out = set()
    for i in range(back, len(parts)):
        near = set().union(*names[i - back : i])
        if near and names[i] and subjects[i][0] not in NO_NAMES | near:
            out.add(parts[i][1])
    return out


def scenes(text: str) -> list[int]:
    """Offsets at which a scene begins: after dividers, at jumps in time or place, at a change of the subject; never 0."""
    out = shifts(paragraphs(text))
    for m in DIVIDER.finditer(text):
        after = re.compile(r"[^\n\r \t]").search(text, m.end())
        out.add(after.start() if after else m.start())
    for m in (*TIME_JUMP.finditer(text), *MOVED.finditer(text)):
        lead = len(m[0]) - len(m[0].lstrip("\n\r \t"))
        out.add(_begin(text, m.start() + lead))
    return sorted(out - {0})


def opening(starts: list[int], offsets: list[int]) -> set[int]:
    """The paragraphs that open a scene: for each offset the first one that begins at or after it."""
    return {k for o in offsets if (k := bisect.bisect_left(starts, o)) < len(starts)}


def tokens(text: str) -> int:
    return len(text) // 4


def long_paragraph(text: str, start: int, size: int) -> list[tuple[str, int, int, int, bool]]:
    """(text, start, end, tokens, False) of runs of sentences of at most `size` tokens, if no sentence is longer."""
    out, held, cost = [], "", 0
    for sentence in [*re.split(r"(?<=[.!?])\s+", text), None]:
        if held and (sentence is None or cost + tokens(sentence) > size):
            if held.strip():
                out.append((held.strip(), start, start + len(held), cost, False))
            start, held, cost = start + len(held), "", 0
        if sentence is not None:
            held, cost = f"{held} {sentence}" if held else sentence, cost + tokens(sentence)
    return out


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, str, int, int, int, bool]]:
    """(position, text, start, end, tokens, begins a scene): paragraphs gathered up to `size` tokens.

    A chunk ends early before a scene once it has half of `least` tokens and a paragraph of its own. The next one begins with
    whole paragraphs of the one before, up to `overlap` tokens. A paragraph over `size` that would begin a chunk is parted by
    sentences. A tail of fewer than `least` tokens joins the chunk before; without one it is dropped.
    """
    parts = paragraphs(text)
    opens = opening([a for _, a, _ in parts], scenes(text))
    cost = [tokens(p) for p, _, _ in parts]
    out: list[tuple[str, int, int, int, bool]] = []
    first, fresh, end = 0, 0, 0  # the chunk holds parts[first:end]; those before `fresh` are overlap

    def close(stop: int) -> None:
        own = min(fresh, stop - 1)
        out.append(("\n\n".join(p for p, _, _ in parts[first:stop]), parts[first][1], parts[stop - 1][2], sum(cost[first:stop]), bool(out) and own in opens))

    for i in range(len(parts)):
        held = sum(cost[first:i])
        if first == i and cost[i] > size:
            made = long_paragraph(parts[i][0], parts[i][1], size)
            if made and out and i in opens:
                made[0] = (*made[0][:4], True)
            out += made
            first = fresh = end = i + 1
            continue
        if first < i and (held + cost[i] > size or i in opens and i > fresh and held >= least // 2):
            close(i)
            floor, first, kept = first, i, 0
            while first > floor and kept + cost[first - 1] <= overlap:
                first -= 1
                kept += cost[first]
            fresh = i
        end = i + 1
    if first < end:
        held = sum(cost[first:end])
        if held >= least:
            close(end)
        elif out:
            last = out[-1]
            joined = last[0] + "\n\n" + "\n\n".join(p for p, _, _ in parts[first:end])
            out[-1] = (joined, last[1], parts[end - 1][2], tokens(joined), last[4])
    return [(k, *c) for k, c in enumerate(out)]


def segments(text: str, most: int = 3000) -> list[tuple[int, str, int]]:
    """(index, text, offset) of parts of at most `most` characters, cut after a line where one ends in the second half."""
    out, at = [], 0
    while at < len(text) or not out:
        end = min(at + most, len(text))
        if end < len(text) and (line := text.rfind("\n", at, end)) > at + most // 2:
            end = line + 1
        out.append((len(out), text[at:end], at))
        at = end
        if not text:
            break
    return out


# --- columns ----------------------------------------------------------------------------------------------------------


def is_boilerplate(name: Column, heading: Column, text: Column) -> Column:
    """A page of contents and the like: by its file's name, its heading, or mostly short lines."""
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n")
    short = F.size(F.filter(lines, lambda ln: F.length(F.regexp_replace(ln, r"^\s+|\s+$", "")) < 80))
    listed = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) > 5) & (short > F.size(lines) * 0.8) & (F.size(lines) > 10)
    return name.rlike(SKIPPED_FILES) | heading.rlike(SKIPPED_HEADS) | listed


def is_no_chapter(title: Column, text: Column) -> Column:
    """A chapter without a story: by its title, or mostly lines that name chapters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda ln: F.lower(F.regexp_replace(ln, r"^\s+|\s+$", ""))), lambda ln: ln != "")
    named = F.size(F.filter(lines, lambda ln: ln.startswith("chapitre") | ln.startswith("chapter")))
    return F.lower(F.trim(F.coalesce(title, F.lit("")))).isin(NO_CHAPTERS) | ((F.size(lines) > 5) & (named / F.greatest(F.size(lines), F.lit(1)) > 0.4))


def box_type(text: Column) -> Column:
    """level_up, skill_acquisition, title, stat_block or mixed; more than one of the first three is mixed."""
    level, skill, title = (text.rlike(p) for p in (BOX_LEVEL, BOX_SKILL, BOX_TITLE))
    many = level.cast("int") + skill.cast("int") + title.cast("int")
    return F.when(many > 1, "mixed").when(level, "level_up").when(skill, "skill_acquisition").when(title, "title").when(text.rlike(BOX_STAT), "stat_block").otherwise("mixed")


def blue_boxes(rows: DataFrame, gap: int = 1) -> DataFrame:
    """(doc_id, first, last, paragraphs, text, box_type): boxes with at most `gap` other paragraphs between them are one.

    rows: doc_id, position, text, kind.
    """
    w = W.partitionBy("doc_id").orderBy("position")
    boxes = rows.where("kind = 'blue_box'").withColumn("new", F.coalesce((F.col("position") - F.lag("position").over(w) - 1 > gap).cast("int"), F.lit(0)))
    runs = boxes.withColumn("run", F.sum("new").over(w))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x.text)
    out = runs.groupBy("doc_id", "run").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count("*").alias("paragraphs"), F.array_join(ordered, "\n").alias("text"))
    return out.drop("run").withColumn("box_type", box_type(F.col("text")))


def style(text: Column) -> list[Column]:
    """dialogue_ratio (three places), pov (first person, else the commonest thinker, ties to the first) and scene_count."""
    t = F.coalesce(text, F.lit(""))
    quoted = F.aggregate(F.regexp_extract_all(t, F.lit('"[^"]{2,}"'), F.lit(0)), F.lit(0), lambda n, q: n + F.length(q))
    ratio = F.when(F.length(t) > 0, F.bround(quoted / F.length(t), 3)).otherwise(0.0)
    who = F.regexp_extract_all(t, F.lit(THINKER), F.lit(1))
    counted = F.transform(F.array_distinct(who), lambda n: F.struct((-F.size(F.filter(who, lambda x: x == n))).alias("n"), F.array_position(who, n).alias("at"), n.alias("name")))
    pov = F.when(t.rlike(FIRST_PERSON), "(first-person)").otherwise(F.get(F.array_sort(counted), F.lit(0)).getField("name"))
    return [ratio.alias("dialogue_ratio"), pov.alias("pov"), (F.regexp_count(t, F.lit(SCENE_GAP)) + 1).alias("scene_count")]


def style_rows(styled: DataFrame, key: str) -> DataFrame:
    """Up to three rows a chapter: (key, feature, value) of pov, dialogue_density and pacing."""
    rows = F.array(F.struct(F.lit("pov").alias("feature"), F.col("pov").alias("value")), F.struct(F.lit("dialogue_density").alias("feature"), F.col("dialogue_ratio").cast("string").alias("value")), F.struct(F.lit("pacing").alias("feature"), F.col("scene_count").cast("string").alias("value")))
    return styled.select(key, F.explode(rows).alias("x")).select(key, "x.feature", "x.value").where("value IS NOT NULL")


def full_text(rows: DataFrame, keys: list[str], order: str = "position", joint: str = "\n") -> DataFrame:
    """The parts of each key in order as one text; blank results go."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x.text)
    return rows.groupBy(*keys).agg(F.array_join(ordered, joint).alias("text")).where(F.trim("text") != "")
