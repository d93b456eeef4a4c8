"""Facts from marked-up text: pattern tables, mentions, grounding, and the checks that found entities and relations must pass."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.chapters import read_each

# --- fixed values -----------------------------------------------------------------------------------------------------

FOLDED, LINES = re.I, re.I | re.M


@dataclass(frozen=True)
class Pattern:
    """name, entity type, expression, the group of each captured field; a field that ends in _paren stands in for its base."""

    name: str
    entity_type: str
    regex: str
    fields: tuple[tuple[str, int], ...]
    flags: int = FOLDED


#: The default patterns.
PATTERNS = [
    Pattern("skill_acquired", "Skill", r"\[(?:Skill|Ability)\s+(?:Acquired|Learned|Gained):\s*(.+?)(?:\s*-\s*(.+?)|\s+\(([^)]+)\))?\]", (("name", 1), ("rank", 2), ("rank_paren", 3))),
    Pattern("level_up", "Level", r"Level:\s*(\d+)\s*(?:→|->|=>)\s*(\d+)", (("old_value", 1), ("new_value", 2))),
    Pattern("class_obtained", "Class", r"Class:\s*(.+?)\s*\((.+?)\)", (("name", 1), ("tier_info", 2))),
    Pattern("title_earned", "Title", r"(?:\[)?Title\s+(?:earned|obtained|acquired):\s*(.+?)(?:\s+\(([^)]+)\))?(?:\]|\n|$)", (("name", 1), ("rank", 2))),
    Pattern("stat_increase", "StatIncrease", r"\+(\d+)\s+(Strength|Agility|Endurance|Vitality|Toughness|Wisdom|Intelligence|Perception|Willpower|Charisma)", (("value", 1), ("stat_name", 2))),
    Pattern("evolution", "Evolution", r"(?:Evolution|Upgrade|Breakthrough).*?(?:→|->|=>)\s*(.+?)(?:\n|$)", (("target", 1),)),
    Pattern("bloodline_notification", "Bloodline", r"\[Bloodline\s+(?:Awakened|Evolved|Activated):\s*(.+?)\]", (("name", 1),)),
    Pattern("profession_obtained", "Profession", r"Profession\s+(?:Obtained|Acquired|Gained):\s*(.+?)\s*(?:\((.+?)\))?$", (("name", 1), ("tier_info", 2)), LINES),
    Pattern("blessing_received", "Church", r"\[Blessing\s+(?:of|from)\s+(.+?)(?:\s+received|\])", (("name", 1),)),
]
#: Any bracket, taken where no pattern before has.
GENERIC = Pattern("blue_box_generic", "SystemNotification", r"\[((?:[^\[\]]|\[[^\[\]]*\]){5,200})\]", (("content", 1),), 0)
#: Shapes of marked-up text in any book.
SHAPES = [
    Pattern("bracketed", "", r"\[([^\[\]]{5,500})\]", (), 0),
    Pattern("stat_gain", "", r"^[+\-]\d+\s+.{2,50}$", (), re.M),
    Pattern("progression", "", r"\d+\s*(?:->|→|=>)\s*\d+", (), 0),
    Pattern("labeled_value", "", r"^(?:Level|Class|Title|Rank|Status|Skill|Race|Species|HP|MP|Mana|Stamina|Strength|Agility|Perception|Vitality|Willpower|Wisdom|Toughness|Endurance|Intelligence|Luck|Charisma|Dexterity):\s*.+$", (), re.M),
]
#: Names that are no names.
PRONOUNS = (
    "il elle ils elles je tu nous vous on lui leur eux me te se soi celui celle ceux celles celui-ci celle-ci ceux-ci celles-ci celui-la celle-la ceux-la celles-la celui-là celle-là ceux-là celles-là ce ceci cela ca ça "
    "qui que quoi dont où y en he she it they him her them his hers its theirs this that these those who whom which what i we you us myself himself herself itself themselves"
).split()
GARBAGE = ["null", "none", "unknown", "n/a", "na", "undefined", "unnamed", "???", "...", "—", "-", "?"]
MOST_NAME = 80
#: What an unnamed thing of a type is called.
NOUNS = {
    "character_fr": "homme femme guerrier guerrière soldat mage sorcier sorcière créature monstre ennemi ennemie assaillant assaillante étranger étrangère inconnu inconnue individu personne enfant vieillard vieil\\s+homme vieille\\s+femme garçon fille type gars mec nana chose bête bete animal silhouette ombre figure voix archer manieur lanceur combattant combattante blaireau sanglier marcassin cochon loup ours serpent vipère premier première deuxième troisième quatrième dernier dernière autre compagnon compagne ami amie allié alliée adversaire rival rivale",
    "character_en": "man woman warrior soldier mage sorcerer sorceress creature monster enemy attacker stranger unknown individual person child old\\s+man old\\s+woman boy girl guy figure shadow voice thing archer axe\\s+wielder fighter beast badger boar wolf bear snake viper first second third fourth last other companion friend ally adversary rival",
    "item_fr": "épée epée arme potion armure bouclier arc flèche fleche bâton baton anneau pendentif robe bottes gants casque sac clé cle livre parchemin pierre cristal fiole baguette dague lance hache masse marteau cape tunique ceinture épaulières jambières plastron bracelet collier carquois munitions flèches",
    "item_en": "sword weapon potion armor shield bow arrow staff ring pendant robe boots gloves helmet bag key book scroll stone crystal vial wand dagger spear axe mace hammer cape tunic belt quiver ammunition",
    "location_fr": "forêt foret pièce piece salle grotte route chemin ville village montagne rivière riviere lac mer océan ocean plaine champ colline vallée vallee désert desert maison bâtiment batiment auberge taverne marché marche arbre buisson rocher pierre clairière clairiere sous-bois bosquet sentier pont mur porte ascenseur escalier couloir bureau pilier dôme dome",
    "location_en": "forest room cave road path city town village mountain river lake sea ocean plain field hill valley desert house building inn tavern market tree bush clearing",
    "faction": "soldats gardes ennemis alliés allies foule groupe soldiers guards enemies allies crowd group",
}
_ART_FR, _ART_EN = "(?:le|la|l['’]\\s?|les|un|une|des|du)", "(?:the|a|an)"


def _after(article: str, nouns: str) -> str:
    return f"^{article}\\s+(?:{'|'.join(NOUNS[nouns].split())})\\b"


#: Rejected names by type.
UNNAMED = {
    "character": [
        _after("(?:le|la|l['’]\\s?|les|un|une|des|du|ce|cet|cette|ces|son|sa|ses|leur|leurs)", "character_fr"), r"^(?:le|la)\s+\d+(?:er|ère|e|ème|ième)\b", r"^(?:ce|cet|cette|ces)\s+\w+", _after("(?:the|a|an|some|this|that)", "character_en"),
        r"^.+['’]s\s+(?:friend|best\s+friend|girlfriend|boyfriend|wife|husband|ex-girlfriend|ex-boyfriend|ex-wife|ex-husband|ex-best\s+friend|father|mother|brother|sister|son|daughter|uncle|aunt|cousin|partner|ally|companion|mentor|teacher|student|rival)\b",
        r"^(?:unnamed|unknown|mysterious|anonymous|unidentified)?\s*(?:protagonist|antagonist|hero|heroine|villain|narrator|silhouette|figure|shadow|voice)\b", r"^(?:parents|family|groupe|group)$",
    ],
    "item": [_after("(?:le|la|l['’]\\s?|les|un|une|des|du|son|sa|ses)", "item_fr"), _after("(?:the|a|an|some|his|her|their)", "item_en")],
    "location": [
        _after(_ART_FR, "location_fr"), r"^(?:ce|cet|cette|ces)\s+(?:forêt|foret|bois|endroit|lieu|place|monde|village|ville|montagne|salle|pièce|cave|grotte)\b", r"^(?:des|les)\s+(?:arbres|bois|rochers|pierres|buissons|champs|collines)\b",
        r"^(?:sous-bois|open\s+space|rez-de-chaussée|rez-de-chausse)$", r"^(?:un|une)\s+(?:petit|petite|grand|grande|énorme|immense|vaste|sombre|vieux|vieille|ancien|ancienne)\s+",
        r"^(?:au\s+nord|au\s+sud|à\s+l['’]\s?est|à\s+l['’]\s?ouest|north|south|east|west|nearby|outside|inside|dehors|dedans|ici|là|là-bas|là-haut|ici-bas|ailleurs)\b", _after(_ART_EN, "location_en"), r"^(?:current\s+location|unknown\s+|here-below|here|there)\b",
    ],
    "skill": [
        r"^(?:compétence|competence|compétences|competences)\s+(?:de|d['’]\s?|pour|en)\s+", r"^(?:maniement|maîtrise|maitrise|utilisation)\s+(?:de|d['’]\s?|des)\s+",
        r"^(?:les?\s+)?(?:armes?\s+(?:de\s+lancer|à\s+(?:deux|une)\s+mains?)|(?:l['’]\s?)?épée\s+et\s+(?:le\s+)?bouclier|double\s+maniement\s+des?\s+armes?)\b", r"^(?:skill\s+(?:with|in|for|at)\s+|proficiency\s+(?:with|in)\s+|ability\s+to\s+)\b",
    ],
    "faction": [_after("(?:le|la|les|un|une|des|the|a|an)", "faction")],
    "event": [r"^(?:il|elle|he|she|they|on|ils|elles)\s+(?:marche|mange|dort|parle|walked|ate|slept|talked|sat|stood)\b"],
}
CONCEPTS = (
    "magie puissance pouvoir force combat bataille guerre mort vie amour haine peur colère temps espace lumière lumiere obscurité obscurite bien mal nature énergie energie vitesse agilité agilite endurance intelligence sagesse charisme "
    "chance destin mana survie évolution evolution progression croissance récompense recompense punition danger sécurité securite magic power strength battle war death life love hate fear anger time space light darkness good evil energy "
    "speed agility wisdom charisma luck fate health stamina perception willpower toughness dexterity constitution vitality survival growth reward punishment safety"
).split()
#: Shorter lower-case words than this are no names of a type; 99: no lower-case word is.
LOWER_CASE = {"character": 4, "creature": 4, "skill": 5, "item": 99, "location": 99, "concept": 99}
#: Roles that name no one, and words that give a wrong type away.
ROLES = (
    "guard guards soldier soldiers merchant merchants villager villagers innkeeper bartender shopkeeper servant servants bandit bandits thief thieves farmer farmers priest priestess healer hunter hunters traveler travelers stranger strangers "
    "warrior warriors mage mages knight knights scout scouts assassin assassins elder elders child children boy girl man woman narrator voice crowd mob army"
).split() + ["old man", "old woman"]
DEEDS = "kills attacks chops pats hits defeats stabs slashes".split()
PLACES = "city dungeon forest mountain building region cave tower village house room hall".split()
TRAITS = "brave strong smart kind cruel tall short fast slow wise cunning loyal stubborn".split()
PARTS = "protagonist antagonist mentor trickster herald guardian shadow shapeshifter narrator".split()
#: Relation types that are always kept, as of a graph of stories.
RELATIONS = (
    "RELATES_TO PARTICIPATES_IN OCCURS_AT CAUSES ENABLES PRECEDES FOLLOWS POSSESSES LOCATED_AT MEMBER_OF LOCATION_PART_OF CONNECTED_TO PERCEIVED_BY MENTIONED_IN GROUNDED_IN FULFILLS RETCONNED_BY HAS_SKILL HAS_CLASS HAS_TITLE AT_LEVEL "
    "IS_RACE EVOLVES_INTO SKILL_EVOLVES_INTO BELONGS_TO INHABITS HAS_BLOODLINE HAS_PROFESSION WORSHIPS HAS_RECIPE HAS_STATE STATE_TRIGGERED_BY TRIGGERS_EVENT FOLLOWS_STATE IN_SETTING SETTING_CONTAINS HAS_FEATURE HAS_TEXTUAL_FEATURE "
    "PLAYS_ROLE ROLE_IN_SEQUENCE INVOLVED_IN RELATIONSHIP_CAUSED_BY SEQUENCED_IN STRUCTURED_BY UNIT_REFERS_TO UNIT_IN_WORK INSTANCE_OF_STOFF CHARACTER_IN_WORK SETTING_OF_WORK USED_IN"
).split()
#: Words that call for a pass over a chapter, and how many.
SIGNALS = {
    "systems": (2, r"skill|level|class|title|stat|ability|evolution|upgrade|breakthrough|acquired|learned|gained|earned|obtained|evolves?|rank(?:ed)?|tier|profession|bloodline|blessing|notification|system\s+message|compétence|classe|titre|niveau|amélioration|évolution|acquis|appris|obtenu|déverrouillé|débloqué|grade|rang|bénédiction|aptitude|maîtrise|profession|lignée|notification|message\s+système|montée\s+de\s+niveau|gain\s+de\s+niveau|\+\d+\s+\w+|Level:\s*\d+|Niveau\s*:\s*\d+|\[(?:Skill|Ability|Class|Title|Compétence|Classe|Titre)"),
    "events": (2, r"battle|fight|killed|defeated|died|death|attacked|ambush|discovered|revealed|betrayed|alliance|war|peace|quest|mission|escaped|captured|saved|rescued|ceremony|ritual|awakened|transformed|arrived|departed|journeyed|traveled|fled|swore|promised|decided|agreed|refused|combat|batail|tué|vaincu|mort|attaqué|embuscade|découvert|révélé|trahi|alliance|guerre|paix|quête|mission|échappé|capturé|sauvé|secouru|cérémonie|rituel|éveillé|transformé|arrivé|parti|voyagé|fui|enfui|juré|promis|décidé|accepté|refusé|affronté|blessé|survécu|détruit|rencontré"),
    "lore": (3, r"dungeon|realm|dimension|continent|kingdom|city|temple|forest|tower|artifact|weapon|potion|elixir|enchant|rune|creature|monster|beast|dragon|demon|spirit|guild|order|faction|clan|church|empire|council|mana|energy|dao|cultivation|magic|law|rule|race|species|elf|dwarf|goblin|orc|undead|ancient|prophecy|legend|myth|lore|donjon|royaume|dimension|continent|ville|temple|forêt|tour|artefact|arme|potion|élixir|enchant|rune|créature|monstre|bête|dragon|démon|esprit|guilde|ordre|faction|clan|église|empire|conseil|mana|énergie|magie|loi|règle|race|espèce|elfe|nain|gobelin|orc|mort-vivant|ancien|prophétie|légende|mythe|savoir|tutoriel|univers|système|initiation"),
}
PROGRESSION, SHORT_CHAPTER = ["litrpg", "progression_fantasy", "cultivation"], 2000
HINTS = {"characters": "Développements de personnages", "systems": "Éléments de système (skills, classes, levels)", "events": "Développements narratifs et événements", "lore": "Éléments de lore (lieux, items, créatures)"}


# --- patterns ---------------------------------------------------------------------------------------------------------


def touches(taken: bytearray, start: int, end: int) -> bool:
    """Whether a span begins or ends inside one of those taken before; one that holds another whole does not."""
    return any(taken[start : start + 1]) or (end > 0 and taken[end - 1] > 0)


def take(taken: bytearray, start: int, end: int) -> None:
    taken[start:end] = b"\1" * (end - start)


def fields_of(pattern: Pattern, m: re.Match) -> dict[str, str]:
    found = {f: v.strip() for f, g in pattern.fields if g <= (m.re.groups or 0) and (v := m[g])}
    stands_in = {f.removesuffix("_paren"): v for f, v in found.items() if f.endswith("_paren")}
    return {**stands_in, **{f: v for f, v in found.items() if not f.endswith("_paren")}}


def facts(text: str, patterns: list[Pattern] = PATTERNS) -> list[tuple[str, str, dict[str, str], str, int, int]]:
    """(pattern, entity type, fields, raw text, start, end): every match of the patterns, then brackets that touch none."""
    out, taken = [], bytearray(len(text))
    for p in [*patterns, GENERIC]:
        for m in re.finditer(p.regex, text, p.flags):
            if p is GENERIC and touches(taken, *m.span()):
                continue
            take(taken, *m.span())
            out.append((p.name, p.entity_type, fields_of(p, m), m[0], m.start(), m.end()))
    return out


def shapes(text: str) -> list[tuple[str, str, int, int]]:
    """(shape, text, start, end) in order of start; a match that touches an earlier shape's goes."""
    out, taken = [], bytearray(len(text))
    for p in SHAPES:
        for m in re.finditer(p.regex, text, p.flags):
            if not touches(taken, *m.span()):
                take(taken, *m.span())
                out.append((p.name, m[0].strip(), m.start(), m.end()))
    return sorted(out, key=lambda x: x[2])


def valid_patterns(specs: list[dict], least: float = 0.8) -> list[Pattern]:
    """Proposed patterns (name, entity_type, regex, examples) that compile and match enough of their own examples, one at least."""
    out = []
    for s in specs:
        try:
            made = re.compile(s["regex"], LINES)
        except re.error:
            continue
        seen = [bool(made.search(e)) for e in s.get("examples") or []]
        if seen and sum(seen) >= least * len(seen):
            out.append(Pattern(s["name"], s["entity_type"], s["regex"], tuple(made.groupindex.items()), LINES))
    return out


def loaded_patterns(table: dict[str, dict]) -> list[Pattern]:
    """Patterns of an ontology's table (name -> pattern, entity_type, captures); expressions that do not compile are left out."""
    out = []
    for name, s in table.items():
        try:
            re.compile(s["pattern"], LINES)
        except re.error:
            continue
        out.append(Pattern(name, s["entity_type"], s["pattern"], tuple((s.get("captures") or {}).items()), LINES))
    return out


def extracted(chapters: DataFrame, keys: list[str], patterns: list[Pattern] | None = None) -> DataFrame:
    """keys, pattern, entity_type, fields, raw_text, start, end of each match in each text."""
    table = PATTERNS if patterns is None else patterns
    return read_each(chapters, "text", lambda t: facts(t, table), "pattern string, entity_type string, fields map<string,string>, raw_text string, start int, end int", keys)


def twins(found: DataFrame, known: DataFrame, similar: float = 0.85) -> DataFrame:
    """found (type, vector) with parent: the nearest known type (type, vector) of at least that cosine; few types on either side.

    The known types are a dimension table of an ontology; as many as KNOWN_TYPES are broadcast, more are an error.
    """
    from skein.functions import cosine

    if known.limit(KNOWN_TYPES + 1).count() > KNOWN_TYPES:
        raise ValueError(f"more than {KNOWN_TYPES} known types")
    met = found.join(F.broadcast(known.select(F.col("type").alias("parent"), F.col("vector").alias("near"))), F.lit(True), "left").withColumn("score", cosine(F.col("vector"), F.col("near")))
    best = met.groupBy("type").agg(F.max_by("parent", F.when((F.col("score") >= similar) & (F.col("parent") != F.col("type")), F.col("score"))).alias("parent"))
    return best


KNOWN_TYPES = 10_000


# --- routing ----------------------------------------------------------------------------------------------------------


def routed(chapters: DataFrame, genre: str = "litrpg") -> DataFrame:
    """chapters (with text, has_facts boolean): passes and hints, comma- and semicolon-joined in their order.

    Short chapters take all. Systems are called for by enough words, by one in a genre of progression, or by facts found before;
    events by one word at least (after lore, if below its number); lore by three.
    """
    t = F.coalesce("text", F.lit(""))
    n = {name: F.regexp_count(t, F.lit(r"(?iU)\b(?:" + words + r")\b")) for name, (_, words) in SIGNALS.items()}
    counted = chapters.select("*", *(c.alias(f"_{name}") for name, c in n.items()))
    one = F.lit(genre.lower() in PROGRESSION) & (F.col("_systems") >= 1)
    systems, events, lore = (F.col(f"_{k}") >= least for k, (least, _) in SIGNALS.items())
    passes = [F.lit("characters"), F.when(systems | one | F.col("has_facts"), "systems"), F.when(events, "events"), F.when(lore, "lore"), F.when(~events & (F.col("_events") >= 1), "events")]
    hints = [F.lit(HINTS["characters"]), F.when(systems | one, HINTS["systems"]), F.when(F.col("_events") >= 1, HINTS["events"]), F.when(lore, HINTS["lore"])]
    short = F.length(t) < SHORT_CHAPTER
    out = counted.withColumn("passes", F.when(short, "characters,systems,events,lore").otherwise(F.concat_ws(",", *passes))).withColumn("hints", F.when(short, ";".join(HINTS.values())).otherwise(F.concat_ws(";", *hints)))
    return out.drop(*(f"_{k}" for k in SIGNALS))


# --- mentions and grounding -------------------------------------------------------------------------------------------


def search_terms(entities: list[tuple[str, str, str, list[str]]]) -> list[tuple[str, str, str, str]]:
    """(term, canonical, type, way) of entities (canonical, name, type, aliases), longest first; terms of one character are none."""
    out = []
    for canonical, name, kind, aliases in entities:
        if canonical:
            own = [(name, "direct_name"), *([(canonical, "direct_name")] if canonical != name else []), *((a.strip(), "alias") for a in aliases)]
            out += [(t, canonical, kind, way) for t, way in own if len(t or "") >= 2]
    return sorted(out, key=lambda x: -len(x[0]))


def mentions(text: str, terms: list[tuple[str, str, str, str]]) -> list[tuple[str, str, str, str, int, int]]:
    """(entity, type, text, way, start, end): whole words in any case, longer terms first, spans never overlap."""
    taken = bytearray(len(text))
    folded, out = text.lower(), []
    for term, canonical, kind, way in terms:
        if term.lower() not in folded and len(folded) == len(text):
            continue
        for m in re.finditer(r"\b" + re.escape(term) + r"\b", text, re.I):
            a, b = m.span()
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((canonical, kind, m[0], way, a, b))
    return out


def mentioned(chapters: DataFrame, keys: list[str], entities: DataFrame, most: int = 200_000) -> DataFrame:
    """Mentions of the entities (canonical, name, entity_type, aliases) of one book in its chapters; the dictionary is sent to
    all workers, so more than `most` entities are an error."""
    rows = entities.select("canonical", "name", "entity_type", "aliases").orderBy("canonical", "name", "entity_type").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entities")
    terms = search_terms([(r[0], r[1], r[2], r[3] or []) for r in rows])
    return read_each(chapters, "text", lambda t: mentions(t, terms), "entity string, entity_type string, mention string, way string, start int, end int", keys)


def part_ratio(a: str, b: str) -> int:
    """0 to 100: how well the shorter text fits some part of the longer one, by matching blocks."""
    from difflib import SequenceMatcher

    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 100 if not b else 0
    best = 0.0
    for block in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        low = max(0, block.b - block.a)
        best = max(best, SequenceMatcher(None, a, b[low : low + len(a)], autojunk=False).ratio())
        if best > 0.995:
            return 100
    return round(100 * best)


class Grounder:
    """Finds quoted passages in one text; what a passage has in the text is looked for once, however often it is quoted."""

    def __init__(self, text: str):
        self.text, self.letters = text, set(text)
        self.found: dict[str, tuple[int, bool]] = {}

    def like(self, q: str) -> bool:
        """Whether part_ratio is over 80; its bound by the letters that the longer text holds spares the search where it is not."""
        if q and len(q) <= len(self.text):
            known = sum(c in self.letters for c in q)
            if round(100 * 2 * known / (len(q) + known)) <= 80:
                return False
        return part_ratio(q, self.text) > 80

    def ground(self, quote: str, start: int, end: int) -> tuple[str, float, int, int]:
        """(alignment, confidence, start, end) of a quoted passage: exact where it is said to be, else fuzzy, else unaligned."""
        q = quote.strip()
        if 0 <= start < end and self.text[start:end].strip() == q:
            return "exact", 1.0, start, end
        if q not in self.found:
            at = self.text.find(q)
            self.found[q] = at, at < 0 and self.like(q)
        at, like = self.found[q]
        if at >= 0:
            return "fuzzy", 0.7, at, at + len(q)
        return ("fuzzy", 0.5, start, end) if like else ("unaligned", 0.3, start, end)


def ground(quote: str, start: int, end: int, text: str) -> tuple[str, float, int, int]:
    return Grounder(text).ground(quote, start, end)


def grounded(quotes: DataFrame, chapters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position, alignment, confidence, start, end of quotes (keys, position, quote, start, stop) in chapters (keys, text);
    a chapter's text goes once to all its quotes."""
    asked = quotes.groupBy(*keys).agg(F.collect_list(F.struct("position", "quote", "start", "stop")).alias("_quotes"))
    packed = chapters.join(asked, keys).select(*keys, F.to_json(F.struct(F.col("_quotes").alias("quotes"), F.col("text").alias("whole"))).alias("text"))

    def read(x):
        import json

        got = json.loads(x)
        g = Grounder(got["whole"])
        return [(q["position"], *g.ground(q["quote"], q["start"], q["stop"])) for q in got["quotes"]]

    return read_each(packed, "text", read, "position long, alignment string, confidence double, start int, end int", keys)


def derived_grounding(mentions_: DataFrame, chunks: DataFrame) -> DataFrame:
    """Mentions (book, chapter, entity, start, end) in the chunks (book, chapter, position, chunk_start, chunk_end) that hold them
    whole; one in an overlap is in both."""
    return mentions_.join(chunks, ["book", "chapter"]).where("start >= chunk_start AND end <= chunk_end").select("book", "chapter", "entity", "position", "start", "end")


# --- checks -----------------------------------------------------------------------------------------------------------


def rejected(name: Column, kind: Column) -> Column:
    """Why a name of a type is noise, or null."""
    n = F.trim(name)
    low = F.lower(n)
    plain = n.rlike(r"^\p{L}+$") & (n == low)
    reason = F.when(low.isin(PRONOUNS), "pronoun").when(low.isin(GARBAGE), "garbage").when(F.length(n) <= 1, "short").when(F.length(n) > MOST_NAME, "long").when(n.contains("(") & n.contains(")"), "parenthetical")
    for k, expressions in UNNAMED.items():
        reason = reason.when((kind == k) & n.rlike("(?iU)" + "|".join(f"(?:{x})" for x in expressions)), "unnamed")
    reason = reason.when((kind == "concept") & low.isin(CONCEPTS), "general")
    for k, least in LOWER_CASE.items():
        reason = reason.when((kind == k) & plain & (F.length(n) < least), "lower_case")
    return reason


def without_noise(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities (name, entity_type) that pass, and relations (source, target, ...) whose ends are both characters that do."""
    kept = entities.where(rejected(F.col("name"), F.col("entity_type")).isNull())
    names = kept.where("entity_type = 'character'").select(F.lower("name").alias("_n")).distinct()
    for end in ("source", "target"):
        relations = relations.join(names, F.lower(F.trim(end)) == F.col("_n"), "left_semi")
    return kept, relations


def verified(entities: DataFrame, chapters: DataFrame, known: DataFrame) -> DataFrame:
    """entities with `reason`: null for those that their chapter bears out.

    entities: chapter, entity_type, name, character, role_type, participants array; chapters: chapter, text; known: name of each
    character of this chapter's extraction, or of the registry with its aliases, in lower case.
    """
    low, kind = F.lower("name"), F.col("entity_type")
    names = known.select(F.lower(F.trim("name")).alias("_known")).where("_known <> ''").distinct()
    text = chapters.select(F.col("chapter"), F.lower("text").alias("_text"))
    name, person = F.coalesce(low, F.lit("")), F.lower(F.trim(F.coalesce("character", F.lit(""))))
    # a chapter's text meets the distinct names that are asked of it once, and goes no further
    asked = entities.select("chapter", F.struct(name.alias("name"), person.alias("who")).alias("_x")).distinct().groupBy("chapter").agg(F.collect_list("_x").alias("_all"))
    body = F.coalesce("_text", F.lit(""))
    parts = lambda n: F.split(F.trim(n), r"\s+")
    seen = lambda n: F.size(F.filter(parts(n), lambda w: (F.length(w) > 2) & body.contains(w)))
    gone = lambda n: ~body.contains(n) & F.when(F.size(parts(n)) > 1, seen(n) < F.least(F.lit(2), F.size(parts(n)))).otherwise(True)
    told = F.transform("_all", lambda x: F.struct(x["name"].alias("_name"), x["who"].alias("_who"), gone(x["name"]).alias("_absent"), body.contains(x["who"]).alias("_there")))
    facts_ = asked.join(text, "chapter", "left").select(F.col("chapter").alias("_chapter"), F.explode(told).alias("_x")).select("_chapter", "_x.*")
    met = F.col("chapter").eqNullSafe(F.col("_chapter")) & (name == F.col("_name")) & (person == F.col("_who"))
    e = entities.withColumn("_row", F.monotonically_increasing_id()).join(facts_, met, "left").drop("_chapter", "_name", "_who")
    e = e.join(names.withColumn("_is", F.lit(True)), low == F.col("_known"), "left").drop("_known")
    e = e.join(names.withColumn("_has", F.lit(True)), F.lower(F.trim("character")) == F.col("_known"), "left").drop("_known")
    # an event that begins with a known name and a space: each of its beginnings is looked up
    words = F.split(low, " ")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    led = e.where((kind == "event") & (F.size(words) > 1)).select("_row", F.explode(heads).alias("_head")).join(names, F.col("_head") == F.col("_known"), "left_semi").select("_row").distinct().withColumn("_led", F.lit(True))
    e = e.join(led, "_row", "left")
    is_known, who = F.coalesce("_is", F.lit(False)), F.lower(F.trim(F.coalesce("character", F.lit(""))))
    of_someone = kind.isin("psychological_state", "character_feature", "narrative_role")
    deed = F.exists(F.array(*map(F.lit, DEEDS)), lambda v: low.contains(v))
    reason = (
        F.when(F.coalesce("name", F.lit("")) == "", "empty_name").when(F.col("_absent"), "name_not_in_text").when((kind == "character") & low.isin(ROLES), "generic_role_as_character")
        .when((kind == "event") & is_known, "event_named_after_character").when((kind == "event") & F.coalesce("_led", F.lit(False)), "event_starts_with_character")
        .when(is_known & (kind != "character"), "known_character_wrong_type").when(of_someone & (who == ""), "golem_missing_character_ref")
        .when(of_someone & ~F.coalesce("_has", F.lit(False)) & ~F.col("_there"), "golem_character_not_found")
        .when((kind == "social_relationship") & (F.coalesce(F.size("participants"), F.lit(0)) < 2), "golem_insufficient_participants")
        .when((kind == "social_relationship") & deed, "golem_sr_looks_like_event")
        .when((kind == "setting") & (low.isin(PLACES) | low.contains("floor ") | low.contains("room ") | low.contains("cave ")), "golem_setting_is_location")
        .when((kind == "narrative_role") & F.lower(F.coalesce("role_type", F.lit(""))).isin(TRAITS), "golem_role_is_trait")
        .when((kind == "character_feature") & low.isin(PARTS), "golem_feature_is_role")
    )
    return e.withColumn("reason", reason).drop("_row", "_absent", "_there", "_is", "_has", "_led")


def typed_relations(relations: DataFrame, entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Relations (source, target, rel, ...) that no rule forbids: a type without a rule passes, and so does an unknown end.

    entities: name, entity_type (one a name); rules: rel, from_types, to_types arrays, a dimension table.
    """
    kinds = entities.select(F.lower(F.trim("name")).alias("_n"), F.lower("entity_type").alias("_t")).groupBy("_n").agg(F.min("_t").alias("_t"))
    r = relations.join(rules, "rel", "left")
    for end, allowed in (("source", "from_types"), ("target", "to_types")):
        r = r.join(kinds, F.lower(F.trim(end)) == F.col("_n"), "left").where(F.col(allowed).isNull() | F.col("_t").isNull() | F.array_contains(allowed, F.col("_t"))).drop("_n", "_t")
    return r.drop("from_types", "to_types")


def clean_relation_types(relations: DataFrame) -> DataFrame:
    """Relations of known types, and of others that are short enough; types upper-case with underscores."""
    t = F.replace(F.upper("rel"), F.lit(" "), F.lit("_"))
    marks = F.length(t) - F.length(F.replace(t, F.lit("_"), F.lit("")))
    return relations.withColumn("type", t).where(F.col("type").isin(RELATIONS) | ((F.length("type") <= 30) & (marks <= 4)))


def coerced(raw: Column, allowed: list[str], default: Column) -> Column:
    """The allowed value that equals the raw one after lower-casing with underscores for blanks and hyphens, else the default."""
    key = F.regexp_replace(F.lower(F.trim(raw)), r"[\s-]+", "_")
    known = F.create_map(*(F.lit(x) for a in allowed for x in (a.lower(), a)))
    return F.coalesce(known[key], default)


def valid_fields(entities: DataFrame, required: list[str], enums: dict[str, list[str]]) -> DataFrame:
    """Rows with all required fields; a field with a value outside its enumeration is emptied."""
    for c in required:
        entities = entities.where(F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    for c, values in enums.items():
        entities = entities.withColumn(c, F.when(F.col(c).isin(values), F.col(c)))
    return entities


def disjoint(types: DataFrame, pairs: DataFrame) -> DataFrame:
    """types (a, b) with `disjoint`: whether the unordered pair is one of pairs (a, b)."""
    k = lambda: F.struct(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    known = pairs.select(k().alias("_k")).distinct().withColumn("disjoint", F.lit(True))
    return types.withColumn("_k", k()).join(known, "_k", "left").withColumn("disjoint", F.coalesce("disjoint", F.lit(False))).drop("_k")


# --- answers ----------------------------------------------------------------------------------------------------------


def citations(text: Column) -> Column:
    """array<struct<chapter, position>> of marks [Ch.N] and [Ch.N, p.M]."""
    marks = F.regexp_extract_all(text, F.lit(r"\[Ch\.\s*\d+(?:,\s*p\.\s*\d+)?\]"), F.lit(0))
    return F.transform(marks, lambda m: F.struct(F.regexp_extract(m, r"Ch\.\s*(\d+)", 1).cast("int").alias("chapter"), F.regexp_extract(m, r"p\.\s*(\d+)", 1).try_cast("int").alias("position")))


def claims(text: Column) -> Column:
    """Sentences of four words or more."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 4)


def entailment(contradiction: Column, entailed: Column, neutral: Column) -> list[Column]:
    """score (entailment and half of neutral, after softmax) and contradicts (probability over one half)."""
    top = F.greatest(contradiction, entailed, neutral)
    c, e, n = (F.exp(x - top) for x in (contradiction, entailed, neutral))
    return [((e + n * 0.5) / (c + e + n)).alias("score"), (c / (c + e + n) > 0.5).alias("contradicts")]


def tier(info: Column) -> Column:
    """0 to 6 for grades F, E, D, C, B, A, S at the beginning, else the number at the end, else null."""
    t = F.upper(F.trim(F.coalesce(info, F.lit(""))))
    graded = F.element_at(F.split(info, r"\s+"), -1).try_cast("int")
    for value, letter in enumerate("FEDCBAS"):
        graded = F.when(t.startswith(letter), value).otherwise(graded)
    return graded


def impact(chapters: DataFrame, patterns: list[str], full: bool = False) -> DataFrame:
    """Chapters that any of the new patterns touches; all without a pattern, or if asked for."""
    if full or not patterns:
        return chapters
    return chapters.where(F.coalesce(F.col("text").rlike("(?im)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False)))


def fulltext_query(words: Column) -> Column:
    """Terms with the search engine's signs escaped, those of several words in quotes, joined by OR."""
    escaped = F.transform(words, lambda w: F.regexp_replace(w, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1"))
    return F.array_join(F.transform(escaped, lambda w: F.when(w.contains(" "), F.concat(F.lit('"'), w, F.lit('"'))).otherwise(w)), " OR ")


def parsed_json(raw: Column, schema: str) -> Column:
    """A model's JSON answer with or without a code fence; null where nothing parses."""
    bare = F.regexp_replace(F.trim(raw), r"^```[a-z]*\s*|\s*```$", "")
    return F.from_json(F.when(bare.rlike(r"^\s*[\[{]"), bare).otherwise(F.regexp_extract(raw, r"(?s)(\{.*\}|\[.*\])", 1)), schema)


#: The phase that a change of the ontology calls for, by its kind (and layer), and whether its target's type is touched.
PHASES = {("add_entity_type", "core"): 1, ("add_entity_type", "genre"): 2, ("add_entity_type", "series"): 3, ("add_regex", ""): 0, ("modify_property", ""): 4, ("add_property", ""): 4, ("add_relationship_type", ""): 4, ("add_relationship", ""): 4, ("extend_enum", ""): 4}
TYPED_CHANGES = ["add_entity_type", "modify_property", "add_property", "extend_enum"]


def impact_scope(changes: DataFrame) -> DataFrame:
    """version, phases (sorted), types (sorted), new_patterns of the changes (version, change_type, layer, target) of each version."""
    phase = F.create_map(*(F.lit(x) for (kind, layer), n in PHASES.items() for x in (f"{kind}/{layer}", n)))
    own = F.concat_ws("/", "change_type", F.when(F.col("change_type") == "add_entity_type", F.col("layer")).otherwise(""))
    shown = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return changes.groupBy("version").agg(
        shown(phase[own].cast("string")).alias("phases"), shown(F.when(F.col("change_type").isin(TYPED_CHANGES), F.col("target"))).alias("types"), F.count(F.when(F.col("change_type") == "add_regex", 1)).alias("new_patterns"),
    )
