"""Operator 7: SentencePiece encoding and decoding of a merge-type (BPE) model, exactly as the library does.

A merge-type encoding is the one sequence of pieces in which every two neighbours are compatible, that is, merging the
characters of the two again yields these two. The encoder walks a text with the longest pieces that an Aho-Corasick
automaton finds at each place, keeps a piece if it is compatible with the one before, tries the next shorter one if not,
steps back if none is left, and marks the place as failed in a bitfield so that no place is tried twice. Two pieces are
compatible if, while their merges are undone from the last to the first, no piece across their border is found that would
have been merged earlier.

Of merges with equal scores, as those of runs of the space mark, the leftmost comes first: they share a rank, those of the
left piece are older than those of the right one, and so is a merge across the border than an equal one to its right. This
order of undoing holds for a piece whose own merges never go back in rank; if a model has others, a pair with one of them is
told by merging its characters.

Characters that are no piece become byte pieces. The ids of the whole text are decoded, which joins byte pieces to UTF-8 with
U+FFFD for broken ones. Where no piece has a space mark behind another character, a text is encoded in chunks: a space with the
run of characters behind it that pieces may hold together. Two neighbours that no piece holds are never merged, so a text may be
parted there. The ids of chunks are remembered in a bounded table.

Defined results: null and empty texts have no ids and decode to the empty text; the space mark U+2581 in a text counts as
a space, as in the library, and decodes to one; texts of any length are encoded whole; repeated rows each get their row;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import keyed_text, short_batches, table

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Entries of a worker's table of pairs of pieces, and half of those of its table of chunks; a full table keeps its newer half.
KEEP = 250_000
#: Longer words are not remembered.
LONG_KEY = 200
UNKNOWN = " \u2047 "
BROKEN = re.compile("[\udc80-\udcff]")


class Remembered(dict):
    """A dict that computes what it lacks; when it is full it becomes the older half, from which what is asked again returns."""

    def __init__(self, make, most: int = KEEP):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(key) > LONG_KEY:
            return self.make(key)
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        out = self[key] = self.older[key] if key in self.older else self.make(key)
        return out


class MergePieces:
    """Encoder and decoder over a piece table: names, scores, and the ids of byte, control and unknown pieces."""

    def __init__(self, names: list[str], scores: list[float], byte_ids: list[int], special: set[int], unknown: int, dummy_prefix: bool = True):
        import ahocorasick

        self.names, self.scores, self.byte_ids, self.dummy_prefix = names, scores, byte_ids, dummy_prefix
        self.unknown = unknown
        self.bytes = {i: b for b, i in enumerate(byte_ids)}
        self.ids = {n: i for i, n in enumerate(names) if i not in special and i not in self.bytes}
        self.across_words = any(re.search(f"[^{SPACE}]{SPACE}", n) for n in self.ids)
        self.special = special
        #: What an id, or its decimal string, decodes to; bytes beyond ASCII as escapes, None for what parts the bytes around it.
        texts = {i: None if i in special else n.replace(SPACE, " ") for i, n in enumerate(names)}
        texts |= {i: chr(b) if b < 128 else chr(0xDC00 + b) for i, b in self.bytes.items()}
        self.texts = texts | {str(i): t for i, t in texts.items()}
        self.id_text = {n: str(i) for n, i in self.ids.items()}
        order = sorted((n for n in self.ids if len(n) > 1), key=lambda n: (-scores[self.ids[n]], self.ids[n]))
        place = {score: k for k, score in enumerate(sorted({scores[self.ids[n]] for n in order}, reverse=True))}
        self.rank = {n: -1 for n in self.ids if len(n) == 1} | {n: place[scores[self.ids[n]]] for n in order}
        self.halves, self.uneven = {}, set()
        for n in order:
            if done := self.last_merges(n):
                self.halves[n] = done[-1]
                ranks = [self.rank[a + b] for a, b in done]
                if ranks != sorted(ranks):
                    self.uneven.add(n)
        reachable = {n for n in self.ids if len(n) == 1 or n in self.halves}
        self.cut = re.compile("  +[^ ]*| ?(?:" + "".join(f"[{re.escape(kin)}]+|" for kin in self.kin()) + ".)", re.DOTALL)
        self.automaton = ahocorasick.Automaton()
        for n in sorted(reachable, key=self.ids.__getitem__):  # siblings are searched in this order: frequent ones first
            self.automaton.add_word(n, n)
        self.automaton.make_automaton()
        self.window = max(map(len, reachable), default=1)
        self.shorter = {n: next((n[:k] for k in range(len(n) - 1, 0, -1) if n[:k] in reachable), None) for n in reachable}
        self.longest = {n[:k]: next((n[:j] for j in range(k, 0, -1) if n[:j] in reachable), n[0]) for n in reachable for k in range(1, len(n) + 1)}
        self.compatible = Remembered(lambda pair: self.fits(*pair))
        self.chunks = Remembered(self.chunk, 2 * KEEP)

    def kin(self) -> list[str]:
        """The characters but the space mark that have neighbours in pieces, in sets that no piece crosses; the largest sets first."""
        sets: dict[str, set[str]] = {}
        for n in self.ids:
            if len(run := n.replace(SPACE, "")) > 1 and not set(run) <= sets.get(run[0], set()):
                joined = set(run).union(*(sets.get(c, ()) for c in run))
                sets |= dict.fromkeys(joined, joined)
        return sorted({"".join(sorted(x)) for x in sets.values()}, key=lambda x: (-len(x), x))

    def last_merges(self, name: str) -> list[tuple[str, str]] | None:
        """The merges of a piece in their order; None if merging its characters ends otherwise."""
        done: list[tuple[str, str]] = []
        return done if self.merge(name, done) == [name] else None

    def merge(self, text: str, done: list | None = None) -> list[str]:
        """The definition: join the neighbours whose piece has the best score, leftmost first, until none is a piece."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (k := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            if done is not None:
                done.append((left, right))
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def backtrack(self, text: str) -> list[str]:
        """The sequence of pairwise compatible pieces; characters that are no piece stand alone and fit anything."""
        reach, longest, compatible, shorter, window = self.automaton.longest_prefix, self.longest, self.compatible, self.shorter, self.window
        size, place, failed, last, rest = len(text), 0, None, None, text[:window]
        out: list[str] = []
        piece = longest[rest[:k]] if (k := reach(rest)) else rest[0]
        while True:
            end = place + len(piece)
            if not (failed and failed[end >> 3] >> (end & 7) & 1) and (last is None or compatible[last, piece]):
                out.append(piece)
                if end == size:
                    return out
                place, last, rest = end, piece, text[end : end + window]
                piece = longest[rest[:k]] if (k := reach(rest)) else rest[0]
                continue
            while (piece := shorter.get(piece)) is None:
                failed = failed or bytearray((size >> 3) + 1)
                failed[place >> 3] |= 1 << (place & 7)
                piece = out.pop()
                place -= len(piece)
                last = out[-1] if out else None

    def fits(self, left: str, right: str) -> bool:
        rank, halves, limit = self.rank, self.halves, len(self.rank)
        if left not in rank or right not in rank:
            return True
        if self.uneven and (left in self.uneven or right in self.uneven):
            return self.merge(left + right) == [left, right]
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            a, b = rank[left], rank[right]
            if a > b:
                limit, left = a, halves[left][1]
            elif b >= 0:
                limit, right = b + 1, halves[right][0]
            else:
                return True

    def chunk(self, text: str) -> tuple[str, ...]:
        """Decimal ids of a chunk, with spaces or their marks; a character that is no piece becomes the bytes of its UTF-8."""
        known, names = self.id_text, self.backtrack(text.replace(" ", SPACE))
        try:
            return tuple(map(known.__getitem__, names))
        except KeyError:
            return tuple(i for n in names for i in ([known[n]] if n in known else [str(self.byte_ids[b]) for b in n.encode("utf-8")]))

    def code_chunks(self, text: str) -> list[tuple[str, ...]]:
        """The whole text, chunk by chunk: decimal ids."""
        if not text:
            return []
        text = (" " if self.dummy_prefix else "") + text.replace(SPACE, " ")
        if self.across_words:
            return [self.chunk(text)]
        parts = self.cut.findall(text)
        if "  " not in text:
            return list(map(self.chunks.__getitem__, parts))
        return [self.chunk(x) if x.startswith("  ") else self.chunks[x] for x in parts]

    def code_parts(self, text: str) -> list[tuple[str, str]]:
        """The whole text, chunk by chunk: decimal ids, comma-joined, and the text that these ids decode to."""
        return [(",".join(ids), self.join(ids)) for ids in self.code_chunks(text)]

    def code(self, text: str) -> list[str]:
        """Decimal ids of the whole text."""
        return list(chain.from_iterable(self.code_chunks(text)))

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.code(text)))

    def join(self, ids: list[int] | list[str]) -> str:
        """Text of ids before the prefix is taken off; each byte that is not UTF-8 becomes U+FFFD, as in the library."""
        try:
            text = "".join(map(self.texts.__getitem__, ids))
        except TypeError:  # control and unknown ids part the bytes around them
            runs, marks = [[]], [""]
            for i in map(int, ids):
                if i in self.special:
                    runs.append([])
                    marks.insert(-1, UNKNOWN if i == self.unknown else "")
                else:
                    runs[-1].append(i)
            return "".join(x for pair in zip(map(self.join, runs), marks, strict=True) for x in pair)
        try:
            text.encode("utf-8")
        except UnicodeEncodeError:  # bytes of byte pieces
            return BROKEN.sub("\ufffd", text.encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape"))
        return text

    def decode(self, ids: list[int] | list[str]) -> str:
        text = self.join(ids)
        first = next((int(i) for i in ids if self.texts[i] is not None), None)
        marked = first is not None and first not in self.bytes and self.names[first].startswith(SPACE)
        return text[1:] if self.dummy_prefix and marked and int(ids[0]) == first else text


@lru_cache(maxsize=2)
def from_model(path: str) -> MergePieces:
    """The tables of a SentencePiece model file with an identity normaliser; once in each worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    return MergePieces([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], byte_ids, special, sp.unk_id(), sp.encode(" ")[:1] != [])


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def coded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens and the digests of the ids and of the text decoded from them; path None: the public model on each worker."""
    short_batches(docs.sparkSession)

    def run(batches):
        coder = from_model(path or model_path())
        for b in batches:
            counts, ids, texts = [], [], []
            for text in b.column(1).to_pylist():
                coded_ids = coder.code(text)
                decoded = coder.decode(coded_ids)
                counts.append(len(coded_ids))
                ids.append(hashlib.sha256(",".join(coded_ids).encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the public 32k merge-type model."""
    return coded(table(spark, sf_dir, "documents"))
