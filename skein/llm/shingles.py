"""Words and word shingles of many texts at a time, as 64-bit numbers.

Words are runs of bytes outside space and 09-0D, after lower-casing A-Z. A word's number comes from the running sum of
byte numbers times powers of an odd constant, so that all words of a stretch of text are hashed by a few array operations;
the stretch is bounded, so memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

STRETCH = 1 << 20
WIDTH = 5
_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_BYTE[_SPACE] = 0
_PLACE = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the constant and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, STRETCH + 4096)
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def stretches(raw: bytes) -> Iterator[bytes]:
    """raw in parts of about STRETCH bytes that end between words."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + STRETCH)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word of raw, and the byte at which it begins."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in a row, and where each text's words begin and end among them (len(texts) + 1 places)."""
    raws = [(t or "").encode("utf-8", "replace").lower() for t in texts]  # bytes.lower changes A-Z only
    numbers, ends, n = [np.zeros(0, np.uint64)], [0], 0
    group: list[bytes] = []

    def flush() -> None:
        nonlocal n
        if group:
            sizes = np.cumsum([len(r) + 1 for r in group])
            h, start = hash_words(b" ".join(group))
            numbers.append(h)
            ends.extend((n + np.searchsorted(start, sizes, "left")).tolist())
            n += len(h)
            group.clear()

    held = 0
    for r in raws:
        if len(r) > STRETCH:
            flush()
            held = 0
            for part in stretches(r):
                h, _ = hash_words(part)
                numbers.append(h)
                n += len(h)
            ends.append(n)
            continue
        if held + len(r) > STRETCH:
            flush()
            held = 0
        group.append(r)
        held += len(r) + 1
    flush()
    return np.concatenate(numbers), np.array(ends, np.int64)


def shingles_of(words: np.ndarray) -> np.ndarray:
    """The number of each five-word shingle in order; of fewer words, the whole sequence as one; of none, none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < WIDTH:
        return mix((words * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    out = words[: n - WIDTH + 1] * _PLACE[0]
    for k in range(1, WIDTH):
        out = out + words[k : n - WIDTH + 1 + k] * _PLACE[k]
    return mix(out)


def sequences_of(words: np.ndarray, n: int) -> np.ndarray:
    """The number of every run of n words: shingles for WIDTH words, the numbers of such short whole texts for fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if n == WIDTH:
        return shingles_of(words)
    out = words[: len(words) - n + 1] * _PLACE[0]
    for k in range(1, n):
        out = out + words[k : len(words) - n + 1 + k] * _PLACE[k]
    return mix(out + np.uint64(n))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle numbers of each text."""
    words, ends = words_of(texts)
    return [np.unique(shingles_of(words[a:b])) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Numbers in both of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
