"""Hashes of all words of a batch of texts at once, with numpy.

A word's hash is a polynomial in its bytes: with prefix sums over a buffer, each word costs two look-ups, so nothing
loops over words or characters in Python. Buffers hold about ``CHUNK`` bytes, whatever the length of a text; a longer word
is hashed buffer by buffer, so its hash doesn't depend on where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
SPACE, LINE = 32, 10


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 2 * CHUNK + 2), _powers(_BASE_INVERSE, 2 * CHUNK + 2)

#: ASCII letters (in lower case), digits and all bytes of other characters make words; line feeds stay, the rest is space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == LINE else SPACE for c in range(256)
)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each span of ``values`` (uint64), sum of value times base to the power of its place in the span.

    Spans that lie over ``2 * CHUNK`` values apart must be given in separate calls.
    """
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _UP[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _DOWN[starts]


def _pieces(texts: Sequence[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(number of the text, line feeds before the part, part of the text with bytes mapped).

    Parts end before a separator, so no word is cut: a word of over ``CHUNK`` bytes makes a longer part of its own.
    """
    for k, text in enumerate(texts):
        text, at, lines = text.translate(WORD_TABLE), 0, 0
        while len(text) - at > CHUNK:
            cut = max(text.rfind(b" ", at + 1, at + CHUNK), text.rfind(b"\n", at + 1, at + CHUNK))
            if cut < 0:
                cut = min((c for c in (text.find(b" ", at + CHUNK), text.find(b"\n", at + CHUNK)) if c >= 0), default=len(text))
            yield k, lines, text[at:cut]
            lines += text.count(b"\n", at, cut)
            at = cut
        if at < len(text) or not at:
            yield k, lines, text[at:] if at else text


def _long(part: tuple[int, int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The one word of a part of over ``CHUNK`` bytes, its polynomial carried from buffer to buffer."""
    k, lines, data = part
    word = data.lstrip(b" \n")
    total = 0
    for at in range(0, len(word), CHUNK):
        values = np.frombuffer(word[at : at + CHUNK], dtype=np.uint8).astype(np.uint64)
        total += pow(int(_BASE), at, 1 << 64) * int(polynomial(values, np.array([0]), np.array([len(values)]))[0])
    line = lines + data[: len(data) - len(word)].count(b"\n")
    return mix(np.array([total % (1 << 64)], dtype=np.uint64)), np.array([k]), np.array([line]), np.array([len(word)])


def _hashed(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(p for _, _, p in parts) + b" ", dtype=np.uint8)
    edge = np.flatnonzero(np.diff((data > SPACE).view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([0] + [len(p) + 1 for _, _, p in parts[:-1]])
    part = np.searchsorted(begins, starts, side="right") - 1
    breaks = np.flatnonzero(data == LINE)
    before = np.array([n for _, n, _ in parts]) - np.searchsorted(breaks, begins)
    return mix(polynomial(data.astype(np.uint64), starts, ends)), np.array([k for k, _, _ in parts])[part], np.searchsorted(breaks, starts) + before[part], ends - starts


def words(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, numbers of the texts, numbers of the lines within them, bytes) of all words in order, a buffer at a time."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for part in _pieces(texts):
        if parts and size + len(part[2]) > CHUNK:
            yield _hashed(parts)
            parts, size = [], 0
        if len(part[2]) > CHUNK:
            yield _long(part)
            continue
        parts.append(part)
        size += len(part[2]) + 1
    if parts:
        yield _hashed(parts)
