"""Words and word shingles as 64-bit hashes.

A word is what is left of a run between ASCII white space, in lower case, without ASCII
characters other than letters and digits; where nothing is left there is no word.
Hashes are polynomials over the UTF-8 bytes, taken from running sums for all words of
many texts at once.
"""

from __future__ import annotations

import numpy as np

from quern.llm.common import MIX, mix

N = 5
CHUNK = 1 << 20
NEAR = 1 << 17  # characters that are scanned at a time: what is made of them stays in a core's cache
DROP, CHAR, SPACE, LINE = 0, 1, 2, 3
_KIND = np.full(256, CHAR, np.uint8)
_KIND[:128] = [CHAR if chr(i).isalnum() else LINE if i == 10 else SPACE if chr(i) in " \t\r\x0b\x0c" else DROP for i in range(128)]
_DROPPED = np.flatnonzero(_KIND == DROP).astype(np.uint8).tobytes()
_VALUE = np.random.default_rng(20240301).integers(1, 1 << 63, 256, np.uint64)
_INVERSE = np.uint64(pow(int(MIX), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, n at least."""
    if len(_powers[0]) < n:
        n = max(n, CHUNK + (CHUNK >> 2))
        for i, x in enumerate((MIX, _INVERSE)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers


def scan(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of every word of the texts, lines numbered from 0 through all of them; each text begins a line."""
    found, n = [], 0
    for lo, hi in parts(texts, NEAR):
        raw = "\n".join([t.lower() for t in texts[lo:hi]]).encode().translate(None, _DROPPED)
        h, line, more = scanned(raw)
        found.append((h, line + n))
        n += more
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def scanned(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """scan() of lower-case bytes without what is dropped, and the number of their lines."""
    b = np.frombuffer(raw, np.uint8)
    kind = np.frombuffer(raw.translate(_KIND.tobytes()), np.uint8)
    char = kind == CHAR
    edge = np.flatnonzero(np.diff(char, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    breaks = np.flatnonzero(kind == LINE)
    h = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):  # a very long text: pieces that end between words
        lo = start[i]
        j = len(start) if end[-1] - lo <= 2 * CHUNK else max(i + 1, int(np.searchsorted(end, lo + CHUNK, "right")))
        hi = end[j - 1]
        up, down = _grown(hi - lo)
        s = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(np.take(_VALUE, b[lo:hi]) * up[: hi - lo], out=s[1:])
        h[i:j] = (s[end[i:j] - lo] - s[start[i:j] - lo]) * down[start[i:j] - lo]
        i = j
    line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.searchsorted(start, breaks), prepend=0, append=len(start)))
    return mix(h) | np.uint64(1), line, len(breaks) + 1


_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True


def run_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray = _VALUE) -> np.ndarray:
    """Hashes (none 0) of the byte runs [start, end), which are in order and apart."""
    h = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):  # pieces that end between runs
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + CHUNK, "right")))
        hi = end[j - 1]
        up, down = _grown(hi - lo)
        s = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value[b[lo:hi]] * up[: hi - lo], dtype=np.uint64, out=s[1:])
        h[i:j] = (s[end[i:j] - lo] - s[start[i:j] - lo]) * down[start[i:j] - lo]
        i = j
    h = mix(h)
    h[h == 0] = 1
    return h


def byte_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the texts in order, words of each text).

    Here a word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case.
    """
    b = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edge = np.diff((~_SPACES[b]).astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return run_hashes(b, start, end, _LOWER), np.diff(np.searchsorted(start, ends), prepend=0)


def parts(texts: list[str | None], most: int = CHUNK):
    """(first, last) runs of texts of about `most` characters; a longer text is alone, and whole."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t or "") > most:
            yield lo, i
            lo, n = i, 0
        n += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def words_of(texts: list[str | None]):
    """Word hashes of each text in turn; none for null."""
    for lo, hi in parts(texts):
        some = [t or "" for t in texts[lo:hi]]
        h, line = scan(some)
        last = np.cumsum([t.count("\n") + 1 for t in some])
        yield from np.split(h, np.searchsorted(line, last[:-1]))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the text's words in order."""
    return scan([text])[0]


def shingles(words: np.ndarray, n: int = N) -> np.ndarray:
    """Distinct hashes, in order of size, of the runs of n words; of all words together where there are fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * MIX + words[j : len(words) - n + 1 + j]
    return np.unique(mix(h))
