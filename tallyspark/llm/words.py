"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of anything but space and the controls 9 to 13, with A-Z in lower case. A
word's hash is a polynomial in its bytes' random codes, taken from prefix sums, then mixed; a
shingle's combines the hashes of its words. Texts are walked in segments of ``SEGMENT`` bytes,
whatever their length and that of their words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEGMENT = 1 << 18
WORDS_IN_SHINGLE = 5
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
LOOSE_GAPS = _SPACE.copy()  # ASCII punctuation parts words too
LOOSE_GAPS[[c for c in range(128) if not chr(c).isalnum()]] = True
_CODES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(SEGMENT, b, np.uint64))]) for b in (_BASE, inverse))


def _segment_words(raw: bytes, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial, start and end of each word of at most ``SEGMENT`` bytes."""
    b = np.frombuffer(raw.lower(), np.uint8)
    gap = np.concatenate([[True], gaps[b], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers()
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_CODES[b] * up[: len(b)], out=sums[1:])
    return (sums[end] - sums[start]) * down[start], start, end


def _finished(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(h + size.astype(np.uint64) * _STEP)


def _long_text(raw: bytes, gaps: np.ndarray) -> np.ndarray:
    """The words of a text of more than a segment. A word that goes on in the next segment is
    put together from its parts' polynomials."""
    out, part, size = [], 0, 0  # of the word at the end of what was read
    for at in range(0, len(raw), SEGMENT):
        piece = raw[at : at + SEGMENT]
        h, start, end = _segment_words(piece, gaps)
        n = end - start
        if size and (not len(start) or start[0]):
            out.append(_finished(np.array([part], np.uint64), np.array([size])))
            part = size = 0
        if not len(start):
            continue
        if size:
            h[0] = np.uint64((part + pow(_BASE, size, 1 << 64) * int(h[0])) % (1 << 64))
            n[0] += size
        part, size = (int(h[-1]), int(n[-1])) if end[-1] == len(piece) else (0, 0)
        done = len(h) - (size > 0)
        out.append(_finished(h[:done], n[:done]))
    if size:
        out.append(_finished(np.array([part], np.uint64), np.array([size])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[str | None], gaps: np.ndarray = _SPACE) -> list[np.ndarray]:
    """The words of each text in order, as hashes; ``gaps``: the bytes between words."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    batch: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal batch, held
        if batch:
            h, start, end = _segment_words(b"\n".join(x for _, x in batch), gaps)
            h = _finished(h, end - start)
            bounds = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for _, x in batch)]))
            for (i, _), a, z in zip(batch, bounds[:-1], bounds[1:]):
                out[i] = h[a:z]
        batch, held = [], 0

    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if len(raw) > SEGMENT:
            out[i] = _long_text(raw, gaps)
            continue
        if held + len(raw) > SEGMENT:
            flush()
        batch.append((i, raw))
        held += len(raw) + 1
    flush()
    return out


def shingles(words: np.ndarray, k: int = WORDS_IN_SHINGLE) -> np.ndarray:
    """Hashes of the k-word shingles in order; of fewer words, the whole sequence as one."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * _STEP + words[j : j + n]
    return mix(out)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted by hash."""
    return [np.unique(shingles(w)) for w in word_hashes(texts)]
