"""Word shingles of many texts at once, as 64-bit fingerprints in numpy.

Words are maximal runs of bytes other than space and \\t..\\r, A-Z lower-cased.
A word's fingerprint is a polynomial of its bytes modulo 2**64 (taken from
prefix sums over the whole batch), mixed; a shingle's combines its words'.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(n: int, base: int, key: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    p = _powers.get(key)
    if p is None:
        p = np.ones(1, U)
    while len(p) < n:
        p = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
    _powers[key] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_prints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, and how many words each text has."""
    joined = b" ".join(texts).translate(LOWER)
    n = len(joined)
    if not n:
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    b = np.frombuffer(joined, np.uint8)
    gap = SPACE[b]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(n + 1, U)
    np.cumsum((b.astype(U) + U(1)) * powers(n, BASE, "up"), out=total[1:])
    words = mix((total[end] - total[start]) * powers(n, BASE_INV, "down")[start] + (end - start).astype(U))
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    stops = np.cumsum(sizes)
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, stops)]))
    return words, counts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle fingerprints; with fewer than width
    words the whole sequence is its one shingle; no words, no shingle."""
    words, counts = word_prints(texts)
    n = len(words)
    sh = np.zeros(n, U)
    for j in range(width):
        m = U((0xD6E8FEB86659FD93 * (2 * j + 1)) & ((1 << 64) - 1))
        sh[: n - j] += mix(words[j:] * m + U(j))
    sh = mix(sh)
    out, at = [], 0
    for c in counts:
        if c >= width:
            out.append(np.unique(sh[at : at + c - width + 1]))
        elif c:
            h = 0x51ED270B * int(c)
            for w in words[at : at + c]:
                h = ((h ^ int(w)) * 0x9FB21C651E98DF25 + 1) & ((1 << 64) - 1)
            out.append(mix(np.array([h], U)))
        else:
            out.append(np.zeros(0, U))
        at += c
    return out
