"""64-bit hashes of words, shingles and byte strings, vectorised over a text's bytes.

Bytes enter as whole numbers of eight, and every step passes them through a mixing function, never through sums of powers: a polynomial
modulo 2^64 gives equal hashes to long strings as simple as a Thue-Morse word and its complement, whatever its base.
"""

from __future__ import annotations

import sys

import numpy as np
import xxhash

U = np.uint64
MASK = (1 << 64) - 1

#: Odd multipliers of a shingle's places.
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair, different in a and b."""
    x = a * U(PLACES[0])
    x ^= x >> U(32)
    x += b
    return mix(x)


def grams(data: bytes | np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, without a copy; as many as whole ones fit."""
    if sys.byteorder != "little":
        raise RuntimeError("hashes are defined on little-endian machines")
    return np.ndarray((max(0, len(data) - 7),), U, buffer=data, strides=(1,)) if len(data) > 7 else np.zeros(0, U)


def doubled(data: np.ndarray, width: int) -> np.ndarray:
    """Ranks of all `width`-byte strings by prefix doubling from eight bytes: the rank at 2w is that of the pair of ranks at w, w apart.
    width is 8 times a power of 2."""
    ranks, w = grams(data), 8
    while w < width:
        ranks = pair_ranks(ranks[:-w], ranks[w:]) if len(ranks) > w else np.zeros(0, U)
        w *= 2
    return ranks


#: Bytes from tab to carriage return, and the space.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: The first k bytes of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Words over so many bytes are hashed by the library.
LONG_WORD = 64


def word_hashes(data: bytes, seed: int = 1, segment: int = 1 << 20) -> np.ndarray:
    """Hashes of a text's words, A-Z lowered. Their edges are looked for in segments."""
    n = len(data)
    padded = data.lower() + bytes(8)
    every, edges, before = np.frombuffer(padded, np.uint8)[:n], [], True
    for at in range(0, n, segment):
        blank = BLANK[every[at : at + segment]]
        edges.append(np.flatnonzero(blank[1:] != blank[:-1]) + at + 1)
        if blank[0] != before:
            edges.insert(-1, np.array([at]))
        before = blank[-1]
    if not before:
        edges.append(np.array([n]))
    if not edges:
        return np.zeros(0, U)
    edges = np.concatenate(edges)
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = grams(padded)
    h = mix(size.astype(U) * U(PLACES[1]) + U(seed))
    h = mix(h ^ (eight[start] & FIRST[np.minimum(size, 8)]))
    for at in range(8, LONG_WORD, 8):
        more = np.flatnonzero(size > at)
        if not len(more):
            break
        h[more] = mix(h[more] ^ (eight[start[more] + at] & FIRST[np.minimum(size[more] - at, 8)]))
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(padded[start[k] : start[k] + size[k]], seed)
    return h


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of `width` consecutive words; of the whole sequence where there are fewer, none without words."""
    if not len(words):
        return words
    wide = min(width, len(words))
    n = len(words) - wide + 1
    out = np.full(n, wide, U)
    for k in range(wide):
        out += words[k : k + n] * U(PLACES[k % 8] + 2 * (k // 8))
    return np.unique(mix(out))
