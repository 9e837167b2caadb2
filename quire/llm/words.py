"""Word and shingle fingerprints of Arrow text, in numpy.

A word is a run of bytes that are none of space, tab, line feed, vertical tab, form feed and carriage return; A-Z are
lower-cased. Fingerprints have 64 bits: a word's is the scrambled sum of a scrambled number for each byte and its place,
whatever the word's length, so no pattern of letters makes two words meet; what rests on them alone can only be wrong by
chance, at about 5e-20 for each pair compared.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

K = 5


def _fixed(count: int, seed: int) -> np.ndarray:
    """The same pseudo-random 64-bit numbers in every process."""
    return mixed(np.arange(count, dtype=np.uint64) + np.uint64(seed << 32))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30)) ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mixed_int(x: int) -> int:
    """The same of one Python number."""
    full = (1 << 64) - 1
    x &= full
    x = ((x ^ (x >> 30) ^ 0x5851F42D4C957F2D) * 0xBF58476D1CE4E5B9) & full
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
    return x ^ (x >> 31)


def _letters() -> np.ndarray:
    table = _fixed(256, 1)
    table[65:91] = table[97:123]
    return table


LETTER = _letters()
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
ORDER = _fixed(K + 1, 3) | np.uint64(1)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of large-string texts end to end, and the offset of each text and of the end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def word_prints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each word of all texts, and the offset of each text's first word (and of the end)."""
    flat, offsets = flat_bytes(texts)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = ~SPACE[flat]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    opening = offsets[:-1][offsets[:-1] < len(flat)]
    start[opening] |= inside[opening]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero(inside)
    lens = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    place = (at - np.repeat(starts, lens)).astype(np.uint64)
    with np.errstate(over="ignore"):
        place *= np.uint64(0x9E3779B97F4A7C15)
        terms = LETTER[flat[at]]
        terms ^= place
        terms ^= terms >> np.uint64(32)
        terms *= np.uint64(0xD6E8FEB86659FD93)
        terms ^= terms >> np.uint64(29)
        terms *= np.uint64(0xBF58476D1CE4E5B9)
        terms ^= terms >> np.uint64(32)
        sums = np.add.reduceat(terms, np.cumsum(lens) - lens)
        sums += lens.astype(np.uint64)
    return mixed(sums), np.searchsorted(starts, offsets)


def shingle_prints(prints: np.ndarray, first: np.ndarray, k: int = K, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each k-word run of each text in order, and the offset of each text's first one (and of the end).

    short: a text of fewer than k words (but one at least) has its whole sequence as its only shingle."""
    words = np.diff(first)
    counts = np.maximum(words - k + 1, (words > 0).astype(np.int64) if short else 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    begin = np.repeat(first[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    with np.errstate(over="ignore"):
        padded = np.append(prints, np.zeros(k, np.uint64))
        out = np.full(offsets[-1], ORDER[K], np.uint64)
        brief = np.repeat(np.minimum(words, k), counts)
        for j in range(k):
            term = padded[begin + j] * ORDER[j]
            if short:
                term[brief <= j] = 0
            out += term
        out += brief.astype(np.uint64) * ORDER[0]
    return mixed(out), offsets


#: White space between words, and the letters that are lower-cased.
BETWEEN, LOWER = re.compile(r"[\x20\x09-\x0D]+"), {c: c + 32 for c in range(65, 91)}


def word_shingles(text: str, k: int = K) -> frozenset:
    """The distinct k-word shingles themselves; none where there are fewer words."""
    found = [w for w in BETWEEN.split(text.translate(LOWER)) if w]
    return frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1))
