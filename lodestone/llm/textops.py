"""Words and shingles of many texts at once, as 64-bit hashes, in numpy.

A word is a maximal run of anything but space and the bytes 9 to 13; A-Z count as a-z. A word's hash is a
polynomial over its bytes, taken from prefix sums over the whole batch, so no text is walked byte by byte in
Python. Two different words share a hash with a chance of about 2 ** -64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_WORD = np.ones(256, dtype=np.uint8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Buffers are hashed in pieces of this many bytes.
PIECE = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finalizer of 64-bit values (splitmix64)."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(256, dtype=U64), 7)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, for places 0 to PIECE."""
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(PIECE + 1, base, dtype=U64)
        steps[0] = 1
        found.append(np.multiply.accumulate(steps))
    return found[0], found[1]


def run_sums(raw: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(polynomial sum of the bytes, A-Z as a-z, start, end) of each longest run of one kind other than 0; at most PIECE bytes."""
    inner = kind != 0
    edge = np.empty(len(raw) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    start, end = np.flatnonzero(edge[:-1] & inner), np.flatnonzero(edge[1:] & inner) + 1
    power, inverse = _powers()
    sums = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(_byte_values()[_LOWER[raw]] * power[: len(raw)], out=sums[1:])
    return (sums[end] - sums[start]) * inverse[start], start, end


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a buffer. It is walked in pieces; a word that crosses their ends is put together again."""
    found, starts = [], []
    held, room = 0, 0  # sum and bytes of a word that the piece before has begun
    for at in range(0, len(data), PIECE):
        raw = np.frombuffer(data, dtype=np.uint8, count=min(PIECE, len(data) - at), offset=at)
        sums, start, end = run_sums(raw, _WORD[raw])
        whole = at + len(raw) == len(data)
        if room:
            if len(start) and start[0] == 0:
                sums[0] = (held + pow(_BASE, room, 1 << 64) * int(sums[0])) & _MASK
                first = at - room
                if end[0] == len(raw) and not whole:  # the piece is all inside of the word
                    held, room = int(sums[0]), room + len(raw)
                    continue
                starts.append(np.array([first], dtype=np.int64))
                found.append(sums[:1])
                sums, start, end = sums[1:], start[1:], end[1:]
            else:
                starts.append(np.array([at - room], dtype=np.int64))
                found.append(np.array([held], dtype=U64))
            held = room = 0
        if len(end) and end[-1] == len(raw) and not whole:
            held, room = int(sums[-1]), int(end[-1] - start[-1])
            sums, start = sums[:-1], start[:-1]
        found.append(sums)
        starts.append(start + at)
    if not found:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    return mix(np.concatenate(found), 1), np.concatenate(starts)


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text)."""
    hashes, starts = hash_words(b" ".join(texts))
    edges = np.cumsum([0] + [len(x) + 1 for x in texts])
    return hashes, np.diff(np.searchsorted(starts, edges))


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct n-word shingles in ascending order, text after text; their number per text).

    A text of fewer than n words has its whole sequence as one shingle; a text without words has none.
    """
    words, counts = text_words(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    total = np.zeros(len(words), dtype=U64)
    for j in range(n):
        total[: len(words) - j] += mix(words[j:], 11 + j) if j else mix(words, 11)
    owner = np.repeat(np.arange(len(texts)), counts)
    full = np.arange(len(words)) + n <= ends[owner]
    short = np.flatnonzero((counts > 0) & (counts < n))
    values, owners = [total[full]], [owner[full]]
    if len(short):
        values.append(np.array([np.sum([mix(words[starts[i] + j : starts[i] + j + 1], 11 + j)[0] for j in range(counts[i])], dtype=U64) + U64(counts[i]) for i in short], dtype=U64))
        owners.append(short)
    value, own = mix(np.concatenate(values), 5), np.concatenate(owners)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[keep], own[keep]
    return value, np.bincount(own, minlength=len(texts))
