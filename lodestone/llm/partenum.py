"""PartEnum signatures: sets that are similar enough, in one band of sizes, share a signature.

A pair with 100 * |a & b| >= percent * |a | b| differs in at most D elements, and D follows from the size of the smaller set. Sizes fall into
bands, so that a similar pair lies in one band or in two that follow each other; a set signs for its own band and, as
the smaller one, for the next. A band's elements fall into `groups` first-level partitions of the feature domain, each of them
into `parts` second-level ones, of which up to `spoiled` may differ. D differences can't spoil more than `spoiled` parts in each of
D // (spoiled + 1) + 1 groups: in one of any so many groups, all but `spoiled` parts are whole. So for each of its first so many groups a
set enumerates the subsets of parts that leave `spoiled` out, and signs each: a hash of the subset's elements. Of a similar pair the larger set
signs for the same groups as the smaller one, and more.

`levels` chooses the sizes by band. Small sets have two levels, three parts with one left out: a signature then holds a third more
elements, which keeps short texts on a common pattern apart, at half as many signatures again. Large sets have groups of one part, which
takes the fewest signatures. There, groups without elements in a set would be shared by all such sets: a set counts and signs only those it has
elements in, unless these aren't enough for the argument above; then it signs all. (Of the groups in which either set has elements, each that only one has is
spoiled; so the first D + 1 of them hold a whole one, and neither set counts further than that to reach it.)
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .textops import U64, mix

#: Bands grow by 100 / percent this many times over.
STEPS = 2
#: Up to so many differences a band has two levels.
TWO_LEVELS = 24
PARTS = 3


@lru_cache(maxsize=8)
def bands(percent: int, largest: int) -> np.ndarray:
    """Lower ends of the bands up to sizes of `largest`, and two more."""
    low = [1]
    while len(low) < 3 or low[-3] <= largest:
        end = low[-1]
        for _ in range(STEPS):
            end = end * 100 // percent + 1
        low.append(end)
    return np.array(low, dtype=np.int64)


def most_differences(percent: int, both: np.ndarray) -> np.ndarray:
    """Elements in which a similar pair of this many elements together can differ."""
    return (100 - percent) * both // (100 + percent)


def differences(percent: int, sizes: np.ndarray) -> np.ndarray:
    """Elements in which a set of this size can differ from a similar one that isn't smaller."""
    return most_differences(percent, sizes + sizes * 100 // percent)


def levels(percent: int, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first-level groups, parts left out) of bands with these largest sizes; with 0 left out a group is one part."""
    most = differences(percent, upper)
    two = (most > 0) & (most <= TWO_LEVELS)
    return np.where(most == 0, 1, np.where(two, most // 2 + 1, most + 3 + most // 50)), two.astype(np.int64)


def signatures(elements: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the set) for sets given one after the other; sets without elements have none."""
    found, owners = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
    if not len(elements):
        return found[0], owners[0]
    low = bands(percent, 1 << int(sizes.max()).bit_length())
    own = np.searchsorted(low, sizes, side="right") - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values = mix(elements, 21)
    differ = differences(percent, sizes)
    for ahead in (0, 1):
        band = own + ahead
        groups, spoiled = levels(percent, low[band + 1] - 1)
        signs = (sizes > 0) & ((low[band] <= sizes * 100 // percent) if ahead else True)  # else there is no partner in the next band
        for left_out in (0, 1):
            n = np.where(signs & (spoiled == left_out), groups, 0)
            use = n[owner] > 0
            o = owner[use]
            if not len(o):
                continue
            salted = elements[use] ^ mix(band[o].astype(U64), 31)
            first = np.cumsum(n) - n
            place = ((mix(salted, 23) >> U64(32)) * n[o].astype(U64)) >> U64(32)
            group = first[o] + place.astype(np.int64)
            sig, of = (_two_levels if left_out else _one_level)(group, salted, values[use], n, first, differ)
            found.append(mix(sig + mix(band[of].astype(U64), 41), 53))
            owners.append(of)
    return np.concatenate(found), np.concatenate(owners)


def _one_level(group: np.ndarray, salted: np.ndarray, values: np.ndarray, n: np.ndarray, first: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = int(n.sum())
    sums = np.zeros(total, dtype=U64)
    np.add.at(sums, group, values)
    held = np.bincount(group, minlength=total)
    of = np.repeat(np.arange(len(n)), n)
    count = np.concatenate([[0], np.cumsum(held > 0)])
    rank = count[1:] - count[first[of]]  # of a group among those with elements
    filled = (count[first + n] - count[first])[of]
    k = np.flatnonzero((filled <= differ[of]) | ((held > 0) & (rank <= differ[of] + 1)))
    number = (k - first[of[k]]).astype(U64)
    return sums[k] + mix(number, 43) + mix(held[k].astype(U64), 47), of[k]


def _two_levels(group: np.ndarray, salted: np.ndarray, values: np.ndarray, n: np.ndarray, first: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = int(n.sum())
    part = group * PARTS + (mix(salted, 29) % U64(PARTS)).astype(np.int64)
    sums = np.zeros(total * PARTS, dtype=U64)
    np.add.at(sums, part, values)
    sums, held = sums.reshape(-1, PARTS), np.bincount(part, minlength=total * PARTS).reshape(-1, PARTS)
    of = np.repeat(np.arange(len(n)), n)
    k = np.flatnonzero(np.arange(total) - first[of] <= differ[of] // 2)
    rest, left = sums[k].sum(axis=1, dtype=U64)[:, None] - sums[k], held[k].sum(axis=1)[:, None] - held[k]
    number = (k - first[of[k]]).astype(U64)[:, None] * U64(PARTS) + np.arange(PARTS, dtype=U64)
    return (rest + mix(number, 43) + mix(left.astype(U64), 47)).reshape(-1), np.repeat(of[k], PARTS)


def sketch_words(percent: int, sizes: np.ndarray) -> np.ndarray:
    """64-bit words of a set's parity sketch: a power of two, eight bits or more for each possible difference."""
    bits = np.maximum(8 * differences(percent, sizes), 64)
    return (1 << np.ceil(np.log2(bits / 64)).astype(np.int64)).astype(np.int64)


def sketches(elements: np.ndarray, sizes: np.ndarray, percent: int) -> list[bytes]:
    """Parities of each set's elements that hash to each bit. Two sets differ in at least as many elements as their sketches in bits."""
    words = sketch_words(percent, sizes)
    first = np.cumsum(words) - words
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = 64 * first[owner] + (mix(elements, 61) & (U64(64) * words[owner].astype(U64) - U64(1))).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * int(words.sum())) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[8 * f : 8 * (f + w)] for f, w in zip(first.tolist(), words.tolist(), strict=True)]


def fold(row: bytes, words: int) -> np.ndarray:
    """A sketch at a smaller size: halves are added modulo 2."""
    out = np.frombuffer(row, dtype="<u8")
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def possible(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each pair of rows can be similar, bits in which their sketches differ). Never rules out a similar pair."""
    bits = np.bitwise_count(left ^ right).sum(axis=-1).astype(np.int64)
    small, large = np.minimum(n_left, n_right), np.maximum(n_left, n_right)
    return (bits <= most_differences(percent, n_left + n_right)) & (100 * small >= percent * large), bits
