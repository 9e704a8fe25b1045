"""64-bit hashes of words and shingles of whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and an odd base with its inverse: the hash of a word is sum(value[byte] * base^i).
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = np.uint64(int(_rng.integers(0, 1 << 62)) * 2 + 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, x in (("up", BASE), ("down", INVERSE)):
            with np.errstate(over="ignore"):
                _powers[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))])
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(body: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words of concatenated texts (text i is body[at[i]:at[i+1]]), and the first word of each text."""
    inside = ~space[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) if len(body) else inside
    after = np.concatenate([inside[1:], [False]]) if len(body) else inside
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, at)


def prefix_sums(body: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i] is the unshifted hash of body[i:j]."""
    up, _ = powers(len(body) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum(BYTE[body] * up[:-1], dtype=np.uint64)])


def range_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of body[begin:end], equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * STEP[-1])


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts given by their words' hashes (text i has words[first[i]:first[i+1]]) and each
    text's first shingle. A text with fewer words has its whole sequence as one; one without words has none."""
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    short = np.repeat(n < width, count)
    out = np.zeros(len(begin), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    length = np.repeat(np.minimum(n, width), count)
    for k in range(width):
        here = mix(padded[begin + k] + STEP[k]) * STEP[k]
        out += np.where(short & (k >= length), np.uint64(0), here)
    return mix(out + length.astype(np.uint64)), at


def shingle_sets(body: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and where each text's set begins."""
    body = LOWER[body]
    begin, end, first = spans(body, at)
    values, where = shingles(range_hash(prefix_sums(body), begin, end), first, width)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(where))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(at)))
