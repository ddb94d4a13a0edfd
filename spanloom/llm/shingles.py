"""Hashed word shingles of texts, in numpy over whole Arrow batches."""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TERMS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_POWERS: dict[str, np.ndarray] = {}
# Bytes of text that are hashed together.
_BLOCK = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; products of unsigned numbers wrap as they should."""
    if not _POWERS or len(_POWERS["up"]) < size:
        size = max(size, _BLOCK)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and the number of words of each text.

    Words are runs without ASCII white space. The hash of a word is a polynomial of its bytes modulo 2**64, taken from
    running sums over the block, then scrambled.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(joined) + 1)
    with np.errstate(over="ignore"):
        sums = np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], dtype=np.uint64)
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        hashes = mix64((sums[ends - 1] - before) * down[starts])
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, limits), prepend=0)


def shingle_sets(texts: list[str | None], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending. A-Z count as lower case.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    found: list[np.ndarray] = []
    block, held = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        block.append(data)
        held += len(data)
        if held >= _BLOCK:
            found += _sets(block, size)
            block, held = [], 0
    return found + (_sets(block, size) if block else [])


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    hashes, counts = word_hashes(texts)
    # Lacking words of a short text count as zero; a hash of a word is never taken for that, as it is scrambled.
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    with np.errstate(over="ignore"):
        whole = np.zeros(len(hashes), np.uint64)
        for k in range(size):
            whole += padded[k : k + len(hashes)] * _TERMS[k]
        whole = mix64(whole)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= size:
            sets.append(np.unique(whole[at : at + n - size + 1]))
        elif n:
            with np.errstate(over="ignore"):
                sets.append(mix64((hashes[at : at + n] * _TERMS[:n]).sum(keepdims=True, dtype=np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
        at += n
    return sets
