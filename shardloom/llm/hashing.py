"""Hashes of words and word n-grams, for whole texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15
#: Bytes of the cache of word hashes, about; words that are longer than so many bytes are not kept in it.
CACHE_BYTES, CACHED = 32 << 20, 64


class _Hashes(dict):
    """Word to 64 bits of its BLAKE2b hash."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= CACHED:
            if self.size > CACHE_BYTES:
                self.clear()
                self.size = 0
            self.size += len(word) + 150
            self[word] = value
        return value


class Numbers(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


_HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word. Equal hashes are a reason to compare words, not proof that they are equal."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; of a shorter, non-empty text one hash of all its words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = (out + words[k : k + len(out)]) * np.uint64(_BASE)
    return mix(out + np.uint64(n))


def _joined(left: np.ndarray, right: np.ndarray, at: int) -> np.ndarray:
    """Dense numbers of the pairs (left[i], right[i + at])."""
    n = max(0, len(right) - at)
    return np.unique(left[:n] * (int(right.max(initial=0)) + 1) + right[at:], return_inverse=True)[1].astype(np.int64)


def gram_numbers(texts: list[list[bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, start): numbers of the n-grams of words of texts in turn, equal where all words are.

    Those of text i are number[start[i]:start[i + 1]]. A shorter text that has words is one n-gram, which
    no longer text has.
    """
    known = Numbers({b"": 0})  # no word is empty: that one fills up short texts
    size = np.array([max(len(t), n) if t else 0 for t in texts], np.int64)
    flat = np.zeros(int(size.sum()), np.int64)
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    for t, a in zip(texts, start.tolist(), strict=False):
        flat[a : a + len(t)] = np.fromiter(map(known.__getitem__, t), np.int64, len(t))
    code, length, power, p, rest = None, 0, flat, 1, n
    while rest:
        if rest & 1:
            code, length = power if code is None else _joined(code, power, length), length + p
        if rest := rest >> 1:
            power, p = _joined(power, power, p), 2 * p
    grams = np.maximum(size - n + 1, 0)
    own = np.repeat(np.arange(len(texts)), grams)
    before = np.concatenate([[0], np.cumsum(grams)]).astype(np.int64)
    return code[start[own] + np.arange(len(own)) - before[own]], before
