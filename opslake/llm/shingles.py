"""Hashes of words and of runs of words, over many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hash a worker remembers; the memory is emptied when full.
REMEMBERED_WORDS = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_2 = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers over all bits."""
    values = (values ^ (values >> np.uint64(32))) * _ODD
    values = (values ^ (values >> np.uint64(29))) * _ODD_2
    return values ^ (values >> np.uint64(32))


def word_hashes(words: list[list[str]], memory: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one row, and where each text ends."""
    ends = np.cumsum([len(w) for w in words]) if words else np.empty(0, np.int64)
    total = int(ends[-1]) if len(ends) else 0
    hashes = np.fromiter((memory[w] for text in words for w in text), np.uint64, total)
    return hashes, ends


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` neighbours, whichever texts they belong to."""
    number = max(0, len(hashes) - size + 1)
    got = np.zeros(number, np.uint64)
    for k in range(size):
        got *= _ODD_2
        got += hashes[k : k + number]
    return mix(got)


def shingles(hashes: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each run of ``size`` words as its hash, the number of its text, and its place among all words.

    A shorter text is one run of all its words.
    """
    counts = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(counts)), counts)
    number = max(0, len(hashes) - size + 1)
    place = np.flatnonzero(text[:number] == text[size - 1 :]) if number else np.empty(0, np.int64)
    got, of = windows(hashes, size)[place], text[place]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return got, of, place
    own = [windows(hashes[ends[i] - counts[i] : ends[i]], int(counts[i]))[0] for i in short]
    own = mix(np.array(own, np.uint64) + counts[short].astype(np.uint64))
    return np.concatenate((got, own)), np.concatenate((of, short)), np.concatenate((place, (ends - counts)[short]))


def weighted_cells(found: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each unit of weight: the first, second, ... occurrence of a run in its text."""
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    nth = np.arange(len(found)) - np.repeat(starts, np.diff(starts, append=len(found)))
    return np.where(nth == 0, found, mix(found + nth.astype(np.uint64) * _ODD)), text
