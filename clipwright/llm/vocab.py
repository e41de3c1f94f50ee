"""Token ids of whole texts by public tokenizers, each distinct word of a task encoded once.

The tokenizers used here never let a token reach over the places where texts are cut into words; tests
hold the ids against those of the uncut texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np

#: A space between two signs other than white space: the tokenizers start anew with it.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: A worker forgets its distinct words beyond this number of them, and encodes them again.
MOST_WORDS = 1_000_000
#: Texts are encoded together up to this number of characters; a longer one by itself.
BLOCK_CHARS = 2_000_000


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each pair of `starts` and `counts`, one after the other."""
    before = np.cumsum(counts) - counts
    return values[np.arange(int(counts.sum())) + np.repeat(starts - before, counts)]


def offsets(counts: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _filled(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """`array` with `values` from `at` on, in a larger copy if they don't fit."""
    if at + len(values) > len(array):
        array = np.concatenate([array[:at], np.empty(max(at, 2 * len(values)), array.dtype)])
    array[at : at + len(values)] = values
    return array


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists in one array, and how many each has."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())), counts


class Encoded:
    """The ids of words, from one or more encoders, each asked once for each distinct word.

    An encoder gives a list of ids for each word, or the ids of all words in one array and how many each has. `flat[e]`, `starts[e]` and
    `counts[e]` hold encoder e's ids of all words known; `marks` what `mark`, which needs lists, says of each.
    """

    def __init__(self, *encoders: Callable[[list[str]], Iterable[list[int]] | tuple[np.ndarray, np.ndarray]], mark: Callable[..., bool] | None = None, most: int = MOST_WORDS):
        self.encoders, self.mark, self.most = encoders, mark, most
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = [np.empty(0, np.int32) for _ in self.encoders]
        self.starts, self.counts = ([np.empty(0, np.int64) for _ in self.encoders] for _ in range(2))
        self.marks, self.used, self.words = np.empty(0, bool), [0] * len(self.encoders), 0

    def _keep(self, words: list[str]) -> None:
        if not words:
            return
        before, now = self.words, self.words + len(words)
        all_ids = [encode(words) for encode in self.encoders]
        if self.mark is not None:
            all_ids = [list(ids) for ids in all_ids]
            self.marks = _filled(self.marks, before, np.fromiter(map(self.mark, words, *all_ids), bool, len(words)))
        for e, ids in enumerate(all_ids):
            used = self.used[e]
            flat, counts = ids if isinstance(ids, tuple) else flattened(list(ids))
            self.flat[e] = _filled(self.flat[e], used, flat)
            self.starts[e] = _filled(self.starts[e], before, used + np.cumsum(counts) - counts)
            self.counts[e] = _filled(self.counts[e], before, counts)
            self.used[e] = used + len(flat)
        self.at.update(zip(words, range(before, now), strict=True))
        self.words = now

    def places(self, words: list[str]) -> np.ndarray:
        """The number of each word in `starts`, `counts` and `marks`; good until the next call."""
        found = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        new = dict.fromkeys(words[i] for i in missing)
        if len(self.at) + len(new) > self.most and self.at:
            self.forget()
            missing, new = np.arange(len(words)), dict.fromkeys(words)
        self._keep(list(new))
        found[missing] = [self.at[words[i]] for i in missing]
        return found

    def ids(self, places: np.ndarray, encoder: int = 0) -> np.ndarray:
        return ragged(self.flat[encoder], self.starts[encoder][places], self.counts[encoder][places])


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """The texts in blocks of about `most` characters, each with the place of its first text."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]
