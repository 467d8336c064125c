"""Token ids of words, remembered by each worker as flat arrays."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Words, and bytes of these, whose tokens a worker remembers; it forgets all when there are more.
REMEMBERED, REMEMBERED_BYTES = 200_000, 8 << 20


class WordTokens:
    """Numbers for words; the tokens of word number i are ids[bounds[i] : bounds[i + 1]]. Another vocabulary that follows this one
    has the same numbers, so that words are looked up once."""

    follower: WordTokens | None = None

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        if self.follower:
            self.follower.forget()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """A number for each word, good until the next call."""
        new = list(set(words).difference(self.known))
        if new and (len(self.known) + len(new) > REMEMBERED or self.held > REMEMBERED_BYTES):
            self.forget()
            new = list(set(words))
        if new:
            self.held += sum(map(len, new))
            self.add(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def add(self, new: list[bytes]) -> None:
        """The tokens of new words, here and in what follows."""
        found = self.encode(new)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        self.ids = np.concatenate([self.ids, flat])
        if self.follower:
            self.follower.add(new)

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens of the words end to end, and how many each word has."""
        sizes = self.bounds[numbers + 1] - self.bounds[numbers]
        at = np.repeat(self.bounds[numbers] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.ids[at], sizes
