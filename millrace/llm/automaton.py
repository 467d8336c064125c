"""Suffix automata over sequences of hashable symbols."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """All substrings of some sequences, with how often each occurs in them."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def add(self, sequence: Iterable, times: int = 1) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)
            self.count[last] += times

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """The part of state q that p's strings reach, as a state of its own."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, symbol) -> int:
        if (q := self.next[last].get(symbol)) is not None:
            return self._split(last, q, symbol)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][symbol], symbol)
        return new

    def finish(self) -> SuffixAutomaton:
        """Hands each state's occurrences on to its suffixes; after this nothing is added."""
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for v in by_length:
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]
        return self

    def occurrences(self, sequence: Sequence, width: int) -> list[int]:
        """How often each ``width`` symbols in a row of a sequence occur; by their first place."""
        out = [0] * max(0, len(sequence) - width + 1)
        v = matched = 0
        follow, link, length = self.next, self.link, self.length
        for end, symbol in enumerate(sequence):
            while v and symbol not in follow[v]:
                v = link[v]
                matched = length[v]
            if symbol in follow[v]:
                v = follow[v][symbol]
                matched += 1
            if matched >= width:
                while length[link[v]] >= width:
                    v = link[v]
                matched = min(matched, length[v])
                out[end - width + 1] = self.count[v]
        return out
