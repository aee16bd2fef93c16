"""Suffix automata over words, and matching statistics of word streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """All word sequences inside the sequences added so far, in states linear in their words."""

    def __init__(self, sequences: Iterable[list[str]] = ()):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in sequences:
            self.add(s)

    def _state(self, length: int, link: int, after: dict[str, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        """The state of exactly the sequences one word longer than p's longest; a copy of q where q holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[str]) -> None:
        last = 0
        for word in sequence:
            if (q := self.next[last].get(word)) is not None:  # known already, from this or another sequence
                last = self._split(last, q, word)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][word], word)
            last = new

    def matches(self, sequence: Iterable[str]) -> Iterator[int]:
        """Matching statistics: after each word, the length of the longest suffix of the stream that the automaton holds."""
        state = size = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if (q := self.next[state].get(word)) is not None:
                state, size = q, size + 1
            yield size
