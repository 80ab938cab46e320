"""Generalised suffix automaton of some token sequences: which substrings they hold, and where."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence


class SuffixAutomaton:
    """States stand for the sets of substrings that end at the same places; link leads to the longest suffix with more places. Its size grows with the sequences' tokens."""

    def __init__(self, sequences: Iterable[Sequence[int]]):
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: list[int] = []  # state of each sequence
        ends: list[tuple[int, int, int]] = []
        for number, tokens in enumerate(sequences):
            state = 0
            for at, token in enumerate(tokens):
                state = self._extended(state, token)
                ends.append((state, number, at + 1))
            self.whole.append(state)
        self._tour(ends)

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, token: int, to: int) -> int:
        """The state of the moved string itself, where `to` also stands for longer ones."""
        if self.length[to] == self.length[state] + 1:
            return to
        made = self._state(self.length[state] + 1, dict(self.moves[to]), self.link[to])
        self.link[to] = made
        while state >= 0 and self.moves[state].get(token) == to:
            self.moves[state][token] = made
            state = self.link[state]
        return made

    def _extended(self, last: int, token: int) -> int:
        if token in self.moves[last]:
            return self._split(last, token, self.moves[last][token])
        made, state = self._state(self.length[last] + 1, {}, 0), last
        while state >= 0 and token not in self.moves[state]:
            self.moves[state][token] = made
            state = self.link[state]
        if state >= 0:
            self.link[made] = self._split(state, token, self.moves[state][token])
        return made

    def _tour(self, ends: list[tuple[int, int, int]]) -> None:
        """Numbers the states so that those whose strings end in a state's strings are a range; the places of a state are then a slice."""
        below: list[list[int]] = [[] for _ in self.link]
        for state in range(1, len(self.link)):
            below[self.link[state]].append(state)
        self.first, self.last = [0] * len(self.link), [0] * len(self.link)
        turn, stack = 0, [(0, False)]
        while stack:
            state, left = stack.pop()
            if left:
                self.last[state] = turn
                continue
            self.first[state] = turn
            turn += 1
            stack.append((state, True))
            stack += [(x, False) for x in below[state]]
        ends.sort(key=lambda e: self.first[e[0]])
        self._turns = [self.first[s] for s, _, _ in ends]
        self._ends = [(number, to) for _, number, to in ends]

    def places(self, state: int) -> list[tuple[int, int]]:
        """Sequence and end of all occurrences of the state's strings."""
        return self._ends[bisect_left(self._turns, self.first[state]) : bisect_right(self._turns, self.last[state] - 1)]

    def statistics(self, tokens: Iterable[int]) -> Iterator[tuple[int, int]]:
        """Of each token: the length of the longest known string that ends there, and its state."""
        state = size = 0
        for token in tokens:
            while state and token not in self.moves[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.moves[state]:
                state, size = self.moves[state][token], size + 1
            yield size, state

    def suffixes(self, size: int, state: int, least: int = 1) -> Iterator[tuple[int, int, int]]:
        """Of a match: sequence, end and length (least or more) of the longest common string with each place where one of its suffixes ends."""
        done: tuple[int, int] | None = None
        while state > 0 and size >= least:
            lo, hi = bisect_left(self._turns, self.first[state]), bisect_right(self._turns, self.last[state] - 1)
            for at in range(lo, hi):
                if done is None or not done[0] <= at < done[1]:
                    yield (*self._ends[at], size)
            done = (lo, hi)
            state = self.link[state]
            size = self.length[state]
