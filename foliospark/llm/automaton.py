"""Rule regexes to one minimal deterministic automaton over bytes.

Rules are regular expressions of ASCII literals, character classes, groups, alternatives and greedy
repeats. Subset construction over all rules at once gives one automaton, partition refinement
minimises it, and byte classes keep its transition array small.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np

#: A byte no UTF-8 text has: it parts texts and sends the automaton back to its start.
BREAK = 0xFF


def _ascii_fold(byte: int) -> set[int]:
    return {byte, ord(chr(byte).swapcase())} if chr(byte).isalpha() else {byte}


class Nfa:
    """A Thompson automaton; ``edges`` are (from, byte set, to), ``jumps`` are (from, to)."""

    def __init__(self) -> None:
        self.size = 0
        self.edges: list[tuple[int, frozenset[int], int]] = []
        self.jumps: list[tuple[int, int]] = []

    def state(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, pattern: str) -> tuple[int, int]:
        """Add a pattern; its first and its accepting state."""
        return self._sequence(sre_parser.parse(pattern), self.state(), fold=False)

    def _sequence(self, tree: Iterable, at: int, fold: bool) -> tuple[int, int]:
        first = at
        for op, arg in tree:
            at = self._item(op, arg, at, fold)
        return first, at

    def _item(self, op: int, arg, at: int, fold: bool) -> int:
        if op in (sre.LITERAL, sre.IN):
            end = self.state()
            self.edges.append((at, self._bytes(op, arg, fold), end))
            return end
        if op is sre.SUBPATTERN:
            _, on, off, tree = arg
            return self._sequence(tree, at, (fold or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE)[1]
        if op is sre.BRANCH:
            end = self.state()
            for tree in arg[1]:
                start = self.state()
                self.jumps.append((at, start))
                self.jumps.append((self._sequence(tree, start, fold)[1], end))
            return end
        if op is sre.MAX_REPEAT:
            least, most, tree = arg
            for _ in range(least):
                at = self._sequence(tree, at, fold)[1]
            if most is sre.MAXREPEAT:
                loop = self.state()
                self.jumps.append((at, loop))
                self.jumps.append((self._sequence(tree, loop, fold)[1], loop))
                return loop
            end = self.state()
            for _ in range(most - least):
                self.jumps.append((at, end))
                at = self._sequence(tree, at, fold)[1]
            self.jumps.append((at, end))
            return end
        raise ValueError(f"not supported in a rule: {op}")

    @staticmethod
    def _bytes(op: int, arg, fold: bool) -> frozenset[int]:
        chosen: set[int] = set()
        for kind, value in [(op, arg)] if op is sre.LITERAL else arg:
            if kind is sre.LITERAL:
                chosen.add(value)
            elif kind is sre.RANGE:
                chosen.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"not supported in a class: {kind}")
        if max(chosen) > 127:
            raise ValueError("rules are ASCII")
        return frozenset(b for c in chosen for b in (_ascii_fold(c) if fold else {c}))

    def reversed(self) -> Nfa:
        other = Nfa()
        other.size = self.size
        other.edges = [(b, on, a) for a, on, b in self.edges]
        other.jumps = [(b, a) for a, b in self.jumps]
        return other


class Subsets:
    """Sets of states of an Nfa as bit masks, stepped by byte classes and kept once computed."""

    def __init__(self, nfa: Nfa, start: int, restart: bool):
        self.near = [1 << s for s in range(nfa.size)]
        changed = True
        while changed:
            changed = False
            for a, b in nfa.jumps:
                if (grown := self.near[a] | self.near[b]) != self.near[a]:
                    self.near[a], changed = grown, True
        sets = {on for _, on, _ in nfa.edges}
        signs = [tuple(b in on for on in sets) for b in range(256)]
        order = {sign: i for i, sign in enumerate(dict.fromkeys([signs[BREAK], *signs]))}
        self.class_of = np.array([order[s] for s in signs], np.int32)
        self.class_of[BREAK] = len(order)
        self.classes = len(order) + 1
        example = {order[s]: b for b, s in enumerate(signs)}
        self.moves: list[list[tuple[int, int]]] = [[] for _ in range(self.classes)]
        for a, on, b in nfa.edges:
            for c, byte in example.items():
                if byte in on:
                    self.moves[c].append((a, self.near[b]))
        self.start = self._closed(start)
        self.restart = self.start if restart else 0
        self.known: dict[tuple[int, int], int] = {}

    def _closed(self, mask: int) -> int:
        return sum_or(self.near[s] for s in range(mask.bit_length()) if mask >> s & 1)

    def step(self, at: int, c: int) -> int:
        key = (at, c)
        if (to := self.known.get(key)) is None:
            to = self.restart | sum_or(near for s, near in self.moves[c] if at >> s & 1)
            self.known[key] = to
        return to


def sum_or(masks: Iterable[int]) -> int:
    total = 0
    for m in masks:
        total |= m
    return total


class Anchored:
    """Runs one rule from a fixed place, forwards or (on the reversed rule) backwards."""

    def __init__(self, nfa: Nfa, start: int, accept: int):
        self.sets = Subsets(nfa, 1 << start, restart=False)
        self.accept = 1 << accept

    def furthest(self, data: Iterable[int]) -> int:
        """The number of bytes of the longest prefix that matches, or -1."""
        at, best = self.sets.start, -1
        for n, byte in enumerate(data, 1):
            at = self.sets.step(at, int(self.sets.class_of[byte]))
            if not at:
                break
            if at & self.accept:
                best = n
        return best


class Automaton:
    """All rules in one: scanning gives, for each byte, the rules that some match ends at."""

    def __init__(self, patterns: list[str]):
        whole = Nfa()
        ends, starts = [], []
        for p in patterns:
            first, last = whole.add(p)
            starts.append(first)
            ends.append(last)
        sets = Subsets(whole, sum(1 << s for s in starts), restart=True)
        number, queue, rows = {sets.start: 0}, [sets.start], []
        for at in queue:
            row = []
            for c in range(sets.classes):
                to = sets.start if c == sets.classes - 1 else sets.step(at, c)
                if to not in number:
                    number[to] = len(queue)
                    queue.append(to)
                row.append(number[to])
            rows.append(row)
        table = np.array(rows, np.int32)
        #: the distinct sets of rules that a state may accept, the empty one first; a state holds the number of its own
        self.accepted: list[tuple[int, ...]] = [()]
        numbers = {(): 0}
        accept = np.zeros(len(queue), np.int32)
        for i, s in enumerate(queue):
            rules = tuple(k for k, e in enumerate(ends) if s >> e & 1)
            if rules not in numbers:
                numbers[rules] = len(self.accepted)
                self.accepted.append(rules)
            accept[i] = numbers[rules]
        table, accept = _minimal(table, accept)
        self.classes, self.states = sets.classes, len(table)
        self.class_of = sets.class_of
        #: states are kept multiplied by the number of classes, so a step is one addition and one look-up
        self.table = (table * self.classes).ravel()
        self.accept = np.zeros(self.states * self.classes, np.int32)
        self.accept[:: self.classes] = accept
        self.forward, self.backward = [], []
        for p in patterns:
            one = Nfa()
            first, last = one.add(p)
            self.forward.append(Anchored(one, first, last))
            self.backward.append(Anchored(one.reversed(), last, first))

    def scan(self, data: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """Per byte the number, in ``accepted``, of the set of rules with a match that ends there. One pass, all lanes in step.

        The bytes are cut into lanes that advance together, each from the start state. A lane
        whose predecessor ended in another state is run again from that state until it falls in with
        what it had; this repeats until no lane disagrees, so the result is that of a single run.
        """
        size = len(data)
        lanes = max(1, min(lanes, size // 64))
        length = -(-size // lanes)
        padded = np.full(lanes * length, BREAK, np.uint8)
        padded[:size] = data
        steps = np.ascontiguousarray(self.class_of[padded.reshape(lanes, length).T])
        seen = np.empty((length, lanes), np.int32)
        at = np.zeros(lanes, np.int32)
        for t in range(length):
            at = np.take(self.table, at + steps[t])
            seen[t] = at
        begun = np.zeros(lanes, np.int32)
        while True:
            wanted = np.concatenate([[0], seen[-1, :-1]]).astype(np.int32)
            wrong = np.flatnonzero(wanted != begun)
            if not wrong.size:
                break
            begun[wrong] = wanted[wrong]
            at = wanted[wrong]
            for t in range(length):
                at = np.take(self.table, at + steps[t, wrong])
                differ = seen[t, wrong] != at
                if not differ.any():
                    break
                seen[t, wrong] = at
                wrong, at = wrong[differ], at[differ]
        return self.accept[seen.T.ravel()[:size]]


def _minimal(table: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge equivalent states: split by what they accept, then by where they lead, until stable."""
    block = np.unique(accept, return_inverse=True)[1].ravel()
    while True:
        signs = np.column_stack([block, block[table]])
        finer = np.unique(signs, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    names = np.full(block.max() + 1, -1)
    order = []
    for s in range(len(table)):  # the start state stays first
        if names[block[s]] < 0:
            names[block[s]] = len(order)
            order.append(s)
    return names[block[table[order]]].astype(np.int32), accept[order]
