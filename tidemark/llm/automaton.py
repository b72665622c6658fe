"""Rule regexes to one minimal deterministic automaton over byte classes.

Syntax: literals, ``[...]`` classes with ranges, groups, ``|``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}``
and backslash escapes (``\\xHH`` too). Only ASCII may stand in a rule.
"""

from __future__ import annotations

import numpy as np


class Parser:
    """Thompson construction: a state has moves (byte set, target) and empty moves."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def parse(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern, 0
        tree = self.choice()
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at} in {pattern!r}")
        return self.build(tree)

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def choice(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            atom = self.atom()
            while self.peek() and self.peek() in "?*+{":
                atom = self.repeat(atom)
            parts.append(atom)
        return ("seq", parts)

    def repeat(self, atom):
        c = self.take()
        if c == "{":
            end = self.text.index("}", self.at)
            low, comma, high = self.text[self.at : end].partition(",")
            self.at = end + 1
            n = int(low)
            if not comma:
                return ("seq", [atom] * n)
            if high:
                return ("seq", [atom] * n + [("opt", atom)] * (int(high) - n))
            return ("seq", [atom] * n + [("star", atom)])
        return {"?": ("opt", atom), "*": ("star", atom), "+": ("seq", [atom, ("star", atom)])}[c]

    def atom(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            tree = self.choice()
            self.take()
            return tree
        if c == "[":
            return ("set", self.members())
        return ("set", frozenset([self.escaped() if c == "\\" else ord(c)]))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def members(self) -> frozenset[int]:
        found: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                c = self.take()
                found.update(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                found.add(low)
        return frozenset(found)

    def build(self, tree) -> tuple[int, int]:
        kind, arg = tree
        a, b = self.state(), self.state()
        if kind == "set":
            self.moves[a].append((arg, b))
        elif kind == "seq":
            at = a
            for part in arg:
                s, e = self.build(part)
                self.empty[at].append(s)
                at = e
            self.empty[at].append(b)
        elif kind == "or":
            for part in arg:
                s, e = self.build(part)
                self.empty[a].append(s)
                self.empty[e].append(b)
        else:
            s, e = self.build(arg)
            self.empty[a] += [s, b]
            self.empty[e].append(b)
            if kind == "star":
                self.empty[e].append(s)
        return a, b


Dfa = tuple[np.ndarray, np.ndarray]  # (moves[state, byte], accepts[state]); state 0 is the start, moves of -1 lead nowhere


def determined(start: frozenset[int], moves, accepting: frozenset[int], again: frozenset[int] = frozenset()) -> Dfa:
    """Subset construction. ``moves(state)`` lists (byte set, closed target set); ``again`` is added to each set, so that every byte may begin a match."""
    seen: dict[int, list] = {}
    todo, found = [start], {start}
    for here in todo:  # grows: all states that can be met
        for x in here:
            if x not in seen:
                seen[x] = moves(x)
                fresh = [t for _, t in seen[x] if t not in found]
                found.update(fresh)
                todo += fresh
    sets = sorted({m for row in seen.values() for m, _ in row}, key=sorted)
    signature = [tuple(b in x for x in sets) for b in range(256)]
    kinds = {x: i for i, x in enumerate(dict.fromkeys(signature))}
    classes = np.array([kinds[x] for x in signature])
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]
    ids, order, table = {start: 0}, [start], []
    for here in order:  # grows
        nexts = []
        for b in sample:
            into = again.union(*(t for x in here for m, t in seen[x] if b in m))
            if into and into not in ids:
                ids[into] = len(ids)
                order.append(into)
            nexts.append(ids[into] if into else -1)
        table.append(nexts)
    return np.array(table)[:, classes], np.array([not accepting.isdisjoint(x) for x in ids], np.int64)


def anchored(rule: str) -> Dfa:
    """The automaton of a rule's matches, from their start on."""
    parser = Parser()
    first, end = parser.parse(rule)
    closures: dict[int, frozenset[int]] = {}

    def closure(s: int) -> frozenset[int]:
        if s not in closures:
            seen, todo = {s}, [s]
            while todo:
                for t in parser.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            closures[s] = frozenset(x for x in seen if parser.moves[x] or x == end)
        return closures[s]

    return determined(closure(first), lambda x: [(m, closure(t)) for m, t in parser.moves[x]], frozenset([end]))


def edges(dfa: Dfa) -> list[list[tuple[frozenset[int], int]]]:
    """(byte set, target) of each state."""
    out = []
    for row in dfa[0]:
        out.append([(frozenset(np.flatnonzero(row == t).tolist()), t) for t in np.unique(row[row >= 0]).tolist()])
    return out


def shortest(dfa: Dfa) -> Dfa:
    """Of matches with one start only the shortest."""
    moves = dfa[0].copy()
    moves[dfa[1] != 0] = -1
    return moves, dfa[1]


def searching(dfa: Dfa) -> Dfa:
    """Accepts where a match ends that began anywhere."""
    out, start = edges(dfa), frozenset([0])
    return determined(start, lambda x: [(m, frozenset([t])) for m, t in out[x]], frozenset(np.flatnonzero(dfa[1]).tolist()), start)


def backwards(dfa: Dfa) -> Dfa:
    """Reads matches from their end; accepts at their starts."""
    into: list[list] = [[] for _ in dfa[1]]
    for x, row in enumerate(edges(dfa)):
        for m, t in row:
            into[t].append((m, frozenset([x])))
    return determined(frozenset(np.flatnonzero(dfa[1]).tolist()), into.__getitem__, frozenset([0]))


class Walker:
    """One rule's automaton over single bytes, in lists."""

    def __init__(self, dfa: Dfa):
        self.moves = [row.tolist() for row in dfa[0]]
        self.accepts = dfa[1].tolist()

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match from ``at``, or -1."""
        state, best = 0, at if self.accepts[0] else -1
        for i in range(at, len(data)):
            state = self.moves[state][data[i]]
            if state < 0:
                break
            if self.accepts[state]:
                best = i + 1
        return best

    def leftmost(self, data: bytes, end: int, least: int) -> int:
        """Least start from ``least`` on of what ends at ``end``, or -1; the automaton is one of ``backwards``."""
        state, best = 0, -1
        for i in range(end - 1, least - 1, -1):
            state = self.moves[state][data[i]]
            if state < 0:
                break
            if self.accepts[state]:
                best = i
        return best


def minimal(moves: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's refinement: split blocks until equal states move to equal blocks. State 0 stays the start."""
    columns = np.unique(moves, axis=1, return_inverse=True)
    table, classes = columns[0], columns[1].ravel()
    block = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, first = np.unique(block, return_index=True)
    place = np.argsort(np.argsort(first))  # by first appearance
    order = np.sort(first)
    return place[block[table[order]]][:, classes], accepts[order]


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Both automata side by side, of reachable pairs only; ``b`` accepts with bit ``shift``."""
    classes = np.unique(np.vstack([a[0], b[0]]), axis=1, return_index=True, return_inverse=True)
    sample, of = classes[1], classes[2].ravel()
    left, right = a[0][:, sample].tolist(), b[0][:, sample].tolist()
    ids, todo, table = {(0, 0): 0}, [(0, 0)], []
    for x, y in todo:  # grows
        nexts = []
        for pair in zip(left[x], right[y]):
            if pair not in ids:
                ids[pair] = len(ids)
                todo.append(pair)
            nexts.append(ids[pair])
        table.append(nexts)
    return np.array(table)[:, of], np.array([a[1][x] | b[1][y] << shift for x, y in todo])


LANE, LANES = 256, 4096


class Automaton:
    """One automaton for where the shortest match of each of some rules ends, wherever it began.

    ``classes[byte]`` is a byte's class; ``next[state + class]`` the next state, where states are multiples of ``n_classes``.
    ``accepts[state / n_classes]`` has bit r where rule r ends; all states from ``first_accepting`` on accept.
    Each rule is made deterministic and minimal, then joined to those before and minimised again, so that
    the subsets of one rule never multiply with those of another.
    """

    def __init__(self, rules: list[str]):
        whole = minimal(*searching(shortest(anchored(rules[0]))))
        for r, rule in enumerate(rules[1:], 1):
            whole = minimal(*product(whole, minimal(*searching(shortest(anchored(rule)))), r))
        moves, accepts = whole
        order = np.argsort(accepts != 0, kind="stable")
        place = np.argsort(order)
        _, sample, classes = np.unique(moves, axis=1, return_index=True, return_inverse=True)
        self.classes = classes.ravel().astype(np.int32)
        self.n_classes = len(sample)
        self.accepts = accepts[order]
        self.next = (place[moves[order][:, sample]] * self.n_classes).astype(np.int32).ravel()
        self.start = int(place[0]) * self.n_classes
        self.first_accepting = int((accepts == 0).sum()) * self.n_classes

    def ends(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ends, rule bits) of all matches, ascending; every byte goes through the automaton in blocks of ``LANE * LANES`` bytes."""
        at, bits, state = [], [], self.start
        for begin in range(0, len(data), LANE * LANES):
            block = np.frombuffer(data, np.uint8, min(LANE * LANES, len(data) - begin), begin)
            states = self._states(block, state)
            state = int(states[len(block) - 1])
            hit = np.flatnonzero(states >= self.first_accepting)
            at.append(hit + begin + 1)
            bits.append(self.accepts[states[hit] // self.n_classes])
        return (np.concatenate(at), np.concatenate(bits)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _states(self, block: np.ndarray, first: int) -> np.ndarray:
        """The state after each byte. Lanes of ``LANE`` bytes step together from the start state; a lane whose
        predecessor ends elsewhere is stepped again, until it meets the states that it had. This goes on until all lanes fit."""
        n = -(-len(block) // LANE)
        codes = np.full(n * LANE, self.classes[10], np.int32)
        codes[: len(block)] = self.classes[block]
        codes = np.ascontiguousarray(codes.reshape(n, LANE).T)
        entry = np.full(n, self.start, np.int32)
        entry[0] = first
        found, state = np.empty((LANE, n), np.int32), entry.copy()
        for t in range(LANE):
            state += codes[t]
            np.take(self.next, state, out=state, mode="clip")
            found[t] = state
        while len(wrong := np.flatnonzero(found[-1, :-1] != entry[1:]) + 1):
            if len(wrong) < 16:
                for i in wrong.tolist():
                    s = entry[i] = int(found[-1, i - 1])
                    for t, (c, was) in enumerate(zip(codes[:, i].tolist(), found[:, i].tolist())):
                        s = int(self.next[s + c])
                        if s == was:
                            break
                        found[t, i] = s
                continue
            entry[wrong] = state = found[-1, wrong - 1]
            for t in range(LANE):
                state = self.next[state + codes[t, wrong]]
                apart = state != found[t, wrong]
                wrong, state = wrong[apart], state[apart]
                if not len(wrong):
                    break
                found[t, wrong] = state
        return found.T.ravel()[: len(block)]
