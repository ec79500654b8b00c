"""Regular expressions over bytes compiled to minimal deterministic automata.

The syntax: literals, escapes (\\\\xHH, \\\\n, \\\\t, \\\\r and escaped signs), ``.``, classes with ranges and ``^``, groups, ``|``,
``*``, ``+``, ``?``, ``{m}``, ``{m,}`` and ``{m,n}``, and ``(?i:...)`` for ASCII letters in either case. A parsed
expression becomes an NFA, the NFAs of all rules one DFA by subset construction, and the DFA a minimal one by
partition refinement; its states are numbered so that accepting ones come last.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

ALL = frozenset(range(256))


class Parser:
    """Recursive descent to a tree of ('set', bytes), ('cat', ...), ('alt', ...), ('rep', node, least, most or None)."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def parse(self):
        node = self.alternatives(False)
        if self.at < len(self.text):
            raise ValueError(f"unmatched ) at {self.at} in {self.text!r}")
        return node

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self, fold: bool):
        found = [self.sequence(fold)]
        while self.peek() == "|":
            self.at += 1
            found.append(self.sequence(fold))
        return found[0] if len(found) == 1 else ("alt", *found)

    def sequence(self, fold: bool):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom(fold)))
        return ("cat", *parts)

    def repeated(self, node):
        while (sign := self.peek()) and sign in "*+?{":
            self.at += 1
            if sign == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, int(sign == "+"), 1 if sign == "?" else None)
        return node

    def escaped(self) -> int:
        sign = self.take()
        if sign == "x":
            return int(self.take() + self.take(), 16)
        return {"n": 10, "t": 9, "r": 13}.get(sign, ord(sign))

    def atom(self, fold: bool):
        sign = self.take()
        if sign == "(":
            inner = fold
            if self.text.startswith("?i:", self.at):
                self.at, inner = self.at + 3, True
            elif self.text.startswith("?:", self.at):
                self.at += 2
            node = self.alternatives(inner)
            if self.take() != ")":
                raise ValueError(f"missing ) in {self.text!r}")
            return node
        if sign == "[":
            return ("set", self.members(fold))
        if sign == ".":
            return ("set", ALL - {10})
        return ("set", self.folded({self.escaped() if sign == "\\" else ord(sign)}, fold))

    def members(self, fold: bool) -> frozenset[int]:
        negative = self.peek() == "^"
        self.at += negative
        found: set[int] = set()
        first = True
        while self.peek() != "]" or first:
            first = False
            sign = self.take()
            low = high = self.escaped() if sign == "\\" else ord(sign)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                sign = self.take()
                high = self.escaped() if sign == "\\" else ord(sign)
            found |= set(range(low, high + 1))
        self.at += 1
        found = set(self.folded(found, fold))
        return frozenset(ALL - found if negative else found)

    @staticmethod
    def folded(found: set[int], fold: bool) -> frozenset[int]:
        if max(found, default=0) > 255:
            raise ValueError("only bytes can be matched")
        letters = {b ^ 32 for b in found if 65 <= (b & ~32) <= 90} if fold else set()
        return frozenset(found | letters)


def reversed_tree(node):
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", reversed_tree(node[1]), *node[2:])
    parts = [reversed_tree(x) for x in node[1:]]
    return (node[0], *(reversed(parts) if node[0] == "cat" else parts))


#: Openings end where text matches them by chance once in 2**_RARE bytes, if bytes were all alike likely.
_RARE = 48
_WAYS = 64


def openings(node) -> list[tuple[frozenset[int], ...]]:
    """Sequences of byte sets, one of which every match of a tree begins with: each of one width, so that its end tells its start.

    A sequence ends where it is rare enough, or where the expression goes on with a varying number of bytes."""

    def rare(way) -> bool:
        return sum(8 - np.log2(len(s)) for s in way) >= _RARE if all(way) else True

    def extend(ways, node):
        """(sequence, whether it goes on) of ``ways`` followed by node."""
        if len(ways) > _WAYS:
            ways = [(w, False) if w else (w, on) for w, on in ways]
        done, live = [x for x in ways if not x[1] or rare(x[0])], [x for x in ways if x[1] and not rare(x[0])]
        done = [(w, False) for w, _ in done]
        if not live:
            return done
        if node[0] == "set":
            return done + [((*w, node[1]), True) for w, _ in live]
        if node[0] == "cat":
            for x in node[1:]:
                live = extend(live, x)
            return done + live
        if node[0] == "alt":
            return done + [y for x in node[1:] for y in extend(live, x)]
        _, inner, least, most = node
        for _ in range(least):
            live = extend(live, inner)
        if most == least:
            return done + live
        if most == 1:
            return done + live + extend([x for x in live if x[1]], inner)
        # goes on with a varying number: those that have begun end here, the others begin after it or in it
        begun, bare = [(w, False) for w, _ in live if w], [x for x in live if not x[0]]
        return done + begun + bare + [(w, False) for w, _ in (extend(bare, inner) if bare else [])]

    found = list(dict.fromkeys(w for w, _ in extend([((), True)], node)))
    if () in found:
        raise ValueError("the expression matches the empty text")
    return found


class Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Adds a tree after ``start``; returns its end."""
        if node[0] == "set":
            at, end = self.state(), self.state()
            self.empty[start].append(at)
            self.moves[at] = (node[1], end)
            return end
        if node[0] == "cat":
            for x in node[1:]:
                start = self.add(x, start)
            return start
        if node[0] == "alt":
            end = self.state()
            for x in node[1:]:
                self.empty[self.add(x, start)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        ends = [start]
        for _ in range(most - least):
            start = self.add(inner, start)
            ends.append(start)
        end = self.state()
        for x in ends:
            self.empty[x].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass(frozen=True)
class Dfa:
    """moves[256 * state + byte] is the next state; states from ``accepting`` on accept, ``labels`` names the rules."""

    moves: np.ndarray
    start: int
    accepting: int
    labels: tuple[tuple[int, ...], ...]
    dead: int

    @property
    def states(self) -> int:
        return len(self.moves) // 256


def compile_dfa(trees: list, anywhere: bool) -> Dfa:
    """One minimal DFA for all trees. anywhere: a match may begin at any byte; accepting states then name what ends there."""
    nfa = Nfa()
    start, ends = nfa.state(), {}
    for rule, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[start].append(first)
        ends[nfa.add(tree, first)] = rule
    # bytes that no rule tells apart form one class
    sets = list(dict.fromkeys(m[0] for m in nfa.moves if m))
    kinds: dict[tuple, int] = {}
    kind_of = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
    sample = [kind_of.index(k) for k in range(len(kinds))]
    first = nfa.closure({start})
    number, table, todo = {first: 0}, [], [first]
    for states in todo:
        row = []
        for byte in sample:
            to = {m[1] for s in states if (m := nfa.moves[s]) and byte in m[0]}
            to = nfa.closure(to | ({start} if anywhere else set()))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    label = [tuple(sorted(ends[s] for s in states if s in ends)) for states in todo]
    block = {x: i for i, x in enumerate(dict.fromkeys(label))}
    part = [block[x] for x in label]
    while True:  # states stay together while their moves lead to the same blocks
        signs: dict[tuple, int] = {}
        new = [signs.setdefault((part[i], *(part[x] for x in row)), len(signs)) for i, row in enumerate(table)]
        if len(signs) == len(set(part)):
            break
        part = new
    found = {p: i for i, p in reversed(list(enumerate(part)))}
    order = sorted(found, key=lambda p: (bool(label[found[p]]), found[p]))
    place = {p: i for i, p in enumerate(order)}
    moves = np.array([[place[part[table[found[p]][kind_of[b]]]] for b in range(256)] for p in order], np.int32)
    labels = tuple(label[found[p]] for p in order)
    dead = next((i for i in range(len(order)) if not labels[i] and (moves[i] == i).all()), -1)
    return Dfa(moves.reshape(-1), place[part[0]], sum(not x for x in labels), labels, dead)


@lru_cache(maxsize=8)
def opening_automaton(patterns: tuple[str, ...]) -> tuple[Dfa, tuple[tuple[int, int], ...]]:
    """The DFA of all rules' openings anywhere in a text; its labels are numbers into (rule, width)."""
    ways = [(rule, way) for rule, p in enumerate(patterns) for way in openings(Parser(p).parse())]
    dfa = compile_dfa([("cat", *(("set", s) for s in way)) for _, way in ways], True)
    return dfa, tuple((rule, len(way)) for rule, way in ways)


@lru_cache(maxsize=8)
def anchored(patterns: tuple[str, ...]) -> Dfa:
    """One DFA of all rules' whole expressions, for matches that begin at a known byte."""
    return compile_dfa([Parser(p).parse() for p in patterns], False)


def reaching(dfa: Dfa, rule: int) -> bytes:
    """For each state 0 (no match of the rule can follow), 1 (one can) or 2 (one ends here)."""
    moves = dfa.moves.reshape(-1, 256)
    found = np.array([2 if rule in x else 0 for x in dfa.labels], np.uint8)
    while True:
        more = (found == 0) & (found[moves] > 0).any(axis=1)
        if not more.any():
            return found.tobytes()
        found[more] = 1


@lru_cache(maxsize=64)
def rule_automata(pattern: str) -> tuple[Dfa, Dfa]:
    """For one rule: the anchored DFA, and the DFA that finds starts of matches when the text is read backwards."""
    tree = Parser(pattern).parse()
    return compile_dfa([tree], False), compile_dfa([reversed_tree(tree)], True)


def longest(dfa_moves: list[int], dfa: Dfa, data: bytes, at: int) -> int:
    """End of the longest match that begins at ``at``, or -1."""
    state, end = dfa.start, at if dfa.start >= dfa.accepting else -1
    for i in range(at, len(data)):
        state = dfa_moves[256 * state + data[i]]
        if state >= dfa.accepting:
            end = i + 1
        elif state == dfa.dead:
            break
    return end
