"""Rules compiled together into one minimal deterministic automaton over bytes.

Thompson's construction, the subset construction over classes of bytes that no rule tells apart,
and Moore's minimisation; the result is one transition array and a bit set of rules per state.
"""

from __future__ import annotations

import re
from re import _parser as grammar

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[set[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append(set())
        self.moves.append([])
        return len(self.empty) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _folded(chars: set[int], fold: bool) -> frozenset[int]:
    if fold:
        chars = chars | {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}
    return frozenset(chars)


def _members(items) -> set[int]:
    out: set[int] = set()
    negate = False
    for op, arg in items:
        if op is grammar.NEGATE:
            negate = True
        elif op is grammar.LITERAL:
            out.add(arg)
        elif op is grammar.RANGE:
            out |= set(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"no class of this kind in a rule: {op}")
    return set(range(256)) - out if negate else out


def _build(nfa: _Nfa, parsed, start: int, fold: bool, backwards: bool) -> int:
    """Add the parsed expression after ``start``; returns its end state."""
    for op, arg in reversed(list(parsed)) if backwards else parsed:
        if op in (grammar.LITERAL, grammar.NOT_LITERAL, grammar.IN):
            end = nfa.state()
            chars = _members(arg) if op is grammar.IN else {arg} if op is grammar.LITERAL else set(range(256)) - {arg}
            nfa.moves[start].append((_folded(chars, fold), end))
        elif op is grammar.SUBPATTERN:
            end = _build(nfa, arg[-1], start, fold, backwards)
        elif op is grammar.BRANCH:
            end = nfa.state()
            for branch in arg[1]:
                first = nfa.state()
                nfa.empty[start].add(first)
                nfa.empty[_build(nfa, branch, first, fold, backwards)].add(end)
        elif op is grammar.MAX_REPEAT:
            low, high, inner = arg
            end = start
            for _ in range(low):
                end = _build(nfa, inner, end, fold, backwards)
            if high is grammar.MAXREPEAT:
                loop, out = nfa.state(), nfa.state()
                nfa.empty[end].add(loop)
                nfa.empty[_build(nfa, inner, loop, fold, backwards)].add(loop)
                nfa.empty[loop].add(out)
                end = out
            else:
                out = nfa.state()
                for _ in range(high - low):
                    nfa.empty[end].add(out)
                    end = _build(nfa, inner, end, fold, backwards)
                nfa.empty[end].add(out)
                end = out
        else:
            raise ValueError(f"rules have no {op}")
        start = end
    return start


class Automaton:
    """``classes``: byte to class; ``table[state][class]``; ``accepts[state]``: bit set of rules; state 0 starts.

    ``first_accepting``: states from this number on accept. ``dead``: the state that leads nowhere, or -1.
    """

    def __init__(self, rules: list[tuple[str, bool]], anchored: bool = False, backwards: bool = False) -> None:
        nfa = _Nfa()
        root, ends = nfa.state(), {}
        for k, (pattern, fold) in enumerate(rules):
            first = nfa.state()
            nfa.empty[root].add(first)
            ends.setdefault(_build(nfa, grammar.parse(pattern, re.ASCII), first, fold, backwards), set()).add(k)
        if not anchored:
            nfa.moves[root].append((frozenset(range(256)), root))
        kinds = sorted({m for moves in nfa.moves for m, _ in moves}, key=sorted)
        rows = np.array([[b in m for m in kinds] for b in range(256)])
        _, byte_of, self.classes = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        self.classes = self.classes.reshape(-1)
        # subset construction; a set of states is a bit set, moves lead to closed sets
        closed = [sum(1 << t for t in nfa.closure([s])) for s in range(len(nfa.moves))]
        class_of = {m: [c for c, b in enumerate(byte_of) if b in m] for m in kinds}
        moves = [[(c, closed[t]) for m, t in own for c in class_of[m]] for own in nfa.moves]
        final = {s: sum(1 << k for k in ks) for s, ks in ends.items()}
        names, todo, table, accepts = {closed[root]: 0}, [closed[root]], [], []
        for now in todo:
            row, bits = [0] * len(byte_of), 0
            while now:
                s = (now & -now).bit_length() - 1
                now &= now - 1
                bits |= final.get(s, 0)
                for c, then in moves[s]:
                    row[c] |= then
            for c, then in enumerate(row):
                if then not in names:
                    names[then] = len(todo)
                    todo.append(then)
                row[c] = names[then]
            table.append(row)
            accepts.append(bits)
        # Moore's minimisation
        t, a = np.array(table), np.array(accepts)
        block = np.unique(a, return_inverse=True)[1].reshape(-1)
        while True:
            finer = np.unique(np.column_stack([block, block[t]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        order = sorted(range(block.max() + 1), key=lambda b: (b != block[0], bool(a[np.argmax(block == b)])))
        if a[0]:
            raise ValueError("a rule matches the empty string")
        rank = {b: i for i, b in enumerate(order)}
        one = [int(np.argmax(block == b)) for b in order]
        self.table = [[rank[block[s]] for s in t[i]] for i in one]
        self.accepts = [int(a[i]) for i in one]
        self.first_accepting = next((i for i, x in enumerate(self.accepts) if x), len(one))
        self.dead = next((i for i, row in enumerate(self.table) if not self.accepts[i] and set(row) == {i} and i), -1)
        self.translate = bytes(self.classes.astype(np.uint8))
