"""One deterministic byte automaton for many regexes.

``compile_rules`` turns regexes over ASCII (classes, groups, alternation and
repeats) into one automaton that scans for all of them at once: a
nondeterministic automaton by rule, subset construction over the bytes that
the rules tell apart, and minimisation by partition refinement.  The result is
a flat transition array.  The scan tells where matches lie: a region begins
where the automaton last had no match under way, and ends at the last byte on
which it accepts the rule, so every match of the rule is inside one region.

Definite results: a regex outside the grammar, or one that the empty string
matches, is a ValueError; no texts, empty texts and null ones (given as empty)
have no regions; equal texts have equal regions; texts may have any length,
the memory of a scan is in proportion to the block.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

from typesift.llm import textbatch as tb

#: Longer lanes are walked alone; shorter ones side by side.
LONG_LANE = 4096

_ALL = frozenset(range(256))
_SPECIAL = "()[]{}|*+?.^$"


class _Regex:
    """Parses one rule: ``a``, ``\\.``, ``\\xHH``, ``.``, ``[..]``, ``(..)``, ``(?:..)``, ``(?i:..)``, ``|`` and repeats.

    Nodes: ("set", bytes), ("one of", sequences), ("repeat", least, most or None, node).
    """

    def __init__(self, rule: str):
        self.rule, self.at = rule, 0
        self.tree = self.choices(False)
        if self.at < len(rule):
            raise ValueError(f"unmatched ) in {rule!r}")

    def next(self, n: int = 1) -> str:
        part = self.rule[self.at:self.at + n]
        if len(part) < n:
            raise ValueError(f"{self.rule!r} ends too early")
        self.at += n
        return part

    def seen(self, part: str) -> bool:
        found = self.rule.startswith(part, self.at)
        self.at += len(part) * found
        return found

    def choices(self, fold: bool):
        found = [self.sequence(fold)]
        while self.seen("|"):
            found.append(self.sequence(fold))
        return ("one of", found)

    def sequence(self, fold: bool) -> list:
        out = []
        while self.at < len(self.rule) and self.rule[self.at] not in "|)":
            node = self.atom(fold)
            if self.seen("?"):
                node = ("repeat", 0, 1, node)
            elif self.seen("*"):
                node = ("repeat", 0, None, node)
            elif self.seen("+"):
                node = ("repeat", 1, None, node)
            elif self.seen("{"):
                close = self.rule.index("}", self.at)
                least, comma, most = self.next(close - self.at).partition(",")
                self.next()
                node = ("repeat", int(least), int(most) if most else None if comma else int(least), node)
            if self.at < len(self.rule) and self.rule[self.at] in "?*+{":
                raise ValueError(f"lazy and repeated repeats can't be compiled: {self.rule!r}")
            out.append(node)
        return out

    def atom(self, fold: bool):
        if self.seen("("):
            inner = fold or self.seen("?i:")
            if inner == fold and not self.seen("?:") and self.rule.startswith("?", self.at):
                raise ValueError(f"group can't be compiled: {self.rule[self.at - 1:]!r}")
            node = self.choices(inner)
            if not self.seen(")"):
                raise ValueError(f"unmatched ( in {self.rule!r}")
            return node
        if self.seen("["):
            return ("set", self.members(fold))
        if self.seen("."):
            return ("set", _ALL - {0x0A})
        if self.rule[self.at] in _SPECIAL:
            raise ValueError(f"{self.rule[self.at]} can't be compiled: {self.rule!r}")
        return ("set", _folded({self.char()}, fold))

    def members(self, fold: bool) -> frozenset:
        negate, out, first = self.seen("^"), set(), True
        while first or not self.seen("]"):
            low, first = self.char(), False
            if self.rule.startswith("-", self.at) and not self.rule.startswith("-]", self.at):
                self.next()
                out.update(range(low, self.char() + 1))
            else:
                out.add(low)
        out = _folded(out, fold)
        return _ALL - out if negate else out

    def char(self) -> int:
        c = self.next()
        if c == "\\":
            c = self.next()
            if c == "x":
                return int(self.next(2), 16)
            if c == "n":
                return 0x0A
            if c.isalnum():
                raise ValueError(f"escape \\{c} can't be compiled")
        if ord(c) > 127:
            raise ValueError(f"{c} is not ASCII")
        return ord(c)


def _folded(members: set[int], fold: bool) -> frozenset:
    more = {ord(x) for b in members if fold and b < 128 for x in (chr(b).lower(), chr(b).upper())}
    return frozenset(members | more)


class _Nfa:
    def __init__(self):
        self.on: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def add(self, node, start: int) -> int:
        """Append ``node`` after ``start``; returns its end."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.on[start].append((node[1], end))
        elif kind == "one of":
            end = self.state()
            for sequence in node[1]:
                last = start
                for one in sequence:
                    last = self.add(one, last)
                self.free[last].append(end)
        else:
            _, least, most, inner = node
            end = start
            for _ in range(least):
                end = self.add(inner, end)
            last = self.state()
            self.free[end].append(last)
            if most is None:
                self.free[self.add(inner, last)].append(last)
            for _ in range((most or least) - least):
                end = self.add(inner, end)
                self.free[end].append(last)
            end = last
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


class Scanner:
    """step: transitions, flat, state * n_classes + class, states premultiplied; accept: rules' bits by state.

    State 0 is that in which no match is under way.
    """

    def __init__(self, classes: np.ndarray, step: np.ndarray, accept: np.ndarray):
        self.n_classes = step.shape[1]
        self.n_states = len(step)
        self.classes = classes.astype(np.uint8)
        self.step = (step * self.n_classes).astype(np.int32).ravel()
        self.accept = np.repeat(accept.astype(np.int64), self.n_classes)
        resets = (step == step[0, 0]).all(0) if (step[:, 0] == step[0, 0]).any() else np.zeros(self.n_classes, dtype=bool)
        resets &= step[0] == 0  # every state goes to the start on these
        self.lane_byte = ~resets[self.classes]
        self.shortest = self._shortest(step, accept)

    @staticmethod
    def _shortest(step: np.ndarray, accept: np.ndarray) -> int:
        seen, now, n = {0}, {0}, 0
        while now and not any(accept[s] for s in now):
            now = set(np.unique(step[sorted(now)]).tolist()) - seen
            seen |= now
            n += 1
        return n

    def scan(self, block: tb.Block) -> np.ndarray:
        """For each text, the bits of the rules that match somewhere in it."""
        out = np.zeros(block.n, dtype=np.int64)
        text, rule, _, _ = self.regions(block)
        np.bitwise_or.at(out, text, np.int64(1) << rule)
        return out

    def regions(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, rule, start, end) of the regions, in ascending places of ``block.data``; every byte is read once."""
        starts, ends = block.runs(self.lane_byte)
        size = ends - starts
        use = size >= self.shortest
        starts, size = starts[use], size[use]
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        n_long = int(np.searchsorted(-size, -LONG_LANE, side="left"))
        data = self.classes[block.data]
        found = [self._walk(data[starts[i]:starts[i] + size[i]].tobytes(), i) for i in range(n_long)]
        if n_long < len(starts):
            found.append(self._walk_lanes(data, starts[n_long:], size[n_long:], n_long))
        lane, begin, end, bits = np.concatenate([np.zeros((4, 0), dtype=np.int64), *found], axis=1)
        event, rule = np.nonzero(bits[:, None] >> np.arange(int(bits.max(initial=0)).bit_length()) & 1)
        at = starts[lane[event]]
        start, end = at + begin[event], at + end[event]
        order = np.lexsort((end, rule, start))
        start, end, rule = start[order], end[order], rule[order]
        last = np.append((start[1:] != start[:-1]) | (rule[1:] != rule[:-1]), True)[:len(order)]  # the region's farthest end
        start, end, rule = start[last], end[last], rule[last]
        return np.searchsorted(block.bounds, start, side="right") - 1, rule, start, end

    def _walk(self, data: bytes, lane: int) -> np.ndarray:
        """Rows lane, begin, end, bits of the accepting places of one lane."""
        table, flags = self._lists
        state = begin = 0
        events, last = [], None
        for at, c in enumerate(data, 1):
            state = table[state + c]
            if not state:
                begin = at
            elif flags[state]:
                if last and last[1] == begin and last[3] == flags[state]:
                    last[2] = at
                else:
                    last = [lane, begin, at, flags[state]]
                    events.append(last)
        return np.array(events, dtype=np.int64).reshape(-1, 4).T

    @cached_property
    def _lists(self) -> tuple[list, list]:
        return self.step.tolist(), self.accept.tolist()

    def _walk_lanes(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, first: int) -> np.ndarray:
        """The same of many lanes side by side, longest first."""
        step, accept = self.step, self.accept
        state, begin = np.zeros(len(starts), dtype=np.int32), np.zeros(len(starts), dtype=np.int32)
        alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right").tolist()  # lanes at least that long
        events = [np.zeros((4, 0), dtype=np.int64)]
        for t, k in enumerate(alive):
            s = step[state[:k] + data[starts[:k] + t]]
            state[:k] = s
            np.putmask(begin[:k], s == 0, t + 1)
            bits = accept[s]
            if bits.any():
                hit = np.flatnonzero(bits)
                events.append(np.stack([hit + first, begin[hit], np.full(len(hit), t + 1), bits[hit]]))
        return np.concatenate(events, axis=1)


def compile_rules(rules: list[str]) -> Scanner:
    nfa = _Nfa()
    root = nfa.state()
    final: dict[int, int] = {}
    for i, rule in enumerate(rules):
        start = nfa.state()
        nfa.free[root].append(start)
        end = nfa.add(_Regex(rule).tree, start)
        if end in nfa.closure([start]):
            raise ValueError(f"the empty string matches {rule!r}")
        final[end] = final.get(end, 0) | 1 << i
    # bytes that no rule tells apart are one class
    signature: dict[tuple, int] = {}
    sets = sorted({m for edges in nfa.on for m, _ in edges}, key=sorted)
    classes = np.array([signature.setdefault(tuple(b in m for m in sets), len(signature)) for b in range(256)])
    n_classes = len(signature)
    example = [int(np.flatnonzero(classes == c)[0]) for c in range(n_classes)]
    # subset construction, sets of states as bits of an integer; the root stays
    # in every subset, so that a match may begin anywhere
    reach = [sum(1 << t for t in nfa.closure([s])) for s in range(len(nfa.on))]
    move = [[0] * n_classes for _ in nfa.on]
    for s, edges in enumerate(nfa.on):
        for members, t in edges:
            for c in range(n_classes):
                if example[c] in members:
                    move[s][c] |= reach[t]
    first = reach[root]
    ids, todo, rows, accept = {first: 0}, [first], [], []
    for now in todo:  # grows
        inside = [s for s in range(now.bit_length()) if now >> s & 1]
        flags = 0
        for s in inside:
            flags |= final.get(s, 0)
        accept.append(flags)
        row = []
        for c in range(n_classes):
            nxt = first
            for s in inside:
                nxt |= move[s][c]
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            row.append(ids[nxt])
        rows.append(row)
    step, accept = np.array(rows), np.array(accept)
    # minimisation: split groups of states until their members agree on every class
    # (the start is alone in its group: in no other state is no match under way)
    group = np.unique(2 * accept + (np.arange(len(accept)) == 0), return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    n = group.max() + 1
    some = np.zeros(n, dtype=np.int64)
    some[group] = np.arange(len(group))
    name = np.empty(n, dtype=np.int64)  # the start becomes 0
    name[np.argsort(np.arange(n) != group[0], kind="stable")] = np.arange(n)
    small, flags = np.empty((n, n_classes), dtype=np.int64), np.empty(n, dtype=np.int64)
    small[name] = name[group[step[some]]]
    flags[name] = accept[some]
    return Scanner(classes, small, flags)
