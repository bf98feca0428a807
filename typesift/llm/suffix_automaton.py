"""A generalised suffix automaton over the words of many items."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """Longest matches of a word stream against all items at once.

    After ``build``, ``scan`` streams word ids and yields, for each position
    where a window ends, the window's length and the items it occurs in.  A
    window is ``k`` consecutive words of an item, or a whole shorter item.
    """

    def __init__(self, k: int):
        self.k = k
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:  # known from an earlier item
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def build(self, items: Iterable[tuple[str, list[int]]]) -> SuffixAutomaton:
        """items: (name, word ids); those without words are skipped."""
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        k, link, length = self.k, self.link, self.len
        order = sorted(range(len(link)), key=length.__getitem__)
        #: the state whose shortest string has at most, and longest at least, k words
        self.window = [-1] * len(link)
        for v in order[1:]:
            if length[v] >= k:
                self.window[v] = v if length[link[v]] < k else self.window[link[v]]
        whole: dict[int, list[tuple[int, str]]] = {}
        found: dict[int, set[str]] = {}
        for name, words in items:
            v = 0
            for w in words:
                v = self.next[v][w]
                if self.window[v] >= 0:
                    found.setdefault(self.window[v], set()).add(name)
            if len(words) < k:
                whole.setdefault(v, []).append((len(words), name))
        self.items = {v: tuple(sorted(s)) for v, s in found.items()}
        self.whole = {v: tuple(sorted(s)) for v, s in whole.items()}
        #: nearest state on the suffix chain, itself included, that ends a short item
        self.short = [-1] * len(link)
        for v in order[1:]:
            self.short[v] = v if v in whole else self.short[link[v]]
        return self

    def scan(self, words: list[int]):
        """(position of the last word, window length, items) for every window that ends there."""
        nxt, link, length, k = self.next, self.link, self.len, self.k
        window, short = self.window, self.short
        v = matched = 0
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                matched = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                matched += 1
            if matched >= k:
                yield i, k, self.items[window[v]]
            s = short[v]
            while s > 0:
                for n, name in self.whole[s]:
                    if n <= matched:
                        yield i, n, (name,)
                s = short[link[s]]
