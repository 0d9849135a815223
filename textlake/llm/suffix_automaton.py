"""Suffix automata of sets of words over integers."""

from __future__ import annotations


class SuffixAutomaton:
    """Generalised, of a set of words over integers below 1 << bits. State 0 is the empty string.

    Each state stands for substrings that are suffixes of one another. `matches` has, longest first, the members of the
    set that are suffixes of its longest string: (length, name).
    """

    def __init__(self, words: list[tuple[int, ...]], names: list[int], bits: int = 9):
        nexts: list[dict[int, int]] = [{}]
        length, link = [0], [-1]
        for word in words:
            last = 0
            for c in word:
                last = self._extend(nexts, length, link, last, c)
        found: dict[int, list[tuple[int, int]]] = {}
        for word, name in zip(words, names, strict=True):
            state = 0
            for c in word:
                state = nexts[state][c]
            found.setdefault(state, []).append((len(word), name))
        matches: list[tuple] = [()] * len(link)
        for s in sorted(range(1, len(link)), key=length.__getitem__):
            own = found.get(s)
            matches[s] = (*sorted(own, reverse=True), *matches[link[s]]) if own else matches[link[s]]
        self.step = {s << bits | c: t for s, n in enumerate(nexts) for c, t in n.items()}
        self.length, self.link, self.matches = length, link, matches

    @staticmethod
    def _extend(nexts, length, link, last, c) -> int:
        def split(p: int, q: int) -> int:
            """A copy of q for the strings up to p's length and one."""
            clone = len(length)
            nexts.append(nexts[q].copy())
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = clone
            while p >= 0 and nexts[p].get(c) == q:
                nexts[p][c] = clone
                p = link[p]
            return clone

        q = nexts[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else split(last, q)
        new, p = len(length), last
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new
