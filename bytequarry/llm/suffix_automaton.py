"""A suffix automaton over word hashes, for matching statistics."""

from __future__ import annotations


class SuffixAutomaton:
    """Grows word by word; knows every sequence of words inside one added span."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.len: list[int] = [0]
        self.last = 0
        self._ends = 0

    def _extend(self, word: int) -> int:
        """Add a word at the end; the length of the longest suffix that also ends earlier."""
        nxt, link, length = self.next, self.link, self.len
        cur = len(length)
        length.append(length[self.last] + 1)
        nxt.append({})
        link.append(0)
        p = self.last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        return length[link[cur]]

    def add(self, words: list[int]) -> list[int]:
        """Add a span; for each of its words the length of the longest sequence ending there that also ends earlier, here or in a span added before."""
        if self.last:
            self._ends -= 1  # hashes of words are not negative
            self._extend(self._ends)
        return [self._extend(w) for w in words]

    def match(self, words: list[int]) -> list[int]:
        """Matching statistics: for each word the length of the longest sequence ending there that some added span holds."""
        nxt, link, length = self.next, self.link, self.len
        state, n, out = 0, 0, []
        for w in words:
            step = nxt[state].get(w)
            while step is None and state:
                state = link[state]
                n = length[state]
                step = nxt[state].get(w)
            if step is not None:
                state, n = step, n + 1
            out.append(n)
        return out
