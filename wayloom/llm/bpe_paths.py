"""Byte-pair vocabularies as weighted transducers.

A sequence of tokens is the byte-pair encoding of a string exactly if each
token encodes to itself and each two neighbours, joined, encode to just those
two. So the encoding is the path of finite weight in a transducer whose states
are (position, last token) and whose arcs weigh 0 where neighbours agree and
infinity where they don't. Each prefix has one such path, so the transducer is
deterministic when built from left to right: one last token a position. With
weights of 0 and infinity alone any finite path is a shortest one in the tropical
semiring, so its relaxation stops at the first finite arc into a state.

Cases: an empty string has the empty path; strings of any length have one, as all
single symbols are tokens.
"""

from __future__ import annotations

NEVER = 1 << 60
SHARED = 40  # code points of a word whose prefixes are remembered


class MergeTable:
    """rank(a, b) is the rank of the merge of two adjacent tokens, or NEVER; lower ranks merge first, ties from the left."""

    def __init__(self, symbols, made_at: dict, ties=frozenset()):
        self.symbols = symbols  # token -> list of its initial symbols
        self.made_at = made_at  # token -> rank of the merge that makes it; initial symbols are missing
        self.ties = ties  # tokens whose merges share a rank
        self.halves: dict = {}

    def rank(self, a, b) -> int:
        raise NotImplementedError

    def join(self, a, b):
        return a + b

    def merged(self, tokens: list) -> tuple[list, tuple | None]:
        """Plain byte-pair merging, and the halves of the last merge."""
        tokens, last = list(tokens), None
        while len(tokens) > 1:
            best, at = min((self.rank(tokens[i], tokens[i + 1]), i) for i in range(len(tokens) - 1))
            if best >= NEVER:
                break
            last = (tokens[at], tokens[at + 1])
            tokens[at : at + 2] = [self.join(*last)]
        return tokens, last

    def split(self, token):
        """The two halves whose merge makes the token, or None."""
        if token not in self.halves:
            self.halves[token] = self.merged(self.symbols(token))[1]
        return self.halves[token]

    def agree(self, a, b) -> bool:
        """Whether the two tokens stay apart when their strings stand side by side."""
        if a in self.ties or b in self.ties:
            return self.merged(self.symbols(a) + self.symbols(b))[0] == [a, b]
        return self._apart(a, b)

    def _apart(self, a, b) -> bool:
        """Undo merges on both sides of the border, latest first; a merge across it that comes in time breaks the pair.

        A merge across the border that ties with the next one on the left loses, and wins against one on the right.
        """
        bound, rank, own, halves = NEVER, self.rank, self.made_at, self.halves
        while True:
            if rank(a, b) < bound:
                return False
            left, right = own.get(a, -1), own.get(b, -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                bound, a = left, (halves.get(a) or self.split(a))[1]
            else:
                bound, b = right + 1, (halves.get(b) or self.split(b))[0]


class PathFinder:
    """Finds the path; remembers, in bounded sets, which pairs of tokens agree."""

    def __init__(self, merges: MergeTable, tokens, longest: int, limit: int = 300_000):
        # a token that doesn't encode to itself is on no path
        self.tokens = {t for t in tokens if len(s := merges.symbols(t)) == 1 or merges.merged(s)[0] == [t]}
        self.merges, self.longest, self.limit = merges, longest, limit
        self.good: set = set()
        self.bad: set = set()
        self.known: dict = {}

    def agree(self, pair) -> bool:
        return pair in self.good or pair not in self.bad and self._agree(pair)

    def _agree(self, pair) -> bool:
        found = self.merges.agree(*pair)
        held = self.good if found else self.bad
        if len(held) >= self.limit:
            held.clear()
        held.add(pair)
        return found

    def path(self, word: str) -> list:
        """The tokens on the one finite path over word.

        Short words share their prefixes' states in one table, which is emptied
        when it is full; a long word has a list of its own.
        """
        return self._shared(word) if len(word) <= SHARED else self._alone(word)

    def _shared(self, word: str) -> list:
        known, tokens, good, bad, longest = self.known, self.tokens, self.good, self.bad, self.longest
        if len(known) >= 2 * self.limit:
            known.clear()
        n = k = len(word)
        while k and word[:k] not in known:
            k -= 1
        for j in range(k + 1, n + 1):
            state = None
            for i in range(j - 1, max(-1, j - longest - 1), -1):
                piece = word[i:j]
                if piece in tokens:
                    if i == 0:
                        state = piece
                        break
                    pair = (known[word[:i]], piece)
                    if pair in good or pair not in bad and pair[0] is not None and self._agree(pair):
                        state = piece
                        break
            known[word[:j]] = state
        out = []
        while n:
            token = known[word[:n]]
            out.append(token)
            n -= len(token)
        out.reverse()
        return out

    def _alone(self, word: str) -> list:
        tokens, longest, last = self.tokens, self.longest, [None]
        for j in range(1, len(word) + 1):
            state = None
            for i in range(j - 1, max(-1, j - longest - 1), -1):
                piece = word[i:j]
                if piece in tokens and (i == 0 or last[i] is not None and ((pair := (last[i], piece)) in self.good or pair not in self.bad and self._agree(pair))):
                    state = piece
                    break
            last.append(state)
        out, j = [], len(word)
        while j:
            out.append(last[j])
            j -= len(last[j])
        out.reverse()
        return out


class ScoredPaths:
    """Unigram pieces as a transducer of one state that accepts each piece at the cost of its negated score.

    Composed with a text it is a lattice of places, in which the tropical shortest
    path is found by relaxing the arcs of each place in turn. A code point that is no
    piece has an arc of its own at the highest cost. Costs are 32-bit numbers, and of
    equal ways the one found first stays: that with the earliest last arc.
    """

    STEP = 10.0  # by which a code point that is no piece costs more than the dearest piece

    def __init__(self, scores: dict[str, float]):
        import numpy as np

        self.number = np.float32
        self.unknown = self.number(-(np.float32(min(scores.values())) - np.float32(self.STEP)))
        self.trie: dict = {}
        for piece, score in scores.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = self.number(-score)

    def path(self, text: str) -> list[tuple[str, bool]]:
        """(piece, whether it is one) of each arc on the shortest path."""
        n = len(text)
        cost: list = [None] * (n + 1)
        back: list = [None] * (n + 1)
        cost[0] = self.number(0)
        for i in range(n):
            here, node, single = cost[i], self.trie, False
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    new = here + node[""]
                    if cost[j + 1] is None or new < cost[j + 1]:
                        cost[j + 1], back[j + 1] = new, (i, True)
                    single = single or j == i
            if not single:
                new = here + self.unknown
                if cost[i + 1] is None or new < cost[i + 1]:
                    cost[i + 1], back[i + 1] = new, (i, False)
        out, at = [], n
        while at:
            i, known = back[at]
            out.append((text[i:at], known))
            at = i
        return out[::-1]
