"""A trie of reference entries searched with a Levenshtein automaton."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class LevenshteinAutomaton:
    """The universal automaton for one distance, built lazily.

    A state is a set of positions (offset from the base, errors so far, phase), kept without subsumed ones; a transition
    depends only on which of the next letters of the query equal the letter read. Transitions are therefore shared by all
    queries and kept.

    ``exchange``: one exchange of neighbouring letters counts as one error. A position is then in phase 0 before the
    exchange, 1 in the middle of it and 2 behind it.
    """

    def __init__(self, distance: int, exchange: bool = False) -> None:
        self.k, self.exchange = distance, exchange
        self.moves: dict[tuple, tuple] = {}
        self.start = ((0, 0, 0),)

    def step(self, state: tuple, bits: int, left: int) -> tuple:
        """The state after a letter; ``bits``: where it equals the query from the state's base; ``left``: letters left there."""
        key = (state, bits, min(left, 3 * self.k + 4))
        found = self.moves.get(key)
        if found is None:
            found = self.moves[key] = self._step(state, bits, left)
        return found

    def _step(self, state: tuple, bits: int, left: int) -> tuple:
        k, reached = self.k, set()
        for i, e, phase in state:
            if phase == 1:
                if i < left and bits >> i & 1:
                    reached.add((i + 2, e, 2))
                continue
            if self.exchange and phase == 0:  # letters of the query may be missing before the exchange
                reached |= {(i + skip, e + skip + 1, 1) for skip in range(k - e) if i + skip + 1 < left and bits >> (i + skip + 1) & 1 and not bits >> (i + skip) & 1}
            if i < left and bits >> i & 1:
                reached.add((i + 1, e, phase))
                continue
            if e < k:
                reached.add((i, e + 1, phase))  # the letter is extra
                if i < left:
                    reached.add((i + 1, e + 1, phase))  # the letter replaces one
                for skip in range(1, k - e + 1):  # letters of the query are missing
                    if i + skip < left and bits >> (i + skip) & 1:
                        reached.add((i + skip + 1, e + skip, phase))
                        break
        # a position in phase 0 can do whatever one in phase 2 can
        return tuple(sorted((i, e, p) for i, e, p in reached if p == 1 or not any(((q == p or q == 0) and f < e and abs(i - j) <= e - f) or (q == 0 and p == 2 and (j, f) == (i, e)) for j, f, q in reached)))

    def errors_at_end(self, state: tuple, left: int) -> int:
        """The least errors with which the query ends in this state; more than k if it doesn't."""
        return min([e + left - i for i, e, phase in state if phase != 1], default=self.k + 1)


_AUTOMATA: dict[tuple[int, bool], LevenshteinAutomaton] = {}


def automaton(distance: int, exchange: bool = False) -> LevenshteinAutomaton:
    found = _AUTOMATA.get((distance, exchange))
    return found or _AUTOMATA.setdefault((distance, exchange), LevenshteinAutomaton(distance, exchange))


class Trie:
    """Entries by their spellings; several spellings (aliases) may lead to one entry and one spelling to several."""

    def __init__(self, spellings: Iterable[tuple[str, Hashable]] = ()) -> None:
        self.root: dict = {}
        self.longest = 0
        for spelling, entry in spellings:
            self.add(spelling, entry)

    def add(self, spelling: str, entry: Hashable) -> None:
        node = self.root
        self.longest = max(self.longest, len(spelling))
        for c in spelling:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(entry)

    def _walk(self, query: str, a: LevenshteinAutomaton):
        """(entries, state, base) of every spelling that the automaton doesn't reject; the base is added to positions."""
        where: dict[str, int] = {}
        for i, c in enumerate(query):
            where[c] = where.get(c, 0) | 1 << i
        n, wide = len(query), (1 << 3 * a.k + 5) - 1
        todo = [(self.root, a.start, 0)]
        while todo:
            node, state, base = todo.pop()
            for c, below in node.items():
                if not c:
                    yield below, state, base
                    continue
                after = a.step(state, where.get(c, 0) >> base & wide, n - base)
                if after:
                    shift = after[0][0]
                    todo.append((below, tuple([(i - shift, e, p) for i, e, p in after]) if shift else after, base + shift))

    def search(self, query: str, distance: int, exchange: bool = False) -> dict[Hashable, int]:
        """All entries with a spelling within ``distance`` of the query, each with its least distance; ``exchange``: one
        exchange of neighbouring letters counts as one error."""
        if len(query) > self.longest + distance:
            return {}
        a, n, found = automaton(distance, exchange), len(query), {}
        for entries, state, base in self._walk(query, a):
            errors = a.errors_at_end(state, n - base)
            if errors <= distance:
                for x in entries:
                    found[x] = min(errors, found.get(x, errors))
        return found

    def prefixes(self, query: str, distance: int) -> list[tuple[int, int, Hashable]]:
        """(errors, length, entry) for all entries with a spelling within ``distance`` of a prefix of the query.

        The length is that of the prefix with the fewest errors; of equals, the one nearest to the spelling's own length.
        """
        found: dict[Hashable, tuple[int, int]] = {}
        for entries, state, base in self._walk(query[: self.longest + distance], automaton(distance)):
            errors, at = min((e, -i) for i, e, _ in state)
            for x in entries:
                best = (errors, base - at)
                if x not in found or best < found[x]:
                    found[x] = best
        return sorted((e, n, x) for x, (e, n) in found.items())


def allowed_distance(length: int) -> int:
    """How many errors a spelling of some length may have: none up to 3 letters, one up to 7, two up to 11, then three."""
    return 0 if length <= 3 else 1 if length <= 7 else 2 if length <= 11 else 3
