"""What a task remembers of words it has met, bounded in bytes; it ends with the task."""

from __future__ import annotations

from collections.abc import Iterable

LIMIT = 24 << 20  # bytes of a table
EACH = 200  # bytes of an entry besides its word and value


class Held:
    """Values of words in two tables. When the newer one is over its bytes it takes the older one's place, and words in use move to a new one.

    So at most two tables and the words of one call are held, whatever the input; what is forgotten is made again when it comes again.
    """

    def __init__(self, limit: int = LIMIT):
        self.limit, self.size = limit, 0
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def turn(self) -> None:
        """Make room; to be called before the words of a new call are asked for."""
        if self.size > self.limit:
            self.before, self.now, self.size = self.now, {}, 0

    def unknown(self, words: Iterable[str]) -> set[str]:
        """Those of the words that neither table has; words of the older table move to the newer."""
        new = set(words).difference(self.now)
        again = {w: self.before[w] for w in new if w in self.before}
        self.add(again)
        return new.difference(again)

    def add(self, values: dict[str, bytes]) -> None:
        self.now.update(values)
        self.size += sum(map(len, values)) + sum(map(len, values.values())) + EACH * len(values)
