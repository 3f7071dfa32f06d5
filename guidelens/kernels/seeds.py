"""Which windows a read can observe at all: those that have a seed in it.

A window is placed in a read by an exact seed only: its guide on either strand, its
first or its last bases. So an index of all seeds by length, looked up with the read's
own substrings, names every window that can be found, at a cost that depends on the
read and not on the number of windows; any other window lacks a seed, which needs no search.
"""

from __future__ import annotations

from ..config import ANCHOR
from .cutsite import Window
from .matching import reverse_complement


class SeedIndex:
    def __init__(self, windows: list[Window]) -> None:
        self.by_length: dict[int, dict[str, list[int]]] = {}
        always = set()
        for w in windows:
            guides = [g for g in (w.guide, reverse_complement(w.guide)) if g and g in w.ref]
            for seed in (*guides, w.ref[:ANCHOR], w.ref[-ANCHOR:]):
                if not seed or seed.strip("ACGT"):  # other letters have no exact complement
                    always.add(w.number)
                    continue
                for text in (seed, reverse_complement(seed)):
                    found = self.by_length.setdefault(len(text), {}).setdefault(text, [])
                    if w.number not in found[-1:]:
                        found.append(w.number)
        self.always = frozenset(always)

    def __call__(self, stretches: list[str]) -> list[int]:
        """Numbers of the windows with a seed in any of a read's stretches, rising."""
        found = set(self.always)
        for n, table in self.by_length.items():
            for text in stretches:
                for at in range(len(text) - n + 1):
                    if (hit := table.get(text[at : at + n])) is not None:
                        found.update(hit)
        return sorted(found)
