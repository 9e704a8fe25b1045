"""Small deterministic weighted transducers over symbols, and their composition.

Weights add along a path. They are numbers, or vectors where what a path would weigh is still to be learned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Transducer:
    """step(state, symbol) gives (state, output symbol, weight); states are hashable, the first is `start`."""

    step: Callable[[Any, str], tuple[Any, str, Any]]
    start: Any = 0
    arcs: dict = field(default_factory=dict)

    def go(self, state, symbol: str) -> tuple[Any, str, Any]:
        """One arc, built when it is first needed."""
        key = (state, symbol)
        if key not in self.arcs:
            self.arcs[key] = self.step(state, symbol)
        return self.arcs[key]

    def then(self, other: Transducer) -> Transducer:
        """The composition: the other reads what this one writes."""

        def step(state, symbol):
            a, out, w = self.go(state[0], symbol)
            b, out, v = other.go(state[1], out)
            return (a, b), out, w + v

        return Transducer(step, (self.start, other.start))

    def run(self, symbols: Iterable[str]) -> list[tuple[str, Any]]:
        state, out = self.start, []
        for symbol in symbols:
            state, written, weight = self.go(state, symbol)
            out.append((written, weight))
        return out


def lexicon(entries: Mapping[str, tuple[str, Any]]) -> Transducer:
    """Rewrites its entries, each with a weight; other symbols pass."""

    def step(state, symbol):
        out, weight = entries.get(symbol, (symbol, 0.0))
        return 0, out, weight

    return Transducer(step, 0)


def scope(opener: str, marks: Mapping[str, str], reach: int, weight: Any = 0.0, closer: str = "") -> Transducer:
    """Within `reach` symbols after an opener, symbols in `marks` are rewritten and gain the weight; one of the closers (characters),
    or END, ends the scope."""

    def step(left, symbol):
        if symbol == opener:
            return reach, symbol, 0.0
        if symbol == "END" or (symbol and symbol in closer):
            return 0, symbol, 0.0
        if left and symbol in marks:
            return left - 1, marks[symbol], weight
        return max(0, left - 1), symbol, 0.0

    return Transducer(step, 0)
