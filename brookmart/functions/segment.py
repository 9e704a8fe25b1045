"""Words of texts without spaces, by a given lexicon: every word at every place, and what no word covers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a lexicon that are sent to the tasks; a larger one is an error.
MOST_WORDS = 1_000_000


class Lexicon:
    """The finest cut of texts by an Aho-Corasick automaton of the words, which a worker builds once."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted({w.lower() for w in words if w})
        self._found = self._other = None

    def __getstate__(self) -> list[str]:
        return self.words

    def __setstate__(self, words: list[str]) -> None:
        self.words, self._found, self._other = words, None, None

    def _build(self) -> None:
        import ahocorasick
        import regex

        self._found = ahocorasick.Automaton()
        for w in self.words:
            self._found.add_word(w, len(w))
        if self.words:
            self._found.make_automaton()
        self._other = regex.compile(r"(?V1)\p{Han}|[[\p{L}\p{N}]--\p{Han}]+")

    def cut(self, text: str | None) -> list[str]:
        """Words in lower case in the order of their places, the longer first; then stretches that no word covers: a Han
        character is one of its own, other letters and digits are runs."""
        if not text:
            return []
        if self._found is None:
            self._build()
        text = text.lower()
        places = [(end - n + 1, -n) for end, n in self._found.iter(text)] if self.words else []
        covered = bytearray(len(text))
        for at, n in places:
            covered[at : at - n] = b"\x01" * -n
        left = "".join(" " if c else x for x, c in zip(text, covered, strict=True))
        places += [(m.start(), m.start() - m.end()) for m in self._other.finditer(left)]
        return [text[at : at - n] for at, n in sorted(places)]


def lexicon_words(words: DataFrame | Iterable[str]) -> Callable[[Column], Column]:
    """A function from a string column to its words, for plans.stats.keyword_stats. words: the lexicon (a column, or strings),
    of at most MOST_WORDS words, which go to the tasks. Null and empty texts have no words."""
    if isinstance(words, DataFrame):
        words = [r[0] for r in words.distinct().limit(MOST_WORDS + 1).collect()]
    found = Lexicon(words)
    if len(found.words) > MOST_WORDS:
        raise ValueError(f"a lexicon of more than {MOST_WORDS} words")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(found.cut, na_action=None)

    return cut
