"""Dictionary search in sequences: a few words as plain containment tests, many by an automaton in Arrow batches."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FEW = 64


def contains_motif(seq: Column, motifs: Sequence[str]) -> Column:
    """Whether any of the words occurs, case kept."""
    words = sorted({m for m in motifs if m})
    if not words:
        return F.lit(False)
    if len(words) <= FEW:
        return functools.reduce(operator.or_, [F.coalesce(seq.contains(w), F.lit(False)) for w in words])
    return _automaton_test(tuple(words))(seq)


@functools.lru_cache(maxsize=8)
def _automaton(words: tuple[str, ...], fold: bool):
    import ahocorasick

    made = ahocorasick.Automaton()
    for w in words:
        w = w.lower() if fold else w
        made.add_word(w, w)
    made.make_automaton()
    return made


def _automaton_test(words: tuple[str, ...]):
    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(words, False)
        for texts in batches:
            yield pd.Series([t is not None and next(automaton.iter(t), None) is not None for t in texts], dtype=bool)

    return test


def find(text: str, words: Sequence[str], ignore_case: bool = False, whole_words: bool = False, without_overlaps: bool = False) -> list[tuple[int, int, str]]:
    """Occurrences (start, end, word), end exclusive, by end. Of overlapping ones the longest stays, then the leftmost, if asked for."""
    own = tuple(sorted({w for w in words if w}))
    if not own:
        return []
    target = text.lower() if ignore_case else text
    hits = [(end + 1 - len(w), end + 1, w) for end, w in _automaton(own, ignore_case).iter(target)]
    if whole_words:
        letter = lambda i: 0 <= i < len(text) and text[i].isalpha()
        hits = [h for h in hits if not letter(h[0] - 1) and not letter(h[1])]
    if without_overlaps:
        kept: list[tuple[int, int, str]] = []
        for h in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
            if all(h[1] <= k[0] or h[0] >= k[1] for k in kept):
                kept.append(h)
        hits = kept
    return sorted(hits, key=lambda h: (h[1], h[0]))


def holds(text: str, words: Sequence[str], ignore_case: bool = False, whole_words: bool = False) -> bool:
    """Whether ``find`` finds anything; stops at the first occurrence and keeps none."""
    own = tuple(sorted({w for w in words if w}))
    if not own:
        return False
    letter = lambda i: 0 <= i < len(text) and text[i].isalpha()
    hits = _automaton(own, ignore_case).iter(text.lower() if ignore_case else text)
    return any(not whole_words or not letter(end - len(w)) and not letter(end + 1) for end, w in hits)


def holds_motif(text: Column, words: Sequence[str], ignore_case: bool = False, whole_words: bool = False) -> Column:
    """Whether a text holds any of the words, as ``motif_hits`` finds them; false for null."""
    own = tuple(words)

    @F.arrow_udf("boolean")
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([t.is_valid and holds(t.as_py(), own, ignore_case, whole_words) for t in texts], pa.bool_())  # one text at a time

    return held(text)


def tokens(text: str, words: Sequence[str], **options: bool) -> list[tuple[str, bool]]:
    """The text cut at its occurrences: (piece, whether it is one)."""
    out, at = [], 0
    for start, end, _ in sorted(find(text, words, without_overlaps=True, **options)):
        if start > at:
            out.append((text[at:start], False))
        out.append((text[start:end], True))
        at = end
    return out + ([(text[at:], False)] if at < len(text) else [])


def motif_hits(text: Column, words: Sequence[str], ignore_case: bool = False, whole_words: bool = False, without_overlaps: bool = False) -> Column:
    """array<struct<start, end, word>> of ``find`` for each text."""
    own = tuple(words)

    @F.pandas_udf("array<struct<start:int,end:int,word:string>>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("start", "end", "word"), h)) for h in find(t or "", own, ignore_case, whole_words, without_overlaps)] for t in texts])

    return hits(text)
