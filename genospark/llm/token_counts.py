"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as one symbol per UTF-8 byte; each merge removes one symbol, so the count is the initial symbols minus the
merges and no identifiers are written anywhere. Pieces repeat, so each Python worker keeps a bounded memo of piece -> count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospark.llm.bpe import IDLE, WHITE_SPACE, BoundedMemo, load

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pattern that cuts text before merging, as byte-level vocabularies of this family define it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _explicit_spaces(pattern: str) -> str:
    return pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")


class TokenCounter:
    """Counts tokens of whole texts. Strings of special tokens inside a text count as one token each."""

    def __init__(self, path: str):
        model = load(path)
        self.pieces = regex.compile(_explicit_spaces(PIECES)).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(model.special, key=len, reverse=True)))) if model.special else None
        self.marks = tuple(model.special)

        def count(piece: str) -> int:
            ids = model.symbols(piece.encode("utf-8"))
            return len(ids) - model.merge(ids)

        self.memo = BoundedMemo(count)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get = self.memo.__getitem__
        if not any(mark in text for mark in self.marks):
            return sum(map(get, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(get, self.pieces(part))) for part in parts)


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_count(text: Column | str, path: str) -> Column:
    """A long column: tokens of each whole text under the vocabulary file at ``path`` (null and empty text: 0)."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")
            counter.memo.trim()
        counter.memo.trim(IDLE)

    return counted(text)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """All rows and columns of ``df`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``), which replace columns of those names.

    Null text is the empty text: 0 bytes, 0 tokens. Texts of any length are read whole. Repeated rows stay; an empty table gives one.
    """
    return df.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(df[text]), F.lit(0)).cast("long"), "n_tokens": token_count(df[text], path)}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
