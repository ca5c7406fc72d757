"""BPE encoding and decoding by forced boundaries.

Two neighbouring bytes that stand side by side in no token of the vocabulary can never end up in one token, so every such place is a
certain cut. A word is split at its certain cuts, each fragment is merged on its own, and the identifiers are concatenated.
"""

from __future__ import annotations

import array
import functools
import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospark.llm.bpe import IDLE, WHITE_SPACE, BoundedMemo, byte_letters, load

VOCABULARY = "word_bpe_49k.json"
#: Fixed value: what the vocabulary's own definition keeps of a normalised text; all else is dropped.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+"


class BpeCodec:
    """Encodes whole texts to identifiers and joins the tokens of identifiers again."""

    def __init__(self, path: str):
        self.model = model = load(path)
        self.words = regex.compile(WORDS).findall
        self.spaces = regex.compile(f"[{WHITE_SPACE}]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(model.special, key=len, reverse=True))) + ")")
        self.tokens = {i: t for t, i in (model.vocab | model.special).items()}
        of_letter = {c: b for b, c in enumerate(byte_letters())}
        self.inside = bytearray(65536)  # 1 where some token has these two bytes side by side
        for token in model.vocab:
            data = [of_letter[c] for c in token.removesuffix(model.suffix)]
            for a, b in zip(data, data[1:]):
                self.inside[a << 8 | b] = 1
        self.memo = BoundedMemo(self._word)

    def fragments(self, data: bytes) -> list[bytes]:
        """``data`` split at every certain cut."""
        inside, start, out = self.inside, 0, []
        for i in range(1, len(data)):
            if not inside[data[i - 1] << 8 | data[i]]:
                out.append(data[start:i])
                start = i
        out.append(data[start:])
        return out

    def encode_word(self, word: str) -> list[int]:
        model, ids = self.model, []
        pieces = self.fragments(word.encode("utf-8"))
        for n, piece in enumerate(pieces):
            part = model.symbols(piece, word_end=n == len(pieces) - 1)
            if len(part) > 1 and model.merge(part):
                part = [i for i in part if i >= 0]
            ids += part
        return ids

    def _word(self, word: str) -> tuple[int, bytes, str]:
        ids = [self.model.special[word]] if word in self.model.special else self.encode_word(word)
        packed = array.array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return len(ids), packed.tobytes(), self.decode(ids)

    def normalise(self, text: str) -> str:
        return self.spaces.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()  # no word-final sigma

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token's string is a word of its own, found before normalising."""
        if "<|" not in text:
            return self.words(self.normalise(text))
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.model.special else self.words(self.normalise(part))
        return out

    def packed(self, text: str | None) -> bytes:
        """The identifiers as little-endian unsigned 32-bit integers."""
        return b"".join([self.memo[word][1] for word in self.split(text or "")])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens of ``ids`` joined by blanks: the vocabulary names no decoder, so this is its decoded form. Unknown ids give nothing."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as little-endian unsigned 32-bit integers, SHA-256 of the decoded text."""
        found = list(map(self.memo.__getitem__, self.split(text or "")))
        packed = b"".join([f[1] for f in found])
        decoded = " ".join([f[2] for f in found])
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def encoded(text: Column | str, path: str) -> Column:
    """An array<int> column: the identifiers of each whole text (null and empty text: an empty array)."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for texts in batches:
            yield pd.Series([np.frombuffer(own.packed(t), "<i4") for t in texts], dtype=object)
            own.memo.trim()
        own.memo.trim(IDLE)

    return ids(text)


def decoded(ids: Column | str, path: str) -> Column:
    """A string column: the decoded text of each array of identifiers (null and empty arrays: the empty text)."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for rows in batches:
            yield pd.Series([own.decode([] if r is None else [int(i) for i in r]) for r in rows], dtype=object)

    return texts(ids)


def encode_digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with n_tokens, ids_sha256 and decoded_sha256, which replace columns of those names.

    Encodes and decodes each whole text in one pass, so identifiers never leave the worker. Null text is the empty text. Repeated rows
    stay; an empty table gives an empty one.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for texts in batches:
            yield pd.DataFrame([own.digests(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            own.memo.trim()
        own.memo.trim(IDLE)

    digests = digests.asNondeterministic()  # one evaluation for the three columns, whatever is asked of them
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    kept = [df[c] for c in df.columns if c not in names]
    return df.select(*kept, digests(df[text]).alias("__digests")).select(*[F.col(c) for c in df.columns if c not in names], *[F.col(f"__digests.{c}").alias(c) for c in names])
