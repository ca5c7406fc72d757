"""Byte-pair merging over a heap and a linked list, and the files of public vocabularies."""

from __future__ import annotations

import functools
import heapq
import json

_SHIFT = 20  # identifiers are below 2 ** 20

#: Unicode's White_Space characters, written out so that no engine's own idea of a space matters.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> list[str]:
    """The printable character that stands for each of the 256 bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in letters)
    letters.update({b: chr(256 + n) for n, b in enumerate(rest)})
    return [letters[b] for b in range(256)]


class BpeModel:
    """Vocabulary and merge ranks of a tokenizer file; ``suffix`` marks the last letter of a word, if the file has one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pairs: dict[int, int] = {}  # left and right identifier -> rank and merged identifier
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = self.vocab[left] << _SHIFT | self.vocab[right]
            self.pairs.setdefault(key, rank << _SHIFT | self.vocab[left + right])
        letters = byte_letters()
        self.first = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]

    def symbols(self, data: bytes, word_end: bool = True) -> list[int]:
        """One identifier for each byte; the last one is a word end if asked for."""
        first = self.first
        ids = [first[b] for b in data]
        if ids and word_end:
            ids[-1] = self.last[data[-1]]
        return ids

    def merge(self, ids: list[int]) -> int:
        """Merge in place, lowest rank first and leftmost among equals; merged-away places become -1. Returns the number of merges.

        Heap entries are never searched: an entry whose pair has changed since is skipped when popped. n symbols cost O(n log n).
        """
        n, pairs, merges = len(ids), self.pairs, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = pairs.get(ids[i] << _SHIFT | ids[i + 1])
            if found is not None:
                heap.append((found, i))
        heapq.heapify(heap)
        mask = (1 << _SHIFT) - 1
        while heap:
            found, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or pairs.get(ids[i] << _SHIFT | ids[j]) != found:
                continue
            ids[i], ids[j] = found & mask, -1
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (right := pairs.get(ids[i] << _SHIFT | ids[k])) is not None:
                    heapq.heappush(heap, (right, i))
            if (h := before[i]) >= 0 and (left := pairs.get(ids[h] << _SHIFT | ids[i])) is not None:
                heapq.heappush(heap, (left, h))
        return merges


@functools.lru_cache(maxsize=4)
def load(path: str) -> BpeModel:
    return BpeModel(path)


IDLE = 100_000  # entries that a worker keeps between tasks


class BoundedMemo(dict):
    """A memo of a function of words. Long words are computed anew; ``trim`` between batches empties a memo that has grown too large."""

    def __init__(self, function, most: int = 400_000, longest: int = 48):
        super().__init__()
        self.function, self.most, self.longest = function, most, longest

    def __missing__(self, word):
        value = self.function(word)
        if len(word) <= self.longest:
            self[word] = value
        return value

    def trim(self, most: int | None = None) -> None:
        if len(self) > (self.most if most is None else most):
            self.clear()
