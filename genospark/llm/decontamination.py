"""Benchmark decontamination by the q-gram lemma.

Texts and passages are compared as lower-case UTF-8 bytes in which ASCII punctuation and white space are single blanks. A passage of m
bytes that occurs in a text with at most k edits shares at least m - q + 1 - k * q of its q-grams with it, on diagonals (text position
minus passage position) that lie within k of each other. Shared q-grams are counted in overlapping bands of diagonals; bands that meet
the bound are kept, and banded alignment of passage and region tells the true number of edits. Passages under q bytes, which have no
q-gram, are looked for as whole words without edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.llm.storage import Scratch

Q = 8  # bytes to a q-gram, so that a gram is exactly one 64-bit number
BUDGET = 0.10  # edits allowed, as a share of the passage's bytes
BLOCK_BYTES = 32 << 20  # passages on the driver and the executors at a time
_BITS = 22
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalise(text: str | None) -> bytes:
    """Lower-case UTF-8 with each run of ASCII punctuation and white space as one blank."""
    return b" ".join(text.lower().encode("utf-8").translate(_FOLD).split()) if text else b""


def characters(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where spans of bytes of the normalised text begin and end in the text itself, in characters."""
    place, blank = [], True  # the character that each byte of the normalised text came from
    for at, letter in enumerate(text):
        for byte in letter.lower().encode("utf-8").translate(_FOLD):
            if byte != 32 or not blank:
                place.append(at)
            blank = byte == 32
    return [(place[a], place[b - 1] + 1) for a, b in spans]


def grams(data: bytes) -> np.ndarray:
    """The q-gram at each position, as a number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.frombuffer(data + b"\0" * (2 * Q), np.uint8)
    out = np.empty((-(-n // Q), Q), np.uint64)
    for s in range(Q):
        out[:, s] = padded[s : s + len(out) * Q].view("<u8")
    return out.reshape(-1)[:n]


def _slots(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


def edit_budget(length: int) -> int:
    """Edits allowed for a passage of ``length`` bytes: BUDGET of it, or fewer where the lemma would promise no shared q-gram."""
    return max(0, min(int(BUDGET * length), (length - Q) // Q))


def banded_alignment(passage: np.ndarray, region: np.ndarray, first: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits between the whole passage and a part of ``region``: (edits, start, end), or None beyond ``most``.

    Cell x of a row stands for the diagonal ``first`` + x; ``width`` diagonals are kept. Either end of the region is free.
    """
    far = most + 1
    lane = np.arange(width)
    n = len(region)
    start = np.clip(lane + first, 0, n)
    cost = np.where((lane + first >= 0) & (lane + first <= n), 0, far)
    for j, letter in enumerate(passage):
        at = j + first + lane  # region position of the letter on each diagonal
        inside = (at >= 0) & (at < n)
        match = np.zeros(width, bool)
        match[inside] = region[at[inside]] == letter
        step = np.where(inside, cost + ~match, far)
        drop, drop_start = np.append(cost[1:], far) + 1, np.append(start[1:], 0)  # the letter is missing in the region
        drop = np.where((at + 1 >= 0) & (at < n), drop, far) if first < 0 else np.where(at < n, drop, far)
        better = drop < step
        new, begin = np.where(better, drop, step), np.where(better, drop_start, start)
        ramp = new - lane  # letters of the region that the passage lacks: from the left, one edit each
        low = np.minimum.accumulate(ramp)
        source = np.maximum.accumulate(np.where(ramp == low, lane, 0))
        filled = low + lane
        begin = np.where(filled < new, begin[source], begin)
        new = np.minimum(filled, new)
        cost, start = np.minimum(new, far), begin
        if cost.min() > most:
            return None
    best = int(cost.argmin())
    return int(cost[best]), int(start[best]), int(np.clip(len(passage) + first + best, 0, n))


class PassageIndex:
    """The q-grams of a bounded block of passages."""

    def __init__(self, items: list[tuple[int, str | None]]):
        found = [(i, normalise(t)) for i, t in items]
        self.short: dict[tuple[bytes, ...], list[int]] = {}  # the words of a passage without q-grams
        for i, d in found:
            if 0 < len(d) < Q:
                self.short.setdefault(tuple(d.split()), []).append(i)
        self.items = [(i, d) for i, d in found if len(d) >= Q]
        self.arrays = [np.frombuffer(d, np.uint8) for _, d in self.items]
        lengths = np.array([len(d) for _, d in self.items], np.int64)
        self.budget = np.array([edit_budget(n) for n in lengths], np.int64)
        self.needed = np.maximum(1, lengths - Q + 1 - self.budget * Q)
        self.offset = int(lengths.max(initial=0))
        all_grams = [grams(d) for _, d in self.items]
        values = np.concatenate([*all_grams, np.zeros(0, np.uint64)])
        item = np.concatenate([*(np.full(len(g), k, np.int64) for k, g in enumerate(all_grams)), np.zeros(0, np.int64)])
        place = np.concatenate([*(np.arange(len(g), dtype=np.int64) for g in all_grams), np.zeros(0, np.int64)])
        order = np.argsort(values, kind="stable")
        self.item, self.place = item[order], place[order]
        self.values, self.at, self.many = np.unique(values[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[_slots(self.values)] = True

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of the best occurrence of each passage found; positions are bytes of the normalised text."""
        if not text or not (data := normalise(text)):
            return []
        return sorted(self._short(data) + (self._long(data) if self.items and len(data) >= Q else []))

    def _short(self, data: bytes) -> list[tuple[int, int, int, int]]:
        if not self.short:
            return []
        words = data.split()
        start = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
        best: dict[int, tuple[int, int]] = {}
        for size in {len(k) for k in self.short}:
            for at in range(len(words) - size + 1):
                for i in self.short.get(tuple(words[at : at + size]), ()):
                    best.setdefault(i, (start[at], start[at + size] - 1))
        return [(i, a, b, 0) for i, (a, b) in best.items()]

    def _long(self, data: bytes) -> list[tuple[int, int, int, int]]:
        own = grams(data)
        where = np.flatnonzero(self.seen[_slots(own)])
        if not len(where):
            return []
        slot = np.minimum(np.searchsorted(self.values, own[where]), len(self.values) - 1)
        true = self.values[slot] == own[where]
        where, slot = where[true], slot[true]
        many = self.many[slot]
        flat = np.repeat(self.at[slot] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        item, place, where = self.item[flat], self.place[flat], np.repeat(where, many)
        # cells one budget wide, bands two cells wide: any k + 1 neighbouring diagonals lie in one band
        cell = (where - place + self.offset) // (self.budget[item] + 1)
        key = item << 40 | cell
        cells, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        follows = np.append(cells[1:] == cells[:-1] + 1, False)
        band = count + np.where(follows, np.append(count[1:], 0), 0)
        # a band may also begin with an empty cell; it then counts no more than the band of its second cell
        strong = np.flatnonzero(band >= self.needed[cells >> 40])
        if not len(strong):
            return []
        grouped = np.argsort(inverse, kind="stable")
        ends = np.cumsum(count)
        region = np.frombuffer(data, np.uint8)
        best: dict[int, tuple[int, int, int]] = {}
        for s in strong:
            k = int(cells[s] >> 40)
            last = s + 1 if follows[s] else s
            hits = grouped[ends[s] - count[s] : ends[last]]
            if len(np.unique(place[hits])) < self.needed[k] or best.get(k, (1,))[0] == 0:
                continue
            most = int(self.budget[k])
            low = (int(cells[s]) & (1 << 40) - 1) * (most + 1) - self.offset
            passage, bytes_of = self.arrays[k], self.items[k][1]
            from_, to = max(0, low - most), min(len(data), low + 3 * (most + 1) + len(passage))
            exact = data.find(bytes_of, from_, to)
            if exact >= 0:
                found = (0, exact, exact + len(passage))
            else:
                got = banded_alignment(passage, region[from_:to], low - most - from_, 2 * (most + 1) + 2 * most, most)
                if got is None or got[0] > most:
                    continue
                found = (got[0], got[1] + from_, got[2] + from_)
            best[k] = min(best.get(k, found), found)
        return [(self.items[k][0], start, end, edits) for k, (edits, start, end) in best.items()]


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """The passages in blocks of about ``limit`` bytes, so that what driver and executors hold at once stays bounded whatever their number."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-size // limit))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) for part in range(parts)] if parts > 1 else [rows]


def _shared(block: DataFrame):
    return block.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in block.collect()])


def find_passages(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, edits, char_start, char_end): each passage that occurs in a document within its edit budget, at its
    best place: bytes of the normalised text, and characters of the text itself.

    Passages under Q bytes once normalised must occur as whole words and without edits; null ones, and those without letters or digits,
    are never found. Null and empty texts contain nothing. Rows that share a doc_id are searched each for itself, and repeated passages
    are reported under each item_id. Empty tables give no rows. A benchmark of more than ``limit`` bytes is searched block by block, each
    block's finds written before the next one is sent.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text")).where("text is not null and text <> ''")
    parts = blocks(benchmark, item_id, item_text, limit)
    if len(parts) == 1:
        return _search(rows, _shared(parts[0]))
    scratch, out = Scratch(docs.sparkSession, "passages"), None
    for n, part in enumerate(parts):
        shared = _shared(part)
        found = scratch.save(_search(rows, shared), f"block{n}")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _search(rows: DataFrame, shared) -> DataFrame:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = PassageIndex(shared.value)
        for batch in batches:
            found = []
            for i, t in zip(batch["id"], batch["text"]):
                if hits := index.search(t):
                    found += [(i, *hit, *place) for hit, place in zip(hits, characters(t, [(h[1], h[2]) for h in hits]))]
            columns = ["doc_id", "item_id", "start", "end", "edits", "char_start", "char_end"]
            yield pd.DataFrame(found, columns=columns).astype({"doc_id": "Int64", "item_id": "Int64"})

    return rows.mapInPandas(search, "doc_id long, item_id long, start long, end long, edits long, char_start long, char_end long")


def clean_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no passage of ``benchmark``. Null and empty texts stay, repeated rows
    too; an empty benchmark takes nothing.

    A benchmark of more than ``limit`` bytes is applied block by block, what is left each time written before the next block is sent.
    """
    kept, parts = docs, blocks(benchmark, "item_id", item_text, limit)
    scratch = Scratch(docs.sparkSession, "clean") if len(parts) > 1 else None
    for n, part in enumerate(parts):
        shared = _shared(part)
        kept = kept.where(_is_clean(shared)(F.col(text)))
        if scratch:
            kept = scratch.save(kept, f"after{n}")
            shared.destroy()
            if n:
                scratch.drop(f"after{n - 1}")
    return kept


def _is_clean(shared):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = PassageIndex(shared.value)
        for texts in batches:
            yield pd.Series([not index.search(t) for t in texts], dtype=bool)

    return clean
