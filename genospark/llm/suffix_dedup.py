"""Passages that repeat across documents, by a sparse suffix array.

Only suffixes that begin at minimisers are kept: of every run of ``size`` words, the place of its least hashed GRAM-word group. Equal
runs choose the same place, so a repeated passage always shares a kept suffix at the same point. Most suffixes begin like no other; a
sort of their first GRAM words, as one number each, drops those. The rest are sorted by the words that follow, neighbours are compared,
and each match is extended right and left from the common place, word by word; where it reaches ``size`` words, it is a repeat. A suffix
may match one neighbour better to the right and a farther one better to the left, so within a run of suffixes that begin alike every
split of ``size`` words into left and right part is compared too. Where a run is cut by the border of a task, the windows that are no
repeat on their own side are grouped with one row for each window of the other sides, so nothing depends on how many suffixes begin
alike. Overlapping repeats merge into spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.llm.storage import Scratch

SIZE, GRAM = 50, 10
CHUNK = 20_000  # sorted suffixes that a task compares at a time
LONG = 48  # of a longer word the array holds a digest
_P = 0x9E3779B97F4A7C15
_Q = 0xD1342543DE82EF95
_M = 0x2545F4914F6CDD1D


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word; A-Z are lower-cased, words end at blanks and the characters 9 to 13."""
    words = text.encode("utf-8").lower().split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def run_hashes(h: np.ndarray, length: int, base: int = _P) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` words: differences of weighted prefix sums, brought to one weight by the inverse base."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    power = _powers(base, len(h))
    back = _powers(pow(base, -1, 2**64), len(h) - length + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
    total = (sums[length:] - sums[:-length]) * back
    total = (total ^ (total >> np.uint64(32))) * np.uint64(_Q)
    return total ^ (total >> np.uint64(29))


def minimisers(h: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``size`` words the place of its minimiser, the leftmost of equal ones; and the hash of the words from each place."""
    grams = run_hashes(h, gram)
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), grams
    views = np.lib.stride_tricks.sliding_window_view(grams, size - gram + 1)
    place = np.concatenate([views[at : at + 50_000].argmin(axis=1) for at in range(0, n, 50_000)])
    return place + np.arange(n), grams


def _scan(size: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, mark, text in zip(batch["id"], batch["mark"], batch["text"]):
                h = word_hashes(text)
                if len(h) < size:
                    continue
                place, grams = minimisers(h, size)
                at = np.unique(place)
                rows.append((i, mark, len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), at.astype(np.int32), grams[at].view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "mark", "n", "digest", "at", "grams"])

    return scan


def _with_equal_neighbour(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted suffixes, those that begin like one of their neighbours. The first and last of a part stay, as a neighbour may be elsewhere."""
    held, equal_before = None, True
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        grams = batch["gram"].to_numpy()
        same = grams[1:] == grams[:-1]
        before, after = np.concatenate([[equal_before], same]), np.concatenate([same, [False]])
        keep = before | after
        yield batch.loc[np.append(keep[:-1], False), ["node", "at"]]
        held, equal_before = batch.iloc[-1:], bool(before[-1])
    if held is not None:
        yield held[["node", "at"]]


def _cut(size: int):
    """The words to the right of each chosen place of a text, and those to the left of it in reverse, each word with a blank behind it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for node, low, high, text, chosen in zip(batch["node"], batch["low"], batch["high"], batch["text"], batch["chosen"]):
                words = [w if len(w) <= LONG else hashlib.blake2b(w, digest_size=16).hexdigest().encode() for w in text.encode("utf-8").lower().split()]
                for p in chosen:
                    left = words[max(0, p - size + GRAM) : p]
                    rows.append((node, low, high, p, b" ".join([*words[p : p + size], b""]), b" ".join([*left[::-1], b""]) if left else b""))
            yield pd.DataFrame(rows, columns=["node", "low", "high", "at", "right", "left"])

    return cut


def _prefixes(contexts: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context a 64-bit number of its first 0, 1, ... ``width`` words, and its number of words."""
    words = [c.split(b" ")[:-1] for c in contexts]
    length = np.fromiter(map(len, words), np.int64, len(words))
    h = np.zeros((len(words), width), np.uint64)
    h[np.arange(width) < length[:, None]] = np.fromiter((xxhash.xxh3_64_intdigest(w) for own in words for w in own), np.uint64, int(length.sum()))
    sums = np.zeros((len(words), width + 1), np.uint64)
    np.cumsum(h * _powers(_P, width), axis=1, out=sums[:, 1:])
    return sums, length


def _in_common(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Words that each row and the next have in common at the beginning."""
    within = np.arange(1, sums.shape[1]) <= np.minimum(length[:-1], length[1:])[:, None]
    return ((sums[:-1, 1:] == sums[1:, 1:]) & within).sum(axis=1)


def _window(left: np.ndarray, right: np.ndarray, at: int, factor: int) -> np.ndarray:
    total = left * np.uint64(factor) + (right ^ np.uint64(at)) * np.uint64(_P)
    total = (total ^ (total >> np.uint64(32))) * np.uint64(_Q)
    return total ^ (total >> np.uint64(29))


def _repeats(rows: pd.DataFrame, run: np.ndarray, sums: tuple, lengths: tuple, size: int) -> np.ndarray:
    """For sorted suffixes, which windows of ``size`` words around each place another document has: a column for each number of words to
    the left. ``run`` numbers the suffixes that begin alike; ``low`` and ``high`` are the smallest and largest id with a suffix's text."""
    (right, left), (n_right, n_left) = sums, lengths
    low, high, o = rows["low"].to_numpy(), rows["high"].to_numpy(), np.arange(size - GRAM + 1)
    found = np.zeros((len(rows), len(o)), bool)
    if not len(rows):
        return found
    # neighbours: a match of r words to the right and l to the left holds all windows of at least size - r and at most l words to the left
    r, l = _in_common(right, n_right), _in_common(left, n_left)  # noqa: E741
    other = (run[:-1] == run[1:]) & (np.minimum(low[:-1], low[1:]) != np.maximum(high[:-1], high[1:]))
    both = other[:, None] & (o >= size - r[:, None]) & (o <= l[:, None])
    found[:-1] |= both
    found[1:] |= both
    # farther matches, in runs of three and more
    many = np.flatnonzero(np.bincount(run)[run] > 2)
    for at in o:
        mine = many[(n_left[many] >= at) & (n_right[many] >= size - at)]
        if not len(mine) or found[mine, at].all():
            continue
        key = _window(left[mine, at], right[mine, size - at], int(at), _Q) ^ run[mine].astype(np.uint64) * np.uint64(_P)
        order = np.argsort(key, kind="stable")
        key, mine = key[order], mine[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shared = np.minimum.reduceat(low[mine], first) != np.maximum.reduceat(high[mine], first)
        found[mine, at] |= np.repeat(shared, np.diff(np.append(first, len(mine))))
    return found


def _extended(size: int):
    """Of sorted suffixes: spans (node, start, end) that repeat; and of runs cut by a border, by two numbers w and v: each window that is
    no repeat here, and, without node, one row for each window that is."""

    def settle(rows: pd.DataFrame, begins: np.ndarray, open_runs: set) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        run = np.cumsum(np.concatenate([[True], begins[1:] != begins[:-1]])) - 1
        (right, n_right), (left, n_left) = _prefixes(rows["right"], size), _prefixes(rows["left"], size - GRAM)
        found = _repeats(rows, run, (right, left), (n_right, n_left), size)
        hit = np.flatnonzero(found.any(axis=1))
        node, at, low, high = (rows[c].to_numpy() for c in ("node", "at", "low", "high"))
        # the windows of one place overlap, so they are one span
        start, end = at[hit] - (size - GRAM - found[hit, ::-1].argmax(axis=1)), at[hit] - found[hit].argmax(axis=1) + size
        yield pd.DataFrame({"node": node[hit], "start": start, "end": end, "w": None, "v": None, "low": None, "high": None})
        opened = np.flatnonzero(np.fromiter((b in open_runs for b in begins), bool, len(rows)))
        for o in range(size - GRAM + 1 if len(opened) else 0):
            mine = opened[(n_left[opened] >= o) & (n_right[opened] >= size - o)]
            w, v = (_window(left[mine, o], right[mine, size - o], o, f).view(np.int64) for f in (_Q, _M))
            known = found[mine, o]
            table = pd.DataFrame({"node": node[mine], "start": at[mine] - o, "end": at[mine] - o + size, "w": w, "v": v, "low": low[mine], "high": high[mine]})
            yield table[~known]
            once = table[known].groupby(["w", "v"], sort=False, as_index=False).agg(low=("low", "min"), high=("high", "max"))
            yield once.assign(node=None, start=None, end=None)[list(table.columns)]

    def beginnings(rows: pd.DataFrame) -> np.ndarray:
        out = np.empty(len(rows), object)
        out[:] = [b" ".join(x.split(b" ", GRAM)[:GRAM]) for x in rows["right"]]
        return out

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, cut = [], None  # rows that wait for the end of their run; the beginning of a run with rows elsewhere
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if cut is None:
                cut = {beginnings(batch.iloc[:1])[0]}
            if sum(map(len, held)) < CHUNK:
                continue
            rows = pd.concat(held, ignore_index=True)
            begins = beginnings(rows)
            last = int(np.argmax(begins == begins[-1]))
            if last == 0:  # one run fills it all
                cut.add(begins[-1])
                last = len(rows)
            yield from settle(rows.iloc[:last], begins[:last], cut)
            held = [rows.iloc[last:]]
            cut = {b for b in cut if b == begins[-1]}
        if held:
            rows = pd.concat(held, ignore_index=True)
            begins = beginnings(rows)
            yield from settle(rows, begins, (cut or set()) | set(begins[-1:]))

    return extend


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def merged_spans(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Spans (start, end) covered by runs of ``size`` words; runs that overlap or touch are one span."""
    if not len(starts):
        return []
    s = np.unique(starts)
    cut = np.flatnonzero(s[1:] > s[:-1] + size)
    return list(zip(s[np.concatenate([[0], cut + 1])].tolist(), (s[np.append(cut, len(s) - 1)] + size).tolist()))


def repeated_passages(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_repeated, spans) for each document with a run of ``size`` words that another document has too.

    spans are an array of (start, end) in words, end exclusive, in order and apart; n_repeated is their total. A run repeated within one
    document only is no repeat. Texts that are null or shorter than ``size`` words, and rows without doc_id, have none and give no row.
    Rows that share a doc_id are one document, so copies of a row do not repeat each other, but each gives a row. An empty table gives
    none. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    base = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text")).where("id is not null").withColumn("mark", F.xxhash64("text"))
    scanned = scratch.save(base.mapInPandas(_scan(size), "id long, mark long, n long, digest binary, at array<int>, grams array<long>"), "scanned")
    # Equal sequences of words are one node, whatever number of rows has them; (doc, mark) is a row, up to copies, with its text. Node
    # numbers are given once, in a written table.
    grouped = scanned.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("row"), F.max("id").alias("high"), F.first("at").alias("at"), F.first("grams").alias("grams"))
    nodes = scratch.save(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("row.id").alias("low"), F.col("row.mark").alias("m"), "high", "at", "grams"), "nodes")
    each = nodes.select("node", F.explode(F.arrays_zip("at", "grams")).alias("s"))
    suffixes = scratch.save(each.select(F.col("s.grams").alias("gram"), "node", F.col("s.at").alias("at")), "starts")
    keys = ["gram", "node", "at"]
    matched = suffixes.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(_with_equal_neighbour, "node long, at int")
    chosen = matched.groupBy("node").agg(F.collect_set("at").alias("chosen"))
    wanted = scratch.save(chosen.join(nodes.select("node", "low", "high", "m"), "node"), "wanted")
    scratch.drop("starts")
    texts = base.join(wanted.hint("merge"), (F.col("id") == F.col("low")) & (F.col("mark") == F.col("m"))).dropDuplicates(["low", "m"])
    cut = texts.select("node", "low", "high", "text", "chosen").mapInPandas(_cut(size), "node long, low long, high long, at int, right binary, left binary")
    array = scratch.save(cut, "array")
    # the range of a row is told by the beginning of its suffix; node and place part equal ones
    ordered = array.repartitionByRange(F.substring("right", 1, LONG), "node", "at").sortWithinPartitions("right", "left", "node", "at")
    found = scratch.save(ordered.mapInPandas(_extended(size), "node long, start int, end int, w long, v long, low long, high long"), "extended")
    windows = found.where("w is not null")
    repeated = windows.groupBy("w", "v").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("w", "v")
    repeated = scratch.save(repeated, "repeated")
    span = ["node", F.struct("start", "end").alias("span")]
    spans_of = found.where("w is null").select(*span).unionByName(windows.where("node is not null").join(repeated.hint("merge"), ["w", "v"]).select(*span))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def joined(found: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in own])] for own in found])

    spans = scratch.save(spans_of.groupBy("node").agg(F.collect_set("span").alias("all")).select(F.col("node").alias("k"), joined("all").alias("spans")), "spans")
    of_class = nodes.select("node", F.col("digest").alias("d"), (F.col("high") > F.col("low")).alias("copied")).join(spans, F.col("node") == F.col("k"), "left")
    of_class = scratch.save(of_class.where("copied or spans is not null").select("d", "copied", "spans"), "of_class")
    scratch.drop("nodes", "wanted", "array", "extended", "repeated", "spans")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    out = scanned.select("id", "n", "digest").join(of_class, F.col("digest") == F.col("d"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), F.when(F.col("copied"), whole).otherwise(F.col("spans")).alias("spans"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return out.select("doc_id", "n_words", covered.alias("n_repeated"), "spans")
