"""Language identification: script ranges, per-word scores, and Viterbi over them.

Learning: from labelled rows, the log-probabilities of 1- to 3-letter groups per language, and the script blocks each language is
written in. Predicting: a word's script blocks narrow the candidate languages; its letter groups score them; Viterbi over the words of
the text, with a penalty for switching, gives each word a language and so labels the spans of mixed text. The language of a text is the
one with most letters; its score is that language's share of the letters, each word weighed by how clearly it was told apart.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genospark.llm.storage import Scratch

UNDETERMINED = "und"
#: Bounds of what is learnt, all per language: labelled rows in the sample, letters read of the sample, letter groups kept.
SAMPLE_ROWS, SAMPLE_LETTERS, GROUPS = 2000, 2_000_000, 50_000
CELLS = 32_000_000  # numbers in a model's table at most: with many languages, fewer letter groups are kept of each
SWITCH = 6.0  # natural-log penalty for a change of language between two words
LONGEST = 40  # a longer word is learnt and scored piece by piece, each of this many letters
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BLOCK = 7  # 128 code points to a script block


def words(text: str) -> list[str]:
    """Lower-case runs of letters, with the marks on them."""
    return _WORDS.findall(text.lower())


def letter_groups(word: str) -> Iterator[str]:
    padded = f" {word} "
    yield from word
    for n in (2, 3):
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


_CODE = 21  # bits of a code point


def _packed(group: str) -> int:
    """A letter group as one number: its code points, behind a 1 where they are fewer than three. A blank is the least of them, so groups
    of different lengths never share a number."""
    out = 1 if len(group) < 3 else 0
    for letter in group:
        out = out << _CODE | ord(letter)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    keys: np.ndarray  # letter groups as numbers, sorted
    table: np.ndarray  # log-probability of each in each language; the last row is of a group never seen
    blocks: dict[int, np.ndarray] = field(default_factory=dict)  # script block -> which languages use it

    def score_many(self, found: list[str]) -> np.ndarray:
        """A row for each word: mean log-probability of its letter groups times its length, per language; -1e3 outside the candidates.

        The words stand between blanks in one array of code points; groups are looked up all together.
        """
        langs = len(self.languages)
        if not found or not langs:
            return np.zeros((len(found), langs))
        pieces, owner = [], []
        for n, word in enumerate(found):
            for at in range(0, len(word), LONGEST):
                pieces.append(word[at : at + LONGEST])
                owner.append(n)
        text = np.frombuffer((" " + " ".join(pieces) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
        blank = text == 32
        piece = np.cumsum(blank) - 1  # a blank belongs to the piece after it
        at = np.flatnonzero(~blank)
        ends = np.flatnonzero(blank)[1:]
        two = 1 << 2 * _CODE
        codes = np.concatenate([
            1 << _CODE | text[at], two | text[at - 1] << _CODE | text[at], two | text[ends - 1] << _CODE | 32,
            text[at - 1] << 2 * _CODE | text[at] << _CODE | text[at + 1],
        ])
        word = np.array(owner)[np.concatenate([piece[at], piece[at], piece[ends - 1], piece[at]])]
        row = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        row = np.where(self.keys[row] == codes, row, len(self.keys))
        size = np.array([min(len(w), LONGEST) for w in found]) / np.bincount(word, minlength=len(found))
        out = np.stack([np.bincount(word, self.table[row, k], len(found)) for k in range(langs)], axis=1) * size[:, None]
        allowed = self._candidates(text[at] >> _BLOCK, np.array(owner)[piece[at]], len(found))
        return np.where(allowed, out, -1e3)

    def _candidates(self, blocks: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """Which languages' scripts cover each word, as n rows of truth values; all, where no language covers all of it."""
        every = np.ones(len(self.languages), bool)
        known, place = np.unique(blocks, return_inverse=True)
        uses = np.array([self.blocks.get(int(b), every) for b in known], bool).reshape(len(known), len(every))
        out = np.ones((n, len(every)), bool)
        pairs = np.unique(word * len(known) + place)  # a word's blocks, once each
        np.logical_and.at(out, pairs // max(1, len(known)), uses[pairs % max(1, len(known))])
        out[~out.any(axis=1)] = True
        return out

    def candidates(self, word: str) -> int:
        """The candidates of one word as a bit set."""
        row = self._candidates(np.array([ord(c) >> _BLOCK for c in word], np.int64), np.zeros(len(word), np.int64), 1)[0]
        return sum(1 << k for k, yes in enumerate(row) if yes)

    def score(self, word: str) -> tuple[float, ...]:
        return tuple(self.score_many([word])[0])


def learn(docs: DataFrame, seed: str = "language") -> LanguageModel:
    """A model from a bounded sample of labelled rows (lang, text, and a column ``key`` that only decides who is in the sample).

    At most about SAMPLE_ROWS rows and SAMPLE_LETTERS letters per language are read, whatever the size of ``docs``. Letter groups are
    counted on the executors; the driver gets at most GROUPS of them per language, and CELLS / languages in all. Rows without text or label
    teach nothing.
    """
    labelled = docs.where("lang is not null and text is not null and text <> ''")
    sizes = {r["lang"]: r for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters")).collect()}
    if not sizes:
        return fitted({})
    share = {k: min(1.0, SAMPLE_ROWS / r["n"], SAMPLE_LETTERS / r["letters"]) for k, r in sizes.items()}
    chance = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1_000_000)) / 1e6
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    sample = labelled.where(chance < F.element_at(limit, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"], batch["text"]):
                seen.setdefault(lang, Counter()).update(words(text))
            found: dict[str, Counter] = {}
            for lang, counts in seen.items():
                own = found[lang] = Counter()
                for word, n in counts.items():
                    for at in range(0, len(word), LONGEST):
                        for group in letter_groups(word[at : at + LONGEST]):
                            own[group] += n
            yield pd.DataFrame([(k, g, n) for k, c in found.items() for g, n in c.items()], columns=["lang", "group", "n"])

    scratch = Scratch(docs.sparkSession, "language")
    counted = sample.mapInPandas(count, "lang string, group string, n long").groupBy("lang", "group").agg(F.sum("n").alias("n"))
    counted = scratch.save(counted, "groups")
    most = min(GROUPS, max(1, CELLS // len(sizes) ** 2))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "group"))
    rows: dict[str, list] = {lang: [] for lang in sorted(sizes)}
    for r in counted.withColumn("place", place).where(F.col("place") <= most).toLocalIterator():
        rows[r["lang"]].append((r["group"], r["n"]))
    scratch.drop("groups")
    return fitted(rows)


def fitted(rows: dict[str, list]) -> LanguageModel:
    """The model of counted letter groups: {language: [(group, count)]}."""
    languages = sorted(k for k, v in rows.items() if v)
    total = {k: [sum(n for g, n in rows[k] if len(g) == size) for size in (1, 2, 3)] for k in languages}
    unseen = [math.log(0.5 / (total[k][2] + 1)) for k in languages]
    groups: dict[int, list[float]] = {}
    blocks: dict[int, np.ndarray] = {}
    for k, lang in enumerate(languages):
        for group, n in rows[lang]:
            groups.setdefault(_packed(group), list(unseen))[k] = math.log(n / total[lang][len(group) - 1])
            if len(group) == 1 and n >= 2e-5 * total[lang][0]:
                blocks.setdefault(ord(group) >> _BLOCK, np.zeros(len(languages), bool))[k] = True
    keys = np.array(sorted(groups), np.int64)
    table = np.array([groups[g] for g in sorted(groups)] + [unseen], np.float64).reshape(len(keys) + 1, len(languages))
    return LanguageModel(languages, keys, table, blocks)


class Labeller:
    """Viterbi over the word scores of many texts at once, the texts side by side in arrays."""

    def __init__(self, model: LanguageModel, most: int = 1_000_000):
        self.model, self.most = model, most // max(5, len(model.languages))  # numbers of words kept, by their scores
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores, self.letters = np.zeros((0, len(self.model.languages))), np.zeros(0)

    def _learn(self, fresh: list[str]) -> None:
        self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
        for at in range(0, len(fresh), 20_000):
            self.scores = np.concatenate([self.scores, self.model.score_many(fresh[at : at + 20_000])])
        self.letters = np.concatenate([self.letters, [len(w) for w in fresh]])

    def paths(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the best path: the language of each word, and the number (in this labeller) of each word."""
        if len(self.index) > self.most:
            self._forget()
        split = [words(text) if text else [] for text in texts]
        fresh: set[str] = set()
        for found in split:
            fresh |= set(found).difference(self.index)
        self._learn(sorted(fresh))
        known = self.index.__getitem__
        numbers = [np.fromiter(map(known, found), np.int64, len(found)) for found in split]
        scores, langs = self.scores, len(self.model.languages)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int16), n) for n in numbers]
        if not langs:
            return out
        order = sorted((i for i, n in enumerate(numbers) if len(n)), key=lambda i: -len(numbers[i]))
        at = 0
        while at < len(order):  # texts of like length together, about a million words at a time, or fewer for many languages
            longest = len(numbers[order[at]])
            group = order[at : at + max(1, 1_000_000 // longest // (1 + langs // 64))]
            at += len(group)
            lengths = np.array([len(numbers[i]) for i in group])
            flat = np.zeros((longest, len(group)), np.int64)
            for column, i in enumerate(group):
                flat[: lengths[column], column] = numbers[i]
            # the best path into a language stays in it or comes from the best language of the word before: one bit, and one number a word
            switched, came = np.zeros((longest, len(group), -(-langs // 8)), np.uint8), np.zeros((longest, len(group)), np.int16)
            value = scores[flat[0]].copy()
            alive = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than t words
            for t in range(1, longest):
                n = alive[t]
                v = value[:n]
                best = v.argmax(axis=1)
                top = v[np.arange(n), best] - SWITCH
                switch = top[:, None] > v
                switched[t, :n], came[t, :n] = np.packbits(switch, axis=1), best
                value[:n] = np.where(switch, top[:, None], v) + scores[flat[t, :n]]
            state = value.argmax(axis=1)
            path = np.zeros((longest, len(group)), np.int16)
            for t in range(longest - 1, -1, -1):
                n = alive[t]
                path[t, :n] = state[:n]
                own = state[:n]
                state[:n] = np.where(switched[t, np.arange(n), own >> 3] >> (7 - (own & 7)) & 1, came[t, :n], own)
            for column, i in enumerate(group):
                out[i] = (path[: lengths[column], column], numbers[i])
        return out

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score (0 to 1) of each text; ('und', 0.0) where it is null or has no letters."""
        names = self.model.languages
        out = []
        paths = self.paths(texts)
        scores, letters = self.scores, self.letters
        behind = np.maximum(scores - scores.max(axis=1, keepdims=True), -30.0) if scores.size else scores  # no single word decides alone
        for path, numbers in paths:
            if not len(path) or not names:
                out.append((UNDETERMINED, 0.0))
                continue
            size = letters[numbers]
            share = np.bincount(path, size, len(names)) / size.sum()
            best = int(share.argmax())
            mean = (behind[numbers] * (size / size.sum())[:, None]).sum(axis=0)
            odds = 1 / np.exp(mean - mean[best]).sum()
            out.append((names[best], float(share[best] * odds)))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Start, end (in characters of the text) and language of each run of words with one language."""
        if not text:
            return []
        found = [m for m in _WORDS.finditer(text) if words(m[0])]
        tokens = [w for m in found for w in words(m[0])[:1]]
        path = self.paths([" ".join(tokens)])[0][0]
        out: list[tuple[int, int, str]] = []
        for m, k in zip(found, path):
            lang = self.model.languages[k]
            out[-1:] = [(out[-1][0], m.end(), lang)] if out and out[-1][2] == lang else [*out[-1:], (m.start(), m.end(), lang)]
        return out


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score, which replace columns of those names.

    Null texts and texts without letters, the empty one too, are ``und`` with score 0. Texts of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by GROUPS

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for texts in batches:
            yield pd.DataFrame(labeller.label(list(texts)), columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    label = label.asNondeterministic()  # or a filter on the outcome would label every text twice
    found = docs.select(*kept, label(docs[text]).alias("__label"))
    return found.select(*kept, "__label.lang_pred", "__label.score")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its doc_id as text, modulo 3, is 1. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def learn_from_documents(documents: DataFrame) -> LanguageModel:
    """A model from the rows of documents (doc_id, text, lang) that aren't held out."""
    return learn(documents.where(~held_out()).select("lang", "text", F.col("doc_id").alias("key")))
