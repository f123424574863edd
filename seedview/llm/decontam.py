"""Benchmark decontamination: BM25 over test items with block-max pruning, then exact overlap.

Test items are indexed: for every term its items with their BM25 impact, and for every term its blocks
of items with the largest impact inside. Impacts are divided by the item's score for itself, so 1
means that a passage holds all of an item's terms. Every training passage is a query. Bounds use the
lists of rare terms only; what the frequent terms can add at most is one number per block. A document
is first bounded as a whole: the block maxima of its rare terms are summed, and only blocks that can
reach the threshold stay. Then its passages are bounded in the same way, all of them together, and items
of blocks that still can reach the threshold are scored with all terms. All items above the threshold
are retrieved; none is missed, as each bound is at least the score. Retrieved items count as leaked if
the passage holds the five-word shingles of their question and of their answer.

Passages overlap: they are twice as long as the longest item and start one such length apart, so each
copy of an item lies inside one. All lengths count cleaned words: tokens of punctuation alone have no place. The index is sent to all executors; it holds at most ``max_items``
items, and a larger benchmark is indexed in parts, each with a pass of its own.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedview.llm.common import words_of
from seedview.session import pin

_EDGE = string.punctuation.encode()
_KEEP = 500_000
#: Term of tokens of punctuation alone, which are no words.
_NO_WORD = -2
#: Numbers in a matrix of passages and blocks at a time.
_CELLS = 2_000_000


@dataclass(frozen=True)
class LeakSettings:
    """BM25's ``k1`` and ``b``, items per ``block``, ``threshold`` on the share of an item's own score,
    ``rare`` share of items up to which a term is rare, ``shingle`` words and ``overlap`` for the exact check, items per index."""

    k1: float = 1.2
    b: float = 0.75
    block: int = 8
    threshold: float = 0.75
    rare: float = 0.05
    shingle: int = 5
    overlap: float = 0.8
    max_items: int = 20_000


def clean_words(text: str | None) -> list[bytes]:
    return [word for raw in words_of(text) if (word := raw.strip(_EDGE))]


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of question and answer: the last line is the answer, else the last sentence, else none."""
    body = text.strip()
    head, found, tail = body.rpartition("\n")
    if not found:
        cut = max((m.end() for m in re.finditer(r"[.?!]\s+(?=\S)", body)), default=0)
        head, tail = (body[:cut], body[cut:]) if cut else (body, "")
    question, answer = clean_words(head), clean_words(tail)
    return (question, answer) if question else (answer, [])


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """Runs of ``size`` words; the whole sequence if it is shorter; none without words."""
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def overlap(wanted: set[tuple[bytes, ...]], words: list[bytes]) -> float:
    """Share of the wanted runs, all of one length, that the words hold; 1 if nothing is wanted."""
    if not wanted:
        return 1.0
    size = len(next(iter(wanted)))
    return len(wanted & set(zip(*(words[k:] for k in range(size))))) / len(wanted)


class _Lists:
    """Lists of (id, weight) per term, one after the other."""

    def __init__(self, lists: list[dict[int, float]]) -> None:
        self.start = np.concatenate([[0], np.cumsum([len(one) for one in lists])]).astype(np.int64)
        self.ids = np.array([k for one in lists for k in one], np.int64)
        self.weights = np.array([w for one in lists for w in one.values()], np.float64)

    def sums(self, terms: np.ndarray, n: int, row: np.ndarray | int = 0, rows: int = 1) -> np.ndarray:
        """(rows, n) sums of the weights of each id over the terms' lists, each term counted in its row."""
        first, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        cell = np.repeat(np.broadcast_to(row, terms.shape) * n, size) + self.ids[at]
        return np.bincount(cell, self.weights[at], minlength=rows * n).reshape(rows, n)


@dataclass(frozen=True)
class ItemCounts:
    """What scores and passages need of all items: number, mean and largest length, items with each word."""

    n: int
    mean: float
    longest: int
    having: dict[bytes, int]


class LeakIndex:
    """Inverted index of test items with block maxima; ``of_all`` counts all items if these are a part of them."""

    def __init__(self, items: list[tuple[int, str]], s: LeakSettings, of_all: ItemCounts | None = None) -> None:
        self.settings = s
        parts = [(item, split_item(text)) for item, text in items if text and clean_words(text)]
        parts.sort(key=lambda p: (len(p[1][0]) + len(p[1][1]), p[0]))
        self.items = [item for item, _ in parts]
        self.questions = [shingles(q, s.shingle) for _, (q, _) in parts]
        self.answers = [shingles(a, s.shingle) for _, (_, a) in parts]
        texts = [q + a for _, (q, a) in parts]
        self.longest = of_all.longest if of_all else max(map(len, texts), default=1)
        self.vocabulary: dict[bytes, int] = {}
        counts: list[dict[int, int]] = []
        for words in texts:
            seen: dict[int, int] = {}
            for word in words:
                term = self.vocabulary.setdefault(word, len(self.vocabulary))
                seen[term] = seen.get(term, 0) + 1
            counts.append(seen)
        self.n_blocks = -(-len(texts) // s.block)
        self.block_of = np.arange(len(texts)) // s.block
        df = np.bincount([t for seen in counts for t in seen], minlength=len(self.vocabulary)) if texts else np.zeros(0)
        n, mean = len(texts), np.mean([len(words) for words in texts]) if texts else 1.0
        if of_all:
            n, mean, df = of_all.n, of_all.mean, np.array([of_all.having[word] for word in self.vocabulary], np.int64)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.least = s.threshold - 1e-9
        #: Whether a term is rare; the last entry is for unknown tokens (-1).
        self.rare = np.append(df <= max(2, s.rare * n), False)
        self.frequent_adds = np.zeros(self.n_blocks)
        postings: list[dict[int, float]] = [{} for _ in self.vocabulary]
        maxima: list[dict[int, float]] = [{} for _ in self.vocabulary]
        for k, (words, seen) in enumerate(zip(texts, counts, strict=True)):
            norm = s.k1 * (1 - s.b + s.b * len(words) / mean)
            impact = {t: idf[t] * tf * (s.k1 + 1) / (tf + norm) for t, tf in seen.items()}
            own = sum(impact.values())
            block = int(self.block_of[k])
            frequent = sum(value for t, value in impact.items() if not self.rare[t]) / own
            self.frequent_adds[block] = max(self.frequent_adds[block], frequent)
            for t, value in impact.items():
                postings[t][k] = value / own
                if self.rare[t]:
                    maxima[t][block] = max(maxima[t].get(block, 0.0), value / own)
        self.postings, self.maxima = _Lists(postings), _Lists(maxima)

    def retrieve(self, terms: np.ndarray, blocks: np.ndarray) -> list[tuple[int, float]]:
        """All items of the blocks at or above the threshold for a passage's distinct terms."""
        scores = self.postings.sums(terms, len(self.items))[0]
        return [(int(k), float(scores[k])) for k in np.nonzero(blocks[self.block_of] & (scores >= self.least))[0]]


class _Terms(dict):
    """Terms of raw tokens, remembered when first asked for; -1 for words that no item has, -2 for no word."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: bytes) -> int:
        if len(self) > _KEEP:
            self.clear()
        word = token.strip(_EDGE)
        term = self[token] = self.vocabulary.get(word, -1) if word else _NO_WORD
        return term


class LeakFinder:
    """Leaks of documents; the passages of one document are bounded together."""

    def __init__(self, index: LeakIndex) -> None:
        self.index, self.terms = index, _Terms(index.vocabulary)

    def _passages(self, ids: np.ndarray, at: np.ndarray, blocks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(passage, block) matrix of what may reach the threshold; ``at`` are the places of rare terms."""
        index, step = self.index, self.index.longest
        base = int(starts[0]) // step
        at = at[np.searchsorted(at, starts[0]) : np.searchsorted(at, starts[-1] + 2 * step)]
        terms = ids[at]
        order = np.argsort(terms, kind="stable")
        before = np.full(len(at), -1)
        again = np.nonzero(terms[order[1:]] == terms[order[:-1]])[0]
        before[order[again + 1]] = at[order[again]]
        bound = np.zeros((len(starts), index.n_blocks))
        for passage in (at // step - base, at // step - base - 1):
            first = (passage >= 0) & (passage < len(starts)) & (before < (passage + base) * step)
            bound += index.maxima.sums(terms[first], index.n_blocks, passage[first], len(starts))
        return blocks & (bound + index.frequent_adds >= index.least)

    def find(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item, score, question overlap, answer overlap) of every leak, with the best passage's numbers."""
        index = self.index
        words = words_of(text)
        if not words or not index.items:
            return []
        ids = np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words))
        if (ids == _NO_WORD).any():
            words = [word for word, term in zip(words, ids.tolist(), strict=True) if term != _NO_WORD]
            ids = ids[ids != _NO_WORD]
        at = np.nonzero(index.rare[ids])[0]
        blocks = index.maxima.sums(np.unique(ids[at]), index.n_blocks)[0] + index.frequent_adds >= index.least
        if not blocks.any():
            return []
        starts = np.arange(0, max(1, len(words) - index.longest), index.longest)
        several = max(1, _CELLS // index.n_blocks)
        parts = (starts[k : k + several] for k in range(0, len(starts), several))
        alive = np.concatenate([self._passages(ids, at, blocks, part) for part in parts])
        best: dict[int, tuple[float, float, float]] = {}
        for k in np.nonzero(alive.any(axis=1))[0]:
            inside = slice(int(starts[k]), int(starts[k]) + 2 * index.longest)
            hits = index.retrieve(np.unique(ids[inside][ids[inside] >= 0]), alive[k])
            held = [raw.strip(_EDGE) for raw in words[inside]] if hits else []
            for item, score in hits:
                asked, told = overlap(index.questions[item], held), overlap(index.answers[item], held)
                if min(asked, told) >= index.settings.overlap:
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, asked, told))
        return [(index.items[item], *found) for item, found in sorted(best.items())]


_LEAKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("question_overlap", T.DoubleType()),
            T.StructField("answer_overlap", T.DoubleType()),
        ]
    )
)


def build_indexes(benchmark: DataFrame, s: LeakSettings = LeakSettings()) -> tuple[int, Iterator[LeakIndex]]:
    """How many indexes of about ``max_items`` items each there are, and these one after the other.

    Items without id or words are left out. Weights and passages follow counts over all items, taken once by
    Spark, so scores do not depend on the number of indexes; the driver holds one index at a time.
    """
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    parts = -(-rows.count() // s.max_items)
    if parts <= 1:
        return parts, (LeakIndex([tuple(row) for row in rows.collect()], s) for _ in range(parts))

    @F.pandas_udf("array<binary>")
    def item_words(texts: pd.Series) -> pd.Series:
        return pd.Series([[word for side in split_item(text) for word in side] for text in texts])

    part = F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part")
    items = pin(rows.select("item_id", "text", part, item_words("text").alias("words")).where(F.size("words") > 0), "items")
    n, mean, longest = items.agg(F.count(F.lit(1)), F.avg(F.size("words")), F.max(F.size("words"))).first()
    words = items.select("part", F.explode(F.array_distinct("words")).alias("word"))
    having = pin(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "item-words")

    def indexes() -> Iterator[LeakIndex]:
        for k in range(parts):
            own = words.where(F.col("part") == k).select("word").distinct().join(having, "word").collect()
            counts = ItemCounts(n, mean, longest, {bytes(r["word"]): r["n"] for r in own})
            chosen = items.where(F.col("part") == k).select("item_id", "text").collect()
            yield LeakIndex([tuple(row) for row in chosen], s, counts)

    return parts, indexes()


def leaks_of(index: LeakIndex):
    """Column function from a text to its leaks as (item_id, score, question_overlap, answer_overlap)."""

    @F.pandas_udf(_LEAKS)
    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = LeakFinder(index)
        for batch in texts:
            yield pd.Series([[dict(zip(_LEAKS.elementType.names, x)) for x in finder.find(text)] for text in batch])

    return leaks


def find_leaks(docs: DataFrame, benchmark: DataFrame, s: LeakSettings = LeakSettings()) -> DataFrame:
    """doc_id, item_id, score and overlaps of every leaked item in every document.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. A missing or
    empty text leaks nothing; repeated rows give repeated leaks; an empty benchmark gives no rows.
    """
    parts, indexes = build_indexes(benchmark, s)
    none = docs.sparkSession.createDataFrame([], T.StructType([docs.schema["doc_id"], *_LEAKS.elementType.fields]))
    for index in indexes:
        part = docs.select("doc_id", F.explode(leaks_of(index)("text")).alias("__l")).select("doc_id", "__l.*")
        none = none.union(pin(part, "leaks") if parts > 1 else part)
    return none


def without_leaks(docs: DataFrame, benchmark: DataFrame, s: LeakSettings = LeakSettings()) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns.

    Rows are judged each for itself, repeated ones and those without id too; a missing text stays.
    """
    parts, indexes = build_indexes(benchmark, s)
    if parts <= 1:
        for index in indexes:
            docs = docs.where(F.size(leaks_of(index)("text")) == 0)
        return docs
    rows = pin(docs.withColumn("__row", F.monotonically_increasing_id()), "leak-rows")
    leaking = [pin(rows.where(F.size(leaks_of(index)("text")) > 0).select("__row"), "leak-ids") for index in indexes]
    return rows.join(reduce(DataFrame.union, leaking).distinct(), "__row", "left_anti").select(*docs.columns)
