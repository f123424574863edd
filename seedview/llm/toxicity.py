"""Toxicity by a learnt lexicon, misspellings included, with quotation told apart from abuse.

The lexicon is learnt from labelled rows: words, and stems with many endings, that toxic documents use
and clean ones do not. Terms form a trie. The Levenshtein automata of all terms are run on the trie
at once: a state is the set of (trie node, edits so far) that a prefix of a token can have reached, and
states are made when first met and kept, so a token costs one look-up per character and most tokens
die within a few. Each hit is scored in its window of neighbouring tokens: hits inside quotation marks
count little, hits close to other hits count more. Two sums per document, abuse and quotation, feed a
logistic model.

Every whole text is scored where it is read: no shuffle. What is sent to the executors is the lexicon,
which is bounded by the sample that it is learnt from.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedview.llm.common import words_of
from seedview.session import pin

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_OPEN, _CLOSE = "\"'“„«»‘‚", "\"'”“»«’‘"
_TRAIL = ".,;:!?…)"
_NEVER = -1
_TEXTS_AT_ONCE = 64


@dataclass(frozen=True)
class ToxicitySettings:
    """``max_toxic``, ``max_clean``  labelled documents that lexicon and weights are learnt from, at most.
    ``half_trust``     documents with a term at which it counts half.
    ``min_share``      share of toxic documents among those with the term, at least.
    ``stems``          lengths of stems; a stem needs ``min_endings`` different words.
    ``one_edit_from``, ``two_edits_from``  term lengths from which that many edits are allowed.
    ``misspelt``       share of the documents with a term that is taken to misspell it before any do.
    ``window``         tokens on each side that make up a hit's context.
    """

    max_toxic: int = 10_000
    max_clean: int = 20_000
    half_trust: float = 10.0
    min_share: float = 0.9
    stems: tuple[int, ...] = (4, 5, 6, 7)
    min_endings: int = 4
    one_edit_from: int = 5
    two_edits_from: int = 9
    misspelt: float = 0.05
    window: int = 8
    ridge: float = 0.05


@dataclass
class TermAutomaton:
    """All terms within their edit limits, and all words that begin with a stem.

    ``terms`` has (edit limit, weight) of every term, ``stems`` the weight of every stem, and ``ordinary`` the
    tokens that are words of their own, not misspellings of a term.
    """

    terms: dict[str, tuple[int, float]]
    stems: dict[str, float]
    ordinary: frozenset[str] = frozenset()
    _next: list[dict[str, int]] = field(default_factory=list)
    _score: list[tuple[float, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._children: list[dict[str, int]] = [{}]
        self._limit, self._ends, self._weight, self._stem = [0], [_NEVER], [0.0], [0.0]
        for term, (edits, weight) in self.terms.items():
            node = self._add(term, edits)
            self._ends[node], self._weight[node] = edits, weight
        for stem, weight in self.stems.items():
            self._stem[self._add(stem, 0)] = weight
        self._ids: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._start = self._state({0: 0})

    def __reduce__(self):
        return (TermAutomaton, (self.terms, self.stems, self.ordinary))

    def _add(self, word: str, edits: int) -> int:
        node = 0
        self._limit[0] = max(self._limit[0], edits)
        for char in word:
            if char not in self._children[node]:
                self._children[node][char] = len(self._children)
                self._children.append({})
                self._limit.append(0)
                self._ends.append(_NEVER)
                self._weight.append(0.0)
                self._stem.append(0.0)
            node = self._children[node][char]
            self._limit[node] = max(self._limit[node], edits)
        return node

    def _state(self, reached: dict[int, int]) -> int:
        """Number of the state, after leaving out characters of the term; -1 if nothing is reachable."""
        queue = list(reached.items())
        while queue:
            node, edits = queue.pop()
            for child in self._children[node].values():
                if edits + 1 <= self._limit[child] and reached.get(child, 9) > edits + 1:
                    reached[child] = edits + 1
                    queue.append((child, edits + 1))
        if not reached:
            return _NEVER
        key = frozenset(reached.items())
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append(key)
            self._next.append({})
            hits = [self._weight[node] * 0.8**edits for node, edits in key if edits <= self._ends[node]]
            prefix = [self._stem[node] for node, edits in key if edits == 0]
            self._score.append((max(hits, default=0.0), max(prefix, default=0.0)))
        return self._ids[key]

    def _step(self, state: int, char: str) -> int:
        reached: dict[int, int] = {}
        for node, edits in self._sets[state]:
            moves = [(self._children[node][char], edits)] if char in self._children[node] else []
            if edits < self._limit[node]:
                moves.append((node, edits + 1))
            moves += [(child, edits + 1) for child in self._children[node].values()]
            for to, cost in moves:
                if cost <= self._limit[to] and cost < reached.get(to, 9):
                    reached[to] = cost
        found = self._next[state][char] = self._state(reached)
        return found

    def weight(self, token: str) -> float:
        """Weight of the best term within its edit limit, less 20 % an edit, or of a stem; 0 for no match."""
        state, stem = self._start, 0.0
        for char in token:
            following = self._next[state].get(char)
            if following is None:
                following = self._step(state, char)
            if following < 0:
                return stem
            stem = max(stem, self._score[following][1])
            state = following
        return stem if token in self.ordinary else max(stem, self._score[state][0])


class Matcher:
    """Match weights of raw tokens, with a bounded memory of tokens seen."""

    def __init__(self, automaton: TermAutomaton, keep: int = 100_000) -> None:
        self.automaton, self.keep, self.seen = automaton, keep, {}

    def weight(self, token: str) -> float:
        known = self.seen.get(token)
        if known is None:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            known = self.seen[token] = self.automaton.weight(_EDGE.sub("", token))
        return known


def _quoted(tokens: list[str], at: int, window: int) -> bool:
    """Between an opening mark before and a closing mark after, both near, with no closing mark between."""
    for j in range(at, max(-1, at - window - 1), -1):
        if j < at and tokens[j].rstrip(_TRAIL)[-1:] in _CLOSE and len(tokens[j].rstrip(_TRAIL)) > 1:
            return False
        if tokens[j][:1] and tokens[j][0] in _OPEN:
            break
    else:
        return False
    return any(t and t[-1] in _CLOSE for t in (x.rstrip(_TRAIL) for x in tokens[at : at + window + 1]))


def context_sums(text: str | None, matcher: Matcher, window: int) -> tuple[float, float]:
    """Abuse and quotation of one whole text."""
    tokens = (text or "").lower().split()
    weight = matcher.weight
    hits = {t for t in set(tokens) if weight(t)}
    if not hits:
        return 0.0, 0.0
    at = [k for k, t in enumerate(tokens) if t in hits]
    abuse = quotation = 0.0
    for n, k in enumerate(at):
        near = (n > 0 and k - at[n - 1] <= window) + (n + 1 < len(at) and at[n + 1] - k <= window)
        score = weight(tokens[k]) * (1 + 0.25 * near)
        if _quoted(tokens, k, window):
            quotation += score
        else:
            abuse += score
    return abuse, quotation


@dataclass(frozen=True)
class ToxicityModel:
    automaton: TermAutomaton
    weights: tuple[float, float, float]
    window: int

    def sums(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("abuse double, quotation double")
        def sums(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(model.automaton)
            for batch in texts:
                rows = [context_sums(text, matcher, model.window) for text in batch]
                yield pd.DataFrame(rows, columns=["abuse", "quotation"])

        return sums(text)

    def score(self, sums: Column) -> Column:
        bias, abuse, quotation = self.weights
        logit = bias + abuse * F.log1p(sums["abuse"]) + quotation * F.log1p(sums["quotation"])
        return 1 / (1 + F.exp(-logit))


def _term_rows(sample: DataFrame, s: ToxicitySettings) -> DataFrame:
    """(term, ending, y) once per document: its words, and its stems with a word each."""

    def terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), _TEXTS_AT_ONCE):
                part, rows = frame.iloc[start : start + _TEXTS_AT_ONCE], []
                for text, y in zip(part["text"], part["y"], strict=True):
                    words = {_EDGE.sub("", token) for token in set((text or "").lower().split())}
                    words = {w for w in words if 3 <= len(w) <= 40}
                    stems = {w[:n] + "*": w for n in s.stems for w in words if len(w) > n}
                    rows += [(w, w, y) for w in words] + [(stem, w, y) for stem, w in stems.items()]
                yield pd.DataFrame(rows, columns=["term", "ending", "y"])

    return sample.select("text", "y").mapInPandas(terms, "term string, ending string, y int")


def _sizes(sample: DataFrame) -> tuple[int, int]:
    """Toxic and clean rows."""
    size = {row["y"]: row["count"] for row in sample.groupBy("y").count().collect()}
    return size.get(1, 0), size.get(0, 0)


def learn_lexicon(sample: DataFrame, s: ToxicitySettings) -> tuple[dict[str, int], dict[str, int]]:
    """Words and stems that mark toxic documents of a labelled sample (text, y), with their toxic documents.

    A term's log-likelihood ratio must exceed what chance gives the best of all terms tried. The
    number of terms is bounded by the words of the sample, which is bounded itself.
    """
    toxic, clean = _sizes(sample)
    if not toxic:
        return {}, {}
    t, c = F.col("t"), F.col("c")
    part = lambda k, rate: F.when(k > 0, k * F.log(k / ((t + c) * rate))).otherwise(0.0)
    gain = 2 * (part(t, toxic / (toxic + clean)) + part(c, max(clean, 1) / (toxic + clean)))
    counted = (
        _term_rows(sample, s)
        .groupBy("term")
        .agg(
            F.sum("y").alias("t"),
            F.sum(1 - F.col("y")).alias("c"),
            F.approx_count_distinct(F.when(F.col("y") == 1, F.col("ending"))).alias("endings"),
        )
    )
    counted = pin(counted.withColumn("gain", gain), "toxic-terms")
    chance = 2 * math.log(max(counted.count(), 1000))
    rows = (
        counted.where((t >= 3) & (F.col("gain") > chance) & (t >= s.min_share * (t + c)))
        .where(~F.col("term").endswith("*") | (F.col("endings") >= s.min_endings))
        .collect()
    )
    found = {row["term"]: row["t"] for row in rows}
    stems = {term[:-1]: n for term, n in found.items() if term.endswith("*")}
    best = {
        stem: n
        for stem, n in stems.items()
        if not any(stem[:k] in stems and stems[stem[:k]] > n for k in range(1, len(stem)))
        and not any(other != stem and other.startswith(stem) and m == n for other, m in stems.items())
    }
    words = {w: n for w, n in found.items() if not w.endswith("*") and not any(w.startswith(stem) for stem in best)}
    return words, best


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[float, float, float]:
    """Logistic weights (bias, abuse, quotation) by Newton steps, ridge on all but the bias.

    Both classes weigh the same, so 0.5 lies between them however rare toxic documents are.
    """
    share = np.where(y == 1, 1.0, min(1.0, y.sum() / max((1 - y).sum(), 1)))
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6, ridge, ridge])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(share @ np.logaddexp(0, np.where(y == 1, -z, z)) + w @ penalty @ w / 2)

    w = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        curve = (x * (share * p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(curve + penalty, x.T @ (share * (y - p)) - penalty @ w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


_COPY_KEYS = 4


def _copy_keys(text: Column) -> Column:
    """Smallest hashes of the five-word shingles, one for each of some seeds: near copies share most."""

    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        def least(text: str | None) -> list[int]:
            words = words_of(text)
            grams = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
            return [min(xxhash.xxh64_intdigest(g, seed) for g in grams) >> 1 for seed in range(_COPY_KEYS)]

        return pd.Series([least(text) for text in texts])

    return keys(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, s: ToxicitySettings = ToxicitySettings()) -> ToxicityModel:
    """Learn lexicon and weights from (doc_id, text) and (doc_id, y).

    At most ``max_toxic`` and ``max_clean`` labelled documents are used, those with the smallest hash
    of their id; of near copies among them one is used. Without toxic labels no text is toxic.
    """

    def most(y: int, n: int) -> DataFrame:
        return labels.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    chosen = most(1, s.max_toxic).unionByName(most(0, s.max_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    rows = rows.select("doc_id", "text", F.col("y").cast("int").alias("y"), _copy_keys(F.col("text")).alias("keys"))
    rows = pin(rows, "toxic-rows")
    firsts = rows.select("doc_id", "y", "keys")
    for k in range(_COPY_KEYS):
        firsts = firsts.withColumn("key", F.col("keys")[k]).dropDuplicates(["key", "y"])
    sample = pin(rows.join(F.broadcast(firsts.select("doc_id")), "doc_id").select("doc_id", "text", "y"), "toxic-sample")
    words, stems = learn_lexicon(sample, s)
    trust = lambda n: n / (n + s.half_trust)
    by_stem = {stem: trust(n) for stem, n in stems.items()}
    limits = {w: (len(w) >= s.one_edit_from) + (len(w) >= s.two_edits_from) for w in words}
    ordinary, off = _ordinary_variants(sample, words, limits, s)
    limits |= dict.fromkeys(off, 0)
    automaton = TermAutomaton({w: (limits[w], trust(n)) for w, n in words.items()}, by_stem, ordinary)
    model = ToxicityModel(automaton, (-4.0, 0.0, 0.0), s.window)
    if not words and not stems:
        return model
    known = sample.select(model.sums(F.col("text")).alias("s"), "y").select("s.abuse", "s.quotation", "y").toPandas()
    x = np.log1p(known[["abuse", "quotation"]].to_numpy())
    return replace(model, weights=_fit(x, known["y"].to_numpy(), s.ridge))


def _ordinary_variants(
    sample: DataFrame, words: dict[str, int], limits: dict[str, int], s: ToxicitySettings
) -> tuple[frozenset[str], set[str]]:
    """Tokens within a term's edit limit that are no misspellings of it, and terms to be matched exactly.

    A token is ordinary if clean documents use it outside quotations and, as for the terms themselves,
    less than ``min_share`` of the documents with it are toxic. Ordinary words not met yet are what a term's
    edits get wrong, so that is measured: with the ordinary tokens of one half of the rows left out, the
    documents of the other half that hold some variant of the term are counted, both ways round. The term is
    matched exactly unless toxic ones among them are ``min_share``, were both classes equally large. Before
    any is counted, half a clean document and ``misspelt`` of the toxic documents with the term (``words``)
    stand for it, so terms that many toxic documents use keep their edits if nothing speaks against them.
    """
    edits = {w: n for w, n in limits.items() if n}
    if not edits:
        return frozenset(), set()

    def variants(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = TermAutomaton({w: (n, 1.0) for w, n in edits.items()}, {})
        for frame in frames:
            rows = []
            for d, text, y in zip(frame["doc_id"], frame["text"], frame["y"], strict=True):
                tokens = (text or "").lower().split()
                words = {raw: _EDGE.sub("", raw) for raw in set(tokens)}
                near = {raw: w for raw, w in words.items() if w and w not in limits and every.weight(w)}
                if near:
                    used = {near[t] for k, t in enumerate(tokens) if t in near and (y or not _quoted(tokens, k, s.window))}
                    rows += [(d, w, y) for w in used]
            yield pd.DataFrame(rows, columns=["doc_id", "token", "y"])

    # The terms near a token are found here, once for each token.
    @F.pandas_udf("array<string>")
    def terms_near(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
        single = {w: TermAutomaton({w: (n, 1.0)}, {}) for w, n in edits.items()}
        for batch in tokens:
            yield pd.Series([[w for w, one in single.items() if one.weight(token)] for token in batch])

    t, c = F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")
    plain = (F.col("c") > 0) & (F.col("t") < s.min_share * (F.col("t") + F.col("c")))
    found = sample.select("doc_id", "text", F.col("y").cast("int").alias("y")).mapInPandas(variants, "doc_id long, token string, y int")
    found = pin(found.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))), "toxic-variants")
    ordinary = frozenset(row["token"] for row in found.groupBy("token").agg(t, c).where(plain).select("token").collect())
    near = pin(found.select("token").distinct().select("token", F.explode(terms_near("token")).alias("term")), "toxic-near")
    learnt = found.groupBy("token", "half").agg(t, c).where(plain).select("token", (1 - F.col("half")).alias("half"))
    unseen = found.join(learnt, ["token", "half"], "left_anti").join(near, "token")
    rows = unseen.select("term", "doc_id", "y").distinct().groupBy("term").agg(t, c).collect()
    toxic, clean = _sizes(sample)
    odds = s.min_share / (1 - s.min_share)
    seen = {r["term"]: (r["t"], r["c"]) for r in rows}
    telling = lambda n, t, c: (t + s.misspelt * n) * clean >= odds * (c + 0.5) * toxic
    return ordinary, {w for w in edits if not telling(words[w], *seen.get(w, (0, 0)))}


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, abuse, quotation of every row; other columns are ignored.

    A missing or empty text has no hits and gets the score of such texts. Repeated rows stay repeated.
    """
    scored = docs.select("doc_id", model.sums(F.col("text")).alias("__s"))
    return scored.select("doc_id", model.score(F.col("__s")).alias("score"), "__s.abuse", "__s.quotation")
