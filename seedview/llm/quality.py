"""Quality by positive-unlabelled learning with the non-negative risk.

Trusted positives are the documents labelled good; every document of the corpus is unlabelled. With
the class prior p, the logistic loss l and the score f, the risk

    p E_pos[l(f)] + max(0, E_all[l(-f)] - p E_pos[l(-f)])

needs no negatives. Each text is reduced once to a few numbers, which are cut into bins at quantiles of
all documents; the score is linear in the bins. The risk is minimised by Newton steps. Every step is
one pass over the binned rows of all documents, summed per partition, then per group of partitions;
the driver sees sums of the size of the model only. The prior is estimated from the best bin: the
smallest ratio of all to positive documents above a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedview.llm.common import utf8
from seedview.session import pin

NAMES = [
    "log_words",
    "word_len",
    "distinct_words",
    "top_word",
    "repeats_next",
    "symbols",
    "digits",
    "upper",
    "marks",
    "bang",
    "bars",
    "sentence_len",
    "line_words",
    "dup_lines",
    "worst_line_symbols",
    "worst_line_upper",
    "worst_line_repeats",
]
_SYMBOLS = b"#*$%&|<>!"
_DIGITS, _UPPER, _MARKS = b"0123456789", bytes(range(65, 91)), b".,;:?"
_NUMBERS = T.StructType([T.StructField(name, T.DoubleType()) for name in NAMES])


@dataclass(frozen=True)
class QualitySettings:
    """``bins`` per number, Newton ``steps`` at most, ``ridge`` on the weights (more with
    few positives), ``min_top`` share of positives that the bin for the prior holds at least."""

    bins: int = 6
    steps: int = 8
    ridge: float = 1e-3
    min_top: float = 0.7


def _without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def numbers(text: str | None) -> tuple[float, ...]:
    """The numbers of one whole text, in the order of ``NAMES``; all zero without a word."""
    data = utf8(text)
    lines = [(line, words) for line in data.split(b"\n") if (words := line.split())]
    n = sum(len(words) for _, words in lines)
    if not n:
        return (0.0,) * len(NAMES)
    counts: dict[bytes, int] = {}
    repeats = 0
    worst = [0.0, 0.0, 0.0]
    for line, words in lines:
        for word in words:
            counts[word] = counts.get(word, 0) + 1
        again = sum(map(eq, words, words[1:]))
        repeats += again
        if len(words) >= 5:
            shares = (_without(line, _SYMBOLS), _without(line, _UPPER), again)
            worst = [max(w, x / len(words)) for w, x in zip(worst, shares, strict=True)]
    marks, bang = _without(data, _MARKS), data.count(b"!")
    return (
        math.log(n),
        len(data) / n,
        len(counts) / n**0.8,
        max(counts.values()) / n,
        repeats / n,
        _without(data, _SYMBOLS) / n,
        _without(data, _DIGITS) / n,
        _without(data, _UPPER) / n,
        marks / n,
        bang / n,
        data.count(b"|") / n,
        n / (1 + data.count(b".")),
        n / len(lines),
        1 - len({line for line, _ in lines}) / len(lines),
        *worst,
    )


@F.pandas_udf(_NUMBERS)
def text_numbers(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([numbers(text) for text in batch], columns=NAMES, dtype="float64")


@dataclass(frozen=True)
class Bins:
    """Inner borders of each number; values up to a border belong below it."""

    borders: tuple[tuple[float, ...], ...]

    @property
    def offsets(self) -> np.ndarray:
        return np.cumsum([1] + [len(b) + 1 for b in self.borders])

    def rows(self, frame: pd.DataFrame) -> np.ndarray:
        """0/1 matrix with a leading column of ones."""
        x = np.zeros((len(frame), self.offsets[-1]))
        x[:, 0] = 1
        each = np.arange(len(frame))
        for name, border, start in zip(NAMES, self.borders, self.offsets, strict=False):
            x[each, start + np.searchsorted(border, frame[name].to_numpy(), side="left")] = 1
        return x


def find_bins(measured: DataFrame, bins: int) -> Bins:
    """Borders at quantiles of all documents; a number that mostly has one value gets fewer bins."""
    steps = [k / bins for k in range(1, bins)] + [0.01, 0.03, 0.9, 0.95, 0.99]
    found = measured.approxQuantile(NAMES, sorted(steps), 0.002)
    return Bins(tuple(tuple(sorted(set(q))) if q else (0.0,) for q in found))


def _sums(measured: DataFrame, part, size: int) -> np.ndarray:
    """Sum over all documents of what ``part`` makes of a batch, a vector of ``size``.

    One vector leaves each partition; about the square root of their number meet in a task, and as many
    reach the driver. A partition's group is its number, so that a task run again sends the same.
    """
    groups = math.isqrt(measured.rdd.getNumPartitions()) + 1

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for frame in frames:
            total += part(frame)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId() % groups], "sums": [total.tobytes()]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [np.sum([np.frombuffer(b) for b in frame["sums"]], axis=0).tobytes()]})

    merged = (
        measured.mapInPandas(partial, "part int, sums binary").groupBy("part").applyInPandas(merge, "sums binary").collect()
    )
    return np.sum([np.frombuffer(row["sums"]) for row in merged], axis=0) if merged else np.zeros(size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def minimise_risk(measured: DataFrame, bins: Bins, prior: float, start: np.ndarray, s: QualitySettings) -> np.ndarray:
    """Newton steps on the non-negative risk; a step that makes its second part negative is shortened."""
    width = len(start)
    triangle = np.triu_indices(width)

    def slopes(w: np.ndarray) -> np.ndarray:
        def part(frame: pd.DataFrame) -> np.ndarray:
            x, y = bins.rows(frame), frame["y"].to_numpy()
            p = _sigmoid(x @ w)
            curve = (x * (p * (1 - p))[:, None]).T @ x
            return np.concatenate([[len(x), y.sum()], p @ x, y @ x, curve[triangle]])

        return _sums(measured, part, 2 + 2 * width + len(triangle[0]))

    def risks(tries: np.ndarray) -> np.ndarray:
        def part(frame: pd.DataFrame) -> np.ndarray:
            z, y = bins.rows(frame) @ tries.T, frame["y"].to_numpy()
            return np.concatenate([_softplus(z).sum(0), y @ _softplus(z), y @ _softplus(-z)])

        return _sums(measured, part, 3 * len(tries)).reshape(3, -1)

    w, best = start, math.inf
    for _ in range(s.steps):
        got = slopes(w)
        n, n_pos = got[0], max(got[1], 1.0)
        if not n:
            break
        all_x, pos_x, curve = got[2 : 2 + width], got[2 + width : 2 + 2 * width], np.zeros((width, width))
        curve[triangle] = got[2 + 2 * width :] / n
        curve = curve + np.triu(curve, 1).T + s.ridge * np.eye(width)
        step = np.linalg.solve(curve, prior * pos_x / n_pos - all_x / n - s.ridge * w)
        step *= min(1.0, 3 / max(np.abs(step).max(), 1e-9))
        tries = np.array([w + step * 0.5**k for k in range(5)])
        as_bad, pos_as_bad, pos = risks(tries)
        negative = as_bad / n - prior * pos_as_bad / n_pos
        risk = prior * pos / n_pos + np.maximum(0, negative) + s.ridge / 2 * (tries**2).sum(1)
        allowed = np.where(negative >= 0, risk, math.inf)
        pick = int(np.argmin(allowed))
        if not allowed[pick] < best - 1e-5:
            if best < math.inf or not w.any():
                break
            w = np.zeros_like(w)  # the start is not allowed under this prior; zero always is
            continue
        w, best = tries[pick], allowed[pick]
    return w


def estimate_prior(measured: DataFrame, bins: Bins, w: np.ndarray, s: QualitySettings) -> float:
    """Smallest ratio of the shares of all and of positive documents above a score.

    A smallest ratio errs to the low side, which keeps the second part of the risk from turning negative.
    """
    cuts = 400

    def part(frame: pd.DataFrame) -> np.ndarray:
        at = np.minimum((_sigmoid(bins.rows(frame) @ w) * cuts).astype(int), cuts - 1)
        y = frame["y"].to_numpy()
        return np.concatenate([np.bincount(at, minlength=cuts), np.bincount(at, y, minlength=cuts)])

    every, positive = _sums(measured, part, 2 * cuts).reshape(2, cuts)
    n, n_pos = max(every.sum(), 1), max(positive.sum(), 1)
    above, above_pos = every[::-1].cumsum() / n, positive[::-1].cumsum() / n_pos
    usable = above_pos >= s.min_top
    return float(np.clip((above / np.maximum(above_pos, 1e-9))[usable].min(initial=0.98), 0.02, 0.98))


@dataclass(frozen=True)
class QualityModel:
    bins: Bins
    weights: np.ndarray
    prior: float

    def score(self, *measured: Column) -> Column:
        """Probability of a good document from its numbers, in the order of ``NAMES``."""
        model = self

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            frame = pd.DataFrame(dict(zip(NAMES, columns, strict=True)))
            return pd.Series(_sigmoid(model.bins.rows(frame) @ model.weights))

        return score(*measured)


def measure_documents(docs: DataFrame, positives: DataFrame) -> DataFrame:
    """(doc_id, y, numbers) of every row, written once; y is 1 for the ids in ``positives``."""
    rows = docs.select("doc_id", text_numbers(F.col("text")).alias("__n")).select("doc_id", "__n.*")
    marked = rows.join(positives.select("doc_id", F.lit(1.0).alias("y")), "doc_id", "left")
    return pin(marked.withColumn("y", F.coalesce("y", F.lit(0.0))), "quality-numbers")


def fit_quality(measured: DataFrame, s: QualitySettings = QualitySettings()) -> QualityModel:
    """Fit on the rows of :func:`measure_documents`: first with a guessed prior, then with the estimate.

    Without positives or rows every score is the prior's guess.
    """
    bins = find_bins(measured, s.bins)
    start = np.zeros(bins.offsets[-1])
    n_pos = measured.agg(F.sum("y")).first()[0] or 0.0
    s = replace(s, ridge=max(s.ridge, 2 / (n_pos + 1)))
    rough = minimise_risk(measured, bins, 0.5, start, s)
    prior = estimate_prior(measured, bins, rough, s)
    return QualityModel(bins, minimise_risk(measured, bins, prior, rough, s), prior)


def score_quality(docs: DataFrame, positives: DataFrame, s: QualitySettings = QualitySettings()) -> DataFrame:
    """doc_id and score of every row of (doc_id, text), given the ids of trusted good documents.

    Other columns are ignored. A missing or empty text has all numbers zero and is scored as such.
    Repeated rows stay repeated and count as often as they occur.
    """
    measured = measure_documents(docs, positives)
    model = fit_quality(measured, s)
    return measured.select("doc_id", model.score(*(F.col(name) for name in NAMES)).alias("score"))
