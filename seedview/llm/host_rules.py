"""Quality rules by host: rule failures per host, shrunk rates, verdicts joined back to documents.

Each document is measured once (one pass over its whole text) and the numbers are written to the
shared folder. Failures are summed per host with map-side sums, so a host with a third of all rows
costs no more than any other. A host's failure rate of each rule is shrunk towards the rate of all
hosts by a beta prior fitted to the hosts themselves (method of moments), so a host with three pages
is not condemned by two of them. Verdicts return to the documents by a join that is salted, because
hosts can be many and one of them can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedview.llm.common import SPACE, utf8
from seedview.session import pin

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_MULTIPLIERS = np.random.default_rng(8).integers(1 << 60, size=WINDOW, dtype=np.int64) * 2 + 1
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words"]
_MEASURES = T.StructType([T.StructField(name, T.LongType()) for name in _COUNTS])


@dataclass(frozen=True)
class HostRules:
    """Limits of the rules and of the host verdict.

    ``host_limit``  a host is rejected if its shrunk failure rate of some rule is above this.
    ``salt``        pieces that each host's documents are dealt into for the join.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    max_upper_percent: int = 50
    max_word_chars: int = 25
    host_limit: float = 0.5
    salt: int = 32


def repeated_words(words: list[bytes]) -> int:
    """Words inside ``WINDOW``-word windows that occur twice or more in the text, first ones included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words))
    keys = np.zeros(n, np.int64)
    for k, factor in enumerate(_MULTIPLIERS):
        keys += ids[k : k + n] * factor
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    starts = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``_COUNTS``; a missing text counts as empty."""
    data = utf8(text)
    words = data.split()
    filled = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text or "") - (len(data) - len(data.translate(None, SPACE))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(data) - len(data.translate(None, bytes(range(65, 91)))),
        len(filled),
        len(filled) - len(set(filled)),
        repeated_words(words),
    )


@F.pandas_udf(_MEASURES)
def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([measure(text) for text in batch], columns=_COUNTS, dtype="int64")


def rule_failures(rules: HostRules) -> dict[str, Column]:
    """What each rule calls a failure, on the measured columns."""
    c = F.col
    return {
        "short": c("n_words") < rules.min_words,
        "repeats": 100 * c("n_repeat_words") > rules.max_repeat_percent * c("n_words"),
        "symbols": 100 * c("n_symbols") > rules.max_symbol_percent * c("word_chars"),
        "lines": 100 * c("n_dup_lines") > rules.max_dup_line_percent * c("n_lines"),
        "upper": 100 * c("n_upper") > rules.max_upper_percent * c("word_chars"),
        "long_words": c("word_chars") > rules.max_word_chars * c("n_words"),
    }


def host_rates(measured: DataFrame, rules: HostRules) -> DataFrame:
    """One row per host: documents, and the shrunk failure rate of every rule.

    The prior of a rule has the mean of the hosts' rates; its weight is what their spread beyond
    binomial noise leaves: w = m (1 - m) / v - 1, between 1 and 1000 documents. A missing host is a
    host of its own.
    """
    names = list(rule_failures(rules))
    hosts = pin(
        measured.groupBy("__host").agg(
            F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.col(f"fail_{n}").cast("long")).alias(f"f_{n}") for n in names)
        ),
        "host-counts",
    )
    rate = {n: F.col(f"f_{n}") / F.col("n_docs") for n in names}
    moments = hosts.agg(
        *(F.avg(rate[n]).alias(f"m_{n}") for n in names),
        *(F.coalesce(F.var_samp(rate[n]), F.lit(0.0)).alias(f"v_{n}") for n in names),
        F.avg(1 / F.col("n_docs")).alias("noise"),
    ).first()
    shrunk = []
    for n in names:
        mean = moments[f"m_{n}"] or 0.0
        spread = mean * (1 - mean)
        extra = moments[f"v_{n}"] - spread * (moments["noise"] or 0.0) if moments[f"v_{n}"] is not None else 0.0
        weight = min(max(spread / extra - 1, 1.0), 1000.0) if extra > 0 else 1000.0
        shrunk.append(((F.col(f"f_{n}") + mean * weight) / (F.col("n_docs") + weight)).alias(f"rate_{n}"))
    return hosts.select("__host", "n_docs", *shrunk)


def judge_documents(docs: DataFrame, host: str, rules: HostRules = HostRules()) -> DataFrame:
    """Counts, base verdict, own failures, host verdict and final verdict of every document.

    ``docs`` has doc_id, text and the column ``host``; other columns are ignored. Every input row
    gives one row: repeated rows stay repeated, a missing text has no words (and so fails), a missing
    id or host is kept as it is. ``kept`` is false if the document fails a rule itself or its host is
    rejected; ``base_failed`` holds for the rules on length and repetition alone.
    """
    fails = rule_failures(rules)
    measured = pin(
        docs.select("doc_id", F.col(host).cast("string").alias("__host"), measures(F.col("text")).alias("__m"))
        .select("doc_id", "__host", "__m.*")
        .withColumns({f"fail_{n}": fail for n, fail in fails.items()}),
        "host-measures",
    )
    verdicts = host_rates(measured, rules).select(
        F.col("__host").alias("__of"),
        F.greatest(*(F.col(f"rate_{n}") for n in fails)).alias("host_rate"),
        F.explode(F.sequence(F.lit(0), F.lit(rules.salt - 1))).alias("__salt_of"),
    )
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(rules.salt)).cast("int")
    own = [F.col(f"fail_{n}") for n in fails]
    return (
        measured.withColumn("__salt", salt)
        .join(verdicts, F.col("__host").eqNullSafe(F.col("__of")) & (F.col("__salt") == F.col("__salt_of")), "left")
        .select(
            "doc_id",
            *(c for c in _COUNTS if c not in ("n_upper", "n_lines")),
            (F.col("fail_short") | F.col("fail_repeats")).alias("base_failed"),
            F.concat_ws(",", *(F.when(F.col(f"fail_{n}"), F.lit(n)) for n in fails)).alias("failed_rules"),
            (F.col("host_rate") > rules.host_limit).alias("host_rejected"),
            (~(F.greatest(*own) | (F.col("host_rate") > rules.host_limit))).alias("kept"),
        )
    )
