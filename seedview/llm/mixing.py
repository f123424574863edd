"""Mixing sources by temperature, in DataFrame operations only.

A source's weight is its token share to the power of an exponent, normalised. The exponent is found by
bisection on sums over the sources: either the weights reach a target entropy, or they are as flat as
a limit on repetition allows. The driver sees a few sums per round, never the sources.

The weights are realised as permutations of blocks. Each source is hashed into blocks; every pass over
it orders its blocks anew, and the last pass stops where the source's token budget ends: whole blocks
first, then documents of one more block. Each block gets its place in the whole run (0 to 1), so that
reading blocks in order of their place mixes the sources by weight at every point.

Blocks grow in number with a source's documents up to ``max_blocks``, so a source with a third of all
rows is dealt over thousands of keys, and the running sums over a source see at most that many rows.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seedview.llm.common import WORD
from seedview.session import pin


@dataclass(frozen=True)
class MixSettings:
    """``entropy``     target as a share of the largest possible entropy; if unset, repetition decides.
    ``repetition``  most passes over any source relative to the least repeated one.
    ``budget``      tokens of the run; if unset, just enough for every document to occur once.
    ``block_docs``, ``max_blocks``  documents per block, blocks per source at most.
    """

    entropy: float | None = None
    repetition: float = 2.0
    budget: float | None = None
    block_docs: int = 512
    max_blocks: int = 4096
    seed: int = 7


_WAYS = 15


#: Largest exponent tried, and the smallest ratio of two weights that one may lead to.
MOST_EXPONENT, LEAST_RATIO = 64.0, 1e-12


def _entropies(sources: DataFrame, exponents: list[float]) -> list[float]:
    """Entropies of the weights that each exponent gives, in one pass over ``ratio``, the shares by the largest."""
    columns = []
    for k, a in enumerate(exponents):
        p = F.pow("ratio", F.lit(a))
        columns += [F.sum(p).alias(f"z{k}"), F.sum(p * F.log("ratio")).alias(f"e{k}")]
    row = sources.agg(*columns).first()
    return [math.log(row[f"z{k}"]) - a * row[f"e{k}"] / row[f"z{k}"] for k, a in enumerate(exponents)]


def _bisect(sources: DataFrame, target: float, most: float) -> float:
    """Exponent from 0 to ``most`` at which the entropy, which falls, reaches the target.

    A first pass tries 1, 2, 4, ...; each further one cuts the interval in 16.
    """
    low, high = 0.0, most
    tries = [2.0**k for k in range(7) if 2.0**k < most]
    for _ in range(7):
        values = _entropies(sources, tries)
        above = sum(v > target for v in values)
        low, high = ([low, *tries])[above], ([*tries, high])[above]
        tries = [low + (high - low) * k / (_WAYS + 1) for k in range(1, _WAYS + 1)]
    return high


def exponent(sources: DataFrame, s: MixSettings) -> float:
    """The exponent for ``sources`` with the column ``share`` over zero.

    An entropy target below that of the shares themselves takes an exponent above 1. Sources of equal
    size keep equal weights whatever the exponent, so a target may be out of reach; then a warning says so.
    """
    ends = sources.agg(F.count(F.lit(1)), F.min("share"), F.max("share")).first()
    if not ends[0] or ends[1] == ends[2]:
        return 1.0
    ratio = ends[2] / ends[1]
    if s.entropy is None:
        # Passes are share ** (exponent - 1) up to a factor, so the ends alone decide.
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            too_many = ratio ** (1 - middle) > max(s.repetition, 1.0)
            low, high = (middle, high) if too_many else (low, middle)
        return high

    target = s.entropy * math.log(ends[0])
    most = max(1.0, min(MOST_EXPONENT, -math.log(LEAST_RATIO) / math.log(ratio)))
    scaled = sources.withColumn("ratio", F.col("share") / F.lit(ends[2]))
    found = _bisect(scaled, target, most)
    if found == most and _entropies(scaled, [most])[0] > target + 1e-9:
        warnings.warn(f"no exponent up to {most:.3g} brings the entropy down to {s.entropy} of the largest", stacklevel=2)
    return found


def source_weights(rows: DataFrame, s: MixSettings) -> DataFrame:
    """__key, tokens, n_docs, weight, quota, passes (whole ones), rest (tokens) and n_blocks of each source."""
    counted = pin(rows.groupBy("__key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "mix-sources")
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    shares = counted.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    used = shares.where("share > 0")
    a = exponent(used, s)
    largest = used.agg(F.max("share")).first()[0] or 1.0
    power = F.pow(F.col("share") / F.lit(largest), F.lit(a))
    sums = used.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    norm, need = sums[0] or 1.0, sums[1] or 0.0
    budget = float(s.budget) if s.budget is not None else need * norm
    quota = F.col("weight") * budget
    weighed = shares.withColumn("weight", F.when(F.col("share") > 0, power / norm).otherwise(0.0)).withColumn("quota", quota)
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + 1e-6)).otherwise(1)
    blocks = F.greatest(F.lit(1), F.least(F.lit(s.max_blocks), F.ceil(F.col("n_docs") / s.block_docs)))
    return pin(
        weighed.withColumn("passes", passes.cast("int"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("passes") * F.col("tokens")))
        .withColumn("n_blocks", blocks.cast("int"))
        .drop("share"),
        "mix-weights",
    )


def _joined_on(rows: DataFrame, weights: DataFrame, columns: list[str], salt: int = 32) -> DataFrame:
    """``rows`` with columns of their source, by a salted join."""
    spread = weights.select(
        F.col("__key").alias("__of"), *columns, F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("__salt")
    )
    own = F.pmod(F.col("__hash"), F.lit(salt)).cast("int")
    return rows.withColumn("__own", own).join(
        spread, (F.col("__key") == F.col("__of")) & (F.col("__own") == F.col("__salt"))
    ).drop("__own", "__salt", "__of")


def count_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix_sources(docs: DataFrame, s: MixSettings = MixSettings()) -> DataFrame:
    """One row per occurrence of a document in the run.

    Columns: doc_id, source, n_tokens, weight (of the source), epoch (1 for the first pass), block,
    block_at (the block's place in the run, 0 to 1) and doc_key (order inside the block). ``docs`` has
    doc_id, source and text; other columns are ignored. A missing source is a source of its own.
    Documents without words cost nothing and occur in every whole pass of their source, in the first
    if it has no words at all. Repeated rows are documents of their own.
    """
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("missing")).alias("__key"),
        count_tokens(F.col("text")).alias("n_tokens"),
    )
    rows = pin(rows.withColumn("__hash", F.xxhash64(F.lit(s.seed), "doc_id", "n_tokens")), "mix-documents")
    weights = source_weights(rows, s)
    dealt = _joined_on(rows, weights, ["n_blocks"])
    dealt = pin(dealt.withColumn("block", F.pmod(F.shiftright("__hash", 8), F.col("n_blocks")).cast("int")).drop("n_blocks"), "mix-dealt")

    last = F.when(F.col("rest") > 0, F.col("passes") + 1).otherwise(F.col("passes"))
    blocks = dealt.groupBy("__key", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    planned = blocks.join(weights, "__key").where(last > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), last)))
    planned = planned.withColumn("__order", F.xxhash64(F.lit(s.seed), "epoch", "__key", "block"))
    before = W.partitionBy("__key", "epoch").orderBy("__order", "block").rowsBetween(W.unboundedPreceding, -1)
    planned = planned.withColumn("before", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)))
    left = F.when(F.col("epoch") > F.col("passes"), F.col("rest") - F.col("before"))
    place = ((F.col("epoch") - 1) * F.col("tokens") + F.col("before")) / F.greatest("quota", F.lit(1.0))
    planned = planned.withColumn("left", left).where("left is null or left > 0").select(
        F.col("__key").alias("__of"),
        F.col("block").alias("__block"),
        "epoch",
        "weight",
        F.least(place, F.lit(1.0)).alias("block_at"),
        F.when(F.col("left") < F.col("block_tokens"), F.col("left")).alias("left"),
    )
    drawn = dealt.join(planned, (F.col("__key") == F.col("__of")) & (F.col("block") == F.col("__block")))
    drawn = drawn.withColumn("doc_key", F.xxhash64(F.lit(s.seed), "epoch", "doc_id", "n_tokens"))
    columns = ["doc_id", "source", "n_tokens", "weight", "epoch", "block", "block_at", "doc_key"]
    whole = drawn.where("left is null").select(*columns)
    upto = W.partitionBy("__key").orderBy("doc_key", "doc_id", "__hash").rowsBetween(W.unboundedPreceding, 0)
    partial = drawn.where("left is not null").withColumn("upto", F.sum("n_tokens").over(upto))
    return whole.unionByName(partial.where("upto <= left").select(*columns))
