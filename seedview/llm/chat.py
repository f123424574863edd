"""Chat formatting with spans found from outside the template.

A template is any function from a list of (role, text) turns to one string. Nothing about its inside
is known: successive prefixes of a conversation are rendered, and what the output gains from one
prefix to the next is the span of that turn. If an output does not start with the one before, the
template rewrites history; this is reported and such a conversation gets no loss mask. Where a turn's
text lies inside its span is found by rendering the same turn with two probe texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_CONTROL = re.compile(r"\\|#{3,}|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*):\n((?:\\.|[^\\<]|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """Backslash before backslashes, before each of three or more #, and before the end mark."""
    return _CONTROL.sub(lambda m: "".join("\\" + char for char in m[0]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(turns: list[Turn]) -> str:
    """Every turn as header, escaped text and end mark."""
    return "".join(f"### {escape(role).replace(':', chr(92) + ':')}:\n{escape(text)}</turn>\n" for role, text in turns)


def read_turns(output: str) -> list[Turn]:
    """The turns of an output of :func:`marked_turns`."""
    found, at = [], 0
    while at < len(output):
        turn = _TURN.match(output, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return found


@dataclass(frozen=True)
class Rendered:
    """An output, the span of each turn in it, the spans of texts to learn, and turns that changed what came before."""

    output: str
    spans: list[tuple[int, int]]
    loss: list[tuple[int, int]]
    rewrites: list[int]


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def render(turns: list[Turn], template: Template, learn: str = "assistant") -> Rendered:
    """Render all prefixes and compare; see the module's text."""
    before, spans, loss, rewrites = template([]), [], [], []
    for k, (role, _) in enumerate(turns):
        output = template(turns[: k + 1])
        if output.startswith(before):
            spans.append((len(before), len(output)))
        else:
            rewrites.append(k)
            spans.append((_common(before, output), len(output)))
        if role == learn and not rewrites:
            one, two = (template([*turns[:k], (role, probe)]) for probe in ("0", "1"))
            start = _common(one, two)
            loss.append((start, len(output) - (len(one) - start - 1)))
        before = output
    return Rendered(before, spans, [] if rewrites else loss, rewrites)


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_RENDERED = T.StructType(
    [
        T.StructField("output", T.StringType()),
        T.StructField("spans", _SPAN),
        T.StructField("loss", _SPAN),
        T.StructField("rewrites", T.ArrayType(T.LongType())),
    ]
)


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conv_id with its turns in order; a missing role or text is empty.

    Rows with the same turn number follow each other by role and text, missing numbers come first.
    Rows without conv_id form one conversation.
    """
    turn = F.struct(
        "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_conversations(rows: DataFrame, template: Template = marked_turns, learn: str = "assistant") -> DataFrame:
    """(conv_id, output, spans, loss, rewrites) of every conversation of (conv_id, turn, role, text) rows.

    A conversation is one row, so one long conversation costs time and memory of its own only. Other
    columns of ``rows`` are ignored. Positions are code points.
    """

    @F.pandas_udf(_RENDERED)
    def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [render([(t["role"], t["text"]) for t in turns], template, learn) for turns in batch]
            yield pd.DataFrame(
                {
                    "output": [r.output for r in out],
                    "spans": [[{"start": a, "end": b} for a, b in r.spans] for r in out],
                    "loss": [[{"start": a, "end": b} for a, b in r.loss] for r in out],
                    "rewrites": [r.rewrites for r in out],
                }
            )

    return conversations(rows).select("conv_id", rendered("turns").alias("__r")).select("conv_id", "__r.*")


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from outputs of :func:`marked_turns`: turns, texts to learn, lengths."""

    @F.pandas_udf(_DIGEST)
    def digest(outputs: pd.Series, losses: pd.Series) -> pd.DataFrame:
        rows = []
        for output, loss in zip(outputs, losses, strict=True):
            turns = read_turns(output)
            learnt = "".join(unescape(output[s["start"] : s["end"]]) for s in loss)
            told = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((len(turns), _sha(told), len(learnt), _sha(learnt), len(output)))
        return pd.DataFrame(rows, columns=[field.split()[0] for field in _DIGEST.split(", ")])

    return formatted.select("conv_id", digest("output", "loss").alias("__d")).select("conv_id", "__d.*")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
