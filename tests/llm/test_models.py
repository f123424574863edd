"""Quality and toxicity."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import EDGE_TEXTS, prose
from pyspark.sql import functions as F

from seedview.llm import quality, queries, toxicity


ROOT = "/root/testdata/sf0.01"


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), max_size=6, unique=True), st.text("abcd", max_size=9))
def test_automaton_is_levenshtein(words, token):
    limits = {w: (len(w) >= 3) + (len(w) >= 6) for w in words}
    automaton = toxicity.TermAutomaton({w: (k, 1.0) for w, k in limits.items()}, {})
    want = max((0.8 ** levenshtein(w, token) for w, k in limits.items() if levenshtein(w, token) <= k), default=0.0)
    assert automaton.weight(token) == pytest.approx(want)


def test_stems_match_every_ending():
    automaton = toxicity.TermAutomaton({}, {"grum": 0.5})
    assert automaton.weight("grumble") == automaton.weight("grum") == 0.5
    assert automaton.weight("gruff") == 0


def test_quotation_is_not_abuse():
    matcher = toxicity.Matcher(toxicity.TermAutomaton({"grumbler": (1, 1.0)}, {}))
    sums = lambda text: toxicity.context_sums(text, matcher, 8)
    assert sums("you grumbler you") == (1.0, 0.0)
    assert sums("he called it “a grumbler here” and left") == (0.0, 1.0)
    assert sums('they said "grumbler." and left') == (0.0, 1.0)
    assert sums('"quoted" then a grumbler') == (1.0, 0.0)
    assert sums("GRUMBLEER!") == (pytest.approx(0.8), 0.0)
    assert sums(None) == sums("") == (0.0, 0.0)
    assert sums("grumbler grumbler")[0] > 2


def test_toxicity_learns_and_holds_out(spark):
    scored = queries.toxicity(spark, ROOT).join(queries.read_table(spark, ROOT, "labels"), "doc_id").toPandas()
    clean = scored[scored.toxic == 0]
    assert (clean.predicted == 0).all()
    assert scored[(scored.toxic == 1) & scored.held_out].predicted.mean() >= 0.5
    assert scored.score.between(0, 1).all()


def test_ordinary_words_near_a_term_and_quotation_are_learnt(spark):
    """Clean texts use words one edit from "blorper", and quote "snivelling"; none is near that."""
    def text(k):
        if k % 4 == 0:
            return f"t{k} {'blorper' if k % 8 else 'snivelling'} t{k}"
        if k % 4 == 1:
            return f"she wrote “that snivelling again” in chapter {k}"
        letters = "abcdfghijklmnostuvwxyz"
        return f"the blor{letters[k % 22]}er stands near blorpe{letters[k * 7 % 22]}"

    docs = spark.createDataFrame([(k, f"{prose(k, 30)} {text(k)}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, y int")
    model = toxicity.fit_toxicity(docs, labels)
    limits = {w: n for w, (n, _) in model.automaton.terms.items()}
    assert "blorper" in limits
    score = lambda t: 1 / (1 + math.exp(-(model.weights[0] + sum(
        w * math.log1p(x) for w, x in zip(model.weights[1:], toxicity.context_sums(t, toxicity.Matcher(model.automaton), 8))
    ))))
    assert score("what a blorper this is") > 0.5 > score("the blorner stands near blorpen")
    assert score("she wrote “that blorper again” in it") < score("she wrote that blorper again in it")


def test_toxicity_edges(spark, edge_docs, no_docs, no_labels):
    untaught = toxicity.fit_toxicity(edge_docs, no_labels)
    out = toxicity.score_toxicity(edge_docs, untaught).toPandas()
    assert len(out) == len(EDGE_TEXTS) and (out.score < 0.5).all()
    rows = [(k, "fine words here " + ("grumbler oaf " * 3 if k % 3 == 0 else f"w{k} ")) for k in range(60)]
    docs = spark.createDataFrame([(k, f"{prose(k, 30)} {t}") for k, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(999, 1)], "doc_id long, y int")
    model = toxicity.fit_toxicity(docs, labels)
    assert {"grumbler"} <= set(model.automaton.terms)
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert min(scores[k] for k in range(0, 60, 3)) > 0.5 > max(scores[k] for k in range(60) if k % 3)


def test_numbers_of_texts():
    assert quality.numbers(None) == quality.numbers(" \n") == (0.0,) * len(quality.NAMES)
    got = dict(zip(quality.NAMES, quality.numbers("one one two!\none one two!\n")))
    assert got["log_words"] == pytest.approx(np.log(6)) and got["dup_lines"] == 0.5
    assert got["repeats_next"] == pytest.approx(2 / 6) and got["bang"] == pytest.approx(2 / 6)


def test_quality_ranks_held_out(spark):
    scored = queries.quality(spark, ROOT).join(queries.read_table(spark, ROOT, "labels"), "doc_id").toPandas()
    held = scored[scored.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (scored.predicted == (scored.score >= 0.7)).all()


def test_risk_recovers_the_posterior(spark):
    """With a known prior the non-negative risk finds P(good | bin) from positives and unlabelled rows only."""
    rng = np.random.default_rng(0)
    good = rng.random(6000) < 0.6
    value = np.where(good, rng.random(6000) < 0.8, rng.random(6000) < 0.1).astype(float)
    rows = [(k, float(g and k % 2), *[float(v)] * 1, *[0.0] * (len(quality.NAMES) - 1)) for k, (g, v) in enumerate(zip(good, value))]
    measured = spark.createDataFrame(rows, ["doc_id", "y", *quality.NAMES])
    model = quality.fit_quality(measured)
    assert model.prior == pytest.approx(0.6, abs=0.15)
    scores = dict(measured.select(quality.NAMES[0], model.score(*(F.col(c) for c in quality.NAMES))).distinct().collect())
    assert scores[1.0] > 0.8 and scores[0.0] < 0.45


def test_quality_edges(spark, edge_docs, no_docs, no_labels):
    out = quality.score_quality(edge_docs, spark.createDataFrame([(5,), (8,)], "doc_id long")).toPandas()
    assert len(out) == len(EDGE_TEXTS) and out.score.between(0, 1).all()
    assert quality.score_quality(edge_docs, no_labels.select("doc_id")).count() == len(EDGE_TEXTS)
    assert quality.score_quality(no_docs, no_labels.select("doc_id")).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(100)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    import zlib

    kept = {r.doc_id for r in queries.train_labels(labels, "quality", 4, 2).collect()}
    assert kept == {k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2}
    assert re.fullmatch("y", queries.train_labels(labels, "toxic", 5, 0).columns[1])


def test_misspellings_count_although_clean_texts_use_a_word_near_the_term(spark):
    rows = [(k, prose(k, 60) + " grumbler " + prose(k + 500, 20), 1) for k in range(60)]
    rows += [(100 + k, prose(k + 900, 60) + (" rumbler" if k % 4 == 0 else "") + (' the "grumblor" word' if k == 1 else ""), 0) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.fit_toxicity(docs, docs.select("doc_id", "y"))
    assert "grumbler" in model.automaton.terms or any("grumbler".startswith(stem) for stem in model.automaton.stems)
    new = spark.createDataFrame([(1, prose(3, 50) + " grxmbler"), (2, prose(3, 50) + " gxumbler"), (3, prose(3, 50) + " rumbler")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(new, model).collect()}
    assert min(score[1], score[2]) >= 0.5 > score[3]
