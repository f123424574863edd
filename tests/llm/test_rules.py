"""Host rules, urls, personal data, chat, mixing and the pipeline."""

import hashlib
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import EDGE_TEXTS, prose
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracles import compare, connect
from seedview.llm import chat, host_rules, mixing, pii, queries, url_filter
from seedview.llm.oracles import ORACLES

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, ROOT).toPandas(), connect(ROOT).execute(ORACLES[name]).df()) == "ok"


# Host rules


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(words):
    runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    twice = {k for k, run in enumerate(runs) if runs.count(run) > 1}
    want = len({k + i for k in twice for i in range(8)})
    assert host_rules.repeated_words([w.encode() for w in words]) == want


def test_measures():
    assert host_rules.measure(None) == host_rules.measure("") == (0,) * 7
    got = dict(zip(host_rules._COUNTS, host_rules.measure("Añ b\x0bc |\n\nx#\nx#\nx# \n")))
    assert got["n_words"] == 7 and got["word_chars"] == 11 and got["n_symbols"] == 4 and got["n_dup_lines"] == 1
    assert got["n_lines"] == 4 and got["n_upper"] == 1


def test_bad_host_takes_its_documents_along(spark):
    good = [(k, prose(k, 40), "fine") for k in range(50)]
    bad = [(100 + k, prose(k, 40) if k % 5 == 0 else "one two", "poor") for k in range(60)]
    small = [(300, "one two", "new"), (301, prose(9, 40), "new")]
    docs = spark.createDataFrame(good + bad + small, "doc_id long, text string, site string")
    kept = {r.doc_id for r in host_rules.judge_documents(docs, "site").where("kept").collect()}
    assert kept == {*range(50), 301}


def test_host_rules_edges(edge_docs, no_docs):
    out = host_rules.judge_documents(edge_docs, "source").collect()
    assert len(out) == len(EDGE_TEXTS) and all(r.kept is not None for r in out)
    assert {r.doc_id for r in out if r.base_failed} == {1, 2, 3, 4, 9, 10}
    assert host_rules.judge_documents(no_docs, "source").count() == 0


# Urls


def test_url_parts_and_rules(spark):
    urls = [
        (1, "https://A.Example.NET/en/x?y=/z", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://net/#f", "net", "/", "net/", "block"),
        (3, "http://subnet/a", "subnet", "/a", None, "allow"),
        (4, "nothing", "", "", None, "allow"),
        (5, None, "", "", None, "allow"),
        (6, "x://b.org", "b.org", "", None, "allow"),
        (7, "x://b.org/fr/q://c", "b.org", "/fr/q://c", "org/fr/", "allow"),
        (8, "x://example.com/de", "example.com", "/de", None, "allow"),
        (9, "x://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
        (10, "a\nb://c.net/\n?", "c.net", "/\n", "net/", "block"),
        (10, "a\nb://c.net/\n?", "c.net", "/\n", "net/", "block"),
    ]
    pages = spark.createDataFrame([u[:2] for u in urls], "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = url_filter.judge_urls(pages, labels, queries.URL_RULES).drop("template").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((u[0], *u[2:]) for u in urls), key=str)
    assert url_filter.judge_urls(pages.limit(0), labels, queries.URL_RULES).count() == 0


def test_bad_branch_is_found_and_alike_branches_merge(spark):
    pages, labels = [], []
    for k in range(400):
        part = ["news", "blog", "casino"][k % 3]
        pages.append((k, f"http://host.test/{part}/{k}.html"))
        labels.append((k, int(part == "casino" or k % 40 == 0)))
    for k in range(400, 460):
        pages.append((k, f"http://host.test/slug{chr(97 + k % 26)}{chr(97 + k // 26)}x/{k}"))
    pages, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")
    tree = {tuple(r.shape): r for r in url_filter.template_tree(pages, labels).collect()}
    assert tree[("casino", "#.html")].blocked and tree[("casino", "#.html")].template[0] == "casino"
    assert not tree[("news", "#.html")].blocked
    judged = url_filter.judge_urls(pages, labels, [])
    assert {r.page_id for r in judged.where("verdict = 'block'").collect()} == {k for k in range(400) if k % 3 == 2}


def test_bad_branch_among_many_small_ones_keeps_its_own(spark):
    section = lambda k: "section" + chr(97 + k % 25)
    pages = [(k, f"http://host.test/{section(k)}/{k}.html") for k in range(1000)]
    pages += [(1000 + k, f"http://host.test/slug{chr(97 + k)}/1.html") for k in range(20)]
    labels = [(k, int(k % 25 == 3)) for k in range(1000)] + [(1000, 1)]
    pages, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")
    tree = {tuple(r.shape): r.template[0] for r in url_filter.template_tree(pages, labels).collect()}
    assert tree[("sectiond", "#.html")] == "sectiond" and tree[("sectiona", "#.html")] == "*"
    assert tree[("sluga", "#.html")] == tree[("slugb", "#.html")] == "*"
    judged = url_filter.judge_urls(pages, labels, [])
    assert {r.page_id for r in judged.where("verdict = 'block'").collect()} == {k for k in range(1000) if k % 25 == 3}


@pytest.mark.parametrize("hot", [1000, 3, 1])
def test_hot_and_rare_shapes_get_the_same_verdicts(spark, hot):
    """Slugs are words, so the tree has about as many rows as there are pages, but for one hot shape."""
    urls = [(k, f"https://big.org/{prose(k, 1)}{chr(97 + k % 26)}/x") for k in range(200)]
    urls += [(1000 + k, f"https://big.org/item/{k}") for k in range(150)] + [(3000, None), (3001, "https://big.org/" + "a/" * 20_000)]
    pages = spark.createDataFrame(urls + urls[:3], "page_id long, url string")
    labels = spark.createDataFrame([(1000 + k, 1) for k in range(0, 150, 2)] + [(k, 0) for k in range(200)], "page_id long, bad int")
    out = url_filter.judge_urls(pages, labels, [], url_filter.TreeSettings(hot_shapes=hot)).collect()
    assert len(out) == len(urls) + 3
    assert {r.page_id for r in out if r.verdict == "block"} == {1000 + k for k in range(150)}
    assert next(r.template for r in out if r.page_id == 1001) == "/item/#"
    assert all(r.template for r in out)


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def fits(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(part) <= 255 for part in found.split("."))
        if kind == "card":
            luhn = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(digits[::-1]))
            return 13 <= len(digits) <= 19 and luhn % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if fits(kind, m[0])
    ]


PERSONAL = [
    "mail a.b+c@x-y.co.uk, and d@e or x@y..z or @b.c a@b.c_x@d.e",
    "hosts 1.2.3.4.5.6.7.8 256.1.1.1 0255.1.2.3 1.2.3 99.88.77.66",
    "cards 4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 1111 1111 5500005555555559-3782 822463 10005",
    "call +1 (555) 010-9999. or +12 or +123456789 +1(23)4-5.6 7890123456789012 ++49 30 1234567",
    "\U0001f600 é +49 30 1234567 ü a@b.cd \U0001f600 4111111111111111",
    "9" * 5000 + " 1.1.1.1 a@" + "b." * 2000 + "c",
]


def test_base_spans(spark):
    rows = [(k, t) for k, t in enumerate(PERSONAL)] + EDGE_TEXTS
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = F.filter("spans", lambda x: x["kind"] != "secret")
    got = pii.find_personal_data(docs).select("row.doc_id", pii.listed(base).alias("spans")).collect()
    assert sorted(((r.doc_id, r.spans) for r in got), key=str) == sorted(((i, ",".join(brute_spans(t))) for i, t in rows), key=str)


def test_personal_data_query(spark):
    docs = {r.doc_id: r.text for r in queries.read_table(spark, ROOT, "documents").collect()}
    for r in queries.personal_data(spark, ROOT).collect():
        spans = brute_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]


def test_secrets_are_added_and_words_are_not(spark):
    rows = [(k, f"word password={'0f' * 6}{k:04x}{'a1b2'} more") for k in range(30)]
    rows += [(100 + k, f"see chapter-section-{k} of it") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.row.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(docs).collect()}
    assert all(found[k] == [("secret", 14, 34)] for k in range(30)) and not any(found[100 + k] for k in range(30))


def test_votes_are_weighed_by_reliability():
    import numpy as np

    votes = np.array([[1, 1, -1], [1, 0, 1], [0, 0, -1], [0, 1, 0]])
    p, true, false = pii.aggregate_votes(votes, np.array([500, 20, 500, 20]))
    assert p[0] > 0.9 > 0.1 > p[2] and (true > false).all()


def test_redaction(spark, edge_docs, no_docs):
    docs = spark.createDataFrame([(1, "a@b.cd x +49 30 1234567"), (2, "none"), (3, None)], "doc_id long, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    out = {r.doc_id: r for r in corpus_pipeline.redact(spark, docs, ROOT).collect()}
    assert out[1].text == "<EMAIL> x <PHONE>" and out[1].n_chars == 17 and out[2].text == "none" and out[3].text is None
    assert corpus_pipeline.redact(spark, edge_docs, ROOT).columns == edge_docs.columns
    assert corpus_pipeline.redact(spark, no_docs, ROOT).count() == 0


# Chat

TURNS = st.lists(
    st.tuples(st.sampled_from(["user", "assistant", "a:b", ""]), st.text(st.sampled_from("\\#<>/turn \n:aé\U0001f600"), max_size=30)),
    max_size=5,
)


@settings(max_examples=200, deadline=None)
@given(TURNS)
def test_chat_round_trip(turns):
    out = chat.render(turns, chat.marked_turns)
    assert chat.read_turns(out.output) == turns
    assert [chat.unescape(out.output[a:b]) for a, b in out.loss] == [t for r, t in turns if r == "assistant"]
    assert not out.rewrites and "".join(out.output[a:b] for a, b in out.spans) == out.output


def test_templates_that_rewrite_history():
    forgetful = lambda turns: "".join(f"[{r}]{t if k >= len(turns) - 2 else ''}" for k, (r, t) in enumerate(turns))
    out = chat.render([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")], forgetful)
    assert out.rewrites == [2, 3] and out.loss == []
    wrapped = lambda turns: "".join(f"<{r}>{t}</{r}>" for r, t in turns)
    out = chat.render([("user", "a"), ("assistant", "bb")], wrapped)
    assert [out.output[a:b] for a, b in out.loss] == ["bb"]


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (None, None, None, None), (1, 1, "assistant", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("output", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    told = "user\na\nassistant\nb\nassistant\nb\n"
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[1].loss_chars == 2
    assert got[2].loss_chars == 0 and got[None].n_turns == 1
    assert chat.format_conversations(frame.limit(0)).count() == 0


# Mixing


def mixed(spark, **options):
    rows = [(k, "big" if k < 300 else f"s{k % 3}", prose(k, 20 + k % 11)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return rows, mixing.mix_sources(docs, mixing.MixSettings(block_docs=16, **options)).toPandas()


@pytest.mark.parametrize("repetition", [1.0, 2.0, 5.0])
def test_repetition_limit(spark, repetition):
    rows, out = mixed(spark, repetition=repetition)
    tokens = Counter()
    for _, source, text in rows:
        tokens[source] += len(text.split())
    assert set(out.doc_id) == set(range(400))
    passes = (out.groupby("source").n_tokens.sum() / tokens[max(tokens, key=tokens.get)]) * 0 + out.groupby("source").n_tokens.sum()
    passes = {s: n / tokens[s] for s, n in passes.items()}
    assert min(passes.values()) == pytest.approx(1, abs=0.02)
    assert max(passes.values()) == pytest.approx(min(repetition, max(passes.values())), abs=0.1) and max(passes.values()) <= repetition + 0.01
    times = out.groupby("doc_id").size()
    for s in passes:
        of = times[[k for k, source, _ in rows if source == s]]
        assert of.max() - of.min() <= 1
    assert not out.duplicated(["doc_id", "epoch"]).any()


def test_entropy_target_and_budget(spark):
    rows, out = mixed(spark, entropy=0.9, budget=5000.0)
    weight = out.groupby("source").weight.first()
    assert -(weight * weight.map(math.log)).sum() == pytest.approx(0.9 * math.log(4), abs=1e-3)
    got = out.groupby("source").n_tokens.sum()
    assert ((5000 * weight - got) >= 0).all() and ((5000 * weight - got) < 31).all()
    assert out.block_at.between(0, 1).all()


def plan_by_hand(tokens, entropy):
    """Weights and quotas by plain search: every source at least once."""
    total = sum(tokens.values())
    weights = lambda a: {k: (v / total) ** a / sum((u / total) ** a for u in tokens.values()) for k, v in tokens.items()}
    h = lambda w: -sum(x * math.log(x) for x in w.values())
    low, high = 0.0, 64.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if h(weights(middle)) > entropy * math.log(len(tokens)) else (low, middle)
    w = weights(high)
    budget = max(tokens[k] / w[k] for k in w)
    return w, {k: budget * w[k] for k in w}


@pytest.mark.parametrize("sizes", [(40, 30, 25), (300, 40, 20), (31, 30, 29)])
def test_entropy_target_is_met_from_either_side(spark, sizes):
    """Shares whose own entropy lies above the target take an exponent above one; no document is left out."""
    rows = [(n * 1000 + k, f"s{n}", prose(k, 10)) for n, size in enumerate(sizes) for k in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix_sources(docs, mixing.MixSettings(entropy=0.97)).toPandas()
    weights, quotas = plan_by_hand({f"s{n}": 10 * size for n, size in enumerate(sizes)}, 0.97)
    got = out.groupby("source").agg(weight=("weight", "first"), tokens=("n_tokens", "sum"))
    for source, weight in weights.items():
        assert got.weight[source] == pytest.approx(weight, abs=1e-5)
        assert quotas[source] - 10 <= got.tokens[source] + 1e-3 and got.tokens[source] <= quotas[source] + 1e-3
    times = out.groupby(["source", "doc_id"]).size().reset_index(name="n").groupby("source").n.agg(["min", "max"])
    for source, quota in quotas.items():
        passes = quota / (10 * sizes[int(source[1])])
        assert math.floor(passes + 1e-6) <= times["min"][source] <= times["max"][source] <= math.floor(passes + 1e-6) + 1
    assert set(out.doc_id) == {r[0] for r in rows}


@pytest.mark.parametrize("root", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_mixing_query_reaches_its_target(spark, root):
    out = queries.QUERIES["op5_mixing"](spark, root)
    weights = [r.weight for r in out.groupBy("source").agg(F.first("weight").alias("weight")).collect()]
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(0.97 * math.log(len(weights)), abs=1e-4)
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{root}/documents.parquet").count()


def test_targets_out_of_reach_are_told(spark):
    docs = spark.createDataFrame([(k, f"s{k % 2 if k < 40 else 2}", prose(k, 10)) for k in range(50)], "doc_id long, source string, text string")
    with pytest.warns(UserWarning, match="no exponent"):
        out = mixing.mix_sources(docs, mixing.MixSettings(entropy=0.1, budget=1000.0)).toPandas()
    assert out.groupby("source").weight.first().sum() == pytest.approx(1.0)


def test_mixing_edges(spark, edge_docs, no_docs):
    out = mixing.mix_sources(edge_docs, mixing.MixSettings(repetition=1.0)).toPandas()
    assert len(out) == len(EDGE_TEXTS) and (out.epoch == 1).all()
    assert mixing.mix_sources(no_docs).count() == 0


# Pipeline


def test_stages_on_edges(spark, edge_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge_docs, ROOT).columns == edge_docs.columns, name
        assert stage(spark, no_docs, ROOT).count() == 0, name


def test_run_of_the_pipeline(spark):
    out = corpus_pipeline.run(spark, ROOT)
    before = queries.read_table(spark, ROOT, "documents").select("doc_id")
    ids = out.select("doc_id").distinct()
    assert ids.join(before, "doc_id", "left_anti").count() == 0
    labels = queries.read_table(spark, ROOT, "labels").where("toxic = 1")
    assert 0 < ids.count() < before.count()
    assert ids.join(labels, "doc_id").count() < labels.count() / 2
    leaks = queries.decontamination(spark, ROOT).select("doc_id")
    assert ids.join(leaks, "doc_id", "left_semi").count() == 0


def test_every_query_is_registered():
    assert [f"op{n}_" for n in range(1, 11)] == [f"{name.split('_')[0]}_" for name in queries.QUERIES]
