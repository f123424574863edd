"""Repeated byte strings, SimHash, leaks: against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import EDGE_TEXTS, prose
from pyspark.sql import functions as F

from seedview.llm import common, decontam, queries, simhash, suffix_dedup
from seedview.llm.graph import connected_components

ROOT = "/root/testdata/sf0.001"


def brute_repeats(rows):
    """(removed, spans, sha) of each (doc_id, text) by trying every window."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - 49):
            if doc is not None:
                first[data[k : k + 50]] = min(first.get(data[k : k + 50], doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if doc is not None and first[data[k : k + 50]] < doc:
                gone[k : k + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def repeats(docs, **settings_):
    out = suffix_dedup.remove_repeats(docs, suffix_dedup.RepeatSettings(**settings_), texts=False)
    return sorted((tuple(r) for r in out.collect()), key=str)


PLANTED = "this very passage of a good many words is found again and again in several documents of this test"


def shared_rows():
    rows = [(k, prose(k % 7, 40) + (PLANTED if k % 3 == 0 else "") + prose(k, 20)) for k in range(40)]
    rows += [(100 + k, "ab" * 60 + str(k)) for k in range(5)] + [(200, PLANTED[:49]), (201, PLANTED[:50])]
    return rows + [(300, "é" * 30 + "x"), (301, "y" + "é" * 30), (302, "\x00" * 80), (303, "\x00" * 70 + "z")]


@pytest.mark.parametrize("crowded", [20_000, 1])
def test_repeats_match_every_window(spark, crowded):
    rows = shared_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats(docs, crowded=crowded, shard=50, bucket=1 << 12) == brute_repeats(rows)


def test_repeats_edges(edge_docs, no_docs):
    assert repeats(edge_docs) == brute_repeats(EDGE_TEXTS)
    assert repeats(no_docs) == []


def test_repeats_query(spark):
    rows = [(r.doc_id, r.text) for r in queries.read_table(spark, ROOT, "documents").collect()]
    assert sorted((tuple(r) for r in queries.suffix_dedup(spark, ROOT).collect()), key=str) == brute_repeats(rows)


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=300).map(lambda b: bytes(x % 3 for x in b)))
def test_suffix_array_and_prefixes(data):
    array = np.frombuffer(data, np.uint8)
    order = suffix_dedup.suffix_array(array)
    assert order.tolist() == sorted(range(len(data)), key=lambda k: data[k:])
    lcp = suffix_dedup.common_prefixes(array, order, 50, suffix_dedup.CONTEXT)
    for k in range(1, len(data)):
        a, b = data[order[k - 1] :], data[order[k] :]
        same = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(same, 50)


def test_anchors_of_equal_windows_are_equal():
    text = prose(1, 200).encode()
    one, two = (suffix_dedup.anchor_places(x + text + y) for x, y in ((b"", b"end"), (b"12345", b"")))
    inside = lambda places, shift: {p - shift for p in places if 60 < p - shift < len(text) - 60}
    assert inside(one, 0) == inside(two, 5)


def judged(rows, crowded=20_000):
    """What is said of the anchors of (doc_id, text) rows, by kind, with each row in a batch of its own."""
    batches = (pd.DataFrame({"doc_id": [doc], "code": [doc], "data": [text.encode()]}) for doc, text in rows)
    sent = pd.concat(suffix_dedup._send_anchors(3)(batches))
    told = pd.concat(suffix_dedup._judge_bucket(crowded)(bucket) for _, bucket in sent.groupby("bucket"))
    return (told["said"] % 4).value_counts().to_dict()


def test_contexts_that_share_no_window_are_not_compared():
    text = lambda k, shared: hashlib.sha512(b"%d" % k).hexdigest() + shared + hashlib.sha512(b"%d" % -k).hexdigest()
    apart = [(k, text(k, PLANTED[:30])) for k in range(1, 30)]
    assert [row[2] for row in brute_repeats(apart)] == [0] * 29
    assert judged(apart) == {}
    met = judged([(k, text(k, PLANTED[:50])) for k in range(1, 30)])
    assert met[suffix_dedup.COMPARE] >= 29
    assert judged([(k, text(k, PLANTED[:50])) for k in range(1, 30)], crowded=20)[suffix_dedup.CROWDED] >= 29


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points):
    """Smallest id reachable over links of at most two bits."""
    ids = list(points)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (points[i] ^ points[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_simhash_query(spark):
    docs = {r.doc_id: r.text for r in queries.read_table(spark, ROOT, "documents").collect()}
    points = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = brute_components(points)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.simhash(spark, ROOT).collect()}
    assert got == {i: (f"{points[i]:016x}", want[i]) for i in docs}


@pytest.mark.parametrize("crowd", [64, 1])
def test_links_of_close_fingerprints(spark, crowd):
    rng = np.random.default_rng(3)
    values = {int(v) for v in rng.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64)} | {0, -1, 1, 3, 7}
    for v in list(values):
        flips = rng.integers(0, 64, 3)
        values.add(simhash._signed((v % 2**64) ^ (1 << int(flips[0]))))
        values.add(simhash._signed((v % 2**64) ^ (1 << int(flips[1])) ^ (1 << int(flips[2]))))
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), crowd)
    roots = dict(connected_components(links).collect())
    want = brute_components({v: v % 2**64 for v in sorted(values)})
    assert {v: roots.get(v, v) for v in values} == want


def test_segment_counts_bound_bits(spark):
    rows = [(0, -1), (5, 6), (-(2**63), 2**62), (123456789, 987654321)]
    frame = spark.createDataFrame(rows, "a long, b long")
    counts = lambda c: simhash.segment_counts(F.col(c))
    for r in frame.select("a", "b", simhash.manhattan(counts("a"), counts("b")).alias("d")).collect():
        pair = lambda v: [(v % 2**64 >> 2 * k & 3).bit_count() for k in range(32)]
        assert r.d == sum(abs(x - y) for x, y in zip(pair(r.a), pair(r.b))) <= ((r.a ^ r.b) % 2**64).bit_count()


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    roots = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert roots == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 160)} | {201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_edges(edge_docs, no_docs):
    out = simhash.near_duplicate_classes(edge_docs).collect()
    assert len(out) == len(EDGE_TEXTS)
    by_id = defaultdict(set)
    for r in out:
        by_id[r.doc_id].add(r.component_id)
    assert by_id[1] == by_id[2] == by_id[3] == {1} and by_id[5] == by_id[6] == by_id[None] == {5}
    assert simhash.near_duplicate_classes(no_docs).count() == 0
    kept = simhash.without_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "7", "8", "8", "8", "None", "9", "10"])
    assert simhash.without_near_duplicates(no_docs).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rows = []
    for k in range(12):
        words = prose(k * 1000 + 1, 200).split()
        rows.append((k, " ".join(words)))
        changed = list(words)
        changed[50], changed[120] = "zebra", "yak"
        rows.append((100 + k, " ".join(changed)))
        rows.append((200 + k, " ".join(words[:60]) + " " + prose(k * 1000 + 500, 140)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.without_near_duplicates(docs).collect()}
    assert kept == {*range(12), *range(200, 212)}


def brute_copies(rows):
    """Smallest id reachable over five-word Jaccard similarities of 0.8."""
    words = {i: (t or "").lower().split() for i, t in rows}
    sets = {i: set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} for i, w in words.items()}
    links = [(0, 0)]
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.append((a, b))
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in links[1:]:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return {i for i in sets if root[i] == i}


def variants(seed, n, length, most):
    rng = np.random.default_rng(seed)
    words = prose(seed, length).split()
    for k in range(n):
        changed = list(words)
        for at in rng.choice(length, int(rng.integers(1, most + 1)), replace=False):
            changed[at] = f"new{k}x{at}"
        yield " ".join(changed)


@pytest.mark.parametrize("crowd", [8, 1000])
def test_groups_of_variants_match_brute_force(spark, crowd):
    texts = [*variants(11, 150, 200, 6)]
    line = prose(77, 30)
    texts += [f"{prose(500 + k, 8)} {line}" for k in range(60)] + [f"{line} word{k}" for k in range(20)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.without_near_duplicates(docs, simhash.NearCopySettings(crowd=crowd))
    assert {r.doc_id for r in got.collect()} == brute_copies(rows)


def test_large_groups_cost_about_one_comparison_a_text(spark, monkeypatch):
    """2,000 variants of one text, any two alike, and texts that share a passage and are unlike."""
    texts = [*variants(5, 2000, 120, 1)]
    passage = prose(78, 40)
    texts += [f"{passage} {prose(7000 + k, 80)}" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    calls, alike = [], simhash._alike

    def counted(pairs, named, s):
        calls.append(pairs.count())
        return alike(pairs, named, s)

    monkeypatch.setattr(simhash, "_alike", counted)
    kept = {r.doc_id for r in simhash.without_near_duplicates(docs).collect()}
    assert kept == {0, *range(2000, 2200)} and sum(calls) <= 2 * len(texts)


def test_pairs_that_cannot_be_alike_are_settled_without_texts(spark):
    """The bound on shared shingles never loses a pair that has the similarity."""
    texts = [t for k in range(40) for t in variants(300 + k, 3, 90, 9)]
    rows = list(enumerate(texts))
    sets = {i: simhash.shingle_set(t, 5) for i, t in rows}
    none = np.array([], np.int64)
    prefixes = {i: simhash.rarest(x, none, none, 0.8) for i, x in sets.items()}
    members = [(i, len(sets[i]), at, int(key)) for i, keys in prefixes.items() for at, key in enumerate(keys)]
    frame = spark.createDataFrame(members, "id long, n int, at int, key long")
    near = [(a, b) for a in sets for b in sets if b < a < b + 3 and a // 3 == b // 3]
    several = spark.createDataFrame([], "id long")
    left = simhash._possible(spark.createDataFrame(near, "a long, b long"), frame, several, simhash.NearCopySettings()).collect()
    true = {p for p in near if simhash.jaccard(sets[p[0]], sets[p[1]]) >= 0.8}
    assert true <= {(r.a, r.b) for r in left} and len(left) < len(near)


def test_short_pairs_with_one_changed_word_are_found(spark):
    rows = list(enumerate(t for k in range(300) for t in variants(100 + k, 2, 55, 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.without_near_duplicates(docs).collect()} == brute_copies(rows)


def test_unlike_texts_of_one_template_never_meet(spark, monkeypatch):
    """More of each text is its own than the similarity allows, though its rarest fifth reaches into the template."""
    template = prose(31, 100)
    rows = [(k, f"{prose(4000 + 50 * k, 16)} {template}") for k in range(80)]
    rows += [(1000 + k, text + " more") for k, text in rows[:5]]
    met, kept_by = [], simhash.pin

    def counted(df, name):
        out = kept_by(df, name)
        met.extend([out.count()] if name == "copy-pairs" else [])
        return out

    monkeypatch.setattr(simhash, "pin", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.without_near_duplicates(docs, simhash.NearCopySettings(sample=1, common=3)).collect()}
    assert kept == brute_copies(rows) == set(range(80)) and sum(met) < len(rows)


def test_fingerprints_propose_pairs_of_the_stage(spark, monkeypatch):
    """Copies of long texts lie within two bits: the grid finds them, and they are checked before all others."""
    first, proposed, links, alike = [], [], simhash.fingerprint_links, simhash._alike
    rows = list(enumerate(t for k in range(20) for t in variants(800 + k, 2, 1500, 1)))

    def seen(fps, *crowd):
        out = links(fps, *crowd)
        proposed.append(out.count())
        return out

    def checked(pairs, named, s):
        out = alike(pairs, named, s)
        first.append(out.count())
        return out

    monkeypatch.setattr(simhash, "fingerprint_links", seen)
    monkeypatch.setattr(simhash, "_alike", checked)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.without_near_duplicates(docs).collect()} == brute_copies(rows)
    assert proposed[0] > 0 and first[0] >= proposed[0]


def test_close_fingerprints_of_different_words_stay(spark):
    line = prose(9, 13)
    rows = [(k, f"{line} " * 200 + prose(900 + k, 60)) for k in range(3)]
    points = [brute_fingerprint(t) for _, t in rows]
    assert all((p ^ points[0]).bit_count() <= 2 for p in points)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.without_near_duplicates(docs).collect()} == brute_copies(rows) == {0, 1, 2}


@pytest.mark.parametrize("most", [2_000_000, 1])
def test_few_and_many_ids_join_alike(spark, edge_docs, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_IDS_SENT", most)
    ids = spark.createDataFrame([(1,), (8,), (99,)], "node long")
    kept = lambda how: sorted(str(r.doc_id) for r in common.join_ids(edge_docs, ids, "node", how).collect())
    assert kept("left_semi") == ["1", "8", "8", "8"]
    assert len(kept("left_anti")) == len(EDGE_TEXTS) - 4 and "None" in kept("left_anti")


def brute_leaks(docs, items, least=0.8):
    found = set()
    for item, text in items:
        asked, told = (decontam.shingles(p, 5) for p in decontam.split_item(text or ""))
        for doc, body in docs:
            words = decontam.clean_words(body)
            if (asked or told) and min(decontam.overlap(asked, words), decontam.overlap(told, words)) >= least:
                found.add((doc, item))
    return found


def test_leaks_query(spark):
    table = lambda name: queries.read_table(spark, ROOT, name)
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    got = queries.decontamination(spark, ROOT).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, items) and got
    assert all(r.score >= 0.75 for r in got)


def test_leaks_planted(spark, edge_docs, no_docs):
    items = [(k, prose(50 + k, 30) + "?\nthe answer is " + prose(80 + k, 4)) for k in range(20)] + [(77, None), (78, ""), (None, "x y z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(k, prose(k + 900, 400) + " " + items[k][1].upper() + ". " + prose(k + 950, 300)) for k in range(10)]
    docs += [(100 + k, prose(k + 900, 700)) for k in range(10)] + [(200, items[3][1].split("\n")[0])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {}
    for size in (20_000, 7):
        s = decontam.LeakSettings(max_items=size)
        found[size] = sorted(map(tuple, decontam.find_leaks(frame, bench, s).collect()))
        assert {r[:2] for r in found[size]} == {(k, k) for k in range(10)}
        kept = decontam.without_leaks(frame.withColumn("__l", F.lit(1)), bench, s)
        assert {r.doc_id for r in kept.collect()} == {*range(100, 110), 200} and kept.columns == [*frame.columns, "__l"]
    for one, two in zip(*found.values(), strict=True):
        assert one == pytest.approx(two, abs=1e-12)
    assert {r.doc_id for r in decontam.without_leaks(frame, bench).collect()} == {*range(100, 110), 200}
    assert decontam.find_leaks(edge_docs, bench).count() == 0 and decontam.find_leaks(no_docs, bench).count() == 0
    assert decontam.find_leaks(frame, bench.limit(0)).count() == 0
    assert decontam.without_leaks(edge_docs, bench).count() == len(EDGE_TEXTS)


def test_all_items_above_the_threshold_are_retrieved(monkeypatch):
    items = [(k, prose(k, 12 + k % 9)) for k in range(60)]
    s = decontam.LeakSettings(threshold=0.3, overlap=0.0, block=4)
    index = decontam.LeakIndex(items, s)
    finder = decontam.LeakFinder(index)
    monkeypatch.setattr(decontam, "_CELLS", 40)
    for seed in range(30):
        words = prose(seed, 90).split()
        want = set()
        for start in range(0, max(1, len(words) - index.longest), index.longest):
            inside = {index.vocabulary.get(w.encode(), -1) for w in words[start : start + 2 * index.longest]} - {-1}
            scores = index.postings.sums(np.array(sorted(inside), np.int64), len(index.items))[0]
            want |= {index.items[k] for k in np.nonzero(scores >= s.threshold - 1e-9)[0]}
        assert {leak[0] for leak in finder.find(" ".join(words))} == want


def test_items_with_free_standing_punctuation_are_found_at_every_offset():
    words = [w for k, w in enumerate(prose(40, 35).split()) for w in ([w, "=", "-"] if k % 7 else [w])]
    item = " ".join(words) + "\n" + prose(41, 5)
    finder = decontam.LeakFinder(decontam.LeakIndex([(1, item), (2, prose(42, 30))], decontam.LeakSettings()))
    before, after = prose(43, 200).split(), prose(44, 150)
    for offset in range(200):
        text = " ".join(before[:offset]) + " " + item + " " + after
        assert [leak[0] for leak in finder.find(text)] == [1], offset
