"""Piece codec, Merkle manifest and centroid clustering against libraries and brute force."""

import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import EDGE_TEXTS
from pyspark.sql import functions as F

from seedview.llm import centroids, manifest, pieces, queries

ROOT = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


# Pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_model(PATH))


TEXTS = st.one_of(
    st.text(max_size=60),
    st.text(alphabet=" ▁ab\n\t\x00", max_size=80),
    st.text(alphabet="etaoinshrdlu ", max_size=120),
    st.lists(st.sampled_from([" ", "  " * 9, "the", "ing", "ñ", "\U0001f600", "中文", "<s>", "<0x0A>", "�"]), max_size=30).map("".join),
)


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_codec_equals_the_library(codec, library, text):
    ids = codec.encode(text)
    assert ids.tolist() == library.encode(text)
    assert codec.decode(ids) == library.decode(ids.tolist()) == text.replace(pieces.MARK, " ")


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 300)), max_size=20))
def test_any_ids_decode_like_the_library(codec, library, ids):
    assert codec.decode(np.array(ids, np.int32)) == library.decode(ids)


def toy(words: list[str]) -> pieces.PieceModel:
    """A model whose pieces are the words, best first, and single bytes."""
    scores = [0.0] * 257 + [-float(i) for i in range(len(words))]
    return pieces.PieceModel([None] * 257 + words, scores, {i + 1: i for i in range(256)}, 0, False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="abc▁", min_size=1, max_size=4), unique=True, max_size=12), st.text(alphabet="abc d", max_size=24))
def test_backtracking_equals_plain_merging(words, text):
    """Also for vocabularies whose longest matches are mostly wrong and with pieces across spaces."""
    own = pieces.Codec(toy(words))
    want = pieces.merged(text.replace(" ", pieces.MARK), own.score)
    got = [piece for stretch in own.stretches.findall(text.replace(" ", pieces.MARK)) for piece in own.cut(stretch)]
    assert got == want


def test_long_texts_without_spaces(codec, library):
    for text in ("a" * 20_000, "abcab" * 3_000, " " * 5_000, "\U0001f600" * 2_000, "中" * 4_000):
        assert codec.encode(text).tolist() == library.encode(text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    own = pieces.Codec(pieces.read_model(PATH))
    for text in [f"word{k % 5} next{k % 7}" for k in range(40)]:
        assert own.encode(text).tolist() == library.encode(text)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        pieces.read_model(str(tmp_path / "m"))


def test_piece_query_over_the_whole_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_piece_codec"](spark, ROOT).collect()
    assert len(rows) == len(docs)
    for row in rows:
        ids = library.encode(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_piece_edges(edge_docs, no_docs, library):
    out = pieces.encode_documents(edge_docs, PATH)
    assert out.columns == [*edge_docs.columns, "__encoded"]
    got = sorted((r.doc_id or 0, r["__encoded"].decoded, list(r["__encoded"].ids)) for r in out.collect())
    assert got == sorted((i or 0, t or "", library.encode(t or "")) for i, t in EDGE_TEXTS)
    assert pieces.encode_documents(no_docs, PATH).count() == 0


# Manifest


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climbed(leaves: list[str], fanout: int) -> tuple[str, list[list[tuple[list[str], int]]]]:
    """The last node of a tree, and per leaf the runs (digests, own place) that it passes."""
    paths, level, members = [[] for _ in leaves], leaves, [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, below = [], []
        for start in range(0, len(level), fanout):
            run = level[start : start + fanout]
            for place, leaf_ids in enumerate(members[start : start + fanout]):
                for i in leaf_ids:
                    paths[i].append((run, place))
            above.append(h("".join(run)))
            below.append([i for ids in members[start : start + fanout] for i in ids])
        level, members = above, below
    return level[0], paths


def by_hand(rows: list[tuple], fanout: int) -> tuple[str, list[tuple]]:
    """Root and sorted (doc_id, digest, subroot, siblings, folded) of (doc_id, group, digest, checked) rows."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, subroots = [], []
    for group in order:
        own = sorted(groups[group], key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))
        subroot, paths = climbed([r[2] for r in own], fanout)
        trees.append((own, paths))
        subroots.append(subroot)
    root, tops = climbed(subroots, fanout)
    out = []
    for (own, paths), subroot, top in zip(trees, subroots, tops):
        for row, path in zip(own, paths):
            folded, siblings = row[3], ""
            for run, place in [*path, *top]:
                folded = h("".join([*run[:place], folded, *run[place + 1 :]]))
                siblings += "".join([*run[:place], *run[place + 1 :]])
            out.append((row[0] or -1, row[2], subroot, siblings, folded))
    return root, sorted(out)


def built(spark, rows, fanout, share):
    frame = spark.createDataFrame([(i, g, bytearray.fromhex(d), bytearray.fromhex(c)) for i, g, d, c in rows], "doc_id long, group string, digest binary, checked binary")
    tree = manifest.build_manifest(frame, fanout, share)
    proofs = manifest.prove(tree).collect()
    return tree, sorted((r.doc_id or -1, r.digest.hex(), r.subroot.hex(), r.siblings.hex(), r.folded.hex()) for r in proofs)


@pytest.mark.parametrize("fanout, share, sizes", [(2, 1, [1, 2, 9, 3]), (3, 2, [40, 1, 1, 7]), (16, 4096, [1]), (4, 3, [1] * 9), (2, 4, [33])])
def test_trees_equal_trees_by_hand(spark, fanout, share, sizes):
    names = [None, "", "z", "a/b", "é", *map(str, range(9))]
    rows = [(i * 7 % 101, names[g], h(f"{g}.{i}"), h(f"{g}.{i}" + "x" * (i % 3 == 0))) for g, n in enumerate(sizes) for i in range(n)]
    root, want = by_hand(rows, fanout)
    tree, got = built(spark, rows, fanout, share)
    assert tree.root == root and got == want
    untouched = {r[2] for r in rows if r[2] == r[3]}
    assert all((folded == root) == (digest in untouched) for _, digest, _, _, folded in got)


def test_repeated_rows_and_missing_ids(spark):
    same = (5, "s", h("x"), h("x"))
    rows = [same, same, same, (None, "s", h("n"), h("n")), (5, "s", h("y"), h("z")), (None, None, h("m"), h("m"))]
    root, want = by_hand(rows, 2)
    tree, got = built(spark, rows, 2, 1)
    assert tree.root == root and got == want


def test_no_rows_no_root(spark):
    tree, got = built(spark, [], 16, 4096)
    assert tree.root is None and got == []


def test_nodes_name_their_parents(spark):
    tree, _ = built(spark, [(i, "s" if i < 30 else "t", h(str(i)), h(str(i))) for i in range(40)], 3, 5)
    nodes = {r.node: r for r in tree.nodes.collect()}
    assert [r.node for r in nodes.values() if r.parent is None] == ["1/0/"]
    for r in nodes.values():
        if r.parent:
            assert nodes[r.parent].children[32 * r.position : 32 * r.position + 32] == r.digest
    copies = tree.nodes.groupBy("node").count().collect()
    assert {r["count"] for r in copies} == {1, 2, 6, 8}  # of 3, 9, 27 or 30, and 40 leaves; five leaves share a copy


def test_leaf_digest_tells_missing_from_empty(spark):
    rows = spark.createDataFrame([(1, None, "é"), (1, "", "é"), (None, "-", None)], "a long, b string, c string")
    got = [bytes(r.d).hex() for r in rows.select(manifest.leaf_digest([F.col(c) for c in "abc"]).alias("d")).collect()]
    assert got == [h("1:1-2:é"), h("1:10:2:é"), h("-1:--")]


def test_manifest_query_finds_what_was_altered(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_merkle_manifest"](spark, ROOT).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    import zlib

    for r in rows:
        altered = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in docs[r.doc_id].text or "")
        assert r.verified != altered and (r.folded_root == r.root) == r.verified


# Centroids


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6), st.sampled_from([1, 3, 1000, 2**25, 2**40]))
def test_orchard_equals_all_distances(k, seed, reach):
    random = np.random.default_rng(seed)
    points = random.integers(-reach, reach + 1, (k, 3)).tolist()
    vectors = centroids._exact(random.integers(-reach, reach + 1, (50, 3)).astype(float))
    cluster, distance = centroids.Orchard(points).nearest(vectors)
    for vector, c, d in zip(vectors.tolist(), cluster.tolist(), distance.tolist()):
        assert (d, c) == min((sum((x - y) ** 2 for x, y in zip(vector, p)), i) for i, p in enumerate(points))


def clustered_by_hand(rows, k, rounds, size):
    kept = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    centers = [v for _, v in sorted((h(f"3:{'' if i is None else i}"), v) for i, v in kept)[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        for n, vs in own.items():
            centers[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)) for i, v in kept]
    fit = lambda x: x if x < 1 << 63 else None
    inertia = {n: fit(sum(d for _, d, m in found if m == n)) for n in range(len(centers))}
    every = fit(sum(d for _, d, _ in found))
    return [(i, n, fit(d), inertia[n], every, h(",".join(map(str, centers[n])))) for i, d, n in found]


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


@pytest.mark.parametrize("case", ["random", "ties", "huge", "few", "none"])
def test_clusters_equal_clusters_by_hand(spark, case):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=4).astype(np.float32).tolist()) for i in range(120)]
    rows += [(None, [0.5] * 4), (7, [0.25] * 4), (7, [0.25] * 4), (200, None), (201, []), (202, [1.0] * 3), (203, [1.0, None, 1.0, 1.0])]
    rows += [(204, [1.0, float("nan"), 1.0, 1.0]), (205, [float("inf"), 1.0, 1.0, 1.0])]
    if case == "ties":
        rows += [(300 + i, [float(i % 2), float(i // 2 % 2), 0.0, -0.0]) for i in range(60)]
    if case == "huge":
        rows += [(400 + i, np.array([3e38 * (-1) ** i, 1e20, 5e9 * i, 0.1], np.float32).tolist()) for i in range(6)]
    if case == "few":
        rows = rows[:2] + rows[120:]
    if case == "none":
        rows = rows[-6:]
    frame = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int")
    got = centroids.cluster_vectors(frame, "vec_id", "embedding", 5, 4, 4).collect()
    assert by_id(got) == by_id(clustered_by_hand(rows, 5, 4, 4))
