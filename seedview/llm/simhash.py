"""SimHash near-duplicates: fingerprints, a grid of bit counts, exact checks, components.

A fingerprint is cut into 32 segments of two bits; the bit counts of the segments are a point in 32
dimensions. The Manhattan distance of two points never exceeds the number of differing bits, so texts
within two bits lie within distance two. The 32 dimensions form four blocks; a distance of two touches
at most two of them, so two such points agree in at least two whole blocks. The grid therefore has six
cells per point, one for each pair of blocks, and a join on the cell finds every link. Candidates are
cut down by the Manhattan distance and then checked on all bits.

A cell with many fingerprints is not joined with itself. Its fingerprints are linked through their
one-bit neighbours instead: two fingerprints differ in at most two bits exactly if they share one of
the 65 strings within one bit of them, so the smallest fingerprint at each such string links all
others there. That is exact, and its rows grow with the fingerprints, not with their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seedview.llm.common import MOST_IDS_SENT, join_ids, words_of
from seedview.llm.graph import connected_components
from seedview.session import pin

SEED = 42
_CHUNK = 1 << 16
_BLOCKS = [0xFFFF << (16 * k) for k in range(4)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = zip(*(words[k:] for k in range(size)))
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(run), SEED) for run in runs), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _CHUNK):
        part = hashes[start : start + _CHUNK].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(text: Column, size: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(shingle_hashes(words_of(text), size)) for text in batch], dtype="int64")

    return of(text)


def segment_counts(fp: Column) -> Column:
    """The 32 bit counts of two-bit segments, packed at two bits each."""
    even = F.lit(0x5555555555555555)
    one, two = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return F.shiftleft(one.bitwiseAND(two), 1).bitwiseOR(one.bitwiseXOR(two))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed count vectors."""
    field = lambda v, k: F.shiftrightunsigned(v, 2 * k).bitwiseAND(F.lit(3).cast("long"))
    return reduce(lambda x, y: x + y, (F.abs(field(a, k) - field(b, k)) for k in range(32)))


def fingerprint_links(fps: DataFrame, crowd: int = 64) -> DataFrame:
    """(a, b) links that connect exactly the fingerprints within two bits of each other.

    ``fps`` has distinct values of ``fp``. Cells with up to ``crowd`` fingerprints give all their
    links, larger ones a connecting set of links.
    """
    counts = segment_counts(F.col("fp"))
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = [
        F.struct(F.lit(n).alias("cell"), counts.bitwiseAND(F.lit(_signed(_BLOCKS[i] | _BLOCKS[j]))).alias("key"))
        for n, (i, j) in enumerate(pairs)
    ]
    cells = fps.select("fp", F.explode(F.array(*keys)).alias("__c")).select("fp", "__c.*")
    sizes = cells.groupBy("cell", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = pin(cells.join(sizes, ["cell", "key"]), "simhash-cells")

    few = shared.where(F.col("size") <= crowd).select("cell", "key", "fp")
    a, b = F.col("x.fp"), F.col("y.fp")
    close = (manhattan(segment_counts(a), segment_counts(b)) <= 2) & (F.bit_count(a.bitwiseXOR(b)) <= 2)
    same = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.key") == F.col("y.key")) & (a < b)
    direct = few.alias("x").join(few.alias("y"), same & close).select(a.alias("a"), b.alias("b"))

    crowded = shared.where(F.col("size") > crowd).select("fp").distinct()
    masks = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << k)) for k in range(64)))
    near = crowded.select("fp", F.explode(masks).alias("__mask"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("__mask")).alias("middle"))
    least = near.groupBy("middle").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    through = near.join(least, "middle").select(F.col("fp").alias("a"), "b").where("a <> b")
    return direct.union(through).distinct()


def near_duplicate_classes(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row of (doc_id, text); other columns are ignored.

    Texts are linked if their fingerprints differ in at most two bits; ``component_id`` is the smallest
    id that links lead to. A missing or empty text has fingerprint zero and is linked like any other.
    Repeated rows stay repeated. A missing id is smaller than none: it is never a component's id
    unless the component has no other.
    """
    marked = pin(docs.select("doc_id", fingerprints(F.col("text"), size).alias("fp")), "simhash-fingerprints")
    first = pin(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-firsts")
    roots = connected_components(fingerprint_links(first.select("fp")))
    known = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = known.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


@dataclass(frozen=True)
class NearCopySettings:
    """``shingle``, ``similarity``  Jaccard similarity of word shingles from which texts are near copies.
    ``crowd``   texts with one shingle up to which all of them ask in the first round.
    ``sample``  one in so many documents is searched for common shingles; ``common`` of them make a shingle common.
    ``most_common``  common shingles known to the executors, at most. The last three touch the cost, not the result.
    """

    shingle: int = 5
    similarity: float = 0.8
    crowd: int = 8
    sample: int = 16
    common: int = 4
    most_common: int = 262_144


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; texts with fewer words have one, of all their words."""
    return np.unique(shingle_hashes(words_of(text), size)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def text_key(shingles: np.ndarray) -> int:
    """One number for each set of shingles."""
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))


def rarest(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles by (count, hash), so many that sets at least this similar have one in common."""
    if not len(shingles):
        return shingles
    rank = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, counts[at], 0)
    order = np.lexsort((shingles, rank))
    return shingles[order[: len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1]]


def _common_shingles(named: DataFrame, s: NearCopySettings) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many documents of a sample have, with their counts in it."""

    @F.pandas_udf("array<long>")
    def shingles(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingle_set(text, s.shingle) for text in batch])

    some = named.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(s.sample)) == 0)
    counts = some.select(F.explode(shingles("text")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") >= s.common).orderBy(F.desc("n"), "key").limit(s.most_common).collect()
    found = np.array(sorted((row["key"], row["n"]) for row in rows), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def near_copy_links(docs: DataFrame, s: NearCopySettings = NearCopySettings()) -> DataFrame:
    """(a, b) of ids whose texts are near copies, enough of them to connect each group of near copies.

    Texts with equal sets of shingles, or without words, are one text. Fingerprints of all texts, which go
    through the grid of :func:`fingerprint_links`, propose to each text the smallest id within two bits; each
    such pair is checked on all shingles.

    A second search finds what fingerprints miss. Distinct texts with the
    similarity have one of their rarest shingles in common (prefix filter), whatever their length, so each
    such shingle is a group that is searched for pairs in rounds. In a small group all texts ask, in a large
    one the first, and with every round eight times as many. A text is compared with the asker that it
    meets in most of its groups, with every round eight times as many; what it is not compared with now
    stays for later. Pairs that cannot have the similarity by length, or by the places of the shingles they
    share, are settled without their texts. Texts that links already connect are not compared, and groups
    that links connect end, so a large group of near copies costs about one comparison a text. The rounds
    end when every pair of every group is compared or connected.

    Two texts meet only in groups whose shingle can be the first that they share: what follows it in either
    must suffice for the similarity. In the shorter text that leaves about the rarest ninth of the shingles,
    so a group where no text has its shingle there holds no pair and is never searched.
    """
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    @F.pandas_udf("t long, fp long")
    def keys_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            hashes = [shingle_hashes(words_of(text), s.shingle) for text in batch]
            rows = [(text_key(np.unique(x).view(np.int64)), fingerprint(x)) for x in hashes]
            yield pd.DataFrame(rows, columns=["t", "fp"], dtype="int64")

    keys_of = keys_of.asNondeterministic()  # a struct of two, to be run once
    marked = pin(named.select("doc_id", keys_of("text").alias("k")).select("doc_id", "k.t", "k.fp"), "copy-texts")
    first = pin(marked.groupBy("t").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp")), "copy-firsts")
    same = marked.join(first, "t").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    distinct = join_ids(named, pin(first.select("first").distinct(), "copy-ids"), "first", "left_semi")
    compared = pin(_fingerprint_pairs(first), "copy-pairs")
    links = pin(_alike(compared, named, s), "copy-links")

    common, counts = _common_shingles(named, s)

    @F.pandas_udf("n int, keys array<long>")
    def prefix(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = [shingle_set(text, s.shingle) for text in batch]
            rows = [(len(x), rarest(x, common, counts, s.similarity)) for x in sets]
            yield pd.DataFrame(rows, columns=["n", "keys"])

    prefix = prefix.asNondeterministic()  # a struct of two, to be run once
    cut = distinct.select(F.col("doc_id").alias("id"), prefix("text").alias("p"))
    cut = pin(cut.select("id", "p.n", F.posexplode("p.keys").alias("at", "key")), "copy-keys")
    shared = cut.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = pin(cut.join(shared, "key", "left_semi"), "copy-members")
    # Of an id with several texts no bound is known.
    several = marked.groupBy("doc_id").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low < high")
    several = pin(several.select(F.col("doc_id").alias("id")), "copy-several")

    active, many = members.withColumn("root", F.col("id")), 1
    if not links.isEmpty():
        active = _rooted(active, links)
    # The similarity as a share of both texts' shingles, and of twice the shorter one's.
    share = s.similarity / (1 + s.similarity)
    while True:
        groups = active.groupBy("key").agg(
            F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.min("root").alias("first_root"), F.max("root").alias("last_root"),
            F.max(F.col("n") - F.col("at") >= 2 * share * F.col("n") - 1e-6).alias("early"),
        )
        # Groups that links connect end here, as do those that are no two texts' first in common.
        groups = groups.where("first_root < last_root and early").select("key", "size", "low")
        active = pin(active.select("key", "id", "n", "at", "root").join(groups, "key"), "copy-rounds")
        largest = active.agg(F.max("size")).first()[0]
        if largest is None:
            break
        chosen = F.pmod(F.xxhash64(F.lit(many), "id"), F.col("size")) < F.lit(many)
        asks = (F.col("size") <= s.crowd) | (F.col("id") == F.col("low")) | (F.lit(many > 1) & chosen)
        asking = active.where(asks).select(
            "key", F.col("id").alias("u"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("root").alias("top")
        )
        alike = F.least("n", "m") >= s.similarity * F.greatest("n", "m") - 1e-6
        left = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place"))
        alike = alike & (left >= share * (F.col("n") + F.col("m")) - 1e-6)
        met = active.join(asking, "key").where((F.col("root") != F.col("top")) & alike)
        met = met.groupBy(F.greatest("id", "u").alias("a"), F.least("id", "u").alias("b")).agg(F.count(F.lit(1)).alias("met"))
        met = met.join(compared, ["a", "b"], "left_anti")
        best = W.partitionBy("a").orderBy(F.desc("met"), "b")
        pairs = pin(met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= many).select("a", "b"), "copy-pairs")
        if pairs.isEmpty():
            if many >= largest:
                break
            many *= 8
            continue
        compared = compared.union(pairs)
        possible = pin(_possible(pairs, members, several, s), "copy-possible")
        found = pin(_alike(possible, named, s), "copy-links")
        if not found.isEmpty():
            links = links.union(found)
            active = _rooted(active, links)
        many *= 8
    return same.union(links)


def _fingerprint_pairs(first: DataFrame) -> DataFrame:
    """(a, b) of each id and the smallest one below it whose text's fingerprint lies within two bits."""
    least = first.groupBy("fp").agg(F.min("first").alias("least"))
    equal = first.join(least, "fp").select(F.col("first").alias("x"), F.col("least").alias("y"))
    side = lambda x, name: least.select(F.col("fp").alias(x), F.col("least").alias(name))
    near = fingerprint_links(least.select("fp")).join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    pairs = equal.union(near).where("x <> y")
    return pairs.groupBy(F.greatest("x", "y").alias("a")).agg(F.min(F.least("x", "y")).alias("b"))


def _rooted(active: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the root of their id's group, as the links go so far."""
    roots = connected_components(links).select(F.col("node").alias("id"), F.col("root").alias("__root"))
    return active.join(roots, "id", "left").withColumn("root", F.coalesce("__root", "root")).drop("__root")


def _possible(pairs: DataFrame, members: DataFrame, several: DataFrame, s: NearCopySettings) -> DataFrame:
    """The (a, b) of ``pairs`` that can have the similarity, judged by the shingles they share.

    All shingles stand in one order, so two texts can share, beyond those of their rarest ones that they do
    share, no more than what follows the last of these in either.
    """
    side = lambda x: members.select(F.col("id").alias(x), "key", F.col("at").alias(f"at_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "key"]).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("c"), *(F.max(c).alias(c) for c in ("at_a", "at_b", "n_a", "n_b"))
    )
    most = F.col("c") + F.least(F.col("n_a") - 1 - F.col("at_a"), F.col("n_b") - 1 - F.col("at_b"))
    least = s.similarity / (1 + s.similarity) * (F.col("n_a") + F.col("n_b"))
    known = both.where(most >= least - 1e-6).select("a", "b")
    unknown = [pairs.join(several, pairs[x] == several["id"], "left_semi") for x in ("a", "b")]
    return known.union(unknown[0]).union(unknown[1]).distinct()


def _alike(pairs: DataFrame, named: DataFrame, s: NearCopySettings) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts have the similarity, counted on all their shingles."""

    @F.pandas_udf("double")
    def similarity(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([jaccard(shingle_set(x, s.shingle), shingle_set(y, s.shingle)) for x, y in zip(one, two, strict=True)], dtype="float64")

    few = pairs.limit(MOST_IDS_SENT + 1).count() <= MOST_IDS_SENT
    wanted = F.broadcast(pairs) if few else pairs

    def texts(side: str) -> DataFrame:
        held = named.join(wanted, named["doc_id"] == wanted[side])
        return held.select(F.col("a"), F.col("b"), F.col("text").alias(f"text_{side}"))

    tried = texts("a").join(texts("b").hint("merge"), ["a", "b"])
    return tried.where(similarity("text_a", "text_b") >= s.similarity).select("a", "b").distinct()


def without_near_duplicates(docs: DataFrame, s: NearCopySettings = NearCopySettings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the smallest id of each group.

    Groups are connected by near copies, each link checked on all shingles. Rows with one id stay or
    go together; rows without id stay. Texts without words are near duplicates of each other.
    """
    return join_ids(docs, connected_components(near_copy_links(docs, s)), "node", "left_anti")
