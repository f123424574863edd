"""Removal of byte strings that an earlier document already has, with suffix arrays per shard.

A string of ``LENGTH`` bytes counts as repeated if it also starts in a document with a smaller id.

1.  Anchors. In every window of ``LENGTH`` bytes the 16-byte string with the smallest hash is an anchor
    (the leftmost of equals), so equal windows have equal anchors at equal places. About one byte in 17
    is an anchor. Its context are the 84 bytes that all windows with this anchor lie in.
2.  Buckets. Anchors are dealt by hash; what travels is a few bytes of hashes each. An anchor whose whole
    context is in an earlier document is repeated with all its context. A window reaches 17 bytes beyond
    its anchor on one side at least, so if another document has the anchor with the 17 bytes on one side,
    the context goes on to a shard, once for each distinct context. Anchors alone are shared the more
    often by chance the more texts there are, which is why they don't suffice. A batch of documents settles
    repeats inside it before anything is sent, so a common line is sent once a batch.
3.  Shards. The contexts with one anchor meet in one shard. Its suffix array is built by Larsson-Sadakane
    refinement (groups that are still equal are sorted by the rank of what follows, twice as far each
    round), neighbours get their common prefixes by Kasai's scan, and runs of prefixes of at least
    ``LENGTH`` are one string, of which all but the earliest document's are repeated.
4.  An anchor with very many different contexts is spread over several shards. Each sends its distinct
    strings, sorted, and the sorted lists of all shards are merged by binary search.

Contexts are compared by 96 bits of hash in step 2 and byte by byte in step 3; equal hashes of one side
only bring a context to step 3. Texts cross the
network twice at most, and no document, bucket or shard needs another one's text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedview.session import pin

LENGTH = 50
ANCHOR = 16
SIDE = LENGTH - ANCHOR
CONTEXT = 2 * SIDE + ANCHOR
HALF = SIDE // 2

_PLACE = np.uint64(28)
_SEGMENT = 1 << 21
_ROWS = 1 << 16
_ODD = np.random.default_rng(LENGTH).integers(1 << 62, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class RepeatSettings:
    """Bytes of text per ``bucket``, contexts per ``shard``, contexts from which one anchor is ``crowded``."""

    bucket: int = 32 << 20
    shard: int = 30_000
    crowded: int = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[14]
    return x ^ (x >> np.uint64(29))


def _anchor_hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return _mix(low * _ODD[0] + _mix(high * _ODD[1]))


def anchor_places(data: bytes | np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Places of the anchors of all windows of a byte string, in pieces that overlap by a window.

    ``whole`` tells at which bytes a window starts that counts.
    """
    found = []
    for start in range(0, max(1, len(data) - LENGTH + 1), _SEGMENT):
        piece = data[start : start + _SEGMENT + LENGTH - 1]
        if len(piece) < LENGTH:
            continue
        words = np.ndarray((len(piece) - 7,), "<u8", buffer=piece, strides=(1,)).copy()
        hashes = _anchor_hash(words[:-8], words[8:])
        least = (hashes >> _PLACE << _PLACE) | np.arange(len(hashes), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, SIDE + 1 - 32):
            least = np.minimum(least[:-step], least[step:])
        least = least if whole is None else least[whole[start : start + len(least)]]
        mark = np.zeros(len(piece), bool)
        mark[(least & np.uint64((1 << 28) - 1)).astype(np.int64)] = True
        found.append(np.nonzero(mark)[0] + start)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Texts:
    """Several byte strings in one buffer, with zeros around each, and rows of context around places in them."""

    def __init__(self, texts: list[bytes]) -> None:
        gap = bytes(CONTEXT)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size + CONTEXT) - self.size
        self.data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and place of every anchor."""
        edge = np.zeros(len(self.data) + 1, np.int8)
        long = self.size >= LENGTH
        edge[self.start[long]] = 1
        edge[(self.start + self.size - LENGTH + 1)[long]] = -1
        at = anchor_places(self.data, np.cumsum(edge[:-1], dtype=np.int8).view(bool))
        text = np.searchsorted(self.start, at, "right") - 1
        return text, at - self.start[text]

    def contexts(self, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A row of ``CONTEXT`` bytes for each place; zeros where the text has none."""
        return np.lib.stride_tricks.sliding_window_view(self.data, CONTEXT)[self.start[text] + place - SIDE]

    def room(self, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window (offset in the context) that lie inside the text."""
        low = np.maximum(SIDE - place, 0)
        high = np.minimum(self.size[text] - place + SIDE - LENGTH, SIDE)
        return low, high


def _words_hash(*columns: np.ndarray) -> np.ndarray:
    """Hash of rows of bytes."""
    width = sum(c.shape[1] for c in columns)
    words = np.zeros((len(columns[0]), -(-width // 8) * 8), np.uint8)
    np.concatenate(columns, axis=1, out=words[:, :width])
    words = words.view("<u8")
    return _mix((_mix(words * _ODD[2 : 2 + words.shape[1]])).sum(1, dtype=np.uint64))


def _anchors_of(rows: np.ndarray) -> np.ndarray:
    """Anchor hashes of context rows."""
    middle = np.ascontiguousarray(rows[:, SIDE : SIDE + ANCHOR]).view("<u8")
    return _anchor_hash(middle[:, 0], middle[:, 1])


def _sides(rows: np.ndarray) -> np.ndarray:
    """Two hashes of context rows: of what is before and of what is after the anchor within ``HALF`` bytes.

    Equal windows with this anchor have the bytes of one side in common at least.
    """
    sides = (rows[:, SIDE - HALF : SIDE], rows[:, SIDE + ANCHOR : SIDE + ANCHOR + HALF])
    return np.column_stack([_words_hash(side) for side in sides]).astype(np.uint16)


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about ``_SEGMENT`` bytes of text."""
    for frame in frames:
        part = (frame["data"].map(len).cumsum() // _SEGMENT).to_numpy()
        for k in np.unique(part):
            yield frame[part == k].reset_index(drop=True)


def _firsts(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each row has the smallest ``doc`` of its ``key``."""
    order = np.argsort(key, kind="stable")
    starts = np.nonzero(np.diff(key[order], prepend=key[order][:1] ^ np.uint64(1)) != 0)[0]
    least = np.minimum.reduceat(doc[order], starts)
    first = np.empty(len(key), bool)
    first[order] = doc[order] == np.repeat(least, np.diff(np.append(starts, len(key))))
    return first


def _meet(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether rows of several documents have the ``key`` of each row."""
    order = np.argsort(key)
    new = np.append(True, np.diff(key[order]) != 0)
    starts = np.nonzero(new)[0]
    several = np.minimum.reduceat(doc[order], starts) != np.maximum.reduceat(doc[order], starts)
    meet = np.empty(len(key), bool)
    meet[order] = several[np.cumsum(new) - 1]
    return meet


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.diff(values.astype(np.int64), prepend=0).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.int64))


_ANCHORS = "bucket int, docs binary, texts binary, counts binary, places binary, anchors binary, contexts binary, sides binary, settled binary"


def _send_anchors(buckets: int):
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _batches(frames):
            texts = Texts(list(frame["data"]))
            text, place = texts.anchors()
            if not len(place):
                continue
            anchor, context = np.empty(len(place), np.uint64), np.empty(len(place), np.uint64)
            sides = np.empty((len(place), 2), np.uint16)
            for k in range(0, len(place), _ROWS):
                s = slice(k, k + _ROWS)
                rows, room = texts.contexts(text[s], place[s]), texts.room(text[s], place[s])
                anchor[s], sides[s] = _anchors_of(rows), _sides(rows)
                context[s] = _words_hash(rows, np.column_stack(room).astype(np.uint8))
            doc, code = frame["doc_id"].to_numpy(np.int64), frame["code"].to_numpy(np.int64)
            first = _firsts(_mix(anchor) ^ context, doc[text])
            bucket = ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.nonzero(np.diff(edges))[0]:
                at = order[edges[b] : edges[b + 1]]
                known, counts = np.unique(text[at], return_counts=True)
                sent = at[first[at]]
                rows.append(
                    (
                        b,
                        _packed(doc[known]),
                        _packed(code[known]),
                        _packed(counts),
                        _packed(place[at]),
                        anchor[sent].astype(np.uint32).tobytes(),
                        context[sent].tobytes(),
                        sides[sent].tobytes(),
                        np.packbits(~first[at]).tobytes(),
                    )
                )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ANCHORS.split(", ")])

    return send


#: What is said of an anchor: place * 4 plus one of these.
REPEATED, COMPARE, CROWDED = 0, 1, 2


def _judge_bucket(crowded: int):
    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        doc, code, place, settled = [], [], [], []
        for row in frame.itertuples():
            counts = _unpacked(row.counts)
            doc.append(np.repeat(_unpacked(row.docs), counts))
            code.append(np.repeat(_unpacked(row.texts), counts))
            place.append(_unpacked(row.places))
            settled.append(np.unpackbits(np.frombuffer(row.settled, np.uint8))[: len(place[-1])].astype(bool))
        doc, code, place, settled = (np.concatenate(x) for x in (doc, code, place, settled))
        anchor = np.frombuffer(b"".join(frame["anchors"]), np.uint32)
        context = np.frombuffer(b"".join(frame["contexts"]), np.uint64)
        sides = np.frombuffer(b"".join(frame["sides"]), np.uint16).reshape(-1, 2)
        rows = np.nonzero(~settled)[0]
        state = np.where(settled, REPEATED, -1)
        if len(rows):
            order = np.lexsort((doc[rows], context, anchor))
            a, c, d = anchor[order], context[order], doc[rows][order]
            new_a = np.append(True, a[1:] != a[:-1])
            new_c = new_a | np.append(True, c[1:] != c[:-1])
            of_a, starts = np.cumsum(new_a) - 1, np.nonzero(new_a)[0]
            shared = (np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts))[of_a]
            least = np.minimum.reduceat(d, np.nonzero(new_c)[0])[np.cumsum(new_c) - 1]
            repeated = shared & (least < d)
            state[rows[order[repeated]]] = REPEATED
            left = np.nonzero(shared & ~repeated)[0]
            key, d = a[left].astype(np.uint64) << np.uint64(16), d[left]
            near = np.zeros(len(left), bool)
            for side in sides[order[left]].T if len(left) else ():
                near |= _meet(key | side, d)
            left = left[near]
            if len(left):
                new_a, new_c = np.append(True, np.diff(a[left]) != 0), np.append(True, np.diff(c[left]) != 0)
                kinds = np.add.reduceat((new_a | new_c).astype(np.int64), np.nonzero(new_a)[0])[np.cumsum(new_a) - 1]
                state[rows[order[left]]] = np.where(kinds > crowded, CROWDED, COMPARE)
        told = state >= 0
        return pd.DataFrame({"doc_id": doc[told], "code": code[told], "said": place[told] * 4 + state[told]})

    return judge


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order.

    Larsson-Sadakane: sort by eight bytes; then sort the groups that are still equal by the rank of
    the suffix ``h`` further on, double ``h``, and leave groups of one alone.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", buffer=padded.tobytes(), strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    new = np.append(new, True)
    at, h = np.nonzero(~(new[:-1] & new[1:]))[0], 8
    while len(at):
        suffix = order[at]
        # The zeros after the end are no bytes: what ends within h bytes comes first, the shortest before all.
        further = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)] + h + 1, n - suffix)
        key = rank[suffix] * (n + h + 2) + further
        inner = np.argsort(key)
        order[at], key = suffix[inner], key[inner]
        new[at] = np.append(True, key[1:] != key[:-1])
        rank[order[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
        at = at[~(new[at] & new[at + 1])]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lane: int) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix with the one before it in ``order``.

    Kasai: the prefix at a place is at least the one at the place before, less one. The scan runs along
    all stretches of ``lane`` bytes side by side.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    lcp = np.zeros(n, np.int64)
    starts, h = np.arange(0, n, lane), np.zeros(-(-n // lane), np.int64)
    for step in range(lane):
        i = starts + step
        i = i[i < n]
        h = np.where(before[i] >= 0, np.maximum(h[: len(i)] - 1, 0), 0)
        going = np.nonzero(before[i] >= 0)[0]
        while len(going):
            x, y = i[going] + h[going], before[i[going]] + h[going]
            fits = (h[going] < most) & (x < n) & (y < n)
            going, x, y = going[fits], x[fits], y[fits]
            going = going[data[x] == data[y]]
            h[going] += 1
        lcp[i] = h
    by_order = lcp[order]
    by_order[0] = 0
    return by_order


_SENT = "shard int, crowded boolean, docs binary, texts binary, places binary, lows binary, highs binary, rows binary"
_RUNS = "doc_id long, code long, first long, last long"


def _send_contexts(shards: int, spread: int):
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _batches(frames):
            said = [np.asarray(x, np.int64) for x in frame["said"]]
            texts, text = Texts(list(frame["data"])), np.repeat(np.arange(len(said)), [len(x) for x in said])
            said = np.concatenate(said)
            keep = said % 4 != REPEATED
            text, place, crowded = text[keep], said[keep] // 4, said[keep] % 4 == CROWDED
            if not len(place):
                continue
            rows, (low, high) = texts.contexts(text, place), texts.room(text, place)
            doc, code = frame["doc_id"].to_numpy(np.int64)[text], frame["code"].to_numpy(np.int64)[text]
            anchor = _anchors_of(rows)
            dealt = _mix(code.astype(np.uint64) + place.astype(np.uint64) * _ODD[3])
            shard = np.where(crowded, shards + dealt % np.uint64(spread), anchor % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            ids, starts = np.unique(shard[order], return_index=True)
            out = []
            for k, at in zip(ids, np.split(order, starts[1:]), strict=True):
                blobs = (doc[at], code[at], place[at], low[at].astype(np.uint8), high[at].astype(np.uint8), rows[at])
                out.append((k, k >= shards, *(x.tobytes() for x in blobs)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SENT.split(", ")])

    return send


@dataclass
class Shard:
    """Contexts of one shard, and which of their windows are equal."""

    doc: np.ndarray
    code: np.ndarray
    place: np.ndarray
    rows: np.ndarray
    window: np.ndarray
    group: np.ndarray

    @staticmethod
    def of(frame: pd.DataFrame) -> "Shard":
        load = lambda name, kind: np.frombuffer(b"".join(frame[name]), kind)
        doc, code, place = (load(name, np.int64) for name in ("docs", "texts", "places"))
        low, high, rows = load("lows", np.uint8), load("highs", np.uint8), load("rows", np.uint8)
        order = suffix_array(rows)
        lcp = common_prefixes(rows, order, LENGTH, CONTEXT)
        owner, offset = order // CONTEXT, order % CONTEXT
        valid = (offset >= low[owner]) & (offset <= high[owner])
        group = np.cumsum(lcp < LENGTH)[valid]
        return Shard(doc, code, place, rows, order[valid], group)

    @property
    def owner(self) -> np.ndarray:
        return self.window // CONTEXT

    def later(self) -> np.ndarray:
        """Whether each window's string is in an earlier document of the shard. Windows are in order of their groups."""
        doc = self.doc[self.owner]
        new = np.append(True, np.diff(self.group) != 0)
        return doc > np.minimum.reduceat(doc, np.nonzero(new)[0])[np.cumsum(new) - 1]

    def runs(self, repeated: np.ndarray) -> pd.DataFrame:
        """Byte ranges that the repeated windows cover, in their documents."""
        window = np.sort(self.window[repeated])
        if not len(window):
            return _run_frame([], [], [], [])
        owner = window // CONTEXT
        first = np.append(True, (window[1:] != window[:-1] + 1) | (owner[1:] != owner[:-1]))
        last = np.append(first[1:], True)
        begin, end, owner = window[first] % CONTEXT, window[last] % CONTEXT, owner[first]
        base = self.place[owner] - SIDE
        return _run_frame(self.doc[owner], self.code[owner], base + begin, base + end + LENGTH)


def _run_frame(doc, code, first, last) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": doc, "code": code, "first": first, "last": last}, dtype="int64")


def _compare_shard(frame: pd.DataFrame) -> pd.DataFrame:
    shard = Shard.of(frame)
    if not len(shard.window):
        return _run_frame([], [], [], [])
    return shard.runs(shard.later())


_LISTS = "part int, strings binary, docs binary, texts binary, places binary"


def _list_shard(parts: int):
    """Distinct strings of a crowded shard, sorted, by part; strings that the shard repeats come as settled rows (part -1)."""

    def lists(frame: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.of(frame)
        if not len(shard.window):
            return pd.DataFrame(columns=[c.split()[0] for c in _LISTS.split(", ")])
        later = shard.later()
        settled = shard.runs(later)
        out = [(-1, settled["last"].to_numpy().tobytes(), *(settled[c].to_numpy().tobytes() for c in ("doc_id", "code", "first")))]
        window = shard.window[~later]
        owner = window // CONTEXT
        strings = shard.rows[window[:, None] + np.arange(LENGTH)]
        digests = b"".join(hashlib.blake2b(string.tobytes(), digest_size=16).digest() for string in strings)
        strings = np.frombuffer(digests, ">u8").reshape(-1, 2)
        part = (strings[:, 0] % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((strings[:, 1], strings[:, 0], part))
        for k in np.unique(part):
            at = order[part[order] == k]
            places = shard.place[owner[at]] - SIDE + window[at] % CONTEXT
            out.append((k, strings[at].tobytes(), shard.doc[owner[at]].tobytes(), shard.code[owner[at]].tobytes(), places.tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _LISTS.split(", ")])

    return lists


def _merge_lists(frame: pd.DataFrame) -> pd.DataFrame:
    """Merge the shards' sorted lists by binary search; all but the earliest document's strings are repeated."""
    if frame["part"].iloc[0] < 0:
        doc, code, first, last = (np.frombuffer(b"".join(frame[c]), np.int64) for c in ("docs", "texts", "places", "strings"))
        return _run_frame(doc, code, first, last)
    values = [np.frombuffer(b, ">u8").reshape(-1, 2) for b in frame["strings"]]
    docs = [np.frombuffer(b, np.int64) for b in frame["docs"]]
    high = np.unique(np.concatenate([v[:, 0] for v in values]))
    # Strings are told apart by both halves; the first half finds the place, the second the string in it.
    both = np.unique(np.concatenate(values), axis=0)
    start = np.searchsorted(both[:, 0], high)
    earliest = np.full(len(both), np.iinfo(np.int64).max)
    spots = []
    for value, doc in zip(values, docs, strict=True):
        spot = start[np.searchsorted(high, value[:, 0])]
        while (wrong := both[spot, 1] != value[:, 1]).any():
            spot = spot + wrong
        np.minimum.at(earliest, spot, doc)
        spots.append(spot)
    spot, doc = np.concatenate(spots), np.concatenate(docs)
    code, place = (np.frombuffer(b"".join(frame[c]), np.int64) for c in ("texts", "places"))
    late = doc > earliest[spot]
    return _run_frame(doc[late], code[late], place[late], place[late] + LENGTH)


def cut(data: bytes, ranges: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text without the byte ranges, the bytes removed and the number of maximal removed runs."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, np.clip(ranges[:, 0], 0, len(data)), 1)
    np.add.at(edge, np.clip(ranges[:, 1], 0, len(data)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _ranges(said, firsts, lasts) -> np.ndarray:
    places = [] if said is None else [x // 4 for x in said if x % 4 == REPEATED]
    whole = np.array(places, np.int64)[:, None] + np.array([-SIDE, ANCHOR + SIDE])
    parts = np.column_stack([firsts, lasts]).astype(np.int64) if firsts is not None else np.zeros((0, 2), np.int64)
    return np.concatenate([whole.reshape(-1, 2), parts])


def remove_repeats(docs: DataFrame, s: RepeatSettings = RepeatSettings(), texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the bytes ``kept`` of every row.

    ``docs`` has doc_id and text; other columns are ignored. Texts are UTF-8 bytes, a missing text is
    empty. Rows with one id are not earlier than each other; repeated rows get equal results. A row
    without id is kept whole and makes no other row repeat.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    keyed = keyed.withColumn("code", F.xxhash64("data"))
    size = keyed.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    named = keyed.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "code", "data")
    anchors = named.mapInPandas(_send_anchors(max(8, -(-size // s.bucket))), _ANCHORS)
    judged = anchors.groupBy("bucket").applyInPandas(_judge_bucket(s.crowded), "doc_id long, code long, said long")
    judged = pin(judged, "repeat-anchors")
    counts = judged.agg(
        F.count_if(F.col("said") % 4 == COMPARE).alias("compare"), F.count_if(F.col("said") % 4 == CROWDED).alias("crowded")
    ).first()
    shards, spread = (max(1, -(-counts[k] // s.shard)) for k in ("compare", "crowded"))

    said = judged.groupBy("doc_id", "code").agg(F.collect_list("said").alias("said"))
    told = keyed.join(said, ["doc_id", "code"], "left")
    asked = told.where(F.exists("said", lambda x: x % 4 != REPEATED)).select("doc_id", "code", "data", "said")
    sent = asked.mapInPandas(_send_contexts(shards, spread), _SENT)
    runs = sent.where("not crowded").drop("crowded").groupBy("shard").applyInPandas(_compare_shard, _RUNS)
    if counts["crowded"]:
        lists = sent.where("crowded").drop("crowded").groupBy("shard").applyInPandas(_list_shard(4 * spread), _LISTS)
        settled = F.when(F.col("part") < 0, F.pmod(F.xxhash64("docs"), F.lit(4 * spread)) - 4 * spread).otherwise(F.col("part"))
        merged = lists.withColumn("part", settled.cast("int")).groupBy("part").applyInPandas(_merge_lists, _RUNS)
        runs = runs.union(merged)
    ranges = runs.groupBy("doc_id", "code").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, data, *ranges in frame[["doc_id", "data", "said", "firsts", "lasts"]].itertuples(index=False):
                left, removed, n = cut(data, _ranges(*ranges))
                row = (doc, len(data), removed, n, hashlib.sha256(left).hexdigest())
                rows.append((*row, left) if texts else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return told.join(ranges, ["doc_id", "code"], "left").mapInPandas(finish, schema)
