"""Exact integer centroid clustering; nearest centroids by Orchard's search.

For each centroid the others are listed by distance. A vector starts at some centroid and walks its
list; as soon as it meets a centroid closer to itself it jumps to that one's list, and it stops when the
next entry lies strictly beyond twice its own distance: nothing from there on can be as close, by the
triangle inequality. Centroids seen are marked and not measured twice. All of it is integer
arithmetic on squared distances, so ties are real ties and go to the smaller number.

Vectors stay where they are: a round is one pass over them whose tasks give out sums per centroid and
component, added up map-side. Centroids are bounded by their number times the components, so they
go through the driver between rounds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedview.session import pin

#: Sums leave a task in pieces of so many bits, so that they add up exactly however large they are.
PIECE_BITS, PIECES = 40, 5
FOUND = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])


def _safe(size: int) -> int:
    """Components up to here keep four squared distances of ``size`` components inside 64 bits."""
    return math.isqrt((1 << 60) // max(size, 1)) // 2


def _exact(values: np.ndarray) -> np.ndarray:
    """Floors as 64-bit integers, or as Python's if squares of their differences could overflow."""
    values = np.floor(values)
    if values.size == 0 or np.abs(values).max() <= _safe(values.shape[1]):
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values.tolist()], dtype=object)


class Orchard:
    """Nearest centroids of many vectors at once."""

    def __init__(self, centroids: list[list[int]]):
        small = max((abs(x) for row in centroids for x in row), default=0) <= _safe(len(centroids[0]))
        self.points = np.array(centroids, dtype=np.int64 if small else object)
        k = len(centroids)
        self.apart = np.empty((k, k), self.points.dtype)  # squared distances between centroids
        for i in range(k):
            difference = self.points - self.points[i]
            self.apart[i] = (difference * difference).sum(axis=1)
        self.lists = np.array([[j for _, j in sorted((self.apart[i, j], j) for j in range(k) if j != i)] for i in range(k)], np.int64)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smallest on ties) and squared distance of every vector."""
        n, k = len(vectors), len(self.points)
        wide = object if object in (vectors.dtype, self.points.dtype) else np.int64

        def measure(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            difference = vectors[rows].astype(wide) - self.points[at]
            return (difference * difference).sum(axis=1)

        everything = np.arange(n)
        here = np.zeros(n, np.int64)
        best = measure(everything, here)
        place = np.zeros(n, np.int64)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        active = everything if k > 1 else everything[:0]
        while len(active):
            at, other = here[active], self.lists[here[active], place[active]]
            inside = ~(self.apart[at, other] > 4 * best[active]).astype(bool)
            active, other = active[inside], other[inside]
            fresh = ~seen[active, other]
            rows, tried = active[fresh], other[fresh]
            seen[rows, tried] = True
            found = measure(rows, tried)
            closer = ((found < best[rows]) | ((found == best[rows]) & (tried < here[rows]))).astype(bool)
            place[active] += 1
            moved = rows[closer]
            here[moved], best[moved], place[moved] = tried[closer], found[closer], 0
            active = active[place[active] < k - 1]
        return here, best


def _batch(batch: pd.Series) -> np.ndarray:
    return _exact(np.stack(batch.to_list()))


def _sums(kept: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty centroid: how many vectors are nearest to it, and the sums of their components."""
    search, size = Orchard(centroids), len(centroids[0])
    mask = (1 << PIECE_BITS) - 1

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = _batch(frame["__vector"])
            cluster, _ = search.nearest(vectors)
            rows = []
            for c in np.unique(cluster).tolist():
                own = vectors[cluster == c]
                rows.append((c, -1, len(own), *[0] * (PIECES - 1)))
                for d, total in enumerate(own.sum(axis=0).tolist()):
                    low = [total >> (PIECE_BITS * i) & mask for i in range(PIECES - 1)]
                    rows.append((c, d, *low, total >> (PIECE_BITS * (PIECES - 1))))
            yield pd.DataFrame(rows, columns=names)

    names = ["cluster", "component", *(f"p{i}" for i in range(PIECES))]
    schema = "cluster int, component int, " + ", ".join(f"p{i} long" for i in range(PIECES))
    added = kept.mapInPandas(partial, schema).groupBy("cluster", "component")
    rows = added.agg(*(F.sum(F.col(f"p{i}").cast("decimal(38,0)")).alias(f"p{i}") for i in range(PIECES))).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for row in rows:
        total = sum(int(row[f"p{i}"]) << (PIECE_BITS * i) for i in range(PIECES))
        count, sums = out.setdefault(row["cluster"], (0, [0] * size))
        if row["component"] < 0:
            out[row["cluster"]] = (total, sums)
        else:
            sums[row["component"]] = total
    return out


def _start(kept: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors whose ids hash lowest."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))), 256)
    rows = kept.select(hashed.alias("h"), "__vector").orderBy("h", "__vector").limit(k).collect()
    return [[math.floor(x) for x in row["__vector"]] for row in rows]


def cluster_vectors(
    table: DataFrame, id_column: str, vector: str, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3"
) -> DataFrame:
    """One row per kept vector: ``id_column``, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly ``size`` components, none missing or not finite; each component x
    becomes floor(scale * x). Rows are kept as they come: repeated ids and vectors give rows of their own, a
    missing id stays missing and hashes like the empty text, ties of the hash go by the vector. Other
    columns are ignored. With fewer than ``k`` vectors there are as many centroids; with none the result is
    empty. Components may be any 32-bit floats; distances and inertias beyond 64 bits are NULL.
    """
    values = F.col(vector).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = table.where((F.size(vector) == size) & finite)
    scaled = F.transform(values, lambda x: x * F.lit(float(scale)))
    kept = pin(chosen.select(F.col(id_column).alias("__id"), scaled.alias("__vector")), "vectors")
    centroids = _start(kept, k, seed)
    for _ in range(rounds if centroids else 0):
        for c, (count, sums) in _sums(kept, centroids).items():
            centroids[c] = [total // count for total in sums]
    search = Orchard(centroids) if centroids else None

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cluster, distance = search.nearest(_batch(batch))
            distances = [d if d < 1 << 63 else None for d in distance.tolist()]
            yield pd.DataFrame({"cluster": cluster, "distance": pd.array(distances, dtype="Int64")})

    assigned = pin(kept.select(F.col("__id").alias(id_column), found("__vector").alias("__f")).select(id_column, "__f.*"), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)")).try_cast("bigint")
    total = F.when(F.count("distance") == F.count(F.lit(1)), total)
    names = F.create_map(*(F.lit(x) for pair in enumerate(map(_hashed, centroids)) for x in pair)) if centroids else None
    clusters = assigned.groupBy("cluster").agg(total.alias("cluster_inertia"))  # one row per centroid
    return assigned.join(F.broadcast(clusters), "cluster").select(
        id_column,
        "cluster",
        "distance",
        "cluster_inertia",
        F.lit(assigned.agg(total).first()[0]).cast("bigint").alias("inertia"),
        (names[F.col("cluster")] if centroids else F.lit(None).cast("string")).alias("centroid_sha256"),
    )


def _hashed(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
