"""Merkle manifest of a data set: trees per group under one root, proofs by a recursive climb.

Every row is a leaf. Leaves of a group are put in order and every ``fanout`` consecutive nodes become
one, level by level, until one is left; these group roots become one root in the same way. Built
levels are stored as rows that name their parent, and proofs are a recursive query over those rows:
each leaf ascends from parent to parent and folds its own, perhaps altered, digest with the siblings
it meets. A leaf meets one row per level, so building and climbing cost rows times levels.

* Order inside a group needs no group in one task: rows are range-partitioned by (group, id, digest),
  and each knows its rank from its place in its partition and the counts of the partitions before.
* Rows high in the tree are met by all leaves below them. They are stored once per ``share`` leaves,
  and a leaf asks for the copy its own name hashes to, so no join key has more than about ``share`` rows.
* Digests are kept as bytes and hashed as hex. A step of the climb gives out where it passed (parent and
  position). Siblings are most of what a proof weighs, and leaves of one run differ only in those of the
  run itself: the bytes are appended along the path of each run's leading leaf and joined to the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedview.operators.keys import PART_BITS
from seedview.session import pin

#: Name of the tree above the group roots; names of the groups' trees start with "-" or "=".
TOP = ""
SIZE = 32
"""Bytes of a digest."""
#: (group, partition) pairs that are sent to every executor at most; more are joined by a shuffle.
MOST_STARTS_SENT = 100_000


@dataclass(frozen=True)
class Manifest:
    """``leaves``: one row per input row: node, parent link, doc_id, digest and the digest to check.
    One leaf of each run of siblings leads. ``nodes``: one row per inner node and copy: node, parent link, digest and those of its children.
    ``root``: the root's digest in hex, ``None`` without rows."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def hashed(data: Column) -> Column:
    """SHA-256, as bytes."""
    return F.unhex(F.sha2(data.cast("binary"), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of a row: each value with its length in UTF-8 bytes before it, ``-`` if it is missing."""
    texts = [c.cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return hashed(F.concat(*fields))


def number_in_groups(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their rank ``at`` (from 0) inside the group and the group's size ``n``.

    ``order`` must tell apart all rows that differ. Rows are written once, range-partitioned by
    (group, order); a table with one row per group and partition turns places into ranks.
    """
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    pinned = pin(ordered.withColumn("__place", F.monotonically_increasing_id()), name)
    part = F.shiftright("__place", PART_BITS)
    counts = pinned.groupBy(group, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    whole = Window.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__part")) - F.col("__n")
    starts = pin(
        counts.select(
            F.col(group).alias("__of"),
            F.col("__part").alias("__in"),
            (before - F.col("__first")).alias("__shift"),
            F.sum("__n").over(whole).alias("n"),
        ),
        f"{name}-starts",
    )
    starts = F.broadcast(starts) if starts.limit(MOST_STARTS_SENT + 1).count() <= MOST_STARTS_SENT else starts
    joined = pinned.join(starts, (F.col(group) == F.col("__of")) & (part == F.col("__in")))
    return joined.select(*rows.columns, (F.col("__place") + F.col("__shift")).alias("at"), "n")


def _named(level: DataFrame, k: int, fanout: int) -> DataFrame:
    """Names and parent links of a tree's nodes on level ``k``; a tree's last node has no parent."""
    name = lambda k, at: F.concat_ws("/", F.lit(str(k)), at.cast("string"), F.col("tree"))
    return level.withColumns(
        {
            "node": name(k, F.col("at")),
            "parent": F.when(F.col("n") > 1, name(k + 1, F.floor(F.col("at") / fanout))),
            "position": F.when(F.col("n") > 1, (F.col("at") % fanout).cast("int")),
        }
    )


def _grow(level: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """The levels above ``level`` (tree, at, n nodes here, digest, leaves below), each written once.

    They also hold their children's digests, one after the other. Ends when every tree has one node.
    """
    levels = []
    while level.where("n > 1").limit(1).count():
        runs = (
            level.where("n > 1")
            .groupBy("tree", F.floor(F.col("at") / fanout).alias("at"), F.ceil(F.col("n") / fanout).alias("n"))
            .agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("c"), F.sum("leaves").alias("leaves"))
        )
        children = F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["digest"])), ""))
        level = runs.select("tree", "at", "n", "leaves", children.alias("children"))
        level = pin(level.withColumn("digest", hashed(hex_of(F.col("children")))), f"{name}-{len(levels) + 1}")
        levels.append(level)
    return levels


def build_manifest(rows: DataFrame, fanout: int = 16, share: int = 4096) -> Manifest:
    """Trees over ``rows`` (doc_id, group, digest, checked).

    ``digest`` is the leaf's, ``checked`` the one that its proof starts from. A missing group comes
    before all others and is not the empty one. Rows without id come first in their group; rows with
    one id stand in the order of their digests, and rows alike in all are leaves of their own. A lone
    leaf is its group's root, and a lone group's root is the root. Without rows there is no root.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("-"))
    rows = rows.select(tree.alias("tree"), "doc_id", "digest", "checked")
    ranked = number_in_groups(rows, "tree", ["doc_id", "digest", "checked"], "leaves")
    leaves = pin(ranked.withColumn("leaves", F.lit(1).cast("long")), "leaf-ranks")
    levels = [leaves, *_grow(leaves, fanout, "level")]

    roots = reduce(DataFrame.union, [level.where("n = 1").select("tree", "digest", "leaves") for level in levels])
    roots = roots.select(F.lit(TOP).alias("top"), F.col("tree").alias("of"), "digest", "leaves")
    groups = number_in_groups(roots, "top", ["of"], "groups").withColumnRenamed("top", "tree")
    groups = pin(_named(groups, 0, fanout).drop("node"), "group-ranks")
    tops = _grow(groups, fanout, "top")
    root = (tops[-1] if tops else groups).select(hex_of(F.col("digest")).alias("root")).first()

    links = groups.select(F.col("of"), F.col("parent").alias("__parent"), F.col("position").alias("__position"))

    def hung(level: DataFrame, k: int) -> DataFrame:
        """A level of the groups' trees whose last nodes hang below the tree of the groups."""
        named = _named(level, k, fanout)
        inner = named.where("n > 1").withColumn("is_group", F.lit(False))
        outer = named.where("n = 1").join(links, F.col("tree") == F.col("of"))
        outer = outer.withColumns({"parent": F.col("__parent"), "position": F.col("__position"), "is_group": F.lit(True)})
        return inner.unionByName(outer.select(inner.columns))

    inner = [hung(level, k) for k, level in enumerate(levels) if k]
    inner += [_named(level, k, fanout).withColumn("is_group", F.lit(False)) for k, level in enumerate(tops, 1)]
    copies = F.ceil(F.col("leaves") / share)
    columns = ["node", "parent", "position", "digest", "children", "is_group", copies.alias("copies")]
    empty = leaves.limit(0).withColumn("children", F.col("digest"))
    nodes = reduce(DataFrame.union, [f.select(columns) for f in inner or [hung(empty, 0)]])
    nodes = pin(nodes, "nodes")

    above = nodes.where("copies > 1").select(F.col("node").alias("__above"), F.col("copies").alias("__copies"))
    counted = lambda f: f.join(above, F.col("parent") == F.col("__above"), "left").withColumn(
        "of_copies", F.coalesce("__copies", F.lit(1).cast("long"))
    ).drop("__above", "__copies")
    stored = counted(nodes).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    hanging = hung(leaves, 0).select("node", "parent", "position", "is_group", "doc_id", "digest", "checked")
    lone = counted(hanging.where("is_group"))  # others hang below a node with at most fanout leaves
    first = lone.groupBy("parent").agg(F.min("node").alias("__first")).withColumnRenamed("parent", "__run")
    lone = lone.join(first, F.col("parent") == F.col("__run"), "left").drop("__run")
    lone = lone.withColumn("leads", F.coalesce(F.col("node") == F.col("__first"), F.lit(True))).drop("__first")
    most = hanging.where("NOT is_group").withColumns({"of_copies": F.lit(1).cast("long"), "leads": F.col("position") == 0})
    return Manifest(most.unionByName(lone), pin(stored.drop("copies"), "node-copies"), root["root"] if root else None)


_CLIMB = """
WITH RECURSIVE climb (leaf, step, parent, position, copy, leads, folded, subroot) AS (
  SELECT node, 0, parent, position, pmod(xxhash64(node), of_copies), leads, checked, CAST(NULL AS BINARY)
  FROM {leaves}
  UNION ALL
  SELECT c.leaf, c.step + 1, n.parent, n.position, pmod(xxhash64(c.leaf), n.of_copies), c.leads,
    unhex(sha2(CAST(lower(hex(concat(
      substring(n.children, 1, 32 * c.position), c.folded, substring(n.children, 32 * c.position + 33)
    ))) AS BINARY), 256)),
    CASE WHEN n.is_group AND c.leads THEN n.digest END
  FROM climb c JOIN {nodes} n ON n.node = c.parent AND n.copy = c.copy
)
SELECT leaf, step, parent, position, copy, leads, subroot, CASE WHEN parent IS NULL THEN folded END AS folded FROM climb
"""

_PASSED = """
SELECT c.leaf, c.step, c.subroot, CASE WHEN c.step = 0 THEN c.parent END AS run,
  CASE WHEN c.step = 0 THEN n.children END AS children,
  CASE WHEN c.step > 0 THEN concat(substring(n.children, 1, 32 * c.position), substring(n.children, 32 * c.position + 33)) END AS others
FROM {climb} c LEFT JOIN {nodes} n ON n.node = coalesce(c.parent, c.leaf) AND n.copy = c.copy
WHERE c.leads
"""


def prove(manifest: Manifest) -> DataFrame:
    """One row per leaf: leaf name, doc_id, digest, subroot, siblings' digests in order, folded root.

    ``siblings`` goes level by level from the leaf to the root and left to right, as bytes; ``folded`` is
    what the checked digest becomes on the way. Without rows the result is empty.
    """
    spark = manifest.leaves.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # leaves times levels; the depth stays limited
    climb = pin(spark.sql(_CLIMB, leaves=manifest.leaves, nodes=manifest.nodes), "climb")

    passed = spark.sql(_PASSED, climb=climb, nodes=manifest.nodes)
    path = F.sort_array(F.collect_list(F.struct("step", "others")))
    runs = passed.groupBy("leaf").agg(path.alias("path"), *(F.max(c).alias(c) for c in ("run", "children", "subroot")))
    upper = F.unhex(F.array_join(F.transform("path", lambda x: F.coalesce(F.hex(x["others"]), F.lit(""))), ""))
    runs = runs.where("run IS NOT NULL").select("run", "children", upper.alias("upper"), F.col("subroot").alias("__subroot"))

    folded = climb.where("parent IS NULL").select(F.col("leaf").alias("__leaf"), "folded")
    proofs = manifest.leaves.join(folded, F.col("node") == F.col("__leaf")).join(runs, F.col("parent") == F.col("run"), "left")
    place = F.col("position") * SIZE
    own = [F.substring("children", F.lit(1), place), F.substring("children", place + SIZE + 1, F.lit(1 << 30))]
    return proofs.select(
        F.col("node").alias("leaf"),
        "doc_id",
        "digest",
        F.when(F.col("is_group"), F.col("digest")).otherwise(F.col("__subroot")).alias("subroot"),
        F.coalesce(F.concat(*own, F.col("upper")), F.lit(b"")).alias("siblings"),
        "folded",
    )


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
