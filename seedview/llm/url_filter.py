"""URL filtering by domain rules and by a tree of path templates, in DataFrame operations only.

Paths of a host form a tree of segments. Level by level, siblings whose labels do not differ
significantly are merged into the wildcard ``*``, as are segments that are rare among many siblings and
have too few labels to tell; a sibling that differs keeps its own branch, however rare it is. Digits and
long hexadecimal runs are generalised before the tree is built, and segments below the deepest level become ``**``. Each template is then judged
by the share of bad labels below it, shrunk towards its host and all hosts.

Pages are counted once per (host, generalised path) with map-side sums; the tree works on these
counts. Verdicts of hot shapes are sent to the pages, all others return by a join in which no key is hot.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedview.session import pin


@dataclass(frozen=True)
class Rule:
    """Verdict for a host with all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeSettings:
    """``depth``         levels of the tree.
    ``max_children``  among more siblings than this, rare ones need enough labels to differ.
    ``rare_share``    a segment below this share of its parent's pages is rare.
    ``z``             two-sided normal quantile above which a sibling's bad share is different.
    ``prior``         labels that the shares of host and corpus count for in a template's share.
    ``reject``        templates whose shrunk bad share is at least this are blocked.
    ``hot_shapes``    a shape with more than one in so many pages is hot, so there are at most as many."""

    depth: int = 6
    max_children: int = 16
    rare_share: float = 0.05
    z: float = 3.0
    prior: float = 10.0
    reject: float = 0.6
    hot_shapes: int = 1000


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host after the first ``://``; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """Path after the host, up to query or fragment; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule], field: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits, the longer host first among equals; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.lit(getattr(rule, field))).otherwise(found)
    return found


def path_shape(path: Column, depth: int) -> Column:
    """Segments with digits and hexadecimal runs generalised, ``**`` for all below ``depth``."""
    plain = F.regexp_replace(path, r"(?i)\b(?=[0-9a-f-]*[0-9])[0-9a-f-]{8,}\b", "#")
    parts = F.split(F.regexp_replace(F.regexp_replace(plain, "^/", ""), "[0-9]+", "#"), "/")
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("**")))).otherwise(parts)


def _generalise(tree: DataFrame, level: int, s: TreeSettings) -> DataFrame:
    """Replace rare and similar segments at one level by ``*``."""
    deep = F.size("template") >= level
    tree = tree.withColumn("__node", F.when(deep, F.slice("template", 1, level - 1)))
    tree = tree.withColumn("__part", F.when(deep, F.element_at("template", level)))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    children = tree.where(deep).groupBy("host", "__node", "__part").agg(*sums)
    nodes = children.groupBy("host", "__node").agg(
        F.count(F.lit(1)).alias("kinds"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "good", "bad"))
    )
    labelled, others = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad") - F.col("good") - F.col("bad")
    share = (F.col("bad") + 0.5) / (labelled + 1)
    rest = (F.col("all_bad") - F.col("bad") + 0.5) / (others + 1)
    pooled = (F.col("all_bad") + 1) / (labelled + others + 2)
    score = F.abs(share - rest) / F.sqrt(pooled * (1 - pooled) * (1 / (labelled + 1) + 1 / (others + 1)))
    rare = (F.col("kinds") > s.max_children) & (F.col("n") < s.rare_share * F.col("all_n"))
    # Chernoff's bound, which holds for few labels too: the chance of such a share among so many labels.
    part = lambda k, p: F.when(k > 0, k * F.log(k / (labelled * p))).otherwise(0.0)
    told = part(F.col("bad"), rest) + part(F.col("good"), 1 - rest) > math.log(2 / math.erfc(s.z / math.sqrt(2)))
    wild = (
        children.join(nodes, ["host", "__node"])
        .where((F.col("kinds") > 1) & ((score <= s.z) | (rare & ~told)))
        .select("host", "__node", "__part", F.lit(True).alias("__wild"))
    )
    before, after = F.slice("template", 1, level - 1), F.slice("template", level + 1, s.depth + 1)
    return tree.join(wild, ["host", "__node", "__part"], "left").select(
        "host",
        "shape",
        F.when(F.col("__wild"), F.concat(before, F.array(F.lit("*")), after)).otherwise(F.col("template")).alias("template"),
        "n",
        "good",
        "bad",
    )


def template_tree(pages: DataFrame, labels: DataFrame, s: TreeSettings = TreeSettings()) -> DataFrame:
    """(host, shape, template, bad_share, blocked, n pages) of every generalised path.

    ``pages`` has page_id and url, ``labels`` has page_id and bad (0 or 1); a page may have several
    labels, labels of unknown pages are ignored.
    """
    keyed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_shape(path_of(F.col("url")), s.depth).alias("shape"))
    zero = F.lit(0).cast("long")
    seen = keyed.select("host", "shape", F.lit(1).cast("long").alias("n"), zero.alias("good"), zero.alias("bad"))
    told = keyed.join(labels.select("page_id", F.col("bad").cast("long").alias("bad")), "page_id").where("bad is not null")
    told = told.select("host", "shape", zero.alias("n"), (1 - F.col("bad")).alias("good"), "bad")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    counts = seen.unionByName(told).groupBy("host", "shape").agg(*sums)
    tree = pin(counts.withColumn("template", F.col("shape")), "url-shapes")
    deepest = tree.agg(F.max(F.size("shape"))).first()[0] or 0
    for level in range(1, min(deepest, s.depth) + 1):
        tree = pin(_generalise(tree, level, s), "url-tree")
    templates = tree.groupBy("host", "template").agg(*sums)
    hosts = templates.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad"))
    total = tree.agg(F.sum("bad").alias("bad"), F.sum(F.col("good") + F.col("bad")).alias("all")).first()
    base = ((total["bad"] or 0) + 1) / ((total["all"] or 0) + 2)
    of_host = (F.col("host_bad") + s.prior * base) / (F.col("host_good") + F.col("host_bad") + s.prior)
    judged = templates.join(hosts, "host").select(
        "host", "template", ((F.col("bad") + s.prior * of_host) / (F.col("good") + F.col("bad") + s.prior)).alias("bad_share")
    )
    return tree.join(judged, ["host", "template"]).select(
        "host", "shape", "template", "bad_share", (F.col("bad_share") >= s.reject).alias("blocked"), "n"
    )


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], s: TreeSettings = TreeSettings()) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every page; other columns are ignored.

    Every row of ``pages`` gives one row, repeated or not. A missing url, or one without ``://``, has
    empty host and path and the template of that empty path.
    """
    tree = template_tree(pages, labels, s).select(
        F.col("host").alias("__h"),
        F.col("shape").alias("__s"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        "blocked",
        "n",
    )
    tree = pin(tree, "url-verdicts")
    most = (tree.agg(F.sum("n")).first()[0] or 0) / s.hot_shapes
    host, path = F.col("host"), F.col("path")
    keyed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn(
        "__shape", path_shape(path, s.depth)
    )
    # Shapes with more than their share of pages, at most ``hot_shapes``, are sent to the pages; pages that they
    # settle are spread by their id in the join with all other shapes.
    hot = tree.where(F.col("n") > most).select(
        F.col("__h").alias("__hot_h"), F.col("__s").alias("__hot_s"), F.col("template").alias("__hot_t"), F.col("blocked").alias("__hot_b")
    )
    marked = keyed.join(F.broadcast(hot), (host == F.col("__hot_h")) & (F.col("__shape") == F.col("__hot_s")), "left")
    settled = F.col("__hot_t").isNotNull()
    spread = F.concat(F.lit("/"), F.xxhash64("page_id", "path").cast("string"))  # no host holds a slash
    marked = marked.withColumn("__key", F.when(settled, spread).otherwise(host)).drop("__hot_h", "__hot_s")
    cold = tree.where(F.col("n") <= most)
    joined = marked.join(cold, (F.col("__key") == F.col("__h")) & (F.col("__shape") == F.col("__s")), "left").withColumns(
        {"template": F.coalesce("__hot_t", "template"), "blocked": F.coalesce("__hot_b", "blocked")}
    )
    method = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        "page_id",
        "host",
        "path",
        rule_of(host, path, rules, "name").alias("rule"),
        F.coalesce(rule_of(host, path, rules, "verdict"), method).alias("verdict"),
        "template",
    )
