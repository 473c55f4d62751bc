"""Connected components of links by alternating large and small stars.

Each round replaces the links of a node by links to the smallest node it knows; the rounds
needed grow with the logarithm of the longest path. Minima are aggregated before the shuffle
and written to the shared folder, so a node with a third of all links meets its minimum in a
join that adaptive execution can split. Links stay on the executors throughout.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochord.session import written


def joined_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking a[i] with b[i]; the root of a set is its smallest position."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long), with component = the smallest
    node reachable. Loops, repeated and reversed links are allowed; NULL ends are ignored."""
    at = written(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"),
                                               F.least("a", "b").alias("lo")).distinct(), "links")
    while not _stars(at):
        both = at.selectExpr("hi AS u", "lo AS v").union(at.selectExpr("lo AS u", "hi AS v"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"))
                        .select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.filter("v > u").join(least, "u").selectExpr("v AS hi", "m AS lo")
                        .distinct(), "large")
        least = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least, "hi")
        at = written(small.filter("lo <> m").selectExpr("lo AS hi", "m AS lo")
                     .union(least.selectExpr("hi", "m AS lo")).distinct(), "links")
    return at.selectExpr("hi AS node", "lo AS component").union(
        at.selectExpr("lo AS node", "lo AS component").distinct())


def _stars(at: DataFrame) -> bool:
    """Whether each node that has a smaller neighbour has one, which has none itself."""
    ends = at.selectExpr("hi AS node", "1 AS up", "0 AS down").union(
        at.selectExpr("lo AS node", "0 AS up", "1 AS down"))
    open_ = (ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
             .filter("up > 1 OR (up > 0 AND down > 0)"))
    return open_.isEmpty()
