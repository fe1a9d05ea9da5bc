"""Connected components of a graph, for any orderable node type."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.session import checkpointed


def least_linked(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index linked to each of ``size`` indices through pairs a-b.

    Hooks and pointer jumps over whole arrays.
    """
    parent = np.arange(size)
    while True:
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return parent
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        low = np.minimum(ra, rb)
        np.minimum.at(parent, ra, low)
        np.minimum.at(parent, rb, low)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` with ``root`` the least node of the component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each
    round links every node to the least neighbour seen, in O(log^2 n) rounds,
    until every node is a root or linked to one root alone.
    A hub shuffles one minimum per task, and the join back is between many
    edge rows and one row per node, which adaptive execution splits.
    ``edges`` has ``u, v``; nodes without an edge are not listed.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    pairs = checkpointed(pairs)
    while _open(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        linked = star.join(low, "u")
        pairs = (
            linked.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        pairs = checkpointed(pairs)
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )


def _open(pairs: DataFrame) -> bool:
    """Whether some ``u`` has several ``v``, or is itself the ``v`` of another."""
    ends = pairs.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(pairs.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.where("up > 1 OR up + down > 1").isEmpty()
