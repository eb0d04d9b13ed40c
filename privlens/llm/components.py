"""Connected components of a link table, without collecting links: alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlens.llm.common import discard, materialize


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' components, given links ``a``-``b`` and an earlier ``root`` to extend."""
    root = np.arange(n) if root is None else root
    while len(a):
        ra, rb = root[a], root[b]
        on = ra != rb
        if not on.any():
            break
        a, b, ra, rb = a[on], b[on], ra[on], rb[on]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(a long, b long)``; ``root`` is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Minima are pre-aggregated
    before each shuffle, and the star joins are plain equi-joins that adaptive execution can split
    when one hub holds a large share of the links. Each round is written to the shared folder.
    Null ends, loops and repeated links are ignored. No links: no rows.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    for _ in range(max_rounds):
        if _is_stars(edges):
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "stars")
        discard(edges)
        edges = after
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one centre and no centre hangs on another."""
    if edges.groupBy("u").count().where("count > 1").limit(1).count():
        return False
    return not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
