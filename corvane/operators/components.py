"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.storage import drop, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)``; component is the smallest id reachable.

    Each round merges every node into the least of itself and its neighbours,
    in an order that is drawn anew by a hash, and keeps the edges between what
    is left. The greatest node of a component goes in every round, and in
    expectation a fixed share of all nodes does, whatever the shape, so rounds
    grow with the logarithm of the largest component and need no limit. The
    edges stay distributed; only whether any are left reaches the driver. Null
    ends are ignored, loops and repeated edges are harmless, an empty table
    gives an empty table.
    """
    both = edges.select("a", "b").where("a is not null and b is not null")
    both = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    levels = []
    while not levels or both.limit(1).count():
        if levels:
            drawn = [F.struct(F.xxhash64(c, F.lit(len(levels))).alias("draw"), F.col(c).alias("id")) for c in ("a", "b")]
            least = both.groupBy("a").agg(F.min(drawn[1]).alias("near")).select(F.col("a").alias("id"), F.least(drawn[0], "near")["id"].alias("into"))
        else:  # the ids as they are serve for one round
            least = both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("into"))
        merged = materialize(least, "merged")
        levels.append(merged)
        a, b = (merged.select(F.col("id").alias(c), F.col("into").alias(f"into_{c}")) for c in ("a", "b"))
        left = materialize(both.join(a, "a").join(b, "b").where("into_a != into_b").select(F.col("into_a").alias("a"), F.col("into_b").alias("b")).distinct(), "edges")
        drop(both)
        both = left
    drop(both)
    roots = levels.pop()
    while levels:  # backwards: where a node went, and where that one ended
        merged, ends = levels.pop(), roots.select(F.col("id").alias("into"), F.col("into").alias("end"))
        found = materialize(merged.join(ends, "into", "left").select("id", F.coalesce("end", "into").alias("into")), "roots")
        drop(merged, roots)
        roots = found
    names = roots.groupBy("into").agg(F.min("id").alias("component"))
    labels = materialize(roots.join(names, "into").select("id", "component"), "labels")
    drop(roots)
    return labels


class Forest:
    """Union-find over 0..n-1 that remembers the joins that mattered."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
