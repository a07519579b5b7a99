"""Connected components of a link table, for graphs of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchkeeper.session import materialize


class UnionFind:
    """Groups of values; the root of a group is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (above := self.parent.get(top, top)) != top:
            top = above
        while x != top:
            self.parent[x], x = top, self.parent.get(x, x)
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.parent[high] = low
            self.parent.setdefault(low, low)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups = UnionFind()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            groups.link(a, b)
        pairs = [(x, r) for x in list(groups.parent) if (r := groups.root(x)) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"]
        )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (the smallest id reachable) for every id that a link names.

    Union-find merges the links of each Arrow batch into a forest; then large-star and small-star rounds
    (each a minimum per node and a join) hook neighbours to smaller ids until every tree is a star. The
    rounds grow with the logarithm of the longest path. Each round is written out, which cuts lineage.
    Links with a null end, and links of an id with itself, join nothing; no links give no rows.
    """
    both = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = materialize(both.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    while True:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        lowest = materialize(lowest, "lowest")  # as a table, so that a join with a hot u can be split
        # large star: every larger neighbour hooks to the smallest id around u
        large = (
            near.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        )
        large = materialize(large.distinct(), "edges")
        # small star: u and its smaller neighbours hook to the smallest of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        roots = edges.select(F.col("v").alias("u")).distinct()
        inner = edges.select("u").join(roots, "u", "left_semi")
        torn = edges.groupBy("u").agg(F.count("v").alias("n")).where("n > 1").select("u")
        if inner.unionByName(torn).isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
