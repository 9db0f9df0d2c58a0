"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.session import checkpointed

#: Edges that one task contracts.
TASK_EDGES = 100_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: every node with the smallest of its component there."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for v, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(v, v)
            root.setdefault(m, m)
            one, other = find(v), find(m)
            if one != other:
                root[max(one, other)] = min(one, other)
    pairs = np.array([(x, r) for x in root if (r := find(x)) != x], dtype=np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["v", "m"])


def components(edges: DataFrame) -> DataFrame:
    """Columns (node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Tasks of a bounded number of edges contract theirs first; where that takes several, alternating large-star and
    small-star steps (Kiveris et al., 2014) end in stars after O(log^2 n) rounds, also on long chains, and never gather a
    component. Null ends are left out.
    """
    star = checkpointed(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
        .distinct()
    )
    tasks = -(-star.count() // TASK_EDGES)
    star = checkpointed(star.repartition(max(1, tasks)).mapInArrow(_contracted, "v long, m long"))
    before = None
    while tasks > 1:
        both = star.unionByName(star.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.join(least, "v").where(F.col("m") > F.col("v")).select(F.col("m").alias("v"), F.col("low").alias("m"))
        large = large.where(F.col("v") != F.col("m")).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v")
        small = small.select("v", F.col("low").alias("m")).unionByName(small.select(F.col("m").alias("v"), F.col("low").alias("m")))
        star = checkpointed(small.where(F.col("v") != F.col("m")).distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = star.select(F.col("v").alias("node"), F.col("m").alias("root"))
    return roots.unionByName(star.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
