"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.llm.memory import released
from rivalry.session import persist_table


def _forest(batches):
    """Within a task only the edges of a spanning forest are needed; each node points at its smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent if root(x) != x]
    flat = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Each round joins the edges with one smallest neighbour per node (a grouped minimum, so
    no neighbourhood is gathered) and halves the distance to the smallest at least; rounds
    end when a round changes nothing. Edges with a null end are ignored. Every round is a
    written table, so a lost executor costs its part of one round.
    """
    ends = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    current = persist_table(ends.mapInArrow(released(_forest), "u long, v long"))
    mark = None
    while True:
        now = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == (now["n"], now["s"]):
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = (now["n"], now["s"])
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # an edge points from the larger to the smaller node
        current = persist_table(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                                .unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
