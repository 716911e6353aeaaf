"""Ranges of an order whose cut points are rows of the table, so that the next row is known across a cut."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of one range, sampled rows for each, and the most ranges; bounds what the driver collects to 16 x 8192 pairs of longs on average.
RANGE_BYTES, SAMPLED, RANGES = 16 << 20, 16, 8192


def cut_points(rows: DataFrame, key: str, tie: str, size: str, range_bytes: int = RANGE_BYTES) -> list[tuple]:
    """(key, tie) of the first row of each range, ascending, null keys first; none for an empty table.

    ``key`` and ``tie`` are longs. Rows are drawn with a chance that grows with ``size``, so
    ranges hold about equally many bytes. The first cut is the smallest row of all.
    """
    total = rows.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(F.struct(key, tie)).alias("first")).first()
    if not total["n"]:
        return []
    bytes_ = max(1, total["bytes"] or 0)
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    count = min(RANGES, max(-(-bytes_ // range_bytes), min(parallel, -(-bytes_ // (1 << 20)))))
    drawn: list[tuple] = []
    if count > 1:
        chance = F.pmod(F.xxhash64(key, tie, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
        sample = rows.where(chance < F.lit(SAMPLED * count / bytes_) * F.col(size)).select(key, tie).distinct().collect()
        drawn = sorted(map(tuple, sample), key=order)
        drawn = drawn[:: max(1, len(drawn) // count)]
    return sorted({tuple(total["first"]), *drawn}, key=order)


def order(pair: tuple) -> tuple:
    """Sorts null keys first."""
    return (pair[0] is not None, pair[0] or 0, pair[1])


def with_next(rows: DataFrame, key: str, tie: str, cuts: list[tuple]) -> DataFrame:
    """Adds ``range_no`` and ``ahead``: the first row of a range also ends the range before it, marked as ahead.

    The first row of all ends the last range. Rows are dealt out by range and ordered inside
    it, null keys first.
    """
    held = [order(c) for c in cuts]

    @F.arrow_udf("array<struct<range_no: int, ahead: boolean>>")
    def places(keys: pa.Array, ties: pa.Array) -> pa.Array:
        out = []
        for k in zip(keys.to_pylist(), ties.to_pylist()):
            k = order(k)
            at = bisect_right(held, k) - 1
            out.append([{"range_no": at, "ahead": False}] + ([{"range_no": (at - 1) % len(held), "ahead": True}] if held[at] == k else []))
        return pa.array(out, pa.list_(pa.struct([("range_no", pa.int32()), ("ahead", pa.bool_())])))

    names = [F.col(f"`{c}`") for c in rows.columns]
    placed = rows.select(*names, F.explode(places(F.col(key), F.col(tie))).alias("place")).select(*names, "place.range_no", "place.ahead")
    return placed.repartition(max(1, len(cuts)), "range_no").sortWithinPartitions("range_no", "ahead", F.col(key).asc_nulls_first(), tie)
