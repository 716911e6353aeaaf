"""Global order without a global sort: split points, prefix sums, as-of counts.

A window without ``partitionBy`` puts every row in one task. The helpers here use
two levels instead: the order is cut into ranges whose number follows the row count,
ranges are summed and offset in a table of one row per range, and only the rows of one
range are ordered together. Rows are first grouped on
their order key, so a key that repeats in a third of the data is one row here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalry.session import persist_table

#: Rows that one range holds on average; the number of ranges follows the row count.
ROWS_PER_RANGE = 100_000


def in_ranges(df: DataFrame, key: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Stores ``df`` dealt out by ranges of ``key`` and adds ``range_no``, which grows with the key.

    Spark samples the cut points, and equal keys share a range. The numbers are those of the
    partitions that were written, so they stay the same whenever the table is read again.
    Rows that fit into one range are written once.
    """
    stored = persist_table(df)
    ranges = max(1, -(-stored.count() // rows_per_range))
    if ranges == 1:
        return stored.withColumn("range_no", F.lit(0))
    return persist_table(stored.repartitionByRange(ranges, key).withColumn("range_no", F.spark_partition_id()))


def prefix_sums(hist: DataFrame, key: str, sums: list[str], by: list[str] | None = None,
                rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``<col>_before``: sum of ``col`` over rows with a smaller key in the same group.

    ``hist`` must hold one row per (by, key).
    """
    by = by or []
    ranged = in_ranges(hist, key, rows_per_range)
    totals = ranged.groupBy(*by, "range_no").agg(*[F.sum(c).alias(c) for c in sums])
    # one row per range and group
    ahead = Window.partitionBy(*by).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "range_no",
                            *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_offset") for c in sums])
    inside = Window.partitionBy(*by, "range_no").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    ordered = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_inside") for c in sums])
    out = ordered.join(offsets, [*by, "range_no"])
    return out.select(*hist.columns,
                      *[(F.col(f"{c}_inside") + F.col(f"{c}_offset")).alias(f"{c}_before") for c in sums])


def trailing(column: str, keys: list[str], day_no: str, days: int | None, upto: int = 1) -> Column:
    """Sum of ``column`` over earlier days ``[day-days, day-upto]`` (all earlier days if None).

    Written as the difference of two running totals: each total grows by one step
    per row, so the cost does not depend on the window length.
    """
    w = Window.partitionBy(*keys).orderBy(day_no)
    until = F.coalesce(F.sum(column).over(w.rangeBetween(Window.unboundedPreceding, -upto)), F.lit(0))
    if days is None:
        return until
    gone = F.coalesce(F.sum(column).over(w.rangeBetween(Window.unboundedPreceding, -days - 1)), F.lit(0))
    return until - gone


def counts_before(events: DataFrame, probes: DataFrame | None, keys: list[str], sums: list[str],
                  days: int | None, day: str = "date", order: str = "match_id") -> DataFrame:
    """As-of sums per probe over events that come earlier in (day, order) within ``days``.

    Both sides hold ``keys + [day, order, "range_no"]`` (see ``in_ranges``); one row per
    distinct probe comes back. Without ``probes`` every event is one. Three parts are added:
    whole earlier days, earlier ranges of the same day, both over one row per key, day and
    range, and earlier ids of the same range. No part orders single rows of more than one
    range of one key's day together. The rows are dealt out once by (keys, day, range), and
    sums, ranges and ids all read that exchange.
    """
    ids = [*keys, day, "range_no", order]
    both = events.select(*ids, *[F.col(s).cast("long").alias(s) for s in sums], F.lit(1 if probes is None else 0).alias("is_probe"))
    if probes is not None:
        both = both.unionByName(probes.select(*ids, *[F.lit(0).cast("long").alias(s) for s in sums], F.lit(1).alias("is_probe")))
    # what has no place in the order meets no probe; said here, so that both readers plan the same exchange
    both = both.where(reduce(lambda a, c: a & F.col(c).isNotNull(), [*keys, day, "range_no"], F.lit(True)))
    both = both.repartition(*keys, day, "range_no").groupBy(*ids).agg(*[F.sum(s).alias(s) for s in sums], F.max("is_probe").alias("is_probe"))
    by_range = both.groupBy(*keys, day, "range_no").agg(*[F.sum(s).alias(s) for s in sums], F.max("is_probe").alias("is_probe"))
    by_range = by_range.repartition(*keys).withColumn("day_no", F.unix_date(F.to_date(day)))
    ahead = Window.partitionBy(*keys, day).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    before = by_range.select(*keys, day, "range_no", "is_probe", *[
        (trailing(s, keys, "day_no", days) + F.coalesce(F.sum(s).over(ahead), F.lit(0))).alias(f"{s}_b") for s in sums])
    before = before.where(F.col("is_probe") == 1).drop("is_probe")
    inside = Window.partitionBy(*keys, day, "range_no").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = both.select(*ids, "is_probe", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"{s}_i") for s in sums])
    out = rows.where(F.col("is_probe") == 1).join(before, [*keys, day, "range_no"])
    return out.select(*keys, day, order, *[(F.col(f"{s}_b") + F.col(f"{s}_i")).alias(s) for s in sums])


def dealt_in_order(rows: DataFrame, keys: list[str], day: str = "date", order: str = "match_id") -> DataFrame:
    """Adds ``day_no``, deals rows out by key and orders them, for ``counts_in_order``; done while rows are narrow."""
    placed = rows.where(reduce(lambda a, c: a & F.col(c).isNotNull(), [*keys, day, order], F.lit(True)))
    return placed.withColumn("day_no", F.unix_date(F.to_date(day))).repartition(*keys).sortWithinPartitions(*keys, "day_no", order)


def counts_in_order(rows: DataFrame, keys: list[str], sums: list[str], days: int | None, day: str = "date", order: str = "match_id") -> DataFrame:
    """What ``counts_before`` counts when every event is a probe, for keys whose rows all fit into one task.

    ``rows`` come from ``dealt_in_order``: all sums follow from that one exchange and its one
    order, and nothing is joined back. A row that repeats (keys, day, order) is one probe.
    """
    until = Window.partitionBy(*keys).orderBy("day_no", order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*keys, "day_no", order)
    gone = Window.partitionBy(*keys).orderBy("day_no").rangeBetween(Window.unboundedPreceding, -(days or 0) - 1)

    def before(s: str) -> Column:
        earlier = F.sum(s).over(until) - F.sum(s).over(same)
        return (earlier if days is None else earlier - F.coalesce(F.sum(s).over(gone), F.lit(0))).alias(s)

    out = rows.select(*keys, day, order, *[before(s) for s in sums], F.row_number().over(same.orderBy(order)).alias("again"))
    return out.where("again = 1").drop("again")


def last_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; partial aggregation, so no key is gathered."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*df.columns)


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*df.columns)
