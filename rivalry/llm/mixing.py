"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length). Every source gets a target; whole repeats
of the source come first, and the rest of the budget is fitted on the counts: a share of
each length in proportion, then one more of single lengths while they fit, then a
bounded-knapsack dynamic program over the few words that remain. The plan is a number of
documents per (source, length); which ones is decided by a seeded hash.

Defined cases: a null or blank text has size 0 and takes 0; an empty table gives no rows;
null sources form one group, last in order; rows that repeat an id and a text are drawn
separately; other columns pass through only if asked for. Results do not depend on
partitioning, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivalry.session import persist_table

WORDS = "[^\\x20\\x09-\\x0D]+"
#: Rows that one task orders when documents of equal length are drawn.
DRAWN = 1024
#: Budget in words that the dynamic program covers (bounds its memory).
FITTED = 1 << 16


def targets(sizes: pd.DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> pd.DataFrame:
    """sizes(source, source_size) -> adds ``target``. Sources in code-point order, null last,
    weigh ``weights`` in turn and share the total; targets stop at ``most`` times the size and
    the excess is shared again by weight."""
    rows = sizes.sort_values("source", key=lambda s: s.map(lambda x: (x is None, x or "")), kind="stable").reset_index(drop=True)
    weight = np.array([weights[i % len(weights)] for i in range(len(rows))], dtype=float)
    size = rows["source_size"].to_numpy(dtype=float)
    capped = np.zeros(len(rows), dtype=bool)
    total = size.sum()
    target = np.zeros(len(rows))
    while len(rows):
        free = ~capped
        rest = total - (most * size[capped]).sum()
        target = np.where(capped, most * size, 0.0)
        if not free.any():
            break
        target[free] = rest * weight[free] / weight[free].sum()
        over = free & (target > most * size)
        if not over.any():
            break
        capped |= over
    return rows.assign(target=target)


def _fit(lengths: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length (at most ``spare``) come nearest to ``budget`` from below: bounded
    knapsack over bits. ``budget`` is at most FITTED, so one layer is a few kilobytes."""
    took = np.zeros(len(lengths), dtype=np.int64)
    full = (1 << (budget + 1)) - 1
    layers, reach = [], 1
    for i in np.flatnonzero((lengths > 0) & (lengths <= budget) & (spare > 0)):
        size, left, part = int(lengths[i]), int(min(spare[i], budget // int(lengths[i]))), 1
        while left and not reach >> budget & 1:
            n = min(part, left)
            layers.append((i, n, reach))
            reach |= (reach << (n * size)) & full
            left -= n
            part *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    for i, n, before in reversed(layers):
        if not before >> at & 1:
            took[i] += n
            at -= n * int(lengths[i])
    return took


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length so that their words come near ``budget`` (never above)."""
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.astype(np.int64).copy()
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):  # one more of a length, longest first, until the program can do the rest
        if left <= FITTED:
            break
        if 0 < lengths[i] <= left and take[i] < counts[i]:
            more = int(min(counts[i] - take[i], max(1, (left - FITTED) // int(lengths[i]))))
            take[i] += more
            left -= more * int(lengths[i])
    small = np.argsort(lengths, kind="stable")
    fitted = _fit(lengths[small], (counts - take)[small], min(left, FITTED))
    take[small] += fitted
    return take


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7, doc_id: str = "doc_id",
        text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words, repeats counted), times,
    and the columns of ``keep``."""
    size = F.size(F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("mix_id"), F.col(source).cast("string").alias("mix_source"), size.alias("mix_size"),
                       F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("mix_draw"), *[F.col(c) for c in keep])
    rows = rows.withColumn("mix_key", F.concat(F.when(F.col("mix_source").isNull(), "n").otherwise("s"), F.coalesce("mix_source", F.lit(""))))
    narrow = persist_table(rows.select("mix_id", "mix_source", "mix_key", "mix_size", "mix_draw"))
    by_length = persist_table(narrow.groupBy("mix_key", "mix_source", "mix_size").agg(F.count(F.lit(1)).alias("n")))
    # one row per source: as many as there are sources, not documents
    sizes = by_length.groupBy("mix_key", "mix_source").agg(F.sum(F.col("mix_size") * F.col("n")).cast("long").alias("source_size"))

    def share(groups):
        frame = pd.concat([*groups, pd.DataFrame({"mix_key": [], "mix_source": [], "source_size": []})])
        frame = frame.rename(columns={"mix_source": "source"}).astype({"source": object, "source_size": np.int64})
        frame["source"] = frame["source"].map(lambda x: None if pd.isna(x) else x)
        done = targets(frame, weights, most)
        yield done[["mix_key", "source_size", "target"]].astype({"mix_key": object})

    aims = sizes.coalesce(1).mapInPandas(share, "mix_key string, source_size long, target double")

    def plan(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = group["mix_size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        order = np.argsort(lengths)
        lengths, counts = lengths[order], counts[order]
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = min(int(target // total), int(most)) if total else 0
        rest = int(round(target - whole * total)) if total else 0
        take = fit_counts(lengths, counts, rest if whole < most else 0)
        return pd.DataFrame({"mix_key": key[0], "mix_size": lengths, "whole": whole, "take": take, "source_size": total, "target": target})

    # a group holds one row per different length of a source
    plans = by_length.drop("mix_source").join(aims, "mix_key").groupBy("mix_key").applyInPandas(
        plan, "mix_key string, mix_size long, whole int, take long, source_size long, target double")
    plans = persist_table(plans)
    n = narrow.count()
    buckets = max(1, -(-n // DRAWN))
    cell = ["mix_key", "mix_size", "mix_bucket"]
    bucket = F.pmod(F.xxhash64("mix_draw"), F.lit(buckets)).alias("mix_bucket")
    drawn = rows.select("*", bucket)
    sums = narrow.select("*", bucket).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("mix_key", "mix_size").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*cell, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("mix_base")).join(plans, ["mix_key", "mix_size"])
    inside = Window.partitionBy(*cell).orderBy("mix_draw", "mix_id")
    placed = drawn.withColumn("mix_rank", F.row_number().over(inside)).join(bases, cell)
    times = F.col("whole") + F.when(F.col("mix_rank") + F.col("mix_base") <= F.col("take"), 1).otherwise(0)
    return placed.select(F.col("mix_id").alias(doc_id), F.col("mix_source").alias(source), F.col("mix_size").alias("size"), "source_size", "target",
                         (F.col("mix_size") * times).cast("long").alias("taken"), times.cast("int").alias("times"),
                         *[F.col(c) for c in keep])
