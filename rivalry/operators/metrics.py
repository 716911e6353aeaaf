"""Probability metrics and calibration tables.

Every metric that needs an order works on a histogram of distinct probabilities,
so equal scores are one row and no task sorts the whole data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.functions import stats as S
from rivalry.operators.ordered import prefix_sums


def core_metrics(p: Column, y: Column, eps: float = C.METRIC_CLIP) -> list[Column]:
    q = S.clip(p, eps)
    return [F.count("*").alias("n"), F.avg((F.when(q >= 0.5, 1).otherwise(0) == y).cast("int")).alias("accuracy"),
            F.avg(S.log_loss(p, y, eps)).alias("log_loss"), F.avg((q - y) * (q - y)).alias("brier_score"),
            F.avg(q).alias("prediction_mean"), F.avg(y).alias("label_mean")]


def expected_calibration_error(df: DataFrame, by: list[str] | None = None, p: str = "p", y: str = "label", bins: int = 10) -> DataFrame:
    """Weighted gap over equal-width bins, the last one closed."""
    by = by or []
    q = S.clip(F.col(p), C.METRIC_CLIP)
    b = F.least(F.floor(q * bins), F.lit(bins - 1))
    g = df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("c"), F.avg(y).alias("acc"), F.avg(q).alias("conf"))
    return g.groupBy(*by).agg((F.sum(F.col("c") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("c")).alias("ece"))


def roc_auc(df: DataFrame, by: list[str] | None = None, p: str = "p", y: str = "label") -> DataFrame:
    """Exact area with average ranks for ties; NULL when only one class is present."""
    by = by or []
    q = S.clip(F.col(p), C.METRIC_CLIP)
    hist = df.groupBy(*by, q.alias("q")).agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"))
    ranked = prefix_sums(hist, "q", ["neg"], by)
    # as doubles: the pair count may exceed a long
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*by).agg(F.try_divide(won, F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def binary_metrics(df: DataFrame, by: list[str] | None = None, p: str = "p", y: str = "label") -> DataFrame:
    """Accuracy, log loss, Brier, AUC, ECE and means, per group."""
    by = by or []
    base = df.groupBy(*by).agg(*core_metrics(F.col(p), F.col(y)))
    parts = [roc_auc(df, by, p, y), expected_calibration_error(df, by, p, y)]
    for part in parts:  # one row per group on each side
        base = base.join(part, by, "left") if by else base.crossJoin(F.broadcast(part))
    return base


def calibration_buckets(df: DataFrame, edges: list[float] = C.CALIBRATION_EDGES, p: str = "p", y: str = "label") -> DataFrame:
    """Right-closed buckets, the first closed on both ends; empty ones are left out."""
    c = F.col(p)
    label = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        cond = (c >= lo if i == 0 else c > lo) & (c <= hi)
        label = F.when(cond, i + 1) if label is None else label.when(cond, i + 1)
    g = df.where((c >= edges[0]) & (c <= edges[-1])).groupBy(label.alias("bucket_no"))
    return g.agg(F.count("*").alias("matches"), F.avg(p).alias("avg_predicted"), F.avg(y).alias("actual_rate"),
                 F.sum(y).cast("long").alias("forfeits"))


def fixed_bins(df: DataFrame, start: int = 0, stop: int = 100, width: int = 5, p: str = "assigned_prob", won: str = "won") -> DataFrame:
    """Percent bins of equal width over [start, stop], last closed; empty bins are kept."""
    c = F.col(p)
    starts = range(start, stop, width)
    lo = None
    for s in starts:
        cond = (c >= s / 100) & ((c <= stop / 100) if s + width == stop else (c < (s + width) / 100))
        lo = F.when(cond, s) if lo is None else lo.when(cond, s)
    g = df.groupBy(lo.alias("lo")).agg(F.count("*").alias("count"), F.sum(F.col(won).cast("int")).alias("wins"), F.avg(p).alias("avg_prob"))
    spine = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in starts])).alias("lo"))
    return spine.join(g, "lo", "left").select(
        "lo", (F.col("lo") + width).alias("hi"), F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("wins", F.lit(0)).cast("long").alias("wins"), "avg_prob")


def adaptive_bins(df: DataFrame, bins: int = 10, p: str = "assigned_prob", won: str = "won") -> DataFrame:
    """Equal-count bins over the order (probability, outcome), without ranking rows.

    Rows with the same probability and outcome are interchangeable, so a group that
    crosses a bin edge is split by arithmetic on its counts.
    """
    hist = df.groupBy(F.struct(F.col(p).alias("p"), F.col(won).cast("int").alias("w")).alias("k")).agg(F.count("*").alias("c"))
    h = prefix_sums(hist, "k", ["c"])
    n = hist.agg(F.sum("c").alias("n")).withColumn("k_bins", F.least(F.lit(bins).cast("long"), F.col("n")))
    h = h.crossJoin(F.broadcast(n))
    first, last = F.col("c_before"), F.col("c_before") + F.col("c") - 1

    def bin_of(r: Column) -> Column:  # the bin whose [floor(i*n/k), floor((i+1)*n/k)) holds row r
        return F.floor(((r + 1) * F.col("k_bins") - 1) / F.col("n"))

    h = h.withColumn("i", F.explode(F.sequence(bin_of(first), bin_of(last))))
    lo_row = F.floor(F.col("i") * F.col("n") / F.col("k_bins"))
    hi_row = F.floor((F.col("i") + 1) * F.col("n") / F.col("k_bins"))
    part = F.least(hi_row, F.col("c_before") + F.col("c")) - F.greatest(lo_row, F.col("c_before"))
    h = h.withColumn("part", part).where(F.col("part") > 0)
    return h.groupBy(F.col("i").cast("long").alias("bin_no")).agg(
        F.min("k.p").alias("lo"), F.max("k.p").alias("hi"), F.sum("part").cast("long").alias("count"),
        F.sum(F.col("part") * F.col("k.w")).cast("long").alias("wins"),
        (F.sum(F.col("part") * F.col("k.p")) / F.sum("part")).alias("avg_prob"))


def bin_record(bins: DataFrame) -> DataFrame:
    """Expected wins, error, interval, exact test and verdict per bin row."""
    n, wins, avg = F.col("count"), F.col("wins"), F.col("avg_prob")
    observed = wins / F.nullif(n, F.lit(0))
    low, high = S.wilson(wins, n)
    out = bins.select("*", (n - wins).alias("losses"), observed.alias("observed"), (avg * n).alias("expected_wins"),
                      (wins - avg * n).alias("delta_wins"), low.alias("ci_low"), high.alias("ci_high"),
                      (observed - avg).alias("error"))
    out = out.withColumn("abs_error", F.abs("error")).withColumn(
        "p_value", F.nanvl(S.binomial_p(F.col("wins"), F.col("count"), F.col("avg_prob")), F.lit(None)))
    return out.withColumn("verdict", S.verdict(F.col("count"), F.col("error"), F.col("p_value")))


def calibration_summary(records: DataFrame) -> DataFrame:
    total = F.sum("count")
    return records.agg(total.alias("evaluations"), F.coalesce(F.sum("expected_wins"), F.lit(0.0)).alias("expected_wins"),
                       F.sum("wins").alias("observed_wins"),
                       F.try_divide(F.sum(F.coalesce("abs_error", F.lit(0.0)) * F.col("count")), total).alias("ece"),
                       F.max("abs_error").alias("mce"),
                       F.try_divide(F.sum(F.coalesce("error", F.lit(0.0)) * F.col("count")), total).alias("signed_bias"))


def rank_order_diagnostics(df: DataFrame) -> DataFrame:
    favoured = F.col("rank_diff") > 0
    won = F.when(favoured, F.col("label") == 1).otherwise(F.col("label") == 0)
    return df.where(F.col("rank_diff") != 0).agg(F.avg(favoured.cast("int")).alias("team_a_rank_favoured_rate"),
                                                 F.avg(won.cast("int")).alias("rank_favourite_win_rate"))


def symmetry_error(df: DataFrame, p: str = "p", mirrored: str = "p_mirror") -> DataFrame:
    """Mean and exact 95th percentile of |p + p_mirror - 1| (linear interpolation on a histogram)."""
    e = df.select(F.abs(F.col(p) + F.col(mirrored) - 1).alias("e"))
    hist = prefix_sums(e.groupBy("e").agg(F.count("*").alias("c")), "e", ["c"])
    n = e.agg(F.count("*").alias("n"), F.avg("e").alias("symmetry_error_mean"))
    pos = F.lit(0.95) * (F.col("n") - 1)
    h = hist.crossJoin(F.broadcast(n))

    def holds(r: Column) -> Column:
        return (F.col("c_before") <= r) & (r < F.col("c_before") + F.col("c"))

    lo, hi = F.floor(pos), F.ceil(pos)
    r = h.groupBy("n", "symmetry_error_mean").agg(F.max(F.when(holds(lo), F.col("e"))).alias("a"), F.max(F.when(holds(hi), F.col("e"))).alias("b"))
    return r.select("symmetry_error_mean", (F.col("a") + (F.col("b") - F.col("a")) * (pos - F.floor(pos))).alias("symmetry_error_p95"))


def evaluation_payload(df: DataFrame) -> DataFrame:
    """Rows, series, dates, means, metrics and rank diagnostics in one row."""
    head = df.agg(F.count("*").alias("rows"), F.countDistinct("match_id").alias("matches"), F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    return (head.crossJoin(F.broadcast(binary_metrics(df).drop("n"))).crossJoin(F.broadcast(rank_order_diagnostics(df))))


def subgroup_metrics(df: DataFrame, min_rows: int = 10, regions: int = 8, organizers: int = 10) -> DataFrame:
    """Metrics per overlapping subgroup; membership labels are exploded on the row."""
    def top(col: str, k: int) -> DataFrame:
        g = df.groupBy(col).agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
        best = g.orderBy(F.desc("n"), col).limit(k)  # at most k rows
        return best.agg(F.collect_list(col).alias(f"top_{col}"))

    d = df.crossJoin(F.broadcast(top("region", regions))).crossJoin(F.broadcast(top("organizer", organizers)))
    labels = F.array_compact(F.array(
        F.when(~F.col("is_lan"), F.lit("online")), F.when(F.col("is_lan"), F.lit("LAN")),
        F.when((F.col("max_rank") > 100) | (F.col("max_rank") >= C.UNRANKED), F.lit("low-ranked/unranked")),
        F.when(F.array_contains("top_region", F.col("region")), F.concat(F.lit("region: "), "region")),
        F.when(F.array_contains("top_organizer", F.col("organizer")), F.concat(F.lit("event family: "), "organizer"))))
    rows = d.select(F.explode(labels).alias("group"), "p", "label")
    return binary_metrics(rows, ["group"]).where(F.col("n") >= min_rows)
