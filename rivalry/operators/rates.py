"""Smoothed event-rate features over all earlier days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.functions import text as X
from rivalry.operators.ordered import trailing
from rivalry.operators.veto import salted_lookup


def smoothed(s: Column, n: Column, prior: float = C.FORFEIT_PRIOR, weight: float = C.FORFEIT_PRIOR_WEIGHT) -> Column:
    return (s + prior * weight) / (n + weight)


def running_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows hold keys + [date, n, s]; result is per (keys, date): totals of all earlier days."""
    daily = rows.groupBy(*keys, "date").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(*keys, "date", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("n", "s")])


def surface_days(base: DataFrame, recent: tuple[int, ...] = (30, 90)) -> DataFrame:
    """Per day and surface: totals of earlier days and recent means, overall and of the surface.

    Facts are summed to one row per (day, surface) first; the windows that follow
    order at most two rows per calendar day.
    """
    daily = base.groupBy("date", "is_lan").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    both = daily.groupBy("date").agg(*[F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(f"{c}_{name}") for c in ("n", "s")
                                       for name, cond in (("all", F.lit(True)), ("lan", F.col("is_lan")), ("net", ~F.col("is_lan")))])
    d = both.withColumn("day_no", F.unix_date("date")).withColumn("one", F.lit(1))
    cols = [trailing(f"{c}_{k}", ["one"], "day_no", None).alias(f"{c}_{k}_past") for c in ("n", "s") for k in ("all", "lan", "net")]
    cols += [trailing(f"{c}_{k}", ["one"], "day_no", days).alias(f"{c}_{k}_{days}") for c in ("n", "s") for k in ("all", "lan", "net") for days in recent]
    d = d.select("date", *cols)
    d = d.withColumn("is_lan", F.explode(F.array(F.lit(True), F.lit(False))))

    def pick(c: str, span) -> Column:
        return F.when(F.col("is_lan"), F.col(f"{c}_lan_{span}")).otherwise(F.col(f"{c}_net_{span}"))

    def mean(s: Column, n: Column) -> Column:
        return F.when(n > 0, s / F.nullif(n, F.lit(0))).otherwise(C.FORFEIT_PRIOR)

    return d.select("date", "is_lan", smoothed(F.col("s_all_past"), F.col("n_all_past")).alias("global_forfeit_rate"),
                    smoothed(pick("s", "past"), pick("n", "past")).alias("surface_forfeit_rate"),
                    *[mean(F.col(f"s_all_{k}"), F.col(f"n_all_{k}")).alias(f"recent_{k}d_forfeit_rate") for k in recent],
                    *[mean(pick("s", k), pick("n", k)).alias(f"recent_surface_{k}d_forfeit_rate") for k in recent])


def forfeit_features(base: DataFrame, targets: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """32 numeric and 5 categorical features from strictly earlier days.

    ``targets`` are unseen rows to score; they enter the history as empty rows, so
    their own outcome is never read. ``compat`` repeats the 30-day value as the
    90-day value.
    """
    scored = base if targets is None else targets
    fill = {"event": "Unknown", "organizer": "Unknown", "region": "Unknown", "match_format": "unknown"}
    probe = [] if targets is None else [targets.withColumns({"forfeit_target": F.lit(0), "forfeit_team": F.lit("Unknown"), "w": F.lit(0)})]
    rows = base.withColumn("w", F.lit(1))
    for p in probe:
        rows = rows.unionByName(p, allowMissingColumns=True)
    rows = rows.fillna(fill).withColumns({"date": F.to_date("date"), "n": F.col("w"), "s": F.col("w") * F.col("forfeit_target"), "is_lan": F.coalesce("is_lan", F.lit(False))})

    def own(k: int) -> Column:
        team = F.lower("forfeit_team")
        return (F.lower(f"team{k}_id") == team).cast("int") * F.col("w") * (F.col("forfeit_team") != "Unknown").cast("int")

    teams = rows.select("date", F.inline(F.array(*[F.struct(F.col(f"team{k}_id").alias("team"), F.col("n").alias("n"), F.col("s").alias("s"), own(k).alias("own")) for k in (1, 2)])))
    daily = teams.groupBy("team", "date").agg(*[F.sum(c).alias(c) for c in ("n", "s", "own")])
    w = Window.partitionBy("team").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    team_state = daily.select("team", "date", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("n", "s", "own")])

    out = scored.fillna({k: v for k, v in fill.items() if k in scored.columns}).withColumns({"date": F.to_date("date"), "is_lan": F.coalesce("is_lan", F.lit(False))})
    for key in ("region", "organizer", "event"):
        state = running_counts(rows, [key]).select(key, "date", F.col("n").alias(f"{key}_n"), F.col("s").alias(f"{key}_s"))
        out = out.join(state, [key, "date"], "left")
    # a calendar has few days: two rows per day are safe to broadcast at any data size
    out = out.join(F.broadcast(surface_days(rows)), ["date", "is_lan"], "left")
    for k in (1, 2):
        out = out.join(team_state.select(F.col("team").alias(f"team{k}_id"), "date", *[F.col(c).alias(f"t{k}_{c}") for c in ("n", "s", "own")]), [f"team{k}_id", "date"], "left")
    start = base.agg(F.min(F.to_date("date")).alias("first_day"))
    out = out.crossJoin(F.broadcast(start))

    r1, r2 = (X.safe_rank(F.col(f"team{k}_rank")) for k in (1, 2))
    l1, l2 = F.log(r1.cast("double")), F.log(r2.cast("double"))
    fmt = F.when(F.col("match_format") == "def", "unknown").otherwise(F.col("match_format"))
    rate = {k: smoothed(F.col(f"t{k}_s"), F.col(f"t{k}_n")) for k in (1, 2)}
    own_rate = {k: smoothed(F.col(f"t{k}_own"), F.col(f"t{k}_n")) for k in (1, 2)}
    b1, b2 = X.rank_bucket(r1), X.rank_bucket(r2)

    def log_count(c: str) -> Column:
        return F.log1p(F.col(c).cast("double"))

    f = {
        "is_lan": F.col("is_lan").cast("int"), "best_of": X.best_of(fmt), "days_since_start": F.greatest(F.datediff("date", "first_day"), F.lit(0)),
        "team1_rank": r1, "team2_rank": r2, "min_rank": F.least(r1, r2), "max_rank": F.greatest(r1, r2), "avg_log_rank": (l1 + l2) / 2,
        "abs_log_rank_diff": F.abs(l1 - l2), "either_unranked": ((r1 >= C.UNRANKED) | (r2 >= C.UNRANKED)).cast("int"),
        "both_unranked": ((r1 >= C.UNRANKED) & (r2 >= C.UNRANKED)).cast("int"),
        **{f"{k}_forfeit_rate": smoothed(F.col(f"{k}_s"), F.col(f"{k}_n")) for k in ("region", "organizer", "event")},
        **{f"team{k}_match_forfeit_rate": rate[k] for k in (1, 2)}, "team_avg_match_forfeit_rate": (rate[1] + rate[2]) / 2, "team_max_match_forfeit_rate": F.greatest(rate[1], rate[2]),
        **{f"team{k}_own_forfeit_rate": own_rate[k] for k in (1, 2)}, "team_avg_own_forfeit_rate": (own_rate[1] + own_rate[2]) / 2, "team_max_own_forfeit_rate": F.greatest(own_rate[1], own_rate[2]),
        "team1_match_count_log": log_count("t1_n"), "team2_match_count_log": log_count("t2_n"), "organizer_match_count_log": log_count("organizer_n"), "event_match_count_log": log_count("event_n"),
    }
    if compat:
        f |= {"recent_90d_forfeit_rate": F.col("recent_30d_forfeit_rate"), "recent_surface_90d_forfeit_rate": F.col("recent_surface_30d_forfeit_rate")}
    numeric = [f.get(c, F.col(c)).alias(c) for c in C.FORFEIT_NUMERIC]
    categorical = [F.col("region"), fmt.alias("format"), b1.alias("team1_rank_bucket"), b2.alias("team2_rank_bucket"), F.array_join(F.array_sort(F.array(b1, b2)), " / ").alias("rank_pair_bucket")]
    target = ["forfeit_target"] if "forfeit_target" in scored.columns else []
    return out.select("match_id", "date", "team1_id", "team2_id", "event", "organizer", *numeric, *categorical, *target)


def hierarchical_rates(train: DataFrame, rows: DataFrame, weight: float = C.FORFEIT_PRIOR_WEIGHT) -> DataFrame:
    """Rate of the finest known level (surface+region+organizer, surface+region, surface), shrunk to the global rate.

    All levels come from one grouping-sets pass; each lookup key is spread over
    several partitions because one surface alone can hold most rows.
    """
    levels = [["is_lan", "region", "organizer"], ["is_lan", "region"], ["is_lan"]]
    g = train.groupingSets([*levels, []], "is_lan", "region", "organizer").agg(F.sum("forfeit_target").alias("s"), F.count("*").alias("n"), F.grouping_id().alias("gid"))
    overall = g.where(F.col("gid") == 7).select((F.col("s") / F.col("n")).alias("overall"))
    out = rows
    for i, keys in enumerate(levels):
        table = g.where(F.col("gid") == (0, 1, 3)[i]).select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias(f"k{i}"), F.col("s").alias(f"s{i}"), F.col("n").alias(f"n{i}"))
        out = salted_lookup(out.withColumn(f"k{i}", F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), table, f"k{i}", ["match_id"])
    out = out.crossJoin(F.broadcast(overall))
    s, n = F.coalesce("s0", "s1", "s2", F.lit(0)), F.coalesce("n0", "n1", "n2", F.lit(0))
    return out.select(*rows.columns, ((s + F.col("overall") * weight) / (n + weight)).alias("baseline_rate"))


def unseen_rows(df: DataFrame, as_of: str) -> DataFrame:
    """Defaults for contests to be scored: event, organizer, region, ranks and date."""
    event = X.clean_event(F.col("event"))
    return df.select("match_id", F.coalesce(F.to_date(X.parse_date(F.col("date"))), F.lit(as_of).cast("date")).alias("date"), event.alias("event"),
                     F.coalesce("organizer", X.infer_organizer(event)).alias("organizer"), F.coalesce("region", F.lit("Unknown")).alias("region"),
                     F.coalesce("is_lan", F.lit(False)).alias("is_lan"), X.normalize_format(F.col("match_format")).alias("match_format"),
                     X.normalize_name(F.col("team1_id")).alias("team1_id"), X.normalize_name(F.col("team2_id")).alias("team2_id"),
                     X.safe_rank(F.col("team1_rank")).alias("team1_rank"), X.safe_rank(F.col("team2_rank")).alias("team2_rank"))
