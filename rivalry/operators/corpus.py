"""Corpus statistics, team directory and team profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry import constants as C


def corpus_stats(maps: DataFrame, pool: list[str] = C.ACTIVE_POOL) -> DataFrame:
    """(kind, key, value) rows: teams, series per format, rounds, map popularity incl. zeros, dates."""
    series = maps.groupBy("match_id", "date", "match_format").agg(F.count("*").alias("n"))
    formats = series.groupBy("match_format").agg(F.count("*").cast("double").alias("v")).select(F.lit("format").alias("kind"), F.col("match_format").alias("key"), F.col("v").alias("value"))
    teams = maps.select(F.explode(F.array("team_a_id", "team_b_id")).alias("t")).distinct().agg(F.count("*").cast("double").alias("value")).select(F.lit("teams").alias("kind"), F.lit("all").alias("key"), "value")
    rounds = F.col("score_a") + F.col("score_b")
    totals = maps.agg(F.count("*").cast("double").alias("maps"), F.sum(rounds).cast("double").alias("rounds"), F.avg(rounds).alias("rounds_per_map"),
                      *[F.count_if(F.col("map_name") == m).cast("double").alias(f"map:{m}") for m in pool],
                      F.unix_date(F.min("date")).cast("double").alias("first_day"), F.unix_date(F.max("date")).cast("double").alias("last_day"))
    rows = totals.select(F.inline(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in totals.columns])))
    return formats.unionByName(teams).unionByName(rows)


def team_directory(maps: DataFrame, default: int = C.UNRANKED) -> DataFrame:
    """Last name and rank per team across both sides; unranked teams come last."""
    def view(s: str) -> Column:
        name = F.col(f"team_{s}_name") if f"team_{s}_name" in maps.columns else F.col(f"team_{s}_id").cast("string")
        return F.struct(F.col(f"team_{s}_id").alias("team"), name.alias("name"), F.coalesce(F.col(f"team_{s}_world_rank"), F.lit(default)).alias("rank"), F.lit(s).alias("side"))

    rows = maps.select("date", "match_id", "map_pos", F.inline(F.array(view("a"), view("b")))).where(F.col("team").isNotNull())
    last = rows.groupBy("team").agg(F.max_by(F.struct("name", "rank"), F.struct("date", "match_id", "map_pos", "side")).alias("r"))
    return last.select("team", "r.*").orderBy(F.when(F.col("rank") == default, 9999).otherwise(F.col("rank")), "name")


def team_profile(maps: DataFrame, as_of: str) -> DataFrame:
    """90/30-day and all-time records, LAN rate and mean opponent rank per team, before ``as_of``."""
    from rivalry.operators.features import side_rows

    s = side_rows(maps.where(F.to_date("date") < F.lit(as_of).cast("date")))
    win = F.col("score_self") > F.col("score_opp")

    def within(days: int) -> Column:
        return F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)

    g = s.groupBy("team").agg(
        F.count("*").alias("maps_all"), F.count_if(win).alias("wins_all"),
        *[F.count_if(within(d)).alias(f"maps_{d}") for d in (90, 30)], *[F.count_if(within(d) & win).alias(f"wins_{d}") for d in (90, 30)],
        F.avg(F.when(within(30), F.col("is_lan").cast("int"))).alias("lan_rate_30"), F.avg(F.when(within(90), F.col("opp_log_rank"))).alias("lr"))
    return g.select("team", "maps_all", "wins_all", "maps_90", "wins_90", "maps_30", "wins_30", F.try_divide("wins_90", "maps_90").alias("win_rate_90"), "lan_rate_30",
                    F.round(F.coalesce(F.exp("lr"), F.lit(float(C.DEFAULT_OPPONENT_RANK))), 1).alias("avg_opponent_rank_90"))


def sample_flags(team_maps_30: Column, map_maps: Column, need_team: int = 10, need_map: int = 3) -> dict[str, Column]:
    return {"low_team_sample": team_maps_30 < need_team, "low_map_sample": map_maps < need_map}


def team_streak(maps: DataFrame, as_of: str) -> DataFrame:
    """(team, last_loss, win_streak): series won since the day of the last lost one, before ``as_of``.

    Series are rolled up to one short row per team and day first, so a team's two passes
    read days, not maps. A series with a forfeit counts for neither side.
    """
    from rivalry.operators.features import series_rows

    day = F.to_date("date")
    s = series_rows(maps.where(day < F.lit(as_of).cast("date")))
    days = s.groupBy("team", "date").agg(F.sum("series_won").alias("wins"), F.sum("series_lost").alias("losses"))
    last = days.groupBy("team").agg(F.max(F.when(F.col("losses") > 0, F.col("date"))).alias("last_loss"))
    since = F.col("last_loss").isNull() | (F.col("date") > F.col("last_loss"))
    return days.join(last, "team").groupBy("team", "last_loss").agg(F.sum(F.when(since, F.col("wins")).otherwise(0)).cast("long").alias("win_streak"))


def team_maps(maps: DataFrame, as_of: str, map_days: int = C.MAP_DAYS, pick_days: int = 30) -> DataFrame:
    """Per team and map: record of the last ``map_days`` and how often it was the team's first pick in ``pick_days``.

    One row per (team, series, map) is counted on the map side; rates are null without rows.
    """
    from rivalry.operators.features import side_rows

    limit = F.lit(as_of).cast("date")
    s = side_rows(maps.where(F.to_date("date") < limit))
    recent = F.col("date") >= F.date_sub(limit, pick_days)
    record = s.where(F.col("date") >= F.date_sub(limit, map_days)).groupBy("team", "map_name").agg(
        F.count("*").alias("maps"), F.count_if(F.col("score_self") > F.col("score_opp")).alias("wins"))
    series = s.where(recent).groupBy("team", "match_id").agg(F.min_by("map_name", F.when(F.col("picked"), F.col("map_pos"))).alias("map_name"))
    picks = series.where(F.col("map_name").isNotNull()).groupBy("team", "map_name").agg(F.count("*").alias("picks"))
    total = series.groupBy("team").agg(F.count("*").alias("series"))
    rows = record.join(picks, ["team", "map_name"], "full").join(total, "team", "left").fillna(0, ["maps", "wins", "picks", "series"])
    return rows.select("team", "map_name", "maps", "wins", F.try_divide("wins", "maps").alias("win_rate"), "picks", "series", F.try_divide("picks", "series").alias("pick_rate"))


def head_to_head_record(maps: DataFrame, as_of: str, windows: tuple[int, ...] = (30, 90)) -> DataFrame:
    """Per team and opponent: maps met and won, within each window and over all time."""
    from rivalry.operators.features import side_rows

    limit = F.lit(as_of).cast("date")
    s = side_rows(maps.where(F.to_date("date") < limit))
    parts = [(f"{d}d", F.col("date") >= F.date_sub(limit, d)) for d in windows] + [("all", F.lit(True))]
    return s.groupBy("team", "opponent").agg(*[F.count_if(c).alias(f"maps_{n}") for n, c in parts], *[F.count_if(c & F.col("won")).alias(f"wins_{n}") for n, c in parts])
