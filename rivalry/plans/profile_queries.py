"""Team profiles: streaks, maps and opponents."""

from __future__ import annotations

from rivalry.operators import corpus as Q
from rivalry.plans.feature_queries import SIDES, STREAKS, rounded
from rivalry.plans.registry import over, query
from rivalry.plans.veto_queries import AS_OF


@query("A29_profile_streak", over("maps", body=f"""{SIDES} {STREAKS.split(', last_loss AS')[0]}, rd AS (SELECT * FROM res WHERE date < DATE '{AS_OF}'),
    ll AS (SELECT team, max(date) FILTER (loss = 1) AS last_loss FROM rd GROUP BY 1)
    SELECT r.team, l.last_loss, CAST(coalesce(sum(r.win) FILTER (l.last_loss IS NULL OR r.date > l.last_loss), 0) AS BIGINT) AS win_streak
    FROM rd r JOIN ll l USING (team) GROUP BY 1, 2"""))
def profile_streak(t):
    return Q.team_streak(t.view("maps"), AS_OF)


@query("A29_profile_maps", over("maps", body=f"""{SIDES}, h AS (SELECT * FROM sides WHERE date < DATE '{AS_OF}'),
    rc AS (SELECT team, map_name, count(*) AS maps, count(*) FILTER (score_self > score_opp) AS wins FROM h WHERE date >= DATE '{AS_OF}' - 90 GROUP BY 1, 2),
    fp AS (SELECT team, match_id, arg_min(map_name, map_pos) FILTER (picked) AS map_name FROM h WHERE date >= DATE '{AS_OF}' - 30 GROUP BY 1, 2),
    pk AS (SELECT team, map_name, count(*) AS picks FROM fp WHERE map_name IS NOT NULL GROUP BY 1, 2),
    ts AS (SELECT team, count(*) AS series FROM fp GROUP BY 1)
    SELECT coalesce(rc.team, pk.team) AS team, coalesce(rc.map_name, pk.map_name) AS map_name, coalesce(maps, 0) AS maps, coalesce(wins, 0) AS wins, round(wins / maps, 6) AS win_rate,
           coalesce(picks, 0) AS picks, coalesce(series, 0) AS series, round(coalesce(picks, 0) / nullif(series, 0), 6) AS pick_rate
    FROM rc FULL JOIN pk ON pk.team = rc.team AND pk.map_name = rc.map_name LEFT JOIN ts ON ts.team = coalesce(rc.team, pk.team)"""))
def profile_maps(t):
    return rounded(Q.team_maps(t.view("maps"), AS_OF))


@query("A29_profile_head_to_head", over("maps", body=f"""{SIDES} SELECT team, opponent, count(*) FILTER (date >= DATE '{AS_OF}' - 30) AS maps_30d,
    count(*) FILTER (date >= DATE '{AS_OF}' - 90) AS maps_90d, count(*) AS maps_all, count(*) FILTER (won AND date >= DATE '{AS_OF}' - 30) AS wins_30d,
    count(*) FILTER (won AND date >= DATE '{AS_OF}' - 90) AS wins_90d, count(*) FILTER (won) AS wins_all FROM sides WHERE date < DATE '{AS_OF}' GROUP BY 1, 2"""))
def profile_head_to_head(t):
    return Q.head_to_head_record(t.view("maps"), AS_OF)
