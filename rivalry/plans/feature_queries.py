"""Point-in-time feature queries; the checks use correlated range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.operators import features as X
from rivalry.operators import ranks as R
from rivalry.plans.registry import Tables, over, query


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds every floating column, so that two engines agree on the last digits."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def feature_maps(t: Tables) -> DataFrame:
    """The map rows with what the features read; history, pairs and the rows themselves share them."""
    return t.stored("maps", ", ".join(c for c in t.view("maps").columns if c in X.INPUT))


SIDES = """, sides AS (
  SELECT match_id, map_pos, map_name, date, is_lan, match_has_forfeit, 'a' AS side, team_a_id AS team,
         team_b_id AS opponent, score_a AS score_self, score_b AS score_opp,
         ln(greatest(team_b_world_rank, 1)) AS opp_log_rank, winner_id = team_a_id AS won, team_a_picked AS picked FROM maps
  UNION ALL
  SELECT match_id, map_pos, map_name, date, is_lan, match_has_forfeit, 'b', team_b_id, team_a_id, score_b, score_a,
         ln(greatest(team_a_world_rank, 1)), winner_id = team_b_id, team_b_picked FROM maps)
, days AS (SELECT DISTINCT team, date FROM sides)"""


def _window(n: int, value: str) -> str:
    return f"{value} FILTER (h.date >= d.date - {n})"


def _days(body: str) -> str:
    return over("maps", body=f"""{SIDES}
    SELECT d.team, d.date, {body}
    FROM days d LEFT JOIN sides h ON h.team = d.team AND h.date < d.date AND h.date >= d.date - 90
    GROUP BY d.team, d.date""")


def _team_days(t: Tables, *cols: str) -> DataFrame:
    state = X.team_state(X.daily_history(t.view("maps")))
    return rounded(state.groupBy("team", "date").agg(*[F.first(c).alias(c) for c in cols]))


@query("W0_side_rows", over("maps", body=f"{SIDES} SELECT match_id, map_pos, map_name, date, is_lan, match_has_forfeit, "
       "side, team, opponent, score_self, score_opp, round(opp_log_rank, 6) AS opp_log_rank, won, picked FROM sides"))
def side_rows(t):
    return rounded(X.side_rows(t.view("maps")))


@query("W1_form", _days(", ".join(
    f"round((coalesce({_window(n, 'sum(CASE WHEN h.score_self > h.score_opp THEN 1 ELSE 0 END)')}, 0) + 2.0E0) / "
    f"({_window(n, 'count(h.match_id)')} + 4), 6) AS form_{n}" for n in C.FORM_DAYS)
    + f", {_window(30, 'count(h.match_id)')} AS maps_30"))
def form(t):
    return _team_days(t, "form_90", "form_30", "form_7", "maps_30")


@query("W2_map_form", over("maps", body=f"""{SIDES}
    , md AS (SELECT DISTINCT team, map_name, date FROM sides)
    SELECT d.team, d.map_name, d.date,
           round((coalesce(sum(CASE WHEN h.won THEN 1 ELSE 0 END), 0) + 2.0E0) / (count(h.match_id) + 4), 6) AS map_form
    FROM md d LEFT JOIN sides h ON h.team = d.team AND h.map_name = d.map_name AND h.date < d.date AND h.date >= d.date - 90
    GROUP BY 1, 2, 3"""))
def map_form(t):
    return rounded(X.team_state(X.daily_history(t.view("maps"))).select("team", "map_name", "date", "map_form"))


@query("W3_sos", _days(", ".join(
    f"round(coalesce({_window(n, 'avg(h.opp_log_rank)')}, ln(100)), 6) AS sos_{n}" for n in (90, 30))))
def sos(t):
    return _team_days(t, "sos_90", "sos_30")


@query("W4_dominance_resilience", _days(
    f"round(coalesce({'avg(h.score_self - h.score_opp) FILTER (h.date >= d.date - 30 AND h.score_self > h.score_opp)'}, 0), 6) AS dominance, "
    f"round(coalesce({'avg(h.score_opp - h.score_self) FILTER (h.date >= d.date - 30 AND h.score_self < h.score_opp)'}, 0), 6) AS loss_margin"))
def dominance(t):
    return _team_days(t, "dominance", "loss_margin")


@query("W5_lan_rate", _days(f"round(coalesce({_window(30, 'avg(CASE WHEN h.is_lan THEN 1.0E0 ELSE 0 END)')}, 0), 6) AS lan_rate"))
def lan_rate(t):
    return _team_days(t, "lan_rate")


def _h2h_sql(days: tuple[int, ...]) -> str:
    cols = ", ".join(
        f"count(h.match_id) FILTER (h.date >= r.date - {n} AND h.w = r.team_{s}_id) AS h2h_{s}_wins_{n}d"
        for n in days for s in "ab")
    return over("maps", body=f""", p AS (SELECT match_id, date, least(team_a_id, team_b_id) AS lo, greatest(team_a_id, team_b_id) AS hi,
        CASE WHEN winner_id = team_a_id THEN team_a_id ELSE team_b_id END AS w FROM maps)
    SELECT r.match_id, r.map_pos, {cols}
    FROM maps r LEFT JOIN p h ON h.lo = least(r.team_a_id, r.team_b_id) AND h.hi = greatest(r.team_a_id, r.team_b_id)
      AND h.date < r.date AND h.date >= r.date - {max(days)}
    GROUP BY r.match_id, r.map_pos""")


@query("W6_h2h", _h2h_sql((14, 30, 90)))
def h2h(t):
    maps = t.view("maps")
    out = X.with_head_to_head(maps.select("match_id", "map_pos", "team_a_id", "team_b_id", "date"), maps, (14, 30, 90))
    return out.drop("team_a_id", "team_b_id", "date")


PICKS = """, picks AS (SELECT team, match_id, date, arg_min(map_name, map_pos) AS map_name FROM sides WHERE picked
   GROUP BY team, match_id, date)"""


@query("W7_comfort", over("maps", body=f"""{SIDES} {PICKS}
    , md AS (SELECT DISTINCT team, map_name, date FROM sides)
    SELECT d.team, d.map_name, d.date,
      round(coalesce(CAST(count(h.match_id) FILTER (h.map_name = d.map_name) AS DOUBLE) / nullif(count(h.match_id), 0), 0), 6) AS comfort
    FROM md d LEFT JOIN picks h ON h.team = d.team AND h.date < d.date AND h.date >= d.date - 30
    GROUP BY 1, 2, 3"""))
def comfort(t):
    return rounded(X.team_state(X.daily_history(t.view("maps"))).select("team", "map_name", "date", "comfort"))


STREAKS = """, won AS (SELECT match_id, date, team_a_id AS a, team_b_id AS b,
      count(*) FILTER (winner_id = team_a_id) AS wa, count(*) FILTER (winner_id = team_b_id) AS wb
    FROM maps GROUP BY ALL HAVING NOT bool_or(match_has_forfeit))
, res AS (SELECT a AS team, date, CAST(wa > wb AS INT) AS win, CAST(wa < wb AS INT) AS loss FROM won
    UNION ALL SELECT b, date, CAST(wb > wa AS INT), CAST(wb < wa AS INT) FROM won)
, last_loss AS (SELECT d.team, d.date, max(r.date) AS lost_on FROM days d
    LEFT JOIN res r ON r.team = d.team AND r.date < d.date AND r.loss = 1 GROUP BY 1, 2)
, streaks AS (SELECT d.team, d.date, CAST(coalesce(sum(r.win), 0) AS BIGINT) AS streak FROM last_loss d
    LEFT JOIN res r ON r.team = d.team AND r.date < d.date AND (d.lost_on IS NULL OR r.date > d.lost_on) GROUP BY 1, 2)"""


@query("W8_streak", over("maps", body=f"{SIDES} {STREAKS} SELECT team, date, streak FROM streaks"))
def streak(t):
    return _team_days(t, "streak")


@query("W9_rank_diff", over("maps", body="""
    SELECT match_id, map_pos, round(ln(greatest(team_b_world_rank, 1)) - ln(greatest(team_a_world_rank, 1)), 6) AS rank_diff,
      round((ln(greatest(team_b_world_rank, 1)) + ln(greatest(team_a_world_rank, 1))) / 2, 6) AS avg_log_rank,
      CAST(team_a_picked AS INT) - CAST(team_b_picked AS INT) AS picker_diff,
      CASE WHEN winner_id = team_a_id THEN 1 ELSE 0 END AS label FROM maps"""))
def rank_diff(t):
    return rounded(X.compute_features(feature_maps(t)).select(
        "match_id", "map_pos", "rank_diff", "avg_log_rank", "picker_diff", "label"))


FULL_FEATURES = f"""{SIDES} {PICKS} {STREAKS}
, st AS (SELECT d.team, d.date,
    {", ".join(f"(coalesce({_window(n, 'sum(CASE WHEN h.score_self > h.score_opp THEN 1 ELSE 0 END)')}, 0) + 2.0E0) / ({_window(n, 'count(h.match_id)')} + 4) AS form_{n}" for n in C.FORM_DAYS)},
    {_window(30, 'count(h.match_id)')} AS maps_30,
    coalesce(avg(h.opp_log_rank), ln(100)) AS sos_90, coalesce({_window(30, 'avg(h.opp_log_rank)')}, ln(100)) AS sos_30,
    coalesce(avg(h.score_self - h.score_opp) FILTER (h.date >= d.date - 30 AND h.score_self > h.score_opp), 0) AS dom,
    coalesce(avg(h.score_opp - h.score_self) FILTER (h.date >= d.date - 30 AND h.score_self < h.score_opp), 0) AS res,
    coalesce({_window(30, 'avg(CASE WHEN h.is_lan THEN 1.0E0 ELSE 0 END)')}, 0) AS lan
  FROM days d LEFT JOIN sides h ON h.team = d.team AND h.date < d.date AND h.date >= d.date - 90 GROUP BY 1, 2)
, md AS (SELECT DISTINCT team, map_name, date FROM sides)
, mf AS (SELECT d.team, d.map_name, d.date,
    (coalesce(sum(CASE WHEN h.won THEN 1 ELSE 0 END), 0) + 2.0E0) / (count(h.match_id) + 4) AS map_form
  FROM md d LEFT JOIN sides h ON h.team = d.team AND h.map_name = d.map_name AND h.date < d.date AND h.date >= d.date - 90 GROUP BY 1, 2, 3)
, cf AS (SELECT d.team, d.map_name, d.date,
    coalesce(CAST(count(h.match_id) FILTER (h.map_name = d.map_name) AS DOUBLE) / nullif(count(h.match_id), 0), 0) AS comfort
  FROM md d LEFT JOIN picks h ON h.team = d.team AND h.date < d.date AND h.date >= d.date - 30 GROUP BY 1, 2, 3)
, hh AS (SELECT r.match_id, r.map_pos, count(h.match_id) FILTER (h.w = r.team_a_id) AS h2h_a, count(h.match_id) FILTER (h.w = r.team_b_id) AS h2h_b
  FROM maps r LEFT JOIN (SELECT match_id, date, least(team_a_id, team_b_id) AS lo, greatest(team_a_id, team_b_id) AS hi,
        CASE WHEN winner_id = team_a_id THEN team_a_id ELSE team_b_id END AS w FROM maps) h
    ON h.lo = least(r.team_a_id, r.team_b_id) AND h.hi = greatest(r.team_a_id, r.team_b_id) AND h.date < r.date AND h.date >= r.date - 30
  GROUP BY 1, 2)
, feats AS (SELECT ln(greatest(m.team_b_world_rank, 1)) - ln(greatest(m.team_a_world_rank, 1)) AS rank_diff,
    a.form_90 - b.form_90 AS win_rate_90d_diff, a.form_30 - b.form_30 AS win_rate_30d_diff, a.form_7 - b.form_7 AS win_rate_7d_diff,
    ln(1.0E0 + sa.streak) AS team_a_win_streak, ln(1.0E0 + sb.streak) AS team_b_win_streak,
    CAST(m.team_a_picked AS INT) - CAST(m.team_b_picked AS INT) AS picker_diff,
    hh.h2h_a AS h2h_a_wins_30d, hh.h2h_b AS h2h_b_wins_30d, ma.map_form - mb.map_form AS map_win_rate_diff,
    ca.comfort - cb.comfort AS map_comfort_diff, a.dom - b.dom AS dominance_diff, b.res - a.res AS resilience_diff,
    (ln(greatest(m.team_b_world_rank, 1)) + ln(greatest(m.team_a_world_rank, 1))) / 2 AS avg_log_rank,
    b.sos_90 - a.sos_90 AS sos_90d_diff, b.sos_30 - a.sos_30 AS sos_diff, a.lan - b.lan AS lan_rate_diff,
    m.match_id, m.map_pos, m.map_name, m.date, m.team_a_id, m.team_b_id, m.match_format, m.score_a, m.score_b,
    m.match_has_forfeit, m.is_lan, a.maps_30 AS team_a_gen_matches_30d, b.maps_30 AS team_b_gen_matches_30d,
    CASE WHEN m.winner_id = m.team_a_id THEN 1 ELSE 0 END AS label
  FROM maps m JOIN st a ON a.team = m.team_a_id AND a.date = m.date JOIN st b ON b.team = m.team_b_id AND b.date = m.date
    JOIN streaks sa ON sa.team = m.team_a_id AND sa.date = m.date JOIN streaks sb ON sb.team = m.team_b_id AND sb.date = m.date
    JOIN mf ma ON ma.team = m.team_a_id AND ma.map_name = m.map_name AND ma.date = m.date
    JOIN mf mb ON mb.team = m.team_b_id AND mb.map_name = m.map_name AND mb.date = m.date
    JOIN cf ca ON ca.team = m.team_a_id AND ca.map_name = m.map_name AND ca.date = m.date
    JOIN cf cb ON cb.team = m.team_b_id AND cb.map_name = m.map_name AND cb.date = m.date
    JOIN hh ON hh.match_id = m.match_id AND hh.map_pos = m.map_pos)"""
_FLOATS = [f for f in C.MODEL_FEATURES if f not in ("picker_diff", "h2h_a_wins_30d", "h2h_b_wins_30d")]


def feature_columns(fmt: str = "round({0}, 6) AS {0}") -> str:
    return ", ".join(fmt.format(f) if f in _FLOATS else f for f in C.MODEL_FEATURES)


_META_SQL = ("match_id, map_pos, map_name, date, team_a_id, team_b_id, match_format, score_a, score_b, match_has_forfeit, "
             "is_lan, team_a_gen_matches_30d, team_b_gen_matches_30d, label")


@query("W10_compute_features", over("maps", body=f"{FULL_FEATURES} SELECT {feature_columns()}, {_META_SQL} FROM feats"))
def compute_features(t):
    return rounded(X.compute_features(feature_maps(t)))


@query("P13_min_history_filter", over("maps", body=f"""{SIDES}, n30 AS (
    SELECT d.team, d.date, count(h.match_id) AS n FROM days d
    LEFT JOIN sides h ON h.team = d.team AND h.date < d.date AND h.date >= d.date - 30 GROUP BY 1, 2)
    SELECT m.match_id, m.map_pos, a.n AS team_a_gen_matches_30d, b.n AS team_b_gen_matches_30d
    FROM maps m JOIN n30 a ON a.team = m.team_a_id AND a.date = m.date JOIN n30 b ON b.team = m.team_b_id AND b.date = m.date
    WHERE a.n >= 1 AND b.n >= 1"""))
def min_history(t):
    f = X.min_history_filter(X.compute_features(feature_maps(t)))
    return f.select("match_id", "map_pos", "team_a_gen_matches_30d", "team_b_gen_matches_30d")


def _mirror_sql() -> str:
    def other(f: str) -> str:
        if f.endswith("_diff"):
            return f"-{f}"
        for a, b in (("team_a_", "team_b_"), ("team_b_", "team_a_"), ("h2h_a_", "h2h_b_"), ("h2h_b_", "h2h_a_")):
            if f.startswith(a):
                return b + f[len(a):]
        return f

    plain = ", ".join(f"round({f}, 6) AS {f}" if f in _FLOATS else f for f in C.MODEL_FEATURES)
    swap = ", ".join(f"round({other(f)}, 6) AS {f}" if f in _FLOATS else f"{other(f)} AS {f}" for f in C.MODEL_FEATURES)
    return (f"SELECT match_id, map_pos, team_a_id, team_b_id, score_a, score_b, label, {plain} FROM feats UNION ALL "
            f"SELECT match_id, map_pos, team_b_id, team_a_id, score_b, score_a, 1 - label, {swap} FROM feats")


@query("P12_mirror_rows", over("maps", body=f"{FULL_FEATURES} {_mirror_sql()}"))
def mirror(t):
    m = X.mirror_rows(X.compute_features(feature_maps(t)))
    return rounded(m.select("match_id", "map_pos", "team_a_id", "team_b_id", "score_a", "score_b", "label",
                            *C.MODEL_FEATURES))


@query("P14_sample_depth_features", over("maps", body=f"""{SIDES}, n30 AS (
    SELECT d.team, d.date, count(h.match_id) AS n FROM days d
    LEFT JOIN sides h ON h.team = d.team AND h.date < d.date AND h.date >= d.date - 30 GROUP BY 1, 2)
    SELECT m.match_id, m.map_pos, a.n - b.n AS gen_matches_30d_diff, least(a.n, b.n) AS min_gen_matches_30d,
      round(ln(1.0E0 + a.n), 6) AS log_team_a_gen_matches_30d, round(ln(1.0E0 + b.n), 6) AS log_team_b_gen_matches_30d,
      round(ln(1.0E0 + a.n) - ln(1.0E0 + b.n), 6) AS log_gen_matches_30d_diff, round(ln(1.0E0 + least(a.n, b.n)), 6) AS log_min_gen_matches_30d
    FROM maps m JOIN n30 a ON a.team = m.team_a_id AND a.date = m.date JOIN n30 b ON b.team = m.team_b_id AND b.date = m.date"""))
def sample_depth(t):
    f = X.sample_depth_features(X.compute_features(feature_maps(t)))
    return rounded(f.select("match_id", "map_pos", "gen_matches_30d_diff", "min_gen_matches_30d",
                            "log_team_a_gen_matches_30d", "log_team_b_gen_matches_30d", "log_gen_matches_30d_diff",
                            "log_min_gen_matches_30d"))


_CARRY = """, obs AS (SELECT team_a_id AS team, date, team_a_{s}_rank AS r FROM maps UNION ALL SELECT team_b_id, date, team_b_{s}_rank FROM maps)
, known AS (SELECT team, date, min(r) AS r FROM obs WHERE r <> 750 GROUP BY 1, 2 HAVING count(DISTINCT r) = 1)"""


def _repair_sql() -> str:
    ctes, cols = "", []
    for s in ("world", "vrs"):
        ctes += _CARRY.format(s=s).replace("obs AS", f"obs_{s} AS").replace("FROM obs ", f"FROM obs_{s} ").replace("known AS", f"known_{s} AS")
        for side in "ab":
            rank, miss = f"m.team_{side}_{s}_rank", f"m.team_{side}_{s}_rank_missing"
            cols.append(f"CASE WHEN {rank} = 750 AND {miss} THEN coalesce((SELECT arg_max(k.r, k.date) FROM known_{s} k "
                        f"WHERE k.team = m.team_{side}_id AND k.date < m.date), 750) ELSE {rank} END AS team_{side}_{s}_rank")
    return over("maps", body=f"{ctes} SELECT m.match_id, m.map_pos, {', '.join(cols)} FROM maps m")


@query("J11_rank_carry_forward", _repair_sql())
def rank_carry_forward(t):
    return R.repair_default_ranks(t.view("maps")).select(
        "match_id", "map_pos", "team_a_world_rank", "team_b_world_rank", "team_a_vrs_rank", "team_b_vrs_rank")


def _combine_sql() -> str:
    def pick(side: str, how: str, default: int) -> str:
        w, v = (f"CAST(greatest(team_{side}_{s}_rank, 1) AS DOUBLE)" for s in ("world", "vrs"))
        wo, vo = (f"(NOT team_{side}_{s}_rank_missing AND team_{side}_{s}_rank <> 750)" for s in ("world", "vrs"))
        both = {"avg_available": f"({w} + {v}) / 2", "log_avg_available": f"exp((ln({w}) + ln({v})) / 2)",
                "best_available": f"least({w}, {v})", "weighted_world_vrs": f"0.65E0 * {w} + 0.35E0 * {v}"}.get(how)
        if both:
            return f"CASE WHEN {wo} AND {vo} THEN {both} WHEN {wo} THEN {w} WHEN {vo} THEN {v} ELSE {default} END"
        if how == "world_only":
            return f"CASE WHEN {wo} THEN {w} ELSE {default} END"
        if how == "vrs_only":
            return f"CASE WHEN {vo} THEN {v} ELSE {default} END"
        return f"CASE WHEN {wo} THEN {w} WHEN {vo} THEN {v} ELSE {default} END"

    cols = []
    for name, (how, default) in C.RANK_STRATEGIES.items():
        a, b = (f"ln(greatest({pick(s, how, default)}, 1))" for s in "ab")
        cols += [f"round({b} - {a}, 6) AS rank_{name}_diff", f"round(({a} + {b}) / 2, 6) AS avg_log_rank_{name}"]
    return over("maps", body=f" SELECT match_id, map_pos, {', '.join(cols)} FROM maps")


@query("P15_combine_ranks", _combine_sql())
def combine_ranks(t):
    f = R.rank_strategy_features(t.view("maps"))
    return rounded(f.select("match_id", "map_pos", *[c for c in f.columns if c.startswith(("rank_", "avg_log_rank_"))]))


_RANK_COLS = [f"team_{s}_{src}_rank" for s in "ab" for src in ("world", "vrs")]


@query("J1_rank_enrich", over("maps", body=f" SELECT match_id, map_name, date, team_a_id, team_b_id, map_pos, "
       f"{', '.join(_RANK_COLS)} FROM maps"))
def rank_enrich(t):
    maps = t.view("maps")
    keys = ["match_id", "map_name", "date", "team_a_id", "team_b_id"]
    return R.rank_enrich(maps.select(*keys, "map_pos"), maps.select(*keys, *_RANK_COLS), keys)


@query("W15_latest_rank", over("maps", body=""", o AS (
    SELECT team_a_id AS team, date, match_id, map_pos, 'a' AS side, team_a_world_rank AS r FROM maps
    UNION ALL SELECT team_b_id, date, match_id, map_pos, 'b', team_b_world_rank FROM maps)
    , l AS (SELECT team, r, row_number() OVER (PARTITION BY team ORDER BY date DESC, match_id DESC, map_pos DESC, side DESC) AS n FROM o WHERE r <> 750)
    SELECT t.team, coalesce(l.r, 750) AS latest_rank FROM (SELECT DISTINCT team FROM o) t LEFT JOIN l ON l.team = t.team AND l.n = 1"""))
def latest_rank(t):
    return X.latest_rank(t.view("maps"))


@query("W14_unseen_map_features", over("maps", body=f"{FULL_FEATURES} SELECT {feature_columns()}, match_id, map_pos, "
    "team_a_gen_matches_30d, team_b_gen_matches_30d FROM feats"))
def unseen_map_features(t):
    """Contests to be scored, without any outcome, get the features that the played rows have."""
    maps = feature_maps(t)
    unseen = maps.drop("winner_id", "score_a", "score_b")
    f = X.compute_features(maps, unseen)
    return rounded(f.select(*C.MODEL_FEATURES, "match_id", "map_pos", "team_a_gen_matches_30d", "team_b_gen_matches_30d"))
