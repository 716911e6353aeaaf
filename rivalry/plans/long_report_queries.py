"""The performance report as one long table, checked row by row."""

from __future__ import annotations

from rivalry.operators import ledger as L
from rivalry.plans.feature_queries import rounded
from rivalry.plans.registry import query
from rivalry.plans.report_queries import EDGE_SQL, _WILSON, latest_frame, latest_sql
from rivalry.session import persist_table


def _long(part: str, key: str, source: str) -> str:
    """Rows of a table whose columns are the part's measures, unpivoted."""
    return " UNION ALL ".join(f"SELECT '{part}' AS part, CAST({key} AS VARCHAR) AS key, '{m}' AS measure, CAST(\"{m}\" AS DOUBLE) AS value FROM {source}"
                              for m in L.REPORT[part][1])


def _bins(name: str, frame: str, first: int) -> str:
    """CTEs of the equal-width and equal-count bins of a frame with their records, and their summaries."""
    fixed = f"""{name}_g AS (SELECT b.lo AS k, count(f.won) AS n, count(*) FILTER (f.won) AS w, avg(f.assigned_prob) AS p
        FROM (SELECT unnest(range({first}, 100, 5)) AS lo) b LEFT JOIN {frame} f ON f.assigned_prob >= b.lo / 100.0E0
        AND (f.assigned_prob < (b.lo + 5) / 100.0E0 OR b.lo = 95) GROUP BY 1)"""
    equal = f"""{name}_o AS (SELECT *, row_number() OVER (ORDER BY assigned_prob, CAST(won AS INT)) - 1 AS r FROM {frame}),
    {name}_c AS (SELECT i, floor(i * n / (1.0 * k)) AS s, floor((i + 1) * n / (1.0 * k)) AS e FROM (SELECT count(*) AS n, least(10, count(*)) AS k FROM {frame}), (SELECT unnest(range(0, 10)) AS i) WHERE i < k),
    {name}_e AS (SELECT c.i AS k, count(*) AS n, count(*) FILTER (won) AS w, avg(assigned_prob) AS p FROM {name}_c c JOIN {name}_o o ON o.r >= c.s AND o.r < c.e GROUP BY 1)"""
    out = [fixed, equal]
    for kind in "ge":
        t = f"{name}_{kind}"
        out.append(f"""{t}m AS (SELECT k, j, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)) AS m
        FROM (SELECT *, unnest(range(0, n + 1)) AS j FROM {t}) WHERE p > 0 AND p < 1),
    {t}v AS (SELECT b.k, sum(m.m) FILTER (m.m <= x.m * (1 + 1e-7)) AS pv FROM {t} b JOIN {t}m m USING (k) JOIN {t}m x ON x.k = b.k AND x.j = b.w GROUP BY 1),
    {t}r AS (SELECT b.k, n AS "count", w AS wins, round(p, 6) AS avg_prob, round(w / nullif(n, 0), 6) AS observed, {_WILSON},
        round(w / nullif(n, 0) - p, 6) AS error, round(least(pv, 1), 6) AS p_value FROM {t} b LEFT JOIN {t}v USING (k)),
    {t}s AS (SELECT CAST(sum(n) AS BIGINT) AS evaluations, round(sum(p * n), 6) AS expected_wins, CAST(sum(w) AS BIGINT) AS observed_wins,
        round(sum(abs(w / n - p) * n) / sum(n), 6) AS ece, round(max(abs(w / n - p)), 6) AS mce, round(sum((w / n - p) * n) / sum(n), 6) AS signed_bias FROM {t} WHERE n > 0)""")
    return ",\n    ".join(out)


_EDGES, _EDGE_SELECT = EDGE_SQL.split("\nSELECT slice, ")
_SUMMARY = """sm AS (SELECT count(*) AS total_matches, count(*) FILTER (valid_for_eval = 1) AS valid_matches, (SELECT count(*) FROM settled) AS settled,
    count(*) FILTER (valid_for_eval = 1 AND result = 'Pending') AS pending, count(*) FILTER (valid_for_eval = 1 AND result NOT IN ('team_a', 'team_b', 'Pending')) AS other,
    count(*) FILTER (valid_for_eval <> 1) AS excluded, (SELECT count(*) FROM favf WHERE won) AS model_correct,
    (SELECT count(*) FROM settled WHERE result = CASE WHEN odds_a < odds_b THEN 'team_a' ELSE 'team_b' END) AS bookie_correct,
    (SELECT count(*) FROM settled WHERE odds_a IS NOT NULL AND odds_b IS NOT NULL) AS n_with_odds,
    (SELECT round(avg(CAST(won AS INT)), 6) FROM favf) AS model_accuracy,
    (SELECT round(avg(CASE WHEN result = CASE WHEN odds_a < odds_b THEN 'team_a' ELSE 'team_b' END THEN 1.0E0 ELSE 0 END), 6) FROM settled) AS bookie_accuracy,
    (SELECT round(avg((model_prob_a - CAST(result = 'team_a' AS INT)) ** 2), 6) FROM settled) AS brier,
    (SELECT round(-avg(CASE WHEN result = 'team_a' THEN ln(greatest(least(model_prob_a, 0.9999), 0.0001))
        ELSE ln(1 - greatest(least(model_prob_a, 0.9999), 0.0001)) END), 6) FROM settled) AS log_loss FROM latest)"""
_REASONS = """rs AS (SELECT 'excluded|' || coalesce(nullif(eval_exclusion_reason, ''), 'unspecified') AS k, count(*) AS "count" FROM latest WHERE valid_for_eval <> 1 GROUP BY 1
    UNION ALL SELECT 'other_result|' || result, count(*) FROM latest WHERE valid_for_eval = 1 AND result NOT IN ('team_a', 'team_b', 'Pending') GROUP BY 1)"""
_UPSETS = """up AS (SELECT match_url, round(greatest(model_prob_a, 1 - model_prob_a), 6) AS favourite_prob FROM settled
    WHERE result <> CASE WHEN model_prob_a >= 0.5 THEN 'team_a' ELSE 'team_b' END
    ORDER BY greatest(model_prob_a, 1 - model_prob_a) DESC, match_date DESC, match_time DESC, match_url LIMIT 5)"""
_PARTS = [_long("summary", "''", "sm"), _long("reasons", "k", "rs"), _long("edge_stats", "slice", "es"), _long("biggest_upsets", "match_url", "up")] + [
    _long(f"{part}_{what}", "k" if what == "bins" else "''", f"{source}{'r' if what == 'bins' else 's'}")
    for part, source in (("calibration", "team_g"), ("adaptive", "team_e"), ("favourite", "fav_g"), ("favourite_adaptive", "fav_e")) for what in ("bins", "summary")]


@query("L9_report_rows", latest_sql(f"""{_EDGES}, es AS (SELECT slice, {_EDGE_SELECT}), {_SUMMARY}, {_REASONS}, {_UPSETS},
    {_bins("team", "teamf", 0)}, {_bins("fav", "favf", 50)}
    SELECT part, key, measure, round(value, 6) AS value FROM ({" UNION ALL ".join(_PARTS)})"""))
def report_rows(t):
    """Every row of all twelve tables of the report."""
    return rounded(L.report_rows(persist_table(latest_frame(t))))
