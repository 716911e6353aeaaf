"""Metric, calibration and ledger-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.functions import stats as S
from rivalry.functions import text as X
from rivalry.operators import ledger as L
from rivalry.operators import metrics as M
from rivalry.plans.clean_queries import EXCLUDED, FORMAT
from rivalry.plans.feature_queries import SIDES, rounded
from rivalry.plans.registry import Tables, corpus, over, query


def latest_frame(t: Tables, median: bool = True):
    d = L.latest_snapshot(t.view("ledger_matches"), t.view("snapshots").drop("date"))
    return L.edge_columns(L.with_median_odds(d) if median else d)


LATEST = """, lst AS (SELECT match_url, max(id) AS id, count(*) AS num_snapshots FROM snapshots GROUP BY 1)
, lt0 AS (SELECT m.*, s.* EXCLUDE (match_url, date), l.num_snapshots,
    TRY_CAST(json_extract_string(s.odds_summary_json, '$.odds_a_median') AS DOUBLE) AS ma, TRY_CAST(json_extract_string(s.odds_summary_json, '$.odds_b_median') AS DOUBLE) AS mb
  FROM ledger_matches m JOIN lst l USING (match_url) JOIN snapshots s ON s.id = l.id)
, latest AS (SELECT * EXCLUDE (odds_a, odds_b, ma, mb), CASE WHEN ma > 0 AND mb > 0 THEN ma ELSE odds_a END AS odds_a, CASE WHEN ma > 0 AND mb > 0 THEN mb ELSE odds_b END AS odds_b,
    CASE WHEN edge_a IS NOT NULL AND edge_b IS NOT NULL THEN CASE WHEN edge_a >= edge_b THEN 'team_a' ELSE 'team_b' END ELSE CASE WHEN model_prob_a >= 0.5 THEN 'team_a' ELSE 'team_b' END END AS best_bet,
    round(CASE WHEN edge_a IS NOT NULL AND edge_b IS NOT NULL THEN greatest(edge_a, edge_b) END, 2) AS best_edge FROM lt0)
, settled AS (SELECT * FROM latest WHERE valid_for_eval = 1 AND result IN ('team_a', 'team_b'))
, teamf AS (SELECT match_url, team_a AS team, model_prob_a AS assigned_prob, result = 'team_a' AS won, odds_a AS odds FROM settled
   UNION ALL SELECT match_url, team_b, 1 - model_prob_a, result = 'team_b', odds_b FROM settled)
, favf AS (SELECT match_url, CASE WHEN model_prob_a >= 0.5 THEN team_a ELSE team_b END AS team, CASE WHEN model_prob_a >= 0.5 THEN team_b ELSE team_a END AS opponent,
    CASE WHEN model_prob_a >= 0.5 THEN model_prob_a ELSE 1 - model_prob_a END AS assigned_prob, result = CASE WHEN model_prob_a >= 0.5 THEN 'team_a' ELSE 'team_b' END AS won,
    CASE WHEN model_prob_a >= 0.5 THEN odds_a ELSE odds_b END AS odds FROM settled)"""


def latest_sql(body: str) -> str:
    return over("ledger_matches", "snapshots", body=LATEST + " " + body)


@query("J3_latest_snapshot", latest_sql("SELECT match_url, id, num_snapshots, result, round(model_prob_a, 6) AS model_prob_a FROM latest"))
def latest_snapshot(t):
    return rounded(latest_frame(t).select("match_url", "id", "num_snapshots", "result", "model_prob_a"))


@query("W23_snapshot_sequence", latest_sql("SELECT match_url, num_snapshots, id AS last_id FROM lst"))
def snapshot_sequence(t):
    return t.view("snapshots").groupBy("match_url").agg(F.count("*").alias("num_snapshots"), F.max("id").alias("last_id"))


@query("J4_version_usage", over("versions", "snapshots", body=""" SELECT v.version_id, v.trained_at, count(DISTINCT s.match_url) AS matches_predicted
    FROM versions v LEFT JOIN snapshots s USING (version_id) GROUP BY 1, 2"""))
def version_usage(t):
    return L.version_usage(t.view("versions"), t.view("snapshots")).select("version_id", "trained_at", "matches_predicted")


@query("J5_odds_history", over("book_odds", body=""" SELECT b.snapshot_id, b.bookmaker, b.b, round(b.odds_a, 6) AS odds_a, round(b.odds_b, 6) AS odds_b, s.version_id
    FROM book_odds b JOIN snapshots s ON s.id = b.snapshot_id WHERE b.match_url = 42"""))
def odds_history(t):
    h = L.odds_history(t.view("book_odds"), t.view("snapshots"), 42)
    return rounded(h.select("snapshot_id", "bookmaker", "b", "odds_a", "odds_b", "version_id"))


@query("X20_json_field", over("versions", "snapshots", body=""" SELECT v.version_id, CAST(json_extract_string(data_stats_json, '$.total_maps') AS BIGINT) AS training_maps,
    json_extract_string(data_stats_json, '$.date_range.start') AS train_start FROM versions v"""))
def json_field(t):
    j = F.col("data_stats_json")
    return t.view("versions").select("version_id", F.get_json_object(j, "$.total_maps").try_cast("long").alias("training_maps"),
                                     F.get_json_object(j, "$.date_range.start").alias("train_start"))


@query("L10_model_payload", over("versions", "snapshots", body=""" , v AS (SELECT * FROM versions ORDER BY trained_at DESC LIMIT 10), u AS (SELECT version_id, count(DISTINCT match_url) AS n FROM snapshots GROUP BY 1)
    SELECT v.version_id, v.trained_at, coalesce(u.n, 0) AS matches_predicted, round(v.test_brier_score, 4) AS brier_score, round(v.test_log_loss, 4) AS log_loss FROM v LEFT JOIN u USING (version_id)"""))
def model_payload(t):
    v = t.view("versions")
    ev = v.select("version_id", F.col("test_brier_score").alias("brier_score"), F.col("test_log_loss").alias("log_loss"))
    return L.model_payload(v, t.view("snapshots"), ev, 10).select("version_id", "trained_at", "matches_predicted", "brier_score", "log_loss")


@query("T7_active_first", over("versions", body=" SELECT version_id, trained_at, CAST(version_id = 'v7' AS INT) AS is_active FROM versions ORDER BY version_id = 'v7' DESC, trained_at DESC LIMIT 5"))
def active_first(t):
    return L.active_first(L.set_active(t.view("versions"), "v7"), 5).select("version_id", "trained_at", "is_active")


@query("L5_team_calibration_frame", latest_sql("SELECT match_url, team, round(assigned_prob, 6) AS assigned_prob, won, round(odds, 6) AS odds FROM teamf"))
def team_frame(t):
    return rounded(L.team_calibration_frame(L.settled_rows(latest_frame(t))).drop("opponent"))


@query("L6_favourite_frame", latest_sql("SELECT match_url, team, opponent, round(assigned_prob, 6) AS assigned_prob, won, round(odds, 6) AS odds FROM favf"))
def favourite_frame(t):
    return rounded(L.favourite_frame(L.settled_rows(latest_frame(t))))


@query("L7_fair_adjustment", over("snapshots", body=""" SELECT id, CASE WHEN id % 10 = 0 THEN 'unavailable' WHEN odds_a IS NULL THEN 'missing_odds' ELSE 'applied' END AS status,
    CASE WHEN id % 10 <> 0 THEN round((1 - f) * ((1 / odds_a) / (1 / odds_a + 1 / odds_b)) + 0.5 * f, 6) END AS fair_prob_a,
    CASE WHEN id % 10 <> 0 THEN round((1 - f) * ((1 / odds_b) / (1 / odds_a + 1 / odds_b)) + 0.5 * f, 6) END AS fair_prob_b FROM (SELECT *, CAST(id % 40 AS DOUBLE) / 100 AS f FROM snapshots)"""))
def fair_adjustment(t):
    s = t.view("snapshots").withColumn("forfeit_prob", F.when(F.col("id") % 10 != 0, (F.col("id") % 40).cast("double") / 100))
    return L.fair_adjustment(s).select("id", "status", "fair_prob_a", "fair_prob_b")


@query("L8_edge_columns", latest_sql("""SELECT id, best_bet, best_edge, round(1 / s.odds_a, 4) AS implied_a_4, round(1 / s.odds_b, 4) AS implied_b_4, round(l.edge_a, 2) AS edge_a_2, round(l.edge_b, 2) AS edge_b_2,
    coalesce(l.edge_a > 2, false) AS value_a, coalesce(l.edge_b > 2, false) AS value_b FROM latest l JOIN (SELECT id AS sid, odds_a, odds_b FROM snapshots) s ON s.sid = l.id"""))
def edge_columns(t):
    return latest_frame(t, median=False).select("id", "best_bet", "best_edge", "implied_a_4", "implied_b_4", "edge_a_2", "edge_b_2", "value_a", "value_b")


@query("X9_implied_no_vig", over("book_odds", body=""" SELECT snapshot_id, b, round(1 / odds_a, 6) AS implied_a, round((1 / odds_a) / (1 / odds_a + 1 / odds_b), 6) AS no_vig_a,
    round((1 / odds_b) / (1 / odds_a + 1 / odds_b), 6) AS no_vig_b, round(1 / odds_a + 1 / odds_b, 6) AS overround FROM book_odds"""))
def implied(t):
    a, b, total = L.no_vig(F.col("odds_a"), F.col("odds_b"))
    return rounded(t.view("book_odds").select("snapshot_id", "b", (1 / L.safe_odds(F.col("odds_a"))).alias("implied_a"), a.alias("no_vig_a"), b.alias("no_vig_b"), total.alias("overround")))


@query("X16_fair_probs", over("snapshots", body=" SELECT id, round((1 - f) * model_prob_a + 0.5 * f, 6) AS fair_a, round((1 - f) * (1 - model_prob_a) + 0.5 * f, 6) AS fair_b FROM (SELECT *, CAST(id % 40 AS DOUBLE) / 100 AS f FROM snapshots)"))
def fair_probs(t):
    a, b = L.fair_probs(F.col("model_prob_a"), (F.col("id") % 40).cast("double") / 100)
    return rounded(t.view("snapshots").select("id", a.alias("fair_a"), b.alias("fair_b")))


@query("A24_odds_summary", over("book_odds", body=" SELECT snapshot_id, count(*) AS book_count, " + ", ".join(
    f"round({f}(odds_{s}), 6) AS odds_{s}_{n}" for s in "ab" for f, n in (("median", "median"), ("avg", "mean"), ("min", "min"), ("max", "max")))
    + " FROM book_odds WHERE odds_a IS NOT NULL AND odds_b IS NOT NULL GROUP BY 1"))
def odds_summary(t):
    return rounded(L.odds_summary(t.view("book_odds"), ["snapshot_id"]))


@query("S7_dedupe_book_odds", over("book_odds", body=""" SELECT snapshot_id, lower(bookmaker) AS book, round(odds_a, 3) AS a, round(odds_b, 3) AS b3, min(b) AS b FROM book_odds
    WHERE odds_a IS NOT NULL AND odds_b IS NOT NULL GROUP BY 1, 2, 3, 4"""))
def dedupe_books(t):
    d = L.dedupe_books(t.view("book_odds"), ["snapshot_id"])
    return d.select("snapshot_id", F.lower("bookmaker").alias("book"), F.round("odds_a", 3).alias("a"), F.round("odds_b", 3).alias("b3"), "b")


@query("A16_ledger_summary", latest_sql("""SELECT count(*) AS total_matches, count(*) FILTER (valid_for_eval = 1) AS valid_matches, (SELECT count(*) FROM settled) AS settled,
    count(*) FILTER (valid_for_eval = 1 AND result = 'Pending') AS pending, count(*) FILTER (valid_for_eval = 1 AND result NOT IN ('team_a', 'team_b', 'Pending')) AS other,
    count(*) FILTER (valid_for_eval <> 1) AS excluded, (SELECT count(*) FROM favf WHERE won) AS model_correct,
    (SELECT count(*) FROM settled WHERE result = CASE WHEN odds_a < odds_b THEN 'team_a' ELSE 'team_b' END) AS bookie_correct,
    (SELECT count(*) FROM settled WHERE odds_a IS NOT NULL AND odds_b IS NOT NULL) AS n_with_odds,
    (SELECT round(avg(CAST(won AS INT)), 6) FROM favf) AS model_accuracy, (SELECT round(avg(CASE WHEN result = CASE WHEN odds_a < odds_b THEN 'team_a' ELSE 'team_b' END THEN 1.0E0 ELSE 0 END), 6) FROM settled) AS bookie_accuracy,
    (SELECT round(avg((model_prob_a - CAST(result = 'team_a' AS INT)) ** 2), 6) FROM settled) AS brier,
    (SELECT round(-avg(CASE WHEN result = 'team_a' THEN ln(greatest(least(model_prob_a, 0.9999), 0.0001)) ELSE ln(1 - greatest(least(model_prob_a, 0.9999), 0.0001)) END), 6) FROM settled) AS log_loss FROM latest"""))
def ledger_summary(t):
    return rounded(L.ledger_summary(latest_frame(t)))


@query("A17_reason_counts", latest_sql("""SELECT 'excluded' AS kind, coalesce(nullif(eval_exclusion_reason, ''), 'unspecified') AS value, count(*) AS "count" FROM latest WHERE valid_for_eval <> 1 GROUP BY 2
    UNION ALL SELECT 'other_result', result, count(*) FROM latest WHERE valid_for_eval = 1 AND result NOT IN ('team_a', 'team_b', 'Pending') GROUP BY 2"""))
def reason_counts(t):
    return L.reason_counts(latest_frame(t))


_FIXED = """, b AS (SELECT unnest(range(0, 100, 5)) AS lo), g AS (SELECT b.lo, count(f.won) AS n, count(*) FILTER (f.won) AS w, avg(f.assigned_prob) AS p
    FROM b LEFT JOIN teamf f ON f.assigned_prob >= b.lo / 100.0E0 AND (f.assigned_prob < (b.lo + 5) / 100.0E0 OR b.lo = 95) GROUP BY 1)"""


@query("A11_fixed_calibration_bins", latest_sql(f"""{_FIXED} SELECT CAST(lo AS INT) AS lo, CAST(lo + 5 AS INT) AS hi, n AS "count", w AS wins, round(p, 6) AS avg_prob FROM g"""))
def fixed_bins(t):
    return rounded(M.fixed_bins(L.team_calibration_frame(L.settled_rows(latest_frame(t)))))


_ADAPT = """, o AS (SELECT *, row_number() OVER (ORDER BY assigned_prob, CAST(won AS INT)) - 1 AS r, count(*) OVER () AS n FROM teamf)
, c AS (SELECT i, floor(i * n / 10.0) AS s, floor((i + 1) * n / 10.0) AS e FROM (SELECT unnest(range(0, 10)) AS i), (SELECT count(*) AS n FROM teamf))
, ad AS (SELECT c.i AS bin_no, min(assigned_prob) AS lo, max(assigned_prob) AS hi, count(*) AS n, count(*) FILTER (won) AS w, avg(assigned_prob) AS p FROM c JOIN o ON o.r >= c.s AND o.r < c.e GROUP BY 1)"""


@query("A12_adaptive_calibration_bins", latest_sql(f"""{_ADAPT} SELECT bin_no, round(lo, 6) AS lo, round(hi, 6) AS hi, n AS "count", w AS wins, round(p, 6) AS avg_prob FROM ad"""))
def adaptive_bins(t):
    return rounded(M.adaptive_bins(L.team_calibration_frame(L.settled_rows(latest_frame(t)))))


_WILSON = """round(CASE WHEN n > 0 THEN greatest(0, ((w / n + 1.96 ** 2 / (2 * n)) - 1.96 * sqrt((w / n * (1 - w / n) + 1.96 ** 2 / (4 * n)) / n)) / (1 + 1.96 ** 2 / n)) END, 6) AS ci_low,
  round(CASE WHEN n > 0 THEN least(1, ((w / n + 1.96 ** 2 / (2 * n)) + 1.96 * sqrt((w / n * (1 - w / n) + 1.96 ** 2 / (4 * n)) / n)) / (1 + 1.96 ** 2 / n)) END, 6) AS ci_high"""
# exact binomial mass by log-gamma over all outcomes of a bin
_BINOM = """, pm AS (SELECT bin_no, j, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)) AS m FROM (SELECT *, unnest(range(0, n + 1)) AS j FROM bins_) WHERE p > 0 AND p < 1)
, pv AS (SELECT b.bin_no, sum(pm.m) FILTER (pm.m <= k.m * (1 + 1e-7)) AS pv FROM bins_ b JOIN pm USING (bin_no) JOIN pm k ON k.bin_no = b.bin_no AND k.j = b.w GROUP BY 1)"""


@query("A13_bin_record", latest_sql(f"""{_FIXED}, bins_ AS (SELECT lo AS bin_no, n, w, p FROM g) {_BINOM}
    SELECT CAST(b.bin_no AS INT) AS lo, n AS "count", w AS wins, n - w AS losses, round(p * n, 6) AS expected_wins, round(w - p * n, 6) AS delta_wins, round(w / nullif(n, 0), 6) AS observed,
      {_WILSON}, round(w / nullif(n, 0) - p, 6) AS error, round(least(pv, 1), 6) AS p_value,
      CASE WHEN n < 20 THEN 'Low sample' WHEN p IS NULL OR pv IS NULL THEN 'No signal' WHEN pv < 0.01 THEN 'Strong warning' WHEN pv < 0.05 THEN 'Suspicious' WHEN abs(w / n - p) >= 0.08 THEN 'Watch' ELSE 'Looks OK' END AS verdict
    FROM bins_ b LEFT JOIN pv USING (bin_no)"""))
def bin_record(t):
    r = M.bin_record(M.fixed_bins(L.team_calibration_frame(L.settled_rows(latest_frame(t)))))
    return rounded(r.drop("hi", "avg_prob", "abs_error"))


@query("X10_wilson_interval", over("forfeit_base", body=f""", g AS (SELECT team1_id, count(*) AS n, CAST(sum(forfeit_target) AS BIGINT) AS w FROM forfeit_base GROUP BY 1) SELECT team1_id, {_WILSON} FROM g"""))
def wilson(t):
    g = t.view("forfeit_base").groupBy("team1_id").agg(F.count("*").alias("n"), F.sum("forfeit_target").alias("w"))
    lo, hi = S.wilson(F.col("w"), F.col("n"))
    return rounded(g.select("team1_id", lo.alias("ci_low"), hi.alias("ci_high")))


@query("X11_binomial_p", over("forfeit_base", body=f""", bins_ AS (SELECT team1_id AS bin_no, count(*) AS n, CAST(sum(forfeit_target) AS BIGINT) AS w, 0.097E0 AS p FROM forfeit_base GROUP BY 1) {_BINOM}
    SELECT bin_no AS team1_id, round(least(pv, 1), 6) AS p_value FROM pv"""))
def binomial(t):
    g = t.view("forfeit_base").groupBy("team1_id").agg(F.count("*").alias("n"), F.sum("forfeit_target").alias("w"))
    return rounded(g.select("team1_id", S.binomial_p(F.col("w"), F.col("n"), F.lit(C.FORFEIT_PRIOR)).alias("p_value")))


@query("X13_verdict", over("forfeit_base", body=""", g AS (SELECT event, organizer, count(*) AS n, avg(forfeit_target) - 0.097E0 AS e, CAST(count(*) % 10 AS DOUBLE) / 100 AS p FROM forfeit_base GROUP BY 1, 2)
    SELECT event, organizer, CASE WHEN n < 20 THEN 'Low sample' WHEN p < 0.01 THEN 'Strong warning' WHEN p < 0.05 THEN 'Suspicious' WHEN abs(e) >= 0.08 THEN 'Watch' ELSE 'Looks OK' END AS verdict FROM g"""))
def verdict(t):
    g = t.view("forfeit_base").groupBy("event", "organizer").agg(F.count("*").alias("n"), (F.avg("forfeit_target") - 0.097).alias("e"))
    return g.select("event", "organizer", S.verdict(F.col("n"), F.col("e"), (F.col("n") % 10).cast("double") / 100).alias("verdict"))


@query("A14_calibration_summary", latest_sql(f"""{_ADAPT} SELECT CAST(sum(n) AS BIGINT) AS evaluations, round(sum(p * n), 6) AS expected_wins, CAST(sum(w) AS BIGINT) AS observed_wins, round(sum(abs(w / n - p) * n) / sum(n), 6) AS ece,
    round(max(abs(w / n - p)), 6) AS mce, round(sum((w / n - p) * n) / sum(n), 6) AS signed_bias FROM ad"""))
def calibration_summary(t):
    return rounded(M.calibration_summary(M.bin_record(M.adaptive_bins(L.team_calibration_frame(L.settled_rows(latest_frame(t)))))))


EDGE_SQL = """, he AS (SELECT best_bet = result AS won, CASE WHEN best_bet = 'team_a' THEN odds_a ELSE odds_b END AS odds, best_edge, (best_bet = 'team_a') = (model_prob_a >= 0.5) AS fav FROM settled WHERE best_edge >= 0)
, hp AS (SELECT *, CASE WHEN won THEN odds - 1 ELSE -1 END AS flat, CASE WHEN won THEN best_edge * (odds - 1) ELSE -best_edge END AS wp,
   CASE WHEN best_edge < 2 THEN '<2%' WHEN best_edge < 5 THEN '2-5%' WHEN best_edge < 10 THEN '5-10%' WHEN best_edge < 999 THEN '10%+' END AS bucket FROM he)
, sl AS (SELECT 'all' AS slice, * FROM hp UNION ALL SELECT bucket, * FROM hp UNION ALL SELECT CASE WHEN fav THEN 'Backing favourites' ELSE 'Backing underdogs' END, * FROM hp)
SELECT slice, count(*) AS bets, count(*) FILTER (won) AS wins, round(avg(CAST(won AS INT)), 6) AS win_rate, round(avg(best_edge) / 100, 6) AS avg_edge, round(avg(flat), 6) AS flat_roi,
  round(sum(wp) / nullif(sum(best_edge), 0), 6) AS confidence_roi, round(CASE WHEN count(*) > 1 THEN avg(flat) / (stddev_samp(flat) / sqrt(count(*))) END, 6) AS t FROM sl GROUP BY 1"""


@query("A15_edge_stats", latest_sql(EDGE_SQL))
def edge_stats(t):
    return rounded(L.edge_stats(L.settled_rows(latest_frame(t))).drop("p_value"))


@query("T2_biggest_upsets", latest_sql("""SELECT match_url, match_date, match_time, CASE WHEN model_prob_a >= 0.5 THEN team_a ELSE team_b END AS favourite, CASE WHEN model_prob_a >= 0.5 THEN team_b ELSE team_a END AS underdog,
    round(greatest(model_prob_a, 1 - model_prob_a), 6) AS favourite_prob FROM settled WHERE result <> CASE WHEN model_prob_a >= 0.5 THEN 'team_a' ELSE 'team_b' END
    ORDER BY greatest(model_prob_a, 1 - model_prob_a) DESC, match_date DESC, match_time DESC, match_url LIMIT 5"""))
def biggest_upsets(t):
    return rounded(L.biggest_upsets(L.settled_rows(latest_frame(t))))


@query("T4_predictions_by_edge", latest_sql("SELECT match_url, best_edge FROM latest ORDER BY best_edge DESC NULLS LAST, match_url LIMIT 50"))
def predictions_by_edge(t):
    return latest_frame(t).orderBy(F.desc_nulls_last("best_edge"), "match_url").limit(50).select("match_url", "best_edge")


@query("P19_ledger_browse_filter", latest_sql("SELECT match_url, match_date, best_edge FROM latest WHERE contains(lower(concat_ws(' ', team_a, team_b, version_id, match_url)), 'team 1') AND result IN ('team_a', 'team_b') AND valid_for_eval = 1 AND coalesce(best_edge, 0) >= 10"))
def browse(t):
    return L.browse(latest_frame(t), "team 1", "settled", valid=1, min_edge=10, sort="edge_desc").select("match_url", "match_date", "best_edge")


@query("L9_performance_report", latest_sql(f"""{_FIXED}, favb AS (SELECT CAST(50 + 5 * least(floor((assigned_prob - 0.5) * 20), 9) AS INT) AS lo, count(*) AS n FROM favf GROUP BY 1)
    SELECT 'calibration_bins' AS part, CAST(sum(n) AS BIGINT) AS rows FROM g UNION ALL SELECT 'favourite_bins', (SELECT count(*) FROM favf)
    UNION ALL SELECT 'reasons', (SELECT count(*) FROM latest WHERE valid_for_eval <> 1) + (SELECT count(*) FROM latest WHERE valid_for_eval = 1 AND result NOT IN ('team_a', 'team_b', 'Pending'))
    UNION ALL SELECT 'summary', (SELECT count(*) FROM latest) UNION ALL SELECT 'edge_stats', (SELECT count(*) FROM settled WHERE best_edge >= 0)"""))
def performance_report(t):
    from rivalry.session import persist_table

    r = L.performance_report(persist_table(latest_frame(t)))
    total = {"calibration_bins": F.sum("count"), "favourite_bins": F.sum("count"), "reasons": F.sum("count"), "summary": F.max("total_matches"),
             "edge_stats": F.max(F.when(F.col("slice") == "all", F.col("bets")))}
    parts = [r[k].agg(v.cast("long").alias("rows")).select(F.lit(k).alias("part"), "rows") for k, v in total.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- metrics --------------------------------------------------------------
_CLIP = "greatest(least(p, 1 - 1e-7), 1e-7)"
AUC_SQL = """(SELECT round(CAST(sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0 AS DOUBLE) / (sum(label) * (count(*) - sum(label))), 6)
   FROM (SELECT label, (rank() OVER (ORDER BY p) + (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1)) / 2.0 AS rk FROM {0}))"""
ECE_SQL = """(SELECT round(sum(c * abs(a - f)) / sum(c), 6) FROM (SELECT count(*) AS c, avg(label) AS a, avg(p) AS f FROM {0} GROUP BY least(floor(p * 10), 9)))"""


@query("A8_binary_metrics", over("scored", body=f""", c AS (SELECT {_CLIP} AS p, label FROM scored)
    SELECT count(*) AS n, round(avg(CAST(CAST(p >= 0.5 AS INT) = label AS INT)), 6) AS accuracy, round(-avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss,
      round(avg((p - label) ** 2), 6) AS brier_score, round(avg(p), 6) AS prediction_mean, round(avg(label), 6) AS label_mean, {AUC_SQL.format('c')} AS roc_auc, {ECE_SQL.format('c')} AS ece FROM c"""))
def binary_metrics(t):
    return rounded(M.binary_metrics(t.view("scored")))


@query("A9_ece", over("scored", body=f""", c AS (SELECT {_CLIP} AS p, label FROM scored) SELECT {ECE_SQL.format('c')} AS ece"""))
def ece(t):
    return rounded(M.expected_calibration_error(t.view("scored")))


@query("M11_roc_auc", over("scored", body=f""", c AS (SELECT {_CLIP} AS p, label FROM scored) SELECT {AUC_SQL.format('c')} AS roc_auc"""))
def roc_auc(t):
    return rounded(M.roc_auc(t.view("scored")))


@query("A10_calibration_buckets", over("scored", body=", e AS (SELECT i, [0.0E0, 0.025, 0.05, 0.075, 0.10, 0.15, 0.20, 0.30, 0.50, 1.0][i] AS lo, [0.0E0, 0.025, 0.05, 0.075, 0.10, 0.15, 0.20, 0.30, 0.50, 1.0][i + 1] AS hi FROM (SELECT unnest(range(1, 10)) AS i)) "
       "SELECT CAST(i AS INT) AS bucket_no, count(*) AS matches, round(avg(p), 6) AS avg_predicted, round(avg(label), 6) AS actual_rate, CAST(sum(label) AS BIGINT) AS forfeits FROM scored JOIN e ON p <= hi AND (p > lo OR (i = 1 AND p = 0)) GROUP BY 1"))
def calibration_buckets(t):
    return rounded(M.calibration_buckets(t.view("scored")))


@query("A18_rank_order_diagnostics", over("scored", body=""" SELECT round(avg(CAST(rank_diff > 0 AS INT)), 6) AS team_a_rank_favoured_rate,
    round(avg(CAST(CASE WHEN rank_diff > 0 THEN label = 1 ELSE label = 0 END AS INT)), 6) AS rank_favourite_win_rate FROM scored WHERE rank_diff <> 0"""))
def rank_order(t):
    return rounded(M.rank_order_diagnostics(t.view("scored")))


@query("A19_symmetry_error", over("scored", body=""" SELECT round(avg(e), 6) AS symmetry_error_mean, round(quantile_cont(e, 0.95), 6) AS symmetry_error_p95
    FROM (SELECT abs(p + CAST((match_id * 17) % 331 AS DOUBLE) / 331 - 1) AS e FROM scored)"""))
def symmetry(t):
    return rounded(M.symmetry_error(t.view("scored").withColumn("p_mirror", ((F.col("match_id") * 17) % 331).cast("double") / 331)))


@query("A34_evaluation_payload", over("scored", body=f""", c AS (SELECT match_id, date, rank_diff, {_CLIP} AS p, label FROM scored)
    SELECT count(*) AS rows, count(DISTINCT match_id) AS matches, min(date) AS start_date, max(date) AS end_date, round(avg((p - label) ** 2), 6) AS brier_score,
      round(-avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, {AUC_SQL.format('c')} AS roc_auc, {ECE_SQL.format('c')} AS ece, round(avg(label), 6) AS label_mean, round(avg(p), 6) AS prediction_mean,
      (SELECT round(avg(CAST(rank_diff > 0 AS INT)), 6) FROM c WHERE rank_diff <> 0) AS team_a_rank_favoured_rate FROM c"""))
def evaluation_payload(t):
    return rounded(M.evaluation_payload(t.view("scored"))).drop("accuracy", "rank_favourite_win_rate")


@query("A20_subgroup_metrics", over("forfeit_base", body=f""", s AS (SELECT *, greatest(team1_rank, team2_rank) AS max_rank, CAST((match_id * 37) % 997 AS DOUBLE) / 997 AS p0, forfeit_target AS label FROM forfeit_base)
    , tr AS (SELECT region FROM forfeit_base GROUP BY 1 HAVING count(*) >= 10 ORDER BY count(*) DESC, 1 LIMIT 8), tor AS (SELECT organizer FROM forfeit_base GROUP BY 1 HAVING count(*) >= 10 ORDER BY count(*) DESC, 1 LIMIT 10)
    , m AS (SELECT 'online' AS g, p0, label FROM s WHERE NOT is_lan UNION ALL SELECT 'LAN', p0, label FROM s WHERE is_lan UNION ALL SELECT 'low-ranked/unranked', p0, label FROM s WHERE max_rank > 100
      UNION ALL SELECT 'region: ' || region, p0, label FROM s JOIN tr USING (region) UNION ALL SELECT 'event family: ' || organizer, p0, label FROM s JOIN tor USING (organizer))
    , c AS (SELECT g, greatest(least(p0, 1 - 1e-7), 1e-7) AS p, label FROM m), rk AS (SELECT g, label, (rank() OVER (PARTITION BY g ORDER BY p) * 2 + count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS rk FROM c)
    SELECT c.g AS "group", count(*) AS n, round(-avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, round(avg((p - label) ** 2), 6) AS brier_score,
      any_value(a.auc) AS roc_auc FROM c JOIN (SELECT g, round((sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM rk GROUP BY 1) a USING (g) GROUP BY 1 HAVING count(*) >= 10"""))
def subgroup_metrics(t):
    d = t.view("forfeit_base").withColumns({"max_rank": F.greatest("team1_rank", "team2_rank"), "p": ((F.col("match_id") * 37) % 997).cast("double") / 997,
                                            "label": F.col("forfeit_target")})
    return rounded(M.subgroup_metrics(d).select("group", "n", "log_loss", "brier_score", "roc_auc"))


# ---- settlement -----------------------------------------------------------
_RESULT = f""", rec AS (SELECT c.*, lower(array_to_string(match_info, ' ')) AS info, {FORMAT.format('format')} AS f1, {FORMAT.format("array_to_string(match_info, ' ')")} AS f2,
    len(list_filter(hltv_maps, lambda m: coalesce(TRY_CAST(m.team1_score AS INT) > TRY_CAST(m.team2_score AS INT), false))) AS w1,
    len(list_filter(hltv_maps, lambda m: coalesce(TRY_CAST(m.team2_score AS INT) > TRY_CAST(m.team1_score AS INT), false))) AS w2,
    len(list_filter(hltv_maps, lambda m: lower(m.map_name) IN ('default', 'forfeit'))) > 0 AS dm FROM corpus c)
, res AS (SELECT *, CASE CASE WHEN f1 = 'unknown' AND len(match_info) > 0 THEN f2 ELSE f1 END WHEN 'bo1' THEN 1 WHEN 'bo3' THEN 2 WHEN 'bo5' THEN 3 END AS need FROM rec)
, result_ AS (SELECT url, match_key, team1, team2, CASE WHEN regexp_matches(info, 'forfeit|walkover|withdraw') OR contains(lower(format), 'def') OR dm THEN 'forfeit' WHEN contains(info, 'cancel') THEN 'cancelled'
    WHEN need IS NULL OR (w1 < need AND w2 < need) THEN NULL WHEN w1 > w2 THEN 'team_a' ELSE 'team_b' END AS result FROM res)"""


@query("A31_series_result", over("corpus", body=f"{_RESULT} SELECT match_key, result FROM result_"))
def series_result(t):
    c = corpus(t)
    return c.select("match_key", L.series_result(c, F.col("team1"), F.col("team2")).alias("result"))


@query("SRC6_index_by_url", over("corpus", body=" SELECT 'hltv:' || CAST(match_key // 2 AS VARCHAR) AS url_key, max(match_key) AS match_key FROM corpus GROUP BY 1"))
def index_by_url(t):
    c = corpus(t).withColumn("url", F.concat(F.lit("https://site.example/matches/"), F.floor(F.col("match_key") / 2).cast("string"), F.lit("/x/#top")))
    return L.index_by_url(c.select("match_key", "url"), "match_key").select("url_key", "match_key")


@query("J7_name_match", over("corpus", body=""", x AS (SELECT match_key, team1, team2, lower(mm.team1) AS c, mm.team1 AS candidate FROM (SELECT match_key, team1, team2, unnest(hltv_maps) AS mm FROM corpus))
    SELECT match_key, candidate, contains(c, lower(team1)) OR contains(lower(team1), c) AS a, contains(c, lower(team2)) OR contains(lower(team2), c) AS b FROM x"""))
def name_match(t):
    m = corpus(t).select("match_key", "team1", "team2", F.explode("hltv_maps.team1").alias("candidate"))
    return m.select("match_key", "candidate", L.name_match(F.col("candidate"), F.col("team1")).alias("a"), L.name_match(F.col("candidate"), F.col("team2")).alias("b"))


def ledger_for_corpus(t: Tables):
    """Ledger rows whose URL points into the corpus; some carry other participants."""
    m = t.view("ledger_matches")
    url = F.concat(F.lit("https://site.example/matches/"), F.col("match_url").cast("string"), F.lit("/x"))
    b = F.when(F.col("match_url") % 14 == 0, F.lit("Somebody Else")).otherwise(F.regexp_replace("team_b", "Team", "Squad"))
    return m.withColumns({"match_url": url, "team_b": b})


_LEDGER = """, lm AS (SELECT match_url AS k, 'https://site.example/matches/' || CAST(match_url AS VARCHAR) || '/x' AS match_url, team_a,
    CASE WHEN match_url % 14 = 0 THEN 'Somebody Else' ELSE replace(team_b, 'Team', 'Squad') END AS team_b, match_date, match_time, result AS old FROM ledger_matches)"""
_CHANGE = "CASE WHEN lower(lm.team_b) <> lower(r.team2) THEN 'participant changed: expected ' || lm.team_a || ' vs ' || lm.team_b || ', final ' || r.team1 || ' vs ' || r.team2 END"
_EVAL = "CASE WHEN f.roster_status <> 'standard' THEN 'roster anomaly: ' || f.roster_status WHEN s.reason IS NOT NULL THEN 'non-standard roster: ' || s.reason END"
_RES = """CASE WHEN r.result = 'team_b' AND NOT (contains(lower(r.team2), lower(lm.team_b)) OR contains(lower(lm.team_b), lower(r.team2))) THEN
    CASE WHEN contains(lower(r.team2), lower(lm.team_a)) OR contains(lower(lm.team_a), lower(r.team2)) THEN 'team_a' ELSE 'unknown:' || r.team2 END ELSE r.result END"""
SETTLED = f"""{EXCLUDED} {_RESULT} {_LEDGER}, sj AS (SELECT lm.*, {_RES} AS resolved, {_CHANGE} AS change_reason, {_EVAL} AS eval_reason
   FROM lm LEFT JOIN result_ r ON r.match_key = lm.k LEFT JOIN flags f ON f.match_key = lm.k LEFT JOIN sizes s ON s.match_key = lm.k)"""


def settled_sql(body: str) -> str:
    return over("corpus", "ledger_matches", "snapshots", body=SETTLED + " " + body)


@query("J6_settle_join", settled_sql("SELECT match_url, resolved, change_reason, eval_reason FROM sj"))
def settle_join(t):
    return L.settle_join(ledger_for_corpus(t).select("match_url", "team_a", "team_b"), corpus(t)).select("match_url", "resolved", "change_reason", "eval_reason")


@query("J19_participant_change", settled_sql("SELECT match_url, change_reason FROM sj WHERE change_reason IS NOT NULL"))
def participant_change(t):
    j = L.settle_join(ledger_for_corpus(t).select("match_url", "team_a", "team_b"), corpus(t))
    return j.where(F.col("change_reason").isNotNull()).select("match_url", "change_reason")


_AS_OF = "2000-01-01 12:00"


def _snaps(t: Tables):
    url = F.concat(F.lit("https://site.example/matches/"), F.col("match_url").cast("string"), F.lit("/x"))
    return t.view("snapshots").withColumn("match_url", url)


@query("L1_settle_pending", settled_sql(f"SELECT match_url, CASE WHEN old = 'Pending' AND match_date || ' ' || match_time <= '{_AS_OF}' AND resolved IS NOT NULL THEN resolved ELSE old END AS result FROM sj"))
def settle_pending(t):
    return L.settle_pending(ledger_for_corpus(t), _snaps(t), corpus(t), _AS_OF)[0].select("match_url", "result")


_NORM = "list_filter(list_transform(string_split(coalesce(s.eval_exclusion_reason, ''), ';'), lambda x: trim(x)), lambda x: x <> '')"


@query("L2_exclusion_reasons", settled_sql(f""", p AS (SELECT s.id, s.valid_for_eval, s.eval_exclusion_reason AS old_reason, j.change_reason, j.eval_reason, list_filter({_NORM}, lambda x, i: list_position({_NORM}, x) = i) AS parts
      FROM snapshots s LEFT JOIN sj j ON j.k = s.match_url)
    SELECT id, CASE WHEN coalesce(change_reason, eval_reason) IS NOT NULL THEN 0 ELSE valid_for_eval END AS valid_for_eval,
      CASE WHEN coalesce(change_reason, eval_reason) IS NOT NULL THEN array_to_string(list_concat(list_filter([eval_reason, change_reason], lambda x: x IS NOT NULL AND NOT list_contains(parts, x)), parts), '; ') ELSE old_reason END AS eval_exclusion_reason FROM p"""))
def exclusion_reasons(t):
    j = L.settle_join(ledger_for_corpus(t).select("match_url", "team_a", "team_b"), corpus(t, without=("hltv_vetoes",)))
    return L.mark_excluded(_snaps(t), j).select("id", "valid_for_eval", "eval_exclusion_reason")


@query("L3_audit_exclusions", settled_sql("SELECT match_url, team_a, team_b, old AS result, concat_ws('; ', change_reason, eval_reason) AS reason FROM sj WHERE old <> 'Pending' AND coalesce(change_reason, eval_reason) IS NOT NULL"))
def audit_exclusions(t):
    return L.audit_exclusions(ledger_for_corpus(t), corpus(t))


@query("L4_legacy_labels", over("snapshots", body=f""" , n AS (SELECT s.*, {_NORM} AS parts FROM snapshots s)
    SELECT id, CASE WHEN valid_for_eval = 0 AND trim(coalesce(eval_exclusion_reason, '')) = '' THEN 'low sample' WHEN len(parts) > 0 THEN array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), '; ') END AS eval_exclusion_reason FROM n"""))
def legacy_labels(t):
    return L.legacy_labels(t.view("snapshots")).select("id", "eval_exclusion_reason")
