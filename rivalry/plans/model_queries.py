"""Rates, splits, experiments, series paths, models, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.functions import series as B
from rivalry.functions import text as X
from rivalry.operators import clean as K
from rivalry.operators import corpus as Q
from rivalry.operators import features as P
from rivalry.operators import models as ML
from rivalry.operators import ordered as O
from rivalry.operators import paths as S
from rivalry.operators import rates as R
from rivalry.operators import splits as E
from rivalry.operators import veto as V
from rivalry.plans.feature_queries import FULL_FEATURES, SIDES, feature_maps, rounded
from rivalry.plans.registry import Tables, corpus, over, query
from rivalry.plans.veto_queries import AS_OF, HISTORY_SQL, NOT_VETO, STATS_SQL, _list, q
from rivalry.session import persist_table, shared_folder
from rivalry.sources import readers as RD
from rivalry.sources import sinks as SK
from rivalry.streaming import wrappers as ST

# ---- smoothed rates -------------------------------------------------------
_P, _W = C.FORFEIT_PRIOR, C.FORFEIT_PRIOR_WEIGHT


def _rate(s: str, n: str) -> str:
    return f"(coalesce({s}, 0) + {_P}E0 * {_W}) / ({n} + {_W})"


def rate_digits(df):
    """Rates with short denominators tie at few digits and logarithms differ in the last bit."""
    return df.select(*[F.round(c, 6 if "log" in c else 12).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("W11_running_rate", over("forfeit_base", body=f""", d AS (SELECT DISTINCT event, date FROM forfeit_base), n AS (SELECT d.event, d.date, count(h.match_id) AS n, sum(h.forfeit_target) AS s FROM d LEFT JOIN forfeit_base h ON h.event = d.event AND h.date < d.date GROUP BY 1, 2)
    SELECT event, date, round({_rate('s', 'n')}, 12) AS rate, round(ln(1.0E0 + n), 6) AS count_log FROM n"""))
def running_rate(t):
    rows = t.view("forfeit_base").select("event", "date", F.lit(1).alias("n"), F.col("forfeit_target").alias("s"))
    s = R.running_counts(rows, ["event"])
    return rate_digits(s.select("event", "date", R.smoothed(F.col("s"), F.col("n")).alias("rate"), F.log1p(F.col("n").cast("double")).alias("count_log")))


_SURFACE = f""", dl AS (SELECT DISTINCT b.date, l.is_lan FROM forfeit_base b CROSS JOIN (SELECT unnest([true, false]) AS is_lan) l)
, dd AS (SELECT date, is_lan, count(*) AS n, sum(forfeit_target) AS s FROM forfeit_base GROUP BY 1, 2)
, sd AS (SELECT d.date, d.is_lan, {_rate('sum(h.s)', 'coalesce(sum(h.n), 0)')} AS global_forfeit_rate, {_rate('sum(h.s) FILTER (h.is_lan = d.is_lan)', 'coalesce(sum(h.n) FILTER (h.is_lan = d.is_lan), 0)')} AS surface_forfeit_rate,
    """ + ", ".join(f"coalesce(sum(h.s) FILTER (h.date >= d.date - {k}) / sum(h.n) FILTER (h.date >= d.date - {k}), {_P}) AS recent_{k}d_forfeit_rate, coalesce(sum(h.s) FILTER (h.date >= d.date - {k} AND h.is_lan = d.is_lan) / sum(h.n) FILTER (h.date >= d.date - {k} AND h.is_lan = d.is_lan), {_P}) AS recent_surface_{k}d_forfeit_rate" for k in (30, 90)) + """
  FROM dl d LEFT JOIN dd h ON h.date < d.date GROUP BY 1, 2)"""
_SD = ["global_forfeit_rate", "surface_forfeit_rate", "recent_30d_forfeit_rate", "recent_90d_forfeit_rate", "recent_surface_30d_forfeit_rate", "recent_surface_90d_forfeit_rate"]


@query("W12_recent_rate", over("forfeit_base", body=_SURFACE + " SELECT date, is_lan, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SD) + " FROM sd"))
def recent_rate(t):
    rows = t.view("forfeit_base").select("date", "is_lan", F.lit(1).alias("n"), F.col("forfeit_target").alias("s"))
    return rounded(R.surface_days(rows))


_TEAMS_CTE = """, tr AS (SELECT date, team1_id AS team, forfeit_target AS s, CAST(forfeit_team = team1_id AS INT) AS own FROM forfeit_base UNION ALL SELECT date, team2_id, forfeit_target, CAST(forfeit_team = team2_id AS INT) FROM forfeit_base)
, td AS (SELECT DISTINCT team, date FROM tr), ts AS (SELECT d.team, d.date, count(h.s) AS n, coalesce(sum(h.s), 0) AS s, coalesce(sum(h.own), 0) AS own FROM td d LEFT JOIN tr h ON h.team = d.team AND h.date < d.date GROUP BY 1, 2)"""
_KEY_CTE = "".join(f", k_{k} AS (SELECT d.{k}, d.date, count(h.match_id) AS n, coalesce(sum(h.forfeit_target), 0) AS s FROM (SELECT DISTINCT {k}, date FROM forfeit_base) d LEFT JOIN forfeit_base h ON h.{k} = d.{k} AND h.date < d.date GROUP BY 1, 2)" for k in ("region", "organizer", "event"))


def _ff_sql(select: str) -> str:
    r = {k: _rate(f"x{k}.s", f"x{k}.n") for k in ("region", "organizer", "event")}
    t = {k: _rate(f"t{k}.s", f"t{k}.n") for k in (1, 2)}
    o = {k: _rate(f"t{k}.own", f"t{k}.n") for k in (1, 2)}
    bucket = lambda r: "CASE " + " ".join(f"WHEN {r} <= {top} THEN {q(label)}" for top, label in C.RANK_BUCKETS) + f" WHEN {r} < 750 THEN '201+' ELSE 'Unranked/unknown' END"
    f = {
        "is_lan": "CAST(b.is_lan AS INT)", "best_of": "CASE b.match_format WHEN 'bo5' THEN 5 WHEN 'bo3' THEN 3 WHEN 'bo1' THEN 1 ELSE 0 END", "days_since_start": "CAST(date_diff('day', (SELECT min(date) FROM forfeit_base), b.date) AS INT)",
        "team1_rank": "team1_rank", "team2_rank": "team2_rank", "min_rank": "least(team1_rank, team2_rank)", "max_rank": "greatest(team1_rank, team2_rank)",
        "avg_log_rank": "(ln(team1_rank) + ln(team2_rank)) / 2", "abs_log_rank_diff": "abs(ln(team1_rank) - ln(team2_rank))", "either_unranked": "CAST(team1_rank >= 750 OR team2_rank >= 750 AS INT)", "both_unranked": "CAST(team1_rank >= 750 AND team2_rank >= 750 AS INT)",
        **{f"{k}_forfeit_rate": v for k, v in r.items()}, "team1_match_forfeit_rate": t[1], "team2_match_forfeit_rate": t[2], "team_avg_match_forfeit_rate": f"({t[1]} + {t[2]}) / 2", "team_max_match_forfeit_rate": f"greatest({t[1]}, {t[2]})",
        "team1_own_forfeit_rate": o[1], "team2_own_forfeit_rate": o[2], "team_avg_own_forfeit_rate": f"({o[1]} + {o[2]}) / 2", "team_max_own_forfeit_rate": f"greatest({o[1]}, {o[2]})",
        "team1_match_count_log": "ln(1.0E0 + t1.n)", "team2_match_count_log": "ln(1.0E0 + t2.n)", "organizer_match_count_log": "ln(1.0E0 + xorganizer.n)", "event_match_count_log": "ln(1.0E0 + xevent.n)",
    }
    ints = {"is_lan", "best_of", "days_since_start", "team1_rank", "team2_rank", "min_rank", "max_rank", "either_unranked", "both_unranked"}
    cols = ", ".join(f"{f.get(c, 'sd.' + c)} AS {c}" if c in ints else f"round({f.get(c, 'sd.' + c)}, {6 if 'log' in c else 12}) AS {c}" for c in C.FORFEIT_NUMERIC)
    b1, b2 = bucket("team1_rank"), bucket("team2_rank")
    return over("forfeit_base", body=f"""{_SURFACE} {_TEAMS_CTE} {_KEY_CTE}, ff AS (SELECT b.match_id, b.date, b.team1_id, b.team2_id, b.event, b.organizer, {cols}, b.region, b.match_format AS format, {b1} AS team1_rank_bucket, {b2} AS team2_rank_bucket,
        least({b1}, {b2}) || ' / ' || greatest({b1}, {b2}) AS rank_pair_bucket, b.forfeit_target FROM forfeit_base b JOIN sd ON sd.date = b.date AND sd.is_lan = b.is_lan
      JOIN ts t1 ON t1.team = b.team1_id AND t1.date = b.date JOIN ts t2 ON t2.team = b.team2_id AND t2.date = b.date JOIN k_region xregion ON xregion.region = b.region AND xregion.date = b.date
      JOIN k_organizer xorganizer ON xorganizer.organizer = b.organizer AND xorganizer.date = b.date JOIN k_event xevent ON xevent.event = b.event AND xevent.date = b.date) {select}""")


@query("W13_forfeit_features", _ff_sql("SELECT * FROM ff"))
def forfeit_features(t):
    return rate_digits(R.forfeit_features(t.view("forfeit_base")))


@query("W14_history_as_of", _ff_sql("SELECT match_id, " + ", ".join(c for c in C.FORFEIT_NUMERIC if c not in ("days_since_start",)) + " FROM ff"))
def history_as_of(t):
    """Every contest scored as an unseen row: its own outcome is withheld and must not matter."""
    base = t.view("forfeit_base")
    probes = base.drop("forfeit_target", "forfeit_team")
    f = R.forfeit_features(base, probes)
    return rate_digits(f.select("match_id", *[c for c in C.FORFEIT_NUMERIC if c != "days_since_start"]))


@query("J14_hierarchical_rate_lookup", over("forfeit_base", body=""", tr AS (SELECT * FROM forfeit_base WHERE date < DATE '1999-01-01'), ev AS (SELECT * FROM forfeit_base WHERE date >= DATE '1999-01-01'), g AS (SELECT avg(forfeit_target) AS r FROM tr)
    , a AS (SELECT is_lan, region, organizer, sum(forfeit_target) AS s, count(*) AS n FROM tr GROUP BY 1, 2, 3), b AS (SELECT is_lan, region, sum(forfeit_target) AS s, count(*) AS n FROM tr GROUP BY 1, 2), c AS (SELECT is_lan, sum(forfeit_target) AS s, count(*) AS n FROM tr GROUP BY 1)
    SELECT ev.match_id, round((coalesce(a.s, b.s, c.s, 0) + g.r * 20) / (coalesce(a.n, b.n, c.n, 0) + 20), 6) AS baseline_rate FROM ev CROSS JOIN g LEFT JOIN a USING (is_lan, region, organizer) LEFT JOIN b USING (is_lan, region) LEFT JOIN c USING (is_lan)"""))
def hierarchical(t):
    b = t.view("forfeit_base")
    cut = F.lit("1999-01-01").cast("date")
    return rounded(R.hierarchical_rates(b.where(F.col("date") < cut), b.where(F.col("date") >= cut)).select("match_id", "baseline_rate"))


# ---- splits and experiments -----------------------------------------------
_SPLIT = ", o AS (SELECT *, row_number() OVER (ORDER BY date, match_id) - 1 AS r, count(*) OVER () AS n FROM scored), sp AS (SELECT *, CASE WHEN r < floor(n * 0.7E0) THEN 'train' WHEN r < floor(n * 0.85E0) THEN 'validation' ELSE 'test' END AS split FROM o)"


def split_scored(t: Tables):
    return E.temporal_split(t.view("scored"), ["date", "match_id"])


@query("E1_temporal_split", over("scored", body=_SPLIT + " SELECT match_id, split FROM sp"))
def temporal_split(t):
    return split_scored(t).select("match_id", "split")


@query("A33_split_summary", over("scored", body=_SPLIT + ' SELECT split, count(*) AS matches, CAST(sum(label) AS BIGINT) AS forfeit_matches, round(avg(label), 6) AS forfeit_rate, min(date) AS "start", max(date) AS "end" FROM sp GROUP BY 1'))
def split_summary(t):
    return rounded(E.split_summary(split_scored(t), "label"))


_FOLDS = """, b AS (SELECT min(date) AS f, max(date) + 1 AS e FROM scored), fs0 AS (SELECT i, f, CAST(e - 120 * (3 - i) AS DATE) AS ee, CAST(e - 120 * (4 - i) AS DATE) AS es FROM b, (SELECT CAST(unnest(range(0, 4)) AS INT) AS i))
, fs1 AS (SELECT i, f, es, ee, (SELECT count(*) FROM scored WHERE date < es) AS tr, (SELECT count(*) FROM scored WHERE date >= es AND date < ee) AS er FROM fs0 WHERE date_diff('day', f, es) >= 60)
, fs AS (SELECT 'fold_' || CAST(row_number() OVER (ORDER BY i) AS VARCHAR) AS fold, f, es, ee, tr, er FROM fs1 WHERE tr > 0 AND er > 0)"""


@query("E2_walk_forward_folds", over("scored", body=_FOLDS + " SELECT fold, f AS train_start, es AS train_end, es AS eval_start, ee AS eval_end, tr AS train_rows, er AS eval_rows FROM fs"))
def folds(t):
    return E.fold_specs(t.view("scored"), 4, 120)


@query("E3_inner_split", over("scored", body=_FOLDS + ", m AS (SELECT fs.fold, s.match_id, row_number() OVER (PARTITION BY fs.fold ORDER BY s.date, s.match_id) - 1 AS r, count(*) OVER (PARTITION BY fs.fold) AS n FROM scored s JOIN fs ON s.date < fs.es) SELECT fold, match_id, CASE WHEN r < floor(n * (1 - 0.15E0)) THEN 'inner_train' ELSE 'inner_validation' END AS split FROM m"))
def inner_split(t):
    s = t.view("scored")
    d = E.with_folds(s, E.fold_specs(s, 4, 120)).where(F.col("role") == "train")
    return E.inner_split(d, ["date", "match_id"], by=["fold"]).select("fold", "match_id", "split")




@query("E4_feature_variants", over("maps", body=f"{FULL_FEATURES} SELECT match_id, map_pos, " + ", ".join(f"round({f}, 6) AS {f}" if f not in ("picker_diff",) else f for f in E.feature_variants()["no_lan_dom_resilience"] if not f.startswith("h2h_")) + ", h2h_a_wins_30d, h2h_b_wins_30d FROM feats"))
def variants(t):
    cols = E.feature_variants()["no_lan_dom_resilience"]
    return rounded(P.compute_features(feature_maps(t)).select("match_id", "map_pos", *cols))


SHRINKS = [0.5, 0.7, 0.85, 1.0, 1.1]
_SHR = f", sh AS (SELECT s, -avg(CASE WHEN label = 1 THEN ln(q) ELSE ln(1 - q) END) AS ll, avg((q - label) ** 2) AS br FROM (SELECT label, s, greatest(least(0.5 + s * (p - 0.5), 1 - 1e-7), 1e-7) AS q FROM scored, (SELECT CAST(unnest({SHRINKS}) AS DOUBLE) AS s)) GROUP BY 1)"


@query("E5_shrink_calibration", over("scored", body=_SHR + " SELECT s AS shrink, round(ll, 6) AS log_loss, round(br, 6) AS brier_score FROM sh"))
def shrink_calibration(t):
    return rounded(E.shrink_scores(t.view("scored"), SHRINKS))


@query("T9_best_shrink", over("scored", body=_SHR + " SELECT s AS shrink, round(ll, 6) AS log_loss, round(br, 6) AS brier_score FROM sh ORDER BY ll, br, abs(s - 1) LIMIT 1"))
def best_shrink(t):
    return rounded(E.best_shrink(E.shrink_scores(t.view("scored"), SHRINKS)))


@query("X26_shrink_clip", over("scored", body=" SELECT match_id, round(greatest(least(0.5 + 0.85E0 * (p - 0.5), 1 - 1e-7), 1e-7), 6) AS shrunk, round(ln(1 + p), 6) AS log1p FROM scored"))
def shrink_clip(t):
    return rounded(t.view("scored").select("match_id", E.shrink(F.col("p"), 0.85).alias("shrunk"), F.log1p("p").alias("log1p")))


_RES = ", rs AS (SELECT CASE match_id % 5 WHEN 0 THEN 'baseline_all' ELSE 'v' || CAST(match_id % 5 AS VARCHAR) END AS variant, 'fold_' || CAST(extract(YEAR FROM date) % 4 AS VARCHAR) AS fold, match_id % 3 AS seed, avg((p - label) ** 2) AS brier_score, avg(abs(p - label)) AS log_loss, max(p) AS calibration_shrink FROM scored GROUP BY 1, 2, 3)"


def results(t: Tables):
    k = F.col("match_id")
    s = t.view("scored").select(F.when(k % 5 == 0, "baseline_all").otherwise(F.concat(F.lit("v"), (k % 5).cast("string"))).alias("variant"), F.concat(F.lit("fold_"), (F.year("date") % 4).cast("string")).alias("fold"), (k % 3).alias("seed"), "p", "label")
    e = F.col("p") - F.col("label")
    return s.groupBy("variant", "fold", "seed").agg(F.avg(e * e).alias("brier_score"), F.avg(F.abs(e)).alias("log_loss"), F.max("p").alias("calibration_shrink"))


@query("J2_baseline_compare", over("scored", body=_RES + " SELECT r.variant, r.fold, r.seed, round(r.brier_score - b.brier_score, 6) AS delta_brier_vs_baseline, round(r.log_loss - b.log_loss, 6) AS delta_log_loss_vs_baseline, r.brier_score - b.brier_score < 0 AS brier_win_vs_baseline FROM rs r LEFT JOIN rs b ON b.variant = 'baseline_all' AND b.fold = r.fold AND b.seed = r.seed"))
def baseline_compare(t):
    return rounded(E.baseline_compare(results(t)).select("variant", "fold", "seed", "delta_brier_vs_baseline", "delta_log_loss_vs_baseline", "brier_win_vs_baseline"))


@query("A22_variant_summary", over("scored", body=_RES + ", d AS (SELECT r.*, r.brier_score - b.brier_score AS db FROM rs r LEFT JOIN rs b ON b.variant = 'baseline_all' AND b.fold = r.fold AND b.seed = r.seed) SELECT variant, count(*) AS runs, round(avg(brier_score), 6) AS mean_brier, round(stddev_samp(brier_score), 6) AS std_brier, round(median(calibration_shrink), 6) AS median_calibration_shrink, round(avg(db), 6) AS mean_delta_brier_vs_baseline, count(*) FILTER (db < 0) AS brier_wins_vs_baseline FROM d GROUP BY 1"))
def variant_summary(t):
    return rounded(E.variant_summary(results(t)).select("variant", "runs", "mean_brier", "std_brier", "median_calibration_shrink", "mean_delta_brier_vs_baseline", "brier_wins_vs_baseline"))


# ---- series probabilities -------------------------------------------------
_PR = "[CAST((match_id * 37) % 97 + 1 AS DOUBLE) / 99, CAST((match_id * 41) % 97 + 1 AS DOUBLE) / 99, CAST((match_id * 43) % 97 + 1 AS DOUBLE) / 99, CAST((match_id * 47) % 97 + 1 AS DOUBLE) / 99, CAST((match_id * 53) % 97 + 1 AS DOUBLE) / 99]"


def _probs():
    return F.array(*[(((F.col("match_id") * m) % 97 + 1).cast("double") / 99) for m in (37, 41, 43, 47, 53)])


# all 2^n outcomes of a best-of-n, enumerated
_OUT = f""", pr AS (SELECT match_id, CASE match_format WHEN 'bo1' THEN 1 WHEN 'bo3' THEN 3 ELSE 5 END AS n, {_PR} AS ps FROM series)
, oc AS (SELECT match_id, n, ps, unnest(range(0, CAST(2 ** n AS INT))) AS o FROM pr)
, ow AS (SELECT match_id, n, o, list_transform(range(0, n), lambda i: (o // CAST(2 ** i AS INT)) % 2) AS bits, list_product(list_transform(range(0, n), lambda i: CASE WHEN (o // CAST(2 ** i AS INT)) % 2 = 1 THEN ps[i + 1] ELSE 1 - ps[i + 1] END)) AS pp FROM oc)
, oz AS (SELECT *, n // 2 + 1 AS need, list_filter(range(1, n + 1), lambda k: list_sum(bits[1:k]) = n // 2 + 1 OR k - list_sum(bits[1:k]) = n // 2 + 1)[1] AS stop FROM ow)"""


@query("X14_combine_probs", over("series", body=_OUT + " SELECT match_id, round(sum(pp) FILTER (list_sum(bits) >= need), 6) AS p FROM oz GROUP BY 1"))
def combine_probs(t):
    p = _probs()
    f = F.col("match_format")
    win = F.when(f == "bo1", B.combine_probs(p, 1)).when(f == "bo3", B.combine_probs(F.slice(p, 1, 3), 3)).otherwise(B.combine_probs(p, 5))
    return rounded(t.view("series").select("match_id", win.alias("p")))


@query("X15_scoreline_probabilities", over("series", body=_OUT + " SELECT match_id, CAST(CAST(list_sum(bits[1:stop]) AS INT) AS VARCHAR) || '-' || CAST(CAST(stop - list_sum(bits[1:stop]) AS INT) AS VARCHAR) AS score, round(sum(pp), 6) AS p FROM oz GROUP BY 1, 2"))
def scorelines(t):
    p, f = _probs(), F.col("match_format")
    lines = F.when(f == "bo1", B.scoreline_probabilities(p, 1)).when(f == "bo3", B.scoreline_probabilities(F.slice(p, 1, 3), 3)).otherwise(B.scoreline_probabilities(p, 5))
    return rounded(t.view("series").select("match_id", F.inline(lines)))


@query("X22_map_picker", over("maps", body=""" SELECT match_id, map_pos, CASE WHEN n = 1 OR map_pos > CASE WHEN n = 5 THEN 4 ELSE 2 END THEN 'neutral' WHEN (map_pos % 2 = 1) = (match_id % 2 = 0) THEN 'a' ELSE 'b' END AS picker
    FROM (SELECT match_id, map_pos, CASE match_format WHEN 'bo1' THEN 1 WHEN 'bo3' THEN 3 ELSE 5 END AS n FROM maps)"""))
def picker(t):
    n = F.when(F.col("match_format") == "bo1", 1).when(F.col("match_format") == "bo3", 3).otherwise(5)
    return t.view("maps").select("match_id", "map_pos", B.map_picker(F.col("map_pos") - 1, n, F.when(F.col("match_id") % 2 == 0, "a").otherwise("b")).alias("picker"))


def matchups(t: Tables):
    """Nations of one region meet: team ids by nation key, format by the key sum."""
    n = t.read("nation")
    a = n.select(F.col("n_nationkey").alias("ka"), F.col("n_regionkey").alias("r"))
    b = n.select(F.col("n_nationkey").alias("kb"), F.col("n_regionkey").alias("r"))
    m = a.join(b, "r").where(F.col("ka") < F.col("kb"))
    return m.select(F.concat(F.lit("TEAM "), "ka").alias("team_a"), F.concat(F.lit("SQUAD "), "kb").alias("team_b"),
                    F.element_at(F.array(F.lit("bo1"), F.lit("bo3"), F.lit("bo5")), (F.col("ka") + F.col("kb")) % 3 + 1).alias("match_format"))


def named_stats(t: Tables):
    """Map statistics under the names the records use (A sides are teams, B sides squads)."""
    s = V.team_map_stats(t.view("maps"), AS_OF)
    names = F.explode(F.array(F.concat(F.lit("TEAM "), "team"), F.concat(F.lit("SQUAD "), "team")))
    return s.withColumn("team", names)


def paths(t: Tables, stats=None):
    return S.veto_paths(matchups(t), S.team_weights(V.ban_history(corpus(t, NOT_VETO)), named_stats(t) if stats is None else stats))


def _steps_sql() -> str:
    """Six joins over the pool, one per move, with the weights spelled out per step."""
    out = f"""{HISTORY_SQL} {STATS_SQL}
, pl AS (SELECT i - 1 AS ix, {_list(C.ACTIVE_POOL)}[i] AS m FROM (SELECT unnest(range(1, 8)) AS i))
, bp AS (SELECT * FROM bh WHERE list_contains({_list(C.ACTIVE_POOL)}, map_name))
, mu AS (SELECT 'TEAM ' || a.n_nationkey AS team_a, 'SQUAD ' || b.n_nationkey AS team_b, ['bo1', 'bo3', 'bo5'][(a.n_nationkey + b.n_nationkey) % 3 + 1] AS fmt FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)
, ms AS (SELECT *, s AS starter, CASE WHEN s = 'a' THEN team_a ELSE team_b END AS f_team, CASE WHEN s = 'a' THEN team_b ELSE team_a END AS s_team FROM mu, (SELECT unnest(['a', 'b']) AS s))
, who AS (SELECT DISTINCT team, fmt FROM (SELECT f_team AS team, fmt FROM ms UNION ALL SELECT s_team, fmt FROM ms))
, bw AS (SELECT w.team, w.fmt, k.slot, pl.m, coalesce((SELECT sum(n) FROM bp WHERE team = w.team AND kind = 'slot' AND match_format = w.fmt AND bp.slot = k.slot AND map_name = pl.m), 0) AS c1, coalesce((SELECT sum(n) FROM bp WHERE team = w.team AND kind = 'slot' AND match_format = w.fmt AND bp.slot = k.slot), 0) AS t1,
    coalesce((SELECT sum(n) FROM bp WHERE team = w.team AND kind = 'eventual' AND match_format = w.fmt AND map_name = pl.m), 0) AS c2, coalesce((SELECT sum(n) FROM bp WHERE team = w.team AND kind = 'eventual' AND match_format = w.fmt), 0) AS t2,
    coalesce((SELECT sum(n) FROM bp WHERE team = w.team AND kind = 'team' AND map_name = pl.m), 0) AS c3, coalesce((SELECT sum(n) FROM bp WHERE team = w.team AND kind = 'team'), 0) AS t3 FROM who w, (SELECT unnest([1, 2, 3]) AS slot) k, pl)
, pw AS (SELECT w.team, pl.m, greatest(coalesce((SELECT max(st.win_rate * st.pick_rate) FROM st WHERE CAST(st.team AS VARCHAR) = regexp_extract(w.team, '\\d+')  AND st.map_name = pl.m), 0.5E0 / 7), 1e-6) AS w FROM (SELECT DISTINCT team FROM who) w, pl)
, lk AS (SELECT x.team, x.fmt, y.team AS opp, min(x.m) AS locked FROM bw x JOIN who y ON y.fmt = x.fmt LEFT JOIN bw z ON z.team = y.team AND z.fmt = x.fmt AND z.slot = 1 AND z.m = x.m
    WHERE x.slot = 1 AND x.t1 >= 10 AND x.c1 / x.t1 >= 0.75 AND NOT (z.t1 >= 10 AND z.c1 / nullif(z.t1, 0) >= 0.75) GROUP BY 1, 2, 3)
, stp AS (SELECT * FROM (VALUES """ + ", ".join(f"('{f}', {i}, {s[0]}, '{s[1]}', {s[2]})" for f, ss in S.STEPS.items() for i, s in enumerate(ss)) + f""") v(fmt, i, is_pick, side, slot))
, r0 AS (SELECT team_a, team_b, fmt, starter, f_team, s_team, {_list(C.ACTIVE_POOL)} AS lft, CAST([] AS VARCHAR[]) AS played, 1.0E0 AS p FROM ms)"""
    for i in range(6):
        out += f"""
, e{i} AS (SELECT r.*, sp.is_pick, sp.slot, CASE WHEN sp.side = 'f' THEN f_team ELSE s_team END AS me, CASE WHEN sp.side = 'f' THEN s_team ELSE f_team END AS op, unnest(lft) AS m, row_number() OVER () AS id0 FROM r{i} r JOIN stp sp ON sp.fmt = r.fmt AND sp.i = {i})
, w{i} AS (SELECT e.*, lk.locked, CASE WHEN is_pick = 1 THEN pw.w ELSE greatest(0.6 * (bw.c1 + 4.0E0 / len(lft)) / (bw.t1 + 4) + 0.25 * (bw.c2 + 4.0E0 / len(lft)) / (bw.t2 + 4) + 0.15 * (bw.c3 + 7.0E0 / len(lft)) / (bw.t3 + 7), 1e-6) END AS w
    FROM e{i} e LEFT JOIN pw ON pw.team = e.me AND pw.m = e.m LEFT JOIN bw ON bw.team = e.me AND bw.fmt = e.fmt AND bw.slot = e.slot AND bw.m = e.m LEFT JOIN lk ON lk.team = e.me AND lk.fmt = e.fmt AND lk.opp = e.op AND e.slot = 1 AND e.is_pick = 0)
, q{i} AS (SELECT *, CASE WHEN locked IS NOT NULL AND list_contains(lft, locked) THEN CASE WHEN m = locked THEN 0.9 ELSE 0.1 * w / sum(CASE WHEN m <> locked THEN w END) OVER pa END ELSE w / sum(w) OVER pa END AS qq FROM w{i} WINDOW pa AS (PARTITION BY team_a, team_b, fmt, starter, lft, played))
, r{i + 1} AS (SELECT team_a, team_b, fmt, starter, f_team, s_team, list_filter(lft, lambda x: x <> m) AS lft, CASE WHEN is_pick = 1 THEN list_append(played, m) ELSE played END AS played, sum(p * qq) AS p FROM q{i} GROUP BY ALL)"""
    return out + ", ps AS (SELECT team_a, team_b, fmt AS match_format, starter, array_to_string(list_concat(played, lft), ',') AS sequence, sum(p) AS p FROM r6 GROUP BY ALL)"


_PATHS = _steps_sql()


def paths_sql(body: str) -> str:
    return over("corpus", "maps", body=_PATHS + " " + body)


@query("M8_veto_path_distribution", paths_sql("SELECT team_a, team_b, match_format, starter, sequence, round(p, 6) AS p FROM ps"))
def veto_paths(t):
    return rounded(paths(t))


_BOTH = ", bs AS (SELECT team_a, team_b, match_format, sequence, sum(p) / 2 AS p FROM ps GROUP BY ALL)"


@query("M12_map_appearance", paths_sql(_BOTH + ", u AS (SELECT team_a, team_b, match_format, p, unnest(string_split(sequence, ',')) AS map_name FROM bs) SELECT team_a, team_b, match_format, map_name, round(sum(p), 6) AS p FROM u GROUP BY ALL"))
def map_appearance(t):
    return rounded(S.map_appearance(S.both_starters(paths(t)), ["team_a", "team_b", "match_format"]))


@query("T3_top_sequences", paths_sql(_BOTH + ", r AS (SELECT *, row_number() OVER (PARTITION BY team_a, team_b, match_format ORDER BY p DESC, sequence) AS k FROM bs) SELECT team_a, team_b, match_format, CAST(k AS INT) AS rank, round(p, 6) AS p FROM r WHERE k <= 5"))
def top_sequences(t):
    return rounded(S.top_sequences(S.both_starters(paths(t)), ["team_a", "team_b", "match_format"], 5).drop("sequence"))


@query("W22_path_cutoff", paths_sql(", o AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY team_a, team_b, match_format, starter ORDER BY p DESC, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM ps) SELECT team_a, team_b, match_format, starter, round(max(p) / sum(p), 6) AS top_share, count(*) AS paths FROM o WHERE bf < 0.9 GROUP BY 1, 2, 3, 4"))
def path_cutoff(t):
    keys = ["team_a", "team_b", "match_format", "starter"]
    return rounded(S.path_cutoff(paths(t), keys).groupBy(*keys).agg(F.max("p").alias("top_share"), F.count("*").alias("paths")))


def map_probs(t: Tables, stats=None):
    """A's win probability per map and picker, from the two sides' map records."""
    s = (named_stats(t) if stats is None else stats).select("team", "map_name", "win_rate")
    m = matchups(t).select("team_a", "team_b").distinct().withColumn("map_name", F.explode(F.array(*[F.lit(x) for x in C.ACTIVE_POOL])))
    m = m.join(s.select(F.col("team").alias("team_a"), "map_name", F.col("win_rate").alias("wa")), ["team_a", "map_name"], "left")
    m = m.join(s.select(F.col("team").alias("team_b"), "map_name", F.col("win_rate").alias("wb")), ["team_b", "map_name"], "left")
    base = 0.5 + (F.coalesce("wa", F.lit(0.5)) - F.coalesce("wb", F.lit(0.5))) / 4
    m = m.select("team_a", "team_b", "map_name", F.inline(F.array(*[F.struct(F.lit(k).alias("by"), (base + d).alias("p")) for k, d in (("a", 0.03), ("b", -0.03), ("neutral", 0.0))])))
    return m.groupBy("team_a", "team_b").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "map_name", "by"), "p"))).alias("probs"))  # 7 maps x 3 pickers


@query("M7_series_over_paths", paths_sql(""", o AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY team_a, team_b, match_format, starter ORDER BY p DESC, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM ps)
    , k AS (SELECT team_a, team_b, match_format, starter, string_split(sequence, ',') AS mp, p / sum(p) OVER (PARTITION BY team_a, team_b, match_format, starter) AS p FROM o WHERE bf < 0.9)
    , sw AS (SELECT CAST(team AS VARCHAR) AS tk, map_name, win_rate FROM st)
    , x AS (SELECT k.*, row_number() OVER () AS id FROM k), xi AS (SELECT x.id, x.team_a, x.team_b, x.match_format, x.p, len(mp) AS n, unnest(range(0, len(mp))) AS i, starter, mp FROM x)
    , xp AS (SELECT xi.*, 0.5 + (coalesce(a.win_rate, 0.5) - coalesce(b.win_rate, 0.5)) / 4 + CASE WHEN n = 1 OR i >= CASE WHEN n = 5 THEN 4 ELSE 2 END THEN 0 WHEN (i % 2 = 0) = (starter = 'a') THEN 0.03 ELSE -0.03 END AS w
       FROM xi LEFT JOIN sw a ON a.tk = regexp_extract(team_a, '\\d+') AND a.map_name = mp[i + 1] LEFT JOIN sw b ON b.tk = regexp_extract(team_b, '\\d+') AND b.map_name = mp[i + 1])
    , xa AS (SELECT id, any_value(team_a) AS team_a, any_value(team_b) AS team_b, any_value(match_format) AS match_format, any_value(p) AS p, any_value(n) AS n, list(w ORDER BY i) AS ws FROM xp GROUP BY 1)
    , z AS (SELECT *, unnest(range(0, CAST(2 ** n AS INT))) AS o FROM xa), zz AS (SELECT *, list_sum(list_transform(range(0, n), lambda i: (o // CAST(2 ** i AS INT)) % 2)) AS won, list_product(list_transform(range(0, n), lambda i: CASE WHEN (o // CAST(2 ** i AS INT)) % 2 = 1 THEN ws[i + 1] ELSE 1 - ws[i + 1] END)) AS pp FROM z)
    SELECT team_a, team_b, match_format, round(sum(p * pp) FILTER (won >= n // 2 + 1) / 2, 6) AS win FROM zz GROUP BY 1, 2, 3"""))
def series_over_paths(t):
    stats = persist_table(named_stats(t))  # read by the weights of paths and by both sides of a pair
    r = S.series_probability(paths(t, stats), map_probs(t, stats)).where(F.col("outcome") == "win")
    return rounded(r.select("team_a", "team_b", "match_format", F.col("probability").alias("win")))


@query("J17_bracket_step", "SELECT r.n_regionkey AS bracket, x.team, round(sum(x.p), 6) AS p FROM (SELECT DISTINCT n_regionkey FROM nation) r JOIN (SELECT a.n_regionkey, a.n_name AS team, 0.25E0 * (CAST(a.n_nationkey + 1 AS DOUBLE) / (a.n_nationkey + b.n_nationkey + 2)) AS p, a.n_nationkey AS k, b.n_nationkey AS o FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation) a JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation) b ON a.n_regionkey = b.n_regionkey AND ((a.s IN (1, 2) AND b.s IN (3, 4)) OR (a.s IN (3, 4) AND b.s IN (1, 2)))) x ON x.n_regionkey = r.n_regionkey GROUP BY 1, 2")
def bracket_step(t):
    from pyspark.sql import Window

    n = t.read("nation").withColumn("s", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    pick = lambda a, b: n.where(F.col("s").isin(a, b)).select(F.col("n_regionkey").alias("bracket"), F.col("n_name").alias("team"), F.lit(0.5).alias("p"))
    return rounded(S.bracket_step(pick(1, 2), pick(3, 4), pair_probs(t)))


def pair_probs(t: Tables):
    n = t.read("nation").select("n_name", "n_nationkey", "n_regionkey")
    b = n.select(F.col("n_name").alias("team_b"), F.col("n_nationkey").alias("kb"), "n_regionkey")
    j = n.select(F.col("n_name").alias("team_a"), F.col("n_nationkey").alias("ka"), "n_regionkey").join(b, "n_regionkey")
    return j.select("team_a", "team_b", ((F.col("ka") + 1).cast("double") / (F.col("ka") + F.col("kb") + 2)).alias("win_a"))


_W = "CAST({0}.k + 1 AS DOUBLE) / ({0}.k + {1}.k + 2)"


@query("M10_bracket_propagation", f"""WITH sd AS (SELECT n_regionkey AS b, n_name AS team, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS s FROM nation),
    s1 AS (SELECT x.b, x.team, x.k, {_W.format('x', 'y')} AS p FROM sd x JOIN sd y ON y.b = x.b AND ((x.s = 0 AND y.s = 1) OR (x.s = 1 AND y.s = 0))), s2 AS (SELECT x.b, x.team, x.k, {_W.format('x', 'y')} AS p FROM sd x JOIN sd y ON y.b = x.b AND ((x.s = 2 AND y.s = 3) OR (x.s = 3 AND y.s = 2))),
    f AS (SELECT x.b, x.team, sum(x.p * y.p * {_W.format('x', 'y')}) AS p FROM s1 x JOIN s2 y USING (b) GROUP BY 1, 2 UNION ALL SELECT x.b, x.team, sum(x.p * y.p * {_W.format('x', 'y')}) FROM s2 x JOIN s1 y USING (b) GROUP BY 1, 2)
    SELECT b AS bracket, 'semi_1' AS slot, team, round(p, 6) AS p FROM s1 UNION ALL SELECT b, 'semi_2', team, round(p, 6) FROM s2 UNION ALL SELECT b, 'final', team, round(p, 6) FROM f""")
def bracket(t):
    from pyspark.sql import Window

    n = t.read("nation")
    seeds = n.select(F.col("n_regionkey").alias("bracket"), (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("seed"), F.col("n_name").alias("team"))
    return rounded(S.bracket_probabilities(seeds, pair_probs(t), 4))


# ---- corpus, directory, listing -------------------------------------------
@query("A1_corpus_stats", over("maps", body=f""", s AS (SELECT DISTINCT match_id, match_format FROM maps) SELECT 'format' AS kind, match_format AS key, CAST(count(*) AS DOUBLE) AS value FROM s GROUP BY 2
    UNION ALL SELECT 'teams', 'all', CAST(count(DISTINCT t) AS DOUBLE) FROM (SELECT team_a_id AS t FROM maps UNION ALL SELECT team_b_id FROM maps)
    UNION ALL SELECT 'total', 'maps', CAST(count(*) AS DOUBLE) FROM maps UNION ALL SELECT 'total', 'rounds', CAST(sum(score_a + score_b) AS DOUBLE) FROM maps UNION ALL SELECT 'total', 'rounds_per_map', round(avg(score_a + score_b), 6) FROM maps
    UNION ALL SELECT 'total', 'map:' || p.m, CAST(count(maps.match_id) AS DOUBLE) FROM (SELECT unnest({_list(C.ACTIVE_POOL)}) AS m) p LEFT JOIN maps ON map_name = p.m GROUP BY 2
    UNION ALL SELECT 'total', 'first_day', CAST(date_diff('day', DATE '1970-01-01', min(date)) AS DOUBLE) FROM maps UNION ALL SELECT 'total', 'last_day', CAST(date_diff('day', DATE '1970-01-01', max(date)) AS DOUBLE) FROM maps"""))
def corpus_stats(t):
    return rounded(Q.corpus_stats(t.view("maps")))


@query("S2_distinct_teams", over("maps", body=" SELECT team_a_id AS team FROM maps UNION SELECT team_b_id FROM maps"))
def distinct_teams(t):
    return t.view("maps").select(F.explode(F.array("team_a_id", "team_b_id")).alias("team")).distinct()


@query("A28_latest_team_directory", over("maps", body=f"{SIDES}, o AS (SELECT team_a_id AS team, date, match_id, map_pos, 'a' AS side, team_a_world_rank AS r FROM maps UNION ALL SELECT team_b_id, date, match_id, map_pos, 'b', team_b_world_rank FROM maps) SELECT team, CAST(team AS VARCHAR) AS name, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC, match_id DESC, map_pos DESC, side DESC) AS n FROM o) WHERE n = 1"))
def directory(t):
    return Q.team_directory(t.view("maps"))


@query("A29_team_profile", over("maps", body=f"""{SIDES}, h AS (SELECT *, date >= DATE '{AS_OF}' - 90 AS d90, date >= DATE '{AS_OF}' - 30 AS d30, score_self > score_opp AS w FROM sides WHERE date < DATE '{AS_OF}')
    SELECT team, count(*) AS maps_all, count(*) FILTER (w) AS wins_all, count(*) FILTER (d90) AS maps_90, count(*) FILTER (d90 AND w) AS wins_90, count(*) FILTER (d30) AS maps_30, count(*) FILTER (d30 AND w) AS wins_30,
      round(count(*) FILTER (d90 AND w) / nullif(count(*) FILTER (d90), 0), 6) AS win_rate_90, round(avg(CAST(is_lan AS INT)) FILTER (d30), 6) AS lan_rate_30, round(coalesce(exp(avg(opp_log_rank) FILTER (d90)), 100), 1) AS avg_opponent_rank_90 FROM h GROUP BY 1"""))
def profile(t):
    return rounded(Q.team_profile(t.view("maps"), AS_OF))


@query("A35_sample_flags", over("maps", body=f"""{SIDES} SELECT d.team, d.map_name, d.date, count(h.match_id) FILTER (h.date >= d.date - 30) < 10 AS low_team_sample, count(h.match_id) FILTER (h.map_name = d.map_name) < 3 AS low_map_sample FROM (SELECT DISTINCT team, map_name, date FROM sides) d LEFT JOIN sides h ON h.team = d.team AND h.date < d.date AND h.date >= d.date - 90 GROUP BY 1, 2, 3"""))
def sample_flags(t):
    s = P.team_state(P.daily_history(t.view("maps")))
    flags = Q.sample_flags(F.col("maps_30"), F.col("map_maps_90"))
    return s.select("team", "map_name", "date", *[v.alias(k) for k, v in flags.items()])


_LIST = "(SELECT DISTINCT 'team ' || CAST(s_suppkey % 40 AS VARCHAR) AS team_key FROM supplier WHERE s_acctbal > 0)"


def whitelist(t: Tables):
    rows = t.read("supplier").where("s_acctbal > 0").select(F.concat(F.lit("  Team  "), (F.col("s_suppkey") % 40).cast("string")).alias("team"), F.col("s_suppkey").alias("pos"))
    return RD.entity_list(rows)


@query("J8_whitelist_semi", over("corpus", body=f" SELECT match_key FROM corpus WHERE lower(team1) IN {_LIST} OR lower(team2) IN {_LIST}"))
def whitelist_semi(t):
    return RD.whitelist_semi(corpus(t), whitelist(t)).select("match_key")


@query("A30_selected_per_entity", over("corpus", body=f" SELECT w.team_key, count(c.match_key) AS selected FROM {_LIST} w LEFT JOIN corpus c ON lower(c.team1) = w.team_key OR lower(c.team2) = w.team_key GROUP BY 1"))
def selected_per_entity(t):
    names = corpus(t).select(F.explode(F.array_distinct(F.array(X.normalize_team(F.col("team1")), X.normalize_team(F.col("team2"))))).alias("team_key"))
    n = names.groupBy("team_key").agg(F.count("*").alias("n"))
    return whitelist(t).join(n, "team_key", "left").select("team_key", F.coalesce("n", F.lit(0)).cast("long").alias("selected"))


@query("SRC3_read_entity_list", f"SELECT team_key, 'Team ' || regexp_extract(team_key, '\\d+') AS name FROM {_LIST}")
def entity_list(t):
    """Written as CSV and read back through the strict reader."""
    path = shared_folder(t.spark)
    t.read("supplier").where("s_acctbal > 0").select(F.concat(F.lit("  Team  "), (F.col("s_suppkey") % 40).cast("string")).alias("team")).write.option("header", True).csv(path)
    return RD.read_entity_list(t.spark, path)


_OUTCOME = """CASE WHEN d IS NULL THEN 'unknown dates' WHEN d < DATE '1996-01-01' OR d > DATE '2000-12-31' THEN 'outside date bounds' WHEN team1 LIKE '%7' THEN 'team excluded' WHEN match_key % 4 = 0 AND match_key % 3 <> 0 THEN 'stored successes skipped'
    WHEN match_key % 4 = 0 THEN 'eligible retries' ELSE 'eligible new' END"""


def listing(t: Tables):
    k = F.col("match_key")
    d = F.when(k % 50 != 0, F.col("date"))
    out = K.listing_outcome(d, "1996-01-01", "2000-12-31", ~F.col("team1").endswith("7"), k % 4 == 0, k % 3 == 0, True)
    return corpus(t).select("match_key", "date", out.alias("outcome"))


@query("P16_listing_eligibility", over("corpus", body=f" SELECT outcome, count(*) AS n FROM (SELECT {_OUTCOME} AS outcome FROM (SELECT *, CASE WHEN match_key % 50 <> 0 THEN CAST(date AS DATE) END AS d FROM corpus)) GROUP BY 1"))
def listing_eligibility(t):
    return listing(t).groupBy("outcome").agg(F.count("*").alias("n"))


@query("T8_limit_after_eligibility", over("corpus", body=f" SELECT match_key FROM (SELECT match_key, date, {_OUTCOME} AS outcome FROM (SELECT *, CASE WHEN match_key % 50 <> 0 THEN CAST(date AS DATE) END AS d FROM corpus)) WHERE outcome LIKE 'eligible%' ORDER BY date DESC, match_key LIMIT 100"))
def limit_after(t):
    return listing(t).where(F.col("outcome").startswith("eligible")).orderBy(F.desc("date"), "match_key").limit(100).select("match_key")


@query("J9_already_stored_anti", over("corpus", "ledger_matches", body=" SELECT match_key FROM corpus WHERE match_key NOT IN (SELECT match_url FROM ledger_matches WHERE result IN ('team_a', 'team_b'))"))
def already_stored(t):
    done = t.view("ledger_matches").where(F.col("result").isin("team_a", "team_b")).select(F.col("match_url").alias("match_key"))
    return corpus(t).select("match_key").join(done, "match_key", "left_anti")


def upcoming(t: Tables):
    k = F.col("match_url")
    m = t.view("ledger_matches")
    return m.select("match_url", F.when(k % 17 == 0, "TBD").when(k % 19 == 0, "Foo/Bar winner").otherwise(F.col("team_a")).alias("team1"), F.col("team_b").alias("team2"),
                    F.when(k % 23 != 0, F.col("match_date")).alias("date"), F.col("match_time").alias("time"))


@query("P17_predictable_filter", over("ledger_matches", body=""" SELECT match_url, CAST(match_date || ' ' || match_time AS TIMESTAMP) > TIMESTAMP '1999-01-04 00:00:00' AS is_later FROM ledger_matches
    WHERE match_url % 17 <> 0 AND match_url % 19 <> 0 AND match_url % 23 <> 0 AND CAST(match_date || ' ' || match_time AS TIMESTAMP) >= TIMESTAMP '1999-01-01 00:00:00'"""))
def predictable(t):
    return K.predictable(upcoming(t), "1999-01-01 00:00:00").select("match_url", "is_later")


@query("P18_eval_eligibility", over("corpus", body=""" SELECT match_key, CASE WHEN r = '' THEN NULL ELSE r END AS eval_exclusion_reason, CASE WHEN r = '' THEN 1 ELSE 0 END AS valid_for_eval
    FROM (SELECT match_key, concat_ws('; ', CASE WHEN match_key % 5 = 0 THEN 'roster anomaly: substitution' END, CASE WHEN match_key % 30 < 10 OR match_key % 14 < 10 THEN 'low sample' END) AS r FROM corpus)"""))
def eval_eligibility(t):
    k = F.col("match_key")
    e = K.eval_eligibility(F.when(k % 5 == 0, "substitution").otherwise("standard"), k % 30, k % 14)
    return corpus(t).select("match_key", *[c.alias(n) for n, c in e.items()])


@query("J18_alias_resolve", f"""WITH x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'NAVI' WHEN 1 THEN 'Team ' || n_name || '!' WHEN 2 THEN 'evt' || CAST(c_nationkey AS VARCHAR) WHEN 3 THEN 'LVG' ELSE c_name END AS label, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT c_custkey AS row_id, label, CASE c_custkey % 5 WHEN 0 THEN 'Natus Vincere' WHEN 1 THEN n_name WHEN 2 THEN n_name WHEN 3 THEN 'Lynn Vision' ELSE label END AS team FROM x""")
def alias_resolve(t):
    n = t.read("nation")
    k = F.col("c_custkey") % 5
    lab = (F.when(k == 0, "NAVI").when(k == 1, F.concat(F.lit("Team "), "n_name", F.lit("!"))).when(k == 2, F.concat(F.lit("evt"), F.col("c_nationkey").cast("string"))).when(k == 3, "LVG").otherwise(F.col("c_name")))
    x = t.read("customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("row_id"), lab.alias("label"))
    ev = n.select(F.concat(F.lit("EVT "), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_name").alias("team"))
    return RD.resolve_aliases(x, n.select(F.col("n_name").alias("name")), ev, C.GLOBAL_TEAM_ALIASES)


# ---- sources and sinks ----------------------------------------------------
@query("SRC1_read_matches", over("corpus", body=" SELECT url, event, len(hltv_maps) AS maps, len(match_info) AS lines FROM corpus"))
def read_matches(t):
    path = shared_folder(t.spark)
    c = corpus(t).select("url", "date", "event", "format", "team1", "team2", "match_info", "hltv_vetoes", "hltv_maps", "team_ranks")
    c.write.option("compression", "lz4").json(path)  # a fifth of the text, for the disk and the way to it
    r = RD.read_matches(t.spark, path)
    return r.select("url", "event", F.size("hltv_maps").cast("long").alias("maps"), F.size("match_info").cast("long").alias("lines"))


@query("SRC2_read_table", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def read_table(t):
    return RD.read_table(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_orderdate"]).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("SRC4_read_eras", "SELECT n_name AS name, DATE '1995-01-01' + n_nationkey AS \"start\", 'Dust2,Mirage,X' AS maps, CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS era_no FROM nation")
def read_eras(t):
    n = t.read("nation").select(F.col("n_name").alias("name"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("n_nationkey")).cast("string").alias("start"), F.lit(None).cast("string").alias("end"),
                                F.array(F.lit("dust ii"), F.lit("MRG"), F.lit(" X ")).alias("maps"), F.lit(None).cast("array<string>").alias("events"), (F.col("n_nationkey") + 1).alias("era_no"))
    # one JSON array in one file, as a registry is kept: a row per nation
    listed = n.groupBy().agg(F.sort_array(F.collect_list(F.struct("era_no", "name", "start", "end", "maps", "events"))).alias("e"))
    text = F.to_json(F.transform("e", lambda x: x.dropFields("era_no")))
    path = shared_folder(t.spark)
    listed.select(text.alias("value")).coalesce(1).write.text(path)
    return RD.read_eras(t.spark, path).select("name", "start", F.array_join("maps", ",").alias("maps"), F.col("era_no").cast("int").alias("era_no"))


@query("SRC5_read_aliases", "SELECT 'a' || CAST(c_custkey AS VARCHAR) AS alias, c_name AS team FROM customer WHERE c_custkey % 3 = 0")
def read_aliases(t):
    k = F.col("c_custkey")
    path = F.when(k % 3 == 0, "/Esl/Pro League/").when(k % 3 == 1, "/esl/pro").otherwise("/iem")
    rows = t.read("customer").select(path.alias("event_path"), F.concat(F.lit(" a"), k.cast("string")).alias("alias"), F.col("c_name").alias("team"))
    folder = shared_folder(t.spark)
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(folder)
    return RD.read_aliases(t.spark, folder, "/esl/pro_league/2024").select("alias", "team")


@query("SNK2_write_results_csv", over("scored", body=_RES + " SELECT variant, fold, CAST(seed AS VARCHAR) AS seed FROM rs"))
def write_csv(t):
    path = shared_folder(t.spark)
    SK.write_csv(results(t), path)
    return t.spark.read.option("header", True).csv(path).select("variant", "fold", "seed")


@query("SNK3_write_metrics_json", over("snapshots", body=" SELECT id, CASE WHEN id % 7 IN (0, 1) THEN '{\"id\":' || CAST(id AS VARCHAR) || ',\"v\":null}' ELSE '{\"id\":' || CAST(id AS VARCHAR) || ',\"v\":0.5}' END AS json FROM snapshots"))
def write_json(t):
    v = F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 7 == 1, F.lit(float("inf"))).otherwise(0.5)
    d = t.view("snapshots").select("id", v.alias("v"))
    return d.select("id").withColumn("k", F.col("id")).join(SK.as_json_rows(d).withColumn("k", F.get_json_object("json", "$.id").cast("long")), "k").select("id", "json")


@query("SNK4_merge_records", over("ledger_matches", body=" SELECT match_url, CASE WHEN match_url % 3 = 0 THEN 'new' ELSE result END AS result FROM ledger_matches UNION ALL SELECT match_url + 10000000, 'new' FROM ledger_matches WHERE match_url % 30 = 0"))
def merge_records(t):
    m = t.view("ledger_matches").select("match_url", "result")
    new = m.where(F.col("match_url") % 3 == 0).select("match_url", F.lit("new").alias("result"))
    extra = m.where(F.col("match_url") % 30 == 0).select((F.col("match_url") + 10000000).alias("match_url"), F.lit("new").alias("result"))
    return SK.merge_records(m, new.unionByName(extra), ["match_url"])


@query("SNK5_append_snapshots", over("ledger_matches", "snapshots", body=""" , f AS (SELECT DISTINCT match_url FROM ledger_matches WHERE match_url % 2 = 1) SELECT 'matches' AS part, count(*) AS rows FROM f UNION ALL SELECT 'snapshots', count(*) FROM ledger_matches
    UNION ALL SELECT 'book_odds', CAST(sum(CASE WHEN match_url % 5 = 0 THEN 1 ELSE 2 END) AS BIGINT) FROM ledger_matches"""))
def append_snapshots(t):
    from rivalry.operators import ledger as L

    k = F.col("match_url")
    known = t.view("ledger_matches").where(k % 2 == 0)
    odds = F.array(F.struct(F.lit("b1").alias("bookmaker"), F.lit(2.0).alias("odds_a"), F.lit(1.8).alias("odds_b")), F.struct(F.lit("b2").alias("bookmaker"), F.when(k % 5 != 0, 1.5).alias("odds_a"), F.lit(2.5).alias("odds_b")))
    pred = t.view("ledger_matches").drop("result", "date").withColumns({"version_id": F.lit("v1"), "model_prob_a": F.lit(0.6), "odds_a": F.lit(2.0), "odds_b": F.lit(1.8), "edge_a": F.lit(10.0), "edge_b": F.lit(-15.0), "bookmaker_odds": odds})
    parts = L.new_snapshots(pred, known, "2024-01-01 00:00:00")
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("SNK5_latest_after_append", over("ledger_matches", body=""" SELECT match_url, CASE WHEN match_url % 3 = 0 THEN 1::BIGINT ELSE 2 END AS num_snapshots,
    CASE WHEN match_url % 3 = 0 THEN '2024-01-01 00:00:00' ELSE '2024-01-02 00:00:00' END AS snapshot_time,
    CASE WHEN match_url % 3 = 0 THEN 0.6E0 ELSE 0.7E0 END AS model_prob_a FROM ledger_matches"""))
def latest_after_append(t):
    """Two batches and a retry of the second are appended; the newest snapshot of a match is the later batch's."""
    from rivalry.operators import ledger as L

    matches = t.view("ledger_matches")
    odds = F.array(F.struct(F.lit("b1").alias("bookmaker"), F.lit(2.0).alias("odds_a"), F.lit(1.8).alias("odds_b")))

    def batch(rows, p, seen):
        pred = rows.drop("result", "date").withColumns({"version_id": F.lit("v1"), "model_prob_a": F.lit(p), "odds_a": F.lit(2.0), "odds_b": F.lit(1.8),
                                                        "edge_a": F.lit(10.0), "edge_b": F.lit(-15.0), "bookmaker_odds": odds})
        return L.new_snapshots(pred, matches, seen)["snapshots"]

    path = shared_folder(t.spark)
    later = matches.where(F.col("match_url") % 3 != 0)
    for rows, p, seen in ((later, 0.7, "2024-01-02 00:00:00"), (matches, 0.6, "2024-01-01 00:00:00"), (later, 0.7, "2024-01-02 00:00:00")):
        batch(rows, p, seen).write.mode("append").parquet(path)
    stored = L.first_row(t.spark.read.parquet(path), ["id"], ["snapshot_time"])
    return L.latest_snapshot(matches.select("match_url"), stored).select("match_url", "num_snapshots", "snapshot_time", "model_prob_a")


@query("SNK6_upsert_evaluation", over("versions", body=" SELECT version_id, 'test' AS eval_name, CASE WHEN trained_at % 2 = 0 THEN 21 ELSE 20 END AS rows FROM versions"))
def upsert_evaluation(t):
    v = t.view("versions")
    old = v.select("version_id", F.lit("test").alias("eval_name"), F.lit(20).alias("rows"))
    new = v.where(F.col("trained_at") % 2 == 0).select("version_id", F.lit("test").alias("eval_name"), F.lit(21).alias("rows"))
    return SK.merge_records(old, new, ["version_id", "eval_name"])


@query("SNK7_register_version", over("versions", body=" SELECT version_id, CAST(version_id = 'v9' AS INT) AS is_active FROM versions UNION ALL SELECT 'new', 0"))
def register_version(t):
    from rivalry.operators import ledger as L

    v = t.view("versions").select("version_id")
    new = v.limit(1).select(F.lit("new").alias("version_id"))
    return L.set_active(SK.merge_records(v.withColumn("x", F.lit(1)), new.withColumn("x", F.lit(1)), ["version_id"]).drop("x"), "v9")


@query("S1_union_all_sides", over("forfeit_base", body=" SELECT team, count(*) AS n FROM (SELECT team1_id AS team FROM forfeit_base UNION ALL SELECT team2_id FROM forfeit_base) GROUP BY 1"))
def union_sides(t):
    b = t.view("forfeit_base")
    return b.select(F.explode(F.array("team1_id", "team2_id")).alias("team")).groupBy("team").agg(F.count("*").alias("n"))


@query("S4_dedupe_on_key", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedupe_on_key(t):
    return t.read("lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


@query("S5_set_operations", over("corpus", body=f""" SELECT match_key, len(list_filter(mp, lambda x: list_contains({_list(C.ACTIVE_POOL)}, x))) AS common, len(list_filter(mp, lambda x: NOT list_contains({_list(C.ACTIVE_POOL)}, x))) = 0 AS subset FROM (SELECT match_key, list_distinct(list_transform(hltv_maps, lambda m: m.map_name)) AS mp FROM corpus)"""))
def set_operations(t):
    names, pool = F.array_distinct("hltv_maps.map_name"), F.array(*[F.lit(m) for m in C.ACTIVE_POOL])
    return corpus(t).select("match_key", F.size(F.array_intersect(names, pool)).cast("long").alias("common"), (F.size(F.array_except(names, pool)) == 0).alias("subset"))


@query("S8_first_seen_by_url", over("corpus", body=" SELECT CAST(match_key // 3 AS VARCHAR) AS url, min(match_key) AS match_key FROM corpus GROUP BY 1"))
def first_seen(t):
    c = corpus(t).select(F.floor(F.col("match_key") / 3).cast("string").alias("url"), "match_key")
    return O.first_row(c, ["url"], ["match_key"])


# ---- models ---------------------------------------------------------------
_Z = ["p", "rank_diff"]


@query("M1_standardise", over("scored", body=_SPLIT + ", m AS (SELECT avg(p) AS a1, stddev_pop(p) AS s1, avg(rank_diff) AS a2, stddev_pop(rank_diff) AS s2 FROM sp WHERE split = 'train') SELECT match_id, round((p - a1) / s1, 6) AS p, round((rank_diff - a2) / s2, 6) AS rank_diff FROM sp, m"))
def standardise(t):
    d = split_scored(t)
    return rounded(ML.standardise(d.select("match_id", *_Z), ML.fit_scale(d.where(F.col("split") == "train"), _Z), _Z))


@query("M2_one_hot", over("forfeit_base", body=" SELECT match_id, CASE WHEN date >= DATE '1999-01-01' AND region = 'zzz' THEN -1 ELSE (SELECT count(DISTINCT region) FROM forfeit_base h WHERE h.date < DATE '1999-01-01' AND h.region < b.region) END AS slot, CAST(1 AS DOUBLE) AS total FROM forfeit_base b"))
def one_hot(t):
    from pyspark.ml.functions import vector_to_array

    b = t.view("forfeit_base").select("match_id", "date", "region")
    enc = ML.one_hot_frame(b.where(F.col("date") < F.lit("1999-01-01").cast("date")), b, ["region"]).withColumn("v", vector_to_array("region_oh"))
    return enc.select("match_id", (F.array_position("v", 1.0) - 1).alias("slot"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


def forfeit_splits(t: Tables):
    f = persist_table(R.forfeit_features(t.view("forfeit_base")))
    d = persist_table(E.temporal_split(f, ["date", "match_id"]))  # every fit reads its rows several times
    return [d.where(F.col("split") == s) for s in ("train", "validation", "test")]


@query("M3_logistic_grid")
def logistic_grid(t):
    train, val, test = forfeit_splits(t)
    model, _ = ML.fit_logistic_grid(train, val, C.FORFEIT_NUMERIC, C.FORFEIT_CATEGORICAL)
    scale = ML.fit_scale(train, C.FORFEIT_NUMERIC)
    return rounded(ML.score_frame(model, ML.standardise(test, scale, C.FORFEIT_NUMERIC)).select("match_id", "forfeit_target", "p"), 4)


@query("M4_calibration")
def calibration(t):
    train, val, test = forfeit_splits(t)
    scale = ML.fit_scale(train, C.FORFEIT_NUMERIC)
    model = ML.logistic_pipeline(C.FORFEIT_NUMERIC, C.FORFEIT_CATEGORICAL, 0.3, train.count(), "forfeit_target").fit(ML.standardise(train, scale, C.FORFEIT_NUMERIC))
    v, s = (ML.score_frame(model, ML.standardise(d, scale, C.FORFEIT_NUMERIC)).select("match_id", "forfeit_target", "p", "margin") for d in (val, test))
    return rounded(ML.isotonic(v, ML.apply_platt(ML.platt(v, "forfeit_target"), s, "p_platt"), "forfeit_target", name="p_isotonic").select("match_id", "p", "p_platt", "p_isotonic"), 4)


def winner_splits(t: Tables):
    f = persist_table(P.min_history_filter(P.compute_features(feature_maps(t))))
    d = E.temporal_split(f, ["date", "match_id", "map_pos"])
    return [d.where(F.col("split") == s) for s in ("train", "validation", "test")]


@query("M5_winner_classifier")
def winner(t):
    train, val, test = winner_splits(t)
    model, _ = ML.fit_winner(P.mirror_rows(train.select(*C.MODEL_FEATURES, "label")), val)
    scale = ML.fit_scale(P.mirror_rows(train.select(*C.MODEL_FEATURES, "label")), C.MODEL_FEATURES)
    rows = test.select("match_id", "map_pos", "label", *[F.col(f).cast("double").alias(f) for f in C.MODEL_FEATURES])
    return rounded(ML.score_frame(model, ML.standardise(rows, scale, C.MODEL_FEATURES)).select("match_id", "map_pos", "label", "p"), 4)


@query("M6_score_frame")
def score(t):
    train, _, test = winner_splits(t)
    scale = ML.fit_scale(train, C.MODEL_FEATURES)
    model = ML.logistic_pipeline(C.MODEL_FEATURES, [], 1.0, train.count(), "label").fit(ML.standardise(train, scale, C.MODEL_FEATURES))
    return rounded(ML.score_frame(model, ML.standardise(test, scale, C.MODEL_FEATURES)).select("match_id", "map_pos", "p"), 4)


# both starters' probabilities of the known maps, and all outcomes of a best-of-n, enumerated
_KNOWN = """, st AS (SELECT unnest([{'s': 'a', 'k': 0}, {'s': 'b', 'k': 6}]) AS st)
, pr AS (SELECT match_id, st.s AS starter, CASE match_format WHEN 'bo1' THEN 1 WHEN 'bo3' THEN 3 ELSE 5 END AS n,
         list_transform([37, 41, 43, 47, 53], lambda m: ((match_id * (m + st.k)) % 97 + 1) / 99.0E0) AS ps FROM series, st)
, oc AS (SELECT *, unnest(range(0, CAST(2 ** n AS INT))) AS o FROM pr)
, ow AS (SELECT *, list_transform(range(0, n), lambda i: (o // CAST(2 ** i AS INT)) % 2) AS bits,
         list_product(list_transform(range(0, n), lambda i: CASE WHEN (o // CAST(2 ** i AS INT)) % 2 = 1 THEN ps[i + 1] ELSE 1 - ps[i + 1] END)) AS pp FROM oc)
, oz AS (SELECT *, list_filter(range(1, n + 1), lambda k: list_sum(bits[1:k]) = n // 2 + 1 OR k - list_sum(bits[1:k]) = n // 2 + 1)[1] AS stop FROM ow)
, ls AS (SELECT match_id, starter, CAST(CAST(list_sum(bits[1:stop]) AS INT) AS VARCHAR) || '-' || CAST(CAST(stop - list_sum(bits[1:stop]) AS INT) AS VARCHAR) AS outcome,
         sum(pp) AS p FROM oz GROUP BY ALL
         UNION ALL SELECT match_id, starter, 'win', sum(pp) FILTER (list_sum(bits) >= n // 2 + 1) FROM oz GROUP BY ALL)
SELECT match_id, outcome, round(avg(p), 6) AS probability FROM ls GROUP BY ALL"""


@query("M9_known_map_prediction", over("series", body=_KNOWN))
def known_maps(t):
    """Series and scoreline probability of every series from given map probabilities of both starters."""
    p = F.array(*[F.struct(F.lit(s).alias("starter"), F.lit(i + 1).alias("map_pos"), (((F.col("match_id") * (m + k)) % 97 + 1).cast("double") / 99).alias("p"))
                  for s, k in (("a", 0), ("b", 6)) for i, m in enumerate((37, 41, 43, 47, 53))])
    return rounded(S.known_map_series(t.view("series").select("match_id", "match_format", F.inline(p))))


@query("M9_winner_model_series")
def winner_series(t):
    """The same from the winner model: every series is probed as unseen, once per starter."""
    maps = feature_maps(t)
    train, val, _ = winner_splits(t)
    mirrored = P.mirror_rows(train.select(*C.MODEL_FEATURES, "label"))
    model, _ = ML.fit_winner(mirrored, val)
    probes = persist_table(P.compute_features(maps, maps.drop("winner_id", "score_a", "score_b")))
    n = F.when(F.col("match_format") == "bo5", 5).when(F.col("match_format") == "bo3", 3).otherwise(1)
    both = probes.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("starter"))
    who = B.map_picker(F.col("map_pos") - 1, n, F.col("starter"))
    both = both.withColumn("picker_diff", F.when(who == "a", 1).when(who == "b", -1).otherwise(0))
    rows = both.select("match_id", "match_format", "map_pos", "starter", *[F.col(f).cast("double").alias(f) for f in C.MODEL_FEATURES])
    scored = ML.score_frame(model, ML.standardise(rows, ML.fit_scale(mirrored, C.MODEL_FEATURES), C.MODEL_FEATURES))
    return rounded(S.known_map_series(scored.select("match_id", "match_format", "starter", "map_pos", "p")), 4)


@query("E10_backtest")
def backtest(t):
    train, _, test = winner_splits(t)
    scale = ML.fit_scale(train, C.MODEL_FEATURES)
    model = ML.logistic_pipeline(C.MODEL_FEATURES, [], 1.0, train.count(), "label").fit(ML.standardise(train, scale, C.MODEL_FEATURES))
    return rounded(ML.backtest(model, scale, test, C.MODEL_FEATURES), 4)


# ---- streams --------------------------------------------------------------
def _stream(t: Tables):
    return ST.read_stream(t.spark, t.folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("ST1_stream_snapshots", "SELECT event_id, user_id FROM events")
def stream_snapshots(t):
    path = shared_folder(t.spark)
    ST.run_available(ST.stream_snapshots(_stream(t), "event_id", "ts").select("event_id", "user_id"), path)
    return t.spark.read.parquet(f"{path}/data")


@query("ST2_stream_settle", over("event_rows", body=" SELECT user_id, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last_event FROM event_rows GROUP BY 1"))
def stream_settle(t):
    path = shared_folder(t.spark)

    def settle(batch, batch_id: int) -> None:
        """One idempotent part per micro-batch; parts are combined on read."""
        batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event")).write.mode("overwrite").parquet(f"{path}/data/part={batch_id}")

    ST.stream_settle(_stream(t), path, settle)
    return t.spark.read.parquet(f"{path}/data").groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event"))


@query("ST3_stream_period_trend", over("event_rows", body=" SELECT CAST(date_trunc('week', date) AS DATE) AS period_start, count(*) AS matches, CAST(sum(forfeit_target) AS BIGINT) AS forfeits FROM event_rows GROUP BY 1"))
def stream_trend(t):
    path = shared_folder(t.spark)
    s = _stream(t).withColumn("forfeit_target", F.when(F.col("value") > 10, 1).otherwise(0))
    ST.run_updates(ST.stream_period_trend(s, "ts", "forfeit_target", "week"), path)
    return ST.latest_updates(t.spark, path, ["period_start"])


@query("ST4_stream_form", over("event_rows", body=" SELECT CAST(date + k AS DATE) AS day, user_id, count(*) AS maps, CAST(sum(forfeit_target) AS BIGINT) AS wins FROM event_rows, (SELECT CAST(unnest(range(1, 8)) AS INT) AS k) GROUP BY 1, 2"))
def stream_form(t):
    path = shared_folder(t.spark)
    s = _stream(t).withColumn("won", F.when(F.col("value") > 10, 1).otherwise(0))
    ST.run_updates(ST.stream_form(s, "ts", "user_id", "won"), path)
    return ST.latest_updates(t.spark, path, ["day", "user_id"])
