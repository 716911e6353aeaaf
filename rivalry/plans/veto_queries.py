"""Pick/ban log queries: parsing, eras, signals, ban models and team histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.functions import text as X
from rivalry.operators import clean as K
from rivalry.operators import veto as V
from rivalry.plans.clean_queries import BLOB, FORMAT, VETO_REASON, q
from rivalry.plans.feature_queries import rounded
from rivalry.plans.registry import Tables, corpus, over, query
from rivalry.session import persist_table

ERAS = [
    ("early", None, "1997-06-01", C.POOL_OVERPASS, ["Winter Cup Asia 1998"]),
    ("mid", "1997-06-01", "1999-06-01", C.POOL_CACHE, []),
    ("late", "1999-06-01", None, C.POOL_OVERPASS, []),
]
ADHOC = ["mrg", "Ancient", "Dust2", "Nuke", "Inferno"]


#: What the era of a record never depends on, and what no veto operator reads.
NOT_ERA = ("team_ranks", "match_info", "hltv_maps")
NOT_VETO = ("team_ranks", "player_stats")


def veto_corpus(t: Tables, without: tuple[str, ...] = NOT_VETO):
    """Records with the year in the event name and some explicit era metadata."""
    k = F.col("match_key")
    return corpus(t, without).withColumns({
        "event": F.concat_ws(" ", "event", F.substring("date", 1, 4)),
        "map_pool_era": F.when(k % 19 == 3, "mid"),
        "map_pool": F.when(k % 23 == 4, F.array(*[F.lit(m) for m in ADHOC]))})


def parsed(t: Tables):
    return V.veto_matches(veto_corpus(t), V.era_frame(t.spark, ERAS))


def signals(t: Tables):
    """Ban signals; the parsed logs are written once because history reads them three times."""
    return V.ban_signals(V.with_history(persist_table(parsed(t))))


def exact(df):
    """Weights are short decimals: nine digits keep rounding ties out of the comparison."""
    return rounded(df, 9)


def _list(items) -> str:
    return "[" + ", ".join(q(m) for m in items) + "]"


_CANON = ", ".join(f"({q(k)}, {q(v)})" for k, v in X.map_alias_rows())
_ACT, _DEC = (p.replace("(?i)", "") for p in (C.VETO_ACTION_PATTERN, C.VETO_DECIDER_PATTERN))
_ERA_ROWS = ", ".join(
    f"({i + 1}, {q(n)}, {'DATE ' + q(s) if s else 'CAST(NULL AS DATE)'}, {'DATE ' + q(e) if e else 'CAST(NULL AS DATE)'}, {_list(m)}, {_list([x.lower() for x in ev]) if ev else 'CAST([] AS VARCHAR[])'})"
    for i, (n, s, e, m, ev) in enumerate(ERAS))
ERA_SQL = f"""{BLOB}
, al AS (SELECT * FROM (VALUES {_CANON}) v(alias, canon))
, er AS (SELECT * FROM (VALUES {_ERA_ROWS}) v(no, name, s, e, maps, events))
, vc AS (SELECT match_key, url, CAST(date AS DATE) AS day, lower(event || ' ' || substr(date, 1, 4)) AS ek, upper(trim(team1)) AS a, upper(trim(team2)) AS b, {FORMAT.format('format')} AS fmt,
    hltv_vetoes, hltv_maps, {VETO_REASON} AS bad, CASE WHEN match_key % 19 = 3 THEN 'mid' END AS ename, match_key % 23 = 4 AS adhoc FROM blob)
, l0 AS (SELECT match_key, i, trim(hltv_vetoes[i]) AS line FROM (SELECT match_key, hltv_vetoes, unnest(range(1, len(hltv_vetoes) + 1)) AS i FROM vc))
, l1 AS (SELECT match_key, i, CASE WHEN regexp_matches(line, {q(_ACT)}, 'i') THEN CASE WHEN lower(regexp_extract(line, {q(_ACT)}, 3, 'i')) = 'removed' THEN 'ban' ELSE 'pick' END
      WHEN regexp_matches(line, {q(_DEC)}, 'i') THEN 'decider' END AS act, upper(trim(regexp_extract(line, {q(_ACT)}, 2, 'i'))) AS team,
      CASE WHEN regexp_matches(line, {q(_ACT)}, 'i') THEN regexp_extract(line, {q(_ACT)}, 4, 'i') ELSE regexp_extract(line, {q(_DEC)}, 2, 'i') END AS raw,
      TRY_CAST(regexp_extract(line, '^\\s*(\\d+)', 1) AS INT) AS idx FROM l0)
, ln AS (SELECT l1.*, al.canon AS map FROM l1 LEFT JOIN al ON al.alias = lower(trim(l1.raw)) WHERE act IS NOT NULL)
, ob AS (SELECT match_key, list(DISTINCT map) AS obs FROM ln WHERE map IS NOT NULL GROUP BY 1)
, fit AS (SELECT ob.match_key, count(*) AS n, count(DISTINCT list_sort(er.maps)) AS pools, arg_max(er.name, coalesce(er.s, DATE '0001-01-01')) FILTER ((er.s IS NULL OR v.day >= er.s) AND (er.e IS NULL OR v.day < er.e)) AS dated,
      min(er.name) AS only_name FROM ob JOIN vc v USING (match_key) JOIN er ON len(list_filter(ob.obs, lambda x: NOT list_contains(er.maps, x))) = 0 GROUP BY 1)
, rs AS (SELECT v.match_key, v.ek, CASE WHEN ename IS NOT NULL THEN ename WHEN adhoc THEN 'explicit_match_pool' ELSE (SELECT min(name) FROM er WHERE list_contains(er.events, v.ek)) END AS explicit,
      CASE WHEN f.n = 1 THEN f.only_name WHEN f.pools = 1 THEN f.dated END AS inferred FROM vc v LEFT JOIN fit f USING (match_key))
, hn AS (SELECT ek, min(n) AS hint FROM (SELECT ek, coalesce(explicit, inferred) AS n FROM rs) WHERE n IS NOT NULL AND n <> 'explicit_match_pool' AND ek <> '' GROUP BY 1 HAVING count(DISTINCT n) = 1)
, re AS (SELECT v.*, coalesce(rs.explicit, rs.inferred, hn.hint, (SELECT max_by(name, coalesce(s, DATE '0001-01-01')) FROM er WHERE (s IS NULL OR v.day >= s) AND (e IS NULL OR v.day < e))) AS era
    FROM vc v JOIN rs USING (match_key) LEFT JOIN hn ON hn.ek = v.ek)
, rp AS (SELECT re.*, CASE WHEN era = 'explicit_match_pool' THEN {_list(['Mirage', *ADHOC[1:]])} ELSE (SELECT maps FROM er WHERE er.name = era) END AS pool FROM re)"""
VETO_SQL = f"""{ERA_SQL}
, us AS (SELECT ln.*, rp.url AS match_id, rp.day, rp.a, rp.b, rp.fmt, rp.era, rp.pool, row_number() OVER (PARTITION BY ln.match_key, ln.map ORDER BY i) AS seen FROM ln JOIN rp USING (match_key)
    WHERE rp.bad IS NULL AND rp.a <> '' AND rp.b <> '' AND rp.fmt IN ('bo1', 'bo3', 'bo5') AND list_contains(rp.pool, ln.map) AND (ln.act = 'decider' OR ln.team IN (rp.a, rp.b)))
, ac AS (SELECT match_key, match_id, day, fmt, era, pool, a, b, act, i, idx, CASE WHEN act <> 'decider' THEN team END AS team, CASE WHEN act <> 'decider' THEN CASE WHEN team = a THEN b ELSE a END END AS opp, map,
      CASE WHEN act = 'ban' THEN row_number() OVER (PARTITION BY match_key, act, team ORDER BY i) END AS slot, list(map) OVER (PARTITION BY match_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM us WHERE seen = 1)
, av AS (SELECT *, list_filter(pool, lambda x: NOT list_contains(coalesce(used, []), x)) AS pool_before FROM ac)
, mt AS (SELECT DISTINCT match_key, match_id, day, fmt, era, a, b FROM av)"""


def veto_sql(body: str) -> str:
    return over("corpus", body=VETO_SQL + " " + body)


@query("J12_era_resolve", over("corpus", body=f"{ERA_SQL} SELECT url, era AS era_name, array_to_string(pool, ',') AS pool FROM rp"))
def era_resolve(t):
    r = V.resolve_eras(veto_corpus(t, NOT_ERA), V.era_frame(t.spark, ERAS), ["url"])
    return r.select("url", F.col("era.name").alias("era_name"), F.array_join("era.maps", ",").alias("pool"))


@query("J13_event_hints", over("corpus", body=f"{ERA_SQL} SELECT ek AS event_key, hint FROM hn"))
def event_hints(t):
    c = X.settle(veto_corpus(t, NOT_ERA), parsed=V.parsed_lines(F.col("hltv_vetoes")), day=F.to_date("date"), event_key=F.lower(X.strip(F.col("event"))))
    return V.event_hints(V.resolve_without_hints(V.with_registry(c, V.era_frame(t.spark, ERAS))))


@query("X7_parse_veto_line", over("corpus", body=f"{ERA_SQL} SELECT match_key, idx, CASE WHEN act = 'decider' THEN '' ELSE team END AS team, act AS action, map FROM ln"))
def parse_lines(t):
    return corpus(t).select("match_key", F.inline(V.parsed_lines(F.col("hltv_vetoes"))))


@query("W17_ban_slot_index", veto_sql("SELECT match_id, idx AS global_action_index, team AS team_id, map AS map_name, CAST(slot AS INT) AS team_ban_index FROM av WHERE act = 'ban'"))
def slot_index(t):
    a = V.action_rows(parsed(t)).where(F.col("action_type") == "ban")
    return a.select("match_id", "global_action_index", "team_id", "map_name", "team_ban_index")


@query("W18_pool_before", veto_sql("SELECT match_id, idx AS global_action_index, act AS action_type, map AS map_name, array_to_string(pool_before, ',') AS pool_before FROM av"))
def pool_before(t):
    return V.action_rows(parsed(t)).select("match_id", "global_action_index", "action_type", "map_name", F.array_join("pool_before", ",").alias("pool_before"))


@query("J15_pool_cross", veto_sql(", c AS (SELECT match_id, team, slot, unnest(pool_before) AS candidate FROM av WHERE act = 'ban') SELECT match_id, team AS team_id, CAST(slot AS INT) AS team_ban_index, candidate FROM c"))
def pool_cross(t):
    a = V.action_rows(parsed(t)).where(F.col("action_type") == "ban")
    return a.select("match_id", "team_id", "team_ban_index", F.explode("pool_before").alias("candidate"))


_PAST = "h.day >= r.day - 90 AND (h.day < r.day OR (h.day = r.day AND h.match_id < r.match_id))"


def _asof(name: str, probes: str, history: str, keys: list[str], agg: str = "count(h.match_id)") -> str:
    cols = ", ".join(f"r.{k}" for k in ["match_id", "day", *keys])
    on = " AND ".join(f"h.{k} = r.{k}" for k in keys)
    return f", {name} AS (SELECT {cols}, {agg} AS n FROM (SELECT DISTINCT match_id, day, {', '.join(keys)} FROM {probes}) r LEFT JOIN {history} h ON {on} AND {_PAST} GROUP BY {cols})"


SIGNAL_SQL = VETO_SQL + """
, bans AS MATERIALIZED (SELECT match_id, day, era, team, fmt, slot, map FROM av WHERE act = 'ban')
, pk AS MATERIALIZED (SELECT match_id, day, era, team, map FROM av WHERE act = 'pick')
, sr AS MATERIALIZED (SELECT match_id, day, era, fmt, unnest([a, b]) AS team FROM mt)
, pm0 AS (SELECT v.match_id, v.day, v.era, v.a, v.b, al.canon AS map, TRY_CAST(m.team1_score AS INT) AS s1, TRY_CAST(m.team2_score AS INT) AS s2, upper(trim(m.team1)) AS n1, upper(trim(m.team2)) AS n2, pos
    FROM (SELECT mt.*, unnest(c.hltv_maps) AS m, generate_subscripts(c.hltv_maps, 1) AS pos FROM mt JOIN corpus c USING (match_key)) v JOIN al ON al.alias = lower(trim(m.map_name)))
, pm1 AS (SELECT *, CASE WHEN s1 > s2 THEN n1 WHEN s2 > s1 THEN n2 END AS w FROM pm0)
, pm2 AS (SELECT *, CASE WHEN w = a THEN a WHEN w = b THEN b WHEN contains(a, w) OR contains(w, a) THEN a WHEN contains(b, w) OR contains(w, b) THEN b END AS winner FROM pm1)
, lw AS (SELECT match_id, map, arg_max(winner, pos) AS winner FROM pm2 WHERE winner IS NOT NULL GROUP BY 1, 2)
, pl AS MATERIALIZED (SELECT p.match_id, p.day, p.era, p.map, unnest([p.a, p.b]) AS team, lw.winner FROM pm2 p LEFT JOIN lw ON lw.match_id = p.match_id AND lw.map = p.map)
, plw AS MATERIALIZED (SELECT * FROM pl WHERE winner = team)
, cd AS MATERIALIZED (SELECT match_id, day, era, fmt, team, opp, slot, map AS actual, pool_before, unnest(pool_before) AS cand, generate_subscripts(pool_before, 1) AS pos FROM av WHERE act = 'ban')
, cs1 AS (SELECT match_id, day, era, fmt, team, slot, cand AS map FROM cd), cs2 AS (SELECT match_id, day, era, fmt, opp AS team, 1 AS slot, cand AS map FROM cd UNION SELECT match_id, day, era, fmt, team, 1, cand FROM cd)
, ct AS (SELECT match_id, day, era, fmt, team, map FROM cs1 UNION SELECT match_id, day, era, fmt, team, map FROM cs2)""" + "".join([
    _asof("n_slot", "(SELECT * FROM cs1 UNION SELECT * FROM cs2)", "bans", ["era", "team", "fmt", "slot", "map"]),
    _asof("n_ev", "ct", "bans", ["era", "team", "fmt", "map"]), _asof("n_ban", "ct", "bans", ["era", "team", "map"]),
    _asof("n_glob", "cs1", "bans", ["era", "fmt", "slot", "map"]), _asof("n_pick", "ct", "pk", ["era", "team", "map"]),
    _asof("n_play", "ct", "pl", ["era", "team", "map"]), _asof("n_win", "ct", "plw", ["era", "team", "map"]),
    _asof("n_series", "ct", "sr", ["era", "team"]), _asof("n_pickable", "ct", "sr", ["era", "team"], "count(h.match_id) FILTER (h.fmt <> 'bo1')"),
]) + """
, sg0 AS (SELECT cd.*, len(pool_before) AS sz, s.n AS c_slot, s1.n AS c_first, o1.n AS c_ofirst, e.n AS c_ev, b.n AS c_ban, g.n AS c_glob, p.n AS c_pick, y.n AS c_play, w.n AS c_win, oy.n AS c_oplay, ow.n AS c_owin, se.n AS c_series, sp.n AS c_pickable
  FROM cd JOIN n_slot s ON s.match_id = cd.match_id AND s.team = cd.team AND s.slot = cd.slot AND s.map = cand
    JOIN n_slot s1 ON s1.match_id = cd.match_id AND s1.team = cd.team AND s1.slot = 1 AND s1.map = cand JOIN n_slot o1 ON o1.match_id = cd.match_id AND o1.team = cd.opp AND o1.slot = 1 AND o1.map = cand
    JOIN n_ev e ON e.match_id = cd.match_id AND e.team = cd.team AND e.map = cand JOIN n_ban b ON b.match_id = cd.match_id AND b.team = cd.team AND b.map = cand
    JOIN n_glob g ON g.match_id = cd.match_id AND g.slot = cd.slot AND g.map = cand JOIN n_pick p ON p.match_id = cd.match_id AND p.team = cd.team AND p.map = cand
    JOIN n_play y ON y.match_id = cd.match_id AND y.team = cd.team AND y.map = cand JOIN n_win w ON w.match_id = cd.match_id AND w.team = cd.team AND w.map = cand
    JOIN n_play oy ON oy.match_id = cd.match_id AND oy.team = cd.opp AND oy.map = cand JOIN n_win ow ON ow.match_id = cd.match_id AND ow.team = cd.opp AND ow.map = cand
    JOIN n_series se ON se.match_id = cd.match_id AND se.team = cd.team JOIN n_pickable sp ON sp.match_id = cd.match_id AND sp.team = cd.team)
, sg1 AS (SELECT *, sum(c_slot) OVER w AS t_slot, sum(c_first) OVER w AS t_first, sum(c_ofirst) OVER w AS t_ofirst, sum(c_ev) OVER w AS t_ev, sum(c_ban) OVER w AS t_ban, sum(c_glob) OVER w AS t_glob FROM sg0 WINDOW w AS (PARTITION BY match_id, team, slot))
, sg AS MATERIALIZED (SELECT match_id, fmt, team, slot, actual, cand, pos, sz, (c_slot + 4.0E0 / sz) / (t_slot + 4) AS slot_p, (c_ev + 4.0E0 / sz) / (t_ev + 4) AS eventual, (c_ban + 7.0E0 / sz) / (t_ban + 7) AS team_ban, (c_glob + 5.0E0 / sz) / (t_glob + 5) AS global_p,
    0.65 * (1 - CASE WHEN c_series > 0 THEN c_play / c_series ELSE 0 END) + 0.35 * (1 - CASE WHEN c_pickable > 0 THEN c_pick / c_pickable ELSE 0 END) AS avoidance, (c_owin + 2.0E0) / (c_oplay + 4) AS threat, 1 - (c_win + 2.0E0) / (c_play + 4) AS own_loss,
    CASE WHEN c_series > 0 THEN c_play / c_series ELSE 0 END AS play, CASE WHEN c_pickable > 0 THEN c_pick / c_pickable ELSE 0 END AS pick, CASE WHEN t_first > 0 THEN c_first / t_first ELSE 0 END AS f_rate, t_first,
    CASE WHEN t_ofirst > 0 THEN c_ofirst / t_ofirst ELSE 0 END AS o_rate, t_ofirst FROM sg1)"""


def signal_sql(body: str) -> str:
    return over("corpus", body=SIGNAL_SQL + " " + body)


_SIG = {"slot": "slot_p", "eventual": "eventual", "team_ban": "team_ban", "global": "global_p", "avoidance": "avoidance", "threat": "threat", "own_loss": "own_loss",
        "raw_first_slot_rate": "f_rate", "opponent_raw_first_slot_rate": "o_rate"}


@query("W16_veto_signals", signal_sql("SELECT match_id, team AS team_id, CAST(slot AS INT) AS team_ban_index, cand AS candidate, " + ", ".join(f"round({v}, 9) AS {k}" for k, v in _SIG.items()) + " FROM sg"))
def veto_signals(t):
    s = signals(t).select("match_id", "team_id", "team_ban_index", F.explode("signals").alias("s"))
    return exact(s.select("match_id", "team_id", "team_ban_index", F.col("s.map_name").alias("candidate"), *[F.col(f"s.{k}").alias(k) for k in _SIG]))


def _model_values(models: dict) -> str:
    cols = [*C.BAN_SIGNALS, "current_like", "lock_probability", "lock_min_sample", "lock_min_rate", "shared_lock_min_rate", "shared_lock_min_sample"]
    rows = ", ".join("(" + ", ".join([q(m), *[f"CAST({w[c]!r} AS DOUBLE)" if c in w else "CAST(NULL AS DOUBLE)" for c in cols]]) + ")" for m, w in models.items())
    return f"(SELECT * FROM (VALUES {rows}) v(model, {', '.join('m_' + c for c in cols)}))"


def scored_sql(models: dict) -> str:
    weighted = " + ".join(f"coalesce(m_{k}, 0) * {_SIG[k]}" for k in C.BAN_SIGNALS)
    return f""", ms AS {_model_values(models)}
, sc0 AS (SELECT sg.*, ms.*, bool_or(play < 0.05 AND pick < 0.01) OVER (PARTITION BY match_id, team, slot, model) AS perma FROM sg CROSS JOIN ms)
, sc1 AS (SELECT *, greatest(CASE WHEN model = 'uniform' THEN 1 WHEN m_current_like > 0 THEN CASE WHEN slot = 1 AND perma THEN CASE WHEN play < 0.05 AND pick < 0.01 THEN threat ELSE 0.0001 END ELSE threat + own_loss END ELSE {weighted} END, 1e-12) AS score FROM sc0)
, sc2 AS (SELECT *, score / sum(score) OVER w AS p0, first_value(cand) OVER (PARTITION BY match_id, team, slot, model ORDER BY f_rate DESC, pos) AS top_map, first_value(f_rate) OVER (PARTITION BY match_id, team, slot, model ORDER BY f_rate DESC, pos) AS top_rate,
    first_value(o_rate) OVER (PARTITION BY match_id, team, slot, model ORDER BY f_rate DESC, pos) AS top_orate FROM sc1 WINDOW w AS (PARTITION BY match_id, team, slot, model))
, sc3 AS (SELECT *, coalesce(m_lock_probability > 0 AND slot = 1 AND t_first >= m_lock_min_sample AND top_rate >= m_lock_min_rate AND NOT coalesce(t_ofirst >= m_shared_lock_min_sample AND top_orate >= m_shared_lock_min_rate, false), false) AS locked FROM sc2)
, sc4 AS (SELECT *, CASE WHEN NOT locked THEN p0 WHEN cand = top_map THEN m_lock_probability ELSE (1 - m_lock_probability) * p0 / sum(CASE WHEN cand <> top_map THEN p0 END) OVER (PARTITION BY match_id, team, slot, model) END AS p FROM sc3)
, rk AS (SELECT *, row_number() OVER (PARTITION BY match_id, team, slot, model ORDER BY round(p, 12) DESC, pos) AS r FROM sc4)
, hit AS (SELECT model, fmt, CASE WHEN slot = 1 THEN 'first_ban' ELSE 'later_ban' END AS sl, greatest(p, 1e-12) AS p, r FROM rk WHERE cand = actual)
, sm AS (SELECT model, coalesce(fmt, 'all') AS format, coalesce(sl, 'all') AS slot, count(*) AS rows, avg(-ln(p)) AS log_loss, avg(CAST(r = 1 AS INT)) AS top1, avg(CAST(r <= 2 AS INT)) AS top2, avg(p) AS mean_actual_prob
    FROM hit GROUP BY GROUPING SETS ((model), (model, fmt, sl)))"""


PRESETS = scored_sql(C.PRESET_BAN_MODELS)


def scores(t: Tables, models: dict = C.PRESET_BAN_MODELS):
    return V.score_models(signals(t), V.model_frame(t.spark, models))


_PROB_COLS = "match_id, team AS team_id, CAST(slot AS INT) AS team_ban_index, model, cand AS candidate"


def _probabilities(df, column: str = "probs"):
    z = F.inline(F.arrays_zip(F.col("pool").alias("candidate"), F.col(column).alias("p")))
    return exact(df.select("match_id", "team_id", "team_ban_index", "model", z))


@query("E9_baseline_models", signal_sql(PRESETS + f" SELECT {_PROB_COLS}, round(p0, 9) AS p FROM sc4 WHERE model IN ('uniform', 'current_like', 'grid_best')"))
def baseline_models(t):
    m = {k: C.PRESET_BAN_MODELS[k] for k in ("uniform", "current_like", "grid_best")}
    return _probabilities(scores(t, m), "base")


@query("W20_normalize_scores", signal_sql(PRESETS + " SELECT match_id, team AS team_id, CAST(slot AS INT) AS team_ban_index, model, round(sum(p0), 9) AS total, count(*) AS candidates FROM sc4 GROUP BY 1, 2, 3, 4"))
def normalize_scores(t):
    s = scores(t)
    return exact(s.select("match_id", "team_id", "team_ban_index", "model", F.aggregate("base", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("base").cast("long").alias("candidates")))


@query("W21_lock_adjustment", signal_sql(PRESETS + f" SELECT {_PROB_COLS}, round(p, 9) AS p FROM sc4 WHERE model IN ('grid_best_locked', 'grid_best_shared_lock')"))
def lock_adjustment(t):
    return _probabilities(scores(t, {k: C.PRESET_BAN_MODELS[k] for k in ("grid_best_locked", "grid_best_shared_lock")}))


@query("J16_model_cross", signal_sql(f", ms AS {_model_values(C.PRESET_BAN_MODELS)} SELECT model, count(*) AS bans FROM cd CROSS JOIN ms WHERE pos = 1 GROUP BY 1"))
def model_cross(t):
    return scores(t).groupBy("model").agg(F.count("*").alias("bans"))


@query("W19_candidate_rank", signal_sql(scored_sql({"uniform": {}}) + " SELECT match_id, team AS team_id, CAST(slot AS INT) AS team_ban_index, round(p, 9) AS actual_prob, CAST(r AS INT) AS rank FROM rk WHERE cand = actual"))
def candidate_rank(t):
    # equal probabilities make the pool-order tie rule decide every rank
    return exact(V.actual_rank(scores(t, {"uniform": {}})).select("match_id", "team_id", "team_ban_index", "actual_prob", "rank"))


_SUMMARY = "model, format, slot, rows, round(log_loss, 9) AS log_loss, round(top1, 9) AS top1, round(top2, 9) AS top2, round(mean_actual_prob, 9) AS mean_actual_prob"


@query("A23_veto_score_summary", signal_sql(PRESETS + " SELECT model, format, slot, rows, round(log_loss, 9) AS log_loss, round(mean_actual_prob, 9) AS mean_actual_prob FROM sm"))
def score_summary(t):
    return exact(V.score_summary(V.actual_rank(scores(t))).drop("top1", "top2"))


@query("E8_veto_backtest", signal_sql(PRESETS + " SELECT model, rows, round(log_loss, 9) AS log_loss, round(mean_actual_prob, 9) AS mean_actual_prob FROM sm WHERE format = 'all'"))
def veto_backtest(t):
    s = V.veto_backtest(persist_table(parsed(t)), V.model_frame(t.spark))
    return exact(s.where(F.col("format") == "all").select("model", "rows", "log_loss", "mean_actual_prob"))


@query("T6_model_ranking", signal_sql(PRESETS + " SELECT model, format, slot, rows, round(log_loss, 9) AS log_loss FROM sm WHERE format <> 'all' AND model IN (SELECT model FROM sm WHERE format = 'all' ORDER BY round(log_loss, 9), model LIMIT 5)"))
def model_ranking(t):
    return exact(V.model_ranking(persist_table(V.veto_backtest(persist_table(parsed(t)), V.model_frame(t.spark)))).select("model", "format", "slot", "rows", "log_loss"))


@query("E7_weight_grid", signal_sql(scored_sql(V.weight_grid()) + " SELECT model, rows, round(log_loss, 9) AS log_loss FROM sm WHERE format = 'all'"))
def weight_grid(t):
    s = V.score_summary(V.actual_rank(scores(t, V.weight_grid())))
    return exact(s.where(F.col("format") == "all").select("model", "rows", "log_loss"))


@query("X30_smoothed_probability", over("forfeit_base", body=""" SELECT team1_id, organizer, round((c + 4.0E0 / 7) / (t + 4), 9) AS smoothed_probability, round((c + 0.5E0 * 4) / (t + 4), 9) AS smoothed_rate, round(c / t, 9) AS raw_rate
    FROM (SELECT team1_id, organizer, CAST(sum(forfeit_target) AS BIGINT) AS c, count(*) AS t FROM forfeit_base GROUP BY 1, 2)"""))
def smoothing(t):
    g = t.view("forfeit_base").groupBy("team1_id", "organizer").agg(F.sum("forfeit_target").alias("c"), F.count("*").alias("t"))
    c, n = F.col("c"), F.col("t")
    return exact(g.select("team1_id", "organizer", V.smoothed_probability(c, n, F.lit(7), 4.0).alias("smoothed_probability"), V.smoothed_rate(c, n, 0.5, 4.0).alias("smoothed_rate"), V.raw_rate(c, n).alias("raw_rate")))


AS_OF = "2000-06-30"
STATS_SQL = f""", d AS (SELECT * FROM maps WHERE date <= DATE '{AS_OF}' AND date >= DATE '{AS_OF}' - 90)
, sd AS (SELECT team_a_id AS team, match_id, map_name, match_format, winner_id = team_a_id AS won, team_a_picked AS picked FROM d UNION ALL SELECT team_b_id, match_id, map_name, match_format, winner_id = team_b_id, team_b_picked FROM d)
, tt AS (SELECT team, count(DISTINCT match_id) AS ts, count(DISTINCT match_id) FILTER (match_format <> 'bo1') AS ps FROM sd GROUP BY 1)
, tm AS (SELECT tt.team, p.map_name, tt.ts, tt.ps, count(sd.match_id) AS n, count(*) FILTER (sd.won) AS w, count(*) FILTER (sd.picked) AS k FROM tt CROSS JOIN (SELECT unnest({_list(C.ACTIVE_POOL)}) AS map_name) p LEFT JOIN sd ON sd.team = tt.team AND sd.map_name = p.map_name GROUP BY ALL)
, st AS (SELECT team, map_name, CASE WHEN n > 0 THEN w / n ELSE 0.5 END AS win_rate, (k + 1) / (ps + 7) AS pick_rate, n / ts AS play_rate, n AS sample, k AS picks, ts, ps FROM tm)"""


@query("A25_team_map_stats", over("maps", body=STATS_SQL + " SELECT team, map_name, round(win_rate, 9) AS win_rate, round(pick_rate, 9) AS pick_rate, round(play_rate, 9) AS play_rate, round(1 - win_rate, 9) AS loss_rate, sample, picks, ts AS total_series, ps AS pickable_series FROM st"))
def team_map_stats(t):
    return exact(V.team_map_stats(t.view("maps"), AS_OF))


HISTORY_SQL = f"""{ERA_SQL}
, bl AS (SELECT ln.match_key, ln.i, ln.team, ln.map, v.fmt, row_number() OVER (PARTITION BY ln.match_key, ln.team ORDER BY i) AS slot FROM ln JOIN vc v USING (match_key)
    WHERE ln.act = 'ban' AND ln.map IS NOT NULL AND v.bad IS NULL AND v.fmt IN ('bo1', 'bo3', 'bo5') AND ln.team IN (v.a, v.b))
, bh AS (SELECT team, 'slot' AS kind, fmt AS match_format, CAST(slot AS INT) AS slot, map AS map_name, count(*) AS n FROM bl GROUP BY ALL
    UNION ALL SELECT team, 'team', NULL, NULL, map, count(*) FROM bl GROUP BY ALL UNION ALL SELECT team, 'eventual', fmt, NULL, map, count(DISTINCT match_key) FROM bl GROUP BY ALL
    UNION ALL SELECT team, 'series', NULL, NULL, NULL, count(DISTINCT match_key) FROM bl GROUP BY ALL)"""


@query("A26_ban_history", over("corpus", body=HISTORY_SQL + f" SELECT * FROM bh WHERE map_name IS NULL OR list_contains({_list(C.ACTIVE_POOL)}, map_name)"))
def ban_history(t):
    return V.ban_history(corpus(t, NOT_VETO))


@query("P21_validate_eras", over("corpus", body=f"""{ERA_SQL}, e2 AS (SELECT r.match_key, r.era, r.pool, r.no FROM (SELECT min(match_key) AS match_key, era, any_value(pool) AS pool, row_number() OVER (ORDER BY min(day)) AS no FROM rp GROUP BY era) r)
    SELECT era AS name, 'needs seven distinct maps' AS violation FROM e2 WHERE len(pool) <> 7 UNION ALL SELECT era, 'first era must be open' FROM e2 WHERE no = 1"""))
def validate_eras(t):
    """Eras as observed in the corpus, each starting with its first contest day."""
    from pyspark.sql import Window

    r = V.resolve_eras(veto_corpus(t, NOT_ERA), V.era_frame(t.spark, ERAS), [])
    seen = r.groupBy(F.col("era.name").alias("name")).agg(F.min("day").alias("start"), F.min("era.maps").alias("maps"))
    seen = seen.withColumn("era_no", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("start", "name")))  # one row per era
    return K.era_violations(seen, list(C.MAP_ALIASES))
