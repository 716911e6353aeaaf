"""Cleaning, classification and forfeit-analysis queries over nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.functions import text as X
from rivalry.operators import clean as K
from rivalry.operators import forfeits as D
from rivalry.plans.feature_queries import rounded
from rivalry.plans.registry import corpus, over, query


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_like(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def any_re(expr: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, {q(p)})" for p in patterns) + ")"


def first_like(expr: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({expr}, {q(w)}) THEN {q(w)}" for w in words) + " END"


BLOB = """, blob AS (SELECT c.*, lower(concat_ws(' ', nullif(event, ''), nullif(format, ''), array_to_string(match_info, ' '),
    coalesce(array_to_string(hltv_vetoes, ' '), ''),
    array_to_string(list_transform(hltv_maps, lambda m: concat_ws(' ', nullif(m.map_name, ''), nullif(m.picker, ''))), ' '))) AS hay FROM corpus c)"""
LINES = """, lines AS (SELECT match_key, i, trim(match_info[i]) AS line, lower(trim(match_info[i])) AS low
    FROM (SELECT match_key, match_info, unnest(range(1, len(match_info) + 1)) AS i FROM corpus))"""
FLAGS = f"""{LINES}, subs AS (SELECT * FROM lines WHERE {any_like('low', C.SUBSTITUTION_KEYWORDS)})
, moves AS (SELECT * FROM lines WHERE {any_like('low', C.TEAM_REPLACEMENT_KEYWORDS)})
, terms AS (SELECT match_key, string_agg(k, ',' ORDER BY k) AS terms FROM (
    SELECT DISTINCT s.match_key, k.k FROM subs s, (SELECT unnest([{', '.join(q(k) for k in C.SUBSTITUTION_REASONS)}]) AS k) k WHERE contains(s.low, k.k)) GROUP BY 1)
, sf AS (SELECT match_key, true AS has_sub, bool_or({any_like('low', ['(coach', ' coach)'])}) AS coach,
    bool_or({any_re('low', C.MID_MAP_PATTERNS)}) AS mid, bool_or({any_re('low', C.MAP_SCOPE_PATTERNS)}) AS scoped,
    string_agg(line, ' | ' ORDER BY i) AS notes FROM subs GROUP BY 1)
, mf AS (SELECT match_key, string_agg(line, ' | ' ORDER BY i) AS notes FROM moves GROUP BY 1)
, flags AS (SELECT c.match_key, coalesce(sf.has_sub, false) AS has_substitution_note, coalesce(sf.coach, false) AS has_coach_standin,
    coalesce(sf.mid, false) AS has_mid_map_sub, coalesce(sf.scoped, false) AS has_map_specific_sub, mf.match_key IS NOT NULL AS has_team_replacement,
    coalesce(t.terms, '') AS substitution_reason_terms, coalesce(sf.notes, '') AS substitution_notes, coalesce(mf.notes, '') AS team_replacement_notes,
    CASE WHEN mf.match_key IS NOT NULL THEN 'team_replacement' WHEN sf.mid THEN 'mid_map_substitution' WHEN sf.coach THEN 'coach_standin'
         WHEN sf.has_sub THEN 'substitution' ELSE 'standard' END AS roster_status
  FROM corpus c LEFT JOIN sf USING (match_key) LEFT JOIN mf USING (match_key) LEFT JOIN terms t USING (match_key))"""
PLAYERS = """, players AS (SELECT match_key, pos, map_name, lower(trim(p.player)) AS player FROM (
      SELECT match_key, pos, hltv_maps[pos].map_name AS map_name, unnest(hltv_maps[pos].player_stats) AS p FROM (
        SELECT match_key, hltv_maps, unnest(range(1, len(hltv_maps) + 1)) AS pos FROM corpus)))
, per_map AS (SELECT match_key, pos, map_name, count(DISTINCT player) AS n FROM players GROUP BY ALL)
, big AS (SELECT match_key, arg_min(CAST(n AS VARCHAR) || ' players recorded on ' || map_name, pos) AS reason FROM per_map WHERE n > 10 GROUP BY 1)
, whole AS (SELECT match_key, count(DISTINCT player) AS n FROM players GROUP BY 1)
, sizes AS (SELECT w.match_key, CASE WHEN b.reason IS NOT NULL THEN b.reason WHEN w.n > 10 THEN CAST(w.n AS VARCHAR) || ' unique players recorded across the series' END AS reason
    FROM whole w LEFT JOIN big b USING (match_key))"""
VETO_REASON = ("CASE WHEN contains(hay, 'randomized') THEN 'randomized' WHEN contains(hay, 'failed to show up') AND "
               "contains(hay, 'veto process') THEN 'failed to show up for the veto process' END")
EXCLUDED = f"""{BLOB} {FLAGS} {PLAYERS}, excl AS (SELECT b.match_key, CASE WHEN {first_like('hay', C.SHOWMATCH_KEYWORDS)} IS NOT NULL THEN 'showmatch'
    WHEN {VETO_REASON} IS NOT NULL THEN 'invalid_veto' WHEN f.roster_status <> 'standard' THEN 'roster_anomaly'
    WHEN s.reason IS NOT NULL THEN 'nonstandard_roster' END AS exclusion
  FROM blob b JOIN flags f USING (match_key) LEFT JOIN sizes s USING (match_key))"""


@query("P6_showmatch_filter", over("corpus", body=f"{BLOB} SELECT match_key, {first_like('hay', C.SHOWMATCH_KEYWORDS)} AS reason FROM blob"))
def showmatch(t):
    c = corpus(t)
    return c.withColumn("hay", K.text_blob(c)).select("match_key", K.showmatch_reason(F.col("hay")).alias("reason"))


@query("P7_invalid_veto_filter", over("corpus", body=f"{BLOB} SELECT match_key, {VETO_REASON} AS reason FROM blob"))
def invalid_veto(t):
    c = corpus(t)
    return c.withColumn("hay", K.text_blob(c)).select("match_key", K.invalid_veto_reason(F.col("hay")).alias("reason"))


@query("P8_roster_flags", over("corpus", body=f"{FLAGS} SELECT * FROM flags"))
def roster_flags(t):
    return K.with_roster_flags(corpus(t)).select("match_key", *K.FLAGS)


@query("P9_roster_size_filter", over("corpus", body=f"{PLAYERS} SELECT match_key, reason FROM sizes"))
def roster_size(t):
    return corpus(t).select("match_key", K.roster_size_reason(F.col("hltv_maps")).alias("reason"))


@query("P10_exclusion_audit", over("corpus", body=f"{EXCLUDED} SELECT coalesce(exclusion, 'kept') AS reason, count(*) AS matches FROM excl GROUP BY 1"))
def exclusion_audit(t):
    return K.exclusion_audit(corpus(t))


def _rank_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR contains(lower({c}), 'unranked') THEN 750 "
            f"ELSE coalesce(TRY_CAST(nullif(regexp_extract({c}, '(\\d+)', 1), '') AS INT), 750) END")


FORMAT = """CASE WHEN regexp_matches(lower(trim({0})), 'bo3|best of 3') THEN 'bo3' WHEN regexp_matches(lower(trim({0})), 'bo5|best of 5') THEN 'bo5'
  WHEN contains(lower({0}), 'def') THEN 'def' WHEN regexp_matches(lower({0}), 'bo1|best of 1') OR lower(trim({0})) IN (""" + ", ".join(
    q(a) for a in C.BO1_ABBREVIATIONS) + """) THEN 'bo1' ELSE 'unknown' END"""
IS_LAN = "coalesce(contains(lower(list_filter(match_info, lambda x: regexp_matches(lower(x), '\\(lan\\)|\\(online\\)'))[1]), '(lan)'), false)"


def _near(x: str, y: str) -> str:
    return f"(contains({x}, {y}) OR contains({y}, {x}))"


MAP_ROWS = f"""{EXCLUDED}
, raw AS (SELECT c.url AS match_id, c.match_key, pos AS map_pos, c.hltv_maps[pos] AS m, upper(trim(team1)) AS a, upper(trim(team2)) AS b,
     c.date, c.team1, c.team2, {FORMAT.format('c.format')} AS match_format, {IS_LAN} AS is_lan, c.ranks
   FROM (SELECT *, unnest(range(1, len(hltv_maps) + 1)) AS pos FROM corpus) c JOIN excl e ON e.match_key = c.match_key AND e.exclusion IS NULL)
, named AS (SELECT *, m.map_name AS map_name, upper(trim(m.team1)) AS t1, upper(trim(m.team2)) AS t2, TRY_CAST(m.team1_score AS INT) AS s1,
     TRY_CAST(m.team2_score AS INT) AS s2, coalesce(upper(trim(m.picker)), '') AS picker FROM raw)
, faced AS (SELECT *, CASE WHEN t1 = b AND t2 = a THEN 'swapped' WHEN t1 = a AND t2 = b THEN 'straight'
     WHEN {_near('t1', 'b')} AND {_near('t2', 'a')} THEN 'swapped' WHEN {_near('t1', 'a')} AND {_near('t2', 'b')} THEN 'straight' END AS facing
   FROM named WHERE map_name <> '' AND lower(map_name) <> 'tbd' AND s1 IS NOT NULL AND s2 IS NOT NULL)
, clean AS (SELECT *, CASE WHEN facing = 'swapped' THEN s2 ELSE s1 END AS score_a, CASE WHEN facing = 'swapped' THEN s1 ELSE s2 END AS score_b,
     list_filter(ranks, lambda r: upper(trim(r.team)) = a)[-1] AS ra, list_filter(ranks, lambda r: upper(trim(r.team)) = b)[-1] AS rb
   FROM faced WHERE facing IS NOT NULL)"""


@query("P1_explode_maps", over("corpus", body=f"{MAP_ROWS} SELECT match_id, CAST(map_pos AS INT) AS map_pos, map_name, CAST(date AS DATE) AS day, "
       "a AS team_a_id, b AS team_b_id, match_format, is_lan FROM clean"))
def explode_maps(t):
    return K.explode_maps(corpus(t)).select("match_id", "map_pos", "map_name", F.to_date("date").alias("day"), "team_a_id",
                                            "team_b_id", "match_format", "is_lan")


@query("P2_orient_scores", over("corpus", body=f"{MAP_ROWS} SELECT match_id, CAST(map_pos AS INT) AS map_pos, score_a, score_b FROM clean"))
def orient_scores(t):
    return K.explode_maps(corpus(t)).select("match_id", "map_pos", "score_a", "score_b")


@query("P3_played_filter", over("corpus", body=f"{MAP_ROWS} SELECT match_key, count(*) AS listed, "
       "count(*) FILTER (map_name <> '' AND lower(map_name) <> 'tbd' AND s1 IS NOT NULL AND s2 IS NOT NULL) AS played FROM named GROUP BY 1"))
def played_filter(t):
    kept = K.with_exclusions(corpus(t)).where(F.col("exclusion").isNull())

    def ok(m):
        s1, s2 = (X.strip(m[c]).try_cast("int") for c in ("team1_score", "team2_score"))
        return K.played_map(m["map_name"], s1, s2)

    return kept.select("match_key", F.size("hltv_maps").cast("long").alias("listed"),
                       F.size(F.filter("hltv_maps", ok)).cast("long").alias("played"))


@query("P4_winner", over("corpus", body=f"{MAP_ROWS} SELECT match_id, CAST(map_pos AS INT) AS map_pos, CASE WHEN score_a > score_b THEN a ELSE b END AS winner_id FROM clean"))
def winner(t):
    return K.explode_maps(corpus(t)).select("match_id", "map_pos", "winner_id")


@query("P5_picker_flags", over("corpus", body=f"{MAP_ROWS} SELECT match_id, CAST(map_pos AS INT) AS map_pos, picker = a AS team_a_picked, "
       "picker = b AND picker <> a AS team_b_picked FROM clean"))
def picker_flags(t):
    return K.explode_maps(corpus(t)).select("match_id", "map_pos", "team_a_picked", "team_b_picked")


def _rank_fields_sql() -> str:
    cols = []
    for s, r in (("a", "ra"), ("b", "rb")):
        blank = f"coalesce(trim({r}.world_rank), '') = ''"
        cols += [f"CASE WHEN {blank} THEN {_rank_sql(r + '.vrs_before_rank')} ELSE {_rank_sql(r + '.world_rank')} END AS team_{s}_world_rank",
                 f"{_rank_sql(r + '.vrs_before_rank')} AS team_{s}_vrs_rank", f"{blank} AS team_{s}_world_rank_missing",
                 f"coalesce(trim({r}.vrs_before_rank), '') = '' AS team_{s}_vrs_rank_missing"]
    return ", ".join(cols)


@query("P20_rank_fields", over("corpus", body=f"{MAP_ROWS} SELECT match_id, CAST(map_pos AS INT) AS map_pos, {_rank_fields_sql()} FROM clean"))
def rank_fields(t):
    cols = [f"team_{s}_{k}" for s in "ab" for k in ("world_rank", "vrs_rank", "world_rank_missing", "vrs_rank_missing")]
    return K.explode_maps(corpus(t)).select("match_id", "map_pos", *cols)


_FORFEIT_CTE = f"""{MAP_ROWS}, ff AS (SELECT DISTINCT match_id FROM clean WHERE lower(map_name) IN ('default', 'forfeit'))
 , fx AS (SELECT c.*, ff.match_id IS NOT NULL AS match_has_forfeit FROM clean c LEFT JOIN ff ON ff.match_id = c.match_id
   WHERE lower(map_name) NOT IN ('default', 'forfeit') AND match_format <> 'def')"""


@query("P11_forfeit_exclusion", over("corpus", body=f"{_FORFEIT_CTE} SELECT match_id, CAST(map_pos AS INT) AS map_pos, map_name, match_has_forfeit FROM fx"))
def forfeit_exclusion(t):
    return K.forfeit_exclusion(K.explode_maps(corpus(t))).select("match_id", "map_pos", "map_name", "match_has_forfeit")


@query("J10_forfeit_series_semi", over("corpus", body=f"{_FORFEIT_CTE} SELECT match_id, count(*) AS maps FROM fx WHERE match_has_forfeit GROUP BY 1"))
def forfeit_series(t):
    out = K.forfeit_exclusion(K.explode_maps(corpus(t))).where("match_has_forfeit")
    return out.groupBy("match_id").agg(F.count("*").alias("maps"))


@query("SNK1_write_clean", over("corpus", body=f"{_FORFEIT_CTE} SELECT match_id, CAST(map_pos AS INT) AS map_pos, map_name, score_a, score_b FROM fx"))
def write_clean(t):
    from rivalry.sources.sinks import write_clean as sink

    clean = K.build_clean_maps(corpus(t))
    return sink(clean, None).select("match_id", "map_pos", "map_name", "score_a", "score_b")


@query("T1_stable_sort", over("corpus", body=f"{MAP_ROWS} SELECT match_id, CAST(map_pos AS INT) AS map_pos, CAST(date AS DATE) AS day FROM clean ORDER BY day, match_id, map_pos"))
def stable_sort(t):
    return K.sorted_maps(K.explode_maps(corpus(t))).select("match_id", "map_pos", F.to_date("date").alias("day"))


@query("A27_freshness", over("corpus", body=""" , m AS (SELECT date, unnest(hltv_maps) AS m FROM corpus)
    SELECT count(*) AS new_maps, count(*) >= 500 AS stale FROM m WHERE CAST(date AS DATE) > DATE '2000-06-30'
      AND trim(m.team1_score) NOT IN ('', '-') AND trim(m.team2_score) NOT IN ('', '-')"""))
def freshness(t):
    return K.freshness(corpus(t), "2000-06-30")


# ---- scalar functions over whole tables -----------------------------------
@query("X1_normalize_name", over("corpus", body=" SELECT match_key, upper(trim(coalesce(team1, ''))) AS a, upper(trim(coalesce(winner, ''))) AS w FROM corpus"))
def normalize_name(t):
    return corpus(t).select("match_key", X.normalize_name(F.col("team1")).alias("a"), X.normalize_name(F.col("winner")).alias("w"))


@query("X2_normalize_team", "SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS name FROM documents")
def normalize_team(t):
    return t.read("documents").select("doc_id", X.normalize_team(F.col("text")).alias("name"))


@query("X3_parse_rank", over("corpus", body=f", r AS (SELECT match_key, unnest(ranks) AS r FROM corpus) SELECT match_key, r.team AS team, {_rank_sql('r.world_rank')} AS world, "
       f"greatest(coalesce(TRY_CAST(r.world_rank AS INT), 750), 1) AS safe FROM r"))
def parse_rank(t):
    r = corpus(t).select("match_key", F.explode("team_ranks").alias("team", "r"))
    return r.select("match_key", "team", X.parse_rank(F.col("r.world_rank")).alias("world"), X.safe_rank(F.col("r.world_rank")).alias("safe"))


@query("X4_normalize_format", over("corpus", body=f" SELECT match_key, {FORMAT.format('format')} AS fmt FROM corpus"))
def normalize_format(t):
    return corpus(t).select("match_key", X.normalize_format(F.col("format")).alias("fmt"))


@query("X5_detect_is_lan", over("corpus", body=f" SELECT match_key, {IS_LAN} AS is_lan FROM corpus"))
def detect_is_lan(t):
    return corpus(t).select("match_key", X.detect_is_lan(F.col("match_info")).alias("is_lan"))


_SHORT = "CASE WHEN {0} THEN {1} END"
_RAW_MAP = {"duck": "CASE match_key % 4 WHEN 0 THEN 'de_' || lower(m.map_name) WHEN 1 THEN ' ' || upper(m.map_name) || ' ' WHEN 2 THEN 'dust ii' ELSE m.map_name END"}


@query("X8_canonical_map", over("corpus", body=f""", m AS (SELECT match_key, unnest(hltv_maps) AS m FROM corpus)
    , al AS (SELECT * FROM (VALUES {', '.join(f'({q(k)}, {q(v)})' for k, v in X.map_alias_rows())}) v(alias, canon))
    SELECT match_key, raw, canon AS map_name FROM (SELECT match_key, {_RAW_MAP['duck']} AS raw FROM m) LEFT JOIN al ON alias = lower(trim(raw))"""))
def canonical_map(t):
    m = corpus(t).select("match_key", F.explode("hltv_maps.map_name").alias("n"))
    k = F.col("match_key") % 4
    raw = (F.when(k == 0, F.concat(F.lit("de_"), F.lower("n"))).when(k == 1, F.concat(F.lit(" "), F.upper("n"), F.lit(" ")))
           .when(k == 2, "dust ii").otherwise(F.col("n")))
    m = m.select("match_key", raw.alias("raw"))
    return m.select("match_key", "raw", X.canonical_map(F.col("raw")).alias("map_name"))


@query("X17_normalize_match_url", """SELECT page_id, CASE WHEN regexp_matches(url, '/matches/\\d+') THEN 'hltv:' || regexp_extract(url, '/matches/(\\d+)', 1)
    ELSE regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '') END AS id FROM pages""")
def normalize_url(t):
    return t.read("pages").select("page_id", X.normalize_url(F.col("url")).alias("id"))


@query("X18_normalize_reasons", over("snapshots", body="""
    , p AS (SELECT id, list_distinct_ordered FROM (SELECT id, list_filter(list_transform(string_split(coalesce(eval_exclusion_reason, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM snapshots)
        , LATERAL (SELECT list_filter(parts, lambda x, i: list_position(parts, x) = i) AS list_distinct_ordered))
    SELECT id, CASE WHEN len(list_distinct_ordered) > 0 THEN array_to_string(list_distinct_ordered, '; ') END AS reasons,
      CASE WHEN list_contains(list_distinct_ordered, 'low sample') THEN array_to_string(list_distinct_ordered, '; ')
           ELSE array_to_string(list_concat(['low sample'], list_distinct_ordered), '; ') END AS marked FROM p"""))
def normalize_reasons(t):
    r = F.col("eval_exclusion_reason")
    return t.view("snapshots").select("id", X.normalize_reasons(r).alias("reasons"), X.prepend_reason(F.lit("low sample"), r).alias("marked"))


@query("S6_ordered_reason_dedupe", over("snapshots", body="""
    , u AS (SELECT id, trim(r) AS r, ord FROM (SELECT id, unnest(string_split(coalesce(eval_exclusion_reason, ''), ';')) AS r, generate_subscripts(string_split(coalesce(eval_exclusion_reason, ''), ';'), 1) AS ord FROM snapshots))
    , f AS (SELECT id, r, min(ord) AS o FROM u WHERE r <> '' GROUP BY 1, 2)
    SELECT s.id, coalesce(string_agg(f.r, '|' ORDER BY f.o), '') AS reasons FROM snapshots s LEFT JOIN f USING (id) GROUP BY 1"""))
def ordered_reasons(t):
    return t.view("snapshots").select("id", F.array_join(X.reason_list(F.col("eval_exclusion_reason")), "|").alias("reasons"))


@query("X19_parse_date", over("corpus", body=""", d AS (SELECT match_key, CASE match_key % 4 WHEN 0 THEN date WHEN 1 THEN date || 'T10:30:00Z' WHEN 2 THEN date || 'T23:15:00+02:00' ELSE 'n/a' END AS raw, date FROM corpus)
    SELECT match_key, strftime(CASE match_key % 4 WHEN 0 THEN CAST(date AS TIMESTAMP) WHEN 1 THEN CAST(date AS TIMESTAMP) + INTERVAL '630 minutes'
      WHEN 2 THEN CAST(date AS TIMESTAMP) + INTERVAL '1275 minutes' END, '%Y-%m-%d %H:%M:%S') AS parsed FROM d"""))
def parse_date(t):
    k = F.col("match_key") % 4
    raw = (F.when(k == 0, F.col("date")).when(k == 1, F.concat("date", F.lit("T10:30:00Z")))
           .when(k == 2, F.concat("date", F.lit("T23:15:00+02:00"))).otherwise("n/a"))
    # the text keeps its own zone; the value is compared as UTC wall time
    return corpus(t).select("match_key", F.date_format(X.parse_date(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("X21_decimal_tokens", """WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(' ' || text || ' ', '([^0-9.])', '\\1\\1', 'g'), '((?:^|[^0-9])[1-9][0-9]?\\.[0-9]{2})\\.', '\\1..', 'g') AS s FROM documents),
    v AS (SELECT doc_id, CAST(unnest(regexp_extract_all(s, '(^|[^0-9])([1-9][0-9]?\\.[0-9]{2})($|[^0-9])', 2)) AS DOUBLE) AS v FROM d)
    SELECT d.doc_id, count(v.v) AS n, round(coalesce(sum(v.v), 0), 6) AS total FROM d LEFT JOIN v ON v.doc_id = d.doc_id AND v.v BETWEEN 1.01 AND 100 GROUP BY 1""")
def decimal_tokens(t):
    d = t.read("documents").select("doc_id", X.decimal_tokens(F.col("text")).alias("v"))
    return rounded(d.select("doc_id", F.size("v").cast("long").alias("n"),
                            F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x).alias("total")))


@query("X25_slugify_alias_key", f"""WITH w AS (SELECT page_id, url, string_split_regex(regexp_replace(upper(url), '[^A-Z0-9\\s]', '', 'g'), '\\s+') AS words FROM pages)
    SELECT page_id, coalesce(nullif(regexp_replace(trim(regexp_replace(lower(url), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_'), '_{{2,}}', '_', 'g'), ''), 'feature_experiment') AS slug,
      array_to_string(list_filter(words, lambda x: x <> '' AND x NOT IN ({', '.join(q(w) for w in C.TEAM_NOISE_WORDS)})), '') AS key FROM w""")
def slugify(t):
    return t.read("pages").select("page_id", X.slugify(F.col("url")).alias("slug"), X.alias_key(F.col("url")).alias("key"))


@query("X27_fill_defaults", over("forfeit_base", body=""" SELECT match_id, coalesce(nullif(organizer, 'CCT'), 'Unknown') AS organizer, coalesce(nullif(region, 'CIS'), 'Unknown') AS region,
    coalesce(nullif(is_lan, false), false) AS is_lan FROM forfeit_base"""))
def fill_defaults(t):
    gaps = t.view("forfeit_base").select("match_id", F.nullif("organizer", F.lit("CCT")).alias("organizer"),
                                         F.nullif("region", F.lit("CIS")).alias("region"), F.nullif("is_lan", F.lit(False)).alias("is_lan"))
    return gaps.select("match_id", F.coalesce("organizer", F.lit("Unknown")).alias("organizer"),
                       F.coalesce("region", F.lit("Unknown")).alias("region"), F.coalesce("is_lan", F.lit(False)).alias("is_lan"))


@query("X28_plus_minus", over("maps", body=" SELECT match_id, map_pos, CAST(score_a - score_b AS INT) AS plus_minus FROM maps"))
def plus_minus(t):
    text = F.concat(F.col("score_a").cast("string"), F.lit(" - "), F.col("score_b").cast("string"))
    return t.view("maps").select("match_id", "map_pos", X.plus_minus(text).alias("plus_minus"))


@query("X29_picker_from_veto", over("corpus", body=""", m AS (SELECT match_key, hltv_vetoes, m.map_name AS map_name, pos FROM (SELECT match_key, hltv_vetoes, unnest(hltv_maps) AS m, generate_subscripts(hltv_maps, 1) AS pos FROM corpus))
    SELECT match_key, CAST(pos AS BIGINT) AS pos, trim(regexp_replace(string_split(list_filter(hltv_vetoes, lambda x: contains(lower(x), 'picked') AND contains(lower(x), lower(map_name)))[-1], 'picked')[1], '^\\d+\\.\\s*', '')) AS picker FROM m"""))
def picker_from_veto(t):
    m = corpus(t).select("match_key", "hltv_vetoes", F.posexplode("hltv_maps.map_name").alias("pos", "map_name"))
    return m.select("match_key", (F.col("pos") + 1).cast("long").alias("pos"), X.picker_from_veto(F.col("hltv_vetoes"), F.col("map_name")).alias("picker"))


@query("X24_content_hash", """SELECT doc_id, substr(sha256('["' || lang || '","' || source || '"]'), 1, 16) AS hash FROM documents""")
def content_hash(t):
    return t.read("documents").select("doc_id", X.content_hash(F.array("lang", "source")).alias("hash"))


@query("X23_best_of", over("corpus", body=f""" SELECT match_key, CASE WHEN contains(f, 'bo5') THEN 5 WHEN contains(f, 'bo3') THEN 3 WHEN contains(f, 'bo1') THEN 1 ELSE 0 END AS best_of,
    CASE g WHEN 'bo1' THEN 1 WHEN 'bo3' THEN 2 WHEN 'bo5' THEN 3 END AS required_wins FROM (SELECT *, CASE WHEN f = 'unknown' AND len(match_info) > 0 THEN {FORMAT.format("array_to_string(match_info, ' ')")} ELSE f END AS g
    FROM (SELECT match_key, match_info, {FORMAT.format('format')} AS f FROM corpus))"""))
def best_of(t):
    c = corpus(t)
    return c.select("match_key", X.best_of(X.normalize_format(F.col("format"))).alias("best_of"),
                    X.required_wins(F.col("format"), F.col("match_info")).alias("required_wins"))


# ---- forfeit analysis -----------------------------------------------------
def _organizer_sql(e: str) -> str:
    arms = " ".join(f"WHEN starts_with(lower({e}), {q(p.lower())}) THEN {q(p)}" for p in C.ORGANIZER_PREFIXES)
    return (f"CASE {arms} ELSE coalesce(nullif(trim(regexp_extract({e}, '^(.*?)({C.EVENT_FAMILY_SUFFIX}|$)', 1), ' :-'), ''), {e}) END")


def _region_sql() -> str:
    hay = "(' ' || lower(event) || '  ' || lower(array_to_string(match_info, ' ')) || ' ')"
    arms = " ".join(f"WHEN {any_like(hay, words)} THEN {q(r)}" for r, words in C.REGION_KEYWORDS)
    return f"CASE {arms} WHEN {IS_LAN} THEN 'LAN/International' ELSE 'Unknown' END"


def _reason_sql(low: str, notes: str) -> str:
    arms = " ".join(f"WHEN {any_like(low, words)} THEN {q(label)}" for label, words in C.REASON_RULES)
    return f"CASE {arms} WHEN len({notes}) > 0 THEN 'other stated reason' ELSE 'default map only' END"


def _bucket_sql(r: str) -> str:
    return "CASE " + " ".join(f"WHEN {r} <= {top} THEN {q(label)}" for top, label in C.RANK_BUCKETS) + \
        f" WHEN {r} < 750 THEN '201+' ELSE 'Unranked/unknown' END"


def _side_rank_sql(team: str) -> str:
    return (f"CASE WHEN {team} IS NULL OR {team} = '' THEN 750 ELSE {_rank_sql(f'list_filter(ranks, lambda r: lower(trim(r.team)) = lower({team}))[1].world_rank')} END")


_NAMED = " ".join(
    f"WHEN len(list_filter(notes, lambda n: lower(trim(regexp_extract(n, {q('(?i)' + p)}, 1), ' *.')) = lower(trim({t})))) > 0 THEN trim({t})"
    for p in C.FORFEIT_TEAM_PATTERNS for t in ("team1", "team2"))
FORFEITS = f""", n0 AS (SELECT *, list_filter(list_transform(match_info, lambda x: trim(x)), lambda x: {any_re('lower(x)', C.FORFEIT_TEXT_PATTERNS)}) AS notes,
     list_filter(hltv_maps, lambda m: lower(trim(m.map_name)) IN ('default', 'forfeit')) AS dmaps, {FORMAT.format('format')} AS fmt FROM corpus)
, n1 AS (SELECT *, CASE WHEN len(list_filter(dmaps, lambda m: m.team1_score || m.team2_score IN ('01', '10'))) > 0
      THEN CASE WHEN len(list_filter(dmaps, lambda m: m.team1_score || m.team2_score = '01')) >= len(list_filter(dmaps, lambda m: m.team1_score || m.team2_score = '10')) THEN trim(team1) ELSE trim(team2) END
      ELSE CASE {_NAMED} WHEN contains(lower(array_to_string(notes, ' ')), lower(trim(team1))) THEN trim(team1)
        WHEN contains(lower(array_to_string(notes, ' ')), lower(trim(team2))) THEN trim(team2) END END AS ft,
    CASE WHEN len(list_filter(dmaps, lambda m: m.team1_score || m.team2_score = '01')) > 0 THEN trim(team2)
         WHEN len(list_filter(dmaps, lambda m: m.team1_score || m.team2_score = '10')) > 0 THEN trim(team1) END AS dw FROM n0)
, n2 AS (SELECT *, CASE WHEN ft IS NOT NULL THEN CASE WHEN lower(ft) = lower(trim(team1)) THEN trim(team2) ELSE trim(team1) END END AS opp FROM n1)
, fr AS (SELECT CAST(date AS DATE) AS date, url, event, {_organizer_sql('event')} AS organizer, {_region_sql()} AS region, {IS_LAN} AS is_lan, fmt AS format,
    trim(team1) AS team1, trim(team2) AS team2, {_side_rank_sql('trim(team1)')} AS team1_rank, {_side_rank_sql('trim(team2)')} AS team2_rank,
    fmt = 'def' OR len(dmaps) > 0 OR len(notes) > 0 AS has_forfeit, fmt = 'def' AS is_full_default, len(dmaps) > 0 AND fmt <> 'def' AS has_partial_default_map,
    CAST(len(dmaps) AS INT) AS default_map_count, coalesce(ft, 'Unknown') AS forfeit_team, coalesce(dw, 'Unknown') AS default_winner,
    {_side_rank_sql('ft')} AS forfeit_team_rank, {_side_rank_sql('opp')} AS opponent_rank, {_reason_sql("lower(array_to_string(notes, ' '))", 'notes')} AS reason,
    array_to_string(notes, ' | ') AS notes FROM n2)
, f AS (SELECT *, {_bucket_sql('forfeit_team_rank')} AS forfeit_rank_bucket, CASE WHEN forfeit_team_rank = 750 AND opponent_rank = 750 THEN 'unknown'
    WHEN forfeit_team_rank < opponent_rank THEN 'higher-ranked forfeit' WHEN forfeit_team_rank > opponent_rank THEN 'lower-ranked forfeit' ELSE 'same rank' END AS rank_side FROM fr)"""


def _forfeits(body: str) -> str:
    return over("corpus", body=FORFEITS + " " + body)


@query("X6_forfeit_notes", _forfeits("SELECT url, organizer, region, forfeit_rank_bucket, rank_side, reason, notes FROM f"))
def forfeit_notes(t):
    return D.forfeit_rows(corpus(t)).select("url", "organizer", "region", "forfeit_rank_bucket", "rank_side", "reason", "notes")


@query("A32_forfeit_team_mode", _forfeits("SELECT * FROM f"))
def forfeit_team_mode(t):
    return D.forfeit_rows(corpus(t))


@query("A2_rate_table", _forfeits("""SELECT organizer, count(*) AS matches, CAST(sum(CAST(has_forfeit AS INT)) AS BIGINT) AS forfeits,
    round(sum(CAST(has_forfeit AS INT)) / count(*), 6) AS forfeit_rate FROM f GROUP BY 1 HAVING count(*) >= 5 ORDER BY 4 DESC, 3 DESC, 2 DESC, 1 LIMIT 20"""))
def rate_table(t):
    return rounded(D.rate_table(D.forfeit_rows(corpus(t)), "organizer", min_matches=5))


@query("A3_team_rate_table", _forfeits(""", s AS (SELECT team1 AS team, has_forfeit, forfeit_team FROM f UNION ALL SELECT team2, has_forfeit, forfeit_team FROM f)
    SELECT team, count(*) AS matches, count(*) FILTER (has_forfeit AND lower(team) = lower(forfeit_team)) AS team_forfeits,
      round(count(*) FILTER (has_forfeit AND lower(team) = lower(forfeit_team)) / count(*), 6) AS team_forfeit_rate FROM s GROUP BY 1 HAVING count(*) >= 3
    ORDER BY 4 DESC, 3 DESC, 2 DESC, 1"""))
def team_rate_table(t):
    return rounded(D.team_rate_table(D.forfeit_rows(corpus(t)), min_matches=3, limit=None))


@query("A4_period_trend", over("event_rows", body=""" SELECT CAST(date_trunc('week', date) AS DATE) AS period_start, count(*) AS matches, CAST(sum(forfeit_target) AS BIGINT) AS forfeits,
    round(avg(forfeit_target), 6) AS forfeit_rate FROM event_rows GROUP BY 1"""))
def period_trend(t):
    return rounded(D.period_trend(t.view("event_rows"), "week", "forfeit_target"))


@query("A5_trend_regression", _forfeits(""", g AS (SELECT CAST(date_trunc('month', date) AS DATE) AS period_start, avg(CAST(has_forfeit AS INT)) AS rate FROM f GROUP BY 1)
    , p AS (SELECT *, date_diff('day', (SELECT min(period_start) FROM g), period_start) AS x FROM g)
    SELECT count(*) AS buckets, round(regr_slope(rate, x), 9) AS slope, round(regr_intercept(rate, x), 6) AS intercept, round(regr_r2(rate, x), 6) AS r2,
      min(period_start) AS "start", max(period_start) AS "end" FROM p"""))
def trend_regression(t):
    r = D.trend_regression(D.period_trend(D.forfeit_rows(corpus(t)), "month"))
    return r.select("buckets", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"), "start", "end")


# the density of Student's t, integrated by Simpson's rule
@query("X12_ttest_p", _forfeits(""", g AS (SELECT CAST(date_trunc('month', date) AS DATE) AS period_start, avg(CAST(has_forfeit AS INT)) AS rate FROM f GROUP BY 1)
    , p AS (SELECT *, date_diff('day', (SELECT min(period_start) FROM g), period_start) AS x FROM g)
    , r AS (SELECT count(*) AS buckets, count(*) - 2.0E0 AS v, regr_r2(rate, x) AS r2 FROM p HAVING count(*) >= 3)
    , t AS (SELECT *, sqrt(r2 * v / (1 - r2)) AS t, exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) AS c FROM r)
    , i AS (SELECT buckets, t, sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * c * pow(1 + pow(k * t / 4000, 2) / v, -(v + 1) / 2)) * t / 12000 AS half
            FROM t, (SELECT unnest(range(0, 4001)) AS k) GROUP BY 1, 2)
    SELECT buckets, round(1 - 2 * half, 6) AS p_value, 1 - 2 * half < 0.05 AS significant FROM i"""))
def trend_p_value(t):
    r = D.trend_regression(D.period_trend(D.forfeit_rows(corpus(t)), "month"))
    return r.select("buckets", F.round("p_value", 6).alias("p_value"), "significant")


@query("A6_share_table", _forfeits("SELECT forfeit_rank_bucket, count(*) AS forfeits, round(count(*) / (SELECT count(*) FROM f WHERE has_forfeit), 6) AS share FROM f WHERE has_forfeit GROUP BY 1"))
def share_table(t):
    return rounded(D.share_table(D.forfeit_rows(corpus(t)).where("has_forfeit"), "forfeit_rank_bucket"))


@query("A7_headline_counts", _forfeits("""SELECT count(*) AS matches, count(*) FILTER (has_forfeit) AS forfeits, count(*) FILTER (is_full_default) AS full_defaults,
    count(*) FILTER (has_partial_default_map) AS partial_defaults, CAST(sum(default_map_count) AS BIGINT) AS default_maps, count(*) FILTER (NOT is_lan) AS online,
    count(*) FILTER (has_forfeit AND NOT is_lan) AS online_forfeits, count(*) FILTER (is_lan) AS lan, count(*) FILTER (has_forfeit AND is_lan) AS lan_forfeits,
    round(count(*) FILTER (has_forfeit AND NOT is_lan) / count(*) FILTER (NOT is_lan), 6) AS online_rate,
    round(count(*) FILTER (has_forfeit AND is_lan) / count(*) FILTER (is_lan), 6) AS lan_rate FROM f"""))
def headline_counts(t):
    return rounded(D.headline_counts(D.forfeit_rows(corpus(t))))


@query("T5_recent_forfeits", _forfeits("SELECT date, url, forfeit_team, default_winner, event, region, format, reason, notes FROM f WHERE has_forfeit ORDER BY date DESC, url LIMIT 20"))
def recent_forfeits(t):
    return D.recent_forfeits(D.forfeit_rows(corpus(t, without=("hltv_vetoes",))), 20)


@query("S3_keep_last_by_match", _forfeits("""SELECT url AS match_id, upper(team1) AS team1_id, upper(team2) AS team2_id, CASE WHEN format = 'def' THEN 'bo3' ELSE format END AS match_format,
    CAST(has_forfeit AS INT) AS forfeit_target FROM f WHERE url NOT IN (SELECT url FROM (SELECT *, lower(concat_ws(' ', event, format, array_to_string(match_info, ' '), array_to_string(hltv_vetoes, ' '))) AS hay FROM corpus)
      WHERE """ + any_like("hay", C.SHOWMATCH_KEYWORDS) + " OR " + any_re("hay", C.NONSTANDARD_PATTERNS) + ")"))
def keep_last(t):
    return D.forfeit_base(corpus(t)).select("match_id", "team1_id", "team2_id", "match_format", "forfeit_target")


@query("A21_grouped_rate_summary", over("forfeit_base", body=""" SELECT organizer AS value, count(*) AS matches, CAST(sum(forfeit_target) AS BIGINT) AS forfeit_matches,
    round(avg(forfeit_target), 6) AS forfeit_rate FROM forfeit_base GROUP BY 1 ORDER BY 2 DESC, 4 DESC, 1 LIMIT 12"""))
def grouped_rate_summary(t):
    return rounded(D.grouped_rate_summary(t.view("forfeit_base"), "organizer"))
