"""Contest views over the star-schema tables, as SQL that two engines can run.

Every view is plain SQL text over the base tables. ``Dialect`` supplies the few
spellings that differ (array and struct literals, lambdas), so the same view text
feeds the Spark queries and the independent SQL checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from rivalry import constants as C


@dataclass(frozen=True)
class Dialect:
    name: str
    folder: str | None = None
    #: Tasks that nested records are built in; a small table is one file, hence one task, otherwise.
    tasks: int | None = None
    #: Nested records hold the players of every map.
    players: bool = True

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def table(self, name: str) -> str:
        return f"parquet.`{self.folder}/{name}.parquet`" if self.spark else name

    def array(self, *items: str) -> str:
        body = ", ".join(items)
        return f"array({body})" if self.spark else f"[{body}]"

    def compact(self, array: str) -> str:
        if self.spark:
            return f"filter({array}, x -> x IS NOT NULL)"
        return f"list_filter({array}, lambda x: x IS NOT NULL)"

    def struct(self, **fields: str) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def spread(self, source: str, **parts: tuple[str, ...]) -> str:
        """``source`` dealt out over ``tasks``; only the columns named per alias are moved."""
        if not self.tasks:
            return source
        structs = ", ".join(f"{self.struct(**{c: f'{a}.{c}' for c in columns})} AS {a}" for a, columns in parts.items())
        return f"(SELECT /*+ REPARTITION({self.tasks}) */ {structs} FROM {source}) spread"

    def explode_range(self, n: str, alias: str) -> str:
        """Lateral clause that yields 1..n as ``alias``."""
        if self.spark:
            return f"LATERAL VIEW explode(sequence(1L, CAST({n} AS BIGINT))) g_{alias} AS {alias}"
        return f", LATERAL (SELECT unnest(range(1, {n} + 1)) AS {alias}) g_{alias}"

    def at(self, items: list[str], index: str) -> str:
        """Element of a fixed text list by 0-based index."""
        arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(items))
        return f"CASE {index} {arms} END"


DUCK = Dialect("duckdb")


def _series(d: Dialect) -> str:
    return f"""
    SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS date,
           o_custkey % n AS team_a_id,
           (o_custkey % n + 1 + o_orderkey % (n - 1)) % n AS team_b_id,
           CASE o_orderkey % 4 WHEN 0 THEN 'bo1' WHEN 3 THEN 'bo5' ELSE 'bo3' END AS match_format,
           o_orderpriority = '1-URGENT' AS is_lan,
           o_orderpriority AS event,
           (o_orderstatus = 'P' AND o_orderkey % 10 = 0) AS match_has_forfeit
    FROM {d.table('orders')} CROSS JOIN (SELECT count(*) AS n FROM {d.table('supplier')}) teams"""


def _rank(side: str, source: str) -> str:
    a, b = ("5", "11") if source == "world" else ("7", "13")
    shift = "1" if side == "a" else "4"
    mult = "37" if source == "world" else "41"
    return (
        f"CASE WHEN (s.match_id + {shift}) % {a} = 0 OR (s.match_id + {shift}) % {b} = 0 THEN {C.UNRANKED} "
        f"ELSE 1 + (s.team_{side}_id * {mult} + extract(MONTH FROM s.date) * 3 + s.match_id % 2) % 250 END"
    )


def _missing(side: str, source: str) -> str:
    a = "5" if source == "world" else "7"
    shift = "1" if side == "a" else "4"
    return f"(s.match_id + {shift}) % {a} = 0"


def _maps(d: Dialect) -> str:
    ranks = ", ".join(
        f"CAST({_rank(s, src)} AS INT) AS team_{s}_{src}_rank, {_missing(s, src)} AS team_{s}_{src}_rank_missing"
        for s in "ab" for src in ("world", "vrs")
    )
    return f"""
    SELECT s.match_id, l.map_pos, s.date, s.team_a_id, s.team_b_id, s.match_format, s.is_lan, s.event,
           s.match_has_forfeit,
           {d.at(C.ACTIVE_POOL, 'l.pk % 7')} AS map_name,
           l.score_a, l.score_b,
           CASE WHEN l.score_a > l.score_b THEN s.team_a_id ELSE s.team_b_id END AS winner_id,
           (s.match_id + l.map_pos) % 3 = 0 AS team_a_picked,
           (s.match_id + l.map_pos) % 3 = 1 AS team_b_picked,
           {ranks}
    FROM series s JOIN (
        SELECT l_orderkey AS match_id, CAST(l_linenumber AS BIGINT) AS map_pos,
               min(l_partkey) AS pk, CAST(floor(min(l_quantity)) AS BIGINT) AS score_a,
               1 + min(l_partkey * 7 + l_suppkey) % 50 AS score_b
        FROM {d.table('lineitem')} GROUP BY l_orderkey, l_linenumber) l ON l.match_id = s.match_id"""


# -- nested corpus: every record is derived from one order row, no shuffle ----
_EVENTS = [
    "ESL Pro League Season 9", "BLAST Premier Europe", "CCT South America Series 2", "Winter Cup Asia",
    "Regional Open Oceania", "Streamer Showdown", "IEM Katowice", "Northern Masters",
]
_K = "o.o_orderkey"


def _corpus_lines() -> list[str]:
    """Candidate info lines; a NULL line is left out of the array."""
    k = _K
    return [
        f"CASE WHEN {k} % 3 = 0 THEN 'Best of 3 (LAN)' WHEN {k} % 3 = 1 THEN 'Best of 3 (Online)' END",
        f"CASE WHEN {k} % 13 = 0 THEN concat('** ', t.t1, ' forfeited the match due to a scheduling conflict') "
        f"WHEN {k} % 29 = 0 THEN 'One side was unable to field an eligible roster' "
        f"WHEN {k} % 31 = 0 THEN concat('** ', t.t2, ' failed to show up for the veto process') END",
        f"CASE WHEN {k} % 17 = 0 THEN concat(t.t1, ' used substitute Neo (coach) due to visa and medical issues') "
        f"WHEN {k} % 19 = 0 THEN concat(t.t2, ' used a stand-in during map 2 after a technical emergency') "
        f"WHEN {k} % 23 = 0 THEN 'Old side withdrawn, replaced by academy' END",
        f"CASE WHEN {k} % 37 = 0 THEN 'Vetoes were randomized' WHEN {k} % 41 = 0 THEN 'charity match' END",
    ]


def _corpus_format() -> str:
    k = _K
    return (f"CASE {k} % 11 WHEN 0 THEN 'mrg' WHEN 1 THEN 'bo5' WHEN 2 THEN 'def' WHEN 3 THEN 'Best of 1' "
            f"WHEN 4 THEN 'exhibition' ELSE 'bo3' END")


def _veto_lines(d: Dialect) -> list[str]:
    """Seven veto lines whose order over the pool depends on the order key."""
    k = _K
    lines = []
    for i in range(7):
        # a step of 1, 2 or 3 is coprime with 7, so every map is named exactly once
        name = d.at(C.POOL_OVERPASS, f"({k} + {i} * (1 + o.o_custkey % 3)) % 7")
        team = f"CASE WHEN ({k} + {i}) % 2 = 0 THEN t.t1 ELSE t.t2 END"
        if i == 6:
            lines.append(f"concat('7. ', {name}, ' was left over')")
        else:
            verb = ("CASE WHEN " + f"{k} % 11 IN (0, 3)" + " THEN ' removed '" +
                    (" ELSE ' picked ' END" if i in (2, 3) else " ELSE ' removed ' END"))
            text = f"concat('{i + 1}. ', {team}, {verb}, {name})"
            if i == 1:
                text = f"CASE WHEN {k} % 43 = 0 THEN concat('2. Somebody Else removed ', {name}) ELSE {text} END"
            lines.append(text)
    return lines


def _map_struct(d: Dialect, pos: int) -> str:
    k = _K
    name = d.at(C.POOL_OVERPASS, f"({k} + {pos} * (1 + o.o_custkey % 3)) % 7")
    if pos == 2:
        name = f"CASE WHEN {k} % 13 = 0 THEN 'Default' WHEN {k} % 5 = 0 THEN 'TBD' ELSE {name} END"
    played = f"CASE WHEN {k} % 5 = 0 AND {pos} = 2 THEN '-' ELSE "
    s1 = f"CAST(({k} * 7 + {pos} * 3) % 14 AS VARCHAR(9))" if not d.spark else f"CAST(({k} * 7 + {pos} * 3) % 14 AS STRING)"
    s2 = s1.replace("* 7", "* 11").replace("* 3", "* 5")
    if pos == 2:
        s1 = f"CASE WHEN {k} % 13 = 0 THEN '0' ELSE {s1} END"
        s2 = f"CASE WHEN {k} % 13 = 0 THEN '1' ELSE {s2} END"
    swap = f"{k} % 6 = 0"
    team1 = f"CASE WHEN {swap} THEN t.t2 WHEN {k} % 47 = 0 THEN concat(t.t1, ' Academy') ELSE t.t1 END"
    team2 = f"CASE WHEN {swap} THEN t.t1 WHEN {k} % 53 = 0 THEN 'Nobody' ELSE t.t2 END"
    picker = f"CASE WHEN ({k} + {pos}) % 3 = 0 THEN upper(t.t1) WHEN ({k} + {pos}) % 3 = 1 THEN t.t2 END"
    players = d.array(*[
        d.struct(player=f"concat('P', CAST((o.o_custkey + {j} + CASE WHEN {k} % 59 = 0 THEN {pos} ELSE 0 END) AS "
                 + ("STRING" if d.spark else "VARCHAR") + "))")
        for j in range(10)])
    extra = d.array(*([d.struct(player="'Eleventh'")]))
    players = (f"CASE WHEN {k} % 61 = 0 AND {pos} = 1 THEN "
               + (f"concat({players}, {extra})" if d.spark else f"list_concat({players}, {extra})")
               + f" ELSE {players} END")
    named = {"player_stats": players} if d.players else {}
    return d.struct(map_name=name, team1=team1, team1_score=f"{played}{s1} END", team2=team2,
                    team2_score=f"{played}{s2} END", picker=picker, **named)


def _corpus(d: Dialect) -> str:
    k = _K
    text = "STRING" if d.spark else "VARCHAR"
    maps = d.array(*[_map_struct(d, p) for p in range(3)])
    n_maps = f"CASE WHEN {k} % 11 IN (0, 3) THEN 1 ELSE 3 END"
    maps = (f"slice({maps}, 1, {n_maps})" if d.spark else f"({maps})[1:{n_maps}]")
    rank = (lambda t, s: f"CASE WHEN ({k} + {s}) % 5 = 0 THEN NULL WHEN ({k} + {s}) % 7 = 0 THEN 'Unranked' "
            f"ELSE concat('#', CAST(1 + (o.o_custkey * 3 + {k} * {t}) % 120 AS {text})) END")
    ranks = d.array(
        d.struct(team="t.t1", world_rank=rank(1, 0), vrs_before_rank=rank(2, 1)),
        d.struct(team="upper(t.t2)", world_rank=rank(3, 2), vrs_before_rank=rank(4, 3)))
    source = f"""{d.table('orders')} o JOIN (
        SELECT match_id, concat('Team ', CAST(team_a_id AS {text})) AS t1,
               concat('Squad ', CAST(team_b_id AS {text})) AS t2 FROM series) t ON t.match_id = o.o_orderkey"""
    return f"""
    SELECT {k} AS match_key,
           concat('https://site.example/matches/', CAST({k} AS {text}), '/', replace(lower(t.t1), ' ', '-'), '?x=1') AS url,
           CAST(CAST(o.o_orderdate AS DATE) AS {text}) AS date,
           {d.at(_EVENTS, f'(o.o_custkey + {k}) % 8')} AS event,
           {_corpus_format()} AS format, t.t1 AS team1, t.t2 AS team2,
           CASE WHEN {k} % 7 = 0 THEN t.t1 END AS winner,
           {d.compact(d.array(*_corpus_lines()))} AS match_info,
           CASE WHEN {k} % 17 = 5 THEN {d.compact(d.array(f'CAST(NULL AS {text})'))}
                ELSE {d.array(*_veto_lines(d))} END AS hltv_vetoes,
           {ranks} AS ranks,
           {maps} AS hltv_maps
    FROM {d.spread(source, o=("o_orderkey", "o_custkey", "o_orderdate"), t=("t1", "t2"))}"""


def _ledger_matches(d: Dialect) -> str:
    text = "STRING" if d.spark else "VARCHAR"
    return f"""
    SELECT match_id AS match_url, concat('Team ', CAST(team_a_id AS {text})) AS team_a,
           concat('Team ', CAST(team_b_id AS {text})) AS team_b, match_format AS format,
           CAST(date AS {text}) AS match_date,
           concat(CASE WHEN match_id % 24 < 10 THEN '0' ELSE '' END, CAST(match_id % 24 AS {text}), ':30') AS match_time,
           date,
           CASE WHEN match_id % 9 = 0 THEN 'Pending' WHEN match_id % 23 = 0 THEN 'forfeit'
                WHEN match_id % 29 = 0 THEN 'unknown:Other'
                WHEN (match_id * 13 + 5) % 10 < 6 THEN 'team_a' ELSE 'team_b' END AS result
    FROM series"""


def _snapshots(d: Dialect) -> str:
    text = "STRING" if d.spark else "VARCHAR"
    return f"""
    SELECT q.*, 1.0E0 / odds_a AS implied_prob_a, 1.0E0 / odds_b AS implied_prob_b,
           CASE WHEN odds_a IS NOT NULL THEN 100 * model_prob_a - 100 / odds_a END AS edge_a,
           CASE WHEN odds_b IS NOT NULL THEN 100 * (1 - model_prob_a) - 100 / odds_b END AS edge_b
    FROM (
      SELECT match_id * 3 + n AS id, match_id AS match_url, concat('v', CAST(match_id % 5 AS {text})) AS version_id,
             date, n,
             CAST((match_id * 37 + n * 11) % 101 AS DOUBLE) / 101 AS model_prob_a,
             CASE WHEN match_id % 12 = 0 THEN NULL ELSE 1.05E0 + CAST((match_id * 53 + n * 7) % 400 AS DOUBLE) / 100 END AS odds_a,
             CASE WHEN match_id % 12 = 0 THEN NULL ELSE 1.05E0 + CAST((match_id * 71 + n * 3) % 400 AS DOUBLE) / 100 END AS odds_b,
             CASE WHEN match_id % 8 = 0 THEN 0 ELSE 1 END AS valid_for_eval,
             CASE WHEN match_id % 16 = 0 THEN 'low sample; roster anomaly: substitution;low sample'
                  WHEN match_id % 8 = 0 THEN ' ' END AS eval_exclusion_reason,
             CASE WHEN match_id % 6 = 1 THEN
               concat('{{"odds_a_median": ', CAST(1 + match_id % 4 AS {text}), '.5, "odds_b_median": ', CAST(1 + match_id % 3 AS {text}), '.25}}')
             END AS odds_summary_json
      FROM series {d.explode_range('3', 'n')}) q"""


def _book_odds(d: Dialect) -> str:
    text = "STRING" if d.spark else "VARCHAR"
    return f"""
    SELECT id AS snapshot_id, match_url, concat('Book', CAST(b % 3 AS {text})) AS bookmaker,
           CASE WHEN (id + b) % 7 = 0 THEN NULL ELSE 1.1E0 + CAST((id * 17 + b * 29) % 300 AS DOUBLE) / 100 END AS odds_a,
           CASE WHEN (id + b) % 11 = 0 THEN NULL ELSE 1.1E0 + CAST((id * 19 + b * 31) % 300 AS DOUBLE) / 100 END AS odds_b, b
    FROM snapshots {d.explode_range('4', 'b')}"""


def _versions(d: Dialect) -> str:
    text = "STRING" if d.spark else "VARCHAR"
    return f"""
    SELECT concat('v', CAST(s_suppkey % 50 AS {text})) AS version_id, max(s_suppkey) AS trained_at,
           CAST(max(s_acctbal) AS DOUBLE) / 10007 AS test_brier_score, CAST(min(s_acctbal) AS DOUBLE) / 10007 AS test_log_loss,
           concat('{{"total_maps": ', CAST(max(s_suppkey) * 10 AS {text}), ', "date_range": {{"start": "2024-01-0', CAST(1 + max(s_suppkey) % 9 AS {text}), '"}}}}') AS data_stats_json
    FROM {d.table('supplier')} GROUP BY s_suppkey % 50"""


def _forfeit_base(d: Dialect) -> str:
    """One row per contest with the settlement target and its context columns."""
    text = "STRING" if d.spark else "VARCHAR"
    return f"""
    SELECT match_id, date, event,
           {d.at(['BLAST', 'ESL', 'IEM', 'PGL', 'CCT', 'RES', 'EPL'], '(match_id + team_a_id) % 7')} AS organizer,
           {d.at(['Europe', 'Asia', 'CIS', 'Oceania', 'Unknown'], '(match_id * 3 + team_b_id) % 5')} AS region,
           is_lan, match_format, concat('T', CAST(team_a_id AS {text})) AS team1_id,
           concat('T', CAST(team_b_id AS {text})) AS team2_id,
           CAST(CASE WHEN match_id % 11 = 0 THEN {C.UNRANKED} ELSE 1 + (team_a_id * 37) % 250 END AS INT) AS team1_rank,
           CAST(CASE WHEN match_id % 13 = 0 THEN {C.UNRANKED} ELSE 1 + (team_b_id * 41) % 250 END AS INT) AS team2_rank,
           CASE WHEN match_id % 9 IN (0, 4) AND match_id % 4 = 0 THEN 1 ELSE 0 END AS forfeit_target,
           CASE WHEN match_id % 9 = 0 AND match_id % 4 = 0 THEN concat('T', CAST(team_a_id AS {text}))
                WHEN match_id % 9 = 4 AND match_id % 4 = 0 THEN concat('T', CAST(team_b_id AS {text})) ELSE 'Unknown' END AS forfeit_team
    FROM series"""


def _scored(d: Dialect) -> str:
    """Probability, label and grouping columns: one scored row per contest."""
    return """
    SELECT match_id, date, event, is_lan, match_format,
           CAST((match_id * 37 + team_a_id * 11) % 997 AS DOUBLE) / 997 AS p,
           CASE WHEN (match_id * 13 + 5) % 1009 < (match_id * 37 + team_a_id * 11) % 997 THEN 1 ELSE 0 END AS label,
           CAST(team_a_id % 20 AS DOUBLE) - 10 AS rank_diff
    FROM series"""


def _events_base(d: Dialect) -> str:
    return f"""
    SELECT event_id, ts, CAST(ts AS DATE) AS date, user_id, event_type, value,
           CASE WHEN value > 10 THEN 1 ELSE 0 END AS forfeit_target
    FROM {d.table('events')}"""


VIEWS = {
    "series": (_series, ()),
    "maps": (_maps, ("series",)),
    "corpus": (_corpus, ("series",)),
    "ledger_matches": (_ledger_matches, ("series",)),
    "snapshots": (_snapshots, ("series",)),
    "book_odds": (_book_odds, ("snapshots",)),
    "versions": (_versions, ()),
    "forfeit_base": (_forfeit_base, ("series",)),
    "scored": (_scored, ("series",)),
    "event_rows": (_events_base, ()),
}


def with_clause(d: Dialect, *names: str) -> str:
    """``WITH`` clause that defines the named views and whatever they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for parent in VIEWS[name][1]:
            visit(parent)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0](d)})" for n in order)
