"""Point-in-time features of a contest: only strictly earlier days are visible.

History is reduced to one row per (team, map, day) before any window runs, so a
team that owns a third of all rows still has at most days x maps history rows.
All windows of a team share one shuffle and running totals replace re-scanned
frames; map rows are then joined to the state of their own (team, map, day).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.operators.ordered import trailing

METADATA = [
    "match_id", "map_pos", "map_name", "date", "team_a_id", "team_b_id", "match_format", "score_a", "score_b",
    "match_has_forfeit", "is_lan", "has_substitution_note", "has_coach_standin", "has_mid_map_sub",
    "has_map_specific_sub", "has_team_replacement", "substitution_reason_terms", "substitution_notes",
    "team_replacement_notes", "roster_status",
]


#: What ``compute_features`` reads of a map row.
INPUT = [*METADATA, "winner_id", "team_a_picked", "team_b_picked", "team_a_world_rank", "team_b_world_rank"]


def _log_rank(rank: str) -> Column:
    return F.log(F.greatest(F.coalesce(F.col(rank), F.lit(C.UNRANKED)), F.lit(1)).cast("double"))


def side_rows(maps: DataFrame) -> DataFrame:
    """Two rows per map row, one from each side's point of view (single pass, no union)."""

    def view(me: str, other: str) -> Column:
        mine, theirs = F.col(f"score_{me}"), F.col(f"score_{other}")
        return F.struct(
            F.lit(me).alias("side"),
            F.col(f"team_{me}_id").alias("team"),
            F.col(f"team_{other}_id").alias("opponent"),
            mine.alias("score_self"), theirs.alias("score_opp"),
            _log_rank(f"team_{other}_world_rank").alias("opp_log_rank"),
            (F.col("winner_id") == F.col(f"team_{me}_id")).alias("won"),
            F.col(f"team_{me}_picked").alias("picked"),
        )

    base = maps.withColumn("s", F.explode(F.array(view("a", "b"), view("b", "a"))))
    return base.select("match_id", "map_pos", "map_name", F.to_date("date").alias("date"), "is_lan",
                       "match_has_forfeit", "s.*")


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def series_rows(maps: DataFrame) -> DataFrame:
    """One row per series and side: series win/loss and the first known pick.

    Grouped with the series' own attributes, so one heavy series is combined
    before the shuffle and never gathered.
    """
    def first_pick(side: str) -> Column:
        picked = F.col(f"team_{side}_picked")
        return F.min_by(F.when(picked, F.col("map_name")), F.when(picked, F.col("map_pos"))).alias(f"pick_{side}")

    per = maps.groupBy("match_id", F.to_date("date").alias("date"), "team_a_id", "team_b_id").agg(
        _count_if(F.col("winner_id") == F.col("team_a_id")).alias("won_a"),
        _count_if(F.col("winner_id") == F.col("team_b_id")).alias("won_b"),
        F.max(F.coalesce("match_has_forfeit", F.lit(False))).alias("void"),
        first_pick("a"), first_pick("b"), F.min("map_name").alias("any_map"),
    )
    counted = ~F.col("void")

    def view(me: str, other: str) -> Column:
        ahead = counted & (F.col(f"won_{me}") > F.col(f"won_{other}"))
        behind = counted & (F.col(f"won_{me}") < F.col(f"won_{other}"))
        return F.struct(F.col(f"team_{me}_id").alias("team"), F.col(f"pick_{me}").alias("pick"),
                        ahead.cast("int").alias("series_won"), behind.cast("int").alias("series_lost"))

    return per.withColumn("s", F.explode(F.array(view("a", "b"), view("b", "a")))).select(
        "match_id", "date", "any_map", "s.*")


_SUMS = ["n", "map_won", "score_won", "log_rank", "win_margin", "win_n", "loss_margin", "loss_n", "lan_n",
         "pick_n", "series_won", "series_lost"]


#: Map rows of a team up to which they are summed in one task.
CROWD = 1_000_000


def _history_parts(maps: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """What rows add to the history, in few columns; ``_counted`` works the sums out of them."""
    s = side_rows(maps)
    zero = F.lit(0)
    none = [zero.alias(c) for c in ("pick_n", "series_won", "series_lost")]
    rows = s.select("team", "map_name", "date", F.lit(1).alias("n"), F.col("won").cast("int").alias("map_won"), (F.col("score_self") - F.col("score_opp")).alias("margin"),
                    F.col("opp_log_rank").alias("log_rank"), F.coalesce("is_lan", F.lit(False)).cast("int").alias("lan_n"), *none)
    empty = [zero.alias("n"), zero.alias("map_won"), F.lit(None).cast(rows.schema["margin"].dataType).alias("margin"), F.lit(0.0).alias("log_rank"), zero.alias("lan_n")]
    rows = rows.unionByName(series_rows(maps).select("team", F.coalesce("pick", "any_map").alias("map_name"), "date", *empty,
                                                     F.col("pick").isNotNull().cast("int").alias("pick_n"), "series_won", "series_lost"))
    if targets is not None:
        rows = rows.unionByName(targets.select(F.explode(F.array("team_a_id", "team_b_id")).alias("team"), "map_name", F.to_date("date").alias("date"), *empty, *none))
    return rows


def _counted(parts: DataFrame) -> DataFrame:
    """One row per (team, map, day)."""
    margin = F.col("margin")

    def of_maps(cond: Column) -> Column:
        return F.when(F.col("n") == 1, cond.cast("int")).otherwise(0)

    sums = {"score_won": of_maps(margin > 0), "win_margin": F.when(margin > 0, margin).otherwise(0), "win_n": of_maps(margin > 0),
            "loss_margin": F.when(margin < 0, -margin).otherwise(0), "loss_n": of_maps(margin < 0)}
    return parts.groupBy("team", "map_name", "date").agg(*[F.sum(sums.get(c, F.col(c))).alias(c) for c in _SUMS])


def daily_history(maps: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Additive history per (team, map, day); ``targets`` adds empty rows for days to be scored."""
    return _counted(_history_parts(maps, targets))


def _days(maps: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """State per (team, day), as ``_by_day`` shapes it.

    Rows of a team are dealt out once, and summed, windowed and gathered there. Only teams
    with more than ``CROWD`` rows are summed by (team, map, day) first and dealt out then.
    """
    teams = F.explode(F.array("team_a_id", "team_b_id")).alias("team")
    # a short list: at most two teams for every CROWD rows
    crowds = [r[0] for r in maps.select(teams).groupBy("team").count().where((F.col("count") > CROWD) & F.col("team").isNotNull()).collect()]
    parts = _history_parts(maps, targets)
    crowded = F.coalesce(F.col("team").isin(crowds), F.lit(False)) if crowds else F.lit(False)
    days = _by_day(team_state(_counted((parts.where(~crowded) if crowds else parts).repartition("team"))))
    return days.unionByName(_by_day(team_state(_counted(parts.where(crowded))))) if crowds else days


def team_state(history: DataFrame) -> DataFrame:
    """State of every (team, map, day) before that day; one shuffle on team serves all windows."""
    day = "day_no"
    h = history.withColumn(day, F.unix_date("date"))

    def t(col: str, days: int | None) -> Column:
        return trailing(col, ["team"], day, days)

    def m(col: str, days: int | None) -> Column:
        return trailing(col, ["team", "map_name"], day, days)

    w = Window.partitionBy("team").orderBy(day)
    h = h.withColumn("wins_through", F.sum("series_won").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    h = h.select(
        "team", "map_name", "date", day, "map_won", "n", "pick_n",
        *[t("n", d).alias(f"n_{d}") for d in C.FORM_DAYS],
        *[t("score_won", d).alias(f"w_{d}") for d in C.FORM_DAYS],
        *[t("log_rank", d).alias(f"lr_{d}") for d in (90, 30)],
        *[t(c, 30).alias(f"{c}_30") for c in ("win_margin", "win_n", "loss_margin", "loss_n", "lan_n")],
        t("pick_n", 30).alias("picks_all_30"),
        (t("series_won", None) - F.coalesce(
            F.max(F.when(F.col("series_lost") > 0, F.col("wins_through")))
            .over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("streak"),
    )
    h = h.withColumn("map_n_90", m("n", C.MAP_DAYS)).withColumn("map_w_90", m("map_won", C.MAP_DAYS))
    h = h.withColumn("picks_map_30", m("pick_n", 30))

    def rate(won: str, n: str) -> Column:
        return (F.col(won) + C.FORM_ALPHA) / (F.col(n) + C.FORM_BETA)

    def mean(total: str, n: str, empty: float) -> Column:
        return F.when(F.col(n) > 0, F.col(total) / F.col(n)).otherwise(F.lit(empty))

    default_sos = math.log(C.DEFAULT_OPPONENT_RANK)
    return h.select(
        "team", "map_name", "date",
        *[rate(f"w_{d}", f"n_{d}").alias(f"form_{d}") for d in C.FORM_DAYS],
        F.col("n_30").cast("long").alias("maps_30"), F.col("n_90").cast("long").alias("maps_90"),
        rate("map_w_90", "map_n_90").alias("map_form"), F.col("map_n_90").cast("long").alias("map_maps_90"),
        mean("lr_90", "n_90", default_sos).alias("sos_90"), mean("lr_30", "n_30", default_sos).alias("sos_30"),
        mean("win_margin_30", "win_n_30", 0.0).alias("dominance"),
        mean("loss_margin_30", "loss_n_30", 0.0).alias("loss_margin"),
        mean("lan_n_30", "n_30", 0.0).alias("lan_rate"),
        mean("picks_map_30", "picks_all_30", 0.0).alias("comfort"),
        F.col("streak").cast("long").alias("streak"),
    )


def _pair_days(maps: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One row per pair and day: wins of the lower and of the higher id."""
    def pair(df: DataFrame, lo_won: Column, hi_won: Column) -> DataFrame:
        return df.select(F.least("team_a_id", "team_b_id").alias("lo"),
                         F.greatest("team_a_id", "team_b_id").alias("hi"),
                         F.to_date("date").alias("date"), lo_won.alias("lo_won"), hi_won.alias("hi_won"))

    # whoever is not A won as B, also on a tied score
    winner = F.when(F.col("winner_id") == F.col("team_a_id"), F.col("team_a_id")).otherwise(F.col("team_b_id"))
    lo = F.least("team_a_id", "team_b_id")
    rows = pair(maps, (winner == lo).cast("int"), (winner != lo).cast("int"))
    if targets is not None:
        rows = rows.unionByName(pair(targets, F.lit(0), F.lit(0)))
    daily = rows.groupBy("lo", "hi", "date").agg(F.sum("lo_won").alias("lo_won"), F.sum("hi_won").alias("hi_won"))
    return daily.withColumn("day_no", F.unix_date("date"))


def head_to_head(maps: DataFrame, days: int = C.H2H_DAYS, targets: DataFrame | None = None) -> DataFrame:
    """Wins of the lower and the higher id of each pair over the trailing window."""
    return _pair_days(maps, targets).select("lo", "hi", "date",
                                            *[trailing(c, ["lo", "hi"], "day_no", days).alias(c) for c in ("lo_won", "hi_won")])


def with_head_to_head(df: DataFrame, maps: DataFrame, windows: tuple[int, ...], targets: DataFrame | None = None) -> DataFrame:
    """Adds ``h2h_a_wins_<days>d`` / ``h2h_b_wins_<days>d`` of several windows: one grouping, one window exchange and one join for all."""
    sums = [trailing(c, ["lo", "hi"], "day_no", d).alias(f"{c}_{d}") for d in windows for c in ("lo_won", "hi_won")]
    right = _pair_days(maps, targets).select(F.col("lo").alias("h_lo"), F.col("hi").alias("h_hi"), F.col("date").alias("h_day"), *sums)
    j = df.join(right, (F.least("team_a_id", "team_b_id") == F.col("h_lo")) & (F.greatest("team_a_id", "team_b_id") == F.col("h_hi"))
                & (F.to_date(df["date"]) == F.col("h_day")), "left")
    a_is_lo = F.col("team_a_id") == F.col("h_lo")

    def wins(side: str, d: int) -> Column:
        lo, hi = F.col(f"lo_won_{d}"), F.col(f"hi_won_{d}")
        mine = F.when(a_is_lo, lo).otherwise(hi) if side == "a" else F.when(a_is_lo, hi).otherwise(lo)
        return F.coalesce(mine, F.lit(0)).cast("long").alias(f"h2h_{side}_wins_{d}d")

    return j.select(*df.columns, *[wins(s, d) for d in windows for s in "ab"])


def join_head_to_head(df: DataFrame, h2h: DataFrame, days: int) -> DataFrame:
    """Adds ``h2h_a_wins_<days>d`` / ``h2h_b_wins_<days>d``."""
    keyed = df.withColumn("h_day", F.to_date("date"))
    right = h2h.select("lo", "hi", F.col("date").alias("r_day"), "lo_won", "hi_won")
    j = keyed.join(right, (F.least(keyed["team_a_id"], keyed["team_b_id"]) == right["lo"])
                   & (F.greatest(keyed["team_a_id"], keyed["team_b_id"]) == right["hi"])
                   & (keyed["h_day"] == right["r_day"]), "left")
    a_is_lo = F.col("team_a_id") == F.col("lo")
    zero = F.lit(0)
    return j.select(
        *df.columns,
        F.coalesce(F.when(a_is_lo, F.col("lo_won")).otherwise(F.col("hi_won")), zero).cast("long")
        .alias(f"h2h_a_wins_{days}d"),
        F.coalesce(F.when(a_is_lo, F.col("hi_won")).otherwise(F.col("lo_won")), zero).cast("long")
        .alias(f"h2h_b_wins_{days}d"))


def _by_day(state: DataFrame) -> DataFrame:
    """One row per (team, day): what all its maps share, and per map what they do not; read from the windows' own exchange."""
    own = ["map_form", "comfort"]
    shared = [c for c in state.columns if c not in ("team", "map_name", "date", "map_maps_90", *own)]
    return state.groupBy("team", "date").agg(*[F.first(c).alias(c) for c in shared], F.collect_list(F.struct("map_name", *own)).alias("maps"))


def _join_side(df: DataFrame, days: DataFrame, side: str) -> DataFrame:
    """Adds the side's state of the row's map and day; the rows of a series stay together, so they move in little space."""
    right = days.select(F.col("team").alias(f"team_{side}_id"), F.col("date").alias("day"),
                        *[F.col(c).alias(f"{side}_{c}") for c in days.columns if c not in ("team", "date")])
    right = right.withColumnsRenamed({f"team_{side}_id": f"{side}_team", "day": f"{side}_day"})
    j = df.join(right, (df[f"team_{side}_id"] == right[f"{side}_team"]) & (F.to_date(df["date"]) == right[f"{side}_day"]), "left").drop(f"{side}_team", f"{side}_day")
    own = F.get(F.filter(f"{side}_maps", lambda m: m["map_name"] == F.col("map_name")), 0)
    j = j.withColumn(f"{side}_own", own).drop(f"{side}_maps")
    known = F.col(f"{side}_own").isNotNull()  # a row without a map has no state
    return j.withColumns({**{f"{side}_{c}": F.when(known, F.col(f"{side}_{c}")) for c in days.columns if c not in ("team", "date", "maps")},
                          **{f"{side}_{c}": F.col(f"{side}_own.{c}") for c in ("map_form", "comfort")}}).drop(f"{side}_own")


def compute_features(maps: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The 17 model features, their metadata and (for played rows) the label.

    With ``targets`` the rows of that frame are scored against the history in
    ``maps``: unseen contests are features as of their own date.
    """
    return _features(maps, maps if targets is None else targets, targets)


def _features(maps: DataFrame, scored: DataFrame, targets: DataFrame | None = None, windows: tuple[int, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Features of ``scored``, head-to-head wins of further ``windows`` and the columns of ``carry``.

    Rows grow with each join and the next one moves them, so the narrow joins come first.
    """
    days = _days(maps, targets)
    label = [F.when(F.col("winner_id") == F.col("team_a_id"), 1).otherwise(0).alias("won_by_a")] if "winner_id" in scored.columns else []
    picker = (F.coalesce(F.col("team_a_picked"), F.lit(False)).cast("int") - F.coalesce(F.col("team_b_picked"), F.lit(False)).cast("int")).alias("picker")
    j = with_head_to_head(scored.select("*", picker, *label), maps, (C.H2H_DAYS, *windows), targets)
    j = _join_side(_join_side(j, days, "a"), days, "b")

    def diff(name: str) -> Column:
        return F.col(f"a_{name}") - F.col(f"b_{name}")

    ra, rb = _log_rank("team_a_world_rank"), _log_rank("team_b_world_rank")
    features = [
        (rb - ra).alias("rank_diff"),
        *[diff(f"form_{d}").alias(f"win_rate_{d}d_diff") for d in C.FORM_DAYS],
        F.log1p(F.col("a_streak").cast("double")).alias("team_a_win_streak"),
        F.log1p(F.col("b_streak").cast("double")).alias("team_b_win_streak"),
        F.col("picker").alias("picker_diff"),
        "h2h_a_wins_30d", "h2h_b_wins_30d",
        diff("map_form").alias("map_win_rate_diff"), diff("comfort").alias("map_comfort_diff"),
        diff("dominance").alias("dominance_diff"), (-diff("loss_margin")).alias("resilience_diff"),
        ((ra + rb) / 2).alias("avg_log_rank"), (-diff("sos_90")).alias("sos_90d_diff"),
        (-diff("sos_30")).alias("sos_diff"), diff("lan_rate").alias("lan_rate_diff"),
    ]
    meta = [c for c in METADATA if c in scored.columns]
    more = [f"h2h_{side}_wins_{d}d" for d in windows for side in "ab"]
    return j.select(*features, *meta, F.col("a_maps_30").alias("team_a_gen_matches_30d"),
                    F.col("b_maps_30").alias("team_b_gen_matches_30d"), *[F.col("won_by_a").alias("label") for _ in label], *more, *carry)


def min_history_filter(features: DataFrame, threshold: int = 1) -> DataFrame:
    """Keeps rows where both sides played at least ``min(threshold, 1)`` maps in 30 days."""
    need = min(threshold, 1)
    return features.where((F.col("team_a_gen_matches_30d") >= need) & (F.col("team_b_gen_matches_30d") >= need))


def mirror_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds the side-swapped copy of every row (in one pass over the input)."""
    cols = df.columns

    def partner(c: str) -> str | None:
        pairs = (("team_a_", "team_b_"), ("h2h_a_wins", "h2h_b_wins"))
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if c.startswith(x) and y + c[len(x):] in cols:
                    return y + c[len(x):]
        if c in ("score_a", "score_b") and {"score_a", "score_b"} <= set(cols):
            return "score_b" if c == "score_a" else "score_a"
        return None

    def swapped(c: str) -> Column:
        if c.endswith("_diff"):
            return (-F.col(c)).alias(c)
        if c == label:
            return (1 - F.col(c)).alias(c)
        return F.col(partner(c) or c).alias(c)

    both = F.explode(F.array(F.struct(*cols), F.struct(*[swapped(c) for c in cols])))
    return df.select(both.alias("r")).select("r.*")


def sample_depth_features(df: DataFrame) -> DataFrame:
    """Plain and log forms of the two 30-day map counts."""
    a, b = (F.col(f"team_{s}_gen_matches_30d") for s in "ab")
    low = F.least(a, b)
    return df.select(
        "*", (a - b).alias("gen_matches_30d_diff"), low.alias("min_gen_matches_30d"),
        F.log1p(a.cast("double")).alias("log_team_a_gen_matches_30d"),
        F.log1p(b.cast("double")).alias("log_team_b_gen_matches_30d"),
        (F.log1p(a.cast("double")) - F.log1p(b.cast("double"))).alias("log_gen_matches_30d_diff"),
        F.log1p(low.cast("double")).alias("log_min_gen_matches_30d"))


def variant_frame(maps: DataFrame) -> DataFrame:
    """The features with every column that a named column set of the experiments asks for."""
    from rivalry.operators import ranks as R

    keys = ["match_id", "map_name", "date", "team_a_id", "team_b_id"]
    sources = [f"team_{side}_{source}_rank{end}" for side in "ab" for source in R.SOURCES for end in ("", "_missing")]
    known = {c: f"known_{c}" for c in sources}
    # the maps are joined to their ranks before the features make them wide
    ranked = R.rank_enrich(maps, maps.select(*keys, *[F.col(c).alias(k) for c, k in known.items()]), keys)
    f = _features(maps, ranked, None, (14, 90), tuple(known.values())).withColumnsRenamed({k: c for c, k in known.items()})
    return sample_depth_features(R.rank_strategy_features(f).drop(*sources))


def latest_rank(maps: DataFrame, default: int = C.UNRANKED) -> DataFrame:
    """Last known rank per team; the default only when no rank was ever seen."""
    def view(side: str) -> Column:
        return F.struct(F.col(f"team_{side}_id").alias("team"), F.col(f"team_{side}_world_rank").alias("rank"),
                        F.lit(side).alias("side"))

    rows = maps.select("date", "match_id", "map_pos", F.explode(F.array(view("a"), view("b"))).alias("s"))
    known = F.when(F.col("s.rank") != default, F.struct("date", "match_id", "map_pos", "s.side"))
    return rows.groupBy(F.col("s.team").alias("team")).agg(
        F.coalesce(F.max_by("s.rank", known), F.lit(default)).alias("latest_rank"))
