"""Nested contest records to clean map rows.

All per-series decisions are array expressions inside the record's own row, so
exclusions run before the explode and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.functions import text as X
from rivalry.session import persist_table


def text_blob(df: DataFrame) -> Column:
    """Lower-case searchable text of a record: event, format, notes, vetoes, map names, pickers."""
    maps = F.transform("hltv_maps", lambda m: F.concat_ws(" ", X.filled(m["map_name"]), X.filled(m["picker"])))
    return F.lower(F.concat_ws(" ", X.filled(F.col("event")), X.filled(F.col("format")),
                               F.concat_ws(" ", "match_info"), F.concat_ws(" ", "hltv_vetoes"),
                               F.concat_ws(" ", F.filter(maps, lambda x: x != ""))))


def showmatch_reason(blob: Column) -> Column:
    return X.first_keyword(blob, C.SHOWMATCH_KEYWORDS)


def invalid_veto_reason(blob: Column) -> Column:
    return (F.when(blob.contains("randomized"), F.lit("randomized"))
            .when(blob.contains("failed to show up") & blob.contains("veto process"),
                  F.lit("failed to show up for the veto process")))


def roster_lines(lines: Column) -> dict[str, Column]:
    """Info lines that mention a substitution, and lines that mention a team replacement."""
    clean = F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: X.strip(x)),
                     lambda x: x != "")
    return {"sub_lines": F.filter(clean, lambda x: X.any_keyword(F.lower(x), C.SUBSTITUTION_KEYWORDS)),
            "move_lines": F.filter(clean, lambda x: X.any_keyword(F.lower(x), C.TEAM_REPLACEMENT_KEYWORDS))}


FLAGS = ["has_substitution_note", "has_coach_standin", "has_mid_map_sub", "has_map_specific_sub",
         "has_team_replacement", "substitution_reason_terms", "substitution_notes", "team_replacement_notes",
         "roster_status"]


def _with_roster_lines(df: DataFrame, lines: str) -> DataFrame:
    """The lines about substitutions and moves, and the former as one lower-case text."""
    df = X.settle(df, **roster_lines(F.col(lines)))
    return X.settle(df, sub_text=F.lower(F.array_join("sub_lines", "\n")))


def _roster_status(moved: Column, mid_map: Column, coach: Column, sub: Column) -> Column:
    return (F.when(moved, "team_replacement").when(mid_map, "mid_map_substitution")
            .when(coach, "coach_standin").when(sub, "substitution").otherwise("standard"))


def with_roster_status(df: DataFrame, lines: str = "match_info") -> DataFrame:
    """The status alone; flags, terms and notes that nobody reads are not worked out."""
    df, text = _with_roster_lines(df, lines), F.col("sub_text")
    status = _roster_status(F.size("move_lines") > 0, X.any_pattern(text, C.MID_MAP_PATTERNS),
                            text.rlike(r"\(coach| coach\)"), F.size("sub_lines") > 0)
    return df.withColumn("roster_status", status).drop("sub_lines", "move_lines", "sub_text")


def with_roster_flags(df: DataFrame, lines: str = "match_info") -> DataFrame:
    """Five flags, reason terms, notes and the status, from the record's info lines."""
    df = _with_roster_lines(df, lines)
    text, has_sub, moved = F.col("sub_text"), F.size("sub_lines") > 0, F.size("move_lines") > 0
    # a line break ends every pattern, so one search over the joined lines equals a search per line
    df = X.settle(
        df, has_substitution_note=has_sub, has_coach_standin=text.rlike(r"\(coach| coach\)"),
        has_mid_map_sub=X.any_pattern(text, C.MID_MAP_PATTERNS),
        has_map_specific_sub=X.any_pattern(text, C.MAP_SCOPE_PATTERNS), has_team_replacement=moved,
        substitution_reason_terms=F.concat_ws(",", *[F.when(text.contains(k), F.lit(k)) for k in sorted(C.SUBSTITUTION_REASONS)]),
        substitution_notes=F.array_join("sub_lines", " | "), team_replacement_notes=F.array_join("move_lines", " | "))
    status = _roster_status(*[F.col(c) for c in ("has_team_replacement", "has_mid_map_sub", "has_coach_standin", "has_substitution_note")])
    return df.withColumn("roster_status", status).drop("sub_lines", "move_lines", "sub_text")


def roster_size_reason(maps: Column, limit: int = C.MAX_STANDARD_PLAYERS) -> Column:
    """Reason when one map, or the whole series, lists more distinct players than allowed."""
    def names(m: Column) -> Column:
        clean = F.transform(m["player_stats"], lambda p: F.lower(X.strip(X.text(p["player"]))))
        return F.array_distinct(F.filter(clean, lambda x: x != ""))

    def count(m: Column) -> Column:
        n = F.size(m["names"])
        return F.when(n > 0, n).otherwise(F.greatest(m["listed"], F.lit(0)))

    def reason(seen: Column) -> Column:
        over = F.filter(seen, lambda m: F.coalesce(count(m), F.lit(0)) > limit)
        first = F.get(over, F.lit(0))
        series = F.size(F.array_distinct(F.flatten(F.transform(F.filter(seen, lambda m: m["has_list"]), lambda m: m["names"]))))
        return (F.when(F.size(over) > 0, F.concat(count(first).cast("string"), F.lit(" players recorded on "),
                                                  F.coalesce(first["map_name"], F.lit("unknown map"))))
                .when(series > limit, F.concat(series.cast("string"), F.lit(" unique players recorded across the series"))))

    seen = F.transform(maps, lambda m: F.struct(
        names(m).alias("names"), F.size(m["player_stats"]).alias("listed"), m["map_name"].alias("map_name"),
        m["player_stats"].isNotNull().alias("has_list")))
    # an array of one element gives the maps' names to the lambda: they are cleaned once
    return F.get(F.transform(F.array(seen), reason), F.lit(0))


def with_exclusions(corpus: DataFrame) -> DataFrame:
    """Adds the roster flags and ``exclusion``: the first applicable reason group, or NULL."""
    df = with_roster_flags(X.settle(corpus, blob=text_blob(corpus)))
    df = X.settle(df, showmatch_reason=showmatch_reason(F.col("blob")), veto_reason=invalid_veto_reason(F.col("blob")),
                  roster_size_reason=roster_size_reason(F.col("hltv_maps")))
    reason = (F.when(F.col("showmatch_reason").isNotNull(), "showmatch").when(F.col("veto_reason").isNotNull(), "invalid_veto")
              .when(F.col("roster_status") != "standard", "roster_anomaly")
              .when(F.col("roster_size_reason").isNotNull(), "nonstandard_roster"))
    return X.settle(df, exclusion=reason).drop("blob")


def exclusion_audit(corpus: DataFrame) -> DataFrame:
    kept = F.coalesce("exclusion", F.lit("kept"))
    return with_exclusions(corpus).groupBy(kept.alias("reason")).agg(F.count("*").alias("matches"))


def _team_ranks(team: str) -> Column:
    entries = F.filter(F.map_entries("team_ranks"), lambda e: X.normalize_name(e["key"]) == F.col(team))
    return F.try_element_at(entries, F.lit(-1))["value"]


def rank_columns(side: str) -> list[Column]:
    """World rank (VRS only if world is blank), VRS rank and their missing flags for one side."""
    r = F.col(f"ranks_{side}")
    world, vrs = r["world_rank"], r["vrs_before_rank"]
    return [
        F.when(X.is_blank(world), X.parse_rank(vrs)).otherwise(X.parse_rank(world)).alias(f"team_{side}_world_rank"),
        X.parse_rank(vrs).alias(f"team_{side}_vrs_rank"),
        X.is_blank(world).alias(f"team_{side}_world_rank_missing"),
        X.is_blank(vrs).alias(f"team_{side}_vrs_rank_missing"),
    ]


def orientation(t1: Column, t2: Column, a: Column, b: Column) -> Column:
    """'straight', 'swapped' or NULL for a map's team names against the series' (A, B)."""
    def near(x: Column, y: Column) -> Column:
        return x.contains(y) | y.contains(x)

    named = (t1 != "") & (t2 != "") & (a != "") & (b != "")
    return (F.when(~named, None)
            .when((t1 == b) & (t2 == a), "swapped").when((t1 == a) & (t2 == b), "straight")
            .when(near(t1, b) & near(t2, a), "swapped").when(near(t1, a) & near(t2, b), "straight"))


def series_header(df: DataFrame) -> DataFrame:
    """Ids, date, format, surface and rank structs of a record."""
    df = X.settle(df, team_a_id=X.normalize_name(F.col("team1")), team_b_id=X.normalize_name(F.col("team2")),
                  played_on=X.parse_date(F.col("date")),
                  match_format=X.normalize_format(F.coalesce(F.col("format"), F.lit("unknown"))),
                  is_lan=X.detect_is_lan(F.col("match_info")))
    fallback = F.concat(F.lit("gen_"), F.xxhash64("team1", "team2", "date").cast("string"))
    return X.settle(df, ranks_a=_team_ranks("team_a_id"), ranks_b=_team_ranks("team_b_id"),
                    match_id=F.coalesce(F.col("url"), fallback))


def explode_maps(corpus: DataFrame) -> DataFrame:
    """One row per played map, oriented to (A, B); position kept, unplayed maps dropped."""
    kept = series_header(with_exclusions(corpus).where(F.col("exclusion").isNull()))
    kept = X.settle(kept, ranks=F.struct(F.struct(*rank_columns("a")).alias("a"), F.struct(*rank_columns("b")).alias("b")))
    carried = ["match_id", "played_on", "team1", "team2", "team_a_id", "team_b_id", "ranks", "match_format", "is_lan", *FLAGS]
    rows = kept.select(*carried, F.posexplode("hltv_maps").alias("pos", "m"))
    rows = X.settle(
        rows.select(*carried, "pos", "m.map_name", "m.team1_score", "m.team2_score", F.col("m.team1").alias("n1"),
                    F.col("m.team2").alias("n2"), F.col("m.picker").alias("by")),
        t1=X.normalize_name(F.col("n1")), t2=X.normalize_name(F.col("n2")),
        s1=X.strip(F.col("team1_score")).try_cast("int"), s2=X.strip(F.col("team2_score")).try_cast("int"),
        picker=X.normalize_name(F.col("by")))
    rows = rows.where(played_map(F.col("map_name"), F.col("s1"), F.col("s2")))
    rows = X.settle(rows, facing=orientation(F.col("t1"), F.col("t2"), F.col("team_a_id"), F.col("team_b_id")))
    rows = rows.where(F.col("facing").isNotNull())
    swapped = F.col("facing") == "swapped"
    rows = rows.withColumn("score_a", F.when(swapped, F.col("s2")).otherwise(F.col("s1")))
    rows = rows.withColumn("score_b", F.when(swapped, F.col("s1")).otherwise(F.col("s2")))
    name = F.col("map_name")
    return rows.select(
        "match_id", (F.col("pos") + 1).alias("map_pos"), "map_name", F.col("played_on").alias("date"),
        "team_a_id", F.col("team1").alias("team_a_name"), "team_b_id", F.col("team2").alias("team_b_name"),
        "score_a", "score_b",
        F.when(F.col("score_a") > F.col("score_b"), F.col("team_a_id")).otherwise(F.col("team_b_id")).alias("winner_id"),
        (F.col("picker") == F.col("team_a_id")).alias("team_a_picked"),
        ((F.col("picker") == F.col("team_b_id")) & (F.col("picker") != F.col("team_a_id"))).alias("team_b_picked"),
        "ranks.a.*", "ranks.b.*", "match_format",
        F.lower(name).isin("default", "forfeit").alias("is_forfeit"), "is_lan", *FLAGS)


def played_map(name: Column, s1: Column, s2: Column) -> Column:
    return (X.text(name) != "") & (F.lower(name) != "tbd") & s1.isNotNull() & s2.isNotNull()


def forfeit_exclusion(raw_maps: DataFrame) -> DataFrame:
    """Flags series with a default map, then drops default maps and whole-default series.

    The flagged ids are grouped with the series' format and side ids, so the join
    adds its own exchange and a heavy series stays splittable at run time. The rows are
    stored first: the flags, the rows and whatever joins the result to itself read them,
    and records are parsed once.
    """
    raw_maps = persist_table(raw_maps)
    flagged = (raw_maps.where("is_forfeit").groupBy("match_id", "team_a_id", "team_b_id", "match_format")
               .agg(F.lit(True).alias("match_has_forfeit")).select("match_id", "match_has_forfeit"))
    out = raw_maps.join(flagged, "match_id", "left")
    out = out.withColumn("match_has_forfeit", F.coalesce("match_has_forfeit", F.lit(False)))
    return out.where(~F.col("is_forfeit") & (F.col("match_format") != "def"))


def forfeit_flagged_corpus(corpus: DataFrame) -> DataFrame:
    """The same flag taken from the nested record itself: no shuffle at all."""
    has = F.exists("hltv_maps", lambda m: F.lower(X.strip(X.text(m["map_name"]))).isin("default", "forfeit"))
    return corpus.withColumn("match_has_forfeit", F.coalesce(has, F.lit(False)))


def build_clean_maps(corpus: DataFrame) -> DataFrame:
    from rivalry.operators.ranks import repair_default_ranks

    return repair_default_ranks(forfeit_exclusion(explode_maps(corpus)))


def sorted_maps(maps: DataFrame) -> DataFrame:
    """Total order by date, series and position; stored first, so that sampling the ranges does not parse the records too."""
    return persist_table(maps).orderBy("date", "match_id", "map_pos")


def freshness(corpus: DataFrame, trained_at: str, limit: int = C.STALE_AFTER_MAPS) -> DataFrame:
    """Played raw maps after the training date and whether the model is stale."""
    def played(m: Column) -> Column:
        s1, s2 = X.strip(X.text(m["team1_score"])), X.strip(X.text(m["team2_score"]))
        return (s1 != "") & (s2 != "") & (s1 != "-") & (s2 != "-")

    new = corpus.where(X.parse_date(F.col("date")) > F.lit(trained_at).cast("timestamp"))
    n = F.coalesce(F.sum(F.size(F.filter("hltv_maps", played))), F.lit(0)).cast("long")
    return new.agg(n.alias("new_maps")).withColumn("stale", F.col("new_maps") >= limit)


# ---- listing and prediction filters ---------------------------------------
def listing_outcome(date: Column, start: str | None, end: str | None, team_ok: Column, stored: Column,
                    stored_error: Column, retry_errors: bool) -> Column:
    """First applicable outcome of a listed contest."""
    day = date.cast("date")
    dated = start is not None or end is not None
    out_of_bounds = F.lit(False)
    if start:
        out_of_bounds = out_of_bounds | (day < F.lit(start).cast("date"))
    if end:
        out_of_bounds = out_of_bounds | (day > F.lit(end).cast("date"))
    failed = F.lit("eligible retries" if retry_errors else "stored failures skipped")
    return (F.when(F.lit(dated) & day.isNull(), "unknown dates").when(out_of_bounds, "outside date bounds")
            .when(~team_ok, "team excluded").when(stored & ~stored_error, "stored successes skipped")
            .when(stored, failed).otherwise("eligible new"))


def predictable(df: DataFrame, as_of: str) -> DataFrame:
    """Drops undetermined, placeholder, started and undated contests; flags those over 3 days away."""
    t1, t2 = F.lower("team1"), F.lower("team2")
    unknown = t1.rlike("unknown|tbd") | t2.rlike("unknown|tbd")
    slot = r".+/.+ (winner|loser)"
    start = F.concat_ws(" ", "date", "time").try_cast("timestamp")
    now = F.lit(as_of).cast("timestamp")
    timed = F.col("date").isNotNull() & F.col("time").isNotNull()
    keep = df.where(~unknown & ~t1.rlike(slot) & ~t2.rlike(slot) & timed & (start.isNull() | (start >= now)))
    return keep.withColumn("is_later", F.coalesce(start > now + F.expr("INTERVAL 3 DAYS"), F.lit(False)))


def eval_eligibility(roster_status: Column, maps_a: Column, maps_b: Column, need: int = 10) -> dict[str, Column]:
    """Exclusion text and validity flag of a prediction."""
    reason = F.concat_ws("; ",
                         F.when(roster_status != "standard", F.concat(F.lit("roster anomaly: "), roster_status)),
                         F.when((maps_a < need) | (maps_b < need), F.lit("low sample")))
    return {"eval_exclusion_reason": X.filled(reason), "valid_for_eval": F.when(reason == "", 1).otherwise(0)}


def era_violations(eras: DataFrame, known_maps: list[str]) -> DataFrame:
    """One row per broken registry rule (a dimension table: one row per era)."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(1)).orderBy("era_no")
    known = F.array(*[F.lit(m) for m in known_maps])
    d = eras.withColumns({"prev": F.lag("start").over(w), "same_name": F.count("*").over(Window.partitionBy("name"))})
    return d.select("name", F.explode(F.array_compact(F.array(
        F.when((F.size("maps") != 7) | (F.size(F.array_distinct("maps")) != 7), F.lit("needs seven distinct maps")),
        F.when(F.size(F.array_except("maps", known)) > 0, F.lit("undefined maps")),
        F.when((F.col("era_no") == 1) & F.col("start").isNotNull(), F.lit("first era must be open")),
        F.when((F.col("era_no") > 1) & F.col("start").isNull(), F.lit("start needed")),
        F.when((F.col("era_no") > 1) & (F.col("start") <= F.col("prev")), F.lit("starts must increase")),
        F.when(F.col("same_name") > 1, F.lit("duplicate name")),
    ))).alias("violation"))
