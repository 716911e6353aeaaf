"""Default and forfeit analysis: record classification and rate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.functions import text as X
from rivalry.operators.clean import showmatch_reason, text_blob

DEFAULT_NAMES = ("default", "forfeit")


def forfeit_notes(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda x: X.any_pattern(F.lower(X.strip(x)), C.FORFEIT_TEXT_PATTERNS)),
                       lambda x: X.strip(x))


def is_nonstandard(df: DataFrame) -> Column:
    text = F.concat_ws(" ", X.clean_event(F.col("event")), X.text(F.col("format")), F.concat_ws(" ", "match_info"))
    return showmatch_reason(text_blob(df)).isNotNull() | X.any_pattern(F.lower(text), C.NONSTANDARD_PATTERNS)


def is_default_map(m: Column) -> Column:
    return F.lower(X.strip(X.text(m["map_name"]))).isin(*DEFAULT_NAMES)


def most_common(names: Column) -> Column:
    """Most frequent element of a short array; the one seen first wins ties."""
    distinct = F.array_distinct(names)
    ranked = F.transform(distinct, lambda n, i: F.struct(
        F.size(F.filter(names, lambda x: x == n)).alias("n"), (-i).alias("pos"), n.alias("name")))
    return F.array_max(ranked)["name"]


def default_teams(loser: bool) -> Column:
    """Losers (or winners) of the record's 1-0 / 0-1 default maps, in order."""
    def team(m: Column) -> Column:
        t1 = F.coalesce(X.filled(X.strip(F.col("team1"))), X.strip(X.text(m["team1"])))
        t2 = F.coalesce(X.filled(X.strip(F.col("team2"))), X.strip(X.text(m["team2"])))
        score = F.concat(X.strip(X.text(m["team1_score"])), F.lit("-"), X.strip(X.text(m["team2_score"])))
        first, second = ("0-1", "1-0") if loser else ("1-0", "0-1")
        return F.when(is_default_map(m) & (score == first), t1).when(is_default_map(m) & (score == second), t2)

    return F.filter(F.transform("hltv_maps", team), lambda x: x.isNotNull() & (x != ""))


def note_team(notes: Column, t1: Column, t2: Column) -> Column:
    """Team named by a forfeit note pattern, else a team mentioned anywhere in the notes."""
    def named(note: Column) -> Column:
        return F.array(*[F.lower(X.strip(F.regexp_extract(note, "(?i)" + p, 1), " *.")) for p in C.FORFEIT_TEAM_PATTERNS])

    found = F.get(F.filter(F.flatten(F.transform(notes, named)),
                           lambda c: (c != "") & ((c == F.lower(t1)) | (c == F.lower(t2)))), F.lit(0))
    text = F.lower(F.concat_ws(" ", notes))
    return (F.when(found == F.lower(t1), t1).when(found == F.lower(t2), t2)
            .when((t1 != "") & F.contains(text, F.lower(t1)), t1).when((t2 != "") & F.contains(text, F.lower(t2)), t2))


def _rank_of(team: Column, kind: str) -> Column:
    entry = F.get(F.filter(F.map_entries("team_ranks"), lambda e: F.lower(X.strip(e["key"])) == F.lower(team)), F.lit(0))
    field = "vrs_before_rank" if kind == "vrs" else "world_rank"
    return F.when(team.isNull() | (team == ""), F.lit(C.UNRANKED)).otherwise(X.parse_rank(entry["value"][field]))


def forfeit_rows(corpus: DataFrame, rank_type: str = "world") -> DataFrame:
    """One row per record with its forfeit classification; array expressions only, no shuffle."""
    df = X.settle(corpus, note_list=forfeit_notes(F.col("match_info")), t1=X.strip(X.text(F.col("team1"))),
                  t2=X.strip(X.text(F.col("team2"))), event_name=X.clean_event(F.col("event")),
                  fmt=X.normalize_format(F.col("format")), defaults=F.size(F.filter("hltv_maps", is_default_map)),
                  losers=default_teams(True), winners=default_teams(False))
    ft = F.col("ft")
    df = X.settle(df, ft=F.when(F.size("losers") > 0, most_common(F.col("losers")))
                  .otherwise(note_team(F.col("note_list"), F.col("t1"), F.col("t2"))))
    df = df.withColumn("opponent", F.when(ft.isNotNull(), F.when(F.lower(ft) == F.lower("t1"), F.col("t2")).otherwise(F.col("t1"))))
    df = X.settle(df, ft_rank=_rank_of(ft, rank_type), opp_rank=_rank_of(F.col("opponent"), rank_type))
    full = F.col("fmt") == "def"
    return df.select(
        F.to_date(X.parse_date(F.col("date"))).alias("date"), "url", F.col("event_name").alias("event"),
        X.infer_organizer(F.col("event_name")).alias("organizer"),
        X.infer_region(F.col("event_name"), F.col("match_info")).alias("region"),
        X.detect_is_lan(F.col("match_info")).alias("is_lan"), F.col("fmt").alias("format"),
        F.col("t1").alias("team1"), F.col("t2").alias("team2"),
        _rank_of(F.col("t1"), rank_type).alias("team1_rank"), _rank_of(F.col("t2"), rank_type).alias("team2_rank"),
        (full | (F.col("defaults") > 0) | (F.size("note_list") > 0)).alias("has_forfeit"),
        full.alias("is_full_default"), ((F.col("defaults") > 0) & ~full).alias("has_partial_default_map"),
        F.col("defaults").alias("default_map_count"), F.coalesce("ft", F.lit("Unknown")).alias("forfeit_team"),
        F.coalesce(most_common(F.col("winners")), F.lit("Unknown")).alias("default_winner"),
        F.col("ft_rank").alias("forfeit_team_rank"), F.col("opp_rank").alias("opponent_rank"),
        X.rank_bucket(F.col("ft_rank")).alias("forfeit_rank_bucket"),
        X.rank_side(F.col("ft_rank"), F.col("opp_rank")).alias("rank_side"),
        X.reason_category(F.col("note_list")).alias("reason"), F.concat_ws(" | ", "note_list").alias("notes"))


def forfeit_base(corpus: DataFrame, include_nonstandard: bool = False) -> DataFrame:
    """Model base rows: usable records, latest per id, formats that do not leak the outcome."""
    from rivalry.operators.ordered import last_row

    df = corpus if include_nonstandard else corpus.where(~is_nonstandard(corpus))
    df = forfeit_rows(df.where((X.text(F.col("team1")) != "") & (X.text(F.col("team2")) != "")))
    df = df.where(F.col("date").isNotNull() & F.col("url").isNotNull())
    b1, b2 = X.rank_bucket(F.col("team1_rank")), X.rank_bucket(F.col("team2_rank"))
    df = df.withColumnRenamed("url", "match_id").select(
        "*", X.normalize_name(F.col("team1")).alias("team1_id"), X.normalize_name(F.col("team2")).alias("team2_id"),
        F.col("format").alias("settlement_match_format"),
        F.when(F.col("format") == "def", "bo3").otherwise(F.col("format")).alias("match_format"),
        F.col("has_forfeit").cast("int").alias("forfeit_target"), b1.alias("team1_rank_bucket"),
        b2.alias("team2_rank_bucket"),
        F.array_join(F.array_sort(F.array(b1, b2)), " / ").alias("rank_pair_bucket"))
    return last_row(df.drop("format", "has_forfeit"), ["match_id"], ["date", "notes"])


# ---- rate tables ----------------------------------------------------------
def rate_table(df: DataFrame, key: str, target: str = "has_forfeit", min_matches: int = 1,
               limit: int | None = 20) -> DataFrame:
    """Matches, forfeits and rate by key, best rates first; NULL keys form their own group."""
    g = df.groupBy(key).agg(F.count("*").alias("matches"), F.sum(F.col(target).cast("int")).alias("forfeits"))
    g = g.where(F.col("matches") >= min_matches).withColumn("forfeit_rate", F.col("forfeits") / F.col("matches"))
    g = g.orderBy(F.desc("forfeit_rate"), F.desc("forfeits"), F.desc("matches"), key)
    return g.limit(limit) if limit else g


def team_rate_table(df: DataFrame, min_matches: int = 1, limit: int | None = 20) -> DataFrame:
    rows = df.select(F.explode(F.array("team1", "team2")).alias("team"), "has_forfeit", "forfeit_team")
    rows = rows.withColumn("own", F.col("has_forfeit") & (F.lower("team") == F.lower("forfeit_team")))
    g = rate_table(rows, "team", "own", min_matches, None).withColumnsRenamed(
        {"forfeits": "team_forfeits", "forfeit_rate": "team_forfeit_rate"})
    g = g.orderBy(F.desc("team_forfeit_rate"), F.desc("team_forfeits"), F.desc("matches"), "team")
    return g.limit(limit) if limit else g


def period_trend(df: DataFrame, cadence: str = "week", target: str = "has_forfeit") -> DataFrame:
    """Counts and rate per day, week or month."""
    start = F.to_date(F.date_trunc(cadence, "date"))
    return (df.where(F.col("date").isNotNull()).groupBy(start.alias("period_start"))
            .agg(F.count("*").alias("matches"), F.sum(F.col(target).cast("int")).alias("forfeits"))
            .withColumn("forfeit_rate", F.col("forfeits") / F.col("matches")))


def trend_regression(trend: DataFrame) -> DataFrame:
    """Least squares of bucket rate on days since the first bucket (one row; NULL below 3 buckets)."""
    from rivalry.functions.stats import two_sided_t_p

    first = Window.partitionBy(F.lit(1))  # one row per period
    pts = trend.withColumn("x", F.datediff("period_start", F.min("period_start").over(first)).cast("double"))
    one = pts.agg(F.count("*").alias("buckets"), F.regr_slope("forfeit_rate", "x").alias("slope"),
                  F.regr_intercept("forfeit_rate", "x").alias("intercept"), F.regr_r2("forfeit_rate", "x").alias("r2"),
                  F.min("period_start").alias("start"), F.max("period_start").alias("end"))
    one = one.where(F.col("buckets") >= 3)
    df_ = F.col("buckets") - 2
    t = F.sqrt(F.col("r2") * df_ / F.nullif(1 - F.col("r2"), F.lit(0.0)))
    return one.withColumn("t", t).withColumn("p_value", two_sided_t_p(F.col("t"), df_.cast("double"))).withColumn(
        "slope_per_30_days", F.col("slope") * 30).withColumn("significant", F.col("p_value") < 0.05)


def share_table(df: DataFrame, key: str) -> DataFrame:
    """Count per value and its share of all rows; the total is summed over the grouped table."""
    g = df.groupBy(key).agg(F.count("*").alias("forfeits"))
    total = g.agg(F.sum("forfeits").alias("total"))
    return g.crossJoin(F.broadcast(total)).select(key, "forfeits", (F.col("forfeits") / F.col("total")).alias("share"))


def headline_counts(df: DataFrame) -> DataFrame:
    def n(c: Column) -> Column:
        return F.count_if(c)

    f, lan = F.col("has_forfeit"), F.col("is_lan")
    return df.agg(F.count("*").alias("matches"), n(f).alias("forfeits"), n(F.col("is_full_default")).alias("full_defaults"),
                  n(F.col("has_partial_default_map")).alias("partial_defaults"),
                  F.sum("default_map_count").alias("default_maps"),
                  n(~lan).alias("online"), n(f & ~lan).alias("online_forfeits"),
                  n(lan).alias("lan"), n(f & lan).alias("lan_forfeits")).select(
        "*", F.try_divide("online_forfeits", "online").alias("online_rate"), F.try_divide("lan_forfeits", "lan").alias("lan_rate"))


def recent_forfeits(df: DataFrame, limit: int) -> DataFrame:
    cols = ["date", "url", "forfeit_team", "default_winner", "event", "region", "format", "reason", "notes"]
    return df.where("has_forfeit").orderBy(F.desc("date"), "url").limit(limit).select(*cols)


def grouped_rate_summary(df: DataFrame, key: str, target: str = "forfeit_target", limit: int = 12) -> DataFrame:
    g = df.groupBy(F.col(key).cast("string").alias("value")).agg(
        F.count("*").alias("matches"), F.sum(target).cast("long").alias("forfeit_matches"), F.avg(target).alias("forfeit_rate"))
    return g.orderBy(F.desc("matches"), F.desc("forfeit_rate"), "value").limit(limit)
