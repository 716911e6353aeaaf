"""Prediction ledger: snapshots, odds, settlement, exclusions and reports.

Latest-per-key steps are ``max_by`` aggregations (combined before the shuffle)
instead of ranking windows, so a contest with very many snapshots stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.functions import stats as S
from rivalry.functions import text as X
from rivalry.operators.ordered import first_row, last_row


# ---- odds -----------------------------------------------------------------
def safe_odds(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when((v > 0) & (v < float("inf")), v)


def no_vig(odds_a: Column, odds_b: Column) -> tuple[Column, Column, Column]:
    """Normalised probabilities and the overround; NULL unless both odds are usable."""
    a, b = 1 / safe_odds(odds_a), 1 / safe_odds(odds_b)
    return a / (a + b), b / (a + b), a + b


def fair_probs(p: Column, forfeit: Column) -> tuple[Column, Column]:
    return (1 - forfeit) * p + 0.5 * forfeit, (1 - forfeit) * (1 - p) + 0.5 * forfeit


def edge(p: Column, odds: Column) -> Column:
    """Percentage points over the raw implied probability (margin included)."""
    return 100 * p - 100 / F.nullif(odds, F.lit(0.0))


def edge_columns(df: DataFrame, prob: str = "model_prob_a") -> DataFrame:
    p, ea, eb = F.col(prob), F.col("edge_a"), F.col("edge_b")
    both = ea.isNotNull() & eb.isNotNull()
    return df.select(
        "*", F.when(F.when(both, ea >= eb).otherwise(p >= 0.5), "team_a").otherwise("team_b").alias("best_bet"),
        F.round(F.when(both, F.greatest(ea, eb)), 2).alias("best_edge"),
        F.round(1 / F.col("odds_a"), 4).alias("implied_a_4"), F.round(1 / F.col("odds_b"), 4).alias("implied_b_4"),
        F.round(ea, 2).alias("edge_a_2"), F.round(eb, 2).alias("edge_b_2"),
        F.coalesce(ea > 2.0, F.lit(False)).alias("value_a"), F.coalesce(eb > 2.0, F.lit(False)).alias("value_b"))


def fair_adjustment(df: DataFrame, forfeit_prob: str = "forfeit_prob") -> DataFrame:
    """No-vig odds blended with the forfeit probability, and the status of the adjustment."""
    raw = F.col(forfeit_prob)  # greatest/least skip NULLs, so keep an unknown probability unknown
    f = F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
    a, b, _ = no_vig(F.col("odds_a"), F.col("odds_b"))
    status = F.when(f.isNull(), "unavailable").when(a.isNull(), "missing_odds").otherwise("applied")
    return df.select("*", F.round((1 - f) * a + 0.5 * f, 6).alias("fair_prob_a"),
                     F.round((1 - f) * b + 0.5 * f, 6).alias("fair_prob_b"), status.alias("status"))


def odds_summary(odds: DataFrame, keys: list[str]) -> DataFrame:
    """Book count and median/mean/min/max per side over complete rows.

    Medians are exact; they come from counts per distinct price, not from gathered lists.
    """
    whole = odds.where((F.coalesce("odds_a", F.lit(0.0)) != 0) & (F.coalesce("odds_b", F.lit(0.0)) != 0))
    return whole.groupBy(*keys).agg(
        F.count("*").alias("book_count"),
        *[f(f"odds_{s}").alias(f"odds_{s}_{n}") for s in "ab"
          for f, n in ((F.median, "median"), (F.avg, "mean"), (F.min, "min"), (F.max, "max"))])


def dedupe_books(odds: DataFrame, keys: list[str]) -> DataFrame:
    """One row per book and rounded prices; the first listed wins."""

    d = odds.where(F.col("odds_a").isNotNull() & F.col("odds_b").isNotNull())
    d = d.select("*", F.lower("bookmaker").alias("book_key"), F.round("odds_a", 3).alias("a3"), F.round("odds_b", 3).alias("b3"))
    return first_row(d, [*keys, "book_key", "a3", "b3"], ["b"]).drop("book_key", "a3", "b3")


def with_median_odds(df: DataFrame) -> DataFrame:
    """Replaces both prices by the summary's medians when both are present and non-zero."""
    a, b = (F.get_json_object("odds_summary_json", f"$.odds_{s}_median").try_cast("double") for s in "ab")
    use = F.coalesce((a != 0) & (b != 0), F.lit(False))
    return df.withColumns({"odds_a": F.when(use, a).otherwise(F.col("odds_a")), "odds_b": F.when(use, b).otherwise(F.col("odds_b"))})


# ---- snapshots ------------------------------------------------------------
def latest_snapshot(matches: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each match with its newest snapshot and its snapshot count.

    Newest is by ``snapshot_time`` where the snapshots carry one, then by id: ids that are
    hashes of the prediction's key have no order of their own.
    """
    rest = [c for c in snapshots.columns if c != "match_url"]
    order = F.struct("snapshot_time", "id") if "snapshot_time" in rest else F.col("id")
    last = snapshots.groupBy("match_url").agg(F.max_by(F.struct(*rest), order).alias("s"), F.count("*").alias("num_snapshots"))
    keep = [c for c in rest if c not in matches.columns]
    return matches.join(last.select("match_url", "num_snapshots", *[F.col("s")[c].alias(c) for c in keep]), "match_url")


def version_usage(versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Versions with the number of distinct matches they predicted."""
    used = snapshots.select("version_id", "match_url").distinct().groupBy("version_id").agg(F.count("*").alias("matches_predicted"))
    out = versions.join(used, "version_id", "left")
    return out.withColumn("matches_predicted", F.coalesce("matches_predicted", F.lit(0)).cast("long"))


def model_payload(versions: DataFrame, snapshots: DataFrame, evaluations: DataFrame, limit: int = 25) -> DataFrame:
    """Evaluation rows of the newest versions, metrics rounded to 4 digits."""
    recent = versions.orderBy(F.desc("trained_at")).limit(limit)
    v = version_usage(recent, snapshots).select("version_id", "trained_at", "matches_predicted")
    rounded = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in evaluations.dtypes]
    return evaluations.select(*rounded).join(F.broadcast(v), "version_id")  # at most `limit` versions


def active_first(versions: DataFrame, limit: int) -> DataFrame:
    return versions.orderBy(F.coalesce("is_active", F.lit(0)).desc(), F.desc("trained_at")).limit(limit)


def set_active(versions: DataFrame, version_id: str) -> DataFrame:
    return versions.withColumn("is_active", (F.col("version_id") == version_id).cast("int"))


def odds_history(book_odds: DataFrame, snapshots: DataFrame, match_url) -> DataFrame:
    """All book odds of one match in snapshot order; the filter reaches both scans."""
    s = snapshots.where(F.col("match_url") == match_url).select(F.col("id").alias("snapshot_id"), "version_id", "model_prob_a")
    return book_odds.where(F.col("match_url") == match_url).join(s, "snapshot_id").orderBy("snapshot_id", "bookmaker", "b")


def new_snapshots(predictions: DataFrame, known_matches: DataFrame, seen: str) -> dict[str, DataFrame]:
    """The three appends of a prediction batch: unseen matches, snapshots, book odds.

    Snapshot ids come from the prediction's own key, so a retried batch writes the same ids;
    ``snapshot_time`` orders the batches.
    """
    named = predictions.where(X.text(F.col("match_url").cast("string")) != "")
    fresh = named.select("match_url", "team_a", "team_b", "format", "match_date", "match_time")
    # of a match that repeats in the batch always the same row is stored
    fresh = first_row(fresh, ["match_url"], ["team_a", "team_b", "format", "match_date", "match_time"])
    fresh = fresh.join(known_matches.select("match_url"), "match_url", "left_anti").withColumn("first_seen", F.lit(seen)).withColumn("result", F.lit("Pending"))
    snaps = edge_columns(named.withColumn("id", F.xxhash64("match_url", "version_id", F.lit(seen))).withColumn("snapshot_time", F.lit(seen)))
    books = named.select("match_url", F.xxhash64("match_url", "version_id", F.lit(seen)).alias("snapshot_id"), F.explode("bookmaker_odds").alias("o"))
    books = books.select("snapshot_id", "match_url", "o.*").where((F.coalesce("odds_a", F.lit(0.0)) != 0) & (F.coalesce("odds_b", F.lit(0.0)) != 0))
    ia, ib = 1 / F.col("odds_a"), 1 / F.col("odds_b")
    books = books.select("*", F.round(ia, 4).alias("implied_prob_a"), F.round(ib, 4).alias("implied_prob_b"), F.round(ia + ib, 4).alias("overround"))
    return {"matches": fresh, "snapshots": snaps.drop("bookmaker_odds"), "book_odds": books}


# ---- settlement -----------------------------------------------------------
def index_by_url(corpus: DataFrame, order: str) -> DataFrame:
    """Records keyed by normalised URL; the last one wins.

    Only the greatest ``order`` of each key is grouped; whole records are joined to it, and
    one of those that share key and order is kept.
    """
    keyed = corpus.where(X.text(F.col("url")) != "").withColumn("url_key", X.normalize_url(F.col("url")))
    newest = keyed.groupBy("url_key").agg(F.max(order).alias("newest"))
    same = keyed.join(newest, "url_key").where(F.col(order).eqNullSafe(F.col("newest"))).drop("newest")
    return same.dropDuplicates(["url_key"]).select(*keyed.columns)


def name_match(x: Column, y: Column) -> Column:
    """Equality or containment either way of two non-blank names."""
    a, b = X.normalize_team(x), X.normalize_team(y)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def outcome_parts() -> dict[str, Column]:
    """From a record's own row: what settles it whatever the sides, both sides' map wins and the format."""
    info, fmt = F.lower(F.concat_ws(" ", "match_info")), F.lower(X.text(F.col("format")))
    default_map = F.coalesce(F.exists("hltv_maps", lambda m: F.lower(X.text(m["map_name"])).isin("default", "forfeit")), F.lit(False))
    is_forfeit = info.rlike("forfeit|walkover|withdraw") | fmt.contains("def") | default_map

    def side_wins(first: bool) -> Column:
        def won(m: Column) -> Column:
            # an unplayed map's dash is no number; said here, because a cast that fails is slow
            s1, s2 = (F.nullif(X.strip(m[c]), F.lit("-")).try_cast("int") for c in ("team1_score", "team2_score"))
            return F.coalesce((s1 > s2) if first else (s2 > s1), F.lit(False))
        return F.size(F.filter("hltv_maps", won))

    return {"fixed": F.when(is_forfeit, "forfeit").when(info.contains("cancel"), "cancelled"),
            "wins_1": side_wins(True), "wins_2": side_wins(False), "need": X.required_wins(F.col("format"), F.col("match_info"))}


def majority_winner(w1: Column, w2: Column, need: Column) -> Column:
    """Name of the side with more maps, NULL while neither has enough of them."""
    leader = F.when(w1 > w2, F.col("team1")).otherwise(F.col("team2"))
    return F.when(need.isNull() | ((w1 < need) & (w2 < need)), None).otherwise(F.coalesce(leader, F.lit("")))


def record_outcome() -> tuple[Column, Column]:
    """From a record's own row: what settles it whatever the sides (forfeit, cancelled), and the majority winner's name."""
    fixed, *rest = outcome_parts().values()
    return fixed, majority_winner(*rest)


def to_side(name: Column, team_a: Column, team_b: Column) -> Column:
    return F.when(name_match(name, team_a), "team_a").when(name_match(name, team_b), "team_b").otherwise(F.concat(F.lit("unknown:"), name))


def series_result(df: DataFrame, team_a: Column, team_b: Column, finished: Column | None = None, winner: Column | None = None) -> Column:
    """forfeit / cancelled / declared winner / map-win majority, or NULL when unresolved."""
    fixed, leader = record_outcome()
    declared = F.when(finished & (X.text(winner) != ""), to_side(winner, team_a, team_b)) if finished is not None else F.lit(None).cast("string")
    return F.coalesce(fixed, declared, F.when(leader.isNotNull(), to_side(leader, team_a, team_b)))


def participant_change(team_a: Column, team_b: Column, final_a: Column, final_b: Column) -> Column:
    same = (X.normalize_team(team_a) == X.normalize_team(final_a)) & (X.normalize_team(team_b) == X.normalize_team(final_b))
    return F.when(~same, F.concat(F.lit("participant changed: expected "), team_a, F.lit(" vs "), team_b,
                                  F.lit(", final "), final_a, F.lit(" vs "), final_b))


def eval_reason(status: Column, size_reason: Column) -> Column:
    return F.coalesce(F.when(status != "standard", F.concat(F.lit("roster anomaly: "), status)),
                      F.concat(F.lit("non-standard roster: "), size_reason))


#: Keys up to which a filter by them is broadcast.
FEW_KEYS = 100_000


def settle_join(matches: DataFrame, corpus: DataFrame, order: str = "match_key") -> DataFrame:
    """Ledger matches with their record's result and exclusion reasons (left, by URL id).

    Everything but the names of the sides is decided in the record's row, so only short
    columns are grouped and joined. Where the ledger rows are few, records are first
    filtered by their keys; the check of that size costs one count of the ledger rows.
    """
    from rivalry.operators.clean import roster_size_reason, with_roster_status

    left = matches.withColumn("url_key", X.normalize_url(F.col("match_url").cast("string")))
    keyed = corpus.withColumn("url_key", X.normalize_url(F.col("url")))
    if left.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        keyed = keyed.join(F.broadcast(left.select("url_key")), "url_key", "left_semi")
    recs = with_roster_status(keyed)
    recs = X.settle(recs, size_reason=roster_size_reason(F.col("hltv_maps")), **outcome_parts())
    leader = majority_winner(F.col("wins_1"), F.col("wins_2"), F.col("need"))
    recs = recs.select("url_key", F.col(order).alias("seq"), "team1", "team2", "fixed", leader.alias("leader"),
                       eval_reason(F.col("roster_status"), F.col("size_reason")).alias("eval_reason"))
    j = left.join(last_row(recs, ["url_key"], ["seq"]), "url_key", "left")
    a, b, found = F.col("team_a"), F.col("team_b"), F.col("team1").isNotNull()
    result = F.coalesce("fixed", F.when(F.col("leader").isNotNull(), to_side(F.col("leader"), a, b)))
    j = X.settle(j, resolved=F.when(found, result), change_reason=F.when(found, participant_change(a, b, F.col("team1"), F.col("team2"))))
    return j.drop("seq", "url_key", "fixed", "leader")


def is_due(as_of: str) -> Column:
    start = F.concat(F.col("match_date"), F.lit(" "), F.coalesce("match_time", F.lit("00:00")))
    return F.col("match_date").isNull() | (start <= F.lit(as_of))


def settle_pending(matches: DataFrame, snapshots: DataFrame, corpus: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """New versions of the match and snapshot tables after settling due pending rows.

    Pending rows alone are joined to the corpus; settled rows pass through untouched.
    """
    pending = matches.where((F.col("result") == "Pending") & is_due(as_of))
    done = settle_join(pending.select("match_url", "team_a", "team_b"), corpus).where(F.col("resolved").isNotNull())
    done = done.select("match_url", "resolved", "change_reason", "eval_reason")
    new_matches = matches.join(done.select("match_url", "resolved"), "match_url", "left")
    new_matches = new_matches.withColumn("result", F.coalesce("resolved", "result")).drop("resolved")
    return new_matches, mark_excluded(snapshots, done)


def mark_excluded(snapshots: DataFrame, reasons: DataFrame) -> DataFrame:
    """Prepends exclusion reasons to all snapshots of the flagged matches and invalidates them."""
    flagged = reasons.where(F.coalesce("change_reason", "eval_reason").isNotNull()).select("match_url", "change_reason", "eval_reason")
    j = snapshots.join(flagged, "match_url", "left")
    old = F.col("eval_exclusion_reason")
    first = F.when(F.col("change_reason").isNotNull(), X.prepend_reason(F.col("change_reason"), old)).otherwise(old)
    both = F.when(F.col("eval_reason").isNotNull(), X.prepend_reason(F.col("eval_reason"), first)).otherwise(first)
    hit = F.coalesce("change_reason", "eval_reason").isNotNull()
    return j.select(*[F.when(hit, 0).otherwise(F.col(c)).alias(c) if c == "valid_for_eval"
                      else F.when(hit, both).otherwise(old).alias(c) if c == "eval_exclusion_reason" else F.col(c) for c in snapshots.columns])


def legacy_labels(snapshots: DataFrame) -> DataFrame:
    blank = X.is_blank(F.col("eval_exclusion_reason"))
    reason = F.when((F.col("valid_for_eval") == 0) & blank, "low sample").otherwise(X.normalize_reasons(F.col("eval_exclusion_reason")))
    return snapshots.withColumn("eval_exclusion_reason", reason)


def audit_exclusions(matches: DataFrame, corpus: DataFrame, include_pending: bool = False) -> DataFrame:
    """Flagged ledger matches with their joined reasons (a dry run; ``mark_excluded`` applies it)."""
    rows = matches if include_pending else matches.where(F.col("result") != "Pending")
    j = settle_join(rows.select("match_url", "team_a", "team_b", "result"), corpus)
    return j.select("match_url", "team_a", "team_b", "result", F.concat_ws("; ", "change_reason", "eval_reason").alias("reason")).where(F.col("reason") != "")


# ---- report ---------------------------------------------------------------
def settled_rows(latest: DataFrame) -> DataFrame:
    return latest.where((F.col("valid_for_eval") == 1) & F.col("result").isin("team_a", "team_b"))


def team_calibration_frame(settled: DataFrame) -> DataFrame:
    def row(me: str, other: str, p: Column) -> Column:
        return F.struct(F.col(f"team_{me}").alias("team"), F.col(f"team_{other}").alias("opponent"), p.alias("assigned_prob"),
                        (F.col("result") == f"team_{me}").alias("won"), F.col(f"odds_{me}").alias("odds"))
    p = F.col("model_prob_a")
    return settled.select("match_url", F.inline(F.array(row("a", "b", p), row("b", "a", 1 - p))))


def favourite_frame(settled: DataFrame) -> DataFrame:
    a = F.col("model_prob_a") >= 0.5

    def pick(x: str, y: str) -> Column:
        return F.when(a, F.col(x)).otherwise(F.col(y))
    return settled.select("match_url", pick("team_a", "team_b").alias("team"), pick("team_b", "team_a").alias("opponent"),
                          F.when(a, F.col("model_prob_a")).otherwise(1 - F.col("model_prob_a")).alias("assigned_prob"),
                          (F.col("result") == F.when(a, "team_a").otherwise("team_b")).alias("won"), pick("odds_a", "odds_b").alias("odds"))


def edge_stats(settled: DataFrame) -> DataFrame:
    """Return-on-edge table: all actionable rows, edge buckets, favourite and underdog backing."""
    d = settled if "best_bet" in settled.columns else edge_columns(settled)
    d = d.where(F.col("best_edge") >= 0)
    won = F.col("best_bet") == F.col("result")
    odds = F.when(F.col("best_bet") == "team_a", F.col("odds_a")).otherwise(F.col("odds_b"))
    stake = F.greatest(F.lit(0.0), F.col("best_edge"))
    bucket = None
    for lo, hi, label in C.EDGE_BUCKETS:
        cond = (F.col("best_edge") >= lo) & (F.col("best_edge") < hi)
        bucket = F.when(cond, label) if bucket is None else bucket.when(cond, label)
    fav = (F.col("best_bet") == "team_a") == (F.col("model_prob_a") >= 0.5)
    d = d.select(won.cast("int").alias("won"), F.when(won, odds - 1).otherwise(-1.0).alias("flat"), stake.alias("stake"), "best_edge",
                 F.when(won, stake * (odds - 1)).otherwise(-stake).alias("weighted"), bucket.alias("bucket"),
                 F.when(fav, "Backing favourites").otherwise("Backing underdogs").alias("backing"))
    d = d.select("*", F.explode(F.array_compact(F.array(F.lit("all"), "bucket", "backing"))).alias("slice"))
    n = F.count("*")
    g = d.groupBy("slice").agg(n.alias("bets"), F.sum("won").cast("long").alias("wins"), F.avg("won").alias("win_rate"),
                               (F.avg("best_edge") / 100).alias("avg_edge"), F.avg("flat").alias("flat_roi"),
                               F.try_divide(F.sum("weighted"), F.nullif(F.sum("stake"), F.lit(0.0))).alias("confidence_roi"),
                               F.stddev_samp("flat").alias("sd"))
    t = F.try_divide(F.col("flat_roi"), F.nullif(F.col("sd"), F.lit(0.0)) / F.sqrt("bets"))
    g = g.withColumn("t", F.when(F.col("bets") > 1, t))
    return g.withColumn("p_value", F.nanvl(S.upper_t_p(F.col("t"), (F.col("bets") - 1).cast("double")), F.lit(None))).drop("sd")


def ledger_summary(latest: DataFrame) -> DataFrame:
    """Counts and favourite accuracy, Brier and log loss of the latest snapshots, in one pass."""
    valid = F.col("valid_for_eval") == 1
    settled = valid & F.col("result").isin("team_a", "team_b")
    actual = F.when(F.col("result") == "team_a", 1).otherwise(0)
    p = F.col("model_prob_a")
    model_ok = F.when(p >= 0.5, "team_a").otherwise("team_b") == F.col("result")
    book_ok = F.when(F.coalesce(F.col("odds_a") < F.col("odds_b"), F.lit(False)), "team_a").otherwise("team_b") == F.col("result")
    other = valid & ~F.coalesce(F.col("result").isin("team_a", "team_b", "Pending"), F.lit(False))
    return latest.agg(
        F.count("*").alias("total_matches"), F.count_if(valid).alias("valid_matches"), F.count_if(settled).alias("settled"),
        F.count_if(valid & (F.col("result") == "Pending")).alias("pending"), F.count_if(other).alias("other"),
        F.count_if(~valid).alias("excluded"), F.count_if(settled & model_ok).alias("model_correct"), F.count_if(settled & book_ok).alias("bookie_correct"),
        F.count_if(settled & F.col("odds_a").isNotNull() & F.col("odds_b").isNotNull()).alias("n_with_odds"),
        F.avg(F.when(settled, model_ok.cast("int"))).alias("model_accuracy"), F.avg(F.when(settled, book_ok.cast("int"))).alias("bookie_accuracy"),
        F.avg(F.when(settled, (p - actual) * (p - actual))).alias("brier"), F.avg(F.when(settled, S.log_loss(p, actual, C.LEDGER_CLIP))).alias("log_loss"))


def reason_counts(latest: DataFrame) -> DataFrame:
    """Exclusion reasons and other results with their counts; empty text gets a label."""
    valid = F.col("valid_for_eval") == 1
    other = valid & ~F.coalesce(F.col("result").isin("team_a", "team_b", "Pending"), F.lit(False))
    kind = F.when(~valid, "excluded").when(other, "other_result")
    value = F.when(~valid, F.coalesce(X.filled(F.col("eval_exclusion_reason")), F.lit("unspecified"))).otherwise(F.coalesce(X.filled(F.col("result")), F.lit("unknown")))
    return latest.select(kind.alias("kind"), value.alias("value")).where(F.col("kind").isNotNull()).groupBy("kind", "value").agg(F.count("*").alias("count"))


def biggest_upsets(settled: DataFrame, limit: int = 5) -> DataFrame:
    a = F.col("model_prob_a") >= 0.5
    rows = settled.where(F.col("model_prob_a").isNotNull() & (F.col("result") != F.when(a, "team_a").otherwise("team_b"))).select(
        "match_url", "match_date", "match_time", F.when(a, F.col("team_a")).otherwise(F.col("team_b")).alias("favourite"),
        F.when(a, F.col("team_b")).otherwise(F.col("team_a")).alias("underdog"), F.greatest("model_prob_a", 1 - F.col("model_prob_a")).alias("favourite_prob"))
    return rows.orderBy(F.desc("favourite_prob"), F.desc("match_date"), F.desc("match_time"), "match_url").limit(limit)


def browse(latest: DataFrame, text: str = "", status: str = "all", version: str = "all", valid: int | None = None,
           min_edge: float | None = None, sort: str = "date_desc") -> DataFrame:
    """Filtered and sorted ledger listing; a missing edge counts as 0, as in the original report."""
    d = latest
    if text:
        hay = F.lower(F.concat_ws(" ", "team_a", "team_b", "version_id", F.col("match_url").cast("string")))
        d = d.where(hay.contains(text.lower()))
    if status == "settled":
        d = d.where(F.col("result").isin("team_a", "team_b"))
    elif status == "pending":
        d = d.where(F.col("result") == "Pending")
    elif status == "other":
        d = d.where(~F.col("result").isin("team_a", "team_b", "Pending"))
    if version != "all":
        d = d.where(F.col("version_id") == version)
    if valid is not None:
        d = d.where(F.col("valid_for_eval") == valid)
    if min_edge is not None:
        d = d.where(F.coalesce("best_edge", F.lit(0.0)) >= min_edge)
    when = F.concat_ws(" ", "match_date", "match_time")
    orders = {"date_desc": F.desc(when), "date_asc": F.asc(when), "edge_desc": F.desc(F.coalesce("best_edge", F.lit(-999.0))),
              "confidence_desc": F.desc(F.abs(F.col("model_prob_a") - 0.5)), "team_asc": F.asc("team_a")}
    return d.orderBy(orders[sort], "match_url")


def performance_report(latest: DataFrame) -> dict[str, DataFrame]:
    """All report tables from one settled frame (write or cache ``latest`` first to share it)."""
    from rivalry.operators import metrics as M

    settled = settled_rows(latest)
    team, fav = team_calibration_frame(settled), favourite_frame(settled)
    fixed, adaptive = M.bin_record(M.fixed_bins(team)), M.bin_record(M.adaptive_bins(team))
    return {
        "summary": ledger_summary(latest), "reasons": reason_counts(latest), "calibration_bins": fixed,
        "calibration_summary": M.calibration_summary(fixed), "adaptive_bins": adaptive, "adaptive_summary": M.calibration_summary(adaptive),
        "favourite_bins": M.bin_record(M.fixed_bins(fav, 50, 100, 5)), "favourite_adaptive_bins": M.bin_record(M.adaptive_bins(fav)),
        "edge_stats": edge_stats(settled), "biggest_upsets": biggest_upsets(settled),
    }


#: Table of the report -> (key column or nothing, measures).
REPORT = {
    "summary": (None, ["total_matches", "valid_matches", "settled", "pending", "other", "excluded", "model_correct", "bookie_correct", "n_with_odds",
                       "model_accuracy", "bookie_accuracy", "brier", "log_loss"]),
    "reasons": ("reason", ["count"]),
    **{f"{name}_bins": (key, ["count", "wins", "avg_prob", "observed", "ci_low", "ci_high", "error", "p_value"])
       for name, key in (("calibration", "lo"), ("adaptive", "bin_no"), ("favourite", "lo"), ("favourite_adaptive", "bin_no"))},
    **{f"{name}_summary": (None, ["evaluations", "expected_wins", "observed_wins", "ece", "mce", "signed_bias"])
       for name in ("calibration", "adaptive", "favourite", "favourite_adaptive")},
    "edge_stats": ("slice", ["bets", "wins", "win_rate", "avg_edge", "flat_roi", "confidence_roi", "t"]),
    "biggest_upsets": ("match_url", ["favourite_prob"]),
}


def report_rows(latest: DataFrame) -> DataFrame:
    """The whole report as one long table (part, key, measure, value), every row of every table.

    ``latest`` should be a stored table. The bins are narrow tables of at most a hundred rows,
    stored once for their own rows and their summaries.
    """
    from rivalry.operators import metrics as M
    from rivalry.session import persist_table

    tables = performance_report(latest)
    tables["reasons"] = tables["reasons"].withColumn("reason", F.concat_ws("|", "kind", "value"))
    for name in ("calibration", "adaptive", "favourite", "favourite_adaptive"):
        tables[f"{name}_bins"] = persist_table(tables[f"{name}_bins"])  # at most twenty rows
        tables[f"{name}_summary"] = M.calibration_summary(tables[f"{name}_bins"])
    out = None
    for name, (key, measures) in REPORT.items():
        each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        rows = tables[name].select(F.lit(name).alias("part"), (F.col(key).cast("string") if key else F.lit("")).alias("key"), F.inline(each))
        out = rows if out is None else out.unionByName(rows)
    return out
