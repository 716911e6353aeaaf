"""Pick/ban logs: parsing, pool eras, point-in-time ban signals and back-tests.

A record's lines, pool state and candidates stay in arrays of its own row, so slot
numbers and remaining pools need no window. Only the history counts are shuffled.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.functions import text as X
from rivalry.operators.clean import invalid_veto_reason, text_blob
from rivalry.operators.ordered import ROWS_PER_RANGE, counts_before, counts_in_order, dealt_in_order, in_ranges
from rivalry.session import persist_table

FORMATS = ("bo1", "bo3", "bo5")


_CUT = "\x01"


def parsed_lines(lines: Column) -> Column:
    """Array of (idx, team, action, map) for every line that follows the grammar; map may be NULL.

    One replacement per pattern turns a line into its parts: four for a ban or pick,
    two for the decider, one (the line itself) for anything else.
    """
    def cut(x: Column, pattern: str, groups: int) -> Column:
        return F.split(F.regexp_replace(x, pattern, _CUT.join(f"${i + 1}" for i in range(groups))), _CUT)

    empty = F.array().cast("array<string>")
    parts = F.transform(F.coalesce(lines, empty), lambda x: cut(X.strip(x), C.VETO_ACTION_PATTERN, 4))
    parts = F.transform(parts, lambda p: F.when(F.size(p) == 4, p).otherwise(cut(F.get(p, F.lit(0)), C.VETO_DECIDER_PATTERN, 2)))

    def row(p: Column) -> Column:
        action = F.size(p) == 4
        return F.struct(
            F.get(p, F.lit(0)).try_cast("int").alias("idx"), F.when(action, X.normalize_name(F.get(p, F.lit(1)))).otherwise("").alias("team"),
            F.when(~action, "decider").when(F.lower(F.get(p, F.lit(2))) == "removed", "ban").otherwise("pick").alias("action"),
            X.canonical_map(F.when(action, F.get(p, F.lit(3))).otherwise(F.get(p, F.lit(1)))).alias("map"))

    return F.transform(F.filter(parts, lambda p: F.size(p) > 1), row)


# ---- eras -----------------------------------------------------------------
ERA_SCHEMA = "name string, start date, end date, maps array<string>, events array<string>, era_no int"


def era_frame(spark, eras: list = C.DEFAULT_ERAS) -> DataFrame:
    import datetime

    def day(s):
        return datetime.date.fromisoformat(s) if s else None
    return spark.createDataFrame([(n, day(s), day(e), list(m), list(ev), i + 1) for i, (n, s, e, m, ev) in enumerate(eras)], ERA_SCHEMA)


def with_registry(df: DataFrame, eras: DataFrame) -> DataFrame:
    """Adds the era registry, a dimension of a few rows, as one array column."""
    reg = eras.groupBy().agg(F.sort_array(F.collect_list(F.struct("era_no", "name", "start", "end", "maps", "events"))).alias("eras"))
    return df.crossJoin(F.broadcast(reg))


def _same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def _first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def era_for_date(day: Column, eras: Column) -> Column:
    """The latest-starting era that contains the day."""
    inside = F.filter(eras, lambda e: (e["start"].isNull() | (day >= e["start"])) & (e["end"].isNull() | (day < e["end"])))
    ranked = F.transform(inside, lambda e: F.struct(F.coalesce(e["start"], F.lit("0001-01-01").cast("date")).alias("s"), (-e["era_no"]).alias("o"), e.alias("era")))
    return F.array_max(ranked)["era"]


def resolve_without_hints(df: DataFrame) -> DataFrame:
    """Adds ``explicit`` and ``inferred`` eras from metadata and from the maps named in the veto.

    Needs ``eras``, ``day``, ``event_key`` and ``parsed``; ``map_pool_era`` and ``map_pool`` are optional.
    """
    for name, kind in (("map_pool_era", "string"), ("map_pool", "array<string>")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    eras = F.col("eras")
    df = X.settle(df, observed=F.array_distinct(F.filter(F.transform("parsed", lambda s: s["map"]), lambda m: m.isNotNull())),
                  pool_maps=F.transform("map_pool", lambda m: F.coalesce(X.canonical_map(m), X.strip(m))))
    named = _first(F.filter(eras, lambda e: F.lower(e["name"]) == F.lower(X.strip(F.col("map_pool_era")))))
    exact = _first(F.filter(eras, lambda e: _same_set(e["maps"], F.col("pool_maps"))))
    adhoc = F.struct(F.lit(0).alias("era_no"), F.lit("explicit_match_pool").alias("name"), F.lit(None).cast("date").alias("start"),
                     F.lit(None).cast("date").alias("end"), F.col("pool_maps").alias("maps"), F.array().cast("array<string>").alias("events"))
    listed = _first(F.filter(eras, lambda e: F.exists(e["events"], lambda x: F.lower(x) == F.col("event_key"))))
    explicit = (F.when(X.text(F.col("map_pool_era")) != "", named)
                .otherwise(F.coalesce(F.when(F.size("pool_maps") > 0, F.coalesce(exact, adhoc)), F.when(F.col("event_key") != "", listed))))
    df = X.settle(df, explicit=explicit, fits=F.filter(eras, lambda e: F.size(F.array_except(F.col("observed"), e["maps"])) == 0))
    fits = F.col("fits")
    one_pool = (F.size(fits) > 0) & F.forall(fits, lambda e: _same_set(e["maps"], _first(fits)["maps"]))
    inferred = (F.when(F.size("observed") == 0, None).when(F.size(fits) == 1, _first(fits))
                .when(one_pool, F.when(F.col("day").isNotNull(), era_for_date(F.col("day"), fits)).otherwise(F.element_at(fits, -1))))
    return X.settle(df, inferred=inferred).drop("fits", "pool_maps")


def event_hints(resolved: DataFrame) -> DataFrame:
    """Events whose evidence names exactly one registered era."""
    era = F.coalesce(F.col("explicit"), F.col("inferred"))
    known = resolved.where((F.col("event_key") != "") & (era["era_no"] > 0)).select("event_key", era["name"].alias("name"))
    g = known.groupBy("event_key").agg(F.min("name").alias("hint"), F.max("name").alias("other"))
    return g.where(F.col("hint") == F.col("other")).select("event_key", "hint")


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread: list[str], salts: int = 16) -> DataFrame:
    """Left join on a key of few distinct values; each key is spread over ``salts`` partitions."""
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).join(salted, [key, "salt"], "left").drop("salt")


#: Hints up to which their table is broadcast: one short row per event.
FEW_HINTS = 100_000


def resolve_eras(corpus: DataFrame, eras: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds ``era`` (struct): explicit metadata, veto evidence, event hint, then the date.

    Logs are parsed once: the parsed rows, of which only the columns ``keep`` are carried
    along (all by default), are stored with what metadata and evidence say; hints are summed
    from that table and looked up in it by event. A small table of hints is broadcast, a
    larger one meets the rows in salted parts of the event.
    """
    keep = corpus.columns if keep is None else keep
    df = X.settle(corpus, parsed=parsed_lines(F.col("hltv_vetoes")), day=F.to_date(X.parse_date(F.col("date"))),
                  event_key=F.lower(X.strip(X.text(F.col("event")))))
    known = resolve_without_hints(with_registry(df, eras))
    rest = [c for c in keep if c not in ("parsed", "day", "event_key", "explicit", "inferred")]
    stored = persist_table(known.select(*rest, "parsed", "day", "event_key", "explicit", "inferred"))
    hints = persist_table(event_hints(stored))  # one row per event
    if hints.limit(FEW_HINTS + 1).count() <= FEW_HINTS:
        df = stored.join(F.broadcast(hints), "event_key", "left")
    else:
        df = salted_lookup(stored, hints, "event_key", [c for c, kind in stored.dtypes if "map<" not in kind])
    j = with_registry(df, eras)
    hinted = _first(F.filter("eras", lambda e: F.lower(e["name"]) == F.lower(F.col("hint"))))
    era = F.coalesce(F.col("explicit"), F.col("inferred"), hinted, era_for_date(F.col("day"), F.col("eras")))
    return X.settle(j, era=era).drop("eras", "explicit", "inferred", "hint")


# ---- matches with numbered actions ----------------------------------------
def _map_winner(m: Column) -> Column:
    """The side that won a map of the record, by its normalised name."""
    s1, s2 = (X.strip(m[c]).try_cast("int") for c in ("team1_score", "team2_score"))
    raw = X.normalize_name(F.when(s1 > s2, m["team1"]).when(s2 > s1, m["team2"]))
    a, b = F.col("team_a_id"), F.col("team_b_id")
    near = F.when(F.contains(a, raw) | F.contains(raw, a), a).when(F.contains(b, raw) | F.contains(raw, b), b)
    return F.when(s1.isNull() | s2.isNull() | (s1 == s2), None).when(raw == a, a).when(raw == b, b).otherwise(near)


def veto_matches(corpus: DataFrame, eras: DataFrame) -> DataFrame:
    """One row per usable veto log: teams, format, era, numbered actions, played maps.

    Everything that does not depend on the era is reduced to short columns before the era
    is looked up, so the nested record is read once and never stored.
    """
    df = X.settle(corpus, blob=text_blob(corpus)).where(invalid_veto_reason(F.col("blob")).isNull()).drop("blob")
    df = X.settle(df, team_a_id=X.normalize_name(F.col("team1")), team_b_id=X.normalize_name(F.col("team2")), match_format=X.normalize_format(F.col("format")))
    played = F.filter(F.transform("hltv_maps", lambda m: F.struct(X.canonical_map(m["map_name"]).alias("map"), _map_winner(m).alias("winner"))), lambda p: p["map"].isNotNull())
    df = X.settle(df, played=played)
    df = resolve_eras(df, eras, ["url", "team_a_id", "team_b_id", "match_format", "played"])
    df = df.where(F.col("day").isNotNull() & F.col("era").isNotNull() & (F.col("team_a_id") != "") & (F.col("team_b_id") != "") & F.col("match_format").isin(*FORMATS))
    sides = F.array("team_a_id", "team_b_id")
    pool = F.col("era.maps")
    usable = F.filter("parsed", lambda s: s["map"].isNotNull() & F.array_contains(pool, s["map"]) & ((s["action"] == "decider") | F.array_contains(sides, s["team"])))
    df = X.settle(df, usable=usable)
    maps = F.transform("usable", lambda s: s["map"])
    # a map leaves the pool once: later lines that name it again do not count
    df = X.settle(df, kept=F.filter("usable", lambda s, i: F.array_position(maps, s["map"]) == i + 1))
    kept = F.col("kept")

    def numbered(s: Column, i: Column) -> Column:
        earlier = F.slice(kept, 1, i)
        slot = F.size(F.filter(earlier, lambda e: (e["action"] == "ban") & (e["team"] == s["team"]))) + 1
        return F.struct(s["idx"].alias("global_action_index"), s["action"].alias("action_type"), F.when(s["team"] != "", s["team"]).alias("team_id"),
                        F.when(s["team"] != "", F.when(s["team"] == F.col("team_a_id"), F.col("team_b_id")).otherwise(F.col("team_a_id"))).alias("opponent_id"),
                        s["map"].alias("map_name"), F.when(s["action"] == "ban", slot).alias("team_ban_index"),
                        F.array_except(pool, F.transform(earlier, lambda e: e["map"])).alias("pool_before"))

    df = X.settle(df, actions=F.transform("kept", numbered))
    return df.where(F.size("actions") > 0).select(F.col("url").alias("match_id"), F.col("day").alias("date"), "match_format", "team_a_id", "team_b_id",
                                                  F.col("era.name").alias("era_name"), pool.alias("pool"), "actions", "played")


def action_rows(matches: DataFrame) -> DataFrame:
    return matches.select("match_id", "date", "match_format", "era_name", F.inline("actions"))


# ---- history counts -------------------------------------------------------
def _key(*parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


#: Maps whose counts share a history row, and slots that share one beside the count of all of them.
MAPS, SLOTS = 12, 4
#: Matches up to which a team's history is summed in one task.
CROWD = 100_000


def _slot_group(slot: Column) -> Column:
    return F.floor((slot - 1) / SLOTS).cast("int")


class Places(NamedTuple):
    """Where the counts of a key stand: ``at`` has the first place of each map, ``step`` maps share a row of ``width`` places."""

    at: Column
    step: int
    parts: int

    @property
    def width(self) -> int:
        return self.step * (SLOTS + 1)


#: A team's series, series with picks and bans stand first in the kind that its maps leave free.
SERIES, PICKABLE, BANS = range(3)


def map_places(matches: DataFrame) -> Places:
    """Places for every map that a log or a result names; maps are a short registry."""
    named = F.array_union(F.coalesce(F.transform("actions", lambda a: a["map_name"]), F.array().cast("array<string>")),
                          F.coalesce(F.transform("played", lambda p: p["map"]), F.array().cast("array<string>")))
    names = sorted(r["map"] for r in matches.select(F.explode(named).alias("map")).where("map IS NOT NULL").distinct().collect())
    step = max(3, min(MAPS, len(names)))
    first = [F.lit(x) for i, m in enumerate(names) for x in (m, i // step * step * (SLOTS + 1) + i % step)]
    return Places(F.create_map(*first).cast("map<string,int>"), step, max(1, -(-len(names) // step)))


def _numbered(matches: DataFrame, places: Places) -> DataFrame:
    """Bans, picks and results of a match by the first places of their maps, and the groups of slots it asks for."""
    played = F.coalesce("played", F.array().cast(matches.schema["played"].dataType))

    def chosen(kind: str) -> Column:
        return F.filter("actions", lambda a: a["action_type"] == kind)

    def named(actions: Column) -> Column:
        return F.transform(F.filter(actions, lambda a: a["map_name"].isNotNull()), lambda a: F.struct(
            a["team_id"].alias("team"), F.try_element_at(places.at, a["map_name"]).alias("at"),
            _slot_group(a["team_ban_index"]).alias("group"), (F.pmod(a["team_ban_index"] - 1, F.lit(SLOTS)) + 1).alias("slot")))

    # a map listed twice credits its last known winner to every listing
    def last_winner(m: Column) -> Column:
        return F.try_element_at(F.filter(played, lambda q: (q["map"] == m) & q["winner"].isNotNull()), F.lit(-1))["winner"]

    results = F.transform(F.filter(played, lambda p: p["map"].isNotNull()), lambda p: F.struct(F.try_element_at(places.at, p["map"]).alias("at"), last_winner(p["map"]).alias("winner")))
    df = X.settle(matches, all_bans=chosen("ban"), picks=named(chosen("pick")), results=results)
    return X.settle(df, bans=named(F.col("all_bans")), banners=F.transform("all_bans", lambda a: a["team_id"]),
                    groups=F.array_distinct(F.concat(F.array(F.lit(0)), F.transform("all_bans", lambda a: _slot_group(a["team_ban_index"]))))).drop("all_bans")


def _row(places: Places, key: Column, part: int, found: Column) -> Column:
    """A row with what a match adds at each place of a part of the maps, from places that repeat."""
    width = places.width
    here = found if places.parts == 1 else F.transform(F.filter(found, lambda x: (x >= part * width) & (x < (part + 1) * width)), lambda x: x - part * width)
    adds = F.map_from_entries(F.transform(F.array_distinct(here), lambda x: F.struct(x.alias("place"), F.size(F.filter(here, lambda y: y == x)).alias("n"))))
    return F.struct(key.alias("key"), F.lit(part).alias("part"), adds.alias("adds"))


def _slot_rows(places: Places, key, mine, overall: bool) -> Column:
    """Rows per group of slots, from the bans that ``mine`` keeps."""
    def found(g: Column) -> Column:
        here = F.filter("bans", mine)
        slots = F.transform(F.filter(here, lambda a: a["group"] == g), lambda a: a["at"] + a["slot"] * places.step)
        return F.concat(slots, F.when(g == 0, F.transform(here, lambda a: a["at"])).otherwise(F.array().cast("array<int>"))) if overall else slots

    return F.flatten(F.transform("groups", lambda g: F.array(*[_row(places, key(g), p, found(g)) for p in range(places.parts)])))


def team_rows(numbered: DataFrame, places: Places, teams: Column) -> DataFrame:
    """One row per team of a match, and one per team, format and group of slots.

    * team: bans, picks, plays, wins of each map; series, series with picks, bans
    * team, format, group of slots: bans of each map in any slot, then in each slot of the group
    """
    era, fmt, sides = F.col("era_name"), F.col("match_format"), F.array("team_a_id", "team_b_id")
    step = places.step

    def repeated(found: Column, times: Column) -> Column:
        return F.flatten(F.transform(found, lambda x: F.array_repeat(x, times)))

    def rows(t: Column) -> Column:
        times = F.size(F.filter(sides, lambda x: x == t))
        whole = F.array_compact(F.array(F.lit(SLOTS * step + SERIES), F.when(fmt != "bo1", F.lit(SLOTS * step + PICKABLE))))
        found = F.concat(
            F.transform(F.filter("bans", lambda a: a["team"] == t), lambda a: a["at"]),
            F.transform(F.filter("picks", lambda a: a["team"] == t), lambda a: a["at"] + step),
            repeated(F.concat(F.transform("results", lambda r: r["at"] + 2 * step), whole), times),
            F.transform(F.filter("results", lambda r: r["winner"] == t), lambda r: r["at"] + 3 * step),
            F.transform(F.filter("banners", lambda b: b == t), lambda b: F.lit(SLOTS * step + BANS)))
        return F.concat(F.array(*[_row(places, _key("map", era, t), p, found) for p in range(places.parts)]),
                        _slot_rows(places, lambda g: _key("slot", era, t, fmt, g), lambda a: a["team"] == t, True))

    return numbered.select("match_id", "date", "range_no", F.inline(F.flatten(F.transform(teams, rows))))


def everybody_rows(numbered: DataFrame, places: Places) -> DataFrame:
    """One row per format and group of slots: everybody's bans of each map in each slot of the group."""
    rows = _slot_rows(places, lambda g: _key("everybody", F.col("era_name"), F.col("match_format"), g), lambda a: F.lit(True), False)
    return numbered.select("match_id", "date", "range_no", F.inline(rows))


def _teams() -> Column:
    return F.array_distinct(F.array("team_a_id", "team_b_id"))


def history_rows(matches: DataFrame) -> DataFrame:
    """What a match adds to the history, and at the same time the history its bans ask for.

    A row holds the counts of up to ``MAPS`` maps as a map from places to numbers, so a match
    is some five rows. Rows that add nothing only ask.
    """
    places = map_places(matches)
    numbered = _numbered(matches, places)
    return team_rows(numbered, places, _teams()).unionByName(everybody_rows(numbered, places))


def _in_day_ranges(matches: DataFrame) -> DataFrame:
    """Adds ``range_no``: one range, unless a day has more matches than a range holds."""
    busiest = matches.groupBy("date").count().agg(F.max("count")).first()[0] or 0
    if busiest > ROWS_PER_RANGE:
        return matches.join(in_ranges(matches.select("match_id").distinct(), "match_id"), "match_id")
    # zero, but no literal: rows stay dealt out by it
    return matches.withColumn("range_no", F.pmod(F.length("match_id"), F.lit(1)))


def with_history(matches: DataFrame, days: int | None = C.VETO_DAYS) -> DataFrame:
    """Adds ``counts``: history before the match in (date, match_id) order, within ``days`` (same day included).

    ``matches`` should be a stored table. A key of ``counts`` holds the numbers of its rows of
    ``history_rows`` by place; ``places`` and ``step`` say where a map's numbers stand. A team's
    history is summed in one task; what everybody banned, and teams with more than ``CROWD``
    matches, are summed by day first, and by ranges of ids where a day has very many matches.
    """
    places, teams = map_places(matches), _teams()
    placed = _in_day_ranges(matches.where("match_id IS NOT NULL AND date IS NOT NULL"))
    numbered = _numbered(placed, places)
    # a short list: at most two teams for every CROWD matches
    crowds = [r[0] for r in placed.select(F.explode(teams).alias("t")).groupBy("t").count().where(F.col("count") > CROWD).collect()]
    by_day, small = everybody_rows(numbered, places), teams
    if crowds:
        by_day = by_day.unionByName(team_rows(numbered, places, F.filter(teams, lambda t: t.isin(crowds))))
        small = F.filter(teams, lambda t: t.isNull() | ~t.isin(crowds))
    names, keys = [f"n{i}" for i in range(places.width)], ["key", "part"]
    ids = [*keys, "date", "match_id"]
    wide = [F.coalesce(F.try_element_at("adds", F.lit(i)), F.lit(0)).alias(n) for i, n in enumerate(names)]
    in_order = counts_in_order(dealt_in_order(team_rows(numbered, places, small).drop("range_no"), keys).select(*ids, "day_no", *wide), keys, names, days)
    asof = in_order.unionByName(counts_before(by_day.select(*ids, "range_no", *wide), None, keys, names, days))
    known = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.struct((F.col("part") * places.width + i).alias("place"), F.col(n).alias("n"))) for i, n in enumerate(names)]))
    asof = X.settle(asof, known=known).where(F.size("known") > 0).select("match_id", "date", "key", "known")
    if places.parts > 1:
        asof = asof.groupBy("match_id", "date", "key").agg(F.flatten(F.collect_list("known")).alias("known"))
    # some five entries a match
    entry = F.struct("key", F.map_from_entries("known").alias("n"))
    per = asof.groupBy("match_id", "date").agg(F.map_from_entries(F.collect_list(entry)).alias("counts"))
    return _full(_slim(matches).join(per, ["match_id", "date"], "left")).withColumns({"places": places.at, "step": F.lit(places.step)})


def _slim(matches: DataFrame) -> DataFrame:
    """Pools before an action as places in the match's pool where they can be, so that fewer bytes travel."""
    def left(a: Column) -> Column:
        return F.transform(a["pool_before"], lambda m: F.array_position("pool", m).cast("int"))

    both = F.transform("actions", lambda a: F.struct(a.alias("a"), left(a).alias("left")))
    here = F.transform(both, lambda x: F.struct(x["a"].alias("a"), F.when((F.size("pool") < 128) & F.forall(x["left"], lambda i: i > 0), x["left"].cast("array<tinyint>")).alias("left")))
    return X.settle(matches, actions=F.transform(here, lambda x: F.struct(
        F.when(x["left"].isNull(), x["a"]).otherwise(x["a"].withField("pool_before", F.lit(None).cast("array<string>"))).alias("a"), x["left"].alias("left"))))


def _full(slim: DataFrame) -> DataFrame:
    """Undoes ``_slim``."""
    pool_before = lambda x: F.coalesce(x["a"]["pool_before"], F.transform(x["left"], lambda i: F.get("pool", i.cast("int") - 1)))
    return X.settle(slim, actions=F.transform("actions", lambda x: x["a"].withField("pool_before", pool_before(x)))).select(*slim.columns)


# ---- signals and models ---------------------------------------------------
def smoothed_probability(count: Column, total: Column, pool_size: Column, alpha: float) -> Column:
    return (count + alpha / F.greatest(pool_size, F.lit(1))) / (total + alpha)


def smoothed_rate(won: Column, total: Column, prior: float, alpha: float) -> Column:
    if alpha <= 0:
        return F.when(total > 0, won / F.nullif(total, F.lit(0))).otherwise(F.lit(prior))
    return (won + prior * alpha) / (total + alpha)


def raw_rate(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / F.nullif(total, F.lit(0))).otherwise(0.0)


def ban_signals(matches: DataFrame) -> DataFrame:
    """One row per ban with ``signals``: an array over the remaining pool."""
    rows = matches.select("match_id", "date", "match_format", "era_name", "counts", "places", "step", F.explode(F.filter("actions", lambda a: a["action_type"] == "ban")).alias("a"))
    rows = rows.select("match_id", "date", "match_format", "era_name", "counts", "places", "step", "a.*").withColumnRenamed("pool_before", "pool")
    era, fmt, team, opp, slot, pool = (F.col(c) for c in ("era_name", "match_format", "team_id", "opponent_id", "team_ban_index", "pool"))

    def at_key(*parts) -> Column:
        return F.try_element_at("counts", _key(*parts))

    def n(counts: str, place: Column) -> Column:
        return F.coalesce(F.try_element_at(counts, place), F.lit(0).cast("long"))

    group, kind = _slot_group(slot), F.pmod(slot - 1, F.lit(SLOTS)) + 1
    # one lookup per kind of row, then its numbers
    rows = X.settle(
        rows, at=F.transform(pool, lambda m: F.try_element_at("places", m)), own=at_key("map", era, team), opp=at_key("map", era, opp),
        own_firsts=at_key("slot", era, team, fmt, F.lit(0)), opp_firsts=at_key("slot", era, opp, fmt, F.lit(0)),
        own_slots=at_key("slot", era, team, fmt, group), everybody=at_key("everybody", era, fmt, group)).drop("counts", "places")

    def each(counts: str, kind: Column | int) -> Column:
        return F.transform("at", lambda at: n(counts, at + F.col("step") * kind))

    rows = X.settle(
        rows, own_slot=each("own_slots", kind), own_first=each("own_firsts", 1), opp_first=each("opp_firsts", 1), eventual=each("own_firsts", 0),
        ban=each("own", 0), glob=each("everybody", kind), pick=each("own", 1), play=each("own", 2), win=each("own", 3), opp_play=each("opp", 2), opp_win=each("opp", 3),
        **{c: n("own", F.col("step") * SLOTS + i) for i, c in ((SERIES, "series"), (PICKABLE, "pickable"), (BANS, "prior_team_bans"))}).drop("at", "step", "own", "opp", "own_firsts", "opp_firsts", "own_slots", "everybody")
    arrays = ["own_slot", "own_first", "opp_first", "eventual", "ban", "glob"]
    rows = X.settle(rows, **{f"{c}_total": F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x) for c in arrays})

    def signal(m: Column, i: Column) -> Column:
        def at(c: str) -> Column:
            return F.get(F.col(c), i)

        def prob(c: str, alpha: float) -> Column:
            return smoothed_probability(at(c), F.col(f"{c}_total"), F.size(pool), alpha)

        play, pick = smoothed_rate(at("play"), F.col("series"), 0.0, 0.0), smoothed_rate(at("pick"), F.col("pickable"), 0.0, 0.0)
        return F.struct(
            m.alias("map_name"), prob("own_slot", 4.0).alias("slot"), prob("eventual", 4.0).alias("eventual"), prob("ban", 7.0).alias("team_ban"), prob("glob", 5.0).alias("global"),
            (0.65 * (1 - play) + 0.35 * (1 - pick)).alias("avoidance"), smoothed_rate(at("opp_win"), at("opp_play"), 0.5, 4.0).alias("threat"),
            (1 - smoothed_rate(at("win"), at("play"), 0.5, 4.0)).alias("own_loss"), play.alias("own_play_rate"), pick.alias("own_pick_rate"),
            raw_rate(at("own_first"), F.col("own_first_total")).alias("raw_first_slot_rate"), F.col("own_first_total").alias("raw_first_slot_sample"),
            raw_rate(at("opp_first"), F.col("opp_first_total")).alias("opponent_raw_first_slot_rate"), F.col("opp_first_total").alias("opponent_raw_first_slot_sample"))

    rows = X.settle(rows, signals=F.transform("pool", signal))
    return rows.select("match_id", "date", "match_format", "team_id", "opponent_id", "team_ban_index", "map_name", "pool", "prior_team_bans", "signals")


MODEL_SCHEMA = "model string, weights map<string,double>"


def weight_grid(values: dict[str, list[float]] = C.WEIGHT_GRID) -> dict[str, dict[str, float]]:
    """Every combination of the listed weights whose sum stays within one, numbered in order."""
    combos = [dict(zip(values, c)) for c in product(*values.values())]
    rests = [1.0 - sum(c.values()) for c in combos]
    usable = [{**c, "global": max(r, 0.0)} for c, r in zip(combos, rests) if r >= -1e-9]
    return {f"grid_{i:04d}": w for i, w in enumerate(usable, 1)}


def model_frame(spark, models: dict[str, dict[str, float]] = C.PRESET_BAN_MODELS) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in models.items()], MODEL_SCHEMA)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body reads it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


#: Weights of a model that is not in its map count as these.
_DEFAULTS = {**{k: 0.0 for k in [*C.BAN_SIGNALS, "current_like", "lock_probability"]}, "lock_min_sample": 10.0, "lock_min_rate": 0.75, "shared_lock_min_sample": 10.0}


def score_models(signals: DataFrame, models: DataFrame) -> DataFrame:
    """Every ban row under every model: ``probs`` over the pool (models are a bounded list).

    What no weight enters is computed once per ban, before the models multiply the rows, and
    each weight is read from its map once per model. ``base`` holds the scores floored at
    1e-12 and divided by their sum.
    """
    def weight(k: str) -> Column:
        return F.coalesce(F.try_element_at("weights", F.lit(k)), F.lit(_DEFAULTS[k]))

    known = F.struct((F.size(F.map_keys("weights")) == 0).alias("none"), F.try_element_at("weights", F.lit("shared_lock_min_rate")).alias("shared_lock_min_rate"),
                     *[weight(k).alias(k) for k in _DEFAULTS])
    w = {k: F.col("w")[k] for k in ["none", "shared_lock_min_rate", *_DEFAULTS]}

    rare = lambda s: (s["own_play_rate"] < 0.05) & (s["own_pick_rate"] < 0.01)
    rows = X.settle(signals, perma=F.exists("signals", rare))
    current = F.transform("signals", lambda s: F.when(
        (F.col("team_ban_index") == 1) & F.col("perma"), F.when(rare(s), s["threat"]).otherwise(0.0001)).otherwise(s["threat"] + s["own_loss"]))
    # lock: the first pool map with the highest raw first-slot rate
    best = F.array_max(F.transform("signals", lambda s, i: F.struct(s["raw_first_slot_rate"].alias("rate"), (-i).alias("neg"), s.alias("s"))))
    rows = X.settle(rows, current=current, best=best).drop("perma")
    rows = rows.crossJoin(F.broadcast(models.withColumn("w", known).drop("weights")))

    weighted = F.transform("signals", lambda s: reduce(lambda acc, k: acc + w[k] * s[k], C.BAN_SIGNALS, F.lit(0.0)))
    scores = F.when(w["none"], F.transform("signals", lambda s: F.lit(1.0))).when(w["current_like"] > 0, F.col("current")).otherwise(weighted)
    b = F.col("best.s")
    locked = (w["lock_probability"] > 0) & (F.col("team_ban_index") == 1) & (b["raw_first_slot_sample"] >= w["lock_min_sample"]) & (b["raw_first_slot_rate"] >= w["lock_min_rate"])
    shared = (w["shared_lock_min_rate"].isNotNull() & (b["opponent_raw_first_slot_sample"] >= w["shared_lock_min_sample"])
              & (b["opponent_raw_first_slot_rate"] >= w["shared_lock_min_rate"]))
    floor = F.transform(scores, lambda s: F.greatest(s, F.lit(1e-12)))
    rows = X.settle(rows, base=_let(floor, lambda f: _let(_total(f), lambda t: F.transform(f, lambda s: s / t))),
                    lock_at=F.when(locked & ~F.coalesce(shared, F.lit(False)), -F.col("best.neg")))
    at, lp = F.col("lock_at"), w["lock_probability"]
    adjusted = _let(_total(F.col("base")) - F.get("base", at), lambda others: F.transform("base", lambda p, i: F.when(i == at, lp).when(
        others > 0, (1 - lp) * p / others).otherwise((1 - lp) / F.greatest(F.size("base") - 1, F.lit(1)))))
    rows = X.settle(rows, probs=F.when(at.isNull(), F.col("base")).otherwise(adjusted))
    return rows.drop("best", "current", "w")


def actual_rank(rows: DataFrame) -> DataFrame:
    """Probability and rank of the banned map; ties keep pool order."""
    at = F.array_position("pool", F.col("map_name")).cast("int") - 1
    known = F.struct(at.alias("at"), F.get("probs", at).alias("p"))
    ahead = _let(known, lambda k: F.size(F.filter("probs", lambda x, i: (x > k["p"]) | ((x == k["p"]) & (i < k["at"])))))
    return X.settle(rows, actual_prob=F.greatest(F.get("probs", at), F.lit(1e-12)), rank=ahead + 1)


def score_summary(ranked: DataFrame) -> DataFrame:
    """Overall and per (format, first/later ban) scores of each model, as grouping sets."""
    d = ranked.select("model", F.col("match_format").alias("format"), F.when(F.col("team_ban_index") == 1, "first_ban").otherwise("later_ban").alias("slot"), "actual_prob", "rank")
    g = d.groupingSets([["model"], ["model", "format", "slot"]], "model", "format", "slot").agg(
        F.count("*").alias("rows"), F.avg(-F.log("actual_prob")).alias("log_loss"), F.avg((F.col("rank") == 1).cast("int")).alias("top1"),
        F.avg((F.col("rank") <= 2).cast("int")).alias("top2"), F.avg("actual_prob").alias("mean_actual_prob"))
    return g.select("model", F.coalesce("format", F.lit("all")).alias("format"), F.coalesce("slot", F.lit("all")).alias("slot"), "rows", "log_loss", "top1", "top2", "mean_actual_prob")


def veto_backtest(matches: DataFrame, models: DataFrame, days: int | None = C.VETO_DAYS, min_prior_bans: int = 0) -> DataFrame:
    """Walk-forward scores of ban models over all parsed matches."""
    signals = ban_signals(with_history(matches, days)).where(F.col("prior_team_bans") >= min_prior_bans)
    return score_summary(actual_rank(score_models(signals, models)))


def model_ranking(summary: DataFrame, top: int = 5) -> DataFrame:
    """Splits of the models that lead the overall log-loss ranking."""
    # rounded: models whose losses are equal but for the order of summation rank by name
    loss = F.round(F.coalesce("log_loss", F.lit(999.0)), 9)
    lead = summary.where((F.col("format") == "all") & (F.col("slot") == "all")).orderBy(loss, "model").limit(top).select("model")
    return summary.where((F.col("format") != "all") | (F.col("slot") != "all")).join(F.broadcast(lead), "model", "left_semi")


# ---- team histories as of a date ------------------------------------------
def team_map_stats(maps: DataFrame, as_of: str, days: int | None = C.VETO_DAYS, pool: list[str] = C.ACTIVE_POOL) -> DataFrame:
    """Win, pick, play and loss rates per team and pool map; teams without maps are absent."""
    day = F.to_date("date")
    d = maps.where(day <= F.lit(as_of).cast("date"))
    if days:
        d = d.where(day >= F.date_sub(F.lit(as_of).cast("date"), days))
    # read twice: the maps and the series of the window
    d = persist_table(d.select("match_id", "team_a_id", "team_b_id", "match_format", "map_name", "winner_id", "team_a_picked", "team_b_picked"))

    def view(s: str) -> Column:
        me = F.col(f"team_{s}_id")
        return F.struct(me.alias("team"), (F.col("winner_id") == me).cast("int").alias("won"), F.col(f"team_{s}_picked").cast("int").alias("picked"))

    per_map = d.select("map_name", F.inline(F.array(view("a"), view("b")))).groupBy("team", "map_name").agg(
        F.count("*").alias("sample"), F.sum("won").alias("wins"), F.sum("picked").alias("picks"))
    series = d.groupBy("match_id", "team_a_id", "team_b_id", "match_format").agg(F.lit(1).alias("one"))
    totals = series.select(F.explode(F.array("team_a_id", "team_b_id")).alias("team"), (F.col("match_format") != "bo1").cast("int").alias("pickable")).groupBy("team").agg(
        F.count("*").alias("total_series"), F.sum("pickable").alias("pickable_series"))
    grid = totals.withColumn("map_name", F.explode(F.array(*[F.lit(m) for m in pool])))
    j = grid.join(per_map, ["team", "map_name"], "left").fillna(0, ["sample", "wins", "picks"])
    win = F.when(F.col("sample") > 0, F.col("wins") / F.nullif("sample", F.lit(0))).otherwise(0.5)
    return j.select("team", "map_name", win.alias("win_rate"), ((F.col("picks") + 1) / (F.col("pickable_series") + len(pool))).alias("pick_rate"),
                    (F.col("sample") / F.col("total_series")).alias("play_rate"), (1 - win).alias("loss_rate"), F.col("sample").cast("long").alias("sample"),
                    F.col("picks").cast("long").alias("picks"), "total_series", "pickable_series")


def ban_history(corpus: DataFrame, cutoff: str | None = None, pool: list[str] = C.ACTIVE_POOL) -> DataFrame:
    """Ban counts per team: by (format, slot, map), by (format, map) per series, by map, and series.

    Slots count every registered map; only maps of the current pool are reported.
    """
    df = X.settle(corpus, blob=text_blob(corpus), day=F.to_date(X.parse_date(F.col("date"))))
    df = df.where(invalid_veto_reason(F.col("blob")).isNull() & F.col("day").isNotNull()).drop("blob")
    if cutoff:
        df = df.where(F.col("day") >= F.lit(cutoff).cast("date"))
    df = X.settle(df, parsed=parsed_lines(F.col("hltv_vetoes")), fmt=X.normalize_format(F.col("format")),
                  sides=F.array_distinct(F.array(X.normalize_name(F.col("team1")), X.normalize_name(F.col("team2")))))
    df = df.where(F.col("fmt").isin(*FORMATS)).select("fmt", "parsed", F.explode("sides").alias("team"))
    mine = F.filter("parsed", lambda s: (s["team"] == F.col("team")) & (s["action"] == "ban") & s["map"].isNotNull())
    df = X.settle(df, bans=F.transform(mine, lambda s: s["map"])).where(F.size("bans") > 0)
    in_pool = F.array(*[F.lit(m) for m in pool])

    def row(kind: str, fmt: Column, slot: Column, m: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), fmt.cast("string").alias("match_format"), slot.cast("int").alias("slot"), m.cast("string").alias("map_name"))

    none = F.lit(None)
    slots = F.filter(F.transform("bans", lambda m, i: row("slot", F.col("fmt"), i + 1, m)), lambda r: F.array_contains(in_pool, r["map_name"]))
    overall = F.filter(F.transform("bans", lambda m: row("team", none, none, m)), lambda r: F.array_contains(in_pool, r["map_name"]))
    eventual = F.transform(F.array_intersect(F.array_distinct("bans"), in_pool), lambda m: row("eventual", F.col("fmt"), none, m))
    series = F.array(row("series", none, none, none))
    return df.select("team", F.inline(F.concat(slots, overall, eventual, series))).groupBy("team", "kind", "match_format", "slot", "map_name").agg(F.count("*").alias("n"))
