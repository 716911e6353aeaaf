"""Readers: nested JSON corpus, parquet tables, entity lists, eras and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.functions import text as X
from rivalry.operators.ordered import first_row

RAW_SCHEMA = """
url string, date string, event string, format string, team1 string, team2 string, error string,
map_pool_era string, map_pool array<string>, winner string, match_info array<string>, hltv_vetoes array<string>,
team_ranks map<string, struct<world_rank: string, vrs_before_rank: string, vrs_before_points: string, vrs_after_rank: string, vrs_after_points: string>>,
player_stats array<map<string,string>>,
hltv_maps array<struct<map_name: string, team1: string, team1_score: string, team2: string, team2_score: string, picker: string,
  stats_url: string, round_history: string,
  halves: array<struct<team1_score: int, team1_side: string, team2_score: int, team2_side: string>>,
  player_stats: array<struct<player: string>>>>,
_corrupt_record string
"""


def read_matches(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested records from JSON; malformed input is an error, not a silent NULL row.

    One object per line splits over tasks and is the form for large corpora;
    ``multi_line`` reads a file that is one array.
    """
    raw = spark.read.schema(RAW_SCHEMA).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    # a filter stays in the plan whatever columns are selected; it names a data column too, because
    # Spark refuses to read the error column alone
    shown = F.concat(F.lit("malformed record: "), F.substring("_corrupt_record", 1, 200), F.coalesce("url", F.lit("")))
    good = F.when(F.col("_corrupt_record").isNotNull(), F.raise_error(shown).cast("boolean")).otherwise(True)
    return raw.where(good).drop("_corrupt_record")


def read_table(spark: SparkSession, path: str, required: list[str], merge: bool = False) -> DataFrame:
    """Parquet scan that fails early when a required column is absent.

    ``merge`` reads the footer of every file to unite their schemas; it is off by default.
    """
    df = spark.read.option("mergeSchema", merge).parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks required columns: {', '.join(missing)}")
    return df


def entity_list(rows: DataFrame, column: str = "team", order: str = "pos") -> DataFrame:
    """Normalised name with the spelling seen first; blanks are left out."""
    named = rows.select(X.squash_spaces(F.col(column)).alias("name"), order).where(F.col("name") != "")
    return first_row(named.withColumn("team_key", X.normalize_team(F.col("name"))), ["team_key"], [order]).select("team_key", "name")


def read_entity_list(spark: SparkSession, path: str) -> DataFrame:
    """CSV with exactly one ``team`` column."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path)
    if df.columns.count("team") != 1:
        raise ValueError(f"{path}: expected exactly one 'team' column")
    out = entity_list(df.withColumn("pos", F.monotonically_increasing_id()))
    if out.isEmpty():
        raise ValueError(f"{path} has no usable teams")
    return out


def clean_eras(rows: DataFrame) -> DataFrame:
    """Canonical map names and trimmed events; unnamed eras are numbered."""
    return rows.select(
        F.coalesce(X.filled(F.col("name")), F.concat(F.lit("era_"), F.col("era_no"))).alias("name"), F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"),
        F.transform("maps", lambda m: F.coalesce(X.canonical_map(m), X.strip(m))).alias("maps"),
        F.filter(F.transform(F.coalesce("events", F.array().cast("array<string>")), lambda e: X.strip(e)), lambda e: e != "").alias("events"), F.col("era_no").cast("int").alias("era_no"))


def read_eras(spark: SparkSession, path: str) -> DataFrame:
    """JSON list of map-pool eras (a small registry)."""
    raw = spark.read.schema("name string, start string, end string, maps array<string>, events array<string>").option("multiLine", True).json(path)
    return clean_eras(raw.withColumn("era_no", F.monotonically_increasing_id() + 1))


def aliases_for_event(rows: DataFrame, page_path: str) -> DataFrame:
    """Alias rows of an event page and of the pages above it."""
    def path(c) -> F.Column:
        return F.lower(F.regexp_replace(F.replace(X.strip(X.text(c)), F.lit(" "), F.lit("_")), r"/+$", ""))

    p = F.col("event_path")
    page = F.lower(F.lit(page_path.replace(" ", "_").rstrip("/")))
    d = rows.select(path(p).alias("event_path"), X.strip(F.col("alias")).alias("alias"), X.strip(F.col("team")).alias("team"))
    return d.where((F.col("event_path") != "") & (F.col("alias") != "") & (F.col("team") != "") & ((page == F.col("event_path")) | F.startswith(page, F.concat("event_path", F.lit("/")))))


def read_aliases(spark: SparkSession, path: str, page_path: str) -> DataFrame:
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    if not {"event_path", "alias", "team"} <= set(df.columns):
        raise ValueError(f"{path} must have event_path, alias and team columns")
    return aliases_for_event(df, page_path)


def resolve_aliases(labels: DataFrame, known: DataFrame, event_aliases: DataFrame, global_aliases: dict[str, str]) -> DataFrame:
    """Event alias, known name, global alias, else the label itself; keys ignore punctuation and noise words.

    ``labels`` has (row_id, label). Lookups are spread joins, since one label may be very frequent.
    """
    from rivalry.operators.veto import salted_lookup

    d = labels.withColumn("k", X.alias_key(F.col("label")))
    kn = known.groupBy(X.alias_key(F.col("name")).alias("k")).agg(F.max("name").alias("known_name"))
    ev = event_aliases.groupBy(X.alias_key(F.col("alias")).alias("k")).agg(F.max("team").alias("event_team"))
    d = salted_lookup(salted_lookup(d, ev, "k", ["row_id"]), kn, "k", ["row_id"])
    glob = F.create_map(*[F.lit(x) for kv in global_aliases.items() for x in kv])
    d = d.withColumn("alias_team", F.coalesce(F.col("event_team"), F.when(F.col("known_name").isNull(), F.try_element_at(glob, F.col("k")))))
    d = d.withColumn("k", X.alias_key(F.col("alias_team")))
    d = salted_lookup(d, kn.withColumnRenamed("known_name", "canonical"), "k", ["row_id"])
    out = F.coalesce(F.when(F.col("alias_team").isNotNull(), F.coalesce("canonical", "alias_team")), "known_name", F.trim("label"))
    return d.select("row_id", "label", out.alias("team"))


def whitelist_semi(matches: DataFrame, whitelist: DataFrame, mode: str = "any", max_list: int = 1_000_000) -> DataFrame:
    """Contests with one (any) or both teams on the list.

    The list is a hand-kept file; up to ``max_list`` rows are broadcast, more are joined by key.
    """
    small = whitelist.limit(max_list + 1).count() <= max_list
    keys = whitelist.select("team_key")
    keys = F.broadcast(keys) if small else keys
    m = matches.withColumns({"k1": X.normalize_team(F.col("team1")), "k2": X.normalize_team(F.col("team2"))})
    a = keys.select(F.col("team_key").alias("k1"), F.lit(True).alias("in1"))
    b = keys.select(F.col("team_key").alias("k2"), F.lit(True).alias("in2"))
    j = m.join(a, "k1", "left").join(b, "k2", "left")
    i1, i2 = F.coalesce("in1", F.lit(False)), F.coalesce("in2", F.lit(False))
    return j.where((i1 & i2) if mode == "both" else (i1 | i2)).select(*matches.columns)
