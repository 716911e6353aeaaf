"""String, name, date and keyword functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry import constants as C

_SPACE = " \t\n\r\f\x0b"


def strip(c: Column, chars: str = _SPACE) -> Column:
    return F.btrim(c, F.lit(chars))


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds derived columns that are computed once per row.

    A generator is a boundary for filter pushdown and projection merging, so costly
    array and regex expressions are not repeated in every later filter.
    """
    old = [c for c in df.columns if c not in columns]
    return df.select(*old, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def filled(c: Column) -> Column:
    """NULL instead of an empty string."""
    return F.when(c != "", c)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_name(c: Column) -> Column:
    return F.upper(strip(text(c)))


def normalize_team(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text(c), r"\s+", " ")))


def squash_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(text(c), r"\s+", " "))


def any_keyword(c: Column, keywords: list[str]) -> Column:
    """True when any keyword occurs literally in ``c`` (one scan of the text)."""
    return c.rlike("|".join(re.escape(k).replace("\\ ", " ") for k in keywords))


def any_pattern(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def first_keyword(c: Column, keywords: list[str]) -> Column:
    """First keyword in list order that occurs in ``c``."""
    return F.coalesce(*[F.when(c.contains(k), F.lit(k)) for k in keywords])


def first_rule(c: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Label of the first rule with any keyword in ``c``."""
    return F.coalesce(*[F.when(any_keyword(c, words), F.lit(label)) for label, words in rules])


def parse_rank(c: Column, default: int = C.UNRANKED) -> Column:
    digits = filled(F.regexp_extract(text(c), r"(\d+)", 1)).try_cast("int")
    return F.when(F.lower(text(c)).contains("unranked"), F.lit(default)).otherwise(F.coalesce(digits, F.lit(default)))


def is_blank(c: Column) -> Column:
    return strip(text(c)) == ""


def safe_rank(c: Column, default: int = C.UNRANKED) -> Column:
    return F.greatest(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(1))


def normalize_format(c: Column) -> Column:
    f = F.lower(strip(text(c)))
    return (F.when(f.rlike("bo3|best of 3"), "bo3").when(f.rlike("bo5|best of 5"), "bo5")
            .when(f.contains("def"), "def")
            .when(f.rlike("bo1|best of 1") | f.isin(C.BO1_ABBREVIATIONS), "bo1").otherwise("unknown"))


def map_alias_rows() -> list[tuple[str, str]]:
    """(alias, canonical name) pairs, lower-cased."""
    return [(k, name) for name, extra in C.MAP_ALIASES.items()
            for k in (name.lower(), f"de_{name.lower()}", *extra)]


def canonical_map(c: Column) -> Column:
    """Registered name of a map or alias, NULL when unknown (a fixed literal lookup)."""
    known = F.create_map(*[F.lit(x) for pair in map_alias_rows() for x in pair])
    return F.try_element_at(known, F.lower(strip(text(c))))


def detect_is_lan(lines: Column) -> Column:
    hit = F.get(F.filter(lines, lambda x: F.lower(x).rlike(r"\(lan\)|\(online\)")), F.lit(0))
    return F.coalesce(F.lower(hit).contains("(lan)"), F.lit(False))


def clean_event(c: Column) -> Column:
    return F.coalesce(filled(strip(text(c))), F.lit("Unknown"))


def infer_organizer(event: Column) -> Column:
    low = F.lower(event)
    prefix = F.coalesce(*[F.when(F.startswith(low, F.lit(p.lower())), F.lit(p)) for p in C.ORGANIZER_PREFIXES])
    family = strip(F.get(F.split(event, C.EVENT_FAMILY_SUFFIX, 2), F.lit(0)), " :-")
    return F.coalesce(prefix, filled(family), event)


def infer_region(event: Column, lines: Column) -> Column:
    hay = F.concat(F.lit(" "), F.lower(event), F.lit("  "), F.lower(F.concat_ws(" ", lines)), F.lit(" "))
    return F.coalesce(first_rule(hay, C.REGION_KEYWORDS),
                      F.when(detect_is_lan(lines), F.lit("LAN/International")), F.lit("Unknown"))


def rank_bucket(rank: Column, default: int = C.UNRANKED) -> Column:
    out = None
    for top, label in C.RANK_BUCKETS:
        out = F.when(rank <= top, label) if out is None else out.when(rank <= top, label)
    return out.when(rank < default, "201+").otherwise("Unranked/unknown")


def rank_side(mine: Column, other: Column, default: int = C.UNRANKED) -> Column:
    return (F.when((mine == default) & (other == default), "unknown").when(mine < other, "higher-ranked forfeit")
            .when(mine > other, "lower-ranked forfeit").otherwise("same rank"))


def reason_category(notes: Column) -> Column:
    low = F.lower(F.concat_ws(" ", notes))
    rest = F.when(F.size(notes) > 0, "other stated reason").otherwise("default map only")
    return F.coalesce(first_rule(low, C.REASON_RULES), rest)


def normalize_url(url: Column, prefix: str = "hltv:") -> Column:
    """Contest id from the URL when it has one, else the URL without query, fragment and slash."""
    clean = F.regexp_replace(F.regexp_replace(text(url), r"[#?].*$", ""), r"/+$", "")
    number = F.regexp_extract(clean, r"/matches/(\d+)", 1)
    return F.when(number != "", F.concat(F.lit(prefix), number)).otherwise(clean)


def reason_list(c: Column) -> Column:
    """Distinct trimmed parts of a ';' text in first-occurrence order."""
    parts = F.transform(F.split(F.replace(text(c), F.lit("; final "), F.lit(", final ")), ";"), lambda x: strip(x))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def normalize_reasons(c: Column) -> Column:
    parts = reason_list(c)
    return F.when(F.size(parts) > 0, F.array_join(parts, "; "))


def prepend_reason(reason: Column, existing: Column) -> Column:
    """New reason first, unless the text already holds it."""
    parts = reason_list(existing)
    return F.array_join(F.when(F.array_contains(parts, reason), parts)
                        .otherwise(F.concat(F.array(reason), parts)), "; ")


def parse_date(c: Column) -> Column:
    """UTC timestamp from ISO text (with or without zone), else from its first ten characters."""
    s = strip(text(c))
    return F.coalesce(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), s.try_cast("timestamp")),
                      F.substring(s, 1, 10).try_cast("date").cast("timestamp"))


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}_-]", "_")
    s = F.regexp_replace(strip(s, "_"), r"_{2,}", "_")
    return F.coalesce(filled(s), F.lit("feature_experiment"))


def alias_key(c: Column) -> Column:
    """Upper-case key without punctuation, spaces and noise words."""
    words = F.split(F.regexp_replace(F.upper(text(c)), r"[^A-Z0-9\s]", ""), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(C.TEAM_NOISE_WORDS)), "")


def decimal_tokens(c: Column) -> Column:
    """Odds-like numbers between 1.01 and 100 in a text."""
    raw = F.regexp_extract_all(text(c), F.lit(r"(?<!\d)([1-9]\d?\.\d{2})(?!\d)"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: x.cast("double")), lambda v: (v >= 1.01) & (v <= 100.0))


def picker_from_veto(lines: Column, map_name: Column) -> Column:
    """Team text of the last veto line that says this map was picked."""
    hit = F.try_element_at(F.filter(lines, lambda x: F.lower(x).contains("picked")
                                    & F.lower(x).contains(F.lower(map_name))), F.lit(-1))
    return strip(F.regexp_replace(strip(F.get(F.split(hit, "picked"), F.lit(0))), r"^\d+\.\s*", ""))


def plus_minus(c: Column) -> Column:
    """Kills minus deaths of a "K-D" text; 0 when it cannot be read."""
    parts = F.transform(F.split(text(c), "-"), lambda x: strip(x).try_cast("int"))
    diff = F.when(F.size(parts) == 2, F.get(parts, F.lit(0)) - F.get(parts, F.lit(1)))
    return F.when(c.contains("-"), F.coalesce(diff, F.lit(0)))


def content_hash(values: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a list written as JSON."""
    return F.substring(F.sha2(F.to_json(values), 256), 1, 16)


def best_of(fmt: Column) -> Column:
    return F.when(fmt.contains("bo5"), 5).when(fmt.contains("bo3"), 3).when(fmt.contains("bo1"), 1).otherwise(0)


def required_wins(fmt: Column, lines: Column | None = None) -> Column:
    f = normalize_format(fmt)
    if lines is not None:
        f = F.when((f == "unknown") & (F.size(lines) > 0), normalize_format(F.concat_ws(" ", lines))).otherwise(f)
    return F.when(f == "bo1", 1).when(f == "bo3", 2).when(f == "bo5", 3)
