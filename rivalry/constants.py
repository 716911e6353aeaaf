"""Fixed values that are part of the result semantics.

Everything here must keep its exact value for results to be comparable; all of
it is passed around as keyword-argument defaults rather than read globally.
"""

# ---- numeric defaults (fixed values) --------------------------------------
UNRANKED = 750
DEFAULT_OPPONENT_RANK = 100
FORM_ALPHA = 2.0
FORM_BETA = 4.0
FORM_DAYS = (90, 30, 7)
MAP_DAYS = 90
H2H_DAYS = 30
VETO_DAYS = 90
FORFEIT_PRIOR = 0.097
FORFEIT_PRIOR_WEIGHT = 20.0
TRAIN_RATIO = 0.70
VALIDATION_RATIO = 0.15
PATH_CUTOFF = 0.90
SLOT_WEIGHT, EVENTUAL_WEIGHT, TEAM_BAN_WEIGHT = 0.60, 0.25, 0.15
LOCK_PROBABILITY, LOCK_MIN_RATE, LOCK_MIN_SAMPLE = 0.90, 0.75, 10
MAX_STANDARD_PLAYERS = 10
LEDGER_CLIP = 1e-4
METRIC_CLIP = 1e-7
STALE_AFTER_MAPS = 500

# ---- keyword and pattern lists (fixed values, in matching order) ----------
SHOWMATCH_KEYWORDS = [
    "showmatch", "show match", "all-star", "all star", "charity match", "streamer",
    "content creator", "wingman", "bombsite a only", "bombsite b only",
    "1v1", "2v2", "3v3", "4v4", "1 vs 1", "2 vs 2", "3 vs 3", "4 vs 4",
]
SUBSTITUTION_KEYWORDS = ["substitute", "substitutes", "substituted", "stand-in", "stand in"]
TEAM_REPLACEMENT_KEYWORDS = ["withdraw", "withdrawn", "disqualified", "replaced by", "replaces"]
MID_MAP_PATTERNS = [
    r"\bduring map\b", r"\bmid[- ]?map\b", r"\bafter round\b",
    r"\bafter the \d+(st|nd|rd|th)? round\b", r"\bround interval\b", r"\bfor the remainder\b",
]
MAP_SCOPE_PATTERNS = [
    r"\bon the \d+(st|nd|rd|th)? map\b", r"\bmap \d+\b",
    r"\b\d+(st|nd|rd|th)? map\b", r"\b\d+(st|nd|rd|th)? and \d+(st|nd|rd|th)? map\b",
]
SUBSTITUTION_REASONS = [
    "visa", "illness", "medical", "sick", "emergency", "technical", "power outage",
]
FORFEIT_TEXT_PATTERNS = [
    r"\bforfeit(?:ed|s)?\b", r"\bdefault win\b", r"\bdisqualif(?:ied|ication)\b",
    r"\bunable to field\b", r"\bfailed to show up\b", r"\bwithdraw(?:n|s)?\b",
]
# The first group is the team that forfeited.
FORFEIT_TEAM_PATTERNS = [
    r"\*\*\s*(.+?)\s+forfeit(?:ed|s)?\b",
    r"\*\*\s*(.+?)\s+have been disqualified\b",
    r"\*\*\s*(.+?)\s+has been disqualified\b",
    r"\*\*\s*(.+?)\s+are disqualified\b",
    r"\*\*\s*(.+?)\s+is disqualified\b",
    r"\*\*\s*(.+?)\s+failed to show up\b",
    r"\*\*\s*(.+?)\s+withdraw(?:n|s)?\s+from the (?:event|tournament)\b",
]
NONSTANDARD_PATTERNS = [r"\b1\s*vs\s*1\b", r"\b1v1\b"]
REGION_KEYWORDS = [
    ("North America", ["north america", " na ", "dust2.us", "esea advanced na"]),
    ("South America", ["south america", "latin america", "brazil", "brasil", "latam"]),
    ("Europe", ["europe", "eu ", "european", "dach", "benelux", "balkan", "ukic", "united21"]),
    ("CIS", ["cis", "russia", "russian", "ukraine", "kazakhstan"]),
    ("Asia", ["asia", "asian", "china", "chinese", "mongolia", "india", "nodwin"]),
    ("Oceania", ["oceania", "australia", "anz"]),
    ("Middle East", ["middle east", "mena", "arabia", "uae"]),
]
ORGANIZER_PREFIXES = [
    "BLAST", "ESL", "IEM", "PGL", "CCT", "YaLLa", "Thunderpick", "ESEA", "EPL",
    "European Pro League", "United21", "Dust2.us", "NODWIN", "StarLadder", "MESA", "RES",
    "Fragadelphia", "Exort", "Tipsport", "LORGAR", "A1", "Galaxy Battle",
]
EVENT_FAMILY_SUFFIX = r"\s+(?:Season|Series|Cup|League|Masters|Open|Closed|Qualifier)\b"
REASON_RULES = [
    ("scheduling conflict", ["scheduling conflict"]),
    ("roster eligibility/lineup", ["eligible roster", "complete lineup", "unable to field"]),
    ("integrity/disqualification", ["integrity", "disqualified", "disqualification"]),
    ("technical", ["technical", "power", "connection"]),
    ("no-show", ["failed to show up"]),
    ("event withdrawal", [
        "withdraw from the event", "withdraws from the event", "withdrawn from the event",
        "withdraw from the tournament", "withdraws from the tournament",
        "withdrawn from the tournament",
    ]),
]
RANK_BUCKETS = [(10, "1-10"), (30, "11-30"), (50, "31-50"), (100, "51-100"), (200, "101-200")]
TEAM_NOISE_WORDS = ["TEAM", "ESPORTS", "GAMING", "CLUB", "SQUAD", "GAMERS", "ORGANIZATION", "CLAN"]
GLOBAL_TEAM_ALIASES = {
    "100T": "100 Thieves", "CW": "Chinggis Warriors", "EF": "Eternal Fire", "FLY": "FlyQuest",
    "LVG": "Lynn Vision", "MONGOLZ": "The MongolZ", "NAVI": "Natus Vincere",
    "NIP": "Ninjas in Pyjamas",
}

# ---- veto line grammar (fixed patterns) -----------------------------------
VETO_ACTION_PATTERN = r"(?i)^\s*(\d+)\.\s*(.*?)\s+(removed|picked)\s+(.+?)\s*$"
VETO_DECIDER_PATTERN = r"(?i)^\s*(\d+)\.\s*(.+?)\s+was\s+left\s+over\s*$"

# ---- maps and pools (fixed values) ----------------------------------------
MAP_ALIASES = {
    "Ancient": ["anc"], "Anubis": ["anb"], "Cache": ["cch"], "Cobblestone": ["cbl"],
    "Dust2": ["d2", "dust 2", "dust ii"], "Inferno": ["inf"], "Mirage": ["mrg"],
    "Nuke": ["nk"], "Overpass": ["over", "ovp"], "Train": ["trn"], "Vertigo": ["vtg"],
}
BO1_ABBREVIATIONS = ["anc", "anb", "cch", "cbl", "d2", "inf", "mrg", "nuke", "ovp", "trn", "vtg"]
POOL_OVERPASS = ["Mirage", "Ancient", "Dust2", "Nuke", "Inferno", "Anubis", "Overpass"]
POOL_CACHE = ["Mirage", "Ancient", "Dust2", "Nuke", "Inferno", "Anubis", "Cache"]
# (name, first day or None, first day after the era or None, maps, events)
DEFAULT_ERAS = [
    ("overpass_active_duty", None, "2026-07-08", POOL_OVERPASS, []),
    ("cache_active_duty", "2026-07-08", None, POOL_CACHE, []),
]
ACTIVE_POOL = POOL_CACHE

# ---- feature lists (fixed order) ------------------------------------------
MODEL_FEATURES = [
    "rank_diff", "win_rate_90d_diff", "win_rate_30d_diff", "win_rate_7d_diff",
    "team_a_win_streak", "team_b_win_streak", "picker_diff",
    "h2h_a_wins_30d", "h2h_b_wins_30d", "map_win_rate_diff", "map_comfort_diff",
    "dominance_diff", "resilience_diff", "avg_log_rank", "sos_90d_diff", "sos_diff",
    "lan_rate_diff",
]
FORFEIT_NUMERIC = [
    "is_lan", "best_of", "days_since_start", "team1_rank", "team2_rank", "min_rank", "max_rank",
    "avg_log_rank", "abs_log_rank_diff", "either_unranked", "both_unranked",
    "global_forfeit_rate", "surface_forfeit_rate", "region_forfeit_rate",
    "organizer_forfeit_rate", "event_forfeit_rate",
    "team1_match_forfeit_rate", "team2_match_forfeit_rate",
    "team_avg_match_forfeit_rate", "team_max_match_forfeit_rate",
    "team1_own_forfeit_rate", "team2_own_forfeit_rate",
    "team_avg_own_forfeit_rate", "team_max_own_forfeit_rate",
    "team1_match_count_log", "team2_match_count_log",
    "organizer_match_count_log", "event_match_count_log",
    "recent_30d_forfeit_rate", "recent_90d_forfeit_rate",
    "recent_surface_30d_forfeit_rate", "recent_surface_90d_forfeit_rate",
]
FORFEIT_CATEGORICAL = [
    "region", "format", "team1_rank_bucket", "team2_rank_bucket", "rank_pair_bucket",
]
# strategy name -> (how the two sources are combined, rank when neither is known)
RANK_STRATEGIES = {
    "world_only_default_500": ("world_only", 500),
    "vrs_only_default_500": ("vrs_only", 500),
    "world_vrs_fallback_default_300": ("world_vrs_fallback", 300),
    "world_vrs_fallback_default_750": ("world_vrs_fallback", 750),
    "world_vrs_fallback_default_1000": ("world_vrs_fallback", 1000),
    "avg_available_default_500": ("avg_available", 500),
    "avg_available_default_750": ("avg_available", 750),
    "log_avg_available_default_500": ("log_avg_available", 500),
    "best_available_default_500": ("best_available", 500),
    "weighted_world_vrs_default_500": ("weighted_world_vrs", 500),
}
# Ban-model presets: weight per signal, plus optional lock settings.
LOCK = {"lock_probability": 0.90, "lock_min_sample": 10.0, "lock_min_rate": 0.75}
SHARED_LOCK = {**LOCK, "shared_lock_min_rate": 0.75, "shared_lock_min_sample": 10.0}
_BEST = {"slot": 0.60, "eventual": 0.25, "team_ban": 0.15}
PRESET_BAN_MODELS = {
    "uniform": {},
    "current_like": {"current_like": 1.0},
    "grid_best": _BEST,
    "grid_best_locked": {**_BEST, **LOCK},
    "grid_best_shared_lock": {**_BEST, **SHARED_LOCK},
    "ban_history_balanced": {"slot": 0.45, "eventual": 0.25, "team_ban": 0.15, "global": 0.05,
                             "avoidance": 0.05, "threat": 0.05},
    "ban_history_slot": {"slot": 0.60, "eventual": 0.15, "team_ban": 0.10, "global": 0.05,
                         "avoidance": 0.05, "threat": 0.05},
    "ban_history_eventual": {"slot": 0.30, "eventual": 0.35, "team_ban": 0.15, "global": 0.05,
                             "avoidance": 0.10, "threat": 0.05},
}
# Values tried per signal; the rest of the weight goes to "global".
WEIGHT_GRID = {"slot": [0.0, 0.35, 0.6], "eventual": [0.0, 0.25, 0.5], "team_ban": [0.0, 0.15, 0.3],
               "avoidance": [0.0, 0.1], "threat": [0.0, 0.1]}
BAN_SIGNALS = ["slot", "eventual", "team_ban", "global", "avoidance", "threat"]
CALIBRATION_EDGES = [0.0, 0.025, 0.05, 0.075, 0.10, 0.15, 0.20, 0.30, 0.50, 1.0]
EDGE_BUCKETS = [(0, 2, "<2%"), (2, 5, "2-5%"), (5, 10, "5-10%"), (10, 999, "10%+")]

# ---- experiment column sets (fixed catalogue) ------------------------------
# Each entry edits the model features: columns to drop or add, another head-to-head
# window in days, or another rank strategy.
SUSPICIOUS = ["lan_rate_diff", "dominance_diff", "resilience_diff"]
DEPTH_COUNTS = ["team_a_gen_matches_30d", "team_b_gen_matches_30d"]
DEPTH_LOGS = ["log_team_a_gen_matches_30d", "log_team_b_gen_matches_30d"]
VARIANT_EDITS = {
    "baseline_all": {},
    "no_lan_rate": {"drop": ["lan_rate_diff"]},
    "no_dominance_resilience": {"drop": ["dominance_diff", "resilience_diff"]},
    "no_lan_dom_resilience": {"drop": SUSPICIOUS},
    **{f"h2h_{days}d_counts": {"h2h_days": days} for days in (14, 30, 90)},
    **{f"no_lan_dom_res_h2h_{days}d": {"drop": SUSPICIOUS, "h2h_days": days} for days in (14, 30, 90)},
    "no_7d_form": {"drop": ["win_rate_7d_diff"]},
    "single_sos_90d": {"drop": ["sos_diff"]},
    "single_sos_30d": {"drop": ["sos_90d_diff"]},
    "no_h2h": {"drop": ["h2h_a_wins_30d", "h2h_b_wins_30d"]},
    "sample_depth_raw_counts": {"add": DEPTH_COUNTS},
    "sample_depth_log_counts": {"add": DEPTH_LOGS},
    "sample_depth_log_diff": {"add": ["log_gen_matches_30d_diff"]},
    "sample_depth_min_log": {"add": ["log_min_gen_matches_30d"]},
    "sample_depth_log_full": {"add": [*DEPTH_LOGS, "log_gen_matches_30d_diff", "log_min_gen_matches_30d"]},
    "sample_depth_all_counts": {"add": [*DEPTH_COUNTS, "gen_matches_30d_diff", "min_gen_matches_30d", *DEPTH_LOGS,
                                        "log_gen_matches_30d_diff", "log_min_gen_matches_30d"]},
    **{f"rank_{name}": {"rank": name} for name in RANK_STRATEGIES},
}
