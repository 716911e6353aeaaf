"""Small-fixture checks of operators against hand values and brute force."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from rivalry import constants as C
from rivalry.functions import series as B
from rivalry.functions import text as X
from rivalry.operators import ledger as L
from rivalry.operators import metrics as M
from rivalry.operators import ordered as O
from rivalry.operators import paths as S
from rivalry.operators import splits as E
from rivalry.operators import veto as V
from rivalry.sources import readers as RD
from rivalry.sources import sinks as SK


def test_prefix_sums_with_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else "cold", i, rng.randint(0, 5)) for i in range(900)]
    out = O.prefix_sums(spark.createDataFrame(rows, "g string, k int, v int"), "k", ["v"], ["g"], rows_per_range=60).collect()
    assert len(out) == 900
    for r in out:
        assert r["v_before"] == sum(v for g, k, v in rows if g == r["g"] and k < r["k"])


def test_counts_before_matches_brute_force(spark):
    rng = random.Random(5)
    d0 = dt.date(2024, 1, 1)
    ev = [(rng.choice("xxxy"), d0 + dt.timedelta(days=rng.randint(0, 120)), f"m{rng.randint(0, 40):02d}", 1) for _ in range(300)]
    schema = "key string, date date, match_id string, n int"
    e = spark.createDataFrame(ev, schema)
    probes = e.select("key", "date", "match_id").distinct()
    ranged = O.in_ranges(e, "match_id", 40)
    out = O.counts_before(ranged, ranged.select("key", "date", "match_id", "range_no").distinct(), ["key"], ["n"], 30).collect()
    assert len(out) == probes.count()
    for r in out:
        want = sum(1 for k, d, m, _ in ev if k == r["key"] and d >= r["date"] - dt.timedelta(days=30) and (d < r["date"] or (d == r["date"] and m < r["match_id"])))
        assert r["n"] == want


def test_roc_auc_ties(spark):
    rows = [(0.2, 0), (0.2, 1), (0.5, 1), (0.5, 0), (0.5, 1), (0.9, 1), (0.1, 0)]
    pairs = [(p, n) for p, y in rows if y for n, z in rows if not z]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    assert M.roc_auc(spark.createDataFrame(rows, "p double, label int")).first()[0] == pytest.approx(want)
    assert M.roc_auc(spark.createDataFrame([(0.4, 1)], "p double, label int")).first()[0] is None


@pytest.mark.parametrize("n", [1, 7, 10, 23])
def test_adaptive_bins_chunks(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([0.25, 0.5, 0.5, 0.75]), rng.random() < 0.5) for _ in range(n)]
    out = {r["bin_no"]: r for r in M.adaptive_bins(spark.createDataFrame(rows, "assigned_prob double, won boolean")).collect()}
    k = min(10, n)
    order = sorted(rows)
    for i in range(k):
        chunk = order[i * n // k:(i + 1) * n // k]
        assert (out[i]["count"], out[i]["wins"]) == (len(chunk), sum(w for _, w in chunk))


def test_temporal_split_sizes(spark):
    rows = [(f"m{i:03d}", dt.date(2024, 1, 1 + (i % 3))) for i in range(101)]
    d = E.temporal_split(spark.createDataFrame(rows, "match_id string, date date"), ["date", "match_id"])
    assert {r["split"]: r["count"] for r in d.groupBy("split").count().collect()} == {"train": 70, "validation": 15, "test": 16}


def test_series_probability_by_enumeration(spark):
    ps = [0.3, 0.8, 0.55, 0.6, 0.45]
    df = spark.range(1).select(F.array(*[F.lit(p) for p in ps]).alias("ps"))
    for bo in (3, 5):
        need = bo // 2 + 1
        want = 0.0
        for bits in itertools.product([0, 1], repeat=bo):
            q = 1.0
            for b, p in zip(bits, ps):
                q *= p if b else 1 - p
            want += q * (sum(bits) >= need)
        got = df.select(B.combine_probs(F.slice("ps", 1, bo), bo).alias("p"), B.scoreline_probabilities(F.col("ps"), bo).alias("s")).first()
        assert got["p"] == pytest.approx(want)
        assert sum(x["p"] for x in got["s"]) == pytest.approx(1)
        assert sum(x["p"] for x in got["s"] if x["score"].startswith(str(need))) == pytest.approx(want)
    assert df.select(B.combine_probs(F.array().cast("array<double>"), 3)).first()[0] == 0.5


def _history(spark, bans):
    return spark.createDataFrame(bans, "team string, kind string, match_format string, slot int, map_name string, n long")


def test_veto_paths_sum_to_one_and_lock(spark):
    bans = [("A", "slot", "bo3", 1, "Nuke", 16), ("A", "slot", "bo3", 1, "Mirage", 4), ("A", "eventual", "bo3", None, "Nuke", 16), ("A", "team", None, None, "Nuke", 16),
            ("B", "slot", "bo3", 1, "Cache", 3), ("B", "team", None, None, "Cache", 3)]
    stats = spark.createDataFrame([("A", "Mirage", 0.6, 0.3)], "team string, map_name string, win_rate double, pick_rate double")
    mu = spark.createDataFrame([("A", "B", f) for f in ("bo1", "bo3", "bo5")], "team_a string, team_b string, match_format string")
    p = S.veto_paths(mu, S.team_weights(_history(spark, bans), stats)).cache()
    for r in p.groupBy("match_format", "starter").agg(F.sum("p").alias("s"), F.first("sequence").alias("q")).collect():
        assert r["s"] == pytest.approx(1)
        assert len(r["q"].split(",")) == {"bo1": 1, "bo3": 3, "bo5": 5}[r["match_format"]]
    # A bans Nuke first with 0.9, so Nuke stays in at most 10 % of the paths A opens
    nuke = S.map_appearance(p.where("starter = 'a' AND match_format = 'bo3'"), ["match_format"]).where("map_name = 'Nuke'").first()["p"]
    assert nuke < 0.1


def test_shared_lock_is_released(spark):
    bans = [(t, "slot", "bo3", 1, "Nuke", 20) for t in "AB"]
    stats = spark.createDataFrame([], "team string, map_name string, win_rate double, pick_rate double")
    mu = spark.createDataFrame([("A", "B", "bo3")], "team_a string, team_b string, match_format string")
    prepared = S.prepare_matchups(mu, S.team_weights(_history(spark, bans), stats)).collect()
    assert all(set(r["step_lock"]) == {-1} for r in prepared)


def test_six_team_bracket(spark):
    teams = "UVWXYZ"
    seeds = spark.createDataFrame([("b", i, t) for i, t in enumerate(teams)], "bracket string, seed int, team string")
    pairs = spark.createDataFrame([(a, b, 0.7 if a < b else 0.3) for a in teams for b in teams if a != b], "team_a string, team_b string, win_a double")
    out = S.bracket_probabilities(seeds, pairs, 6).collect()
    assert sum(r["p"] for r in out if r["slot"] == "final") == pytest.approx(1)
    assert {r["team"] for r in out if r["slot"] == "quarter_1"} == {"W", "Z"}
    assert {r["team"] for r in out if r["slot"] == "semi_1"} == {"U", "W", "Z"}


def test_bo1_ban_slots(spark):
    lines = [f"{i}. {t} removed {m}" for i, (t, m) in enumerate(zip(["A", "A", "B", "B", "B", "A"], C.POOL_CACHE), 1)] + ["7. Cache was left over"]
    rec = spark.createDataFrame([("u", "2026-07-10", "ev", "bo1", "A", "B", None, [], lines, [])],
                                "url string, date string, event string, format string, team1 string, team2 string, winner string, match_info array<string>, hltv_vetoes array<string>, "
                                "hltv_maps array<struct<map_name:string,team1:string,team1_score:string,team2:string,team2_score:string,picker:string>>")
    m = V.veto_matches(rec, V.era_frame(spark))
    acts = V.action_rows(m).where("team_id = 'A'").orderBy("global_action_index").collect()
    assert [a["team_ban_index"] for a in acts] == [1, 2, 3]
    assert m.first()["era_name"] == "cache_active_duty"
    assert len(acts[2]["pool_before"]) == 2


def test_fair_probabilities_golden(spark):
    d = L.fair_adjustment(spark.createDataFrame([(2.0, 3.0, 0.2), (None, 3.0, 0.2), (2.0, 3.0, None)], "odds_a double, odds_b double, forfeit_prob double")).collect()
    assert (d[0]["fair_prob_a"], d[0]["fair_prob_b"], d[0]["status"]) == (0.58, 0.42, "applied")
    assert [r["status"] for r in d[1:]] == ["missing_odds", "unavailable"]


def test_upsert_keeps_one_row(spark):
    old = spark.createDataFrame([("v1", "test", 20, 0.65)], "version_id string, eval_name string, rows int, log_loss double")
    new = spark.createDataFrame([("v1", "test", 21, 0.63)], old.schema)
    out = SK.merge_records(old, new, ["version_id", "eval_name"]).collect()
    assert [(r["rows"], r["log_loss"]) for r in out] == [(21, 0.63)]


def test_entity_list_and_whitelist(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text('team\n"  G2  "\n"The   MongolZ"\n"THE mongolz"\n" "\n')
    w = RD.read_entity_list(spark, str(path))
    assert {r["team_key"]: r["name"] for r in w.collect()} == {"g2": "G2", "the mongolz": "The MongolZ"}
    m = spark.createDataFrame([("G2 Academy", "X"), ("g2", "X"), ("G2", "the  mongolz")], "team1 string, team2 string")
    assert RD.whitelist_semi(m, w).count() == 2
    assert RD.whitelist_semi(m, w, "both").count() == 1


def test_reader_rejects_malformed(spark, tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text(json.dumps([{"url": "u", "team1": "A", "team_ranks": {"A": {"world_rank": "#4"}}}]))
    bad.write_text('{"url": "u"\n')
    assert RD.read_matches(spark, str(good), multi_line=True).first()["team_ranks"]["A"]["world_rank"] == "#4"
    with pytest.raises(Exception, match="malformed"):
        RD.read_matches(spark, str(bad)).collect()


def test_text_functions(spark):
    d = spark.createDataFrame([("bo3 best of 5", "K 10-7", "#42", "https://x/matches/77/a?z#q")], "f string, k string, r string, u string")
    r = d.select(X.normalize_format(F.col("f")).alias("f"), X.plus_minus(F.lit("10-7")).alias("k"), X.parse_rank(F.col("r")).alias("r"), X.normalize_url(F.col("u")).alias("u"),
                 X.best_of(F.lit("bo5")).alias("b")).first()
    assert (r["f"], r["k"], r["r"], r["u"], r["b"]) == ("bo3", 3, 42, "hltv:77", 5)


def test_variant_catalogue():
    v = E.feature_variants()
    assert len(v) == 30
    assert len(v["baseline_all"]) == 17
    assert len(E.preset_variants("full")) == 28
    assert len(V.weight_grid()) == 78


def test_malformed_json_raises_whatever_is_selected(spark, tmp_path):
    from rivalry.sources.readers import read_matches

    path = tmp_path / "records.json"
    path.write_text('{"url": "u1", "event": "e"}\n{"url": "u2", "event": \n')
    for read in (lambda d: d.select("event").collect(), lambda d: d.count(), lambda d: d.select("url").collect()):
        with pytest.raises(Exception, match="malformed record"):
            read(read_matches(spark, str(path)))
    path.write_text('{"url": "u1", "event": "e"}\n')
    assert read_matches(spark, str(path)).count() == 1


def test_starters_are_combined_before_they_are_averaged(spark):
    from rivalry.operators.paths import known_map_series

    rows = [("m", "bo3", s, i + 1, p) for s, ps in (("a", (0.9, 0.2, 0.9)), ("b", (0.5, 0.6, 0.9))) for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "match_id string, match_format string, starter string, map_pos int, p double")
    got = {r.outcome: r.probability for r in known_map_series(df).collect()}
    assert got["win"] == pytest.approx(0.798, abs=1e-9)
    assert sum(v for k, v in got.items() if k != "win") == pytest.approx(1)


def test_shared_folder_needs_the_setting_on_a_cluster():
    from types import SimpleNamespace as N

    from rivalry.session import shared_root

    conf = N(get=lambda *a: None)
    assert shared_root(N(conf=conf, sparkContext=N(master="local[4]")))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(N(conf=conf, sparkContext=N(master="local-cluster[3,2,1000]")))
    assert shared_root(N(conf=N(get=lambda *a: "hdfs://x/y/"), sparkContext=None)) == "hdfs://x/y"


def test_settlement_shuffles_short_columns_only(spark):
    nested = "url string, match_key long, date string, event string, format string, team1 string, team2 string, match_info array<string>, " \
             "hltv_maps array<struct<map_name: string, team1: string, team1_score: string, team2: string, team2_score: string, player_stats: array<struct<player: string>>>>, " \
             "player_stats array<map<string,string>>"
    one = lambda m, a, b: {"map_name": m, "team1": "X", "team1_score": a, "team2": "Y", "team2_score": b, "player_stats": None}
    rows = [("/matches/1/x", 1, "2024-01-01", "e", "bo3", "X", "Y", ["Best of 3"], [one("m1", "16", "2"), one("m2", "16", "3")], None),
            ("/matches/2/x", 2, "2024-01-01", "e", "bo1", "X", "Y", ["team forfeit"], None, None)]
    corpus_ = spark.createDataFrame(rows, nested)
    ledger = spark.createDataFrame([("/matches/1/x", "Y", "X"), ("/matches/2/x", "X", "Y"), ("/matches/9/x", "X", "Y")], "match_url string, team_a string, team_b string")
    for few in (100_000, 0):
        L.FEW_KEYS, old = few, L.FEW_KEYS
        try:
            out = L.settle_join(ledger, corpus_)
            got = {r.match_url: r.resolved for r in out.collect()}
            plan = out._jdf.queryExecution().executedPlan().toString()
        finally:
            L.FEW_KEYS = old
        assert got == {"/matches/1/x": "team_b", "/matches/2/x": "forfeit", "/matches/9/x": None}
        for part in plan.split("Exchange hashpartitioning")[1:]:
            head = part.split("\n")[1]
            assert "hltv_maps" not in head and "player_stats" not in head


def test_settlement_works_out_the_status_alone(spark):
    from rivalry.operators import clean as K

    lines = [None, [], ["X used substitute Neo (coach) due to visa issues"], ["Y used a stand-in during map 2"], ["old side withdrawn, replaced by academy"],
             ["  ", None, "X used a stand-in"], ["Best of 3"]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "match_key long, match_info array<string>")
    want = {r.match_key: r.roster_status for r in K.with_roster_flags(df).collect()}
    assert {r.match_key: r.roster_status for r in K.with_roster_status(df).collect()} == want
    assert set(want.values()) == {"standard", "coach_standin", "mid_map_substitution", "team_replacement", "substitution"}

    nested = "url string, match_key long, format string, team1 string, team2 string, match_info array<string>, " \
             "hltv_maps array<struct<map_name: string, team1_score: string, team2_score: string, player_stats: array<struct<player: string>>>>"
    eleven, five = ([{"player": f"P{i}"} for i in range(n)] for n in (11, 5))
    one = lambda a, b, p: {"map_name": "m", "team1_score": a, "team2_score": b, "player_stats": p}
    rows = [("/matches/1", 1, "bo3", "X", "Y", [], [one("-", "-", None), one("16", "2", five), one(" 16 ", "x", five), one("13", "2", [])]),
            ("/matches/2", 2, "bo1", "X", "Y", [], [None, one("2", "16", eleven)])]
    ledger = spark.createDataFrame([(f"/matches/{i}", "X", "Y") for i in (1, 2)], "match_url string, team_a string, team_b string")
    out = L.settle_join(ledger, spark.createDataFrame(rows, nested))
    assert {r.match_url: (r.resolved, r.eval_reason) for r in out.collect()} == {
        "/matches/1": ("team_a", None), "/matches/2": ("team_b", "non-standard roster: 11 players recorded on m")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "substitution_reason_terms" not in plan and "has_map_specific_sub" not in plan


def test_ranges_follow_the_row_count(spark):
    from rivalry.operators.ordered import in_ranges, prefix_sums

    keys = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), F.lit(1).cast("long").alias("c"))
    sizes = [r["count"] for r in in_ranges(keys, "k").groupBy("range_no").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 200_000  # twice the average at most
    few = spark.createDataFrame([(k, i % 3 + 1) for i, k in enumerate([5, 3, 9, 1, None, 7, 2, 8])], "k long, c long")
    got = {r.k: r.c_before for r in prefix_sums(few, "k", ["c"], rows_per_range=2).collect()}
    want, at = {}, 0
    for k, c in sorted(((r.k, r.c) for r in few.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        want[k], at = at, at + c
    assert got == want


def test_hints_reach_records_without_url(spark, monkeypatch):
    eras = spark.createDataFrame([(1, "old", None, dt.date(2020, 1, 1), ["Nuke", "Train"], []), (2, "new", dt.date(2020, 1, 1), None, ["Mirage", "Ancient"], [])],
                                 "era_no int, name string, start date, end date, maps array<string>, events array<string>")
    rows = [("u1", "Cup", "2021-05-01", "old"), (None, "Cup", "2021-05-02", None), ("", "Cup", "2021-05-02", None), ("u2", "Cup", "2021-05-03", None),
            (None, "Other", "2021-05-02", None), (None, None, "2019-05-02", None)]
    df = spark.createDataFrame([(*r, []) for r in rows], "url string, event string, date string, map_pool_era string, hltv_vetoes array<string>")

    def found():
        return sorted(((r["url"], r["event"], r["e"]) for r in V.resolve_eras(df, eras).select("url", "event", F.col("era.name").alias("e")).collect()), key=repr)

    few = found()
    monkeypatch.setattr(V, "FEW_HINTS", 0)
    assert found() == few and len(few) == len(rows)
    assert [r for r in few if r[:2] == (None, "Cup")] == [(None, "Cup", "old")]


def test_rows_of_a_fit_are_spread(spark):
    """A small stored table is one task; every pass of a fit would wait for it."""
    from rivalry.operators import models as ML
    from rivalry.session import persist_table

    stored = persist_table(spark.range(400).coalesce(1))
    out = ML.spread(stored).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(out) == spark.sparkContext.defaultParallelism and sum(r["count"] for r in out) == 400


def test_temporal_split_repeated_and_null_keys(spark):
    """Only keys are ordered and rows are not joined to their places; repeated keys share one, rows without keys have none."""
    days = [None, *[dt.date(2024, 1, 1 + i % 9) for i in range(40)], None]
    rows = [(None if i == 7 else f"m{i % 13}", d, i) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "match_id string, date date, v int")
    d = E.temporal_split(df, ["date", "match_id"], 0.5, 0.2)
    low = lambda r: tuple((x is not None, x) if x is not None else (False, "") for x in (r[1], r[0]))
    order = [low(r) for r in rows]
    want = set()
    for r in rows:
        if r[0] is not None and r[1] is not None:
            at = sum(o < low(r) for o in order)
            want.add((r[2], "train" if at < int(42 * 0.5) else "validation" if at < int(42 * 0.7) else "test"))
    assert {(r.v, r.split) for r in d.collect()} == want and d.columns == ["date", "match_id", "v", "split"]
    assert " Join Inner, (" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert E.temporal_split(df.where("false"), ["date", "match_id"]).count() == 0


def test_parsed_rows_are_read_once(spark):
    """Flagging a series and ordering rows read stored rows; the parsing behind them runs in one pass."""
    from rivalry.operators import clean as K

    parsed = spark.sparkContext.accumulator(0)

    def parse(batches):
        for b in batches:
            parsed.add(b.num_rows)
            yield b

    rows = [("m1", 1, "A", "B", "bo3", False), ("m1", 2, "A", "B", "bo3", True), ("m2", 1, "A", "C", "def", False), ("m3", 1, "B", "C", "bo1", False)]
    schema = "match_id string, map_pos int, team_a_id string, team_b_id string, match_format string, is_forfeit boolean"
    raw = spark.createDataFrame(rows, schema).mapInArrow(parse, schema)
    out = K.forfeit_exclusion(raw).select("match_id", "map_pos", "match_has_forfeit").collect()
    assert sorted(map(tuple, out)) == [("m1", 1, True), ("m3", 1, False)] and parsed.value == 4
    ordered = K.sorted_maps(raw.withColumn("date", F.lit("2024-01-01"))).select("match_id", "map_pos").collect()
    assert list(map(tuple, ordered)) == [r[:2] for r in rows] and parsed.value == 8
