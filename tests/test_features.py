"""Golden values, metamorphic checks and a naive replay of the point-in-time features."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rivalry.operators import experiments as EX
from rivalry.operators import features as X
from rivalry.operators import ranks as R
from rivalry.operators import splits as E

D0 = dt.date(2026, 1, 1)
SCHEMA = ("match_id string, map_pos int, map_name string, date date, team_a_id string, team_b_id string, score_a int, score_b int, winner_id string, "
          "team_a_picked boolean, team_b_picked boolean, team_a_world_rank int, team_b_world_rank int, is_lan boolean, match_has_forfeit boolean")
RANK = {"A": 5, "B": 20, "C": 40}


def row(match, pos, name, day, a, b, winner, pick=None, lan=False, void=False, ranks=RANK):
    won = winner == a
    return (match, pos, name, D0 + dt.timedelta(days=day), a, b, 13 if won else 8 if winner == b else 5, 5 if won else 13, winner,
            pick == a, pick == b, ranks[a], ranks[b], lan, void)


GOLDEN = [
    row("prior", 1, "nuke", 1, "A", "C", "A", lan=True),
    row("bo3", 1, "mirage", 2, "A", "B", "A", "A"), row("bo3", 2, "ancient", 2, "A", "B", "A", "A"), row("bo3", 3, "nuke", 2, "A", "B", "B", "B"),
    row("later", 1, "mirage", 3, "A", "B", "A", "B"), row("later", 2, "ancient", 3, "A", "B", "A"),
]


def features(spark, rows):
    out = X.compute_features(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r["match_id"], r["map_name"]): r for r in out}


def test_golden_rows(spark):
    f = features(spark, GOLDEN)
    m = f["bo3", "mirage"]
    assert (m["picker_diff"], m["map_win_rate_diff"], m["team_a_gen_matches_30d"], m["team_b_gen_matches_30d"], m["lan_rate_diff"]) == (1, 0, 1, 0, 1)
    n = f["bo3", "nuke"]
    assert n["picker_diff"] == -1
    assert n["map_win_rate_diff"] == pytest.approx(0.1)
    assert n["sos_diff"] == pytest.approx(math.log(100 / 40))
    later = f["later", "mirage"]
    assert (later["team_a_gen_matches_30d"], later["team_b_gen_matches_30d"], later["h2h_a_wins_30d"], later["h2h_b_wins_30d"]) == (4, 3, 2, 1)
    assert later["team_a_win_streak"] == pytest.approx(math.log(3))
    assert later["lan_rate_diff"] == pytest.approx(0.25)
    assert later["map_comfort_diff"] == pytest.approx(1)
    assert f["later", "ancient"]["map_comfort_diff"] == pytest.approx(0)


def test_streak_mixed_day_and_forfeit(spark):
    rows = [row("w1", 1, "nuke", 1, "A", "B", "A"), row("w2", 1, "nuke", 2, "A", "B", "A"), row("l2", 1, "nuke", 2, "A", "C", "C"),
            row("p3", 1, "nuke", 3, "A", "B", "A"), row("q3", 1, "nuke", 3, "A", "C", "A"), row("v3", 1, "nuke", 3, "A", "C", "C", void=True),
            row("z", 1, "nuke", 4, "A", "B", "A")]
    for order in (rows, rows[::-1]):
        f = features(spark, order)
        assert f["p3", "nuke"]["team_a_win_streak"] == 0
        assert f["z", "nuke"]["team_a_win_streak"] == pytest.approx(math.log(3))


def test_future_changes_do_not_alter_earlier_rows(spark):
    flipped = GOLDEN[:4] + [row("later", 1, "mirage", 3, "A", "B", "B", "B"), row("later", 2, "ancient", 3, "A", "B", "B")]
    a, b = features(spark, GOLDEN), features(spark, flipped)
    for k in a:
        assert [a[k][c] for c in X.C.MODEL_FEATURES] == [b[k][c] for c in X.C.MODEL_FEATURES]


def test_unseen_rows_equal_played_rows(spark):
    """Scoring the last day as unseen rows gives the features it had when played."""
    maps = spark.createDataFrame(GOLDEN, SCHEMA)
    day3 = F.col("date") == F.lit(D0 + dt.timedelta(days=3))
    unseen = maps.where(day3).drop("winner_id", "score_a", "score_b")
    got = {r["map_name"]: r for r in X.compute_features(maps.where(~day3), unseen).collect()}
    want = features(spark, GOLDEN)
    for name in ("mirage", "ancient"):
        for c in X.C.MODEL_FEATURES:
            assert got[name][c] == pytest.approx(want["later", name][c])


def test_mirror_twice_is_identity_and_negates(spark):
    f = X.compute_features(spark.createDataFrame(GOLDEN, SCHEMA))
    m = X.mirror_rows(f).collect()
    assert len(m) == 12
    assert sum(r["label"] for r in m) == 6
    assert sum(r["rank_diff"] for r in m) == pytest.approx(0)


def replay(rows):
    """Day-by-day reference with plain lists."""
    hist, out = {}, {}
    for day in sorted({r[3] for r in rows}):
        today = [r for r in rows if r[3] == day]
        for r in today:
            def form(t, days):
                h = [x for x in hist.get(t, []) if x[0] >= day - dt.timedelta(days=days)]
                return (sum(x[1] for x in h) + 2) / (len(h) + 4)

            def dom(t):
                h = [x[2] for x in hist.get(t, []) if x[0] >= day - dt.timedelta(days=30) and x[2] > 0]
                return sum(h) / len(h) if h else 0.0
            out[r[0], r[1]] = tuple(form(r[4], d) - form(r[5], d) for d in (90, 30, 7)) + (dom(r[4]) - dom(r[5]),)
        for r in today:
            hist.setdefault(r[4], []).append((day, int(r[6] > r[7]), r[6] - r[7]))
            hist.setdefault(r[5], []).append((day, int(r[7] > r[6]), r[7] - r[6]))
    return out


def test_against_naive_replay(spark):
    rng = random.Random(7)
    teams = {f"T{i}": rng.randint(1, 200) for i in range(6)}
    rows = []
    for i in range(250):
        a, b = rng.sample(sorted(teams), 2) if rng.random() < 0.7 else ("T0", "T1")  # one hot pair
        rows.append(row(f"m{i}", 1, rng.choice(["nuke", "mirage"]), rng.randint(0, 150), a, b, rng.choice([a, b]), ranks=teams))
    want = replay(rows)
    got = X.compute_features(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 250
    for r in got:
        w = want[r["match_id"], r["map_pos"]]
        assert (r["win_rate_90d_diff"], r["win_rate_30d_diff"], r["win_rate_7d_diff"], r["dominance_diff"]) == pytest.approx(w)


def test_rank_carry_forward(spark):
    schema = "match_id string, map_pos int, date date, team_a_id string, team_b_id string, " + ", ".join(
        f"team_{s}_{k}_rank int, team_{s}_{k}_rank_missing boolean" for s in "ab" for k in ("world", "vrs"))

    def r(i, day, a, b, ra, rb):
        def two(x):
            return (750, True) if x is None else (x, False)
        return (f"m{i}", 1, D0 + dt.timedelta(days=day), a, b, *two(ra), *two(None), *two(rb), *two(None))

    rows = [r(1, 1, "A", "B", 5, 20), r(2, 2, "B", "A", None, None), r(3, 3, "A", "C", 9, 40), r(4, 3, "C", "A", 40, 11), r(5, 4, "A", "B", None, None)]
    out = {x["match_id"]: x for x in R.repair_default_ranks(spark.createDataFrame(rows, schema)).collect()}
    assert (out["m2"]["team_a_world_rank"], out["m2"]["team_b_world_rank"]) == (20, 5)
    # day 3 disagrees (9 and 11), so day 1 still counts
    assert out["m5"]["team_a_world_rank"] == 5
    assert out["m5"]["team_a_vrs_rank"] == 750


def test_h2h_window(spark):
    rows = [row(f"m{i}", 1, "nuke", d, "A", "B", w) for i, (d, w) in enumerate([(0, "A"), (10, "B"), (20, "A")])]
    maps = spark.createDataFrame(rows, SCHEMA)
    out = X.join_head_to_head(maps, X.head_to_head(maps, 14), 14).orderBy("date").collect()
    assert [(r["h2h_a_wins_14d"], r["h2h_b_wins_14d"]) for r in out] == [(0, 0), (1, 0), (0, 1)]


def test_variant_frame_has_the_columns_of_every_set(spark):
    df = spark.createDataFrame(GOLDEN, SCHEMA)
    for side in "ab":
        df = df.withColumn(f"team_{side}_vrs_rank", F.col(f"team_{side}_world_rank") * 2)
        for source in ("world", "vrs"):
            df = df.withColumn(f"team_{side}_{source}_rank_missing", F.lit(False))
    f = X.variant_frame(df)
    assert not {c for cols in E.feature_variants().values() for c in cols} - set(f.columns)
    rows = {(r["match_id"], r["map_name"]): r for r in f.collect()}
    r = rows["later", "mirage"]
    assert len(rows) == len(GOLDEN) and (r["h2h_a_wins_14d"], r["h2h_b_wins_90d"]) == (2, 1)
    assert r["rank_vrs_only_default_500_diff"] == pytest.approx(math.log(40 / 10))
    assert r["log_min_gen_matches_30d"] == pytest.approx(math.log1p(3))


def test_experiment_runs_differ_by_seed(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, D0 + dt.timedelta(days=i // 4), x, z, int(x * z + rng.gauss(0, 1) > 0)))
    df = spark.createDataFrame(rows, "match_id int, date date, x_diff double, z_diff double, label int")
    folded = E.with_folds(df, E.fold_specs(df, 1, 20))
    out = EX.experiment_run(folded, {"both": ["x_diff", "z_diff"]}, (1, 2), ["date", "match_id"], [0.9, 1.0], max_iter=10).collect()
    assert sorted((r["variant"], r["fold"], r["seed"]) for r in out) == [("both", "fold_1", 1), ("both", "fold_1", 2)]
    assert out[0]["log_loss"] != out[1]["log_loss"]


def test_feature_joins_move_narrow_rows_first(spark):
    """Wins against each other and ranks are joined before the state of both sides widens the rows."""
    maps = spark.createDataFrame(GOLDEN, SCHEMA)
    joined = X.compute_features(maps)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in joined.splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 3 and "h_lo" not in joins[0] and "h_lo" not in joins[1] and "lo#" in joins[2] and "map_name" not in "".join(joins)


def test_row_without_map_or_side_has_no_state(spark):
    rows = spark.createDataFrame(GOLDEN, SCHEMA).withColumn("map_name", F.when(F.col("map_pos") > 1, F.col("map_name")))
    side = X._join_side(rows.withColumn("day", F.to_date("date")), X._by_day(X.team_state(X.daily_history(rows))), "a")
    plain = X.team_state(X.daily_history(rows)).select(F.col("team").alias("team_a_id"), "map_name", F.col("date").alias("day"), "form_90", "map_form", "comfort", "streak")
    want = rows.withColumn("day", F.to_date("date")).join(plain, ["team_a_id", "map_name", "day"], "left")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, want.select("match_id", "map_pos", "form_90", "map_form", "comfort", "streak").collect()), key=key) == sorted(
        map(tuple, side.select("match_id", "map_pos", "a_form_90", "a_map_form", "a_comfort", "a_streak").collect()), key=key)


def _odd_maps(spark):
    rng = random.Random(8)
    teams = ["A", "B", "C", "D", None]
    rows = []
    for i in range(150):
        a, b = rng.choice(teams), rng.choice(teams)
        day = None if i % 17 == 0 else D0 + dt.timedelta(days=rng.randint(0, 60))
        rows.append((f"m{i // 2}", i % 2, rng.choice(["nuke", "mirage", None]), day, a, b, rng.choice([13, 7, None]), rng.choice([5, 16]), rng.choice([a, b, None]),
                     rng.choice([True, False, None]), rng.choice([True, False]), rng.choice([3, 90, None]), 40, rng.choice([True, None]), i % 9 == 0))
    return spark.createDataFrame(rows + rows[:9], SCHEMA)


def test_teams_of_many_rows_have_the_same_state(spark, monkeypatch):
    """Teams beyond ``CROWD`` are summed by day first; rounded, as sums of logarithms depend on their order."""
    maps = _odd_maps(spark)
    def rows():
        days = X._days(maps, maps.limit(5)).withColumn("maps", F.array_sort("maps"))
        return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in days.collect())
    light = rows()
    plain = X._by_day(X.team_state(X.daily_history(maps, maps.limit(5)))).withColumn("maps", F.array_sort("maps"))
    assert light == sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in plain.collect())
    monkeypatch.setattr(X, "CROWD", 55)
    busy = maps.select(F.explode(F.array("team_a_id", "team_b_id")).alias("t")).groupBy("t").count().where("t IS NOT NULL AND count > 55").count()
    assert 0 < busy < 4 and rows() == light


def test_history_is_dealt_out_once(spark):
    """Maps of a team were summed by (team, map, day) in one exchange and dealt out by team in another."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = X._days(spark.createDataFrame(GOLDEN, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [line.count("team") for line in plan.splitlines() if "Exchange hashpartitioning(team#" in line] == [1]


def test_joins_move_no_column_twice(spark):
    """Rows carry their label and picker, not what these are made of, and their day only once."""
    plan = X.compute_features(spark.createDataFrame(GOLDEN, SCHEMA))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    side_b = next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
    moved = next(line for line in plan[side_b + 1:] if "Project [" in line)
    assert not any(f" {c}#" in moved for c in ("winner_id", "team_a_picked", "team_b_picked", "day"))
