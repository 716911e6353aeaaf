import datetime as dt
import random

from rivalry.operators import ordered as O
from rivalry.operators import veto as V

POOL = ["Ancient", "Anubis", "Dust2", "Inferno", "Mirage"]
SCHEMA = ("match_id string, date date, match_format string, team_a_id string, team_b_id string, era_name string, pool array<string>, "
          "actions array<struct<global_action_index int, action_type string, team_id string, opponent_id string, map_name string, team_ban_index int, pool_before array<string>>>, "
          "played array<struct<map string, winner string>>")


def _matches(n: int, seed: int) -> list[tuple]:
    rng, out = random.Random(seed), []
    for i in range(n):
        a, b = rng.sample("ABC", 2)
        maps, left, slots, actions = rng.sample(POOL, 5), list(POOL), {a: 0, b: 0}, []
        for j, m in enumerate(maps):
            # every ban by one side in some matches, so that slots reach the second group
            side, kind = (a if i % 4 == 0 else rng.choice([a, b])), "ban" if i % 4 == 0 else rng.choice(["ban", "ban", "pick"])
            slots[side] += kind == "ban"
            actions.append((j, kind, side, b if side == a else a, m, slots[side] if kind == "ban" else None, list(left)))
            left.remove(m)
        played = [(m, rng.choice([a, b, None])) for m in rng.choices([*POOL, "Train"], k=3)]
        out.append((f"m{i:03d}", dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 40)), rng.choice(["bo1", "bo3"]), a, b, rng.choice(["x", "y"]), POOL, actions, played))
    return out


def _expected(rows: list[tuple], me: tuple, days: int) -> dict:
    """own and opponent's numbers of every signal of every ban of ``me``, counted one by one."""
    past = [r for r in rows if r[5] == me[5] and 0 <= (me[1] - r[1]).days <= days and (r[1], r[0]) < (me[1], me[0])]

    def bans(team, m, fmt=None, slot=None):
        return sum(1 for r in past if fmt in (None, r[2]) for x in r[7] if x[1] == "ban" and team in (None, x[2]) and x[4] == m and slot in (None, x[5]))

    def plays(team, m):
        return sum(1 for r in past if team in r[3:5] for p in r[8] if p[0] == m)

    def wins(team, m):
        total = 0
        for r in past:
            known = [p[1] for p in r[8] if p[0] == m and p[1]]
            total += sum(1 for p in r[8] if p[0] == m) if known and known[-1] == team else 0
        return total

    out = {}
    for x in (x for x in me[7] if x[1] == "ban"):
        t, opp, slot, pool = x[2], x[3], x[5], x[6]
        n = len(pool)
        own = [bans(t, m, me[2], slot) for m in pool]
        every = [bans(t, m, me[2]) for m in pool]
        glob = [bans(None, m, me[2], slot) for m in pool]
        first, other = ([bans(s, m, me[2], 1) for m in pool] for s in (t, opp))
        series = sum(1 for r in past if t in r[3:5])
        pickable = sum(1 for r in past if t in r[3:5] and r[2] != "bo1")
        for i, m in enumerate(pool):
            play = plays(t, m) / series if series else 0.0
            pick = sum(1 for r in past for y in r[7] if y[1] == "pick" and y[2] == t and y[4] == m) / pickable if pickable else 0.0
            out[t, slot, m] = (sum(1 for r in past for y in r[7] if y[1] == "ban" and y[2] == t),
                               (own[i] + 4 / n) / (sum(own) + 4), (every[i] + 4 / n) / (sum(every) + 4), (glob[i] + 5 / n) / (sum(glob) + 5),
                               play, pick, (wins(opp, m) + 2) / (plays(opp, m) + 4), sum(first), sum(other))
    return out


def test_signals_match_brute_force(spark):
    rows = _matches(60, 4)
    got = V.ban_signals(V.with_history(spark.createDataFrame(rows, SCHEMA), 20)).selectExpr("match_id", "team_id", "team_ban_index", "prior_team_bans", "inline(signals)").collect()
    want = {(r[0], *k): v for r in rows for k, v in _expected(rows, r, 20).items()}
    assert len(got) == len(want)
    assert max(r["team_ban_index"] for r in got) > V.SLOTS
    for r in got:
        here = (r["prior_team_bans"], r["slot"], r["eventual"], r["global"], r["own_play_rate"], r["own_pick_rate"], r["threat"], r["raw_first_slot_sample"], r["opponent_raw_first_slot_sample"])
        assert all(abs(a - b) < 1e-12 for a, b in zip(here, want[r["match_id"], r["team_id"], r["team_ban_index"], r["map_name"]]))


def test_a_match_is_few_history_rows(spark):
    """Events and probes of a match share rows with several counts each; one row per count was some 190."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([r for r in _matches(40, 5) if r[2] == "bo3"], SCHEMA).withColumn("range_no", F.lit(0))
    per = V.history_rows(df).groupBy("match_id").count().agg(F.max("count")).first()[0]
    assert per <= 2 * (6 + 1) + 3 * 2 * len(POOL)


def test_maps_share_history_rows(spark):
    """A row per team, per team and group of slots, and per group of slots; a row per map of the pool was some 40."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([r for r in _matches(40, 5) if r[2] == "bo3"], SCHEMA).withColumn("range_no", F.lit(0))
    assert V.history_rows(df).groupBy("match_id").count().agg(F.max("count")).first()[0] <= 2 + 2 * 2 + 2


def test_signals_of_crowds_many_maps_and_repeated_matches(spark, monkeypatch):
    """Teams of many matches, days of many matches, maps beyond one row, and matches that come twice."""
    rows = _matches(60, 4)
    rows += rows[:7]
    want = {(r[0], *k): v for r in rows for k, v in _expected(rows, r, 20).items()}
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in (("CROWD", 44), ("MAPS", 3), ("ROWS_PER_RANGE", 2)):
        monkeypatch.setattr(V, name, value)
        got = V.ban_signals(V.with_history(df, 20)).selectExpr("match_id", "team_id", "team_ban_index", "pool", "prior_team_bans", "inline(signals)").collect()
        assert len(got) == sum(len(x[6]) for r in rows for x in r[7] if x[1] == "ban")
        for r in got:
            here = (r["prior_team_bans"], r["slot"], r["eventual"], r["global"], r["own_play_rate"], r["own_pick_rate"], r["threat"], r["raw_first_slot_sample"], r["opponent_raw_first_slot_sample"])
            assert all(abs(a - b) < 1e-12 for a, b in zip(here, want[r["match_id"], r["team_id"], r["team_ban_index"], r["map_name"]]))
    assert V.map_places(df).parts == 2


def test_pools_come_back_as_they_were(spark):
    """Pools before an action travel as places where they can; a map outside the match's pool, or none, stays."""
    rows = [list(r) for r in _matches(6, 3)]
    rows[0][7] = [(*a[:6], ["Elsewhere", "Dust2"]) for a in rows[0][7]]
    rows[1][7] = [(*a[:6], None) for a in rows[1][7]]
    rows[2][6], rows[3][7] = None, None
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    assert sorted(map(repr, V._full(V._slim(df)).select(*df.columns).collect())) == sorted(map(repr, df.collect()))


def test_counts_read_one_exchange(spark):
    """Whole days, ranges and single ids are summed from one exchange of the rows."""
    e = spark.range(100).selectExpr("CAST(id % 3 AS STRING) AS key", "DATE'2024-01-01' + CAST(id % 9 AS INT) AS date", "CAST(id AS STRING) AS match_id", "1 AS n", "CAST(id % 4 AS INT) AS range_no")
    out = O.counts_before(e, e.select("key", "date", "match_id", "range_no"), ["key"], ["n"], 5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan
    assert plan.count("Exchange hashpartitioning") <= 3


def test_scores_read_values_once(spark):
    rows = _matches(30, 6)
    signals = V.ban_signals(V.with_history(spark.createDataFrame(rows, SCHEMA), 20))
    models = {"uniform": {}, "current": {"current_like": 1.0}, "lock": {"slot": 0.5, "threat": 0.5, "lock_probability": 0.9, "lock_min_sample": 1.0, "lock_min_rate": 0.5}}
    got = V.score_models(signals, V.model_frame(spark, models)).collect()
    assert len(got) == 3 * signals.count()
    locks = 0
    for r in got:
        s = [x.asDict() for x in r["signals"]]
        score = [max(1.0 if r["model"] == "uniform" else x["threat"] + x["own_loss"] if r["model"] == "current" else 0.5 * x["slot"] + 0.5 * x["threat"], 1e-12) for x in s]
        if r["model"] == "current" and r["team_ban_index"] == 1:
            rare = [x["own_play_rate"] < 0.05 and x["own_pick_rate"] < 0.01 for x in s]
            if any(rare):
                score = [x["threat"] if y else 0.0001 for x, y in zip(s, rare)]
        p = [x / sum(score) for x in score]
        assert max(abs(a - b) for a, b in zip(p, r["base"])) < 1e-12
        if r["model"] == "lock" and r["team_ban_index"] == 1:
            best = max(range(len(s)), key=lambda i: (s[i]["raw_first_slot_rate"], -i))
            if s[best]["raw_first_slot_sample"] >= 1 and s[best]["raw_first_slot_rate"] >= 0.5:
                locks += 1
                p = [0.9 if i == best else 0.1 * x / (sum(p) - p[best]) for i, x in enumerate(p)]
        assert max(abs(a - b) for a, b in zip(p, r["probs"])) < 1e-12
    assert locks
