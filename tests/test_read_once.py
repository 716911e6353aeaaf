"""Queries that read only what they use, and only once."""

import datetime as dt
import os

import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from rivalry.operators import models as ML
from rivalry.operators import veto as V
from rivalry.plans import load_all
from rivalry.plans import model_queries as MQ
from rivalry.plans import veto_queries as VQ
from rivalry.plans.registry import QUERIES, Tables, corpus

load_all()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, k * 7 % 50, dt.date(1996, 1, 1) + dt.timedelta(days=k), "P" if k % 5 == 0 else "O", "1-URGENT") for k in range(200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.range(9).select(F.col("id").alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    return Tables(spark, folder)


def test_unread_players_and_columns_are_left_out(spark, tables):
    whole, short = corpus(tables), corpus(tables, VQ.NOT_VETO)
    fields = lambda d: d.schema["hltv_maps"].dataType.elementType.fieldNames()
    assert "player_stats" in fields(whole) and fields(short) == [f for f in fields(whole) if f != "player_stats"]
    assert not {"hltv_maps", "match_info", "team_ranks"} & set(VQ.veto_corpus(tables, VQ.NOT_ERA).columns)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(V.ban_history(short), V.ban_history(whole))
    eras = V.era_frame(spark, VQ.ERAS)
    named = lambda without: V.resolve_eras(VQ.veto_corpus(tables, without), eras, ["url"]).select("url", "era.name")
    assert same(named(VQ.NOT_ERA), named(()))


def test_maps_are_read_once_for_team_stats(spark):
    read = spark.sparkContext.accumulator(0)
    day = dt.date(2000, 6, 1)
    rows = [(i, day, i % 3, 3 + i % 2, "bo3", ["Mirage", "Nuke"][i % 2], i % 3, True, False) for i in range(40)]
    maps = spark.createDataFrame(rows, "match_id long, date date, team_a_id long, team_b_id long, match_format string, map_name string, winner_id long, team_a_picked boolean, team_b_picked boolean")

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield pa.RecordBatch.from_arrays(b.columns, names=b.schema.names)

    got = V.team_map_stats(maps.mapInArrow(counted, maps.schema), "2000-06-30").where("sample > 0").select("team", "sample", "total_series").collect()
    assert read.value == 40 and sum(r["sample"] for r in got) == 80


def test_stats_are_worked_out_once_for_series_over_paths(tables, monkeypatch):
    calls = []
    stats = tables.local([(f"{s} {k}", m, 0.5, 0.2) for s in ("TEAM", "SQUAD") for k in range(3) for m in ("Mirage", "Nuke")], "team string, map_name string, win_rate double, pick_rate double")
    pairs = tables.local([("TEAM 0", "SQUAD 1", "bo1")], "team_a string, team_b string, match_format string")
    monkeypatch.setattr(MQ, "named_stats", lambda t: calls.append(1) or stats)
    monkeypatch.setattr(MQ, "matchups", lambda t: pairs)
    assert QUERIES["M7_series_over_paths"](tables.spark, tables.folder).count() == 1 and len(calls) == 1


def test_grid_prepares_vectors_once(spark, monkeypatch):
    rows = [(float(i % 17), "abc"[i % 3], int(i % 17 + (i * 7) % 11 > 12)) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, k string, y int")
    train, val = df.where("x < 14"), df.where("x >= 5")
    scale = ML.fit_scale(train, ["x"])
    tr, va = ML.standardise(train, scale, ["x"]), ML.standardise(val, scale, ["x"])
    plain = ML.logistic_pipeline(["x"], ["k"], 0.3, train.count(), "y").fit(tr)
    fits, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    model, losses = ML.fit_logistic_grid(train, val, ["x"], ["k"], "y", (0.3, 1e-6))
    assert len(fits) == 1 and losses[0.3] < losses[1e-6]
    a, b = (sorted(r["p"] for r in ML.score_frame(m, va).select("p").collect()) for m in (plain, model))
    assert a == pytest.approx(b, abs=1e-9)


def test_written_matches_are_compressed(tables, monkeypatch):
    seen = []
    read = MQ.RD.read_matches
    monkeypatch.setattr(MQ.RD, "read_matches", lambda spark, path, *a: seen.append(path) or read(spark, path, *a))
    got = QUERIES["SRC1_read_matches"](tables.spark, tables.folder).collect()
    c = corpus(tables).select("url", "event", F.size("hltv_maps").cast("long"), F.size("match_info").cast("long")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, c)) and len(got) == 200
    parts = [f for f in os.listdir(seen[0]) if f.startswith("part-")]
    assert parts and all(f.endswith(".json.lz4") for f in parts)
