"""Keyed tables, rebalanced writes, run scopes and late rows of streams."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from rivalry.operators import corpus as Q
from rivalry.session import persist_table, run_scope, shared_folder
from rivalry.sources import sinks as SK
from rivalry.sources.keyed import KeyedTable
from rivalry.streaming import wrappers as ST


def test_merge_rewrites_touched_buckets_only(spark):
    table = KeyedTable(spark, shared_folder(spark), ["k"], buckets=16)
    table.create(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    table.create(spark.range(5).select(F.col("id").alias("k"), F.lit("again").alias("v")))  # exists already
    new = spark.createDataFrame([(3, "new"), (5000, "added")], "k long, v string")
    touched = table.merge(new, "one")
    assert 1 <= len(touched) <= 2
    assert len({os.path.dirname(f) for f in glob.glob(f"{table.path}/data/version=1/bucket=*/*.parquet")}) == len(touched)
    rows = {r.k: r.v for r in table.read().collect()}
    assert len(rows) == 1001 and rows[3] == "new" and rows[5000] == "added" and rows[4] == "old"
    assert table.merge(spark.createDataFrame([(3, "replayed")], "k long, v string"), "one") == []
    # a merge that failed before its commit is not seen, and its repetition overwrites what it left
    spark.createDataFrame([(7, "half")], "k long, v string").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table.path}/data/version=2")
    assert {r.k: r.v for r in table.read().collect()} == rows
    table.merge(spark.createDataFrame([(7, "whole"), (None, "null key")], "k long, v string"), "two")
    after = {r.k: r.v for r in table.read().collect()}
    assert after == rows | {7: "whole", None: "null key"}
    empty = KeyedTable(spark, shared_folder(spark), ["k"])
    empty.create(new.where("false"))
    assert empty.read().count() == 0
    empty.merge(new, "first")
    assert empty.read().count() == 2


def test_a_merge_moves_its_rows_once(spark, monkeypatch):
    table = KeyedTable(spark, shared_folder(spark), ["k"], buckets=16)
    table.create(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    write, plans = table._write, []
    monkeypatch.setattr(table, "_write", lambda df, *rest: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *rest)))
    table.merge(spark.range(0, 1000, 10).select(F.col("id").alias("k"), F.lit("new").alias("v")), "one")
    assert plans[0].count("Exchange hashpartitioning") == 1  # merging and writing by bucket read the same exchange
    assert table.read().where(F.col("v") == "new").count() == 100 and table.read().count() == 1000


def test_arrivals_of_the_ledger_stream_read_their_own_part(spark, monkeypatch):
    from rivalry.plans import stream_queries as SQ
    from rivalry.plans.registry import Tables

    parts = []
    rows = spark.range(50).select(F.col("id").alias("match_key"), F.lit("x").alias("url"))
    ledger = spark.createDataFrame([("x", "Pending")], "match_url string, result string")
    monkeypatch.setattr(SQ, "corpus", lambda t: rows)
    monkeypatch.setattr(SQ, "ledger_for_corpus", lambda t: ledger)
    monkeypatch.setattr(SQ, "_snaps", lambda t: ledger)
    monkeypatch.setattr(SQ.ST, "settle_stream", lambda *a: lambda part, i: parts.append(part) or [])
    assert SQ.settle_ledger(Tables(spark, "/none")).count() == 1
    assert [p.columns for p in parts] == [rows.columns] * 2
    assert all({r.match_key for r in p.collect()} == {r.match_key for r in rows.where(F.pmod(F.xxhash64("match_key"), F.lit(5)) == i).collect()}
               for p, i in zip(parts, (1, 4)))
    assert all("PartitionFilters: [isnotnull(arrival" in p._jdf.queryExecution().executedPlan().toString() for p in parts)


def test_nested_columns_nobody_reads_are_not_built(spark):
    from rivalry.plans.registry import corpus

    rows = spark.range(3).select(F.col("id").alias("match_key"), F.lit("x").alias("url"), F.array(F.lit("line")).alias("match_info"),
                                 F.array(F.concat(F.lit("veto "), F.col("id").cast("string"))).alias("hltv_vetoes"), F.array(F.lit("map")).alias("hltv_maps"),
                                 F.array(F.struct(F.lit("a").alias("team"), F.lit("#1").alias("world_rank"), F.lit("#2").alias("vrs_before_rank"))).alias("ranks"))
    t = type("T", (), {"view": lambda self, name: rows})()
    whole, part = corpus(t), corpus(t, without=("hltv_vetoes",))
    assert part.columns == [c for c in whole.columns if c != "hltv_vetoes"]
    assert part.collect() == whole.drop("hltv_vetoes").collect()
    assert "veto " in whole._jdf.queryExecution().optimizedPlan().toString()
    assert "veto " not in part._jdf.queryExecution().optimizedPlan().toString()


def test_clean_files_and_pruning(spark):
    days = spark.range(900).select((F.col("id") % 90).cast("int").alias("n"), F.col("id").alias("match_id"))
    df = days.select("match_id", F.date_add(F.lit("2024-01-10").cast("date"), F.col("n")).alias("date"))
    path = shared_folder(spark)
    assert SK.write_clean(df, path).count() == 900
    assert len(glob.glob(f"{path}/month=*/*.parquet")) <= 2 * len(glob.glob(f"{path}/month=*"))
    part = SK.read_clean(spark, path, "2024-02-01", "2024-02-11")
    assert part.count() == 100 and part.columns == ["match_id", "date"]
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_run_scope_deletes_its_folders(spark):
    with run_scope(spark):
        kept = persist_table(spark.range(5))
        path = kept.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "").replace("file:", "")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def test_late_rows_are_routed_and_a_replay_changes_nothing(spark):
    source, path = shared_folder(spark), shared_folder(spark)
    schema = "id long, ts timestamp"
    day = lambda d: dt.datetime(2024, 1, d)
    for rows in ([(1, day(1)), (2, day(10))], [(3, day(9)), (4, day(2)), (5, None)], [(6, day(20)), (7, day(7))]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        ST.route_late(spark.readStream.schema(schema).parquet(source), path, "ts", "2 days")
    assert [tuple(r) for r in ST.accounts(spark, path).orderBy("batch").select("batch", "sent", "kept", "late").collect()] == [(0, 2, 2, 0), (1, 3, 2, 1), (2, 2, 1, 1)]
    assert {r.id for r in ST.routed(spark, path, schema, late=True).collect()} == {4, 7}
    ST.route_late(spark.readStream.schema(schema).parquet(source), path, "ts", "2 days")  # nothing new
    assert ST.accounts(spark, path).agg(F.sum("sent")).first()[0] == 7


def test_streak_counts_series_since_the_last_loss(spark):
    rows = [(m, p, "nuke", dt.date(2024, 1, d), "A", "B", w, False) for m, p, d, w in
            [(1, 1, 1, "A"), (2, 1, 2, "B"), (3, 1, 3, "A"), (4, 1, 4, "A"), (4, 2, 4, "B"), (4, 3, 4, "A"), (5, 1, 9, "A")]]
    maps = spark.createDataFrame([(*r, False, False) for r in rows], "match_id long, map_pos int, map_name string, date date, team_a_id string, team_b_id string, winner_id string, "
                                 "match_has_forfeit boolean, team_a_picked boolean, team_b_picked boolean")
    got = {r.team: (r.win_streak, r.last_loss) for r in Q.team_streak(maps, "2024-01-08").collect()}
    assert got == {"A": (2, dt.date(2024, 1, 2)), "B": (0, dt.date(2024, 1, 4))}
