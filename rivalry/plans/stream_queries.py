"""Streams that arrive in several batches, with late, repeated and replayed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.operators import ledger as L
from rivalry.plans.registry import Tables, corpus, over, query
from rivalry.plans.report_queries import _AS_OF, _snaps, ledger_for_corpus, settled_sql
from rivalry.session import shared_folder
from rivalry.sources.keyed import KeyedTable
from rivalry.streaming import wrappers as ST

ARRIVALS, DELAY = 6, "2 days"
EVENT = "event_id long, user_id long, ts timestamp, value double"

# every 20th event arrives two arrivals after its time, every 7th one arrival
ARRIVED = """arrived AS (
    SELECT event_id, user_id, ts, value, CAST(least(5, event_id * 6 // (SELECT max(event_id) + 1 FROM events)
           + CASE WHEN event_id % 20 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS INT) AS batch FROM events),
high AS (SELECT batch, max(ts) AS high FROM arrived GROUP BY 1),
mark AS (SELECT batch, max(high) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM high),
judged AS (SELECT a.*, coalesce(a.ts < m.mark, false) AS is_late FROM arrived a JOIN mark m USING (batch))"""


def _arrivals(t: Tables) -> list[DataFrame]:
    """The events in the batches they arrive in."""
    e = t.read("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    n = e.agg(F.max("event_id")).first()[0] + 1
    later = F.when(F.col("event_id") % 20 == 0, 2).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    at = F.least(F.lit(ARRIVALS - 1), F.floor(F.col("event_id") * ARRIVALS / n) + later)
    return [e.where(at == i) for i in range(ARRIVALS)]


def _routed(t: Tables) -> str:
    """Every arrival is written to the source's folder and drained as one batch."""
    source, path = shared_folder(t.spark), shared_folder(t.spark)
    for rows in _arrivals(t):
        rows.write.mode("append").parquet(source)
        ST.route_late(t.spark.readStream.schema(EVENT).parquet(source), path, "ts", DELAY)
    return path


@query("ST1_late_accounts", f"WITH {ARRIVED} SELECT batch, count(*) AS sent, count(*) FILTER (NOT is_late) AS kept, count(*) FILTER (is_late) AS late FROM judged GROUP BY 1")
def late_accounts(t):
    return ST.accounts(t.spark, _routed(t)).select("batch", "sent", "kept", "late")


@query("ST1_late_rows", f"WITH {ARRIVED} SELECT event_id, batch FROM judged WHERE is_late")
def late_rows(t):
    return ST.routed(t.spark, _routed(t), EVENT, late=True).select("event_id", "batch")


@query("ST1_snapshots_resent", f"WITH {ARRIVED} SELECT event_id, user_id FROM judged WHERE NOT is_late")
def snapshots_resent(t):
    """Kept rows, a third of them sent again with the next batch, appended once."""
    path, source, out = _routed(t), shared_folder(t.spark), shared_folder(t.spark)
    kept = ST.routed(t.spark, path, EVENT)
    for i in range(ARRIVALS):
        rows = kept.where(F.col("batch") == i).unionByName(kept.where((F.col("batch") == i - 1) & (F.col("event_id") % 3 == 0)))
        rows.drop("batch").write.mode("append").parquet(source)
        ST.drain(ST.stream_snapshots(t.spark.readStream.schema(EVENT).parquet(source), "event_id", "ts", "30 days").select("event_id", "user_id"), out, "append")
    return t.spark.read.parquet(f"{out}/data").select("event_id", "user_id")


def _kept_stream(t: Tables, transform, keys: list[str]) -> tuple[DataFrame, int]:
    """Newest rows of an aggregate over the kept rows, drained batch by batch, and how many rows its state dropped."""
    path, source, out, dropped = _routed(t), shared_folder(t.spark), shared_folder(t.spark), 0
    kept = ST.routed(t.spark, path, EVENT)
    for i in range(ARRIVALS):
        kept.where(F.col("batch") == i).drop("batch").write.mode("append").parquet(source)
        dropped += sum(p["dropped"] for p in ST.drain(transform(t.spark.readStream.schema(EVENT).parquet(source)), out, "update"))
    return ST.latest_updates(t.spark, out, keys), dropped


@query("ST3_period_trend_batches", f"""WITH {ARRIVED} SELECT CAST(date_trunc('week', ts) AS DATE) AS period_start, count(*) AS matches,
    CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS forfeits, 0 AS dropped FROM judged WHERE NOT is_late GROUP BY 1""")
def trend_batches(t):
    target = lambda s: s.withColumn("forfeit_target", F.when(F.col("value") > 10, 1).otherwise(0))
    rows, dropped = _kept_stream(t, lambda s: ST.stream_period_trend(target(s), "ts", "forfeit_target", "week", "21 days"), ["period_start"])
    return rows.withColumn("dropped", F.lit(dropped))


@query("ST4_form_batches", f"""WITH {ARRIVED} SELECT CAST(CAST(ts AS DATE) + k AS DATE) AS day, user_id, count(*) AS maps,
    CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM judged, (SELECT CAST(unnest(range(1, 8)) AS INT) AS k) WHERE NOT is_late GROUP BY 1, 2""")
def form_batches(t):
    won = lambda s: s.withColumn("won", F.when(F.col("value") > 10, 1).otherwise(0))
    return _kept_stream(t, lambda s: ST.stream_form(won(s), "ts", "user_id", "won", 7, "21 days"), ["day", "user_id"])[0]


@query("ST2_settle_ledger", settled_sql(f"""SELECT match_url, CASE WHEN old = 'Pending' AND match_date || ' ' || match_time <= '{_AS_OF}' AND resolved IS NOT NULL
    THEN resolved ELSE old END AS result FROM sj"""))
def settle_ledger(t):
    """Records arrive in five batches; each settles its pending rows, and two batches are replayed."""
    spark, source, path = t.spark, shared_folder(t.spark), shared_folder(t.spark)
    table = KeyedTable(spark, shared_folder(spark), ["match_url"])
    table.create(ledger_for_corpus(t))
    snapshots = _snaps(t).limit(0)

    def settle(batch: DataFrame, rows: DataFrame) -> DataFrame:
        pending = rows.where(F.col("result") == "Pending")
        after = L.settle_pending(pending, snapshots, batch, _AS_OF)[0]
        return after.where(F.col("result") != "Pending")

    dealt, records = shared_folder(spark), corpus(t)  # written once by arrival, so that each arrival reads its own part alone
    arrivals = records.withColumn("arrival", F.pmod(F.xxhash64("match_key"), F.lit(5)).cast("int"))
    arrivals.write.partitionBy("arrival").parquet(dealt)
    arrivals = spark.read.schema(arrivals.schema).parquet(dealt)
    parts = [arrivals.where(F.col("arrival") == i).drop("arrival") for i in range(5)]
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(source)
        handle = ST.settle_stream(spark.readStream.schema(records.schema).parquet(source), path, table, settle)
        if i in (1, 4):
            assert handle(part, i) == [], "a replayed batch must change nothing"
    return table.read().select("match_url", "result")


@query("SNK4_partial_rewrite", over("ledger_matches", body=""" SELECT match_url, CASE WHEN match_url % 100 = 0 THEN 'new' ELSE result END AS result FROM ledger_matches
    UNION ALL SELECT match_url + 10000000, 'new' FROM ledger_matches WHERE match_url % 300 = 0"""))
def partial_rewrite(t):
    """One row in a hundred is merged: only the buckets of those keys are rewritten, and a repeated merge changes nothing."""
    m = t.view("ledger_matches").select("match_url", "result")
    table = KeyedTable(t.spark, shared_folder(t.spark), ["match_url"])
    table.create(m)
    new = m.where(F.col("match_url") % 100 == 0).select("match_url", F.lit("new").alias("result"))
    extra = m.where(F.col("match_url") % 300 == 0).select((F.col("match_url") + 10000000).alias("match_url"), F.lit("new").alias("result"))
    table.merge(new.unionByName(extra), "first")
    table.merge(new.withColumn("result", F.lit("twice")), "first")
    return table.read()
