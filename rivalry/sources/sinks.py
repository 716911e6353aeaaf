"""Parquet, CSV and JSON sinks, and keyed rewrites without a table format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.operators.ordered import last_row
from rivalry.session import persist_table, shared_folder


def write_clean(df: DataFrame, path: str | None, partition: bool = True) -> DataFrame:
    """Writes rows partitioned by month of ``date`` and reads them back.

    Rows are rebalanced by month: adaptive execution cuts a large month into files of its
    advisory size and puts small ones together, whatever the table's size.
    """
    target = path or shared_folder(df.sparkSession)
    if partition and "date" in df.columns:
        out = df.withColumn("month", F.date_format("date", "yyyy-MM")).hint("rebalance", "month")
        out.write.mode("overwrite").partitionBy("month").parquet(target)
    else:
        df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target).select(*df.columns)


def read_clean(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of ``since`` <= date < ``until`` (days); the bounds prune whole months of a partitioned table."""
    df = spark.read.parquet(path)
    day = F.to_date("date")
    for bound, keep, months in ((since, lambda b: day >= b, lambda b: F.col("month") >= F.date_format(b, "yyyy-MM")),
                                (until, lambda b: day < b, lambda b: F.col("month") <= F.date_format(b, "yyyy-MM"))):
        if bound is not None:
            b = F.lit(bound).cast("date")
            df = df.where(keep(b))
            df = df.where(months(b)) if "month" in df.columns else df
    return df.drop("month")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, so that JSON stays strict."""
    bad = ("double", "float")
    return df.select(*[F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c)
                       if t in bad else F.col(c) for c, t in df.dtypes])


def as_json_rows(df: DataFrame) -> DataFrame:
    return finite(df).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_metrics_json(df: DataFrame, path: str) -> None:
    finite(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def merge_records(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None,
                  deal: str | None = None) -> DataFrame:
    """Stored rows replaced by incoming rows of the same key, new keys appended.

    Two rows per key at most survive map-side combining; the last incoming one wins. Rows
    that are dealt out by ``deal``, one of the keys, stay where they are afterwards.
    """
    seq = F.col(order) if order else F.lit(0)
    both = (stored.withColumn("is_new", F.lit(0)).withColumn("seq", F.lit(None).cast("long"))
            .unionByName(incoming.withColumn("is_new", F.lit(1)).withColumn("seq", seq.cast("long")), allowMissingColumns=True))
    both = both.repartition(deal) if deal else both
    return last_row(both, keys, ["is_new", "seq"]).drop("is_new", "seq")


def rewrite_table(df: DataFrame, path: str) -> DataFrame:
    """Writes the new version to a fresh folder; the caller then points readers at it."""
    return persist_table(df, path)
