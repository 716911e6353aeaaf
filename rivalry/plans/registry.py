"""Query registry: one Spark callable and one independent SQL check per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from rivalry.session import persist_table
from rivalry.sources.adapters import DUCK, Dialect, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Base tables and contest views of one data folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.dialect = Dialect("spark", self.folder, tasks)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str, columns: str = "*", players: bool = True) -> DataFrame:
        return self.spark.sql(f"{with_clause(replace(self.dialect, players=players), name)} SELECT {columns} FROM {name}")

    def stored(self, name: str, columns: str = "*") -> DataFrame:
        """The view written once, for queries that read it several times."""
        return persist_table(self.view(name, columns))

    def local(self, rows: list, schema: str) -> DataFrame:
        """A fixed dimension (pools, models, templates) as a DataFrame."""
        return self.spark.createDataFrame(rows, schema)


def query(name: str, oracle: str | None = None):
    """Registers ``fn(tables)`` as a query; ``oracle`` is its SQL check, if it has one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def over(*views: str, body: str) -> str:
    """SQL check over contest views; ``body`` may open with further ``, x AS (...)`` parts."""
    return f"{with_clause(DUCK, *views)} {body}"


def corpus(t: Tables, without: tuple[str, ...] = ()) -> DataFrame:
    """Nested records with ranks keyed by team name, as the reader yields them.

    Nested columns that a query does not read are left out by ``without``; the boundary
    that computes the others once would keep them. ``player_stats`` stands for the players
    inside ``hltv_maps``.
    """
    from pyspark.sql import functions as F

    pairs = F.transform("ranks", lambda r: F.struct(
        r["team"].alias("key"), F.struct(r["world_rank"].alias("world_rank"),
                                         r["vrs_before_rank"].alias("vrs_before_rank")).alias("value")))
    from rivalry.functions.text import settle

    nested = {"team_ranks": F.map_from_entries(pairs), **{c: F.col(c) for c in ("match_info", "hltv_vetoes", "hltv_maps")}}
    rows = t.view("corpus", players=False) if "player_stats" in without else t.view("corpus")
    d = settle(rows, **{c: e for c, e in nested.items() if c not in without})
    return d.drop("ranks", *without)
