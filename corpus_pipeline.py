"""Documents to packed training sequences: rules, near duplicates, secrets, mixture, packing.

Every stage works on all rows its predecessor kept. Defined cases: empty tables pass through;
null texts have no words and go at the first stage; rows with a null id are never near
duplicates of others; rows of one id with different texts are different documents for the
near-duplicate stage, rows that repeat id and text are one; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.llm import jaccard, mixing, packing, quality, secrets
from rivalry.session import persist_table

ROW, NUMBER, DIGEST, AGAIN, FIRST = "corpus_row", "corpus_number", "corpus_digest", "corpus_again", "corpus_first"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass every rule of the policy."""
    return quality.apply_policy(quality.rule_ledger(docs), "v1").where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the smallest id.

    A document is known by its id and its text. Of an id that stands at several texts one
    keeps the id as its number, the others get numbers beyond all usual ids, so that they never
    stand for a group before an ordinary document; rows that repeat both are one document.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest")).where("doc_id IS NOT NULL")
    several = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("first")).where("n > 1").drop("n")
    again = persist_table(several)  # stored, so that the joins can split an id of many rows
    held = docs.withColumn(DIGEST, F.xxhash64("text")).join(again.select(F.col("doc_id").alias(AGAIN), F.col("first").alias(FIRST)),
                                                            F.col("doc_id") == F.col(AGAIN), "left")
    far = F.shiftrightunsigned(F.xxhash64("doc_id", DIGEST), 2).bitwiseOR(F.lit(1 << 62))
    number = F.when(F.col(AGAIN).isNotNull() & (F.col(DIGEST) != F.col(FIRST)), far).otherwise(F.col("doc_id").cast("long"))
    numbered = held.select(*[F.col(f"`{c}`") for c in docs.columns], number.alias(NUMBER), F.col(AGAIN).isNotNull().alias(AGAIN))
    found = jaccard.similar_documents(numbered, 5, 80, doc_id=NUMBER)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(NUMBER)).distinct()
    kept = numbered.join(gone, NUMBER, "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    single = kept.where(~F.col(AGAIN)).select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = kept.where(AGAIN).groupBy(NUMBER).agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias(ROW)).select(f"{ROW}.*")
    return single.unionByName(repeated.select(*[F.col(f"`{c}`") for c in docs.columns]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret; the document stays, with its length counted again."""
    clean = secrets.redactor()(F.col("text"))
    out = docs.select(*[clean.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    rows = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))
    mixed = mixing.mix(rows, keep=(ROW,)).where("times > 0")
    return mixed.select(F.explode(F.array_repeat(ROW, F.col("times"))).alias(ROW)).select(f"{ROW}.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: The vocabulary and the hashes of the stages cannot be written in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = persist_table(docs)
    return docs
