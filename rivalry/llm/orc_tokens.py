"""Token ids in ORC files, in ascending document order.

Each file holds one range of document ids. ORC stores the integers run-length encoded in
stripes of ``stripe_bytes``, with a row index every ``index_rows`` rows and a Bloom filter on
the document id, so readers take stripes in parallel and skip those whose statistics or
filter exclude an id.

Defined cases: a null text is empty and holds the end id alone; an empty table gives no
files with rows; null ids come first; rows that repeat an id stay together in one file and
are counted in the order of their ids' lengths and contents; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivalry.llm.memory import released
from rivalry.llm.tokens import encoder, together
from rivalry.session import persist_table

#: Text bytes of one file.
FILE_BYTES = 64 << 20


def encode_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, keeps_blanks: bool = False,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): every whole text encoded, ``end_id`` appended."""

    def run(batches):
        enc = encoder(vocabulary, keeps_blanks)
        for batch in batches:
            for part in together(batch, 1):
                offsets, ids = enc.encode_all(part.column(1), end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(released(run), "doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, keeps_blanks: bool = False,
                 doc_id: str = "doc_id", text: str = "text", stripe_bytes: int = 16 << 20, index_rows: int = 1000,
                 file_bytes: int = FILE_BYTES) -> str:
    """Writes the ids sorted by document id. Texts cross the network once and are encoded after
    that, because compressed text is smaller than ids."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parallel = source.sparkSession.sparkContext.defaultParallelism
    ranged = source.repartitionByRange(max(parallel, -(-size // file_bytes)), F.col("doc_id").asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    (encode_documents(ordered, vocabulary, end_id, keeps_blanks).write.mode("overwrite")
     .option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("compression", "zstd").orc(path))
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows; a filter on ``doc_id`` reaches the stripes' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def _measure(batches):
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("ids"))
        flat, offsets = np.asarray(col.flatten(), dtype="<u4"), np.asarray(col.offsets) - col.offsets[0].as_py()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "file", "n_tokens", "ids_crc32"])


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: (doc_id, start, n_tokens, ids_crc32, file).

    Files are ordered by their first id and summed in a table of one row per file; the
    running sum inside a file orders only that file's documents.
    """
    stored = read_tokens(spark, path).select("doc_id", F.col("_metadata.file_name").alias("file"), "ids")
    rows = persist_table(stored.mapInArrow(released(_measure), "doc_id long, file string, n_tokens long, ids_crc32 long"))
    files = rows.groupBy("file").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(offsets, "file").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "file")
