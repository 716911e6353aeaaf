"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

How pieces are packed depends on their lengths alone, and there are at most ``capacity``
different lengths, so the plan is made on the histogram: a bin is filled greedily with the
largest lengths that fit; then its smallest piece is replaced by two unpacked pieces that
fill its place and the gap more tightly, as long as that helps. The pattern found is used
as many times as the counts allow. The plan's size is bounded by the capacity, whatever
the corpus. Pieces then look up their place by (length, rank among equal lengths).

Defined cases: a null text is empty and becomes a piece of the end id alone; an empty table
gives no rows; null or repeated ids are separate documents; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivalry.llm.memory import released
from rivalry.llm.tokens import encoder, together
from rivalry.session import persist_table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows that one task orders when equal lengths are numbered.
RANKED = 8192


def cut_documents(docs: DataFrame, capacity: int = 1024, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2,
                  keeps_blanks: bool = True, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece. Documents up to the capacity stay whole; of longer ones the first
    piece takes the remainder and all others are full. ``with_ids`` adds the ids themselves."""

    def run(batches):
        enc = encoder(vocabulary, keeps_blanks)
        for batch in batches:
            for part in together(batch, 1):
                out = [[] for _ in range(6)]
                bounds, every = enc.encode_all(part.column(1), end_id)
                for key, first, last in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    ids = every[first:last]
                    edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for no, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                        for column, value in zip(out, (key, no, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].view(np.int32))):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:n], kinds)], names=names[:n])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(released(run), PIECES + (", ids array<int>" if with_ids else ""))


def plan_bins(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """counts[l] pieces of length l -> [(number of bins, [(length, pieces of it in a bin)])]."""
    capacity = len(counts) - 1
    left, lengths = counts.astype(np.int64).copy(), np.arange(capacity + 1)
    left[0] = 0
    plan = []
    while left.any():
        free = left.copy()
        below = np.maximum.accumulate(np.where(free > 0, lengths, 0))  # largest length left that is <= x
        gap, content = capacity, {}
        while gap and (pick := int(below[gap])):
            many = min(gap // pick, int(free[pick]))
            content[pick] = content.get(pick, 0) + many
            free[pick] -= many
            gap -= many * pick
            if not free[pick]:
                below = np.maximum.accumulate(np.where(free > 0, lengths, 0))
        while gap:
            smallest = min(content)
            room = gap + smallest
            first = np.flatnonzero(free[:room])
            if not len(first):
                break
            below = np.maximum.accumulate(np.where(free > 0, lengths, 0))
            second = below[room - first]
            lower = np.where(second > 0, below[np.maximum(second - 1, 0)], 0)
            second = np.where((second == first) & (free[first] < 2), lower, second)
            total = np.where(second > 0, first + second, 0)
            best = int(total.argmax())
            if total[best] <= smallest:
                break
            content[smallest] -= 1
            free[smallest] += 1
            if not content[smallest]:
                del content[smallest]
            for x in (int(first[best]), int(second[best])):
                content[x] = content.get(x, 0) + 1
                free[x] -= 1
            gap = room - int(total[best])
        times = min(int(left[x]) // m for x, m in content.items())
        for x, m in content.items():
            left[x] -= times * m
        plan.append((times, sorted(content.items(), reverse=True)))
    return plan


def _places(plan) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> arrays over its intervals: first rank, bins, first sequence, offset in the bin."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for bins, content in plan:
        offset = 0
        for length, many in content:
            found.setdefault(length, []).append((used.get(length, 0), bins, sequence, offset))
            used[length] = used.get(length, 0) + many * bins
            offset += many * length
        sequence += bins
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in found.items()}


def pack(pieces: DataFrame, capacity: int = 1024, keys: tuple[str, ...] = ("doc_id", "piece", "ids_crc32"), length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a length of 1 to ``capacity``.

    ``pieces`` should be a stored table: it is read for the histogram and again for the
    ranks. Ranks among equal lengths are numbered in buckets of about ``RANKED`` rows whose
    number follows the row count, so no length is ordered in one task.
    """
    histogram = pieces.groupBy(length).agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in histogram:
        if not 1 <= (row[0] or 0) <= capacity:
            raise ValueError(f"a piece has length {row[0]}; it must be 1 to {capacity}")
        counts[row[0]] = row[1]
    places = _places(plan_bins(counts))
    buckets = max(1, -(-int(counts.sum()) // RANKED))
    rows = pieces.withColumn("pack_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sums = rows.groupBy(length, "pack_bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(length).orderBy("pack_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(length, "pack_bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("pack_base"))
    inside = Window.partitionBy(length, "pack_bucket").orderBy(*keys)
    ranked = (rows.withColumn("pack_rank", F.row_number().over(inside) - 1).join(bases, [length, "pack_bucket"])
              .select(*pieces.columns, (F.col("pack_rank") + F.col("pack_base")).cast("long").alias("pack_rank")))

    def locate(batches):
        for batch in batches:
            size = np.asarray(batch.column(batch.schema.get_field_index(length)), dtype=np.int64)
            rank = np.asarray(batch.column(batch.schema.get_field_index("pack_rank")), dtype=np.int64)
            sequence, offset = np.empty_like(size), np.empty_like(size)
            for x in np.unique(size):
                at = np.flatnonzero(size == x)
                first, bins, begin, inner = places[int(x)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                slot, no = np.divmod(rank[at] - first[i], bins[i])
                sequence[at], offset[at] = begin[i] + no, inner[i] + slot * x
            kept = [c for c in batch.schema.names if c != "pack_rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(sequence), pa.array(offset)],
                                             names=[*kept, "sequence_id", "offset"])

    schema = ", ".join([f"`{c}` {t}" for c, t in pieces.dtypes] + ["sequence_id long", "offset long"])
    return ranked.mapInArrow(locate, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, **how) -> DataFrame:
    """Cuts, stores the narrow piece table once, and packs it."""
    return pack(persist_table(cut_documents(docs, capacity, **how)), capacity)


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids): pieces of a sequence joined by offset; at most ``capacity`` ids a group."""
    parts = packed_with_ids.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
