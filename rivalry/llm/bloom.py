"""Semi-join reduction by a Bloom filter of fixed size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: a constant, so what is broadcast does not grow with the data.
BITS = 1 << 23
CHUNK = 1 << 16


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(BITS)).astype(np.int64) for i in range(3)]


def thin_out(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``rows`` whose ``column`` (a 64-bit hash) may be in ``keys``. Only an exact join
    afterwards decides; where the filter is full it lets every row through."""

    def collect(batches):
        bits = np.zeros(BITS, dtype=bool)
        for batch in batches:
            for at in _slots(np.asarray(batch.column(0))):
                bits[at] = True
        packed = np.packbits(bits).reshape(-1, CHUNK)
        used = [i for i in range(len(packed)) if packed[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[i].tobytes() for i in used], pa.binary())], names=["part", "bits"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[part] = held[part] | np.frombuffer(b, np.uint8) if part in held else np.frombuffer(b, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["part", "bits"])

    schema = "part int, bits binary"
    parts = keys.select(F.col(column).cast("long")).mapInArrow(collect, schema)
    merged = parts.repartition(BITS // 8 // CHUNK, "part").mapInArrow(merge, schema).collect()  # one megabyte at most
    whole = np.zeros((BITS // 8 // CHUNK, CHUNK), dtype=np.uint8)
    for r in merged:
        whole[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(whole.tobytes())

    @F.arrow_udf("boolean")
    def maybe(column_: pa.Array) -> pa.Array:
        bits = np.frombuffer(held.value, dtype=np.uint8)
        hit = np.ones(len(column_), dtype=bool)
        for at in _slots(np.asarray(column_.fill_null(0))):
            hit &= (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return pa.array(hit)

    return rows.where(maybe(F.col(column)))
