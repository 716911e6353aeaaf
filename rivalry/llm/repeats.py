"""Exact removal of repeated byte strings, by column-wise construction.

Every ``length``-byte window of a text belongs to its anchor: the leftmost ``anchor``-byte
string in it with the smallest hash. Equal windows have equal anchors at equal places, so
windows are dealt out by anchor. Consecutive windows with the same anchor form a segment.

1. Segments whose anchor occurs once hold no repeat. Segments that are equal as a whole are
   repeated as a whole; one of them stands for all.
2. Different segments of one anchor are compared column by column: they are laid out so that
   their anchors are aligned, and each round takes one symbol of every segment, from the last
   column to the first. The order of the segments from this column on follows from the order
   of the last round by one stable distribution on the new symbol (the round's column of the
   collection's Burrows-Wheeler transform), and the common prefix of neighbours is one more than
   the least between them. A window whose common prefix with a neighbour reaches ``length``
   is repeated. There are ``2 * length - anchor`` rounds whatever the length of the documents.
   The rounds' files are Spark's: segments of one anchor arrive sorted in a shuffled partition.
3. The spans go back to the documents.

An anchor with more than ``crowd`` different segments is decided by grouping its windows on a
128-bit fingerprint instead, so that no anchor is gathered in one task.

Defined cases: null texts are empty; texts shorter than ``length`` keep all bytes; rows that
repeat an id and a text are separate occurrences of each other; a null id is like any other;
empty tables give no rows; other columns are ignored. Whole segments are compared by 64-bit
anchor and 64-bit content hashes together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.llm.bloom import thin_out
from rivalry.llm.shingles import mix, powers, prefix_hash, slices
from rivalry.session import persist_table

LENGTH, ANCHOR, CROWD = 200, 64, 20_000
#: Segments that one round of a task holds.
TOGETHER = 16_384
END = 255  # never part of UTF-8
NO_ID = -(2**63)
U = np.uint64
SEGMENT = "doc_id long, text_key long, anchor long, content long, start int, windows int, place int"


def _leftmost_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest value in every window of ``w`` values. The upper 33 bits
    decide and the position breaks ties, so the choice depends on the window's content alone."""
    n = len(h) - w + 1
    keyed = (h >> U(31) << U(31)) | np.arange(len(h), dtype=np.uint64)
    full = np.concatenate([keyed, np.full(-len(h) % w, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    from_left = np.minimum.accumulate(full, axis=1).reshape(-1)  # smallest from the block's start to here
    to_right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)  # smallest from here to the block's end
    return (np.minimum(to_right[:n], from_left[w - 1:w - 1 + n]) & U((1 << 31) - 1)).astype(np.int64)


def cut_segments(source: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row per segment: anchor and content hashes, first window, number of windows, and the
    anchor's distance from the segment's start."""
    width = length - anchor + 1

    def segments(data: np.ndarray, p: np.ndarray, base: int):
        """Of one text at ``base`` of the slice whose prefix hashes are ``p``."""
        n = len(data)
        _, down = powers(len(p))
        here = p[base:base + n + 1]
        hashes = mix((here[anchor:] - here[:-anchor]) * down[base:base + n - anchor + 1])
        where = _leftmost_minimum(hashes, width)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        count = np.diff(np.append(first, len(where)))
        ends = first + count - 1 + length
        content = mix(mix((here[ends] - here[first]) * down[base + first]) + (ends - first).astype(np.uint64))
        return hashes[where[first]], content, first, count, where[first] - first

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), np.asarray(batch.column(1))
            for at, offsets, data in slices(batch.column(2)):
                p = prefix_hash(data)
                rows, parts = [], []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    if b - a >= length:
                        parts.append(segments(data[a:b], p, a))
                        rows.append(np.full(len(parts[-1][0]), at + i))
                if not rows:
                    continue
                row = np.concatenate(rows)
                a, c, first, count, place = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(keys[row]), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)),
                     *[pa.array(x.astype(np.int32)) for x in (first, count, place)]],
                    names=["doc_id", "text_key", "anchor", "content", "start", "windows", "place"])

    return source.select("doc_id", "text_key", "text").mapInArrow(run, SEGMENT)


def column_rounds(texts: list[bytes], places: np.ndarray, windows: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """For segments of any anchors: a boolean matrix (segment, window) of windows that another segment has too."""
    m, left = len(texts), length - anchor
    columns = left + length
    table = np.full((m, columns), END, dtype=np.uint8)
    for i, (t, place) in enumerate(zip(texts, places.tolist())):
        table[i, left - place:left - place + len(t)] = np.frombuffer(t, dtype=np.uint8)
    table = np.ascontiguousarray(table.T)
    order, common = np.arange(m), np.zeros(m, dtype=np.int16)  # common[i]: with the one before it in the order
    repeated = np.zeros((m, left + 1), dtype=bool)
    for x in range(columns - 1, -1, -1):
        symbol = table[x][order]
        turn = np.argsort(symbol, kind="stable")
        order, symbol = order[turn], symbol[turn]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != END)) + 1
        fresh = np.zeros(m, dtype=np.int16)
        if len(same):
            bounds = np.stack([turn[same - 1] + 1, turn[same] + 1], axis=1).reshape(-1)
            least = np.minimum.reduceat(np.append(common, np.int16(0)), bounds)[::2]
            fresh[same] = least + 1
        common = fresh
        if x <= left:
            twin = np.flatnonzero(common >= length)
            repeated[order[twin], x] = True
            repeated[order[twin - 1], x] = True
    # column x is window x - (left - place) of a segment
    out = np.zeros((m, left + 1), dtype=bool)
    for i, (place, n) in enumerate(zip(places.tolist(), windows.tolist())):
        out[i, :n] = repeated[i, left - place:left - place + n]
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


SPANS = "anchor long, content long, first int, last int"


def _compare(length: int, anchor: int):
    """Segments sorted by anchor -> runs of repeated windows; anchors are never split between rounds."""

    def solve(table: pa.Table):
        texts = table["bytes"].to_pylist()
        flags = column_rounds(texts, np.asarray(table["place"]), np.asarray(table["windows"]), length, anchor)
        rows = [(i, a, b - 1) for i in np.flatnonzero(flags.any(axis=1)) for a, b in _runs(flags[i])]
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([table["anchor"].take(at).combine_chunks(), table["content"].take(at).combine_chunks(),
                                           pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
                                          names=["anchor", "content", "first", "last"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= TOGETHER:
                anchors = np.asarray(held["anchor"])
                cut = int(np.searchsorted(anchors, anchors[-1], side="left"))  # the last anchor may go on
                if cut:
                    yield solve(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def _extract(length: int):
    """Document and its wanted segments -> their bytes, or for crowded anchors a fingerprint of every window."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                for s in wanted:
                    part = data[s["start"]:s["start"] + s["windows"] - 1 + length]
                    for i in range(s["windows"]) if s["crowded"] else (-1,):
                        mark = None if i < 0 else hashlib.blake2b(part[i:i + length], digest_size=16).digest()
                        for c, v in zip(out, (s["anchor"], s["content"], s["windows"], s["place"], i, None if mark else part, mark)):
                            c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                             names=["anchor", "content", "windows", "place", "no", "bytes", "mark"])

    return run


def _remove(batches):
    """Text and spans -> what is removed and the digest of the rest."""
    for batch in batches:
        removed, spans, digests = [], [], []
        for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            data, kept, done, runs, gone = (text or "").encode(), [], 0, 0, 0
            for s in sorted(found, key=lambda s: (s["a"], s["b"])):
                if s["a"] > done or not runs:
                    kept.append(data[done:s["a"]])
                    runs += 1
                    gone += s["b"] - s["a"]
                    done = s["b"]
                elif s["b"] > done:
                    gone += s["b"] - done
                    done = s["b"]
            kept.append(data[done:])
            removed.append(gone), spans.append(runs), digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                                          pa.array(digests, pa.string())], names=["doc_id", "text_key", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, crowd: int = CROWD,
                   doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with their keys, (doc_id, text_key, found array<struct<a,b>>) byte spans of documents that have some; they may overlap)."""
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("text_key", F.xxhash64("text")).withColumn("row_key", F.xxhash64("doc_id", "text_key"))
    cut = persist_table(cut_segments(source, length, anchor))
    # grouped tables are stored before they are joined: a join of two plain exchanges can split a hot key
    again = persist_table(cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    met = persist_table(cut.join(again, "anchor"))
    kinds = met.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_key", "start", "windows", "place")).alias("one"))
    kinds = persist_table(kinds.select("anchor", "content", "copies", "one.*"))
    mixed = persist_table(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    unlike = kinds.join(mixed, "anchor").withColumn("crowded", F.col("kinds") > crowd)
    wanted = unlike.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "content", "start", "windows", "place", "crowded")).alias("wanted"))
    wanted = persist_table(wanted.withColumn("row_key", F.xxhash64("doc_id", "text_key")))
    some = thin_out(source, wanted, "row_key").join(wanted.drop("row_key"), ["doc_id", "text_key"])
    parts = persist_table(some.select("text", "wanted").mapInArrow(
        _extract(length), "anchor long, content long, windows int, place int, no int, bytes binary, mark binary"))
    rounds = parts.where("no < 0").repartition("anchor").sortWithinPartitions("anchor", "content").select(
        "anchor", "content", "windows", "place", "bytes").mapInArrow(_compare(length, anchor), SPANS)
    marks = parts.where("no >= 0").select("anchor", "content", "no", "mark")
    twice = marks.groupBy("anchor", "mark").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo <> hi")
    crowds = marks.join(twice.select("anchor", "mark"), ["anchor", "mark"]).select("anchor", "content", F.col("no").alias("first"), F.col("no").alias("last"))
    whole = kinds.where("copies > 1").select("anchor", "content", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
    runs = rounds.unionByName(crowds).unionByName(whole).distinct()
    spans = met.join(runs, ["anchor", "content"]).select(
        "doc_id", "text_key", F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + length).alias("b")).alias("span"))
    return source, persist_table(spans.groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("found")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, crowd: int = CROWD,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    source, found = repeated_spans(docs, length, anchor, crowd, doc_id, text)
    hit = thin_out(source, found.withColumn("row_key", F.xxhash64("doc_id", "text_key")), "row_key").join(found, ["doc_id", "text_key"])
    done = hit.select("doc_id", "text_key", "text", "found").mapInArrow(
        _remove, "doc_id long, text_key long, n_removed long, n_spans long, kept_sha256 string").distinct()
    plain = source.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    every = plain.join(done, ["doc_id", "text_key"], "left")
    return every.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
