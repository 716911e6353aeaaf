"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph is what stands between two line feeds. It is hashed into a wide vector of two
parts: ``EQUAL`` lanes of 32 bits from SHA-256, and ``LIKE`` lanes that hold a signed count
of its word shingles (each adds one or minus one to the lane its hash names). A document's
vector is the sum of its paragraphs' vectors modulo 2**32, lane by lane. So the order of
paragraphs does not matter, equal texts have equal vectors, and a paragraph is inserted or
deleted by adding or subtracting its vector, without the rest of the text.

The second part makes vectors comparable: the inner product of two sums of signed counts
estimates how many shingles the documents share (error about ``LIKE ** -0.5``).

Defined cases: a null text is empty; an empty text is one empty paragraph; a paragraph with
fewer words than a shingle has its whole sequence as one, without words none; null ids come
first in the order of documents, rows that share an id are ordered by a hash of the text and
keep a row each; the only document is its own next one; empty tables give no rows; other
columns are ignored. Long texts are hashed whole, some thousand paragraphs at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.llm.ranges import cut_points, with_next
from rivalry.llm.tokens import texts

#: Lanes for equality and for likeness, words of a shingle, and the base that joins word codes.
EQUAL, LIKE, WORDS, BASE = 32, 256, 5, 31
#: Paragraphs hashed at a time; documents and characters worked on at a time.
STEP, DOCS, CHARS = 1 << 15, 256, 1 << 20
MASK = (1 << 32) - 1


def _digest(paragraph: bytes) -> bytes:
    return b"".join(hashlib.sha256(b"%d:" % i + paragraph).digest() for i in range(EQUAL // 8))


def _codes(words: pa.Array) -> np.ndarray:
    """32 bits of each word's digest; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    heads = b"".join(hashlib.md5(w).digest()[:4] for w in coded.dictionary.cast(pa.large_binary()).to_pylist())
    return np.frombuffer(heads, ">u4").astype(np.int64)[np.asarray(coded.indices)]


def _shingles(paragraphs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph, code) of every word shingle."""
    split = pc.ascii_split_whitespace(paragraphs)
    words, owner = split.flatten(), np.repeat(np.arange(len(split)), np.diff(np.asarray(split.offsets)))
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    owner, code = owner[full], _codes(words.filter(pa.array(full)))
    count = np.bincount(owner, minlength=len(split))
    first = np.cumsum(count) - count
    has = np.flatnonzero(count)
    starts = np.maximum(count[has] - WORDS + 1, 1)  # shingles of each paragraph with words
    owners = np.repeat(has, starts)
    at = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + first[owners]
    end = first[owners] + count[owners]
    total = np.zeros(len(at), dtype=np.int64)
    for j in range(WORDS):
        inside = at + j < end
        total[inside] += code[(at + j)[inside]] * BASE**j
    return owners, total & MASK


def vectors(column: Iterable[str]) -> np.ndarray:
    """One vector of ``EQUAL + LIKE`` lanes per text, modulo 2**32."""
    split = pc.split_pattern(pa.array(list(column), pa.large_string()), "\n")
    offsets = np.asarray(split.offsets).astype(np.int64)
    paragraphs, n = split.flatten(), len(split)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    equal, like = np.zeros((n, EQUAL), dtype=np.uint32), np.zeros(n * LIKE, dtype=np.int64)
    for at in range(0, len(paragraphs), STEP):
        part, own = paragraphs.slice(at, STEP), owner[at:at + STEP]
        coded = part.dictionary_encode()
        wide = np.frombuffer(b"".join(map(_digest, coded.dictionary.cast(pa.large_binary()).to_pylist())), ">u4").astype(np.uint32).reshape(-1, EQUAL)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        equal[own[first]] += np.add.reduceat(wide[np.asarray(coded.indices)], first, axis=0, dtype=np.uint32)
        paragraph, code = _shingles(part)
        lane = own[paragraph] * LIKE + code // (2**32 // LIKE)
        minus = code // (2**31 // LIKE) % 2 == 1
        like += np.bincount(lane[~minus], minlength=n * LIKE) - np.bincount(lane[minus], minlength=n * LIKE)
    return np.concatenate([equal, (like & MASK).astype(np.uint32).reshape(n, LIKE)], axis=1)


def insert(vector: np.ndarray, paragraphs: np.ndarray) -> np.ndarray:
    """The vector after inserting paragraphs given by their own vector."""
    return vector + paragraphs


def delete(vector: np.ndarray, paragraphs: np.ndarray) -> np.ndarray:
    return vector - paragraphs


def spell(vector: np.ndarray) -> str:
    """Lower-case hex, eight digits a lane."""
    return vector.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1 from two vectors alone: twice the shared shingles by those of both, 1 for equal vectors."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EQUAL:].astype(np.uint32).view(np.int32).astype(np.int64) for v in (a, b))
    both = int(x @ x) + int(y @ y)
    return min(1.0, max(0.0, 2.0 * int(x @ y) / both)) if both else 0.0


def _edited(text: str, following: str) -> tuple[str, str, str]:
    """The edited text, and the paragraphs that the edit deletes and inserts."""
    half = len(text) // 2
    kept, new = text[:len(text) - half], following[:half]
    start = kept.rfind("\n") + 1
    return kept + new, text[start:], kept[start:] + new


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches):
    """Documents in order: each is compared with its half-edited text and with the next document."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    waiting: list[tuple] = []  # (range, ahead, id, text); the first one's vector may be known
    known = None

    def flush():
        nonlocal waiting, known
        own = vectors(r[3] for r in (waiting[1:] if known is not None else waiting))
        own = own if known is None else np.concatenate([known, own])
        at = [i for i in range(len(waiting) - 1) if not waiting[i][1] and waiting[i][0] == waiting[i + 1][0]]
        edits = [_edited(waiting[i][3], waiting[i + 1][3]) for i in at]
        changed = insert(delete(own[at], vectors(e[1] for e in edits)), vectors(e[2] for e in edits)) if at else own[:0]
        out = [(waiting[i][2], len(waiting[i][3]), hashlib.sha256(e[0].encode()).hexdigest(), spell(own[i]), spell(c),
                likeness(own[i], c), likeness(own[i], own[i + 1])) for i, e, c in zip(at, edits, changed)]
        waiting, known = waiting[-1:], own[-1:]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=names)

    chars = 0
    for batch in batches:
        for at, part in texts(batch.column(1)):
            for i, text in enumerate(part):
                waiting.append((batch.column(2)[at + i].as_py(), batch.column(3)[at + i].as_py(), batch.column(0)[at + i].as_py(), text))
                chars += len(text)
                if len(waiting) > DOCS or chars > CHARS and len(waiting) > 1:
                    yield flush()
                    chars = 0
    if len(waiting) > 1:
        yield flush()


def half_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = 16 << 20) -> DataFrame:
    """Per document its fingerprint and that of its text with the last half replaced from the next document.

    The edited fingerprint is not hashed anew: the paragraphs of the last half are deleted
    from the document's vector and the new ones inserted. Whole texts cross the network once,
    into ranges of ids; a range also gets the first document of the next one.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("tie"), F.octet_length("text").cast("long").alias("size"))
    cuts = cut_points(keyed, "doc_id", "tie", "size", range_bytes)
    if not cuts:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    dealt = with_next(rows.select("doc_id", "text", F.xxhash64("text").alias("tie")), "doc_id", "tie", cuts)
    return dealt.select("doc_id", "text", "range_no", "ahead").mapInArrow(_rows, SCHEMA)
