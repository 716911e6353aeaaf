"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are random product codes: after a seeded rotation a vector is cut into
blocks, each block has its own random codebook, and every combination of one word per block
is a direction. A vector joins all directions whose cosine exceeds a threshold; they are
list-decoded from the block scores without scoring all combinations. Vectors that meet in a
direction (and label) are compared exactly. The threshold follows the number of vectors so
that a direction holds up to ``PER_FILTER`` of them, by the exact share of a spherical cap.

Directions of one code share words, so a close pair misses all of them far more often than
independent directions would. The miss of one code is therefore measured on random pairs at
the wanted cosine; as rotations are random it is the same for every such pair, and that many
independent codes are used that a pair misses all with a probability of at most ``MISS``.
Labels of at most ``EXACT`` vectors are one direction, and so is what no codes can serve.

Copies of one vector are one class with a weight. A pair is counted only in the smallest
direction both are in, so counts are summed without writing pairs; directions with many
members are cut into blocks that meet pairwise.

Defined cases: null labels, null, empty or zero vectors, and vectors with null or non-finite
components link with nothing; vectors of different lengths are not compared; rows that
repeat an id are separate vectors for counts and one node for components; a null id has a
null component; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.llm.graph import components
from rivalry.session import persist_table

PER_FILTER = 48
#: Directions of one code that hold a vector, on average.
PER_CODE = 4
#: Chance that a pair at the wanted cosine shares no direction, and the most codes used for it.
MISS, CODES = 0.02, 12
#: A label of so many vectors is compared whole.
EXACT = 512
#: Random pairs to measure a code with, and the most words in a codebook.
PAIRS, WORDS = 1000, 4096
#: Rows that meet in one task.
BLOCK = 1024
SEED = 20240


def cap_limit(dim: int, share: float) -> float:
    """Cosine that a random unit vector has with a direction with the chance ``share``."""
    angle = np.linspace(0, np.pi, 100_001)
    log = (dim - 2) * np.log(np.maximum(np.sin(angle), 1e-300))
    mass = np.cumsum(np.exp(log - log.max()))
    return float(np.cos(angle[np.searchsorted(mass, share * mass[-1])]))


def close_pairs(rng: np.random.Generator, count: int, dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors, and for each another one at the given cosine."""
    u, w = rng.standard_normal((2, count, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    return u, cosine * u + max(0.0, 1 - cosine**2) ** 0.5 * w


@lru_cache(maxsize=64)
def parameters(n: int, dim: int, cosine: float) -> tuple[float, int, int, int]:
    """(least cosine with a direction, blocks, words per block, codes) for ``n`` vectors to compare; no codes: one direction for all."""
    share = PER_FILTER / max(n, 1)
    while n > EXACT and dim > 1 and share < 0.25:
        limit, directions = cap_limit(dim, share), PER_CODE / share
        blocks = 1 if dim < 8 else 2 if dim < 24 or directions <= WORDS**2 else 3
        words = max(2, int(np.ceil(directions ** (1 / blocks))))
        if words <= WORDS:
            u, v = close_pairs(np.random.default_rng([SEED, dim]), PAIRS, dim, min(1.0, max(-1.0, cosine)))
            pairs = zip(decode(u, limit, blocks, words, 1), decode(v, limit, blocks, words, 1))
            miss = float(np.mean([not len(np.intersect1d(a, b)) for a, b in pairs]))
            miss = min(1.0, miss + 2 * (max(miss, 1 / PAIRS) / PAIRS) ** 0.5)  # not below the true one by chance
            if miss**CODES <= MISS:
                return limit, blocks, words, max(1, int(np.ceil(np.log(MISS) / np.log(miss))))
        share *= 2  # wider caps
    return -1.0, 1, 1, 0


@lru_cache(maxsize=16)
def code(dim: int, blocks: int, words: int, number: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Rotation, and per block its range and codebook. Small: words x dim numbers."""
    rng = np.random.default_rng([SEED, dim, blocks, words, number])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    edges = np.linspace(0, dim, blocks + 1).astype(int)
    books = []
    for a, b in zip(edges[:-1], edges[1:]):
        book = rng.standard_normal((words, b - a))
        books.append((a, b, book / np.linalg.norm(book, axis=1, keepdims=True) * ((b - a) / dim) ** 0.5))
    return rotation, books


def decode(units: np.ndarray, limit: float, blocks: int, words: int, codes: int) -> list[np.ndarray]:
    """Per unit vector the sorted ids of all directions with a cosine of at least ``limit`` (of a code without one the best)."""
    if not codes:
        return [np.zeros(1, dtype=np.int64)] * len(units)
    found: list = []
    for at in range(0, len(units), BLOCK):  # bounds the scores held
        part = [_decode(units[at : at + BLOCK], limit, blocks, words, k) for k in range(codes)]
        found += [np.concatenate(ids) for ids in zip(*part)]
    return found


def _decode(units: np.ndarray, limit: float, blocks: int, words: int, number: int) -> list[np.ndarray]:
    rotation, books = code(units.shape[1], blocks, words, number)
    turned = units @ rotation
    scores = [turned[:, a:b] @ book.T for a, b, book in books]
    rest = np.zeros((len(books) + 1, len(units)))  # the most that the blocks from i on can add
    for i in range(len(books) - 1, -1, -1):
        rest[i] = rest[i + 1] + scores[i].max(axis=1)
    found = []
    for r in range(len(units)):
        ids, sums = np.zeros(1, dtype=np.int64), np.zeros(1)
        for i, s in enumerate(scores):
            first = np.flatnonzero(sums + rest[i, r] >= limit)  # others cannot reach it with any word
            total = sums[first, None] + s[r][None, :]
            x, y = np.nonzero(total + rest[i + 1, r] >= limit)
            ids, sums = ids[first[x]] * words + y, total[x, y]
        if not len(ids):
            best = 0
            for s in scores:
                best = best * words + int(s[r].argmax())
            ids = np.array([best], dtype=np.int64)
        found.append(np.sort(ids) + number * words**blocks)
    return found


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name))


def assign_filters(classes: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """(label, dim, node, weight, vector, filters): one row per class of equal vectors; ``sizes`` has ``n`` = rows to compare with.

    Sizes count as the next power of two. All workers must use the same codes, so they are chosen here.
    """
    sizes = sizes.withColumn("n", F.expr("shiftleft(1L, length(bin(n - 1)))"))
    kinds = sizes.select("dim", "n").distinct().collect()  # at most 64 rows per dimension
    chosen = {(r["dim"], r["n"]): parameters(r["n"], r["dim"], cosine) for r in kinds}
    rows = classes.join(sizes, ["label", "dim"]).select("label", "dim", "node", "class_id", "weight", "vector", "n")

    def run(batches):
        for batch in batches:
            dims, sizes = np.asarray(_rows(batch, "dim")), np.asarray(_rows(batch, "n"))
            vectors = _rows(batch, "vector").to_pylist()
            filters: list = [None] * len(vectors)
            for dim, n in set(zip(dims.tolist(), sizes.tolist())):
                at = np.flatnonzero((dims == dim) & (sizes == n))
                x = np.array([vectors[i] for i in at], dtype=np.float64)
                units = x / np.abs(x).max(axis=1, keepdims=True)
                units /= np.linalg.norm(units, axis=1, keepdims=True)
                for i, f in zip(at, decode(units, *chosen[dim, n])):
                    filters[i] = f
            out = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "n"]
            names = [c for c in batch.schema.names if c != "n"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(filters, pa.list_(pa.int64()))], names=[*names, "filters"])

    return rows.mapInArrow(run, "label long, dim int, node long, class_id long, weight long, vector array<double>, filters array<long>")


def _compare(cosine: float):
    """One direction (or one pair of its blocks): counts per class, and a spanning forest of the links."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        filter_id, left, right = key[1].as_py(), key[2].as_py(), key[3].as_py()
        side, node, cls = np.asarray(table["side"]), np.asarray(table["node"]), np.asarray(table["class_id"])
        weight = np.asarray(table["weight"])
        x = np.array(table["vector"].to_pylist(), dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        member = table["filters"].to_pylist()
        a = np.flatnonzero(side == left)
        b = a if left == right else np.flatnonzero(side == right)
        linked = x[a] @ x[b].T >= cosine
        if left == right:
            np.fill_diagonal(linked, False)
        earlier = sorted({f for m in member for f in m if f < filter_id})
        if earlier and linked.any():
            place = {f: i for i, f in enumerate(earlier)}
            has = np.zeros((len(x), len(earlier)), dtype=np.float32)
            for i, m in enumerate(member):
                has[i, [place[f] for f in m if f < filter_id]] = 1
            linked &= has[a] @ has[b].T < 0.5  # counted in an earlier direction
        kind, one, two = [], [], []
        for own, count in ((a, linked @ weight[b]), *(((b, weight[a] @ linked),) if left != right else ())):
            for i in np.flatnonzero(count):
                kind.append(0), one.append(int(cls[own[i]])), two.append(int(count[i]))
        for i, j in forest(linked, left == right):
            kind.append(1), one.append(int(node[a[i]])), two.append(int(node[b[j]]))
        return pa.table({"kind": pa.array(kind, pa.int32()), "one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64())})

    return run


def forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges that connect what a boolean matrix connects, by breadth-first search."""
    n, m = linked.shape
    edges: list[tuple[int, int]] = []
    row_new, col_new = np.ones(n, bool), np.ones(m, bool)
    for s in np.flatnonzero(linked.any(axis=1)):
        if not row_new[s]:
            continue
        row_new[s] = False
        if same:
            col_new[s] = False
        rows = [s]
        while rows:
            r = rows.pop()
            hit = np.flatnonzero(linked[r] & col_new)
            col_new[hit] = False
            edges += [(int(r), int(c)) for c in hit]
            if same:
                row_new[hit] = False
                rows += hit.tolist()
                continue
            for c in hit:
                more = np.flatnonzero(linked[:, c] & row_new)
                row_new[more] = False
                edges += [(int(q), int(c)) for q in more]
                rows += more.tolist()
    return edges


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                          F.col(embedding).cast("array<double>").alias("vector"))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0)
                      & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
                      & F.exists("vector", lambda v: v != 0), F.lit(False))
    valid = rows.where(good)
    classes = valid.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    classes = persist_table(classes.select("label", F.size("vector").alias("dim"), "node",
                                           F.xxhash64("label", "vector", F.lit(1)).alias("class_id"), "weight", "vector"))
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    spread = persist_table(assign_filters(classes, sizes, cosine))
    cell = ["label", "dim", "filter"]
    narrow = spread.select("label", "dim", F.explode("filters").alias("filter"))
    crowds = narrow.groupBy(*cell).agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    met = spread.select("*", F.explode("filters").alias("filter")).join(crowds, cell)
    blocks = F.ceil(F.col("crowd") / BLOCK).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("side", F.pmod(F.col("class_id"), F.col("blocks")).cast("int"))
    pair = F.struct(F.least("side", "other").alias("l"), F.greatest("side", "other").alias("r"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("pair", pair)
    met = met.withColumn("space", F.xxhash64("label", "dim")).select(
        "space", "filter", F.col("pair.l").alias("l"), F.col("pair.r").alias("r"), "side", F.coalesce("node", F.lit(-(2**63))).alias("node"),
        "class_id", "weight", "vector", "filters")
    out = persist_table(met.groupBy("space", "filter", "l", "r").applyInArrow(_compare(cosine), "kind int, one long, two long"))
    counts = out.where("kind = 0").groupBy(F.col("one").alias("class_id")).agg(F.sum("two").alias("others"))
    # an id that repeats with different vectors is one node
    same = valid.join(classes.select("label", "vector", "node", "class_id", "weight"), ["label", "vector"])
    links = out.where("kind = 1").select(F.col("one").alias("a"), F.col("two").alias("b")).unionByName(
        same.where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b")))
    found = components(links)
    own = same.select("vec_id", "class_id", "weight").join(counts, "class_id", "left").select(
        "vec_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"))
    every = own.unionByName(rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links")))
    joined = every.join(found, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", "n_links", component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
