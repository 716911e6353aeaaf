"""Exact n-gram Jaccard join, grouped by prefix.

A document is the set of its distinct word shingles. Shingles have one global order, rare
before frequent; documents with a Jaccard similarity of ``percent``/100 or more share one of
the first ``size - ceil(percent * size / 100) + 1`` shingles of that order (their prefix).
Documents with the same prefix and size form one group. Groups that share a prefix shingle
are filtered as pairs by size and position; the members of the pairs left are filtered by a
bitmap bound and verified on their whole sets.

Links serve to find components, so the documents of a crowded shingle do not all meet. They
are first dealt into blocks, differently for each shingle, and a spanning forest of the
candidates inside each block is verified. What is then in one component never meets again:
two more rounds compare only documents of different components and of sizes that allow the
similarity, first a forest, then all that are still apart. The largest component of a crowd
is cut into blocks that meet the other documents only, so its rows are not copied for each
other. All filters are bounds, so no link between different components is lost, whatever
the order of the shingles.

The order decides how many unrelated documents meet. A leading share of the shingles, chosen
by hash and ``LEADING`` times as large as a prefix, is counted exactly and ordered by
frequency; all others follow by hash and are needed by short documents only. So prefixes
consist of the rarest shingles, and those of one document alone meet nobody.

Defined cases: texts without words (null, empty, blank) have size 0 and link with nothing;
shorter texts than a shingle have their word sequence as the only shingle; copies are one
class; rows that repeat an id are one node; a null id has a null component; empty tables
give no rows; other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.llm.bloom import thin_out
from rivalry.llm.caps import forest
from rivalry.llm.graph import components
from rivalry.llm.memory import release, released
from rivalry.llm.shingles import mix, shingle_sets
from rivalry.llm.tokens import together
from rivalry.session import persist_table

#: Shingles that are counted, as a multiple of a prefix: mostly shingles of one document alone, so a little more than a prefix suffices.
LEADING = 1.25
#: Documents of a shingle up to which its pairs are joined, and those that meet in one task beyond it.
FEW, BLOCK = 32, 1024
#: Bits of the bitmap that bounds the difference of two sets.
BITS = 1024


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def measured(source: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per document: size, digest of its set, bitmap, its shingles of the leading share, and what a prefix needs of the others."""
    share = min(1 << 16, int((100 - percent) * LEADING * (1 << 16) / 100) + 1)
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]

    def row(s: np.ndarray) -> tuple:
        n, mixed = len(s), mix(s)
        digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
        leads = (mixed & np.uint64(0xFFFF)) < share
        wanted = n - (percent * n + 99) // 100 + 1 if n else 0
        odd = np.bincount((mixed >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1
        chosen = s[leads]
        return (n, int(digest[0]), int(digest[1]), np.packbits(odd.astype(np.uint8)).view(np.int64), chosen.view(np.int64),
                s[~leads][: max(0, wanted - len(chosen))].view(np.int64))

    def run(batches):
        for batch in batches:
            for part in together(batch, 1, 1 << 20):
                columns = zip(*[row(s) for _, s in shingle_sets(part.column(1), k)])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                                                 names=["doc_id", "n", "d1", "d2", "bits", "chosen", "rest"])

    return source.mapInArrow(released(run), "doc_id long, n long, d1 long, d2 long, bits array<long>, chosen array<long>, rest array<long>")


def prefixes(heads: DataFrame, percent: int) -> DataFrame:
    """(node, grp, n, bits, found): group and the prefix shingles that other documents may have, with their places.

    The order of all shingles: the leading share by exact frequency, then the others by hash.
    A shingle of one document alone stands before all others and meets nobody, so only how
    many of them there are matters.
    """
    each = heads.select("head", F.explode("chosen").alias("shingle"))
    # stored, so that the join can split a frequent shingle
    common = persist_table(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    held = each.join(common, "shingle").groupBy("head").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("many"))
    parts = heads.select("node", "head", "n", "bits", "rest", F.size("chosen").alias("s")).join(held, "head", "left")
    many = F.coalesce("many", F.array().cast("array<struct<c: bigint, shingle: bigint>>"))
    wanted = F.expr(f"n - CEIL({percent} * n / 100.0) + 1")
    parts = parts.select("node", "n", "bits", "rest", "s", "head", many.alias("many"), (F.col("s") - F.size(many)).alias("alone"), wanted.cast("int").alias("wanted"))
    taken = F.transform(F.slice("many", F.lit(1), F.greatest(F.lit(0), F.col("wanted") - F.col("alone"))),
                        lambda x, i: F.struct(x["shingle"].alias("shingle"), (F.col("alone") + i).alias("pos")))
    later = F.transform("rest", lambda x, i: F.struct(x.alias("shingle"), (F.col("s") + i).alias("pos")))
    parts = parts.select("node", "head", "n", "bits", "alone", F.concat(taken, later).alias("found"))
    group = F.when(F.col("alone") > 0, F.xxhash64(F.lit("one"), "head")).otherwise(F.xxhash64("n", F.transform("found", lambda x: x["shingle"])))
    return persist_table(parts.where(F.size("found") > 0).select("node", group.alias("grp"), "n", "bits", "found"))


def _candidates(percent: int, all_pairs: bool):
    """Pairs of one shingle (or of two blocks of its documents): group pairs are filtered first, then members."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        left, right, inner = key[1].as_py(), key[2].as_py(), key[3].as_py()
        col = {c: np.asarray(table[c]) for c in ("side", "node", "cluster", "grp", "n", "pos")}
        order = np.argsort(col["node"], kind="stable")
        bits = np.asarray(table["bits"].combine_chunks().flatten()).view(np.uint64).reshape(-1, BITS // 64)[order]
        col = {c: v[order] for c, v in col.items()}
        a = np.flatnonzero(col["side"] == left)
        b = a if left == right else np.flatnonzero(col["side"] == right)
        ga, ia, wa = np.unique(col["grp"][a], return_index=True, return_inverse=True)
        gb, ib, wb = np.unique(col["grp"][b], return_index=True, return_inverse=True)
        na, nb, pa_, pb = col["n"][a][ia][:, None], col["n"][b][ib][None, :], col["pos"][a][ia][:, None], col["pos"][b][ib][None, :]
        need = -((-percent * (na + nb)) // (100 + percent))  # smallest common size that reaches the similarity
        groups = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((ga[:, None] == gb[None, :]) == inner)
        if not inner:
            groups &= np.minimum(na - pa_, nb - pb) >= need
        ok = groups[wa][:, wb] & (col["cluster"][a][:, None] != col["cluster"][b][None, :])
        if left == right:
            ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
        i, j = np.nonzero(ok)
        for s in range(0, len(i), 1 << 16):
            x, y = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
            differ = np.bitwise_count(bits[a[x]] ^ bits[b[y]]).sum(axis=1)
            both = col["n"][a[x]] + col["n"][b[y]]
            ok[x, y] = differ <= both - 2 * -((-percent * both) // (100 + percent))
        if all_pairs:
            pairs = np.argwhere(ok)
        else:
            pairs = np.array(forest(ok | ok.T if left == right else ok, left == right), dtype=np.int64).reshape(-1, 2)
        one, two = col["node"][a[pairs[:, 0]]], col["node"][b[pairs[:, 1]]]
        if len(order) >= BLOCK:
            del ok, groups, bits
            release()
        return pa.table({"a": pa.array(np.minimum(one, two)), "b": pa.array(np.maximum(one, two))})

    return run


def _meet(shared: DataFrame, members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of nodes, and the groups of crowded shingles. ``members`` holds node, cluster, grp, n, bits.

    Shingles of at most ``FEW`` documents are joined as groups: pairs of groups are filtered by
    size, by the place of their first common shingle and by the number of common ones in
    their prefixes, then expanded to members and filtered by the bitmap bound. Documents of
    the others meet inside one block each; ``_apart`` finds what that leaves out.
    """
    sized = members.groupBy("grp", "n").agg(F.count(F.lit(1)).alias("m"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
    at = shared.join(sized.drop("n"), "grp").select("shingle", "grp", "n", "pos", "m", "lo", "hi", F.lit(False).alias("inner"))
    own = sized.where("m > 1").select(F.col("grp").alias("shingle"), "grp", "n", F.lit(0).alias("pos"), "m", "lo", "hi", F.lit(True).alias("inner"))
    at = at.unionByName(own)
    crowds = at.groupBy("shingle", "inner").agg(F.sum("m").alias("crowd"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    crowds = persist_table(crowds.where("least <> most").drop("least", "most"))
    at = persist_table(at.join(crowds, ["shingle", "inner"]))

    few = at.where(F.col("crowd") <= FEW).select("shingle", "inner", "grp", "n", "pos", "lo", "hi")
    x, y = few.alias("x"), few.alias("y")
    close = f"100 * LEAST(x.n, y.n) >= {percent} * GREATEST(x.n, y.n) AND LEAST(x.lo, y.lo) <> GREATEST(x.hi, y.hi)"
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.inner") == F.col("y.inner")) & F.expr(
        f"((x.inner AND x.grp = y.grp) OR (NOT x.inner AND x.grp < y.grp)) AND {close}"))
    need = F.expr(f"CEIL({percent} * (x.n + y.n) / {100 + percent}.0)").alias("need")
    first = F.expr(f"x.inner OR LEAST(x.n - x.pos, y.n - y.pos) >= CEIL({percent} * (x.n + y.n) / {100 + percent}.0)")
    # beyond the prefixes the two sets share at most what the longer rest holds
    rest = F.expr(f"CEIL({percent} * GREATEST(x.n, y.n) / 100.0) - 1").alias("rest")
    groups = met.select(F.col("x.grp").alias("ga"), F.col("y.grp").alias("gb"), F.col("x.inner").alias("inner"), need, rest, first.alias("first"))
    groups = groups.groupBy("ga", "gb", "inner", "need", "rest").agg(F.count(F.lit(1)).alias("c"), F.max("first").alias("first")).where("first")
    # common prefix shingles of the crowded kind are not among the joined ones: count them as if all were common
    hot = persist_table(at.where((F.col("crowd") > FEW) & ~F.col("inner")).groupBy("grp").agg(F.count(F.lit(1)).alias("h")))
    for g, h in (("ga", "ha"), ("gb", "hb")):
        groups = groups.join(hot.select(F.col("grp").alias(g), F.col("h").alias(h)), g, "left")
    seen = F.col("c") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    groups = groups.where(F.col("inner") | (seen + F.col("rest") >= F.col("need"))).select("ga", "gb").distinct()
    side = lambda c: members.select(F.col("grp").alias(f"g{c}"), F.col("node").alias(f"n{c}"), F.col("cluster").alias(f"c{c}"),
                                    F.col("n").alias(f"s{c}"), F.col("bits").alias(f"bits_{c}"))
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)
    likely = differ <= F.expr(f"sa + sb - 2 * CEIL({percent} * (sa + sb) / {100 + percent}.0)")
    pairs = groups.join(side("a"), "ga").join(side("b"), "gb").where("ca <> cb AND (ga <> gb OR na < nb)").where(likely).select(
        F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))

    crowded = at.where(F.col("crowd") > FEW).select("shingle", "inner", "grp", "n", "pos", "crowd")
    many = crowded.drop("n").join(members, "grp")
    block = F.pmod(F.xxhash64("shingle", "node"), F.ceil(F.col("crowd") / BLOCK)).cast("int")
    many = many.select("shingle", block.alias("l"), block.alias("r"), "inner", block.alias("side"), "node", "cluster", "grp", "n", "pos", "bits")
    crowd = many.groupBy("shingle", "l", "r", "inner").applyInArrow(_candidates(percent, False), "a long, b long")
    return pairs.unionByName(crowd).where("a <> b").distinct(), crowded


def _apart(crowded: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Documents of crowded shingles dealt so that those of different clusters and near sizes meet.

    Sizes are cut into classes as wide as the similarity allows, so similar documents are in
    the same or in adjacent classes; a zone holds two of them. In a zone the largest cluster
    is cut into blocks, the rest too, and blocks of the rest meet all blocks.
    """
    size = F.col("n") if percent >= 100 else F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9)))  # a hair wider: no rounding can part them
    size = size.cast("int").alias("size")
    held = members.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("m"))
    held = crowded.join(held, "grp").groupBy("shingle", "inner", size, "cluster").agg(F.sum("m").alias("m"))
    mixed = held.groupBy("shingle", "inner").agg(F.min("cluster").alias("least"), F.max("cluster").alias("most")).where("least <> most")
    held = held.join(mixed.select("shingle", "inner"), ["shingle", "inner"], "left_semi")
    held = held.select("*", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("zone"))
    held = held.groupBy("shingle", "inner", "zone", "cluster").agg(F.sum("m").alias("m"), F.max("size").alias("size"))
    zones = held.groupBy("shingle", "inner", "zone").agg(F.count(F.lit(1)).alias("clusters"), F.max("size").alias("size"), F.sum("m").alias("all"),
                                                         F.max("m").alias("largest"), F.max_by("cluster", F.struct("m", "cluster")).alias("top"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    zones = persist_table(zones.where("clusters > 1 AND size = zone").select(
        "shingle", "inner", "zone", "top", blocks(F.col("largest")).alias("tops"), blocks(F.col("all") - F.col("largest")).alias("rests"),
        F.explode(F.array(F.col("zone"), F.col("zone") - 1)).alias("size")))
    rows = crowded.drop("crowd").withColumn("size", size).join(zones, ["shingle", "inner", "size"]).drop("n", "size").join(members, "grp")
    is_top = F.col("cluster") == F.col("top")
    side = F.when(is_top, F.col("rests") + F.pmod(F.xxhash64("node"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rests")))
    others = F.sequence(F.lit(0), F.when(is_top, F.col("rests") - 1).otherwise(F.col("rests") + F.col("tops") - 1))
    rows = rows.select("*", side.cast("int").alias("side"), F.explode(others).alias("other"))
    return rows.select("shingle", "zone", F.least("side", "other").alias("l"), F.greatest("side", "other").alias("r"), "inner",
                       "side", "node", "cluster", "grp", "n", "pos", "bits")


def _meet_apart(crowded: DataFrame, members: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Candidate pairs of crowded shingles between different clusters."""
    met = _apart(crowded, members, percent).groupBy("shingle", "l", "r", "inner", "zone").applyInArrow(_candidates(percent, all_pairs), "a long, b long")
    return met.where("a <> b").distinct()


def _verify(source: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that reach the similarity on their whole sets."""
    pairs = persist_table(pairs)
    ids = persist_table(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
                        .withColumn("id_hash", F.xxhash64("doc_id")))

    def sets(batches):
        for batch in batches:
            for part in together(batch, 1, 1 << 20):
                out = [s.tobytes() for _, s in shingle_sets(part.column(1), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["doc_id", "set"])

    some = thin_out(source.withColumn("id_hash", F.xxhash64("doc_id")), ids, "id_hash").select("doc_id", "text")
    held = persist_table(some.join(ids, "doc_id", "left_semi").mapInArrow(released(sets), "doc_id long, set binary"))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):  # no copies of the sets
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a").join(
        held.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")
    return persist_table(full.mapInArrow(released(check), "a long, b long"))


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    source = _source(docs, doc_id, text)
    rows = persist_table(measured(source, k, percent))
    usable = rows.where("n > 0 AND doc_id IS NOT NULL")
    # grouped tables are stored before they are joined: a join of two plain exchanges can split a hot key
    classes = persist_table(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")))
    # one document of every class stands for its copies
    heads = persist_table(usable.join(classes, ["d1", "d2"]).where("doc_id = node").dropDuplicates(["d1", "d2"])
                          .select("node", F.col("d1").alias("head"), "n", "bits", "chosen", "rest"))
    placed = prefixes(heads, percent)
    shared = placed.select("grp", "n", F.inline("found")).select("shingle", "grp", "n", "pos").distinct()
    members = placed.select("node", F.col("node").alias("cluster"), "grp", "n", "bits")
    pairs, crowded = _meet(shared, members, percent)
    links = _verify(source, pairs, k, percent)
    for all_pairs in (False, True):
        named = placed.join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("cluster"), "grp", "n", "bits")
        links = links.unionByName(_verify(source, _meet_apart(crowded, named, percent, all_pairs), k, percent))
    copies = usable.join(classes, ["d1", "d2"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    final = components(links.unionByName(copies))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(final, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
