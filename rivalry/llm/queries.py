"""Thin queries over the operators; each derives its contract's columns from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.llm import (
    caps, conversations, fingerprints, jaccard, language, mixing, negatives, orc_tokens, packing, quality, repeats, secrets, warc,
)
from rivalry.llm.registry import query, table
from rivalry.session import shared_folder

OP1_SQL = """
WITH r AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, max(page_id) AS m FROM r WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, r.d AS payload_digest,
       CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to
FROM r LEFT JOIN w ON w.d = r.d AND r.n >= 1000"""


@query("op1_warc_archive", OP1_SQL)
def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"), shared_folder(spark))
    return warc.read_archive(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT r, doc_id, len(ws) AS n_words, length(list_aggregate(list_concat(ws, ['']), 'string_agg', '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
             length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters,
             length(t) - length(regexp_replace(t, '[!?]{2,}', '', 'g')) AS n_marks,
             len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1])) AS n_stutter FROM w),
g AS (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) > 8),
h AS (SELECT r, p, array_to_string(ws[p:p + 7], ' ') AS k FROM g),
f AS (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS c FROM h),
o AS (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM f WHERE c > 1),
n AS (SELECT r, sum(least(8, coalesce(q - p, 8))) AS n_repeat_words FROM o GROUP BY r),
a AS (SELECT m.*, coalesce(n.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN n USING (r)),
b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words)::BIGINT
        + 8 * (word_chars > 15 * n_words)::BIGINT + 16 * (10 * n_symbols > 3 * n_words)::BIGINT
        + 32 * (n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines)::BIGINT + 64 * (n_letters >= 40 AND 10 * n_upper > 6 * n_letters)::BIGINT
        + 128 * (10 * n_marks > 5 * n_words)::BIGINT + 256 * (10 * n_stutter > 3 * n_words)::BIGINT AS rule_bits FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words, (rule_bits & 3) <> 0 AS base_failed, rule_bits = 0 AS kept, rule_bits FROM b"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.rule_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality.apply_policy(quality.apply_policy(ledger, "base", "base_ok"), "v1")
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         (~F.col("base_ok")).alias("base_failed"), (F.col("kept") & F.col("base_ok")).alias("kept"), "rule_bits")


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secrets.joined("spans", secrets.KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
                        secrets.joined("spans", secrets.KINDS).alias("spans"), count("random"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = orc_tokens.write_tokens(table(spark, sf_dir, "documents"), shared_folder(spark))
    return orc_tokens.positions(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op9_source_mix")
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_embedding_near_dedup")
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id"""


@query("op10_ngram_jaccard", OP10_SQL)
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), 3, 90)


@query("op8_repeated_bytes")
def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(table(spark, sf_dir, "documents"))
    return language.identify(table(spark, sf_dir, "pages"), model)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT a.r, b.r AS s, substr(a.t, 1, length(a.t) - length(a.t) // 2) || substr(b.t, 1, length(a.t) // 2) AS t
      FROM d a JOIN d b ON b.r = a.r % (SELECT count(*) FROM d) + 1),
x AS (SELECT r, 0 AS k, t FROM d UNION ALL SELECT r, 1, t FROM e),
p AS (SELECT r, k, unnest(string_split(t, chr(10))) AS p FROM x),
g AS (SELECT r, k, p, count(*)::BIGINT AS c FROM p GROUP BY ALL),
h AS (SELECT r, k, c, i, sha256(i::VARCHAR || ':' || p) AS h FROM g, range(4) AS t(i)),
q AS (SELECT r, k, 8 * i + j AS lane, sum(c * ('0x' || substr(h, (8 * j + 1)::INT, 8))::BIGINT) AS v FROM h, range(8) AS t(j) GROUP BY ALL),
w AS (SELECT r, k, c, list_transform(regexp_extract_all(p, '[^\x20\x09-\x0D]+'), lambda z: ('0x' || substr(md5(z), 1, 8))::BIGINT) AS w FROM g),
n AS (SELECT r, k, c, unnest(CASE WHEN len(w) < 5
          THEN [w[1] + 31 * coalesce(w[2], 0) + 961 * coalesce(w[3], 0) + 29791 * coalesce(w[4], 0)]
          ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] + 31 * w[i + 1] + 961 * w[i + 2] + 29791 * w[i + 3] + 923521 * w[i + 4]) END)
        % 4294967296 AS z FROM w WHERE len(w) > 0),
l AS (SELECT r, k, z // 16777216 AS lane, sum(CASE WHEN z // 8388608 % 2 = 1 THEN -c ELSE c END) AS v FROM n GROUP BY ALL),
b AS (SELECT r, k, lane, v FROM q UNION ALL SELECT r, k, 32 + lane, v FROM l),
f AS (SELECT x.r, x.k, string_agg(printf('%08x', ((coalesce(v, 0) % 4294967296 + 4294967296) % 4294967296)::BIGINT), '' ORDER BY i) AS f
      FROM x CROSS JOIN range(288) AS t(i) LEFT JOIN b ON b.r = x.r AND b.k = x.k AND b.lane = i GROUP BY ALL),
o AS (SELECT r, k, sum(v * v) AS o FROM l GROUP BY ALL),
y AS (SELECT e.r, 1 AS k, e.r AS s FROM e UNION ALL SELECT e.r, 0, e.s FROM e),
i AS (SELECT y.r, y.k, sum(a.v * b.v) AS i FROM y JOIN l a ON a.r = y.r AND a.k = 0 JOIN l b ON b.r = y.s AND b.k = y.k AND b.lane = a.lane GROUP BY ALL),
m AS (SELECT y.r, y.k, CASE WHEN a.f = b.f THEN 1.0::DOUBLE WHEN coalesce(oa.o, 0) + coalesce(ob.o, 0) = 0 THEN 0.0::DOUBLE
             ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2.0::DOUBLE * coalesce(i.i, 0)::DOUBLE / (coalesce(oa.o, 0) + coalesce(ob.o, 0))::DOUBLE)) END AS m
      FROM y JOIN f a ON a.r = y.r AND a.k = 0 JOIN f b ON b.r = y.s AND b.k = y.k LEFT JOIN o oa ON oa.r = y.r AND oa.k = 0
      LEFT JOIN o ob ON ob.r = y.s AND ob.k = y.k LEFT JOIN i ON i.r = y.r AND i.k = y.k)
SELECT d.doc_id, length(d.t)::BIGINT AS n_chars, sha256(e.t) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
       u.m AS near_edited, v.m AS near_next
FROM d JOIN e ON e.r = d.r JOIN f a ON a.r = d.r AND a.k = 0 JOIN f b ON b.r = d.r AND b.k = 1
JOIN m u ON u.r = d.r AND u.k = 1 JOIN m v ON v.r = d.r AND v.k = 0"""


@query("op12_document_fingerprints", OP12_SQL)
def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.half_edits(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM r WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(a.v, lambda x, i: x * b.v[i]))::BIGINT AS s
      FROM a, r b WHERE b.vec_id IS DISTINCT FROM a.vec_id OR a.label <> b.label),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INT AS rank, n.b AS negative_id,
       p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND n.s <= p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 5"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return negatives.hard_negatives(rows.where(finite).select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector")), F.col("id") % 100 == 0)
