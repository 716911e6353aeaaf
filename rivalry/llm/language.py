"""Language identification by Bayesian evidence fusion.

The posterior of a page multiplies four pieces of evidence: the likelihood of its text under
hashed byte trigrams, of its declared markup language, of its address suffix, and the prior of
its host. Host priors are smoothed along host, domain and the whole table; their counts, and
how reliable declarations and suffixes are, come from grouped sums of the text-only
posteriors over all pages. A page's own share is taken out of the sums before they are used.

The trigram model is fitted on a sample of labelled rows: about ``FITTED`` per language, chosen
by a hash of the id. Everything else covers all rows.

Defined cases: a null or empty text gives no text evidence; a null or unreadable address, host
or declaration gives none of that kind (the host's prior is then the whole table's); ties go to
the first language in code-point order; null or repeated ids are rows like any other; an empty
table gives no rows; pages of any length are walked once; with no labelled rows fitting is an error; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry.llm.shingles import LOWER, slices
from rivalry.session import persist_table

FITTED = 2000
BUCKETS = 1 << 15
#: Weight of a trigram: neighbouring trigrams overlap, so each counts for a part of one.
WEIGHT = 0.2
#: Pseudo-counts of a parent in its child's prior, and of a table of reliabilities.
KAPPA, FLOOR = 8.0, 0.5
#: Elements whose content is not seen, and where they end.
HIDDEN = re.compile(r"<(?:(script)|style)\b", re.IGNORECASE)
HIDDEN_END = {True: re.compile(r"</script\s*>", re.IGNORECASE), False: re.compile(r"</style\s*>", re.IGNORECASE)}
HTML, LANG = re.compile(r"<html\b[^>]*", re.IGNORECASE), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)


def visible(html: str) -> str:
    """Text between tags, without scripts, styles and comments.

    One walk over the page: what has no end is looked for once only, so a page of unclosed tags
    costs no more than any other. A comment or script without an end is a tag like others.
    """
    out, done, endless = [], 0, set()
    at = html.find("<")
    while at >= 0:
        end = -1
        if html.startswith("<!--", at) and "--" not in endless:
            end = html.find("-->", at + 4)
            end = end + 3 if end >= 0 else endless.add("--") or -1
        elif m := HIDDEN.match(html, at):
            kind = m[1] is not None
            if kind not in endless:
                close = HIDDEN_END[kind].search(html, m.end())
                end = close.end() if close else endless.add(kind) or -1
        if end < 0:
            end = html.find(">", at + 1) + 1
            if not end:
                break
        out += [html[done:at], " "]
        done, at = end, html.find("<", end)
    return "".join([*out, html[done:]])


def declared(html: str) -> str | None:
    """The language of the first html tag that names one."""
    for tag in HTML.finditer(html):
        if found := LANG.search(tag[0]):
            return found[1].lower()
    return None


def _buckets(data: np.ndarray) -> np.ndarray:
    """Hashed trigrams of one text's bytes, A-Z lower-cased."""
    if len(data) < 3:
        return np.empty(0, dtype=np.int64)
    x = LOWER[data].astype(np.int64)
    return ((x[:-2] * 65537 + x[1:-1] * 257 + x[2:]) * 0x9E3779B1 >> 8) % BUCKETS


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = FITTED) -> tuple[list[str], np.ndarray]:
    """(languages in code-point order, log-probabilities languages x BUCKETS)."""
    rows = labelled.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        raise ValueError("no labelled rows to fit on")
    langs = sorted(counts)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, bound / counts[k])))])
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches):
        table = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        for batch in batches:
            names = batch.column(1).to_pylist()
            for at, offsets, data in slices(batch.column(0)):
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    table[langs.index(names[at + i])] += np.bincount(_buckets(data[a:b]), minlength=BUCKETS)
        lang_no, bucket = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(lang_no.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(table[lang_no, bucket])],
                                         names=["lang_no", "bucket", "n"])

    sums = sample.select("text", "lang").mapInArrow(count, "lang_no int, bucket int, n long").groupBy("lang_no", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(langs), BUCKETS), 0.1)
    table[np.asarray(sums["lang_no"]), np.asarray(sums["bucket"])] += np.asarray(sums["n"])
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], key: str, url: str | None, text: str, markup: bool) -> DataFrame:
    """One narrow row per page: likelihood and posterior of the text alone, declaration, suffix, domain, host."""
    held = pages.sparkSession.sparkContext.broadcast(model)
    langs = model[0]

    def run(batches):
        _, log_p = held.value
        flat = log_p.T.copy()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                likely, said = [], []
                for t in part.column(2).to_pylist():
                    said.append(declared(t) if markup and t else None)
                    words = np.frombuffer((visible(t) if markup else t).encode(), dtype=np.uint8) if t else np.empty(0, np.uint8)
                    likely.append(WEIGHT * flat[_buckets(words)].sum(axis=0))
                x = np.array(likely).reshape(-1, len(langs))
                post = np.exp(x - x.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(said, pa.string()), pa.array(list(x), pa.list_(pa.float64())),
                                                  pa.array(list(post), pa.list_(pa.float64()))], names=["key", "url", "declared", "likely", "post"])

    source = pages.select(F.col(key).cast("long").alias("key"), (F.col(url) if url else F.lit(None)).cast("string").alias("url"), F.col(text).cast("string").alias("text"))
    rows = source.mapInArrow(run, "key long, url string, declared string, likely array<double>, post array<double>")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    labels = F.split(host, r"\.")
    known = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNotNull(), "?")
    return rows.select("key", known.alias("declared"), "likely", "post", host.alias("host"),
                       F.when(F.size(labels) > 1, F.element_at(labels, -1)).alias("suffix"),
                       F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(host).alias("domain"))


def _sums(rows: DataFrame, by: str, n: int, name: str) -> DataFrame:
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(n)]).alias(name))


def _plus(x: Column, y: Column, weight: float) -> Column:
    return F.zip_with(x, y, lambda a, b: a + weight * b)


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], key: str = "page_id", url: str | None = "url", text: str = "html",
             markup: bool = True) -> DataFrame:
    """Per row: key, language, probability, text_language (by the text alone), declared, host."""
    langs = model[0]
    n = len(langs)
    rows = persist_table(text_evidence(pages, model, key, url, text, markup))
    total = rows.agg(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)]).first()
    everything = np.array([total[i] for i in range(n)])
    base = F.array(*[F.lit(float(x)) for x in (everything + FLOOR) / (everything + FLOOR).sum()])
    out = rows
    for by, name in (("declared", "by_declared"), ("suffix", "by_suffix"), ("domain", "by_domain"), ("host", "by_host")):
        out = out.join(_sums(rows, by, n, name), by, "left")
    zero = F.array(*[F.lit(0.0)] * n)
    own = lambda name: F.when(F.col(name).isNull(), zero).otherwise(F.zip_with(name, "post", lambda a, b: F.greatest(a - b, F.lit(0.0))))
    # a child's prior: its counts plus KAPPA pseudo-counts dealt by its parent's prior
    smooth = lambda counts, parent: F.transform(_plus(counts, parent, KAPPA), lambda x: x / (F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) + KAPPA))
    out = out.withColumn("p_domain", smooth(own("by_domain"), base)).withColumn("p_host", smooth(own("by_host"), F.col("p_domain")))
    # how often pages of a language carry this declaration or suffix
    sizes = F.array(*[F.lit(float(x) + 2 * FLOOR) for x in everything])
    chance = lambda name: F.when(F.col(name).isNull(), zero).otherwise(F.zip_with(own(name), sizes, lambda a, b: F.log((a + FLOOR) / b)))
    added = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = added(added(F.col("likely"), F.transform("p_host", lambda x: F.log(x))), added(chance("by_declared"), chance("by_suffix")))
    out = out.withColumn("score", score)
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    part = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("score")))
    return out.select(F.col("key").alias(key), best("score").alias("language"), (1 / part).alias("probability"),
                      best("likely").alias("text_language"), "declared", "host")
