"""Rule bitmask ledger: every rule is evaluated once per document, policies come later.

``rule_ledger`` measures each whole text and stores one failure bit per rule.
``apply_policy`` keeps the documents whose bits do not meet a policy's mask, and
``ablation`` counts from the bits alone what each rule of a policy removes.
Everything is DataFrame expressions on the document's own row, so nothing is shuffled
but the ablation counts (one row per distinct bit pattern and task).

Defined cases: a null or blank text has no words and zero measurements, and fails
``few_words``; null or repeated ids are rows like any other; the input row travels whole in
the struct ``doc``, so no name of an extra column can clash; an empty table gives no rows.
A word window is recognised by a 64-bit hash; windows are compared within one document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_stutter"]

#: name -> (failure condition over the measurements). The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "word_length_low": "word_chars < 2 * n_words",
    "word_length_high": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines",
    "shouting": "n_letters >= 40 AND 10 * n_upper > 6 * n_letters",
    "marks": "10 * n_marks > 5 * n_words",
    "stutter": "10 * n_stutter > 3 * n_words",
}

#: Versioned policies: rule names whose failure rejects a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "word_length_low", "word_length_high", "symbols", "repeated_lines", "shouting", "marks",
           "stutter"],
}


def mask_of(rules: list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _let(value: Column, body) -> Column:
    """Binds a costly value once inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, n_words: Column, size: int = WINDOW) -> Column:
    """Number of words covered by ``size``-word windows that occur twice or more.

    Windows are sorted by (hash, position); neighbours with equal hashes are repeats, and
    the union of their spans is summed in order of position: no step is quadratic.
    """
    starts = F.sequence(F.lit(1), n_words - (size - 1))

    def spans(at: Column) -> Column:
        step = lambda p, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - p, F.lit(size)))
        return F.aggregate(F.transform(at, step), F.lit(0), lambda a, x: a + x)

    def repeats(ordered: Column) -> Column:
        twin = lambda x, i: ((x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"])).eqNullSafe(True)
        return _let(F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"])), spans)

    def measure(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(F.sort_array(pairs), repeats))

    windows = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hw: F.transform(starts, lambda i: F.xxhash64(F.slice(hw, i, size))))
    return F.when(n_words < size + 1, F.lit(0)).otherwise(_let(windows, measure))


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc: the input row, and the columns of ``MEASURES``). The words are split once (the generator keeps them in one place)."""
    t = F.col("text_0")
    words = F.array_remove(F.split(t, BLANKS), "")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text_0"))
    split = rows.select("doc", "text_0", F.inline(F.array(F.struct(
        words.alias("words_0"), F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines_0")))))
    return split.select(
        "doc", F.size("words_0").cast("long").alias("n_words"),
        F.length(F.array_join("words_0", "")).cast("long").alias("word_chars"), _count(t, "[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines_0") - F.size(F.array_distinct("lines_0"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words_0"), F.size("words_0")).cast("long").alias("n_repeat_words"),
        F.size("lines_0").cast("long").alias("n_lines"), _count(t, "\\p{Lu}+").alias("n_upper"), _count(t, "\\p{L}+").alias("n_letters"),
        _count(t, "[!?]{2,}").alias("n_marks"),
        F.size(F.filter("words_0", lambda w, i: w == F.get("words_0", i - 1))).cast("long").alias("n_stutter"))


def rule_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Input row (``doc``), measurements, and ``rule_bits``: bit i is set if rule i fails."""
    # one generated row keeps the measurements from being evaluated again for every rule
    kept = measure(docs, text).select("doc", F.inline(F.array(F.struct(*MEASURES))))
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())), F.lit(0).cast("long"))
    return kept.withColumn("rule_bits", bits)


def apply_policy(ledger: DataFrame, policy: str | list[str] = "v1", out: str = "kept") -> DataFrame:
    """Adds a boolean: no rule of the policy failed. Texts are not read again."""
    mask = mask_of(POLICIES[policy] if isinstance(policy, str) else policy)
    return ledger.withColumn(out, F.col("rule_bits").bitwiseAND(F.lit(mask)) == 0)


def ablation(ledger: DataFrame, policy: str | list[str] = "v1") -> DataFrame:
    """Per rule of a policy: documents failing it, failing only it, and kept without it."""
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    mask = mask_of(rules)
    patterns = ledger.groupBy(F.col("rule_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).cast("long").alias("bit")) for r in rules]))
    rows = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    others = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return rows.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
                                    F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
                                    F.sum(F.when(others == 0, F.col("n")).otherwise(0)).alias("kept_without"))
