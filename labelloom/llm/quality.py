"""Quality rules: fixed base rules, then a likelihood ratio of hashed n-grams.

``trusted`` texts and the raw corpus are two multinomials over ``BUCKETS``
hashed n-grams, single words and pairs of words. A document's score is the mean
log ratio of its words plus that of its pairs; it is kept when it passes the
base rules and scores at least ``threshold``. That is the cut with the fewest
errors on labelled documents that pass the base rules (quality 0 kept, quality 1
dropped), or ``THRESHOLD`` where fewer than ``LEAST_LABELLED`` have either label.

Defined cases: a null or blank text has no words and fails the base rules;
repeated rows each get their own (equal) verdict; without trusted documents
every ratio is 0 and the base rules decide; an empty table gives no rows; other
columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.texts import SPACE_CHARS, joined_hashes, packed, whole, word_hashes, words
from labelloom.operators.joins import lookup_join
from labelloom.operators.ordering import running_total
from labelloom.session import settle

BUCKETS = 1 << 14  # size of both multinomials, whatever the corpus
PRIOR = 1_000.0  # pseudo-counts that pull the target towards the corpus
THRESHOLD = -0.25  # mean log ratio a kept document reaches, where the labels are too few to derive one
LEAST_LABELLED = 20  # documents of either label that a derived threshold needs
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """row, the base measures, and the hashes of words (h) and word pairs (h2) of every document."""
    t = packed(docs, text).select("row", "text", words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    t = t.select(
        "row",
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    h = F.col("h")
    t = t.select(
        "row", "h", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        joined_hashes(h, h, 1).alias("h2"),
    )
    t = t.select("*", joined_hashes(F.col("h2"), F.col("h2"), 2).alias("h4"))
    # a window of five can only repeat where one of four does
    t = t.withColumn("h4", F.when(F.size(F.array_distinct("h4")) < F.size("h4"), F.col("h4")))
    t = t.withColumn("windows", joined_hashes(F.col("h4"), h, WINDOW - 1)).drop("h4")
    ranked = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    t = t.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ranked))
    r = F.col("windows")
    starts = F.transform(
        r, lambda x, k: F.when((F.get(r, k - 1)["h"] == x["h"]) | (F.get(r, k + 1)["h"] == x["h"]), x["i"])
    )
    t = t.withColumn("windows", F.sort_array(F.array_compact(starts)))
    s = F.col("windows")
    covered = F.aggregate(
        F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda a, x: a + x,
    )
    t = t.select(
        "row", "h", "h2", F.size("h").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return t.select("*", ((F.col("n_words") < MIN_WORDS) | repeats).alias("base_failed"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The distinct ids of all documents labelled good."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: ``ratio``, the log ratio of each bucket (0 where the corpus has none)."""
    good = trusted.select(F.col("doc_id").alias("doc"), F.lit(1).alias("good"))
    marked = (
        lookup_join(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), good, "doc")
        .select(F.coalesce("good", F.lit(0)).alias("good"), word_hashes(whole("text")).alias("h"))
        .select("good", "h", joined_hashes(F.col("h"), F.col("h"), 1).alias("h2"))
    )
    counts = (
        marked.select("good", F.explode(F.concat("h", "h2")).alias("x"))
        .groupBy(F.pmod("x", F.lit(BUCKETS)).cast("int").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
    )
    # one row per bucket at most, so both of these stay small
    dense = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    dense = dense.join(counts, "bucket", "left").na.fill(0)
    sums = dense.agg(
        F.sum("raw").alias("raws"),
        F.sum("target").alias("targets"),
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("cells"),
    )
    share = lambda c: c["raw"] / F.col("raws")
    log_ratio = lambda c: F.when(
        (c["raw"] > 0) & (F.col("targets") > 0),
        F.log((c["target"] + PRIOR * share(c)) / (F.col("targets") + PRIOR)) - F.log(share(c)),
    ).otherwise(F.lit(0.0))
    return sums.select(F.transform("cells", log_ratio).alias("ratio"))


def scored(docs: DataFrame, ratio: DataFrame, text: str = "text") -> DataFrame:
    """row, the base measures and ``score`` of every document."""
    # one name for each use: a column used once is folded into its use, not copied into every row
    t = measured(docs, text).select("*", ratio.scalar().alias("ratio_h"), ratio.scalar().alias("ratio_h2"))

    def mean(hashes: str) -> Column:
        r = F.col(f"ratio_{hashes}")
        total = F.aggregate(hashes, F.lit(0.0), lambda a, x: a + r[F.pmod(x, F.lit(BUCKETS)).cast("int")])
        return F.when(F.size(hashes) > 0, total / F.size(hashes))

    score = mean("h") + F.coalesce(mean("h2"), F.lit(0.0))
    return t.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        score.alias("score"),
    )


def least_error_cut(junk: np.ndarray, good: np.ndarray) -> float:
    """The score below which fewest of ``good`` and from which on fewest of ``junk`` lie.

    A cut lies in the middle between two neighbouring scores; of equal ones the widest gap counts, then the lowest.
    """
    values = np.unique(np.concatenate([junk, good]))
    junk, good = np.sort(junk), np.sort(good)
    low, high = values[:-1], values[1:]
    middles = (low + high) / 2
    # beyond both ends: everything is kept, or nothing
    cuts = np.concatenate([[values[0]], np.where(middles > low, middles, high), [np.nextafter(values[-1], np.inf)]])
    gaps = np.concatenate([[0.0], high - low, [0.0]])
    errors = len(junk) - np.searchsorted(junk, cuts) + np.searchsorted(good, cuts)
    return float(cuts[np.lexsort((cuts, -gaps, errors))[0]])


def least_error_threshold(rows: DataFrame) -> float | None:
    """``least_error_cut`` of any number of rows (label, score), by running counts over the distributed order of scores;
    None where fewer than ``LEAST_LABELLED`` have either label."""
    counts = rows.groupBy("score").agg(
        F.sum((F.col("label") == 0).cast("long")).alias("junk"),
        F.sum((F.col("label") == 1).cast("long")).alias("good"),
        F.lit(1).cast("long").alias("at"),
    )
    ranked = running_total(counts, ["score"], ["junk", "good", "at"])
    sums = ranked.agg(F.sum("junk").alias("junk"), F.sum("good").alias("good"), F.min("score").alias("least")).first()
    if min(sums["junk"] or 0, sums["good"] or 0) < LEAST_LABELLED:
        return None
    # cuts above a score and not above the next one: junk beyond it is kept, good up to it is dropped
    errors = F.lit(sums["junk"]) - F.col("cum_junk") + F.col("cum_good")
    above = ranked.select("score", errors.alias("errors"), "cum_at")
    fewest = above.agg(F.min("errors")).first()[0]
    if sums["junk"] < fewest:
        return sums["least"]  # everything is kept
    following = ranked.select((F.col("cum_at") - 1).alias("cum_at"), F.col("score").alias("high"))
    cuts = above.filter(F.col("errors") == fewest).join(following, "cum_at", "left")
    best = cuts.orderBy(F.coalesce(F.col("high") - F.col("score"), F.lit(0.0)).desc(), "score").first()
    if best["high"] is None:  # only the cut beyond the last score
        return sums["least"] if sums["junk"] == fewest else float(np.nextafter(best["score"], np.inf))
    middle = (best["score"] + best["high"]) / 2
    return middle if middle > best["score"] else best["high"]


def fit_threshold(docs: DataFrame, labels: DataFrame, ratio: DataFrame, key: str = "doc_id", text: str = "text") -> float:
    """The least-error cut between all labelled documents; of contradicting labels the worse counts."""
    each = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    each = each.groupBy(F.col("doc_id").alias("doc")).agg(F.min("quality").alias("label"))
    chosen = lookup_join(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), each, "doc", "inner")
    # written before the filter: pushed below the measures, it would repeat them
    rows = settle(scored(chosen, ratio).select(F.col("row.label").alias("label"), "base_failed", "score"))
    found = least_error_threshold(rows.filter(~F.col("base_failed")))
    return THRESHOLD if found is None else found


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float | None = None
) -> DataFrame:
    """row, the base measures, ``score`` and ``kept`` of every document; ``threshold`` replaces the derived one."""
    ratio = settle(ratios(docs, trusted_ids(labels), key, text))
    if threshold is None:
        threshold = fit_threshold(docs, labels, ratio, key, text)
    return scored(docs, ratio, text).select(
        "*", (~F.col("base_failed") & (F.coalesce("score", F.lit(0.0)) >= threshold)).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    # a filter on the measures would be pushed below them and repeat them; it is not pushed below a generator
    found = judge(docs, labels).select("row", F.explode_outer(F.expr("array_repeat(true, int(kept))")).alias("stays"))
    return found.filter("stays").select("row.*")
