"""Mixing documents to target weights of soft domains.

The labelled table gives three domains: ``toxic``, ``low`` (quality 0) and
``clean``. A naive Bayes classifier on the words a text holds, fitted on at most ``SAMPLE``
labelled rows (copies once) and pruned to words whose log ratio is significant,
gives every document its posterior over the domains. Rates r >= 0 are then
fitted so that the expected tokens of each domain, sum of r * tokens *
posterior, match the targets in the least-squares sense. With residuals scaled
by the domains' present sizes, steps of length 1 of the projected gradient
cannot overshoot; a step only needs one aggregation of three sums. A rate is a
function of the posterior alone, so rates are computed in the row, never stored.

The total is set so that the first domain (clean) keeps its present size.

Defined cases: a null or blank text has no tokens and the prior as posterior; a
domain without any mass keeps its rate term out; without labels everything is
clean; repeated rows count as often as they occur; empty tables give no rows;
other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.texts import packed, whole, word_hashes
from labelloom.session import settle

DOMAINS = ("clean", "low", "toxic")
TARGETS = (0.985, 0.01, 0.005)
SAMPLE = 20_000  # labelled documents the classifier is fitted on, chosen by a hash of the id
SIGNIFICANT = 5.0  # standard errors a word's log ratio must differ from 0
FEATURES = 4096  # words of the classifier at most, the most significant ones
SLOTS = 1 << 16  # places for these words; of two in one place the more significant one is a feature
STEPS = 40
TOLERANCE = 1e-4  # of the wanted total


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, F.lit(2)).when(quality == 0, F.lit(1)).otherwise(F.lit(0))


def slot(h: Column) -> Column:
    return F.pmod(h, F.lit(SLOTS)).cast("int")


def sampled_labels(labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc, d) of at most ``limit`` documents; of contradicting labels the worse counts."""
    each = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(
        F.max(domain(F.col("quality"), F.col("toxic"))).alias("d")
    )
    return each.orderBy(F.xxhash64("doc"), "doc").limit(limit)


def weights(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """One row: ``words`` (the hash in each slot, or null), ``low`` and ``toxic`` (its log ratios to clean), ``prior`` (log ratios)."""
    marked = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(
        F.broadcast(sampled_labels(labels)), "doc"
    )
    marked = marked.select("d", F.sort_array(F.array_distinct(word_hashes(whole("text")))).alias("h"))
    distinct = marked.groupBy(F.xxhash64("h")).agg(F.max(F.struct("d", "h")).alias("one"))  # copies count once
    distinct = settle(distinct.select("one.d", "one.h"))
    count = lambda i: F.count(F.when(F.col("d") == i, 1))
    known = distinct.agg(*[count(i).alias(f"k{i}") for i in range(3)]).withColumn("one", F.lit(1))
    words = (
        distinct.select("d", F.explode("h").alias("h"))
        .groupBy("h")
        .agg(*[count(i).alias(f"n{i}") for i in range(3)])
        .withColumn("one", F.lit(1))
        .join(known, "one")
    )

    def ratio(i: int) -> tuple[Column, Column]:
        """Log ratio of the shares of documents that hold a word, and its size in standard errors."""
        mine, clean = F.col(f"n{i}") + 0.5, F.col("n0") + 0.5
        value = F.log(mine / (F.col(f"k{i}") + 1)) - F.log(clean / (F.col("k0") + 1))
        # two-proportion test with the pooled share; zero counts leave its variance alone
        pooled = F.try_divide(F.col(f"n{i}") + F.col("n0"), F.col(f"k{i}") + F.col("k0"))
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col(f"k{i}")) + F.try_divide(F.lit(1.0), F.col("k0"))))
        gap = F.abs(F.try_divide(F.col(f"n{i}"), F.col(f"k{i}")) - F.try_divide(F.col("n0"), F.col("k0")))
        both = (F.col(f"k{i}") > 0) & (F.col("k0") > 0) & (spread > 0)
        return value, F.when(both, gap / F.when(both, spread)).otherwise(0.0)

    def absent(i: int) -> Column:
        """Log ratio of the shares of documents that lack a word."""
        return F.log(1 - (F.col(f"n{i}") + 0.5) / (F.col(f"k{i}") + 1)) - F.log(1 - (F.col("n0") + 0.5) / (F.col("k0") + 1))

    kept = lambda i, c: F.when(ratio(i)[1] >= SIGNIFICANT, c).otherwise(0.0)
    sure = words.select(
        "h", kept(1, ratio(1)[0] - absent(1)).alias("low"), kept(2, ratio(2)[0] - absent(2)).alias("toxic"),
        kept(1, absent(1)).alias("no_low"), kept(2, absent(2)).alias("no_toxic"), F.greatest(ratio(1)[1], ratio(2)[1]).alias("z")
    ).filter(F.col("z") >= SIGNIFICANT)
    sure = sure.orderBy(F.col("z").desc(), "h").limit(FEATURES)
    sure = sure.groupBy(slot(F.col("h")).alias("slot")).agg(F.max(F.struct("z", "h", "low", "toxic", "no_low", "no_toxic")).alias("w"))
    dense = docs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(sure, "slot", "left")
    found = dense.agg(
        F.array_sort(F.collect_list(F.struct("slot", "w.h", "w.low", "w.toxic"))).alias("cells"),
        F.coalesce(F.sum("w.no_low"), F.lit(0.0)).alias("no1"),  # a text that holds none of the words
        F.coalesce(F.sum("w.no_toxic"), F.lit(0.0)).alias("no2"),
    )
    prior = lambda i: F.log((F.col(f"k{i}") + 0.01) / (F.col("k0") + 1)) + F.col(f"no{i}")
    return found.withColumn("one", F.lit(1)).join(known, "one").select(
        F.col("cells.h").alias("words"), F.col("cells.low").alias("low"), F.col("cells.toxic").alias("toxic"),
        F.array(prior(1), prior(2)).alias("prior"),
    )


def posteriors(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, n_tokens and p_<domain> of every document."""
    fitted = settle(weights(docs, labels, key, text))
    part = lambda name: fitted.select(name).scalar().alias(f"fitted_{name}")
    t = packed(docs, text).select("row", word_hashes(F.col("text")).alias("h"), part("words"))
    held = F.array_distinct(F.filter("h", lambda x: F.col("fitted_words")[slot(x)] == x))
    # each array is used once, so it is folded into its use and not copied into every row
    t = t.select(
        "row", F.size("h").cast("long").alias("n_tokens"), held.alias("held"), part("low"), part("toxic"), part("prior")
    )
    odds = lambda name: F.aggregate("held", F.lit(0.0), lambda a, x: a + F.col(f"fitted_{name}")[slot(x)])
    t = t.select(
        "row", "n_tokens", F.col("fitted_prior").alias("prior"), odds("low").alias("o1"), odds("toxic").alias("o2")
    )
    bounded = lambda c: F.greatest(F.lit(-50.0), F.least(F.lit(50.0), c))
    t = t.select(
        "row", "n_tokens", F.exp(bounded(F.col("o1") + F.col("prior")[0])).alias("e1"),
        F.exp(bounded(F.col("o2") + F.col("prior")[1])).alias("e2"),
    )
    total = 1 + F.col("e1") + F.col("e2")
    return t.select(
        "row", "n_tokens", (1 / total).alias("p_clean"), (F.col("e1") / total).alias("p_low"),
        (F.col("e2") / total).alias("p_toxic"),
    )


def rate(steps: Sequence[Sequence[float]]) -> Column:
    """The rate after these gradient steps, from the posterior."""
    r = F.lit(1.0)
    for g in steps:
        move = sum((F.col(f"p_{d}") * float(x) for d, x in zip(DOMAINS, g, strict=True)), F.lit(0.0))
        r = F.greatest(F.lit(0.0), r - move)
    return r


def fit_rates(soft: DataFrame, targets: Sequence[float] = TARGETS) -> tuple[list[list[float]], float]:
    """Gradient steps and the residual left, as a share of the wanted total.

    soft: n_tokens and p_<domain>; three sums per step reach the driver.
    """
    steps: list[list[float]] = []
    now = wanted = total = None
    while True:
        r = rate(steps)
        sums = soft.agg(*[F.sum(r * F.col("n_tokens") * F.col(f"p_{d}")) for d in DOMAINS]).first()
        sums = [float(x or 0.0) for x in sums]
        if now is None:
            now = sums
            total = now[0] / targets[0]
            wanted = [w * total for w in targets]
        gaps = [s - w if size > 0 else 0.0 for s, w, size in zip(sums, wanted, now, strict=True)]
        left = max(map(abs, gaps)) / total if total else 0.0
        if left <= TOLERANCE or len(steps) == STEPS:
            return steps, left
        steps.append([g / size if size > 0 else 0.0 for g, size in zip(gaps, now, strict=True)])


def mixed(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS) -> DataFrame:
    """row, n_tokens, p_<domain>, ``rate`` and ``copies`` (the rate, rounded) of every document."""
    soft = posteriors(docs, labels)
    numbers = settle(soft.drop("row"))
    steps, _ = fit_rates(numbers, targets)
    return soft.select("*", rate(steps).alias("rate")).withColumn("copies", F.floor(F.col("rate") + 0.5))


def remixed(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS) -> DataFrame:
    """Every document as often as its copies say."""
    found = mixed(docs, labels, targets).select("row", F.explode(F.expr("array_repeat(0, int(copies))")))
    return found.select("row.*")
