"""Exact Jaccard self-join on word shingles by rare-first prefix filtering.

A text's set holds its distinct shingles (of four words unless told otherwise) as 64-bit hashes. All sets
are ordered alike: first the shingles of one quarter of the hash space, rarest
first, then the rest by hash. Two sets at the threshold share one of the first
``n - ceil(t n) + 1`` shingles in this (or any) order, so only those are joined,
and only on shingles that two texts hold. A candidate pair must pass the

- length filter (sizes within the threshold of each other),
- positional filter (what can still follow the first common shingle suffices),
- suffix filter (the sizes of 16 slices of the token space bound the difference of the sets),

and is then verified once on the whole sets. The filter runs twice. Over all
texts, frequencies are counted in a quarter of the space, which keeps the shuffle
small and loses nothing, as any fixed order is exact. Over the texts that remain,
every shingle is ranked, so what a text shares with no other one comes first.

Copies: texts with the same set form one class, and its smallest id stands for
it. A frequent prefix shingle is first paired with one hub only; all pairs are
tried only between texts that the hubs have not connected yet. So a group of
thousands of near copies yields a link per text and no list of all pairs.

Defined cases: null or blank texts have the empty set, link with nothing and are
their own component; a text of fewer words than a shingle is one shingle; rows
that share an id are one node; a row without id takes no part (component null);
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.llm.components import components
from labelloom.llm.texts import joined_hashes, lower_ascii, whole, word_hashes
from labelloom.session import settle

SHINGLE = 4
PERCENT = 85
COUNTED = 4  # one in so many hashes is ranked by frequency
SLICES = 16


def shingled(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc, s, n): the set and its size per row."""
    if shingle < 1:
        raise ValueError("a shingle holds one word at least")
    t = docs.select(F.col(key).alias("doc"), word_hashes(lower_ascii(whole(text))).alias("h"))
    t = t.withColumn("run", F.col("h"))
    length = 1  # words each hash of ``run`` covers; two runs that overlap or touch make a longer one
    while length < shingle:
        step = min(length, shingle - length)
        t = t.select("doc", "h", joined_hashes(F.col("run"), F.col("run"), step).alias("run"))
        length += step
    s = (
        F.when(F.size("h") >= shingle, F.array_distinct("run"))
        .when(F.size("h") > 0, F.array(F.xxhash64("h")))
        .otherwise(F.array().cast("array<long>"))
    )
    t = t.select("doc", s.alias("s"))
    return t.select("doc", "s", F.size("s").alias("n"))


def needed(n: Column, percent: int) -> Column:
    """Smallest overlap a set of size n has with any partner at the threshold."""
    return F.floor((percent * n + 99) / 100)


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Smallest overlap of two sets of these sizes at the threshold."""
    return F.ceil(percent * (a + b) / (100 + percent))


def with_tokens(sets: DataFrame, percent: int, one_in: int) -> DataFrame:
    """``sets`` with r, the number of counted shingles (one in ``one_in``), and ``token``: those (fixed 0) and, where
    they are fewer than the prefix, the next ones."""
    own = [c for c in sets.columns if c != "s"]
    counted = F.filter("s", lambda x: F.pmod(x, F.lit(one_in)) == 0)
    prefix = (F.col("n") - needed(F.col("n"), percent) + 1).cast("int")
    t = sets.select(*own, "s", counted.alias("c"), prefix.alias("p"))
    t = t.select(*own, "s", "c", F.size("c").alias("r"), (F.col("p") - F.size("c")).alias("lack"))
    others = F.sort_array(F.filter("s", lambda x: F.pmod(x, F.lit(one_in)) != 0))
    more = F.when(F.col("lack") > 0, F.slice(others, F.lit(1), F.greatest("lack", F.lit(0))))
    t = t.select(*own, "c", "r", F.coalesce(more, F.array().cast("array<long>")).alias("more"))
    token = F.concat(
        F.transform("c", lambda x: F.struct(x.alias("h"), F.lit(0).alias("fixed"))),
        F.transform("more", lambda x, k: F.struct(x.alias("h"), (F.col("r") + k + 1).alias("fixed"))),
    )
    return t.select(*own, "r", token.alias("token"))


def postings(held: DataFrame, percent: int) -> DataFrame:
    """(h, doc, n, pos): prefix shingles that at least two texts hold, at their places in the order.

    Filters come after the generator only: pushed below it, they would repeat what made ``held``.
    """
    t = held.select("doc", "n", "r", F.explode_outer("token").alias("token"))
    tokens = t.select("token.h", "doc", "n", "r", "token.fixed").filter("h is not null")
    shared = settle(
        tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    )
    found = tokens.join(shared, "h")
    order = Window.partitionBy("doc").orderBy(F.col("fixed") > 0, "df", "h")
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn(
        "common", F.sum((F.col("fixed") == 0).cast("int")).over(Window.partitionBy("doc"))
    )
    pos = F.when(F.col("fixed") > 0, F.col("fixed")).otherwise(F.col("r") - F.col("common") + F.col("rank"))
    return (
        ranked.withColumn("pos", pos.cast("int"))
        .filter(F.col("pos") <= F.col("n") - needed(F.col("n"), percent) + 1)
        .select("h", "doc", "n", "pos", (F.col("r") - F.col("common")).cast("int").alias("alone"))
    )


def slice_sizes(s: Column) -> Column:
    """How many members fall in each slice of the token space."""
    of = F.transform(s, lambda x: F.pmod(F.shiftright(x, 7), F.lit(SLICES)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda k: F.size(of) - F.size(F.array_remove(of, k)))


def may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filter of two postings of the same shingle."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (
        rest + 1 >= least_overlap(na, nb, percent)
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: suffix filter on slice sizes, then the whole sets."""
    slim = sets.select("doc", "n", "slices")
    side = lambda df, x: df.select(*[F.col(c).alias(c if c == x else f"{x}_{c}") for c in df.columns])
    left, right = (side(slim.withColumnRenamed("doc", x), x) for x in ("a", "b"))
    near = pairs.join(left, "a").join(right, "b")
    gap = F.aggregate(
        F.zip_with("a_slices", "b_slices", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x
    )
    most = F.col("a_n") + F.col("b_n") - 2 * least_overlap(F.col("a_n"), F.col("b_n"), percent)
    near = near.filter(gap <= most).select("a", "b")
    full = sets.select("doc", "n", "s")
    left, right = (side(full.withColumnRenamed("doc", x), x) for x in ("a", "b"))
    both = near.join(left, "a").join(right, "b")
    both = both.withColumn("i", F.size(F.array_intersect("a_s", "b_s")))
    return both.filter(100 * F.col("i") >= percent * (F.col("a_n") + F.col("b_n") - F.col("i"))).select("a", "b")


def signed(sets: DataFrame) -> DataFrame:
    """``sets`` with two hashes of the whole set."""
    s = F.sort_array("s")
    return sets.select("*", F.xxhash64(s).alias("s1"), F.xxhash64(F.lit(1), s, F.col("n")).alias("s2"))


def classes(marked: DataFrame) -> DataFrame:
    """(doc, n, rep): rep is the smallest id with the same set (the id itself for empty sets)."""
    reps = marked.filter("n > 0 and doc is not null").groupBy("s1", "s2").agg(F.min("doc").alias("rep"))
    out = marked.join(reps, ["s1", "s2"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("rep")).otherwise(F.col("doc"))
    return out.select("doc", "n", own.alias("rep"))


def linked(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE
) -> DataFrame:
    """(doc, n, component) for every row."""
    # the only pass over all texts: hashes of the sets and the counted shingles are kept
    held = settle(with_tokens(signed(shingled(docs, key, text, shingle)), percent, COUNTED))
    member = settle(classes(held.select("doc", "n", "s1", "s2")))
    reps = member.filter("n > 0 and doc = rep").select("doc").distinct()
    wide = postings(held.filter("doc is not null"), percent).join(reps, "doc", "left_semi")
    wide = settle(wide.select("h", "doc"))
    met = wide.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b").select("h")
    wanted = wide.join(met, "h", "left_semi").select("doc").distinct()
    kept = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(wanted, "doc", "left_semi")
    kept = settle(shingled(kept, "doc", "text", shingle).withColumn("slices", slice_sizes(F.col("s"))))
    # only these texts can link: their shingles are now all ranked, by how many of these texts hold them
    posted = settle(postings(with_tokens(kept, percent, 1), percent).distinct())
    several = posted.groupBy("h").agg(F.min(F.struct("alone", "doc", "n", "pos")).alias("hub"), F.count("*").alias("m"))
    hubs = several.filter("m > 1").select("h", "hub.doc", "hub.n", "hub.pos")
    first = posted.alias("x").join(hubs.alias("y"), "h").filter(may_link("x", "y", percent))
    ends = lambda df: df.select(
        F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")
    ).filter("a < b").distinct()
    label = components(verified(ends(first), kept, percent), "a", "b")
    # what the hubs did not connect: all pairs of one shingle that lie in different components
    now = posted.join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
        "label", F.coalesce("label", "doc")
    )
    open_h = now.groupBy("h").agg(F.min("label").alias("l"), F.max("label").alias("g")).filter("l <> g").select("h")
    now = settle(now.join(open_h, "h", "left_semi"))
    apart = now.alias("x").join(
        now.alias("y"),
        (F.col("x.h") == F.col("y.h"))
        & (F.col("x.doc") < F.col("y.doc"))
        & (F.col("x.label") != F.col("y.label"))
        & may_link("x", "y", percent),
    )
    # a star for each component found so far joins the same texts as its links, in fewer rounds
    stars = label.select(F.col("label").alias("a"), F.col("node").alias("b"))
    links = stars.unionByName(verified(ends(apart), kept, percent))
    label = components(links, "a", "b").withColumnRenamed("node", "rep")
    return member.join(label, "rep", "left").select(
        "doc", "n", F.coalesce("label", "rep").alias("component")
    )


def keep_one(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The documents without all but one of each group of linked ones: the smallest id stays.

    Rows without id stay; of rows that repeat an id, all stay where that id does.
    """
    found = linked(docs, "doc_id", "text", percent, shingle)
    gone = found.filter("doc <> component").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
