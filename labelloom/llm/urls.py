"""URL lists that change over time: every capture meets the entries active when it was fetched.

A list is a log of dated entries (pattern, action, since). Per pattern an entry
holds until the next one; ``remove`` ends it without a successor. A capture is
looked up under all keys its URL has: the host and its parent domains (``host``
patterns), and the host with each leading part of the path (``host/path/``).
Only keys of a length that some pattern has are built, so a long path costs no more than
the list asks for. The longest active pattern decides, ``block`` before ``allow`` on a tie.

Defined cases: user names, ports, trailing dots of the host, blanks before the URL and a
missing scheme (``//host/``) do not hide a host; a null URL, one without a host and a null fetch time match
nothing; of entries of one pattern and date the greatest action name counts;
captures equal in id, URL and time give one row; an empty list leaves all
captures undecided; further columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_START = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
HOST = _START + r"(?:[^/?#]*@)?([^/:?#@]*[^/:?#@.])"
PATH = _START + r"[^/?#]+/([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until): when each entry holds; until is open (null) for the last."""
    dated = (
        entries.filter("pattern is not null and since is not null")
        .groupBy(F.lower("pattern").alias("pattern"), "since")
        .agg(F.max("action").alias("action"))
    )
    following = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return dated.withColumn("until", following).filter("action <> 'remove'")


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots; the scheme may be missing."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def depths(patterns: DataFrame) -> tuple[list[int], list[int]]:
    """Numbers of labels of the host patterns and of path parts of the others: as many numbers
    as the longest pattern has parts, at most."""
    parts = F.size(F.split("pattern", "/"))
    path = parts > 1
    n = F.when(path, parts - 2).otherwise(F.size(F.split("pattern", "\\.")))
    found = patterns.select(path.alias("path"), n.alias("n")).distinct().filter("n > 0").collect()
    return tuple(sorted(r["n"] for r in found if r["path"] == p) for p in (False, True))


def keys(url: Column, host_depths: list[int], path_depths: list[int]) -> Column:
    """The patterns of these depths that would cover the URL."""
    numbers = lambda ns: F.array(*[F.lit(n) for n in ns]).cast("array<int>")
    name = host(url)
    labels = F.split(name, "\\.")
    domains = F.transform(
        F.filter(numbers(host_depths), lambda n: n <= F.size(labels)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    parts = F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/")
    prefixes = F.transform(
        F.filter(numbers(path_depths), lambda n: n < F.size(parts)),
        lambda n: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")),
    )
    return F.when(name != "", F.concat(domains, prefixes))


def decided(captures: DataFrame, entries: DataFrame, key: str, url: str, fetched: str) -> DataFrame:
    """(id, url, fetched, host, n_active, pattern, decision) per capture."""
    seen = captures.select(
        F.col(key).alias("id"), F.col(url).alias("url"), F.col(fetched).alias("fetched")
    ).distinct()
    active = intervals(entries)
    looked = seen.select("*", F.explode_outer(keys(F.col("url"), *depths(active))).alias("pattern"))
    met = looked.join(
        active,
        (looked.pattern == active.pattern)
        & (looked.fetched >= active.since)
        & (active.until.isNull() | (looked.fetched < active.until)),
        "left",
    ).select("id", "url", "fetched", active.pattern.alias("pattern"), "action")
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern"), "action", "pattern"))).alias("best")
    out = met.groupBy("id", "url", "fetched").agg(F.count("pattern").alias("n_active"), best)
    return out.select(
        "id", "url", "fetched", F.coalesce(host(F.col("url")), F.lit("")).alias("host"), "n_active",
        F.col("best.pattern").alias("pattern"), F.coalesce("best.action", F.lit("none")).alias("decision"),
    )
