"""URL filters: captures against dated lists, as of the time of the fetch, with DataFrame operations only.

A list's dated entries (add or remove a key at a time) become validity intervals [from, to), kept as one sorted timeline for
each list and key. Captures meet the timelines of their keys by an equi-join, and an as-of lookup (binary search) finds the entry
that was in force at the fetch, so a capture costs the logarithm of a timeline, not its length. A key is
a host or a parent domain (kind `domain`), or a whole URL without scheme, port, query and fragment (kind
`url`). Captures are reduced to their distinct (key source, fetch time) before they are expanded to the
keys that may match, so a host with a third of all captures weighs no more than its distinct times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import free_name, let


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), r"\.+$", "")


def page_of(url: Column) -> Column:
    """Host and path, without a trailing slash."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path, r"/+$", ""))


def domain_keys(host: Column) -> Column:
    """The host and its parent domains, the top level left out."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, key, verdict, valid_from, valid_to (null: open) of dated entries (list, kind, key, verdict, action, at).

    An entry's effect ends at the next entry of the same list, kind and key; of entries at one time, a removal
    wins, then the greatest verdict. Entries with null list, kind, key or time are left out.
    """
    ahead = Window.partitionBy("list", "kind", "key").orderBy("at")
    spans = _per_time(entries).select("list", "kind", "key", "verdict", "gone", F.col("at").alias("valid_from"), F.lead("at").over(ahead).alias("valid_to"))
    return spans.where(~F.col("gone")).drop("gone")


def _per_time(entries: DataFrame) -> DataFrame:
    known = entries.where("list is not null and kind is not null and key is not null and at is not null")
    return known.groupBy("list", "kind", "key", "at").agg(F.max(F.coalesce("action", F.lit("add")) == "remove").alias("gone"), F.max("verdict").alias("verdict"))


def timelines(entries: DataFrame) -> DataFrame:
    """list, kind, key, steps: a row for each list and key, its entries as (at, gone, verdict), one for each time, ascending."""
    return _per_time(entries).groupBy("list", "kind", "key").agg(F.sort_array(F.collect_list(F.struct("at", "gone", "verdict"))).alias("steps"))


def in_force(steps: Column, at: Column) -> Column:
    """The last step at or before a time; null if there is none. Binary search: 31 halvings serve any array."""

    def found(s: Column) -> Column:
        def halve(x: Column, _: Column) -> Column:
            middle = F.floor((x["low"] + x["high"] + 1) / 2).cast("int")
            reached = F.get(s, middle - 1)["at"] <= at
            open_ = x["low"] < x["high"]
            return F.struct(F.when(open_ & reached, middle).otherwise(x["low"]).alias("low"), F.when(open_ & ~reached, middle - 1).otherwise(x["high"]).alias("high"))

        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(s) + 1)).cast("int"))
        return F.get(s, F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(s).alias("high")), halve, lambda x: x["low"]) - 1)

    return let(steps, found)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched_at and any others) with host, lists (array of list names active for it, sorted)
    and blocked behind its own: some active entry blocks and none allows. Clashing names get an underscore in front.

    Null, empty or unusable URLs and null fetch times match nothing and are not blocked. Repeated rows stay. An empty table gives
    no rows, and without entries nothing is blocked. Ties: see intervals(). URLs of any length are matched whole.
    """
    names = captures.columns
    host, lists, blocked = (free_name(names, x) for x in ("host", "lists", "blocked"))
    own = {x: free_name([*names, host], x) for x in ("_page", "_time")}
    base = captures.withColumns({host: host_of(F.col("url")), own["_page"]: page_of(F.col("url")), own["_time"]: F.col("fetched_at")})
    seen = base.select(F.col(host).alias("host"), F.col(own["_page"]).alias("page"), F.col("fetched_at").alias("time")).where("host <> '' and time is not null")
    lines = timelines(entries)

    def verdicts(keyed: DataFrame, kind: str, by: str) -> DataFrame:
        met = keyed.join(lines.where(F.col("kind") == kind), "key").withColumn("step", in_force(F.col("steps"), F.col("time"))).where("not step.gone")
        return met.groupBy(by, "time").agg(
            F.collect_set("list").alias(f"{kind}_lists"), F.max(F.col("step.verdict") == "block").alias(f"{kind}_block"), F.max(F.col("step.verdict") == "allow").alias(f"{kind}_allow")
        )

    domains = verdicts(seen.select("host", "time").distinct().withColumn("key", F.explode(domain_keys(F.col("host")))), "domain", "host")
    pages = verdicts(seen.select("page", "time").distinct().withColumn("key", F.col("page")), "url", "page")
    b, d, p = base.alias("b"), domains.alias("d"), pages.alias("p")
    at = lambda c: F.col(f"b.`{c}`")
    joined = b.join(d, (at(host) == F.col("d.host")) & (at(own["_time"]) == F.col("d.time")), "left").join(p, (at(own["_page"]) == F.col("p.page")) & (at(own["_time"]) == F.col("p.time")), "left")
    none = F.array().cast("array<string>")
    either = lambda what: F.coalesce(F.col(f"d.domain_{what}"), F.lit(False)) | F.coalesce(F.col(f"p.url_{what}"), F.lit(False))
    return joined.select(
        *(at(c).alias(c) for c in names), at(host).alias(host),
        F.array_sort(F.array_union(F.coalesce("d.domain_lists", none), F.coalesce("p.url_lists", none))).alias(lists), (either("block") & ~either("allow")).alias(blocked),
    )
