"""Temporal list join: dated list entries become validity intervals, and every capture meets the entries active when it was fetched.

An entry is a change: on a day, a key (a domain, a host, or a host with its first path segment) is added to or removed from a
category of the list.  Between an addition and the next change of the same key and category the entry is active.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import quoted

URL = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?"
FOREVER = "9999-12-31"


def url_host(url: Column) -> Column:
    """Host in lower case without a last dot; null where the text has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"\.$", "")
    return F.when(host != "", host)


def url_directory(url: Column) -> Column:
    """First segment of the path; null where there is none."""
    first = F.regexp_extract(F.regexp_extract(url, URL, 2), r"^/+([^/]+)", 1)
    return F.when(first != "", first)


def url_keys(url: Column) -> Column:
    """Keys that a list may hold for a URL, most specific first: host/segment, host, then each parent domain of two labels or more."""
    host, first = url_host(url), url_directory(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, F.greatest(F.size(labels), F.lit(0))), "."))
    keys = F.concat(F.array(F.concat_ws("/", host, first)), F.when(F.size(labels) > 1, parents).otherwise(F.array(host)))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def validity(entries: DataFrame) -> DataFrame:
    """``key, category, valid_from, valid_to`` (end excluded) from ``key, category, day, action`` (add or remove).

    Of several changes of one key and category on one day, a removal wins.  A key and category then has one row a day at most, which bounds the
    window.  Repeated additions make adjoining intervals, a removal without an addition none; rows with a null key,
    day or unknown action are dropped, a null category counts as a category of its own.
    """
    known = entries.where(F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    daily = known.groupBy("key", "category", "day").agg(F.min(F.col("action") == "add").alias("__added"))
    after = F.lead("day").over(Window.partitionBy("key", "category").orderBy("day"))
    return (daily.withColumn("valid_to", F.coalesce(after, F.lit(FOREVER).cast("date"))).where("__added")
            .select("key", "category", F.col("day").alias("valid_from"), "valid_to"))


def active_entries(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on", allow: str = "allow") -> DataFrame:
    """The captures' columns, ``n_active``, ``entry``, ``category`` (those of the deciding entry) and ``blocked``.

    The most specific active entry decides, of equally specific ones the first category; ``allow`` entries let the capture through.
    Captures are first reduced to their different pairs of keys and day, so a host with a third of all captures
    meets the list once a day and directory; the answers go back by the same pair.  A null URL, one without a host, or a
    null day has no active entry and is not blocked.  Every capture gives one row; columns of the added names are replaced.
    """
    kept = [c for c in captures.columns if c not in ("n_active", "entry", "category", "blocked")]
    asked = captures.select(*map(quoted, kept), url_keys(F.col(url)).alias("__keys"), F.col(fetched).alias("__day"))
    pairs = asked.where((F.size("__keys") > 0) & F.col("__day").isNotNull()).groupBy("__keys", "__day").agg(F.count(F.lit(1)).alias("__n"))
    looked = pairs.select("__keys", "__day", F.posexplode("__keys").alias("__rank", "key"))
    met = looked.join(validity(entries), "key").where((F.col("valid_from") <= F.col("__day")) & (F.col("__day") < F.col("valid_to")))
    decided = met.groupBy("__keys", "__day").agg(
        F.count(F.lit(1)).alias("__active"),
        F.min(F.struct("__rank", F.coalesce("category", F.lit("")).alias("c"), "key", "category")).alias("__first"))
    back = decided.select(F.col("__keys").alias("__k2"), F.col("__day").alias("__d2"), "__active", "__first")
    answered = asked.join(back, (F.col("__keys") == F.col("__k2")) & (F.col("__day") == F.col("__d2")), "left")
    return answered.select(
        *map(quoted, kept), F.coalesce("__active", F.lit(0)).cast("long").alias("n_active"), F.col("__first.key").alias("entry"),
        F.col("__first.category").alias("category"),
        (F.col("__first").isNotNull() & ~F.coalesce(F.col("__first.category") == allow, F.lit(False))).alias("blocked"))
