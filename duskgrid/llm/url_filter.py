"""URL filters over dated lists: entries become validity intervals, captures meet those active when they were fetched.

A list entry says that from a moment on a domain is (`add`) or is no longer (`remove`) on a list. For each list and
domain the entries in order of time give intervals; a capture matches a list if some domain its host belongs to (the
host itself or a parent) has an interval around the fetch time, that is if the latest entry as of then is an `add`.
This is an equi-join on the domain with the interval as further condition, which Spark can split where a host is hot;
all of it is DataFrame operations.

Defined results: of entries with one list, domain and moment the `remove` wins; entries with a null in any of them take
no part; URLs without a host (null, empty or not of the form scheme://host) and captures without a fetch time match
nothing; a capture is a distinct (page_id, url, fetched), so repeated rows give one; empty tables give every capture
unmatched; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The lower-cased host of a URL, without user (all up to the last @), port and final dot; null if there is none."""
    raw = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:@]+)", 1))
    bare = F.regexp_replace(raw, r"\.+$", "")
    return F.when(bare != "", bare)


def domains(name: Column) -> Column:
    """The host and every parent domain of it."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def intervals(entries: DataFrame) -> DataFrame:
    """list, domain, since, until (excluded; null: to this day) of entries (list, domain, action, ts)."""
    whole = entries.where("list is not null and domain is not null and action is not null and ts is not null")
    last = whole.groupBy("list", F.lower("domain").alias("domain"), "ts").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    later = Window.partitionBy("list", "domain").orderBy("ts")
    return last.withColumn("until", F.lead("ts").over(later)).where("action = 'add'").select("list", "domain", F.col("ts").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, host, lists (sorted names), blocked of captures (page_id, url, fetched)."""
    rows = captures.select("page_id", "url", "fetched").withColumn("host", host(F.col("url")))
    parts = rows.withColumn("domain", F.explode_outer(domains(F.col("host"))))
    spans = intervals(entries)
    met = (parts["domain"] == spans["domain"]) & (parts["fetched"] >= spans["since"]) & (spans["until"].isNull() | (parts["fetched"] < spans["until"]))
    names = F.array_sort(F.collect_set("list"))  # as many as there are lists
    return parts.join(spans.drop("host"), met, "left").groupBy("page_id", "url", "fetched", "host").agg(names.alias("lists")).withColumn("blocked", F.size("lists") > 0)
