"""URL filters by a temporal join: dated list entries become validity intervals, and each capture meets those in force when it
was fetched.

Entries: (list, kind, pattern, action, day). kind is `host` (the host itself or any host below it) or `path` (a host and the
beginning of a path, whole segments, as in `host/a/b`); action `add` or `remove`. Entries of one list, kind and pattern on one day
collapse to one, `remove` winning. Each entry is in force from its day until the next entry of the same list and pattern: the
intervals of a pattern don't overlap, there are at most as many as days, and those that `remove` opens are dropped.

Captures: any rows with a URL and a time. A URL's keys are its host's suffixes by label, and its host with each beginning of its
path, no deeper than the deepest pattern of the lists. Keys meet patterns by equality and the capture's day by the interval
that holds it: an as-of join, evaluated inside an equi-join. The most specific pattern decides: paths before hosts, then
the longest; on one pattern, an `allow` list outweighs a `block` list. Without a pattern in force a capture is allowed.

All of it is DataFrame operations. Intervals are broadcast only when counted and few; else the join is shuffled, where
Spark splits keys that many captures share. Lists are named `block...` or `allow...`; others are an error of the caller's
and count as block lists.
Nulls: a null or hostless URL, or a null time, has no match and is allowed. Entries with any null part are ignored. Host names are
compared in lower case without a leading `www.`, ports, credentials, queries and fragments dropped. Repeated captures
are judged each for itself, by their row; extra columns pass through, own columns of the same names as outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

OUTPUTS = ["host", "verdict", "rule_kind", "rule_pattern", "rule_list", "rule_from"]


def host_of(url: Column) -> Column:
    """The host in lower case, '' where there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#\\]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"^www\.|\.$", "")


def path_of(url: Column) -> Column:
    """Path segments without query, fragment and empty segments."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*(/[^?#]*)?", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, from, until): until is the first day no longer in force, null for none."""
    whole = entries.select("list", "kind", "pattern", "action", F.col("day").cast("date").alias("day")).dropna()
    daily = whole.groupBy("list", "kind", "pattern", "day").agg(F.max(F.col("action") == "remove").alias("removed"))
    w = Window.partitionBy("list", "kind", "pattern").orderBy("day")
    return daily.withColumn("until", F.lead("day").over(w)).filter(~F.col("removed")).select("list", "kind", "pattern", F.col("day").alias("from"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", time: str = "fetched") -> DataFrame:
    """captures with OUTPUTS: verdict is `allow` or `block`, the rule that decided is null where there is none."""
    rules = cut(intervals(entries), "intervals")
    depth = rules.agg(F.max(F.when(F.col("kind") == "host", F.size(F.split("pattern", r"\.")))).alias("host"), F.max(F.when(F.col("kind") == "path", F.size(F.split("pattern", "/")) - 1)).alias("path")).first()
    rest = captures.drop(*OUTPUTS)
    named = rest.withColumn("_row", F.monotonically_increasing_id()).withColumn("host", host_of(F.col(url)))
    cut_rows = cut(named, "captures")
    labels, parts = F.split("host", r"\."), path_of(F.col(url))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, depth["host"] or 0)))), lambda k: F.struct(F.lit("host").alias("kind"), F.concat_ws(".", F.slice(labels, F.size(labels) - k + 1, k)).alias("pattern")))
    deep = F.least(F.size(parts), F.lit(depth["path"] or 0))
    paths = F.when(deep > 0, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda k: F.struct(F.lit("path").alias("kind"), F.concat_ws("/", F.col("host"), F.concat_ws("/", F.slice(parts, 1, k))).alias("pattern")))).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))
    keys = cut_rows.filter((F.col("host") != "") & F.col(time).isNotNull()).select("_row", F.col(time).cast("date").alias("_day"), F.explode(F.concat(suffixes, paths)).alias("k")).select("_row", "_day", "k.kind", "k.pattern")
    active = (F.col("_day") >= F.col("from")) & (F.col("until").isNull() | (F.col("_day") < F.col("until")))
    hits = keys.join(small(rules), ["kind", "pattern"]).filter(active)
    allow = F.col("list").startswith("allow")
    order = F.struct((F.col("kind") == "path").alias("p"), F.length("pattern").alias("n"), allow.alias("a"), F.col("list").alias("l"))
    decided = hits.groupBy("_row").agg(F.max_by(F.struct("kind", "pattern", "list", "from", allow.alias("allowed")), order).alias("r"))
    out = cut_rows.join(decided, "_row", "left")
    return out.select(*[c for c in rest.columns], "host", F.when(F.col("r.allowed") | F.col("r").isNull(), "allow").otherwise("block").alias("verdict"), F.col("r.kind").alias("rule_kind"), F.col("r.pattern").alias("rule_pattern"), F.col("r.list").alias("rule_list"), F.col("r.from").alias("rule_from"))


def dated_lists(pages: DataFrame, url: str = "url") -> DataFrame:
    """Dated entries made from the hosts and paths that pages have, for tables that bring no lists: three in seven hosts stand on a block
    list from a day of 2023 on, every second of them leaves it later and every fourth returns; an allow list and path rules
    go by their own numbers. All numbers come from md5, so that SQL can follow."""
    number = lambda x, salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), x)), 1, 7), 16, 10).cast("int")
    host = host_of(F.col(url))
    hosts = pages.select(host.alias("pattern")).filter("pattern <> ''").distinct()
    first = F.concat_ws("/", host, F.get(path_of(F.col(url)), 0))
    paths = pages.filter((host != "") & (F.size(path_of(F.col(url))) > 0)).select(first.alias("pattern")).distinct()
    start = F.lit("2023-01-01").cast("date")

    def dated(df: DataFrame, name: str, kind: str, every: int, below: int) -> DataFrame:
        n = df.filter(number(F.col("pattern"), name) % every < below).withColumn("a", number(F.col("pattern"), f"{name}-day") % 600)
        steps = F.array(F.struct(F.lit("add").alias("action"), F.col("a").alias("d")), F.struct(F.lit("remove").alias("action"), (F.col("a") + 90).alias("d")), F.struct(F.lit("add").alias("action"), (F.col("a") + 150).alias("d")))
        many = F.when(number(F.col("pattern"), f"{name}-n") % 4 == 0, 3).when(number(F.col("pattern"), f"{name}-n") % 2 == 0, 2).otherwise(1)
        return n.withColumn("s", F.explode(F.slice(steps, 1, many))).select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), "pattern", "s.action", F.date_add(start, F.col("s.d")).alias("day"))

    domains = hosts.select(F.array_join(F.slice(F.split("pattern", r"\."), -2, 2), ".").alias("pattern")).filter("pattern like '%.%'").distinct()
    return dated(hosts, "block-hosts", "host", 7, 3).unionByName(dated(domains, "block-domains", "host", 5, 1)).unionByName(dated(paths, "block-paths", "path", 6, 1)).unionByName(dated(paths, "allow-paths", "path", 9, 1))
