"""Host and path rules applied to urls by a sorted sweep over reversed-host keys.

Every host becomes a key of its labels from the last to the first, each followed by a dot
(`www.example.net` gives `net.example.www.`). The hosts that a rule covers, its own and all
subdomains, are then one interval of keys: from `net.example.` up to, without, `net.example/`
(the slash follows the dot in byte order). Intervals either nest or are apart, so at any
key the rules that may apply form a stack.

The sweep merges rule starts and distinct hosts in key order. It runs inside range
partitions, and what is open at the end of the earlier partitions is handed on in a table of
one row per partition. Urls are then joined to their host's stack, in which the longest rule
whose path the url starts with decides.

Rules: none is lost or capped. Ties of length go to the longer host, then to the smaller
path and verdict. A url that is null or has no `://` has an empty host and path and fits no
rule; the default verdict then holds. Repeated urls and ids give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "struct<size int, host string, path string, verdict string, rule string, key string, ends string>"


def host_of(url: Column) -> Column:
    """From after the first `://` to the next `/`, `?`, `#` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, to the next `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _nested(rules: DataFrame) -> DataFrame:
    """A row for each rule host: its key and the stack there, itself and the rules of all enclosing hosts."""
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' and verdict is not null").distinct()
    clean = clean.withColumn("key", key_of(F.col("host")))
    clean = clean.withColumn("ends", F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))).withColumn("rule", F.concat("host", "path"))
    own = clean.groupBy("key").agg(F.collect_list(F.struct(F.length("rule").alias("size"), "host", "path", "verdict", "rule", F.col("key").alias("key"), "ends").cast(RULE)).alias("own"))
    parts = F.split(F.col("key"), r"\.")
    above = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "."), F.lit(".")))).alias("outer"))
    return above.join(own.select(F.col("key").alias("outer"), "own"), "outer").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))


def _stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and the stack open at its key, by one sorted sweep over rule starts and hosts."""
    starts = _nested(rules).select("key", F.lit(None).cast("string").alias("host"), "stack")
    events = hosts.select(key_of(F.col("host")).alias("key"), "host", F.lit(None).cast(f"array<{RULE}>").alias("stack")).unionByName(starts)
    # Staged, so that both reads below see the same ranges.
    events = staged(events.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    opened = events.where("stack is not null").groupBy("part").agg(F.max_by("stack", "key").alias("last"))
    # One row per range; the stack handed on is the one of the last rule start before the range.
    handed = events.groupBy("part").agg(F.count("*").alias("n")).join(opened, "part", "left")
    handed = handed.select("part", F.last("last", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    sweep = Window.partitionBy("part").orderBy("key", F.col("host").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("here", F.last("stack", True).over(sweep)).where("host is not null")
    stack = F.coalesce("here", "before")
    open_here = F.filter(stack, lambda r: (r["key"] <= F.col("key")) & (F.col("key") < r["ends"]))
    return swept.join(F.broadcast(handed), "part", "left").select("host", open_here.alias("stack")).where(F.size("stack") > 0)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """urls(id, url) and rules(host, path, verdict) -> id, host, path, rule, verdict."""
    seen = urls.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    stacks = _stacks(seen.select("host").where("host <> ''").distinct(), rules)
    fit = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(fit, lambda r: F.struct(r["size"].alias("size"), F.length(r["host"]).alias("of_host"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    joined = seen.join(stacks, "host", "left").withColumn("won", longest)
    return joined.select("id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
