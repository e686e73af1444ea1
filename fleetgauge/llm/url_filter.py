"""URL verdicts by a sort-merge range join.

A host is turned round label by label (`www.example.net` becomes `net|example|www|`), so that a rule
for a host and all its subdomains is one interval of keys, and a rule's path is an interval of the
paths below its host. Intervals of prefixes lie within each other or apart. Their begins and ends and
the URLs are sorted together by sampled splitters and swept in order: begins push a rule, ends pop it.
How many rules are open is a running sum; the rule at one place of the stack is the one that was pushed
there last. What is open at the end of a slice is handed to those that follow, as far as it reaches.

The first sweep gives each URL the rule hosts that enclose it; the second, over the paths of each of these
hosts, the longest path that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import pinned

#: Ends a label; sorts before every character that a host can hold. A NUL in a host is read as \x01.
END = "\x00"


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?` or `#`; A-Z in lower case; empty without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(F.replace(host, F.lit(END), F.lit("\x01")), r"\."))


def _key(host: Column) -> Column:
    """Sorts a host next to its subdomains, which lie behind it; the empty rule host encloses all."""
    return F.concat(F.array_join(_labels(host), END), F.lit(END)).cast("binary")


def swept(points: DataFrame, intervals: DataFrame, *, whole_stack: bool) -> DataFrame:
    """Rows of points (key, point) with `rule`: the innermost interval around the key, or one row for each.

    `intervals` has prefix and rule, each prefix once; keys and prefixes are bytes of UTF-8 text. A point that
    no interval holds has one row with a null rule.
    """
    rule_type, point_type = intervals.schema["rule"].dataType, points.schema["point"].dataType
    no_rule, no_point = F.lit(None).cast(rule_type).alias("rule"), F.lit(None).cast(point_type).alias("point")
    begins = intervals.select(F.col("prefix").alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"), "rule", no_point, "prefix")
    # No text holds this byte, so it lies behind all keys that begin with the prefix.
    ends = intervals.select(F.concat("prefix", F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), no_rule, no_point, "prefix")
    places = points.select("key", F.lit(1).alias("kind"), F.lit(0).alias("step"), no_rule, "point", F.lit(None).cast("binary").alias("prefix"))
    dealt = (
        begins.unionByName(ends).unionByName(places).repartitionByRange("key", "kind", F.xxhash64("point"))
        .withColumn("slice", F.spark_partition_id())
    )
    # The slices must stay as they are while several steps read them.
    sliced = pinned(dealt, "sweep")
    # One row per slice, so as many as there are partitions.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    opened = sliced.groupBy("slice").agg(F.sum("step").alias("net")).select("slice", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("open"))
    so_far = F.sum("step").over(Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    placed = sliced.join(F.broadcast(opened), "slice").withColumn("level", (F.col("open") + so_far).cast("int")).drop("open", "step")
    reach = placed.where("kind <> 1").groupBy("prefix").agg(
        F.min_by("level", "kind").alias("level"), F.min_by("slice", "kind").alias("first"), F.max_by("slice", "kind").alias("last"),
        F.first("rule", ignorenulls=True).alias("rule"),
    )
    # As many rows per slice as rules are open where it begins.
    handed = reach.where("last > first").select(
        F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("slice"), "level", F.lit(-1).alias("kind"), F.unhex(F.lit("")).alias("key"), "rule", no_point
    )
    shown = placed.where("kind < 2")
    if whole_stack:
        levels = F.when((F.col("kind") == 1) & (F.col("level") > 0), F.sequence(F.lit(1), F.greatest("level", F.lit(1)))).otherwise(F.array("level"))
        shown = shown.withColumn("level", F.explode(levels))
    stack = Window.partitionBy("slice", "level").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["slice", "level", "kind", "key", "rule", "point"]
    found = shown.select(*columns).unionByName(handed.select(*columns)).withColumn("rule", F.last("rule", ignorenulls=True).over(stack))
    return found.where("kind = 1").select("point", "rule")


def url_verdicts(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict.

    `rules` has host, path and verdict; a rule fits its host and all subdomains where the URL's path
    starts with the rule's. The longest rule (host and path together, then the longer host) wins, and
    among equal rules with different verdicts the verdict that sorts first. Without a rule that fits,
    `rule` is null and the verdict is `default`. A rule with an empty host fits all hosts, one with a null
    host none. A null URL, or one without `://`, has an empty host and path, which no rule fits. Repeated
    pages keep their rows; empty tables give the default for all pages, or no rows.
    """
    urls = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    single = rules.where("host IS NOT NULL").groupBy(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.min("verdict").alias("verdict"))
    hosts = single.select("host").distinct().select(F.when(F.col("host") == "", F.unhex(F.lit(""))).otherwise(_key(F.col("host"))).alias("prefix"), F.struct("host").alias("rule"))
    point = F.struct("row", "page_id", "host", "path")
    # A URL without a host lies in no interval, not even in that of all hosts.
    enclosed = swept(urls.where("host <> ''").select(_key(F.col("host")).alias("key"), point.alias("point")), hosts, whole_stack=True)
    # Written once: one part goes on to the second sweep.
    enclosed = pinned(enclosed, "enclosed")

    def below(host, path):
        return F.concat(F.lpad(F.length(host).cast("string"), 10, "0"), host, path).cast("binary")

    paths = single.select(below(F.col("host"), F.col("path")).alias("prefix"), F.struct("host", "path", "verdict").alias("rule"))
    with_rules = enclosed.where("rule IS NOT NULL")
    fitting = swept(with_rules.select(below(F.col("rule.host"), F.col("point.path")).alias("key"), "point"), paths, whole_stack=False)
    longer = F.struct((F.length("rule.host") + F.length("rule.path")).alias("n"), F.length("rule.host").alias("host"))
    best = fitting.groupBy(F.col("point.row").alias("row")).agg(F.first("point").alias("point"), F.max_by("rule", F.when(F.col("rule").isNotNull(), longer)).alias("rule"))
    alone = enclosed.where("rule IS NULL").select("point.*", "rule").unionByName(
        urls.where("host = ''").withColumn("rule", F.lit(None).cast("struct<host:string>"))
    )
    shown = ["page_id", "host", "path"]
    return best.select(
        *[F.col(f"point.{c}") for c in shown], F.concat("rule.host", "rule.path").alias("rule"), F.coalesce("rule.verdict", F.lit(default)).alias("verdict")
    ).unionByName(alone.select(*shown, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
