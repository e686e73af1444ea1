"""Connected components of links by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import drop_folder, shared_folder


def _stars(links: DataFrame) -> DataFrame:
    """One round on links (a > b): larger neighbours go to the least one around b, then all of a's to a's least."""
    # The least neighbour counts where it is less than the node itself, so only nodes that have one go into the join.
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
    joined = links.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    # Dealt by `a` once, for the distinct rows, the least of each node and the join of both.
    large = joined.repartition("a").distinct()
    root = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(root, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(root).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in `links` (columns a and b, long) but the roots: the least node reachable.

    Loops and repeated links do no harm; nulls are left out; without links there are no rows.
    """
    spark = links.sparkSession
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    before, seen = None, None
    while True:
        path = shared_folder(spark, "links")
        now.write.parquet(path)
        now = spark.read.schema("a long, b long").parquet(path)
        if before:
            drop_folder(spark, before)
        print_of = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if print_of["n"] == 0 or print_of == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, seen, now = path, print_of, _stars(now)
