"""Exact duplicates by sorting contents.

Rows are range-partitioned by sampled splitters over the first bytes of the normalised text and a
hash of it, sorted, and every row is compared in full with its neighbour: a run of equal neighbours
is a group. A text with more copies than a fraction of a task's fair share is dealt over several
pieces, which lie side by side in the sort order; the heads of its runs, a few rows, are compared in
full once more and joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import partitions, squeezed

#: Bytes of the sort key that a splitter holds at most; the hash behind it parts texts with a common start.
PREFIX = 32
#: A text is dealt out once its copies fill this part of a task's fair share.
SHARE = 0.25


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry=()) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 and the columns of `carry`.

    Texts are equal when they are identical without white space; a null text counts as empty. Of equal
    texts the longest original (code points) stays, then the smallest id; a null id comes last. Of
    repeated rows with one id exactly one is kept. An empty table gives an empty result. `carry` names
    further columns of `docs` to return; they come in a struct `carried`, so that names can't clash.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        (F.struct(*carry) if carry else F.lit(None).cast("int")).alias("carried"),
    )
    share = max(1, int(SHARE * rows.count() / partitions(spark)))
    mark = F.xxhash64(squeezed(F.col("text")))
    # Fewer than partitions / SHARE texts can have so many copies, whatever the input.
    hot = (
        rows.groupBy(mark.alias("mark")).count().where(F.col("count") > share)
        .select("mark", F.ceil(F.col("count") / share).alias("pieces"))
    )
    marked = rows.withColumn("mark", mark).join(F.broadcast(hot), "mark", "left")
    dealt = marked.select(
        "*",
        F.substring(squeezed(F.col("text")), 1, PREFIX).alias("start"),
        F.when(
            F.col("pieces").isNotNull(),
            F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("pieces")),
        ).otherwise(0).alias("piece"),
    ).repartitionByRange("start", "mark", "piece")

    run = Window.partitionBy("start", "mark", "piece", "body").orderBy(F.desc("n_points"), F.asc_nulls_last("doc_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (
        dealt.withColumn("body", squeezed(F.col("text"))).withColumn("n_points", F.length(F.coalesce("text", F.lit(""))))
        .select(
            "*",
            F.row_number().over(run).alias("place"),
            F.first("doc_id").over(whole).alias("head"),
            F.count(F.lit(1)).over(whole).alias("copies"),
        )
        # Never null, so that no filter for a join on it makes the two readers of the sorted rows differ.
        .withColumn("text_sha256", F.coalesce(F.sha2("body", 256), F.lit("")))
    )
    rank = F.struct(
        (-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"),
        F.col("piece").alias("d"),
    )
    # Heads of the pieces of the same text, compared in full: less than 2 * partitions / SHARE rows.
    joined = (
        runs.where((F.col("place") == 1) & F.col("pieces").isNotNull()).groupBy("body", "text_sha256")
        .agg(F.min(rank).alias("best"), F.sum("copies").alias("all_copies"))
        .select("text_sha256", F.col("best.c").alias("best_id"), F.col("best.d").alias("best_piece"), "all_copies")
    )
    of_pieces = F.col("pieces").isNotNull()
    return (
        runs.drop("body").join(F.broadcast(joined), "text_sha256", "left")
        .select(
            "doc_id",
            F.when(of_pieces, F.col("best_id")).otherwise(F.col("head")).alias("keep_id"),
            F.when(of_pieces, F.col("all_copies")).otherwise(F.col("copies")).alias("group_size"),
            ((F.col("place") == 1) & (~of_pieces | (F.col("piece") == F.col("best_piece")))).alias("kept"),
            "text_sha256",
            *(["text", "carried"] if carry else []),
        )
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with the columns of `docs`."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    sorted_rows = content_sort(docs, id_col, text_col, others or [F.lit(None).alias("none")])
    back = {id_col: "doc_id", text_col: "text"}
    return sorted_rows.where("kept").select(
        *(F.col(back.get(c, f"carried.`{c}`")).alias(c) for c in docs.columns)
    )
