"""Mixing sources to target weights by a splitting tree.

Every source gets a target in words. What goes beyond whole copies of the source is an exact quota of
blocks, which a binary tree splits among leaves: at each node the left half's share is a hypergeometric
draw from the blocks below, so the leaves' quotas are one multivariate hypergeometric draw and add up
to the source's quota. A leaf draws disjoint blocks in a permuted order, up to its quota, and passes over
documents that don't fit. The source's rest is filled with the largest that fit of the documents behind
the leaves' ends, and what is left then with the largest that fit of all, until none does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import WORD, pinned

#: Documents that a leaf holds on average, leaves of a source at most, and blocks of a source at least.
LEAF_DOCS, MOST_LEAVES, LEAST_BLOCKS = 256, 1 << 16, 1 << 16
#: Bins whose order is permuted within a leaf.
BINS = 16
#: Documents per source that are tried first for its rest, at least.
SETTLERS = 64


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _log_factorial(x: Column) -> Column:
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(16)))
    y = F.greatest(x.cast("double"), F.lit(1.0))
    series = y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + 1 / (12 * y) - 1 / (360 * y * y * y)
    return F.when(x < 16, F.get(small, x.cast("int"))).otherwise(series)


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hypergeometric(left: Column, right: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` balls come from `left`, others from `right`: the quantile of `u`."""
    def known(left, right, drawn, u):
        both = left + right
        low, high = F.greatest(F.lit(0), drawn - right), F.least(left, drawn)
        share = left / F.greatest(both, F.lit(1))
        spread = F.sqrt(F.greatest(drawn * share * (1 - share) * (both - drawn) / F.greatest(both - 1, F.lit(1)), F.lit(0.0)))
        first = F.greatest(low, F.floor(drawn * share - 10 * spread - 5))
        last = F.least(high, F.ceil(drawn * share + 10 * spread + 5))
        choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        begin = F.exp(choose(left, first) + choose(right, drawn - first) - choose(both, drawn))

        def step(state, k):
            total = state["total"] + state["p"]
            return F.struct(
                (state["p"] * (left - k) * (drawn - k) / ((k + 1) * F.greatest(right - drawn + k + 1, F.lit(1)))).alias("p"),
                total.alias("total"),
                (state["n"] + F.when(total < u, 1).otherwise(0)).cast("long").alias("n"),
            )

        start = F.struct(begin.alias("p"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"))
        passed = F.aggregate(F.sequence(first, last), start, step, lambda state: state["n"])
        return F.least(first + passed, last)

    # A one-element array gives each argument a name, so that none is evaluated again at each step.
    given = F.array(F.struct(left.alias("l"), right.alias("r"), drawn.alias("d"), u.alias("u")))
    return F.transform(given, lambda g: known(g["l"], g["r"], g["d"], g["u"]))[0]


def targets(sizes: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """Adds `target` to one row per source (`key` sorts the sources, `source_size` is its size).

    Weights repeat in the order of the keys. A target ends at `most` times the source's size; what is
    above goes to the others by weight: all that are not full reach the same level of words per weight.
    """
    # One row per source.
    order = Window.orderBy("key")
    weighted = sizes.withColumn(
        "weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights))
    ).withColumn("cap", F.col("source_size") * most)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    leveled = weighted.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest),
    )
    open_level = F.min_by(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")),
                          F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("cap") / F.col("weight")))
    return (
        leveled.withColumn("level", open_level.over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
        .drop("cap", "level")
    )


def _split_quota(prefix: Column, depth: Column, quota: Column, key: Column, seed: int) -> Column:
    """Leaf quotas of one source; `prefix` holds the running block counts of its leaves, from 0 on."""
    def below(quotas, level):
        width = F.pow(F.lit(2.0), depth - level).cast("int")
        at = lambda i: F.get(prefix, (i * width).cast("int"))

        def halves(q, i):
            left = hypergeometric(
                at(2 * i + 1) - at(2 * i), at(2 * i + 2) - at(2 * i + 1), q, _uniform(F.lit(seed), key, level, i)
            )
            return F.transform(F.array(left), lambda x: F.struct(x.alias("x"), (q - x).alias("y")))[0]

        split = F.transform(quotas, halves)
        return F.flatten(F.transform(split, lambda s: F.array(s["x"], s["y"])))

    levels = F.when(depth > 0, F.sequence(F.lit(1), F.greatest(depth, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, F.array(quota), below)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows in the permuted order of their leaf: `place` from 1, and whether a row `fits` the leaf's goal.

    Rows longer than the goal are passed over; so are, in a second run, those longer than what the first one left.
    """
    line = Window.partitionBy("key", "leaf").orderBy(
        F.xxhash64(F.lit(1), F.pmod(F.col("draw"), F.lit(BINS)), "leaf"), F.xxhash64(F.lit(2), "draw"), "doc_id"
    )
    up_to, whole = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = lambda fits, over: F.coalesce(F.sum(F.when(fits, F.col("size"))).over(over), F.lit(0))
    short = F.col("size") <= F.col("goal")
    again = ~F.col("first") & (F.col("size") <= F.col("over"))
    return (
        rows.withColumn("place", F.row_number().over(line))
        .withColumn("first", short & (words(short, up_to) <= F.col("goal")))
        .withColumn("over", F.col("goal") - words(F.col("first"), whole))
        .withColumn("fits", F.col("first") | (again & (words(again, up_to) <= F.col("over"))))
        .drop("first", "over")
    )


def _filled(undrawn: DataFrame, left: DataFrame) -> DataFrame:
    """(key, leaf, place) of the undrawn rows that fill what is `left` of each source: the largest that fit, until none fits."""
    fitting = undrawn.join(left, "key").where((F.col("size") > 0) & (F.col("size") <= F.col("left"))).drop("left")
    counted = fitting.groupBy("key", "size", "leaf").agg(F.count(F.lit(1)).alias("n"))
    # One entry per source and size.
    sizes = (
        counted.groupBy("key", "size").agg(F.sum("n").alias("n"))
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes")).join(left, "key")
    )

    def take(s, x):
        n = F.least(x["n"], F.floor(s["left"] / x["size"]))
        return F.when(
            x["size"] <= s["left"],
            F.struct((s["left"] - n * x["size"]).alias("left"), F.concat(s["got"], F.array(F.struct(x["size"].alias("size"), n.alias("take")))).alias("got")),
        ).otherwise(s)

    start = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<size:bigint,take:bigint>>").alias("got"))
    takes = sizes.select("key", F.explode(F.aggregate("sizes", start, take, lambda s: s["got"])).alias("got")).select("key", "got.size", "got.take")
    before = Window.partitionBy("key", "size").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    per_leaf = (
        counted.join(takes, ["key", "size"])
        .withColumn("take", F.least("n", F.col("take") - F.coalesce(F.sum("n").over(before), F.lit(0))))
        .where("take > 0").select("key", "size", "leaf", "take")
    )
    rank = F.row_number().over(Window.partitionBy("key", "leaf", "size").orderBy("place"))
    return fitting.join(per_leaf, ["key", "size", "leaf"]).withColumn("rank", rank).where("rank <= take").select("key", "leaf", "place")


def mix_plan(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: int = 42, carry=(), id_col="doc_id", text_col="text",
             source_col="source") -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, copies, taken and the struct `carried`.

    `size` counts the words of the text (null: none). Sources are ordered by code point, a null source
    last; `target` is the words that the source should give, and `taken` is `copies` times the size, so
    that a source's taken words miss its target by less than its smallest document not drawn. Drawing
    depends on the id, the text and the seed alone, so reruns agree. Null ids and repeated rows are
    documents like others. A text without words has nothing to take; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.concat(F.when(F.col(source_col).isNull(), "1").otherwise("0"), F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("key"),
        n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col)).alias("draw"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    narrow = pinned(rows.select("doc_id", "key", "size", "draw"), "mix-sizes")
    depth = F.greatest(F.lit(0), F.least(F.lit(int(math.log2(MOST_LEAVES))), F.round(F.log2(F.col("n_docs") / LEAF_DOCS)).cast("int")))
    sources = pinned(
        targets(narrow.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("depth", depth)
        .withColumn("leaves", F.pow(F.lit(2.0), "depth").cast("int"))
        .withColumn("block", F.greatest(F.lit(1), F.floor(F.col("source_size") / F.greatest(F.lit(LEAST_BLOCKS), 16 * F.col("leaves"))))),
        "mix-sources",
    )
    of_source = sources.select("key", "source_size", "target", "whole", "leaves")
    # No hint: Spark broadcasts the sources only if they turn out to be small.
    leaf = F.pmod(F.xxhash64(F.lit(3), "draw"), F.col("leaves")).cast("int")
    in_leaves = lambda frame: frame.join(of_source, "key").withColumn("leaf", leaf)

    per_leaf = (
        in_leaves(narrow).groupBy("key", "leaf").agg(F.sum("size").alias("words"))
        .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "words"))).alias("words"))
    )
    quotas = (
        per_leaf.join(sources, "key")
        .withColumn("words", F.transform(F.sequence(F.lit(0), F.col("leaves") - 1), lambda i: F.coalesce(F.col("words")[i], F.lit(0))))
        .withColumn("blocks", F.transform("words", lambda w: F.ceil(w / F.col("block"))))
        .withColumn("prefix", F.aggregate("blocks", F.array(F.lit(0).cast("long")), lambda out, b: F.concat(out, F.array(F.element_at(out, -1) + b))))
        .withColumn(
            "quota",
            F.when(F.col("source_size") > 0, F.round(F.element_at("prefix", -1) * F.col("rest") / F.col("source_size"))).otherwise(0).cast("long"),
        )
        .withColumn("split", _split_quota(F.col("prefix"), F.col("depth"), F.col("quota"), F.col("key"), seed))
        .select("key", "rest", "leaves", F.posexplode(F.arrays_zip("words", "blocks", "split")).alias("leaf", "of"))
        .select("key", "rest", "leaves", "leaf", F.when(F.col("of.blocks") > 0, F.col("of.split") * F.col("of.words") / F.col("of.blocks")).otherwise(0.0).alias("goal"))
    )
    quotas = pinned(quotas, "mix-quotas")
    goals = quotas.select("key", "leaf", "goal")
    placed = _placed(in_leaves(narrow).join(goals, ["key", "leaf"]))
    placed = pinned(placed, "mix-placed")
    ends = placed.groupBy("key", "leaf").agg(
        F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).alias("drawn"),
        F.coalesce(F.max(F.when(F.col("fits"), F.col("place"))), F.lit(0)).alias("last"),
    )
    left = ends.groupBy("key").agg(F.sum("drawn").alias("drawn")).join(sources.select("key", "rest"), "key").select(
        "key", F.floor(F.col("rest") - F.col("drawn")).alias("left")
    )
    next_ones = (
        placed.where(~F.col("fits") & (F.col("size") > 0)).join(ends.select("key", "leaf", "last"), ["key", "leaf"])
        .where((F.col("place") - F.col("last")).between(1, F.ceil(F.lit(SETTLERS) / F.col("leaves"))))
        # As many rows per source as it has leaves, or SETTLERS.
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("size", "draw", "leaf", "place")), asc=False).alias("next"))
        .join(left, "key")
    )
    start = lambda: F.struct(F.col("left"), F.array().cast("array<struct<leaf:int,place:int>>").alias("got"))
    settled = F.aggregate(
        "next", start(),
        lambda s, x: F.when(
            x["size"] <= s["left"],
            F.struct((s["left"] - x["size"]).alias("left"), F.concat(s["got"], F.array(F.struct(x["leaf"], x["place"]))).alias("got")),
        ).otherwise(s),
        lambda s: s["got"],
    )
    near = pinned(next_ones.select("key", F.explode(settled).alias("got")).select("key", "got.leaf", "got.place"), "mix-settled")
    undrawn = placed.where(~F.col("fits")).select("key", "leaf", "place", "size")
    got = undrawn.join(near, ["key", "leaf", "place"]).groupBy("key").agg(F.sum("size").alias("got"))
    still = left.join(got, "key", "left").select("key", (F.col("left") - F.coalesce("got", F.lit(0))).alias("left"))
    others = undrawn.join(near, ["key", "leaf", "place"], "left_anti")
    picked = pinned(near.union(_filled(others, pinned(still, "mix-left"))).withColumn("picked", F.lit(1)), "mix-filled")
    full = placed if not carry else _placed(in_leaves(rows).join(goals, ["key", "leaf"]))
    return (
        full.join(picked, ["key", "leaf", "place"], "left")
        .withColumn("copies", F.col("whole") + F.when(F.col("fits") | F.col("picked").isNotNull(), 1).otherwise(0))
        .withColumn("copies", F.least("copies", F.lit(most)))
        .select(
            "doc_id", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"),
            (F.col("copies") * F.col("size")).cast("long").alias("taken"), "draw", *(["carried"] if carry else []),
        )
    )


def mixture(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, shuffled within each task.

    A document without words is taken once, as there is nothing to weigh.
    """
    plan = mix_plan(docs, weights, most, seed, carry=list(docs.columns))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    return (
        plan.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
        .withColumn("turn", F.xxhash64(F.lit(seed), "draw", "copy")).sortWithinPartitions("turn").select("carried.*")
    )
