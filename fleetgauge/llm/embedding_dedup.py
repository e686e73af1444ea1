"""Near copies of embeddings by cross-polytope hashing.

A hash is the nearest corner of the cross-polytope after three fast Hadamard rotations with random
signs; several make a bucket of one table. Each vector also probes the buckets that its next-best
corners give. Equal vectors collapse first. Vectors that share a bucket are compared in double
precision; a pair counts where it meets first, and a bucket gives each vector's number of links and a
tree for each group, never its pairs. Buckets that fill more than a tile are cut into tiles of two parts.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import pinned
from fleetgauge.llm.components import components

COSINE = 0.98
#: Tables, hashes of a bucket, and buckets that a vector enters in each table. 2 * d corners to the power
#: of HASHES should exceed the vectors of a label; with more hashes, more tables keep the recall.
TABLES, HASHES, PROBES = 6, 3, 4
TILE, SEED = 1024, 10


def _signs(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).choice(np.array([-1.0, 1.0]), (TABLES, HASHES, 3, size))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row."""
    half = 1
    while half < x.shape[-1]:
        y = x.reshape(*x.shape[:-1], -1, 2, half)
        x = np.stack((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-2).reshape(x.shape)
        half *= 2
    return x


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def buckets(vectors: np.ndarray) -> np.ndarray:
    """The PROBES likeliest buckets of each row in each table, as numbers (rows x TABLES x PROBES)."""
    n, d = vectors.shape
    size = max(2, 1 << (d - 1).bit_length())
    unit = np.zeros((n, size))
    unit[:, :d] = _unit(vectors)
    signs = _signs(size)
    out = np.empty((n, TABLES, PROBES), np.int64)
    tops = min(PROBES, 2 * size)
    for t in range(TABLES):
        corners, losses = [], []
        for h in range(HASHES):
            x = unit
            for s in signs[t, h]:
                x = _hadamard(x * s) / np.sqrt(size)
            both = np.concatenate((x, -x), axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :tops]
            best = np.take_along_axis(both, order, axis=1)
            corners.append(order)
            losses.append((best[:, :1] - best) ** 2)
        # All combinations of the leading corners, those that lose least first.
        picks = list(itertools.product(range(tops), repeat=HASHES))
        loss = np.stack([sum(losses[h][:, p[h]] for h in range(HASHES)) for p in picks], axis=1)
        chosen = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        number = np.zeros((n, len(picks)), np.int64)
        for h in range(HASHES):
            number = number * (2 * size) + corners[h][:, [p[h] for p in picks]]
        out[:, t, :] = np.take_along_axis(number, chosen, axis=1)
    return out


def _codes(batches):
    """(rep, space, codes) of every vector; vectors of any length may lie in a batch."""
    for batch in batches:
        lists = batch.column(2)
        values, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())
        starts = np.concatenate(([0], np.cumsum(sizes)))
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            found = buckets(values[starts[rows][:, None] + np.arange(size)]).reshape(-1)
            ends = pa.array(np.arange(0, len(found) + 1, TABLES * PROBES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(found))],
                ["rep", "space", "codes"],
            )


def _shared_before(a: np.ndarray, b: np.ndarray, slot: int, code: int) -> np.ndarray:
    """Whether pairs with these buckets (pairs x TABLES * PROBES) meet in an earlier bucket than this one."""
    early = np.zeros(len(a), bool)
    for t in range(slot + 1):
        own = slice(t * PROBES, (t + 1) * PROBES)
        same = a[:, own][:, :, None] == b[:, own][:, None, :]
        if t == slot:
            same &= (a[:, own] < code)[:, :, None]
        early |= same.any(axis=(1, 2))
    return early


def _compare(reps, many, vectors, codes, slot, code, parts, cosine):
    """Links of one tile: weighted counts per vector, and a tree per group, as (rep, links, parent)."""
    unit = _unit(vectors)
    n = len(reps)
    links, parent = np.zeros(n, np.int64), np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for begin in range(0, n, 256):
        block = slice(begin, min(n, begin + 256))
        near = unit[block] @ unit.T >= cosine
        near &= np.arange(n)[None, :] > np.arange(begin, block.stop)[:, None]
        if parts is not None:
            near &= parts[block][:, None] != parts[None, :]
        i, j = np.nonzero(near)
        i += begin
        for cut in range(0, len(i), 1 << 14):
            a, b = i[cut : cut + (1 << 14)], j[cut : cut + (1 << 14)]
            first = ~_shared_before(codes[a], codes[b], slot, code)
            a, b = a[first], b[first]
            np.add.at(links, a, many[b])
            np.add.at(links, b, many[a])
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    some = np.flatnonzero(links)
    roots = np.array([root(x) for x in some.tolist()], np.int64)
    return reps[some], links[some], reps[roots] if len(some) else reps[some]


def _tiles(cosine):
    def run(batches):
        held = None
        keys = ("bucket", "first", "second")

        def finish(tile, tables):
            table = pa.concat_tables(tables).combine_chunks()
            reps, many = table["rep"].to_numpy(), table["many"].to_numpy()
            lists = lambda name: np.array(table[name].combine_chunks().flatten()).reshape(len(reps), -1)
            parts = table["part"].to_numpy() if tile[1] != tile[2] else None
            code = table["code"][0].as_py()
            rows = _compare(reps, many, lists("embedding").astype(np.float64), lists("codes"), table["slot"][0].as_py(), code, parts, cosine)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["rep", "links", "parent"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                tile = tuple(int(c[s]) for c in columns)
                if held and held[0] != tile:
                    yield finish(*held)
                    held = None
                held = held or (tile, [])
                held[1].append(pa.Table.from_batches([batch.slice(s, e - s)]))
        if held:
            yield finish(*held)

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col="vec_id", vec_col="embedding", label_col="label") -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Vectors link within one label (not null) and one length at a cosine of `cosine` or more, in double
    precision. A vector that is null, empty or zero, or that holds null or non-finite components, links
    with nothing, nor does one without an id: n_links 0 and its own id as component. Repeated rows are
    vectors of their own that link with each other; rows that share an id share a component. An empty
    table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False),
    )
    node = F.xxhash64("label", "embedding")
    # One row per distinct vector of a label; those of one label and length share a space.
    reps = pinned(
        rows.where(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("many"))
        .select(node.alias("rep"), F.xxhash64("label", F.size("embedding")).alias("space"), "embedding", "least", "many"),
        "vectors",
    )
    codes = pinned(reps.select("rep", "space", "embedding").mapInArrow(_codes, "rep long, space long, codes array<long>"), "vector-codes")
    entered = codes.select("rep", "space", F.posexplode("codes").alias("at", "code")).select(
        "rep", F.floor(F.col("at") / PROBES).cast("int").alias("slot"), "code", F.xxhash64("space", F.floor(F.col("at") / PROBES), "code").alias("bucket")
    )
    # Most vectors are alone in their buckets; the others go on.
    sizes = entered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = pinned(entered.join(sizes, "bucket").select("bucket", "n", "rep", "slot", "code"), "vector-buckets")
    tiles = (
        met.withColumn("parts", F.when(F.col("n") > TILE, F.ceil(F.col("n") / (TILE // 2))).otherwise(1).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("bucket", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "rep", "slot", "code")
        .join(codes.select("rep", "codes"), "rep").join(reps.select("rep", "embedding", "many"), "rep")
    )
    order = ["bucket", "first", "second"]
    found = pinned(
        tiles.repartition(*order).sortWithinPartitions(*order).mapInArrow(_tiles(cosine), "rep long, links long, parent long"),
        "vector-links",
    )
    roots = components(found.select(F.col("rep").alias("a"), F.col("parent").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.select("rep", "least", "many").join(counted, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "least", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(smallest, "root").select("rep", "n_links", "component_id")
    return (
        rows.select("vec_id", F.when(sound, node).alias("rep")).join(known, "rep", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
    )
