"""Near copies by SimHash fingerprints and pivot distance tables.

Equal fingerprints collapse first. Fingerprints within four bits share at least three of seven bit
blocks, so every choice of three blocks brings all such pairs into common buckets. In a bucket the
Hamming distances of its fingerprints to fixed references are tabled; pairs whose distances to any
reference differ by more than four are discarded, and the rest are verified. A bucket gives no pairs,
but a tree for each of its groups. Buckets that fill more than a tile are cut into tiles of two parts.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import pinned
from fleetgauge.llm.components import components

SHINGLE, SEED, NEAR = 4, 42, 4
#: Bits of the blocks, and how many of them a pair within NEAR bits has in common.
BLOCKS, COMMON = (9, 9, 9, 9, 9, 9, 10), 3
REFERENCES, TILE = 16, 4096
#: Shingles whose bits are counted at a time.
STRETCH = 1 << 15


def fingerprint(text: str | None) -> int:
    """Majority bits of the shingles' hashes; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - SHINGLE + 1)].tolist()
    ends = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest, total, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(starts)
    for i in range(0, n, STRETCH):
        packed = b"".join([digest(line[s:e], SEED) for s, e in zip(starts[i : i + STRETCH], ends[i : i + STRETCH])])
        bits = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marked: bool = False) -> DataFrame:
    """doc_id and the fingerprint as a signed long; if `marked`, also `mark`, a hash of the text."""
    more = [F.xxhash64(text_col).alias("mark")] if marked else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), *rest], ["doc_id", "fp", *(["mark"] if rest else [])])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long" + (", mark long" if marked else ""))


def _masks() -> list[int]:
    edges = [0, *itertools.accumulate(BLOCKS)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in itertools.combinations(blocks, COMMON)]


def _references() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, REFERENCES, np.uint64)


def _first_choice(difference: np.ndarray) -> np.ndarray:
    """The first choice of blocks in which a pair agrees: the one that links it, of all where they meet."""
    first = np.full(difference.shape, -1, np.int16)
    for k, mask in reversed(list(enumerate(_masks()))):
        first[(difference & np.uint64(mask)) == 0] = k
    return first


def linked(prints: np.ndarray, choice: int, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Trees over the distinct fingerprints of a bucket that link within NEAR bits and meet in `choice` first.

    With `parts` only links between different parts count.
    """
    table = np.bitwise_count(prints[:, None] ^ _references()[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    parts = None if parts is None else parts[order]
    line, waiting = table[:, 0], np.ones(len(prints), bool)
    children, roots = [], []
    for root in range(len(prints)):
        if not waiting[root]:
            continue
        waiting[root], reached = False, [root]
        while reached:
            x = reached.pop()
            low, high = np.searchsorted(line, line[x] - NEAR), np.searchsorted(line, line[x] + NEAR, "right")
            near = low + np.flatnonzero(waiting[low:high])
            near = near[np.abs(table[near] - table[x]).max(axis=1, initial=0) <= NEAR]
            difference = prints[near] ^ prints[x]
            close = np.bitwise_count(difference) <= NEAR
            near, difference = near[close], difference[close]
            near = near[_first_choice(difference) == choice]
            if parts is not None:
                near = near[parts[near] != parts[x]]
            waiting[near] = False
            reached.extend(near.tolist())
            children.extend(near.tolist())
            roots.extend([root] * len(near))
    return prints[np.array(children, np.int64)], prints[np.array(roots, np.int64)]


def _rows(choice, key, a, b, kind) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, choice, np.int32)), pa.array(np.full(n, key, np.int64)), pa.array(np.asarray(a, np.uint64).view(np.int64)),
         pa.array(np.asarray(b, np.uint64).view(np.int64)), pa.array(np.full(n, kind, np.int32))],
        ["choice", "key", "a", "b", "kind"],
    )


ROWS = "choice int, key long, a long, b long, kind int"


def _sweep(batches):
    """Buckets, one after the other, of rows sorted by choice and key; too large ones are handed on (kind 1)."""
    held, too_large = None, False  # the rows of the last bucket, which may go on

    def bucket(choice, key, prints):
        if len(prints) > 1:
            children, roots = linked(prints, choice)
            if len(children):
                yield _rows(choice, key, children, roots, 0)

    for batch in batches:
        if not batch.num_rows:
            continue
        choice, key, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        prints = prints.view(np.uint64)
        cuts = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        if held is not None and (held[0], held[1]) != (choice[0], key[0]):
            if not too_large:
                yield from bucket(*held)
            held, too_large = None, False
        # Rows alone in their bucket are the most; only the others are looked at, and the last one is held.
        many = ends - starts > 1
        many[0] |= held is not None
        many[-1] = True
        pairs = many & (ends - starts == 2)
        pairs[0] &= held is None
        pairs[-1] = False
        at = starts[pairs]
        if len(at):
            difference = prints[at] ^ prints[at + 1]
            references = _references()
            apart = np.abs(
                np.bitwise_count(prints[at][:, None] ^ references).astype(np.int8) - np.bitwise_count(prints[at + 1][:, None] ^ references).astype(np.int8)
            ).max(axis=1)
            at = at[(apart <= NEAR) & (np.bitwise_count(difference) <= NEAR)]
            at = at[_first_choice(prints[at] ^ prints[at + 1]) == choice[at]]
            if len(at):
                yield _rows(-1, 0, prints[at + 1], prints[at], 0)
        for i in np.flatnonzero(many & ~pairs).tolist():
            own = prints[starts[i] : ends[i]]
            whole = own if held is None else np.concatenate((held[2], own))
            held = (int(choice[starts[i]]), int(key[starts[i]]), whole)
            if too_large or len(whole) > TILE:
                yield _rows(held[0], held[1], whole, whole, 1)
                held, too_large = (held[0], held[1], whole[:0]), True
            if i < len(starts) - 1:
                if not too_large:
                    yield from bucket(*held)
                held, too_large = None, False
    if held is not None and not too_large:
        yield from bucket(*held)


def _tiles(batches):
    """Tiles, one after the other, of rows sorted by tile: (choice, key, first, second, part, print)."""
    held = None
    names = ("choice", "key", "first", "second", "part", "a")

    def tile(t, columns):
        prints = columns[5].view(np.uint64)
        children, roots = linked(prints, t[0], columns[4] if t[2] != t[3] else None)
        if len(children):
            yield _rows(t[0], t[1], children, roots, 0)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns[:4]:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            t, own = tuple(int(c[s]) for c in columns[:4]), [c[s:e] for c in columns]
            if held and held[0] != t:
                yield from tile(*held)
                held = None
            held = (t, own if not held else [np.concatenate(x) for x in zip(held[1], own)])
    if held:
        yield from tile(*held)


def links(prints: DataFrame) -> DataFrame:
    """Trees (a, b) over all links between the distinct fingerprints `fp`."""
    masks = F.array(*(F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for k, m in enumerate(_masks())))
    keyed = prints.select("fp", F.explode(masks).alias("k")).select("k.choice", "k.key", "fp")
    swept = pinned(
        keyed.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_sweep, ROWS), "simhash-links"
    )
    large = swept.where("kind = 1")
    parts = large.groupBy("choice", "key").agg(F.ceil(F.count(F.lit(1)) / (TILE // 2)).cast("int").alias("parts"))
    tiles = (
        large.join(parts, ["choice", "key"])
        .withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("choice", "key", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "a")
    )
    order = ["choice", "key", "first", "second"]
    tiled = tiles.repartition(*order).sortWithinPartitions(*order).mapInArrow(_tiles, ROWS)
    return swept.where("kind = 0").select("a", "b").union(tiled.select("a", "b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Texts are read whole; A-Z lower-cased, shingles of four words, a shorter text is one shingle. A null
    text or one without words has fingerprint zero, which links like any other. Rows with a null id
    link others but name no component; a component of such rows alone has a null id. Repeated rows are
    kept; an empty table gives no rows.
    """
    found = _grouped(pinned(fingerprints(docs, id_col, text_col), "simhash-prints"), F.col("doc_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(prints: DataFrame, name: Column) -> DataFrame:
    """Adds component_id, the smallest name of the rows that links reach."""
    distinct = prints.groupBy("fp").agg(F.min(name).alias("least"))
    found = components(links(distinct.select("fp")))
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # One row per distinct fingerprint; each component's smallest name goes back to its fingerprints.
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with the columns of `docs`: the smallest id of each component, and null ids.

    Rows are told apart by id and text: where an id is repeated, only the row that is a copy goes, and of the
    texts that a component's smallest id has, one stays. Rows equal in both stay or go together.
    """
    name = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))
    found = _grouped(pinned(fingerprints(docs, id_col, text_col, marked=True), "simhash-prints"), name)
    copies = found.where(name != F.col("component_id")).select(F.col("doc_id").alias("_copy_id"), F.col("mark").alias("_copy_mark"))
    return docs.join(copies, (docs[id_col] == copies["_copy_id"]) & (F.xxhash64(docs[text_col]) == copies["_copy_mark"]), "left_anti")
