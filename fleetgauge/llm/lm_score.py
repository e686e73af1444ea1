"""Texts scored by a bigram model that lies in an Elias-Fano trie.

Words are counted over all training texts, then pairs of neighbours.
The trie has two levels, in shards that single tasks write to the shared folder and every scorer maps:
words as an Elias-Fano sequence of their hashes, with counts, quantised back-off weights and monotone
pointers; and their successors as an Elias-Fano sequence, with quantised probabilities. Words are
numbered in the order of their hashes, so the successors of a context are spread evenly: one is looked
for where its number leads among the places that the context's pointers delimit.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import crc_of_id, partitions, pinned, shared_folder
from fleetgauge.llm.elias_fano import EliasFano
from fleetgauge.llm.storage import arrays, create, new_name

#: Least count of a pair in the model (1: all pairs), and what is taken off each count for pairs unseen.
LEAST, DISCOUNT = 1, 0.6
#: Bits of a stored probability; tokens whose pairs are looked up together; counts that are summed up before they are
#: handed on; bytes of text split at a time; distinct words that are hashed and looked up at a time.
BITS, TOGETHER, COUNTED, STRETCH, REMEMBERED = 16, 1 << 19, 1 << 21, 1 << 21, 1 << 18
#: Marks that no word can be: they hold white space.
START, END = b"\t", b"\n"
KEY_BITS = 63


def word_keys(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)).astype(np.int64)


START_KEY, END_KEY = (xxhash.xxh64_intdigest(mark) >> 1 for mark in (START, END))


def _stretches(texts: pa.Array):
    """Texts of about STRETCH bytes together, or a part of one longer text; the first one's number, whether the last one ends."""
    upto, begin = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while begin < len(texts):
        end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + STRETCH, "right"))
        if end > begin:
            yield texts.slice(begin, end - begin), begin, True
        else:
            raw, at, end = texts[begin].as_py().encode("utf-8"), 0, begin + 1
            while cut := SPACE.search(raw, at + STRETCH):
                yield pa.array([raw[at : cut.start()].decode("utf-8")]), begin, False
                at = cut.end()
            yield pa.array([raw[at:].decode("utf-8")]), begin, True
        begin = end


def token_chunks(texts: pa.Array):
    """Words of whole texts in order, END after each text, in chunks: the distinct words with END last, each
    token's place among them, and its text's number."""
    for some, first, ended in _stretches(pc.fill_null(texts, "")):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(some))
        coded, numbers = lists.flatten().dictionary_encode(), np.repeat(np.arange(len(some)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        distinct, line = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64)
        if b"" in distinct:
            words = line != distinct.index(b"")
            line, numbers = line[words], numbers[words]
        if ended:
            ends = np.searchsorted(numbers, np.arange(len(some)), "right")
            line, numbers = np.insert(line, ends, len(distinct)), np.insert(numbers, ends, np.arange(len(some)))
        distinct.append(END)
        for at in range(0, len(line), TOGETHER):
            yield distinct, line[at : at + TOGETHER], first + numbers[at : at + TOGETHER]


SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Tally:
    """Counts of long keys, summed up before they are handed on."""

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None):
        self.held.append((keys, np.ones(len(keys), np.int64) if counts is None else counts))
        self.n += len(keys)

    def out(self):
        if self.n:
            keys, at = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in self.held])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
        self.held, self.n = [], 0


def _count_words(batches):
    tally = Tally()
    for batch in batches:
        for distinct, line, _ in token_chunks(batch.column(0)):
            times = np.bincount(line, minlength=len(distinct))
            met = np.flatnonzero(times)
            tally.add(np.append(word_keys(distinct)[met], START_KEY), np.append(times[met], times[-1]))
            if tally.n >= COUNTED:
                yield from tally.out()
    yield from tally.out()


def store(folder: str, stem: str, parts: dict[str, np.ndarray]) -> str:
    """Writes arrays to one new file; returns where they lie in it."""
    uri, layout, at = new_name(folder, stem), {}, 0
    with create(uri) as file:
        for name, array in parts.items():
            raw = np.ascontiguousarray(array).tobytes()
            layout[name] = [array.dtype.str, at, len(array)]
            raw += bytes(-len(raw) % 8)
            file.write(raw)
            at += len(raw)
    return json.dumps({"uri": uri, "layout": layout})


def load(stored: str) -> dict[str, np.ndarray]:
    spec = json.loads(stored)
    return arrays(spec["uri"], spec["layout"])


def sequence(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
    made = EliasFano.build(values, universe)
    shape = np.array([made.n, made.width], np.int64)
    return {f"{name}.{k}": v for k, v in zip(("shape", "low", "high", "ones", "zeros"), [shape, *made.parts()])}


def opened(parts: dict[str, np.ndarray], name: str) -> EliasFano:
    n, width = parts[f"{name}.shape"].tolist()
    return EliasFano(n, width, *(parts[f"{name}.{k}"] for k in ("low", "high", "ones", "zeros")))


def quantised(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
    step = (high - low) / ((1 << BITS) - 1) or 1.0
    return {f"{name}.codes": np.round((values - low) / step).astype(np.uint16), f"{name}.scale": np.array([low, step])}


def restored(parts: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    low, step = parts[f"{name}.scale"].tolist()
    return low + step * parts[f"{name}.codes"][at]


@dataclass
class Model:
    """What a scorer needs besides the mapped files: totals and where the shards are."""

    tokens: int
    distinct: int
    shard_bits: int
    room: int  # ids of a shard of words
    words: dict[int, str]
    pointers: dict[int, tuple[int, str]]  # first place of the shard's successors, file
    weights: dict[int, str]
    successors: list[tuple[int, int, str]]  # first place, its word, file


def grouped(numbers: np.ndarray):
    """Each number with the places where it stands."""
    order = np.argsort(numbers, kind="stable")
    each, starts = np.unique(numbers[order], return_index=True)
    return zip(each.tolist(), np.split(order, starts[1:]))


class Trie:
    def __init__(self, spec: dict):
        self.m = Model(**spec)
        self.files: dict[str, tuple[dict, EliasFano | None]] = {}
        self.first_places, self.first_words = (np.array([s[k] for s in self.m.successors], np.int64) for k in (0, 1))
        self.ids = self.m.room << self.m.shard_bits

    def file(self, stored: str, name: str | None):
        if stored not in self.files:
            parts = load(stored)
            self.files[stored] = parts, opened(parts, name) if name else None
        return self.files[stored]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and training counts of word keys."""
        ids, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        below = KEY_BITS - self.m.shard_bits
        for shard, own in grouped(keys >> below):
            if shard in self.m.words:
                parts, hashes = self.file(self.m.words[shard], "hash")
                at = hashes.find(keys[own] & ((1 << below) - 1))
                known = at >= 0
                ids[own[known]] = shard * self.m.room + at[known]
                counts[own[known]] = parts["counts"][at[known]]
        return ids, counts

    def _by_shard(self, ids: np.ndarray, files: dict):
        for shard, own in grouped(np.where(ids >= 0, ids // self.m.room if self.m.room else -1, -1)):
            if shard in files:
                yield files[shard], own, ids[own] - shard * self.m.room

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for stored, own, at in self._by_shard(ids, self.m.words):
            out[own] = self.file(stored, "hash")[0]["counts"][at]
        return out

    def children(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of context ids: the place of the first successor, and how many there are."""
        begin, many = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for (first, stored), own, at in self._by_shard(ids, self.m.pointers):
            here, after = self.file(stored, "pointer")[1].access_two(at)
            begin[own], many[own] = first + here.astype(np.int64), (after - here).astype(np.int64)
        return begin, many

    def weight(self, ids: np.ndarray) -> np.ndarray:
        """log10 back-off weight of context ids; without successors 0."""
        out = np.zeros(len(ids))
        for stored, own, at in self._by_shard(ids, self.m.weights):
            out[own] = restored(self.file(stored, None)[0], "weight", at)
        return out

    def likely_place(self, ids: np.ndarray, begin: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Where among the places of its context an evenly spread successor lies; it rises with the id."""
        return begin + np.minimum((ids * (many / self.ids)).astype(np.int64), many - 1)

    def value(self, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """What the sequence of successors holds: the likely place, then the id."""
        return (place << (self.ids - 1).bit_length()) | ids

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.m.tokens + 0.5 * (self.m.distinct + 1)))

    def bigram(self, before: np.ndarray, ids: np.ndarray, base: np.ndarray) -> np.ndarray:
        """log10 probability of each id behind the id before it; `base` is what is backed off to."""
        contexts, c = np.unique(before, return_inverse=True)
        words, w = np.unique(ids, return_inverse=True)
        return self.paired(contexts, c, words, w, base)

    def paired(self, contexts: np.ndarray, c: np.ndarray, words: np.ndarray, w: np.ndarray, base: np.ndarray) -> np.ndarray:
        """As `bigram`, of words[w] behind contexts[c]; equal pairs are looked up once, in the order of the contexts given."""
        begin, many = self.children(contexts)
        out = self.weight(contexts)[c] + base
        asked = np.flatnonzero((many > 0)[c] & (words >= 0)[w])
        if not len(asked):
            return out
        keys, back = np.unique(c[asked] * len(words) + w[asked], return_inverse=True)
        at_context, at_word = np.divmod(keys, len(words))
        ids = words[at_word]
        places = self.likely_place(ids, begin[at_context], many[at_context])
        found = np.full(len(keys), np.nan)
        for shard, own in self._holders(places, ids):
            parts, line = self.file(self.m.successors[shard][2], "line")
            first, last = parts["places"].tolist()
            own = own[places[own] <= last]
            at = line.find(self.value(places[own] - first, ids[own]))
            found[own[at >= 0]] = restored(parts, "probability", at[at >= 0])
        score = found[back]
        out[asked] = np.where(np.isnan(score), out[asked], score)
        return out

    def _holders(self, places: np.ndarray, ids: np.ndarray):
        """The parts of the successors, each with those of the questions that it would hold."""
        part = np.searchsorted(self.first_places, places, "right") - 1
        while True:
            # Equal places belong to one context; they may lie in several parts, in the order of the words.
            early = (part >= 0) & (self.first_places[part] == places) & (ids < self.first_words[part])
            if not early.any():
                break
            part -= early
        yield from ((number, own) for number, own in grouped(part) if number >= 0)


class Line:
    """The tokens of a chunk, by the ids of its distinct words, and the token before each one."""

    def __init__(self, trie: Trie, distinct: list[bytes], line: np.ndarray, before: int, start: int):
        ids, counts = (np.concatenate(x) for x in zip(*(
            trie.look_up(word_keys(distinct[at : at + REMEMBERED])) for at in range(0, len(distinct), REMEMBERED)
        )))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        #: Ids and counts of the words, by id; each token's word; the tokens that end a text.
        self.words, self.counts = ids[order], counts[order]
        self.token, self.ends = rank[line], line == len(distinct) - 1
        #: Ids of what tokens stand behind: the words, then the start of a text, then what ended the chunk before.
        self.contexts = np.concatenate((self.words, [start, before]))
        behind = np.where(self.ends, len(order), self.token)
        self.behind = np.concatenate(([len(order) + 1], behind[:-1]))
        #: What the next chunk stands behind.
        self.last = int(self.contexts[behind[-1]])


def _sorted_runs(batches, columns: list[str]):
    """All rows of each run of the first column, as arrays; rows arrive sorted."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        cuts = [0, *(np.flatnonzero(arrays[0][1:] != arrays[0][:-1]) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if held and arrays[0][s] != now:
                yield int(now), [np.concatenate(x) for x in zip(*held)]
                held = []
            now = arrays[0][s]
            held.append([a[s:e] for a in arrays[1:]])
    if held:
        yield int(now), [np.concatenate(x) for x in zip(*held)]


def _meta(**columns):
    return pa.RecordBatch.from_pydict({k: [v] for k, v in columns.items()})


def _write_words(folder: str, shard_bits: int):
    def run(batches):
        below = KEY_BITS - shard_bits
        for shard, (keys, counts) in _sorted_runs(batches, ["shard", "key", "n"]):
            kind = np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
            parts = sequence(keys & ((1 << below) - 1), 1 << below, "hash") | {"counts": counts.astype(kind)}
            yield _meta(shard=shard, size=len(keys), stored=store(folder, "words", parts))

    return run


def _count_pairs(spec):
    def run(batches):
        trie = Trie(spec.value)
        (start,), _ = trie.look_up(np.array([START_KEY]))
        for batch in batches:
            before = start
            for distinct, line, _ in token_chunks(batch.column(0)):
                chunk = Line(trie, distinct, line, before, start)
                before = chunk.last
                pairs, n = np.unique(chunk.behind * len(chunk.words) + chunk.token, return_counts=True)
                context, word = np.divmod(pairs, len(chunk.words))
                yield pa.RecordBatch.from_arrays([pa.array(chunk.contexts[context]), pa.array(chunk.words[word]), pa.array(n)], ["context", "word", "n"])

    return run


def _write_successors(spec, folder: str):
    """Writes the successors of this part of the key range; gives the sums of its contexts and one row of its own."""
    def run(batches):
        trie = Trie(spec.value)
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        context, ids, n = (np.concatenate(x) for x in zip(*held))
        start = np.concatenate(([0], np.flatnonzero(context[1:] != context[:-1]) + 1))
        contexts, length = context[start], np.diff(np.append(start, len(context)))
        begin, many = (np.repeat(x, length) for x in trie.children(contexts))
        places = trie.likely_place(ids, begin, many)
        probability = (n - DISCOUNT) / np.repeat(trie.counts(contexts), length)
        below = 10.0 ** trie.unigram(trie.counts(ids))
        universe = trie.value(places[-1] - places[0] + 1, np.int64(0))
        parts = sequence(trie.value(places - places[0], ids), int(universe), "line") | {"places": places[[0, -1]]} | quantised(np.log10(probability), "probability")
        stored, m = store(folder, "successors", parts), len(contexts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(contexts, places[0])), pa.array([None] * m + [ids[0]], pa.int64()),
             pa.array(np.append(np.add.reduceat(probability, start), 0.0)),
             pa.array(np.append(np.add.reduceat(below, start), 0.0)), pa.array([None] * m + [stored], pa.string())],
            ["context", "word", "seen", "below", "stored"],
        )

    return run


def _write_pointers(spec, folder: str):
    def run(batches):
        trie = Trie(spec.value)
        for shard, (contexts, children) in _sorted_runs(batches, ["shard", "context", "children"]):
            counts = np.zeros(trie.file(trie.m.words[shard], "hash")[1].n, np.int64)
            counts[contexts - shard * trie.m.room] = children
            pointers = np.concatenate(([0], np.cumsum(counts)))
            yield _meta(shard=shard, size=int(pointers[-1]), stored=store(folder, "pointers", sequence(pointers, int(pointers[-1]) + 1, "pointer")))

    return run


def _write_weights(spec, folder: str):
    def run(batches):
        trie = Trie(spec.value)
        for shard, (contexts, seen, below) in _sorted_runs(batches, ["shard", "context", "seen", "below"]):
            weight = np.zeros(trie.file(trie.m.words[shard], "hash")[1].n)
            weight[contexts - shard * trie.m.room] = np.log10(np.maximum(1 - seen, 1e-9) / np.maximum(1 - below, 1e-9))
            yield _meta(shard=shard, size=len(weight), stored=store(folder, "weights", quantised(weight, "weight")))

    return run


def train(texts: DataFrame, folder: str) -> dict:
    """Counts `text` of all rows, writes the trie to `folder`, and gives its description: a few values per shard."""
    spark = texts.sparkSession
    tasks = max(1, partitions(spark))
    shard_bits = (tasks - 1).bit_length()
    shard_row = "shard long, size long, stored string"
    lines = texts.select("text")
    words = pinned(lines.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    tokens, distinct = words.where(F.col("key") != START_KEY).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    by_shard = lambda frame: frame.repartition(tasks, "shard")
    written = (
        by_shard(words.withColumn("shard", F.shiftright("key", KEY_BITS - shard_bits)))
        .sortWithinPartitions("shard", "key").mapInArrow(_write_words(folder, shard_bits), shard_row).collect()
    )
    room = max((r["size"] for r in written), default=0)
    spec = Model(tokens, distinct, shard_bits, room, {r["shard"]: r["stored"] for r in written}, {}, {}, []).__dict__
    if not written:
        return spec
    known = spark.sparkContext.broadcast(spec)
    pairs = pinned(
        lines.mapInArrow(_count_pairs(known), "context long, word long, n long").groupBy("context", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST),
        "lm-pairs",
    )
    in_shards = lambda frame: by_shard(frame.withColumn("shard", F.floor(F.col("context") / room))).sortWithinPartitions("shard", "context")
    children = pairs.groupBy("context").agg(F.count(F.lit(1)).alias("children"))
    place = 0
    for r in sorted(in_shards(children).mapInArrow(_write_pointers(known, folder), shard_row).collect(), key=lambda r: r["shard"]):
        spec["pointers"][r["shard"]] = (place, r["stored"])
        place += r["size"]
    known = spark.sparkContext.broadcast(spec)
    sums = pinned(
        pairs.repartitionByRange("context", "word").sortWithinPartitions("context", "word")
        .mapInArrow(_write_successors(known, folder), "context long, word long, seen double, below double, stored string"),
        "lm-contexts",
    )
    # A context's successors may lie in several parts.
    contexts = sums.where("stored IS NULL").groupBy("context").agg(F.sum("seen").alias("seen"), F.sum("below").alias("below"))
    spec["weights"] = {r["shard"]: r["stored"] for r in in_shards(contexts).mapInArrow(_write_weights(known, folder), shard_row).collect()}
    spec["successors"] = [(r["context"], r["word"], r["stored"]) for r in sums.where("stored IS NOT NULL").orderBy("context", "word").collect()]
    return spec


def scored(texts: DataFrame, spec: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of doc_id and text."""
    spec = texts.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        trie = Trie(spec.value)
        (start,), _ = trie.look_up(np.array([START_KEY]))
        for batch in batches:
            n = batch.num_rows
            sums, before = np.zeros((4, n)), start
            for distinct, line, numbers in token_chunks(batch.column(1)):
                chunk = Line(trie, distinct, line, before, start)
                before = chunk.last
                base = trie.unigram(chunk.counts)[chunk.token]
                score = trie.paired(chunk.contexts, chunk.behind, chunk.words, chunk.token, base)
                for row, values in zip(sums, (None, (chunk.counts > 0)[chunk.token], base, score)):
                    row += np.bincount(numbers, values, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3])],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose id's CRC-32 mod 5 is not 1, and scores all; a null text counts as empty and
    is one end token. Scores are log10 probabilities: `base_score` of single tokens with 0.5 added to
    each count, `score` of tokens behind the one before. Without training texts every token is
    unknown and both scores are 0. A null id is neither learned from nor held out; repeated rows are
    kept, and learned from as often; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 1, F.lit(False))
    training = rows.where(F.col("doc_id").isNotNull() & ~held_out)
    spec = train(training, shared_folder(docs.sparkSession, "lm-trie"))
    return scored(rows, spec).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(spec["tokens"]).cast("long").alias("train_tokens"), "base_score", "score"
    )
