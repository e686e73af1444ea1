"""Importance resampling towards a target distribution of hashed word sequences.

Runs of one to three words are hashed by CRC-32 into buckets. How much more frequent a bucket is in the
target than in the corpus is its gain; a document weighs the sum over its features, and Gumbel noise on
the weights makes the highest scores a draw without replacement.

Tasks take the CRCs of many features at once: the distinct features of a stretch of text are grouped by
their length into matrices of bytes, one row per feature, and all CRCs of a matrix are carried on column
by column; buckets are then scattered back to the places where the features occur.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import pinned

#: Words in a feature, buckets, seed of the noise, share drawn in hundredths, and words that a document must have.
LONGEST, BUCKETS, SEED, PERCENT, LEAST_WORDS = 3, 10_000, 42, 5, 20
#: Bytes of text whose features are hashed together, about.
STRETCH = 1 << 21
#: Longer features, in bytes, are hashed one by one: a matrix of a few long rows has too many columns.
WIDEST = 192
SPACE, POLYNOMIAL = 32, 0xEDB88320

_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """The CRC of each byte, bytes in lower case, and which bytes belong to words."""
    if not _TABLES:
        crc = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1).astype(np.uint32)
        byte = np.arange(256, dtype=np.uint8)
        lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
        _TABLES.update(crc=crc, lower=lower, word=(lower >= 128) | ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122)))
    return _TABLES


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a matrix of bytes, all rows together, column by column."""
    table = _tables()["crc"]
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = table[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def crcs(stream: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of many slices of a stream of bytes: one matrix per length."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(lengths[order]) != 0, True)) + 1 if len(order) else []
    begin = 0
    for end in ends:
        group, begin = order[begin:end], end
        length = int(lengths[group[0]])
        if length > WIDEST:
            out[group] = [zlib.crc32(stream[s : s + length]) for s in starts[group]]
        else:
            out[group] = crc_matrix(np.lib.stride_tricks.sliding_window_view(stream, length)[starts[group]])
    return out


def _numbered(stream: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words only: words are read as rows of 8-byte integers."""
    numbers, used = np.empty(len(starts), np.int64), 0
    cells = (lengths + 7) // 8
    padded = np.append(stream, np.zeros(8, np.uint8))
    for n in np.unique(cells):
        own = np.flatnonzero(cells == n)
        if n * 8 > WIDEST:
            codes, distinct = pd.factorize(np.array([stream[starts[i] : starts[i] + lengths[i]].tobytes() for i in own], object))
            distinct = len(distinct)
        else:
            codes, distinct = np.zeros(len(own), np.int64), 1
            for cell in range(n):
                at = np.minimum(starts[own] + 8 * cell, len(stream))
                value = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8").ravel()
                # No word holds a zero byte, so zeros behind its end say how long it is.
                behind = (8 * np.maximum(8 * (cell + 1) - lengths[own], 0)).astype(np.uint64)
                value = (value << behind) >> behind
                parts, values = pd.factorize(value)
                codes, seen = pd.factorize(codes * len(values) + parts)
                distinct = len(seen)
        numbers[own], used = codes + used, used + distinct
    return numbers


class _Stretch:
    """The words of a stretch of bytes, and for each n the buckets of the features that end at an own word."""

    def __init__(self, data: np.ndarray, first_of_doc: np.ndarray, own_from: int):
        tables = _tables()
        lower = tables["lower"][data]
        word = tables["word"][data]
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first_of_doc[1:]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first_of_doc[1:]
        self.begin = np.flatnonzero(begins)
        self.lengths = np.flatnonzero(ends) + 1 - self.begin
        self.own = self.begin >= own_from
        # All words with one space behind each.
        self.at = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.stream = np.full(int((self.lengths + 1).sum()), SPACE, np.uint8)
        self.stream[np.cumsum(word)[word] + np.cumsum(begins)[word] - 2] = lower[word]
        self.doc = np.cumsum(first_of_doc)[self.begin]

    def features(self, buckets: int):
        """For each n: the last word of each feature, the number of its distinct feature, and the bucket of each of those."""
        number = _numbered(self.stream, self.at, self.lengths)
        width, codes = int(number.max(initial=0)) + 1, number
        found = []
        for n in range(1, LONGEST + 1):
            last = np.arange(n - 1, len(number))
            if n > 1:
                whole = self.doc[last] == self.doc[last - n + 1]
                joined = codes[:-1] * width + number[n - 1 :]
                codes, _ = pd.factorize(joined)
                last, kept = last[whole & self.own[last]], codes[whole & self.own[last]]
            else:
                last, kept = last[self.own], codes[self.own]
            kept, distinct = pd.factorize(kept)
            one = np.empty(len(distinct), np.int64)
            one[kept[::-1]] = last[::-1]
            found.append((last, kept, one, n))
        starts = np.concatenate([self.at[one - n + 1] for _, _, one, n in found])
        ends = np.concatenate([self.at[one] + self.lengths[one] for _, _, one, _ in found])
        hashed = (crcs(self.stream, starts, ends - starts) % np.uint32(buckets)).astype(np.int64)
        begin = 0
        for last, kept, one, _ in found:
            yield last, kept, hashed[begin : begin + len(one)]
            begin += len(one)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings, and where each row begins; a null is empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def stretches(column: pa.Array):
    """The texts in stretches: each with the row of each of its words. Cut between two words, also within a text.

    A stretch begins with up to two words of the text that the last one ended in, which belong to that one.
    """
    word = _tables()["word"]
    data, offsets = _bytes_of(column)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begin, context = 0, 0
    while begin < len(data):
        end = min(begin + STRETCH, len(data))
        while end < len(data) and not first[end] and word[data[end]]:
            # To the end of the word or of the text.
            ahead = slice(end, end + 4096)
            stops = np.flatnonzero(~word[data[ahead]] | first[:-1][ahead])
            end = end + int(stops[0]) if len(stops) else min(end + 4096, len(data))
        part = _Stretch(data[context:end], first[:-1][context:end], begin - context)
        rows = np.searchsorted(offsets, part.begin + context, "right") - 1
        yield part, rows
        begin = end
        now = part.begin[-(LONGEST - 1) :] + context if LONGEST > 1 and len(part.begin) else []
        # Words of another text are no context.
        text = offsets[np.searchsorted(offsets, end - 1, "right") - 1] if end else 0
        inside = [p for p in now if p >= text]
        context = int(inside[0]) if len(inside) and end < len(data) and not first[end] else end


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of all texts; at most `buckets` rows leave a task."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part, _ in stretches(batch.column(0)):
                for _, kept, hashed in part.features(buckets):
                    # Sums of counts, exact in doubles.
                    total += np.bincount(hashed, np.bincount(kept, minlength=len(hashed)), buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths, from the (bucket, n) of the corpus and of the target."""
    def all_of(counts):
        n = np.zeros(buckets)
        for row in counts.collect():
            n[row["bucket"]] = row["n"]
        return n

    s, t = all_of(corpus), all_of(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of rows of doc_id and text; one gain per bucket reaches the tasks."""
    gain, buckets = docs.sparkSession.sparkContext.broadcast(table), len(table)

    def run(batches):
        for batch in batches:
            words, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for part, rows in stretches(batch.column(1)):
                words += np.bincount(rows[part.own], minlength=batch.num_rows)
                for last, kept, hashed in part.features(buckets):
                    # Features come in the order of the rows: sums from one row's first to the next one's.
                    sums = np.append(0, np.cumsum(gain.value[hashed][kept]))
                    cuts = np.searchsorted(rows[last], np.arange(batch.num_rows + 1))
                    weight += np.diff(sums[cuts])
            features = sum(np.maximum(words - n, 0) for n in range(LONGEST))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long")


def noise(doc_id, seed: int = SEED):
    """Gumbel noise of an id, in thousandths."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds `rank` to rows of doc_id, n_words and score: 1, 2, 3 ... by falling score for the drawn ones, else null.

    Rows are dealt by ranges of the order, so that a rank is the number of rows in the ranges before plus the
    place in its own; no range holds more than its share, however many scores are equal.
    """
    fit = F.col("n_words") >= least_words
    rows = pinned(scored.withColumn("_fit", fit).withColumn("_row", F.monotonically_increasing_id()), "scored")
    order = [F.desc("_fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    dealt = pinned(rows.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "ranges")
    # One row per range.
    sizes = {r["_slice"]: r["n"] for r in dealt.where("_fit").groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = percent * sum(sizes.values()) // 100
    before, last, total = [], -1, 0
    for k in sorted(sizes):
        if total < taken:
            before.append((k, total))
            last = k
        total += sizes[k]
    ahead = dealt.sparkSession.createDataFrame(before, "_slice int, _before long")
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) + F.col("_before")
    ranked = dealt.where(F.col("_slice") <= last).join(F.broadcast(ahead), "_slice").withColumn("rank", F.when(F.col("_fit") & (place <= taken), place))
    rest = dealt.where(F.col("_slice") > last).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").unionByName(rest.select(*scored.columns, "rank"))


def resampled(
    docs: DataFrame, target: DataFrame, id_col="doc_id", text_col="text", target_text_col="text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_features, weight, score, rank, n_words.

    Features are the runs of one to three words of a text in lower case (A-Z only). The `percent` hundredths,
    rounded down, of the documents with `least_words` words or more are drawn, highest scores first, equal
    scores by smaller id. All texts are read whole, those of `docs` twice. A null text has no words and weighs
    0, like an empty one; a null id draws its noise from the empty string and comes last among equal scores;
    repeated rows are rows of their own. Without target texts, or without documents, counts are zero and the
    formula holds; an empty table of documents gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(rows, "text", buckets), bucket_counts(target, target_text_col, buckets), buckets)
    scored = weighed(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
