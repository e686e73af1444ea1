"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text in lower case and the beginnings of its longer words, so that what is
inflected is known by its stem; each is hashed. Of the hashed terms those are kept that go with the label
more often, or less often, than chance allows, and Spark's factorization machine learns from which of them a
text holds: a weight for each, and for each pair the product of their factors, so that two terms can mean
together what neither does alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import crc_of_id, pinned

#: Labelled documents that are learned from, about, of each label; chosen by a hash of the id.
SAMPLE = 20_000
#: Hashed terms, how many are kept at most, least chi-square of those, and documents of the sample that hold them.
BUCKETS, KEPT, SURE, LEAST = 1 << 20, 4096, 25.0, 5
#: Letters of the beginnings of longer words.
STEMS = (4, 5, 6)
FACTORS, TURNS, STEP, SHRINK, SEED = 8, 80, 0.1, 1e-4, 12
#: Words whose terms a worker remembers.
KNOWN = 1 << 19
WORD = re.compile(r"[^\W_]+")


def terms_of(word: str) -> list[int]:
    """The buckets of a word and of its beginnings."""
    named = [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]
    return [crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in named]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class Terms:
    """Which of the kept buckets a text holds, as places among them; all buckets where none were chosen yet."""

    def __init__(self, kept: np.ndarray | None = None):
        self.places = None if kept is None else {int(b): i for i, b in enumerate(kept)}
        self.known: dict[str, list[int]] = {}

    def of(self, text: str | None) -> list[int]:
        found: set[int] = set()
        for word in words_of(text):
            terms = self.known.get(word)
            if terms is None:
                terms = terms_of(word)
                if self.places is not None:
                    terms = [self.places[t] for t in terms if t in self.places]
                if len(self.known) >= KNOWN:
                    self.known.clear()
                if len(word) < 64:
                    self.known[word] = terms
            found.update(terms)
        return sorted(found)


@dataclass(frozen=True)
class Machine:
    """What was learned; small: at most KEPT terms with one weight and FACTORS factors each."""

    bias: float
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def score(self, places: list[int]) -> float:
        rows = self.factors[places]
        # Half of (sum)^2 less the sum of squares: all pairs at once.
        pairs = 0.5 * float((rows.sum(axis=0) ** 2).sum() - (rows**2).sum())
        value = self.bias + float(self.weights[places].sum()) + pairs
        return float(1.0 / (1.0 + np.exp(-np.clip(value, -700, 700))))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, text) to learn from: about `sample` documents of each label that are not held out, whole texts.

    The chosen labels are bounded by the sample, so they go to the documents rather than the documents to them.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_of_id(F.col("doc_id")) % 5 != 0))
    # A document with different labels is toxic.
    single = usable.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("double")).alias("label"))
    sizes = {r["label"]: r["n"] for r in single.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 11) / float(1 << 53)
    share = F.when(F.col("label") > 0, min(1.0, sample / sizes.get(1.0, 1))).otherwise(min(1.0, sample / sizes.get(0.0, 1)))
    return docs.join(F.broadcast(single.where(draw < share)), "doc_id").select("label", "text")


def chosen(held: DataFrame, sizes: dict[float, int]) -> np.ndarray:
    """The buckets that go with the label, surest first, at most KEPT, from rows of label and terms."""
    n1, n0 = (float(sizes.get(x, 0)) for x in (1.0, 0.0))
    counts = held.select("label", F.explode("terms").alias("bucket")).groupBy("bucket").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    both = a + b
    chi = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (both * (n1 + n0 - both) * n1 * n0)
    sure = counts.where((both >= LEAST) & (both < n1 + n0)).withColumn("chi", chi).where(F.col("chi") >= SURE)
    best = sure.orderBy(F.desc("chi"), "bucket").limit(KEPT).select("bucket").collect()
    return np.array([r["bucket"] for r in best], np.int64)


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine from rows of (doc_id, text) and (doc_id, toxic)."""
    def run(kept):
        def held(batches):
            terms = Terms(kept)
            for batch in batches:
                found = [terms.of(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["label", "terms"])

        return held

    texts = pinned(sampled(docs, labels, sample), "labelled")
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    rate = min(max(sizes.get(1.0, 0) / total, 1e-9), 1 - 1e-9) if total else 1e-9
    plain = Machine(float(np.log(rate / (1 - rate))))
    if len(sizes) < 2:
        return plain
    kept = chosen(texts.mapInArrow(run(None), "label double, terms array<int>"), sizes)
    if not len(kept):
        return plain
    words = texts.mapInArrow(run(kept), "label double, terms array<int>").select("label", F.col("terms").cast("array<string>").alias("words"))
    rows = pinned(words, "terms")
    made = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(kept))], "words", "features")
    vectors = made.setBinary(True).transform(rows).select("label", "features")
    fitted = FMClassifier(factorSize=FACTORS, maxIter=TURNS, stepSize=STEP, regParam=SHRINK, initStd=0.05, seed=SEED).fit(vectors)
    return Machine(float(fitted.intercept), kept, fitted.linear.toArray(), fitted.factors.toArray())


def toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_id="doc_id", label_col="toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on, else 0).

    Learns from the labels of documents whose id's CRC-32 mod 5 is not 0; the score reads the text alone, all of
    it. Rows of `labels` without an id or a label are not learned from; an id with different labels is toxic. A
    null text, an empty one, or one without a known term scores what the machine gives to no terms. Where there
    is nothing to tell apart (no labels, or one label only) the score is the share of toxic rows. A null id is
    not held out; repeated rows are kept; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    machine = docs.sparkSession.sparkContext.broadcast(learned(rows, labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).cast("double").alias("toxic")), sample))

    def run(batches):
        terms = Terms(machine.value.kept)
        for batch in batches:
            scores = [machine.value.score(terms.of(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 0, F.lit(False))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
