"""Language by rank-order profiles.

A text's one- to three-letter sequences are ranked by how often they occur; its distance to a language
is the sum, over its most frequent sequences, of how far each lies from its place in the language's
own ranking. A sequence that the language's profile lacks counts as far as a rank can be.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import crc_of_id

#: Ranks of a profile and of a text, longest sequence, and labelled texts that each language is learned from, about.
RANKS, LONGEST, SAMPLE = 400, 3, 1000
#: Characters whose sequences are counted at a time.
STRETCH = 1 << 20
SPACE = 32


_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _TABLES["letters"]


def _cells(text: str) -> np.ndarray:
    """Code points in lower case; what lies between words is one space, and there is one at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    cells = np.where(letter, points, SPACE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    cells = cells[keep]
    return np.concatenate(([SPACE], cells, [SPACE] if cells[-1] != SPACE else [])).astype(np.int64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sequences of a text as sorted codes, and how often each occurs."""
    cells = _cells(text)
    found = []
    for begin in range(0, len(cells), STRETCH):
        part = cells[begin : begin + STRETCH + LONGEST - 1]
        own = len(cells[begin : begin + STRETCH])
        codes, all_codes = part, []
        for n in range(1, LONGEST + 1):
            if n > 1:
                codes = (codes[:-1] << 21) | part[n - 1 :]
            all_codes.append(codes[:own])
        found.append(np.unique(np.concatenate(all_codes), return_counts=True))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(found) == 1:
        codes, times = found[0]
    else:
        codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        times = np.bincount(place, np.concatenate([t for _, t in found])).astype(np.int64)
    words = codes != SPACE
    return codes[words], times[words]


def fractions(labelled: DataFrame, sample: int) -> Column:
    """The share of a language's rows to learn from; one entry per language."""
    sizes = {row["lang"]: row["n"] for row in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return F.lit(0.0)
    pairs = [F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample / n))]
    return F.element_at(F.create_map(*pairs), F.col("lang"))


def learn(labelled: DataFrame, ranks: int = RANKS, sample: int = SAMPLE) -> DataFrame:
    """Profiles (lang, code, rank) from rows of doc_id, text and lang; whole texts of a sample chosen by id."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(6), "doc_id"), 11) / float(1 << 53)
    chosen = labelled.where(draw < fractions(labelled, sample)).select("lang", "text")

    def count(batches):
        for batch in batches:
            for lang, text in zip(*batch.to_pydict().values()):
                codes, times = counts(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(times)], ["lang", "code", "n"])

    return (
        chosen.mapInArrow(count, "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")))
        .where(F.col("rank") <= ranks).select("lang", "code", "rank")
    )


class Profiles:
    """The profiles of all languages as one table of ranks."""

    def __init__(self, rows, ranks: int = RANKS):
        self.ranks = ranks
        self.langs = sorted({lang for lang, _, _ in rows})
        self.codes = np.unique(np.array([code for _, code, _ in rows], np.int64))
        self.table = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)
        for lang, code, rank in rows:
            self.table[np.searchsorted(self.codes, code), self.langs.index(lang)] = rank - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs:
            return "und", 0.0
        codes, times = counts(text)
        if not len(codes):
            return "und", 0.0
        top = codes[np.argsort(-times, kind="stable")[: self.ranks]]
        at = np.searchsorted(self.codes, top)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == top[known]
        places = self.table[np.where(known, at, len(self.codes))]
        out_of_place = np.abs(places - np.arange(len(top), dtype=np.int32)[:, None])
        distance = np.where(places < 0, self.ranks, out_of_place).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.ranks * len(top))


def predicted(docs: DataFrame, profiles: DataFrame, keep=("doc_id",), text_col: str = "text", ranks: int = RANKS) -> DataFrame:
    """Adds lang_pred and score to the `keep` columns; languages x ranks rows of profiles reach the tasks."""
    known = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in profiles.select("lang", "code", "rank").collect()])
    rows = docs.select(*keep, F.col(text_col).alias("_text"))

    def run(batches):
        table = Profiles(known.value, ranks)
        for batch in batches:
            if batch.num_rows:
                made = [table.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                    [*batch.schema.names[:-1], "lang_pred", "score"],
                )

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{own}lang_pred string, score double")


def language_of(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score (1 at no distance, 0 at the greatest).

    Learns from rows with a text and a language whose id's CRC-32 mod 4 is not 2; the prediction reads
    the text alone, all of it. `und` with score 0 if the text is null or has no letter, or if there is
    nothing to learn from. Equally near languages go by name. A null id is neither learned from nor
    held out; repeated rows are kept; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    training = rows.where(F.col("doc_id").isNotNull() & ~held_out)
    return predicted(rows, learn(training, sample=sample)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """The rows of `docs` whose text has a language, with the columns of `docs`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    training = rows.where(F.col("doc_id").isNotNull() & (crc_of_id(F.col("doc_id")) % 4 != 2))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    return predicted(whole, learn(training), keep=("row",)).where("lang_pred <> 'und'").select("row.*")
