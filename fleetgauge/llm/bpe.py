"""BPE encoding and decoding with contiguous rank arrays.

A short word is held as two lists: the starts of its parts, and the merge rank of each part with the
next one. The smallest rank is looked up, its boundary deleted, and the ranks beside it are refreshed,
until no neighbours can merge. Words too long for repeated scans keep their candidates in a heap over
linked parts; both give the same parts. A worker encodes a distinct word once while it remembers it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols up to which a word is scanned, and distinct words that a worker remembers.
SHORT, REMEMBERED = 64, 400_000
#: Characters of a text that are split into words at a time; cuts are made at white space.
STRETCH = 1 << 16
NO_RANK = 1 << 60

#: Letters younger than Unicode 16, which the tokenizer takes for symbols.
YOUNG_LETTERS = (
    "558 58B-58C 88F C5C CDC 1C89 208F 209D-209F A7CB-A7CC A7CE-A7CF A7D2 A7D4 A7DA A7DC-A7DD A7E2 A7F1 AB6C-AB6D "
    "107BB-107BF 10940-10959 10D50-10D65 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)

#: Capitals younger than Python's tables, and their small letters.
YOUNG_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
    0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


def _as_class(ranges: str) -> str:
    return "".join("-".join(rf"\U{int(x, 16):08X}" for x in part.split("-")) for part in ranges.split())


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself where it is one, else the next free letter from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class WordBpe:
    """The tokenizer of a vocabulary file with word ends: normalises, splits, merges, and decodes."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: s for s, i in self.special.items()})
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.plain = regex.compile(pattern)
        letters = rf"[\p{{L}}--[{_as_class(YOUNG_LETTERS)}]]"
        self.careful = regex.compile(pattern.replace(r"[\p{L}]", letters).replace(r"\s\p{L}", rf"\s{letters}"), regex.V1)
        self.beyond = regex.compile(r"[^\0-\u0557]")
        tags = sorted(self.special, key=len, reverse=True)
        self.tags = regex.compile("(" + "|".join(map(regex.escape, tags)) + ")") if tags else None
        self.letters = byte_letters()
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[left], self.vocab[right]] = (rank, self.vocab[left + right])
        if not all(x in self.vocab and x + self.end in self.vocab for x in self.letters):
            raise ValueError("the vocabulary lacks single bytes")
        self.ids_of: dict[str, bytes] = {}
        self.shown_of: dict[str, str] = {}

    def symbols(self, word: str) -> list[int]:
        letters = [self.letters[b] for b in word.encode()]
        letters[-1] += self.end
        return [self.vocab[x] for x in letters]

    def merge_scan(self, parts: list[int]) -> list[int]:
        """Contiguous arrays: `parts[i]` begins at boundary i, `ranks[i]` is its rank with the next one."""
        none = (NO_RANK, 0)
        ahead = [self.merges.get(pair, none) for pair in zip(parts, parts[1:])]
        while ahead:
            best = min(ahead)
            if best[0] == NO_RANK:
                break
            i = ahead.index(best)
            parts[i] = best[1]
            del parts[i + 1], ahead[i]
            if i:
                ahead[i - 1] = self.merges.get((parts[i - 1], parts[i]), none)
            if i < len(ahead):
                ahead[i] = self.merges.get((parts[i], parts[i + 1]), none)
        return parts

    def merge_heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = []

        def offer(i):
            j = after[i]
            if j < n and (found := self.merges.get((parts[i], parts[j]))):
                heapq.heappush(heap, (found[0], i, parts[i], parts[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j] = made, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p, a in zip(parts, alive) if a]

    def learn(self, words: list[str]) -> None:
        """Encodes the words that aren't remembered yet."""
        if len(self.ids_of) >= REMEMBERED:
            self.ids_of.clear(), self.shown_of.clear()
        for word in words:
            if word not in self.ids_of:
                parts = self.symbols(word)
                ids = self.merge_scan(parts) if len(parts) <= SHORT else self.merge_heap(parts)
                self.ids_of[word] = array("I", ids).tobytes()
                self.shown_of[word] = " ".join([self.names[i] for i in ids])

    def normal(self, text: str) -> str:
        # Each capital is lowered by itself, so a final sigma is no case of its own.
        small = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return small.translate(YOUNG_CAPITALS) if self.beyond.search(small) else small

    def pieces(self, text: str) -> Iterator[tuple[bytes, str]]:
        """Ids and decoded form of one stretch after the other."""
        for k, part in enumerate(self.tags.split(text) if self.tags else [text]):
            if k % 2:
                yield array("I", [self.special[part]]).tobytes(), part
                continue
            begin = 0
            while begin < len(part):
                end = part.find(" ", begin + STRETCH) + 1 or len(part)
                stretch = self.normal(part[begin:end])
                begin = end
                words = (self.careful if self.beyond.search(stretch) else self.plain).findall(stretch)
                try:
                    packed = b"".join(map(self.ids_of.get, words))
                except TypeError:
                    self.learn(words)
                    packed = b"".join(map(self.ids_of.get, words))
                if words:
                    yield packed, " ".join(map(self.shown_of.get, words))
                if len(words) and max(map(len, words)) > SHORT:
                    for word in words:
                        if len(word) > SHORT:
                            self.ids_of.pop(word, None), self.shown_of.pop(word, None)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Count of ids, digest of the ids, digest of the decoded text; holds one stretch of it at a time."""
        ids, shown, n = hashlib.sha256(), hashlib.sha256(), 0
        for packed, words in self.pieces(text):
            ids.update(packed)
            shown.update(((" " if n else "") + words).encode())
            n += len(packed) // 4
        return n, ids.hexdigest(), shown.hexdigest()

    def encode(self, text: str) -> list[int]:
        out = array("I")
        for packed, _ in self.pieces(text):
            out.frombytes(packed)
        return out.tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids if i in self.names])


def load(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _mapped(docs: DataFrame, vocabulary: str, keep: list[str], text_col: str, work, fields: list[pa.Field], schema: str) -> DataFrame:
    """Adds `work(tokenizer, text)` to every row; the vocabulary travels as one broadcast of fixed size."""
    spec = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches):
        bpe = WordBpe(spec.value)
        for batch in batches:
            if batch.num_rows:
                made = [work(bpe, t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*made), fields)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *(f.name for f in fields)])

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{whole}, {schema}")


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes the whole text and decodes the ids again. A null text counts as empty: no ids, and digests
    of nothing. Special tokens written out in a text are those tokens. Null ids and repeated rows are
    kept as they are; an empty table gives no rows.
    """
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    return _mapped(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), vocabulary, ["doc_id"], "text",
        lambda bpe, text: bpe.digest(text), fields, "n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the list of its token ids."""
    return _mapped(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), vocabulary, ["doc_id"], "text",
        lambda bpe, text: (bpe.encode(text),), [pa.field("ids", pa.list_(pa.int32()))], "ids array<int>",
    )


def decoded(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of its ids; a null list gives an empty text, unknown ids are left out."""
    return _mapped(
        tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), vocabulary, ["doc_id"], "ids",
        lambda bpe, ids: (bpe.decode(ids or []),), [pa.field("decoded", pa.string())], "decoded string",
    )
