import hashlib
import random

import duckdb
import numpy as np
import pytest
from llm_rows import docs, rows_of  # noqa: F401

from fleetgauge.llm import bpe

public = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(bpe.load(public.path("word_bpe_49k.json")))


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    shown = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


def test_random_texts(library, own):
    draw = random.Random(4)
    pool = [*"aàéñßΣσςİIiﬁ'sre vell d123 \t\n\x0b\x1c\x85​　中文字😀👍🏽́̈-_.,!?Ᲊვ1\U00016ea1", "<|startoftext|>", "<|endoftext|>", "'re", "hello", "Å"]
    for _ in range(3000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("length", [64, 65, 700, 20_000])
def test_long_words(library, own, length):
    text = "".join(random.Random(length).choice("abcdeé") for _ in range(length))
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_scan_and_heap_agree(own):
    draw = random.Random(8)
    for _ in range(300):
        parts = own.symbols("".join(draw.choice("aathe") for _ in range(draw.randint(1, 60))))
        assert own.merge_scan(list(parts)) == own.merge_heap(list(parts))


def test_stretches_and_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 16)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.WordBpe(bpe.load(public.path("word_bpe_49k.json")))
    text = "it's  a <|endoftext|>  text with é and  many\nwords " * 20
    assert own.digest(text) == want(library, text)


def test_query_like_the_library(spark, library):
    from fleetgauge.llm.queries import QUERIES

    got = {r[0]: tuple(r)[1:] for r in QUERIES["op9_rank_array"](spark, FOLDER).collect()}
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    assert got == {d: want(library, t) for d, t in rows}


def test_odd_rows_and_round_trip(docs, library):
    path = public.path("word_bpe_49k.json")
    rows = [(1, None), (2, ""), (3, " \n"), (None, "x y"), (5, "Same row"), (5, "Same row"), (6, "word " * 60_000)]
    got = [tuple(r.values()) for r in rows_of(bpe.token_digests(docs(rows), path))]
    assert sorted(got, key=repr) == sorted([(d, *want(library, t)) for d, t in rows], key=repr)
    assert rows_of(bpe.token_digests(docs([]), path)) == []
    back = {r["doc_id"]: r["decoded"] for r in rows_of(bpe.decoded(bpe.encoded(docs(rows), path), path))}
    assert back[5] == "same</w> row</w>" and back[1] == ""
