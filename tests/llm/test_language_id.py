import duckdb
from llm_rows import docs, rows_of  # noqa: F401

from fleetgauge.llm import language_id
from fleetgauge.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
TEXTS = {"en": "the house and the garden of my friends " * 4, "de": "das haus und der garten meiner freunde " * 4}


def brute(text, profiles):
    """Ranks by plain counting."""
    cells = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    cells = " " + " ".join(cells.split()) + " "
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(cells) - n + 1):
            if cells[i : i + n] != " ":
                counts[cells[i : i + n]] = counts.get(cells[i : i + n], 0) + 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    top = sorted(counts, key=lambda g: (-counts[g], code(g)))[: language_id.RANKS]
    scores = {}
    for lang, ranks in profiles.items():
        scores[lang] = sum(abs(ranks[code(g)] - 1 - i) if code(g) in ranks else language_id.RANKS for i, g in enumerate(top))
    best = min(scores, key=lambda x: (scores[x], x))
    return best, 1 - scores[best] / (language_id.RANKS * len(top))


def test_held_out_accuracy_and_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op6_rank_order"](spark, FOLDER).collect()}
    rows = duckdb.connect().execute(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet'").fetchall()
    held = [(got[d]["lang_pred"], lang) for d, _, lang in rows if got[d]["held_out"]]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.98
    docs_ = spark.read.parquet(f"{FOLDER}/documents.parquet")
    training = docs_.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2")
    profiles = {}
    for r in language_id.learn(training).collect():
        profiles.setdefault(r["lang"], {})[r["code"]] = r["rank"]
    for d, text, _ in rows[:60]:
        lang, score = brute(text, profiles)
        assert (got[d]["lang_pred"], round(got[d]["score"], 9)) == (lang, round(score, 9))


def test_counts_across_stretches(monkeypatch):
    text = "Ähren und Wälder, 12 ... ünd " * 50
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "STRETCH", 7)
    cut = language_id.counts(text)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_odd_rows(docs):
    rows = [(i, TEXTS[lang], lang) for i, lang in zip((1, 2, 3, 4, 6), ["en", "de"] * 3)]
    odd = [(10, None, "en"), (11, "", "en"), (12, "123 ... !", "de"), (None, TEXTS["de"], "xx"), (14, TEXTS["en"], None), (14, TEXTS["en"], None), (15, TEXTS["de"] * 3000, None), (16, "我们", None)]
    got = rows_of(language_id.language_of(docs(rows + odd)))
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == 13 and [pred[i] for i in (10, 11, 12)] == ["und"] * 3
    assert (pred[None], pred[14], pred[15]) == ("de", "en", "de") and pred[16] in ("de", "en")
    assert all(0 <= r["score"] <= 1 for r in got) and not got[-1]["held_out"]


def test_nothing_to_learn_from(docs):
    assert rows_of(language_id.language_of(docs([]))) == []
    assert [r["lang_pred"] for r in rows_of(language_id.language_of(docs([(1, "some text")])))] == ["und"]


def test_texts_without_a_language_go(docs):
    frame = docs([(i, TEXTS["en"], "en") for i in range(8)] + [(20, "12", None), (21, None, None)])
    out = language_id.with_language(frame)
    assert out.columns == frame.columns and sorted(r["doc_id"] for r in out.collect()) == list(range(8))
