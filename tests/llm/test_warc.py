import gzip
import hashlib
import json

from llm_rows import rows_of

from fleetgauge.llm import warc
from fleetgauge.llm.common import shared_folder
from fleetgauge.llm.storage import mapped

LONG = "<p>ä</p>" * 200


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS size", "'x' AS archive")


def brute(rows):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [i for i, _, h in rows if i is not None and (h or "") == (html or "")]
        keeper = max(same) if same and len(payload) >= 1000 and sum((h or "") == (html or "") for _, _, h in rows) > 1 else page_id
        revisit = keeper != page_id
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


def check(spark, rows):
    got = warc.archived(pages(spark, rows)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == brute(rows)


ROWS = [
    (1, "http://a.net/", LONG), (2, "http://b.net/", LONG), (9, None, LONG), (4, "http://a.net/é x\r\ny", "short"), (5, "u", "short"), (6, "u", None),
    (7, "u", ""), (None, "u", LONG), (None, "v", LONG + "lone"), (9, "again", LONG), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90), (12, "big", "x" * 3_000_000),
    (13, "u", "y" * 999), (14, "u", "y" * 999), (15, "u", "y" * 1000), (16, "u", "y" * 1000),
]


def test_like_brute_force(spark):
    check(spark, ROWS)
    check(spark, [])


def test_many_small_archives_and_reads(spark, monkeypatch):
    for name, value in (("ARCHIVE", 600), ("PART", 2000), ("READ", 700), ("GAP", 10)):
        monkeypatch.setattr(warc, name, value)
    check(spark, ROWS + [(100 + i, f"http://c.net/{i}", "z" * (i % 50) * 40) for i in range(300)])


def test_index_leads_to_records(spark):
    index = warc.write_archives(pages(spark, ROWS), shared_folder(spark, "warc-test"))
    row = index.where("page_id = 11").first()
    raw = mapped(row["archive"])[row["offset"] : row["offset"] + row["length"]].tobytes()
    head, http, payload = warc.parsed(gzip.decompress(raw))
    assert payload.decode() == ROWS[10][2] and head["WARC-Type"] == "response" and http["Content-Length"] == str(len(payload))
    chosen = warc.read_records(index.where("page_id IN (4, 11)"), with_payload=True)
    assert {r["page_id"]: r["payload"].decode() for r in chosen.collect()} == {4: "short", 11: ROWS[10][2]}
    assert json.dumps(rows_of(index.groupBy("archive").count(), "count"))
    whole = gzip.decompress(mapped(row["archive"]).tobytes())
    assert whole.startswith(b"WARC/1.1\r\n")
