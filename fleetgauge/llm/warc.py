"""WARC archives with an index.

Tasks write compressed archives, one gzip member per record, and give an index row per record: archive,
offset, length, URL and digest. Records are read by index rows: sorted by place, neighbouring byte
ranges are joined to one read each. Of long equal payloads one record holds the bytes, the others are
revisits of it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import pinned, shared_folder
from fleetgauge.llm.storage import create, located, new_name

#: Payload bytes from which equal ones are stored once; bytes of an archive, of the part of it that one task reads,
#: of one read, and the gap that a read may bridge.
LONG, ARCHIVE, PART, READ, GAP = 1000, 64 << 20, 16 << 20, 8 << 20, 64 << 10
LEVEL = 3
#: Archives hold no clock time, so that writing again gives the same bytes.
DATE = "1970-01-01T00:00:00Z"

INDEX = "archive string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def record_name(page_id: int | None, url: str | None, digest: str) -> str:
    seed = f"page {page_id}" if page_id is not None else f"url {url} {digest}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(seed.encode()).digest())}>"


def _header(first: str, fields: list[tuple[str, object]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A response record with its payload, or a revisit record of page `refers_to` without it."""
    kind = "response" if refers_to is None else "revisit"
    http = _header("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http + (payload if refers_to is None else b"")
    head = _header(
        "WARC/1.1",
        [
            ("WARC-Type", kind), ("WARC-Record-ID", record_name(page_id, url, digest)), ("WARC-Date", DATE),
            ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Id", page_id), ("Refers-To-Page-Id", refers_to),
            ("WARC-Refers-To", None if refers_to is None else record_name(refers_to, None, digest)),
            ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
        ],
    )
    return head + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record."""
    def fields(text):
        return dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:])

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _write(folder: str):
    def run(batches):
        file, name, offset = None, "", 0
        for batch in batches:
            out = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    name = new_name(folder, "pages") + ".warc.gz"
                    file, offset = create(name), 0
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, html, digest, refers_to)) + packer.flush()
                file.write(member)
                out.append((name, offset, len(member), url, digest, page_id, "response" if refers_to is None else "revisit"))
                offset += len(member)
                if offset >= ARCHIVE:
                    file.close()
                    file = None
            if out:
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                names = [f.split()[0] for f in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if file is not None:
            file.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Writes a record per row of `pages` to `folder` and gives the index, which is stored beside the archives.

    A null html is an empty payload; a null URL leaves its field out. Of records with equal payloads of
    at least LONG bytes, the one with the largest id is the response (each of them if its id is repeated),
    the others, null ids too, are revisits of it. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"),
    ).withColumn("digest", F.sha1("html"))
    same = ["digest", "size", "mark"]
    marked = rows.withColumn("size", F.length("html")).withColumn("mark", F.xxhash64("html"))
    # Written first: its size is known then, and only if it is small does Spark broadcast it and leave the payloads where they are.
    repeated = pinned(
        marked.where(F.col("size") >= LONG).groupBy(*same).agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND response IS NOT NULL").drop("n"),
        "warc-repeated",
    )
    records = marked.join(repeated, same, "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to")
    )
    records.mapInArrow(_write(folder), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _read(with_payload: bool):
    def ranges(rows):
        """Sorted (archive, offset, length) in groups that one read covers."""
        group, end = [], 0
        for row in rows:
            if group and (row[0] != group[0][0] or row[1] - end > GAP or row[1] + row[2] - group[0][1] > READ):
                yield group
                group = []
            group.append(row)
            end = row[1] + row[2]
        if group:
            yield group

    def run(batches):
        opened, file = None, None
        for batch in batches:
            out = []
            for group in ranges(zip(*(c.to_pylist() for c in batch.columns))):
                if group[0][0] != opened:
                    store, path = located(group[0][0])
                    opened, file = group[0][0], store.open_input_file(path)
                begin = group[0][1]
                data = file.read_at(group[-1][1] + group[-1][2] - begin, begin)
                for _, offset, length in group:
                    warc, http, payload = parsed(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                    stated = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    whole = warc["WARC-Type"] == "response"
                    digest = hashlib.sha1(payload).hexdigest() if whole else stated
                    if digest != stated:
                        raise ValueError(f"{opened} at {offset}: payload {digest} instead of {stated}")
                    page_id, refers = warc.get("Page-Id"), warc.get("Refers-To-Page-Id")
                    out.append((
                        None if page_id is None else int(page_id), warc.get("WARC-Target-URI"), warc["WARC-Type"],
                        None if refers is None else int(refers), len(payload) if whole else int(http["Content-Length"]), digest,
                        *([payload] if with_payload else []),
                    ))
            if out:
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = [*(f.split()[0] for f in RECORD.split(", ")), "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names[: len(out[0])])

    return run


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the given index rows, each checked against its digest; `payload` is null-free bytes.

    A revisit has no bytes of its own; its payload_bytes and payload_digest are those of the whole payload.
    """
    placed = (
        index.select("archive", "offset", "length", F.floor(F.col("offset") / PART).alias("part"))
        .repartition("archive", "part").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    )
    return placed.mapInArrow(_read(with_payload), RECORD + (", payload binary" if with_payload else ""))


def archived(pages: DataFrame) -> DataFrame:
    """Writes all pages to a new folder and reads them back: one row per page, as its record tells."""
    return read_records(write_archives(pages, shared_folder(pages.sparkSession, "warc")))
