"""WARC archives of page captures, and the assembly of their records into one nested row per capture.

Writing: every page becomes a request, a response or revisit, and a metadata record; the first and last name the second
in WARC-Concurrent-To. Of payloads of at least ``LEAST`` bytes that are equal, that of the smallest page_id is stored and
the others revisit it (WARC-Refers-To). Records are gzip members; a task closes a file after ``FILE_BYTES``. Files are named
by content, so a repeated task writes the same name, and only listed files are read. The ``HEAVY`` most repeated digests, rows of fixed
size, are broadcast; any other one is a smaller part of all rows than 1 / ``HEAVY`` and met in a join.

Reading: each file is parsed where it is read, response payloads are hashed and checked against the stored digest, and
records are grouped by the capture's identifier (one shuffle of headers; payloads stay in the files, at uri and offset).
A revisit takes the payload's length and page from the record it refers to.

Cases: null html is an empty payload; null url is written as empty, and a url without ``://`` asks for ``/`` of no host; null page_ids never are the smallest and are read back
as null; repeated rows are written and returned as often, under one record id; short payloads are all responses; an empty table gives no files
and no rows; extra columns are dropped.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from urllib.parse import quote
from uuid import NAMESPACE_URL, uuid5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get_file, new_dir, put_file, staged

LEAST, FILE_BYTES, DATE = 100, 32 << 20, "1970-01-01T00:00:00Z"
HEAVY = 10_000
RECORD = "uri string, offset long, record_id string, type string, capture string, refers_to string, target string, digest string, payload_bytes long, page_id long"


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def record(kind: str, rid: str, headers: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": DATE, **headers, "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode("utf-8") + block + b"\r\n\r\n", 1, mtime=0)


def request(url: str) -> bytes:
    """What a client sends for a url: path and query, characters that may not stand there escaped, and the host."""
    host, target = re.match(r"([^/?#]*)([^#]*)", url.partition("://")[2], re.S).groups()
    path = quote(target if target.startswith("/") else f"/{target}", safe="/?%:@!$&'()*+,;=~[]")
    return f"GET {path} HTTP/1.1\r\nHost: {quote(host, safe='%:@[]')}\r\n\r\n".encode()


def capture_records(page_id: int | None, url: str, payload: bytes, digest: str, first: tuple | None) -> list[bytes]:
    """first: (page_id, SHA-256 of the url) of the page whose payload this one repeats, or None."""
    line = re.sub(r"[\r\n]+", " ", url)
    rid = record_id("revisit" if first else "response", page_id, hashlib.sha256(url.encode()).hexdigest(), digest)
    about = {"WARC-Target-URI": line}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kept = {**about, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
    if first:
        kept |= {"WARC-Refers-To": record_id("response", *first, digest), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    beside = {**about, "WARC-Concurrent-To": rid}
    note = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    return [
        record("request", record_id("request", rid), {**beside, "Content-Type": "application/http; msgtype=request"}, request(url)),
        record("revisit" if first else "response", rid, kept, http if first else http + payload),
        record("metadata", record_id("metadata", rid), {**beside, "Content-Type": "application/warc-fields"}, note),
    ]


def write(pages: DataFrame, out_uri: str) -> DataFrame:
    """Write archives below out_uri; returns the staged list of files (uri, n_captures, n_bytes)."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("payload"), F.sha2(html, 256).alias("digest"))
    long = base.where(F.octet_length("payload") >= LEAST)
    first = F.min(F.struct("page_id", F.sha2("url", 256).alias("url"))).alias("first")
    groups = long.where("page_id is not null").groupBy("digest").agg(first, F.max("page_id").alias("last"), F.count("*").alias("n"))
    nobody = long.where("page_id is null").groupBy("digest").agg(F.count("*").alias("lost"))
    repeats = groups.join(nobody, "digest", "left").where("last > first.page_id or lost is not null")
    repeats = staged(repeats.select("digest", F.col("first.page_id").alias("fid"), F.col("first.url").alias("furl"), (F.col("n") + F.coalesce("lost", F.lit(0))).alias("n")), "repeats")
    heavy = repeats.orderBy(F.desc("n"), "digest").limit(HEAVY)
    rest = repeats.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    near = base.join(F.broadcast(heavy.select("digest", F.col("fid").alias("hid"), F.col("furl").alias("hurl"))), "digest", "left")
    # a row that has met its digest goes anywhere
    key = F.when(F.col("hid").isNull(), F.col("digest")).otherwise(F.concat(F.lit("+"), F.monotonically_increasing_id().cast("string")))
    met = near.withColumn("key", key).join(rest.select(F.col("digest").alias("key"), "fid", "furl"), "key", "left")
    given = met.withColumn("fid", F.coalesce("hid", "fid")).withColumn("furl", F.coalesce("hurl", "furl"))

    def files(batches):
        body, n, size = [], 0, 0

        def close():
            data = b"".join(body)
            uri = f"{out_uri}/{hashlib.sha256(data).hexdigest()}.warc.gz"
            put_file(uri, data)
            return pd.DataFrame({"uri": [uri], "n_captures": [n], "n_bytes": [len(data)]})

        for b in batches:
            for i, url, payload, digest, fid, furl in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["fid"], b["furl"], strict=True):
                i = None if pd.isna(i) else int(i)
                first = None if pd.isna(fid) or i == int(fid) else (int(fid), furl)
                made = capture_records(i, url, bytes(payload), digest, first)
                body += made
                n, size = n + 1, size + sum(map(len, made))
                if size > FILE_BYTES:
                    yield close()
                    body, n, size = [], 0, 0
        if n:
            yield close()

    return staged(given.select("page_id", "url", "payload", "digest", "fid", "furl").mapInPandas(files, "uri string, n_captures long, n_bytes long"), "warcs")


def members(data: bytes):
    """(offset, content) of every gzip member."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        content, end = [], at
        while not z.eof and end < len(data):
            content.append(z.decompress(data[end : end + (1 << 16)]))
            end += 1 << 16
        yield at, b"".join(content)
        at = min(end, len(data)) - len(z.unused_data)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def records(listed: DataFrame) -> DataFrame:
    """One row per record of the listed archives."""

    def load(batches):
        for b in batches:
            for uri in b["uri"]:
                out = []
                for at, content in members(get_file(uri)):
                    f, block = parse(content)
                    kind, digest, size, page = f["WARC-Type"], f.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{uri} at {at}: payload and digest differ")
                        size = len(payload)
                    elif kind == "metadata" and (m := re.search(rb"page-id: (-?\d+)", block)):
                        page = int(m[1])
                    rid = f["WARC-Record-ID"]
                    out.append((uri, at, rid, kind, f.get("WARC-Concurrent-To", rid), f.get("WARC-Refers-To"), f.get("WARC-Target-URI"), digest, size, page))
                names = [x.split()[0] for x in RECORD.split(", ")]
                yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64", "page_id": "Int64"})

    n = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("uri").repartition(n, "uri").mapInPandas(load, RECORD)


def assemble(rows: DataFrame) -> DataFrame:
    """(capture, request, response, metadata, copies): nested structs of the records that name each other."""
    part = F.struct("uri", "offset", "record_id", "type", "refers_to", "target", "digest", "payload_bytes", "page_id")
    main = F.col("type").isin("response", "revisit")
    return rows.groupBy("capture").agg(
        F.max(F.when(F.col("type") == "request", part)).alias("request"), F.max(F.when(main, part)).alias("response"),
        F.max(F.when(F.col("type") == "metadata", part)).alias("metadata"), F.count(F.when(main, 1)).alias("copies"),
    ).where("response is not null")


def captures(listed: DataFrame) -> DataFrame:
    """Assembled captures with what a revisit refers to: payload_bytes and refers_to (page_id)."""
    got = staged(assemble(records(listed)), "captures")
    # capture ids are unique after assembly; only referred ids are joined, repeats of a hot one are on the left
    wanted = got.where("response.refers_to is not null").select(F.col("response.refers_to").alias("capture")).distinct()
    aim = got.join(wanted, "capture", "left_semi").select(
        F.col("capture").alias("aim"), F.col("response.payload_bytes").alias("aim_bytes"), F.col("metadata.page_id").alias("aim_page"), F.col("response.digest").alias("aim_digest")
    )
    return got.join(aim, (F.col("response.refers_to") == F.col("aim")) & (F.col("response.digest") == F.col("aim_digest")), "left")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    listed = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), new_dir(spark, "warc"))
    return captures(listed).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("response.payload_bytes", "aim_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(F.col("response.type") == "revisit", F.col("aim_page")).alias("refers_to"),
    )


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
