"""WARC archives with a two-level capture index.

Pages become gzipped WARC records, one member each, in files of the shared
folder. Of equal payloads of at least ``least_bytes`` the page with the largest
id is the response, the others are revisits that refer to it.

The index sorts captures by reversed-host URL key and page id, keeps them in
compressed blocks, and next to each index file a sparse directory with the
first key of each block. A lookup finds the index file among the files' first
keys, the blocks by binary search in that file's directory, and reads only
these ranges; then the records' ranges, in file order.

Defined results. Null html: an empty payload. Null url: the empty key. A null
page id is written and read back as null and is never referred to. Repeated
rows give a record each. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written
from .components import join_grouped

DATE = "2024-01-01T00:00:00Z"
SHIFT = 1 << 63


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then port, path and query; lower-case host, no scheme, no www."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe="/:?&=%,;@!$'()*+~#[]")
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" if host else ""
    rest = (parts.path or ("/" if host else "")) + (f"?{parts.query}" if parts.query else "")
    return key + quote(rest, safe="/:?&=%,;@!$'()*+~")


def id_key(page_id: int | None) -> str:
    """Ids as text that sorts as they do, null first."""
    return "-" if page_id is None else f"{page_id + SHIFT:020d}"


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, not yet compressed."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = http_head(len(payload))
    block = head if refers_to is not None else head + payload
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", "%0A", url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields, HTTP length and payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = lambda x: int(m[1]) if x and (m := re.search(r"page:(-?\d+)>", x)) else None
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": length,
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": page(fields.get("WARC-Refers-To")),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _gzip(data: bytes, level: int) -> bytes:
    return gzip.compress(data, level, mtime=0)


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, file_bytes: int = 256 << 20, level: int = 4, broadcast_rows: int = 200_000) -> DataFrame:
    """Write all pages; one row per record: page_id, key, file, offset, length."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    known = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    first = written(known, "payloads")
    several = first.where("n > 1")
    if several.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows = rows.join(F.broadcast(several.drop("n")), "digest", "left")
    else:  # small payloads have no digest and stay where they are; the commonest ones meet by a bounded broadcast
        small = rows.where("digest IS NULL").withColumn("response_id", F.lit(None).cast("long"))
        rows = join_grouped(rows.where("digest IS NOT NULL"), first, "digest", "n", first.agg(F.sum("n")).first()[0] or 0).unionByName(small)
    refers = F.when(F.coalesce(F.col("page_id") != F.col("response_id"), F.col("response_id").isNotNull()), F.col("response_id"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"))
    folder = new_path(spark, "archives")

    def write(batches):
        system, base = _opened(folder)
        system.create_dir(base, recursive=True)
        out, path, at = None, "", 0
        for batch in batches:
            found = []
            for page_id, url, payload, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    path, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0  # a task that runs again leaves its first files unused
                    out = system.open_output_stream(path, compression=None)
                data = _gzip(record(page_id, url, payload, refers_to), level)
                out.write(data)
                found.append((page_id, f"{url_key(url)} {id_key(page_id)}", path, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))] if found else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())], names=["page_id", "key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return written(rows.mapInArrow(write, "page_id long, key string, file string, offset long, length long"), "captures")


class CaptureIndex:
    """Index files in one folder and the first key of each of them."""

    def __init__(self, spark: SparkSession, folder: str, files: list[tuple[str, str]]):
        self.spark, self.folder, self.files = spark, folder, sorted(files)

    @classmethod
    def build(cls, captures: DataFrame, block_lines: int = 1000, files: int | None = None) -> "CaptureIndex":
        """Sort captures by key over ``files`` files of compressed blocks, each with its directory."""
        spark = captures.sparkSession
        folder = new_path(spark, "index")
        files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

        def write(batches):
            system, base = _opened(folder)
            system.create_dir(base, recursive=True)
            name, at, directory, lines = f"{base}/{uuid.uuid4().hex}", 0, [], []
            with system.open_output_stream(name + ".cdx.gz", compression=None) as out:

                def flush():
                    nonlocal at, lines
                    if lines:
                        data = _gzip("\n".join(x[1] for x in lines).encode(), 6)
                        out.write(data)
                        directory.append((lines[0][0], at, len(data)))
                        at += len(data)
                        lines = []

                for pdf in batches:
                    for row in pdf.itertuples(index=False):
                        lines.append((row.key, f"{row.key} {json.dumps([row.file, row.offset, row.length])}"))
                        if len(lines) >= block_lines:
                            flush()
                flush()
            with system.open_output_stream(name + ".dir", compression=None) as out:
                out.write(json.dumps(directory).encode())
            if directory:
                yield pd.DataFrame([(directory[0][0], name)], columns=["first", "name"])

        dealt = captures.select("key", "file", "offset", "length").repartitionByRange(files, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
        made = written(dealt.mapInPandas(write, "first string, name string"), "index-files")
        return cls(spark, folder, [(r["first"], r["name"]) for r in made.collect()])  # one row per index file

    def lookup(self, keys: DataFrame, key_col: str = "key") -> DataFrame:
        """key, file, offset, length of every capture whose key is, or begins with, a given key and a space."""
        folder, files = self.folder, self.files
        firsts = [f for f, _ in files]

        def find(batches):
            system, _ = _opened(folder)
            directories, blocks = OrderedDict(), OrderedDict()

            def kept(store, key, most, make):
                if key not in store:
                    store[key] = make()
                    if len(store) > most:
                        store.popitem(last=False)
                return store[key]

            def directory(name):
                def read():
                    with system.open_input_stream(name + ".dir", compression=None) as f:
                        rows = json.loads(f.read())
                    return [r[0] for r in rows], rows

                return kept(directories, name, 4, read)

            def block(name, offset, length):
                def read():
                    with system.open_input_file(name + ".cdx.gz") as f:
                        lines = gzip.decompress(f.read_at(length, offset)).decode().split("\n")
                    return [x.rsplit(" [", 1)[0] for x in lines], lines

                return kept(blocks, (name, offset), 8, read)

            for pdf in batches:
                out = []
                for key in pdf["key"]:
                    for k in range(max(0, bisect.bisect_left(firsts, key) - 1), len(files)):
                        if firsts[k] > key + " ~":
                            break
                        names, rows = directory(files[k][1])
                        for b in range(max(0, bisect.bisect_left(names, key) - 1), len(rows)):
                            if names[b] > key + " ~":
                                break
                            known, lines = block(files[k][1], rows[b][1], rows[b][2])
                            for i in range(bisect.bisect_left(known, key), len(known)):
                                if known[i] != key and not known[i].startswith(key + " "):
                                    break
                                out.append((known[i], *json.loads(lines[i][len(known[i]) + 1 :])))
                yield pd.DataFrame(out, columns=["key", "file", "offset", "length"])

        asked = keys.select(F.col(key_col).alias("key")).where("key IS NOT NULL").distinct()
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = asked.repartitionByRange(n, "key").sortWithinPartitions("key")
        return dealt.mapInPandas(find, "key string, file string, offset long, length long")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records at these places, each by a range read, in file order; payloads are checked against their digest."""
    schema = READ + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        system, _ = _opened(folder)
        path, f = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.file != path:
                    if f is not None:
                        f.close()
                    path, f = row.file, system.open_input_file(row.file)
                got = parse_record(zlib.decompress(f.read_at(row.length, row.offset), 31))
                if got["payload"] is not None and (len(got["payload"]) != got["payload_bytes"] or hashlib.sha1(got["payload"]).hexdigest() != got["payload_digest"]):
                    raise ValueError(f"payload of page {got['page_id']} does not match its digest")
                out.append([got[c] for c in names])
            columns = zip(*out) if out else [[] for _ in names]
            types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.Table.from_arrays([pa.array(list(c), types[x.split()[1]]) for c, x in zip(columns, schema.split(", "))], names=names).to_pandas(types_mapper=pd.ArrowDtype)
        if f is not None:
            f.close()

    n = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = captures.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(read, schema)


def capture_key(url: Column, page_id: Column) -> Column:
    """The index key of a page, as its own column function."""

    @F.pandas_udf("string")
    def key(urls: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([f"{url_key(u if isinstance(u, str) else None)} {i}" for u, i in zip(urls, ids)])

    shifted = F.when(page_id.isNull(), F.lit("-")).otherwise(F.lpad((page_id.cast("decimal(20,0)") + F.expr(f"{SHIFT}BD")).cast("string"), 20, "0"))
    return key(url, shifted)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Write all pages, index them, look every page up and read it back: one row per record."""
    captures = write_archives(pages, id_col, url_col, html_col, least_bytes)
    index = CaptureIndex.build(captures)
    keys = pages.select(capture_key(F.col(url_col), F.col(id_col).cast("long")).alias("key"))
    places = index.lookup(keys)
    return read_records(written(places, "places"), index.folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), chosen AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS largest FROM sized
)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM chosen
"""
