"""Web archives: written with an index, read back by coalesced byte ranges of the index.

Writing: every task writes one archive of gzip members, one member a record, and returns a row for
each: file, offset, length, URL, digest. These rows are the index, a table of their own. Of records
with the same payload one is a response, the others are revisits that refer to it and carry no body.

Reading: whatever rows of the index are wanted are sorted by file and offset; neighbouring ranges
are read in one go, and records are cut out, unpacked and checked against their digests.

Archives go to a folder that all executors share, through pyarrow's file systems. A task that is
repeated writes a file of its own, and the index names only files of tasks that succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import col, text_or_empty, written

INDEX_SCHEMA = ("file string, offset long, length long, url string, digest string, record_type string, "
                "record_id string")
RECORD_SCHEMA = ("record_id string, url string, record_type string, refers_to string, payload_bytes long, "
                 "payload_digest string, payload binary")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:record:{}>"
DATE = "2000-01-01T00:00:00Z"
#: Ranges that lie at most so far apart are read together, up to so many bytes at a time.
GAP, SPAN = 64 << 10, 8 << 20
#: Bytes of archives per task that reads them.
SHARE = 8 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain_value(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None,
           date: str) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which keeps the HTTP head but not the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
            f"WARC-Record-ID: {RECORD_ID.format(_header_value(record_id))}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {RECORD_ID.format(_header_value(refers_to))}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """Fields of a record in the order of ``RECORD_SCHEMA``; raises where the payload fails its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    name = lambda key: _plain_value(fields[key][len("<urn:record:"):-1]) if key in fields else None
    url = _plain_value(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {name('WARC-Record-ID')}: the payload does not have its digest")
    return (name("WARC-Record-ID"), url, kind, name("WARC-Refers-To"), size, digest,
            payload if kind == "response" else None)


def with_revisits(pages: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """``key``, payload, and ``_top``/``_copies``: the largest key among equal payloads of ``min_bytes`` or more.

    Equal payloads are counted before anything is joined, so a payload that a third of all pages
    share costs a row a task. Only payloads that occur more than once are looked up; their table is
    written first, so that Spark broadcasts it if it is small and can split a hot payload if not.
    """
    known = pages.withColumn("_sha1", F.sha1(col(payload)))
    repeated = written(known.where(F.octet_length(col(payload)) >= min_bytes).groupBy("_sha1")
                       .agg(F.max(col(key)).alias("_top"), F.count(F.lit(1)).alias("_copies"))
                       .where("_copies > 1"), "payloads")
    return known.join(repeated, "_sha1", "left")


def write_archives(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html",
                   min_bytes: int = 0, date: str = DATE, level: int = 4) -> DataFrame:
    """Write a record per row into archives below ``path`` and return the written index.

    Null payload: the empty one. Null URL: a record without target. Null key: the smallest key,
    record id ``null``. Rows that share the largest key of a payload are all responses. Repeated rows
    give repeated records. Pages of any length are one record each, and a task holds a batch of them. An
    empty table gives an empty index and no archive. Other columns are ignored.
    """
    rows = pages.select(col(key).alias("_key"), col(url).cast("string").alias("_url"),
                        text_or_empty(payload).alias("_payload"))
    rows = with_revisits(rows, "_key", "_payload", min_bytes)
    rows = rows.select(F.coalesce(F.col("_key").cast("string"), F.lit("null")).alias("record_id"), "_url",
                       "_payload", F.when(F.col("_copies").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_top")),
                                          F.col("_top").cast("string")).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, offset = None, 0
        try:
            for batch in batches:
                found = []
                for record_id, target, text, refers in batch.itertuples(index=False):
                    if out is None:
                        files, folder = fs.FileSystem.from_uri(path)
                        files.create_dir(folder, recursive=True)
                        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{folder}/{name}", compression=None)
                    body = text.encode()
                    digest = base32_sha1(body)
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = pack.compress(record(record_id, target, body, digest, refers, date)) + pack.flush()
                    out.write(data)
                    found.append((f"{path}/{name}", offset, len(data), target, digest,
                                  "response" if refers is None else "revisit", record_id))
                    offset += len(data)
                yield pd.DataFrame(found, columns=[x.split()[0] for x in INDEX_SCHEMA.split(", ")])
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInPandas(write, INDEX_SCHEMA), "warc-index")


def read_records(index: DataFrame, *, gap: int = GAP, span: int = SPAN, share: int = SHARE) -> DataFrame:
    """The records that the given rows of an index point to, read by coalesced ranges.

    Rows of one archive go to one task, in the order of their offsets; an archive is as large as a
    partition of the table that it was written from. At most ``span`` bytes (or one record) are held.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file = None, None
        for batch in batches:
            rows, i = list(batch.itertuples(index=False, name=None)), 0
            while i < len(rows):
                path, start, length = rows[i]
                end, j = start + length, i + 1
                while j < len(rows) and rows[j][0] == path and rows[j][1] - end <= gap and \
                        rows[j][1] + rows[j][2] - start <= span:
                    end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                if path != name:
                    files, at = fs.FileSystem.from_uri(path)
                    name, file = path, files.open_input_file(at)
                data = file.read_at(end - start, start)
                yield pd.DataFrame([parse_record(zlib.decompress(data[o - start:o - start + n], 31))
                                    for _, o, n in rows[i:j]],
                                   columns=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])
                i = j

    wanted = index.select("file", "offset", "length")
    total = wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ranges = wanted.repartition(total // share + 1, "file").sortWithinPartitions("file", "offset")
    return ranges.mapInPandas(read, RECORD_SCHEMA)
