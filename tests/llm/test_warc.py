import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from snapledger.llm import warc
from tests.llm.odd import frame

PAGES = [(1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y", "<p>one</p>"), (3, None, "<p>two\r\n\r\nWARC/1.1</p>"),
         (4, "http://b.example/\r\nX: y%", None), (5, "http://b.example/", ""), (None, "http://c.example/", "<p>one</p>"),
         (None, None, "alone"), (2, "http://a.example/y", "<p>one</p>"), (6, "u", "é" * 200_000)]


def expected(rows, least=0):
    groups = defaultdict(list)
    for key, _, page in rows:
        groups[page or ""].append(key)
    out = []
    for key, _, page in rows:
        data = (page or "").encode()
        top = max((k for k in groups[page or ""] if k is not None), default=None)
        revisit = len(data) >= least and key != top
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows, least", [(PAGES, 0), (PAGES, 5), ([], 0)])
def test_round_trip(spark, tmp_path, rows, least):
    pages = frame(spark, rows, ("page_id", "url", "html"), ("bigint", "string", "string"))
    index = warc.write_archives(pages, f"file://{tmp_path}/w", min_bytes=least)
    back = warc.read_records(index, share=1000).collect()
    got = [(None if r["record_id"] == "null" else int(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"],
            None if r["refers_to"] is None else int(r["refers_to"])) for r in back]
    assert sorted(got, key=str) == expected(rows, least)
    texts = {(r["record_id"], bytes(r["payload"]).decode()) for r in back if r["record_type"] == "response"}
    assert texts <= {(str("null" if k is None else k), page or "") for k, _, page in rows}
    assert {r["url"] for r in back} == {u for _, u, _ in rows}


def test_selected_records_and_plain_gzip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", f"<p>{i}</p>") for i in range(300)], "page_id long, url string, html string")
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    some = warc.read_records(index.where("url LIKE '%7'"), gap=0, span=1).collect()
    assert sorted(int(r["record_id"]) for r in some) == list(range(7, 300, 10))
    records = b"".join(gzip.open(p).read() for p in (tmp_path / "w").glob("*.warc.gz"))
    assert records.count(b"WARC/1.1\r\n") == 300 and records.endswith(b"\r\n\r\n")


def test_damaged_payload_is_noticed():
    raw = warc.record("1", "u", b"abc", warc.base32_sha1(b"abd"), None, warc.DATE)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw)
