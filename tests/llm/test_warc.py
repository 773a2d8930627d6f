import gzip
import hashlib

from leadloom.llm import warc
from leadloom.llm.common import keep
from leadloom.session import work_path

BIG = "<html>" + "x" * 1200 + "</html>"


def archive(spark, rows):
    path = work_path(spark, "warc-test")
    warc.write(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, capture string"), path)
    return path


def captures(spark, rows, **options):
    return warc.assemble(keep(warc.read(spark, archive(spark, rows), **options), "records"))


def test_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "é🙂" * 600
    rows = [(1, "http://a.org/x?q=1#f", BIG), (5, "http://b.org/", BIG), (3, "http://c.org", BIG), (2, "https://d.org/é p", tricky), (7, None, None), (8, "no scheme", ""),
            (9, "http://e.org/\r\nX-Bad: 1", "short"), (10, "http://f.org/", "short"), (None, "http://g.org/", "no id"), (11, "http://h.org/", "y" * 300_000)]
    out = captures(spark, rows, with_payload=True).collect()
    assert len(out) == len(rows)
    note = lambda m, k: (m[0].fields or {}).get(k) if m else None
    by = {note(r.metadata, "page-id"): r for r in out}
    assert set(by) == {str(r[0]) if r[0] is not None else None for r in rows}
    for page_id, url, html in rows:
        r, data = by[str(page_id) if page_id is not None else None], (html or "").encode()
        assert len(r.requests) == len(r.metadata) == 1 and note(r.metadata, "payload-length") == str(len(data))
        assert r.header_digest == hashlib.sha1(data).hexdigest()
        if page_id in (1, 3):
            assert r.record_type == "revisit" and r.payload == b"" and r.referred.metadata[0].fields["page-id"] == "5"
        else:
            assert r.record_type == "response" and bytes(r.payload) == data and r.payload_digest == r.header_digest and r.referred is None
        assert r.target_uri == (None if url is None else url.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A"))


def test_repeated_rows_come_back(spark):
    out = captures(spark, [(1, "http://a.org/", BIG)] * 3 + [(1, "http://b.org/", BIG), (0, "http://a.org/", BIG)]).collect()
    assert sorted((r.record_type, r.copies) for r in out) == [("response", 1), ("revisit", 1), ("revisit", 3)]


def test_other_writers_archives(spark):
    def record(kind, name, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{name}>", **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(block))}
        return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"

    http = {"Content_Type": "application/http"}
    parts = [record("warcinfo", "i", b"software: x\r\n", Content_Type="application/warc-fields"), record("request", "q", b"GET / HTTP/1.0\r\n\r\n", **http),
             record("response", "p", b"HTTP/1.0 200 OK\r\n\r\nbody", WARC_Concurrent_To="<urn:q>", **http),
             record("metadata", "m", b"via: y\r\n", WARC_Concurrent_To="<urn:p>", Content_Type="application/warc-fields"),
             record("metadata", "lost", b"via: z\r\n", WARC_Concurrent_To="<urn:none>", Content_Type="application/warc-fields")]
    import os

    for name, data in (("plain.warc", b"".join(parts)), ("each.warc.gz", b"".join(gzip.compress(p) for p in parts))):
        path = work_path(spark, "other").removeprefix("file://")
        os.makedirs(path)
        with open(f"{path}/{name}", "wb") as f:
            f.write(data)
        rows = keep(warc.read(spark, "file://" + path, with_payload=True), "records")
        assert rows.count() == 5
        (r,) = warc.assemble(rows).collect()
        assert bytes(r.payload) == b"body" and r.requests[0].record_id == "<urn:q>" and r.metadata[0].fields == {"via": "y"}


def test_cut_off_record_is_refused():
    import pytest

    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


def test_empty(spark):
    assert captures(spark, []).count() == 0
