import base64
import gzip
import hashlib

import pytest

from riskloom.llm import warc


def sha1(x):
    return "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_derivatives_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = warc.responses(pages)
    sources = {r.page_id: warc.parse(bytes(r.record)) for r in made.collect()}
    html = {r.page_id: r for r in pages.collect()}
    got = warc.derivatives(made, ("page_id",)).collect()
    assert len(got) == 2 * len(html)
    by_page = {}
    for r in got:
        by_page.setdefault(r.page_id, {})[r.record_type] = r
    for page, pair in by_page.items():
        fields, block = sources[page]
        named = dict(fields)
        assert block.endswith(html[page].html.encode()) and named["WARC-Target-URI"] == html[page].url
        assert named["WARC-Payload-Digest"] == sha1(html[page].html.encode()) and named["WARC-Block-Digest"] == sha1(block)
        for kind, r in pair.items():
            own, out = warc.parse(bytes(r.record))
            own = dict(own)
            assert own["WARC-Type"] == kind and own["WARC-Refers-To"] == named["WARC-Record-ID"] == r.refers_to
            assert own["WARC-Block-Digest"] == sha1(out) == r.block_digest and r.n_bytes == len(out)
            assert own["WARC-Date"] == named["WARC-Date"] and own["WARC-Target-URI"] == html[page].url
        assert pair["metadata"].concurrent_to == pair["conversion"].record_id
        assert pair["conversion"].concurrent_to == pair["metadata"].record_id
        meta = warc.parse(bytes(pair["metadata"].record))[1].decode()
        assert f"Source-WARC-Payload-Digest: {named['WARC-Payload-Digest']}\r\n" in meta
        assert "Payload-Digest-Holds: true\r\n" in meta and "HTTP-Content-Type: text/html; charset=utf-8\r\n" in meta
        assert meta.count("Outlink: ") == html[page].html.count("<a href=")
        text = warc.parse(bytes(pair["conversion"].record))[1].decode()
        assert "<" not in text.replace("< ", "") and "track(" not in text and text
    assert len({r.record_id for r in got}) == len(got)


def one(message, digest=None):
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>"), ("WARC-Target-URI", "http://a/")]
    if digest:
        head.append(("WARC-Payload-Digest", digest))
    return {d["record_type"]: warc.parse(d["record"])[1].decode() for d in warc.derive(warc.record(head, message))}


def test_codings_and_charsets():
    body = "<html lang=fr><title>T &amp;\n u</title><p>é<br>b  c</p><script>x</script></html>"
    packed = gzip.compress(body.encode("latin-1"))
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (packed[:7], packed[7:])) + b"0\r\n\r\n"
    message = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html;\r\n charset=ISO-8859-1\r\nContent-Encoding: gzip\r\n"
               b"Transfer-Encoding: chunked\r\n\r\n" + chunked)
    got = one(message, sha1(chunked))
    assert got["conversion"] == "é\nb c"
    assert "Title: T & u\r\nLanguage: fr\r\nCharset: iso-8859-1\r\n" in got["metadata"]
    assert "Payload-Digest-Holds: true" in got["metadata"]
    assert "Payload-Digest-Holds: false" in one(message, sha1(b"other"))["metadata"]


def test_broken_and_other_records():
    for bad in (b"nothing", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nxx", b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\nx",
                b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz"):
        got = one(bad)
        assert got["conversion"] == "" and "Fault: " in got["metadata"]
    image = one(b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG<a href=x>")
    assert image["conversion"] == "" and "Outlink" not in image["metadata"]
    assert list(warc.derive(warc.record([("WARC-Type", "request")], b"x"))) == []
    for data in (None, b"", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab", b"WARC/1.1\r\n\r\nab"):
        assert [d["record_type"] for d in warc.derive(data)] == ["metadata", "conversion"]


def test_nulls_repeats_and_empty_tables(spark):
    kinds = "page_id long, url string, html string"
    rows = [(1, None, None), (None, "u", "<p>x"), (2, "u", "<p>x" * 30_000), (2, "u", "<p>x" * 30_000)]
    got = warc.derivatives(warc.responses(spark.createDataFrame(rows, kinds)), ("page_id",)).collect()
    assert len(got) == 8 and len({r.record_id for r in got}) == 6
    assert warc.derivatives(warc.responses(spark.createDataFrame([], kinds)), ("page_id",)).count() == 0


@pytest.mark.parametrize("html", ["<title>" * 40_000, "<a " * 80_000, '<a href="' * 30_000, "<html " * 40_000])
def test_hostile_pages_take_linear_time(html):
    import time

    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + html.encode()
    whole = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], block)
    began = time.process_time()
    assert len(list(warc.derive(whole))) == 2
    assert time.process_time() - began < 5
