"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

A response record holds its own headers and an HTTP message. From it come
  metadata    application/warc-fields: the HTTP status and headers, the source's own record
              headers and digests and whether they hold, title, language, charset and outlinks
  conversion  text/plain: the visible text, one line per block
Both keep the source's target URI and date, refer to it by WARC-Refers-To, name each other by
WARC-Concurrent-To, and carry digests of their own blocks. Their ids are made from the source's id
and the kind, so a repeated run gives the same records.

Records that are not responses have no derivatives. A response whose HTTP message cannot be read
has a metadata record that says why and an empty conversion record; a null or broken record gives
one too, with an empty Refers-To. Undecodable bytes become replacement characters. Repeated rows
give repeated records; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frames import column, per_batch, rows_of

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
#: what metadata keeps of the source record, under the name with Source- put in front
KEPT = ("WARC-Payload-Digest", "WARC-Block-Digest", "WARC-IP-Address", "WARC-Identified-Payload-Type",
        "WARC-Warcinfo-ID", "WARC-Truncated", "Content-Type", "Content-Length")

_HIDDEN = re.compile(r"<(script|style|noscript|template|title|textarea|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
_BREAKS = re.compile(
    r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|h[1-6]|article|section|header|footer|nav|aside|main|form|blockquote|"
    r"pre|figure|figcaption|address|option|head|body|html|td|th)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^>]*>")
_SPACES = re.compile(r"[^\S\n]+")
# a tag ends at the next bracket of either kind, so no start is followed to the end of the page again and again
_TITLE = re.compile(r"<title[^<>]*>", re.I)
_TITLE_END = re.compile(r"</title", re.I)
_LANG = re.compile(r"<html[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_META_CHARSET = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_HREF = re.compile(r"<a\s[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LINE_ENDS = re.compile(r"[\r\n]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    """Header lines, folded ones joined to the line before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def _get(fields: list[tuple[str, str]], name: str) -> str:
    return next((v for k, v in fields if k.lower() == name.lower()), "")


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record; ValueError if it is none."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = _fields(lines[1:])
    length = _get(fields, "Content-Length")
    if not length.isascii() or not length.isdigit():
        raise ValueError("no Content-Length")
    if len(rest) < int(length):
        raise ValueError("the block is shorter than Content-Length")
    return fields, rest[: int(length)]


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bytes]:
    """Status line, headers, payload as sent and decoded body of an HTTP message."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("HTTP/"):
        raise ValueError("no HTTP message")
    fields, body = _fields(lines[1:]), payload
    if _get(fields, "Transfer-Encoding").lower() == "chunked":
        body = _dechunked(body)
    coding = _get(fields, "Content-Encoding").lower()
    if coding in ("gzip", "x-gzip"):
        body = gzip.decompress(body)
    elif coding == "deflate":
        body = zlib.decompress(body)
    elif coding not in ("", "identity"):
        raise ValueError(f"content coding {coding}")
    return lines[0], fields, payload, body


def _decoded(body: bytes, content_type: str) -> tuple[str, str]:
    named = _CHARSET.search(content_type)
    within = _META_CHARSET.search(body[:4096])  # where a page may declare it
    charset = named[1] if named else within[1].decode("ascii", "replace") if within else "utf-8"
    try:
        return body.decode(charset, "replace"), charset.lower()
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace"), "utf-8"


def _open_at_end(html: str) -> bool:
    """Whether a hidden element or comment is still open at the end."""
    last = None
    for last in _HIDDEN.finditer(html):
        pass
    if last is None or last.end() < len(html):
        return False
    end = rf"</{last[1]}\s*>\Z" if last[1] else r"-->\Z"
    return re.search(end, last[0][-4096:], re.I) is None


def visible_text(html: str) -> str:
    """Text outside scripts and the like, one line per block, white space inside lines joined."""
    # no tag ends after the last bracket: what follows is text, up to an open comment, and is not searched for tags
    at = html.rfind(">") + 1
    shown = _HIDDEN.sub(" ", html[:at])
    rest = "" if _open_at_end(html[:at]) else html[at:].split("<!--")[0]
    text = _TAG.sub("", _BREAKS.sub("\n", _LINE_ENDS.sub(" ", shown))) + _LINE_ENDS.sub(" ", rest)
    lines = (" ".join(x.split()) for x in unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def _one_line(text: str) -> str:
    return " ".join(text.split())


Derived = dict[str, object]


def _title(html: str) -> str | None:
    """What stands between the first title's tags."""
    start = _TITLE.search(html)
    end = _TITLE_END.search(html, start.end()) if start else None
    return html[start.end() : end.start()] if start and end else None


def derive(data: bytes | None) -> Iterator[Derived]:
    """The derivative records of one record."""
    fields: list[tuple[str, str]] = []
    try:
        fields, block = parse(data or b"")
        if _get(fields, "WARC-Type").lower() != "response":
            return
        status, headers, payload, body = http(block)
        fault = ""
    except (ValueError, OSError, EOFError, zlib.error) as error:
        fault, status, headers, payload, body, block = str(error), "", [], b"", b"", b""
    source, uri = _get(fields, "WARC-Record-ID"), _get(fields, "WARC-Target-URI")
    date = _get(fields, "WARC-Date") or DATE
    content_type = _get(headers, "Content-Type")
    html, charset = _decoded(body, content_type)
    kind = content_type.split(";")[0].strip().lower()
    is_html = kind in ("", "text/html", "application/xhtml+xml")
    is_text = is_html or kind.startswith("text/")
    text = visible_text(html) if is_html else html if is_text else ""
    lines = [("HTTP-Status", status)] if status else []
    lines += [(f"HTTP-{k}", v) for k, v in headers]
    lines += [(f"Source-{k}", _get(fields, k)) for k in KEPT if _get(fields, k)]
    for name, given, of in (("Payload", _get(fields, "WARC-Payload-Digest"), payload), ("Block", _get(fields, "WARC-Block-Digest"), block)):
        if given.lower().startswith("sha1:"):
            lines.append((f"{name}-Digest-Holds", str(digest(of) == f"sha1:{given[5:].upper()}").lower()))
    if is_html and html:
        language = _LANG.search(html)
        for name, found in (("Title", _title(html)), ("Language", language and language[1])):
            if found is not None:
                lines.append((name, _one_line(unescape(found))))
        lines.append(("Charset", charset))
        lines += [("Outlink", _one_line(unescape(next(filter(None, x), "")))) for x in _HREF.findall(html)]
    if fault:
        lines.append(("Fault", fault))
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "replace")),
        "conversion": ("text/plain; charset=utf-8", text.encode("utf-8", "replace")),
    }
    seed = source or hashlib.sha1(data or b"").hexdigest()
    ids = {name: record_id(seed, name) for name in blocks}
    for name, (type_, out) in blocks.items():
        other = ids["conversion" if name == "metadata" else "metadata"]
        head = [("WARC-Type", name), ("WARC-Record-ID", ids[name]), ("WARC-Date", date), ("WARC-Target-URI", uri),
                ("WARC-Refers-To", source), ("WARC-Concurrent-To", other), ("WARC-Block-Digest", digest(out)),
                ("Content-Type", type_)]
        yield {
            "record_type": name, "record_id": ids[name], "refers_to": source, "concurrent_to": other,
            "target_uri": uri, "date": date, "content_type": type_, "block_digest": digest(out),
            "source_payload_digest": _get(fields, "WARC-Payload-Digest"), "n_bytes": len(out),
            "record": record([(k, v) for k, v in head if v], out),
        }


def response(uri: str, html: str, date: str = DATE) -> bytes:
    """A response record of a page."""
    payload = html.encode()
    message = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id(uri, digest(payload))), ("WARC-Date", date),
        ("WARC-Target-URI", _LINE_ENDS.sub(" ", uri)), ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(message + payload)), ("Content-Type", "application/http; msgtype=response"),
    ], message + payload)


_OUT = pa.schema([
    *((c, pa.string()) for c in ("record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date",
                                 "content_type", "block_digest", "source_payload_digest")),
    ("n_bytes", pa.int64()), ("record", pa.binary()),
])
_KINDS = ", ".join(f"{f.name} {({'string': 'string', 'int64': 'long', 'binary': 'binary'})[str(f.type)]}" for f in _OUT)


def responses(pages: DataFrame, html: str = "html", url: str = "url", id_column: str = "page_id") -> DataFrame:
    """page_id and a response record for each page; a null page or address counts as empty."""
    schema = pa.schema([("page_id", pa.int64()), ("record", pa.binary())])

    def make():
        def columns(batch):
            made = [response(u or "", h or "") for u, h in zip(rows_of(batch, "url"), rows_of(batch, "html"))]
            return {"page_id": rows_of(batch, "page_id"), "record": made}
        return columns

    rows = pages.select(
        column(id_column).cast("long").alias("page_id"), column(url).cast("string").alias("url"), column(html).alias("html")
    )
    return rows.mapInArrow(per_batch(make, schema), "page_id long, record binary")


def derivatives(records: DataFrame, keep: tuple[str, ...] = (), record_column: str = "record") -> DataFrame:
    """The derivative records of the column ``record_column``, each with the columns ``keep`` of
    its source row in front."""
    rows = records.select(*[column(c).alias(f"kept_{k}") for k, c in enumerate(keep)], column(record_column).alias("source"))
    kept = [rows.schema[f"kept_{k}"] for k in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, d) for k, x in enumerate(rows_of(batch, "source")) for d in derive(x)]
            at = pa.array([k for k, _ in found], pa.int64())
            names = [*(f.name for f in kept), *_OUT.names]
            arrays = [batch.column(batch.schema.get_field_index(f.name)).take(at) for f in kept]
            arrays += [pa.array([d[f.name] for _, d in found], f.type) for f in _OUT]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept) + _KINDS
    out = rows.mapInArrow(run, kinds)
    return out.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], *_OUT.names)
