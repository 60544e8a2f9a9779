"""WARC derivatives (operator 7).

Response records become two linked derivatives each: a metadata record (JSON
envelope: the response's WARC and HTTP headers, title, links and digests) and a
conversion record (plain text).  Both carry ``WARC-Refers-To`` with the
response's id and its target URI and date; the metadata record is
``WARC-Concurrent-To`` the conversion record.  Ids are version-5 UUIDs of the
response's id and the record type, so a rerun after a lost executor gives the
same records.  Digests are SHA-1 in base 32, as the format has them.

Records are independent: one pass over the rows, no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal
from .html import Page

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
VERSION = "WARC/1.1"
MEMBER = b"\x1f\x8b\x08"  # how a gzip member starts
#: Codecs of Python that are no charsets of pages.
NO_CHARSETS = frozenset("idna punycode undefined unicode_escape raw_unicode_escape".split())
#: A rooted link whose segments need no resolving.
ROOTED = re.compile(r"(?:/[^/?#;\\\x00-\x20.][^/?#;\\\x00-\x20]*)+")
BASE32 = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
RECORD = ("page_id long, record_id string, warc_type string, refers_to string, concurrent_to string, target_uri string, "
          "warc_date string, source_payload_digest string, block_digest string, content_length long, record binary")
RESPONSE = "record_id string, warc_type string, target_uri string, warc_date string, headers map<string,string>, block binary"


def digest(data: bytes) -> str:
    """SHA-1 in base 32: ten bits are two characters."""
    n = int.from_bytes(hashlib.sha1(data).digest(), "big")
    return "sha1:" + "".join([BASE32[n >> s & 1023] for s in range(150, -1, -10)])


def record_id(of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, of)}>"


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    """A record's bytes.  Line ends inside a value would end the header and are
    written as blanks."""
    lines = [VERSION]
    for k, v in headers.items():
        if v is not None:
            lines.append(f"{k}: " + v.replace("\r", " ").replace("\n", " "))
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def field(headers: dict[str, str], name: str) -> str | None:
    """A header's value; names have no case."""
    if name in headers:
        return headers[name]
    name = name.lower()
    return next((v for k, v in headers.items() if k.lower() == name), None)


def parse_records(data: bytes):
    """(headers, block) of each record of an uncompressed WARC; a record whose
    length passes the end of the data is given as far as it goes."""
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", at)
        if at < 0 or end < 0:
            return
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                headers[name.strip()] = value.strip()
        size = field(headers, "Content-Length") or ""
        size = int(size) if size.isascii() and size.isdigit() and len(size) < 19 else 0
        yield headers, data[end + 4: end + 4 + size]
        at = end + 4 + size


def inflate(data: bytes, step: int = 1 << 16) -> bytes:
    """All gzip members of a .warc.gz, or the bytes themselves.  A member that
    breaks off or is damaged is given as far as it goes, and what follows is read
    from the next member's first bytes.  Members are fed in steps, so that the
    rest of the file is not copied for each of them."""
    if data[:2] != MEMBER[:2]:
        return data
    parts, at, view = [], 0, memoryview(data)
    while data[at: at + 2] == MEMBER[:2]:
        member, start = zlib.decompressobj(31), at
        try:
            while at < len(data) and not member.eof:
                fed = view[at: at + step]
                parts.append(member.decompress(fed))
                at += len(fed) - len(member.unused_data)
            parts.append(member.flush())
        except zlib.error:
            at = data.find(MEMBER, max(at, start + 1))
            if at < 0:
                break
    return b"".join(parts)


def unchunked(body: bytes) -> bytes:
    """A body without its chunked transfer coding; one that has none (archives
    keep the header of bodies they have decoded) as it is, one that breaks off
    as far as it goes."""
    parts, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;.*)?", body[at:end] if 0 <= end < at + 4096 else b"")
        if not size:
            return b"".join(parts) + body[at:]
        if not int(size[1], 16):
            break
        at, size = end + 2, int(size[1], 16)
        parts.append(body[at: at + size])
        at += size
        if body[at: at + 2] not in (b"\r\n", b"\r", b""):
            return b"".join(parts) + body[at:]
        at += 2
    return b"".join(parts)


def decoded(body: bytes, coding: str) -> bytes:
    """A body without one content coding, as far as it goes; one that is not so
    coded (or by an unknown coding) as it is."""
    coding = coding.removeprefix("x-")
    if coding == "gzip":
        return inflate(body)
    if coding == "deflate":
        for bits in (15, -15):  # with the zlib header, and as some servers send it
            try:
                whole = zlib.decompressobj(bits)
                return whole.decompress(body) + whole.flush()
            except zlib.error:
                pass
    if coding in ("br", "zstd"):
        try:
            return pa.CompressedInputStream(pa.BufferReader(body), {"br": "brotli"}.get(coding, coding)).read()
        except (OSError, ValueError, pa.ArrowException):
            pass
    return body


def entity(pairs: list[tuple[str, str]], payload: bytes) -> tuple[bytes, bytes]:
    """The body without transfer coding, and without content codings too."""
    codings = {name: [x.strip().lower() for k, v in pairs if k.lower() == name for x in v.split(",")]
               for name in ("transfer-encoding", "content-encoding")}
    for coding in reversed(codings["transfer-encoding"]):
        payload = unchunked(payload) if coding == "chunked" else decoded(payload, coding)
    plain = payload
    for coding in reversed(codings["content-encoding"]):
        plain = decoded(plain, coding)
    return payload, plain


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response block; a block
    without a header end is all payload."""
    head, end, payload = block.partition(b"\r\n\r\n")
    if not end or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("iso-8859-1").split("\r\n")
    pairs = [tuple(x.strip() for x in line.split(":", 1)) for line in lines[1:] if ":" in line]
    return lines[0], pairs, payload


def resolve(base: str | None, links: list[str]) -> list[str]:
    """Absolute forms of a page's links; one that cannot be resolved as it is."""
    try:
        root = urlsplit(base or "")
        root = f"{root.scheme}://{root.netloc}" if root.scheme in ("http", "https") and root.netloc else None
    except ValueError:
        root = None
    out = []
    for link in links:
        if root and ROOTED.fullmatch(link):
            out.append(root + link)
            continue
        try:
            out.append(urljoin(base or "", link))
        except ValueError:
            out.append(link)
    return out


def derive(source: dict[str, str], block: bytes, digests: tuple[str, str] | None = None) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and the conversion record of a response.  ``digests`` are
    those of the block and of its payload, where they are known."""
    status, pairs, sent = http_parts(block)
    payload, plain = entity(pairs, sent)
    own = digests[0] if digests else digest(block)
    entity_digest = digests[1] if digests and payload is sent else digest(payload)
    kind = next((v for k, v in pairs if k.lower() == "content-type"), "")
    charset = CHARSET.search(kind)
    charset = charset[1] if charset and charset[1].lower().replace("-", "_") not in NO_CHARSETS else "utf-8"
    try:
        html = plain.decode(charset, "replace")
    except (LookupError, ValueError):  # no such charset, or a codec that is none of texts
        html = plain.decode("utf-8", "replace")
    of, uri, date = (field(source, k) for k in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    of = of or record_id(f"{uri} {date} {own}")
    ids = {t: record_id(f"{of} {t}") for t in ("metadata", "conversion")}
    page = Page(html)
    links = [{"path": "A@/href", "url": url} for url in resolve(uri, page.links)]
    envelope = {"Envelope": {
        "WARC-Header-Metadata": source, "Payload-Metadata": {
            "Actual-Content-Type": kind, "HTTP-Response-Metadata": {
                "Response-Message": {"Status-Line": status}, "Headers": [list(p) for p in pairs],
                "HTML-Metadata": {"Head": {"Title": page.title}, "Links": links},
                "Entity-Length": len(payload), "Entity-Digest": entity_digest}},
        "Block-Digest": own}}
    made = []
    for t, body, media in (("metadata", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace"), "application/json"),
                           ("conversion", "\n".join(t for _, _, t in page.blocks).encode("utf-8", "replace"), "text/plain")):
        made.append(({"WARC-Type": t, "WARC-Record-ID": ids[t], "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Refers-To": of,
                      "WARC-Concurrent-To": ids["conversion"] if t == "metadata" else None,
                      "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date,
                      "WARC-Block-Digest": digest(body), "Content-Type": media, "Content-Length": str(len(body))}, body))
    return made


def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages: (page_id, headers, block).  The
    id is made from the page's id and url.  Null html is an empty payload."""
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    page, url = F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`").cast("string")
    return pages.select(page.alias("page_id"), url.alias("url"), html.alias("html"), F.lit(date).alias("date"))


def _responses(batches):
    """Rows of ``page_responses`` -> (page_id, headers, block)."""
    for page, url, html, date in batches:
        payload = html.encode("utf-8", "replace")
        block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload
        yield page, {"WARC-Type": "response", "WARC-Record-ID": record_id(f"{page} {url}"), "WARC-Target-URI": url, "WARC-Date": date,
                     "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block),
                     "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}, block


def _rows(made) -> pa.RecordBatch:
    types = (pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary())
    names = [part.split()[0] for part in RECORD.split(", ")]
    columns = zip(*made) if made else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _derived(page, source, block, digests=None):
    for headers, body in derive({k: v for k, v in source.items() if v is not None}, block, digests):
        yield (page, headers["WARC-Record-ID"], headers["WARC-Type"], headers["WARC-Refers-To"], headers["WARC-Concurrent-To"],
               headers["WARC-Target-URI"], headers["WARC-Date"], field(source, "WARC-Payload-Digest"), headers["WARC-Block-Digest"],
               len(body), serialise(headers, body))


def page_derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                     date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The derivatives of a table of pages, two rows a page.

    A null url gives records without a target; null or empty html gives an
    empty text and an envelope without links.  Repeated rows give the same
    records again.  Extra columns are ignored; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = zip(*(c.to_pylist() for c in batch.slice(k, 64).columns))
                yield _rows([r for page, source, block in _responses(rows)
                             for r in _derived(page, source, block, (source["WARC-Block-Digest"], source["WARC-Payload-Digest"]))])

    return page_responses(pages, id_col, url_col, html_col, date).mapInArrow(frugal(run), RECORD)


def read_responses(spark: SparkSession, path: str, batch_bytes: int = 16 << 20) -> DataFrame:
    """Response records of .warc and .warc.gz files under ``path``; a file is
    read and inflated by one task, which passes on batches of about
    ``batch_bytes`` of blocks, whatever the file holds.  Records of other types are left out; a missing header is
    null, a record that breaks off is given as far as it goes, an empty file has
    no records, and a file that is there twice is read twice."""

    types = (*[pa.string()] * 4, pa.map_(pa.string(), pa.string()), pa.binary())
    names = [part.split()[0] for part in RESPONSE.split(", ")]

    def batched(found: list) -> pa.RecordBatch:
        columns = zip(*found) if found else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                found, held = [], 0
                for h, block in parse_records(inflate(cell.as_py() or b"")):
                    if field(h, "WARC-Type") == "response":
                        found.append((*(field(h, f"WARC-{x}") for x in ("Record-ID", "Type", "Target-URI", "Date")), list(h.items()), block))
                        held += len(block)
                    if held >= batch_bytes:
                        yield batched(found)
                        found, held = [], 0
                yield batched(found)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(frugal(run), RESPONSE)


def response_derivatives(responses: DataFrame) -> DataFrame:
    """The derivatives of response records (``headers``, ``block``); page_id is
    null.  Null headers and blocks count as empty."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = zip(*(c.to_pylist() for c in batch.slice(k, 64).columns))
                yield _rows([r for headers, block in rows for r in _derived(None, dict(headers or ()), block or b"")])

    return responses.select("headers", "block").mapInArrow(frugal(run), RECORD)
