"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

A response gives two records. The metadata record (JSON) keeps the source's WARC header, its HTTP status and header,
title, language and links; the conversion record is the text of the page. Both name the response in WARC-Refers-To
and the conversion is named in the metadata, so either leads to the others. Digests are SHA-1 in base 32, as crawls
write them: of the block of each record, and of the payload (the HTTP body) that both derive from. Record ids are
UUIDs derived from the source's id, so a task that runs again writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, text_batches

VERSION = b"WARC/1.1"
#: Pages carry no time of capture; their records have this one.
NO_DATE = "1970-01-01T00:00:00Z"
SCHEMA = "id long, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, block_digest string, payload_digest string, source_digest string, content_length long, block string, record binary"

# Every pattern takes what it began up to its end or that of the page, so a page is read once, whatever isn't closed.
_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\b[^>]*(?:>|\Z)|\Z)|<!doctype[^>]*(?:>|\Z)")
_BREAK = re.compile(r"(?i)<(?:/?(?:p|div|article|section|nav|header|footer|aside|main|ul|ol|li|table|tr|td|th|h[1-6]|pre|blockquote|form|figure|dl|dt|dd|hr)|br)\b[^>]*(?:>|\Z)")
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")
_LINK_TAG = re.compile(r"(?i)<(a|link|img|script|iframe)\b[^>]*(?:>|\Z)")
_TARGET = re.compile(r"""(?is)\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([A-Za-z-]+)""")
_HTML, _HEAD, _HEAD_END, _TITLE, _TITLE_END = (re.compile(f"(?i){p}") for p in (r"<html\b[^>]*", r"<head\b", r"</head\b[^>]*(?:>|\Z)|(?=<body\b)", r"<title\b[^>]*>", r"</title\b[^>]*(?:>|\Z)"))
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of a file in pieces of about 1 MB; gzip members are inflated one after the other."""
    piece = 1 << 20
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), piece):
            yield data[at : at + piece]
        return
    at, member = 0, zlib.decompressobj(31)
    try:
        while at < len(data):
            chunk = data[at : at + piece]
            at += len(chunk)
            while chunk:
                out = member.decompress(chunk, piece)
                if out:
                    yield out
                chunk = member.unconsumed_tail
                if member.eof:
                    chunk, member = member.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
    except zlib.error:
        return  # a broken member ends the file; the records before it count


def read_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(header fields in order, block) of each record of a WARC file's bytes, gzipped or not.

    Records are read one after the other, so only one is held inflated. A record that is cut off is left out."""
    pieces, buffer = _inflated(data), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        buffer.extend(piece or b"")
        return piece is not None

    while True:
        while (at := buffer.find(b"WARC/1.")) < 0:
            del buffer[:-6]
            if not more():
                return
        del buffer[:at]
        while (end := buffer.find(b"\r\n\r\n")) < 0 and len(buffer) < 1 << 22:
            if not more():
                return
        if end < 0:  # no header is so long
            del buffer[:7]
            continue
        fields = [line.split(":", 1) for line in buffer[:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line]
        headers = [(k.strip(), v.strip()) for k, v in fields]
        size = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isdigit()), 0)
        while len(buffer) < end + 4 + size:
            if not more():
                return
        yield [h for h in headers if h[0].lower() != "content-length"], bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        except ValueError:
            return body if not out else b"".join(out)  # it isn't chunked after all, or broken from here on
        if size <= 0:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def decoded(http: list[list[str]], payload: bytes) -> bytes:
    """The body without its transfer and content encodings: chunks, gzip, deflate. What is broken is read as far as it
    goes; with any other encoding there is no text, so it is empty."""
    fields: dict[str, str] = {}
    for k, v in http:
        fields[k.lower()] = v.lower()
    if "chunked" in fields.get("transfer-encoding", ""):
        payload = _dechunked(payload)
    for coding in reversed([c.strip() for c in fields.get("content-encoding", "").split(",") if c.strip() and c.strip() != "identity"]):
        if coding in ("gzip", "x-gzip") and payload[:2] != b"\x1f\x8b":
            continue  # kept inflated, as some crawls do
        if coding not in ("gzip", "x-gzip", "deflate"):
            return b""
        out = b""
        for bits in (31,) if coding != "deflate" else (15, -15):
            reader = zlib.decompressobj(bits)
            parts = []
            try:
                for at in range(0, len(payload), 65536):
                    parts.append(reader.decompress(payload[at : at + 65536]))
            except zlib.error:
                pass
            out = b"".join(parts)
            if out:
                break
        payload = out
    return payload


def plain_text(page: str) -> str:
    """The visible text: blocks on lines of their own, white space collapsed, no scripts, styles, comments or head.

    The first head ends at its end tag or where the body begins; without either only its title is left out."""
    body = _HIDDEN.sub(" ", page)
    head = _HEAD.search(body)
    end = _HEAD_END.search(body, head.end()) if head else None
    if end:
        body = f"{body[: head.start()]}\n{body[end.end() :]}"
    elif title := _TITLE.search(body):
        end = _TITLE_END.search(body, title.end())
        body = f"{body[: title.start()]} {body[end.end() if end else title.end() :]}"
    body = html.unescape(_TAG.sub("", _BREAK.sub("\n", body)))
    return _LINES.sub("\n", _SPACE.sub(" ", body)).strip()


def derive(headers: list[tuple[str, str]], block: bytes) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    source = dict((k.lower(), v) for k, v in headers)
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    http = [[k.strip(), v.strip()] for k, _, v in (line.partition(":") for line in lines[1:]) if k]
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = re.search(r"charset=\"?([\w-]+)", kind)
    body = decoded(http, payload)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    uri, date = source.get("warc-target-uri", ""), source.get("warc-date", NO_DATE)
    own = source.get("warc-record-id") or record_id("unnamed", uri, date, digest(block))
    of_payload = source.get("warc-payload-digest") or digest(payload)
    ids = {kind: record_id(own, kind) for kind in ("metadata", "conversion")}
    visible = _HIDDEN.sub(" ", page)
    title, root = _TITLE.search(visible), _HTML.search(visible)
    title_end = _TITLE_END.search(visible, title.end()) if title else None
    lang = _LANG.search(root[0]) if root else None
    links = []
    for tag in _LINK_TAG.finditer(visible):
        m = _TARGET.search(tag[0])
        if not m:
            continue
        target = html.unescape(m[1] or m[2] or m[3] or "").strip()
        try:
            links.append({"path": tag[1].lower(), "url": urljoin(uri, target)})
        except ValueError:
            links.append({"path": tag[1].lower(), "url": target})
    meta = {
        "WARC-Header": [list(h) for h in headers], "HTTP-Status": lines[0], "HTTP-Header": http, "Payload-Digest": of_payload, "Payload-Length": len(payload),
        "Conversion": ids["conversion"], "Title": html.unescape(visible[title.end() : title_end.start()]).strip() if title_end else None, "Lang": lang[1].lower() if lang else None, "Links": links,
    }
    blocks = {"metadata": ("application/json", json.dumps(meta, ensure_ascii=False)), "conversion": ("text/plain; charset=utf-8", plain_text(page))}
    out = []
    for name, (content, text) in blocks.items():
        data = text.encode("utf-8", "surrogatepass")
        other = ids["conversion" if name == "metadata" else "metadata"]
        fields = [("WARC-Type", name), ("WARC-Record-ID", ids[name]), ("WARC-Refers-To", own), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", other), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", of_payload), ("WARC-Block-Digest", digest(data)), ("Content-Type", content)]
        out.append({"warc_type": name, "record_id": ids[name], "refers_to": own, "concurrent_to": other, "target_uri": uri, "warc_date": date, "block_digest": digest(data), "payload_digest": of_payload, "source_digest": source.get("warc-block-digest") or digest(block), "content_length": len(data), "block": text, "record": write_record(fields, data)})
    return out


def response_of(page_id: int | None, url: str | None, page: str | None) -> tuple[list[tuple[str, str]], bytes]:
    """A response record for a page that was kept without one."""
    uri = re.sub(r"[\r\n]+", " ", url or "")
    body = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), uri)), ("WARC-Target-URI", uri), ("WARC-Date", NO_DATE), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return headers, block


def _table(rows: list[dict], kind=None):
    import pyarrow as pa

    kind = kind or pa.int64()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"id": kind, "content_length": pa.int64(), "record": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


def _from_pages(batches) -> Iterator:
    for b in text_batches(batches, 2):
        ids, urls, pages = (b.column(i).to_pylist() for i in range(3))
        for lo in range(0, len(ids), 200):
            rows = [r | {"id": i} for i, u, p in zip(ids[lo : lo + 200], urls[lo : lo + 200], pages[lo : lo + 200]) for r in derive(*response_of(i, u, p))]
            if rows:
                yield _table(rows, b.column(0).type)


def _from_files(batches) -> Iterator:
    for b in batches:
        for data in b.column(0).to_pylist():
            rows = []
            for n, (headers, block) in enumerate(read_records(data)):
                if dict((k.lower(), v) for k, v in headers).get("warc-type") == "response":
                    rows += [r | {"id": n} for r in derive(headers, block)]
                if len(rows) >= 400:
                    yield _table(rows)
                    rows = []
            if rows:
                yield _table(rows)


def derivatives_of_pages(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Two rows for each page, its metadata and its conversion record, with their fields and bytes (``SCHEMA``).

    A null url is empty and a null page an empty payload: both still give two records. Equal rows give equal records.
    Very long pages are read whole, in linear time. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[page_id].dataType.simpleString()
    return df.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("page")).mapInArrow(_from_pages, SCHEMA.replace("id long", f"id {kind}", 1))


def derivatives_of_files(spark: SparkSession, path: str) -> DataFrame:
    """The same from WARC files (.warc, .warc.gz); ``id`` is the record's number in its file.

    A task holds one file as it is stored and one record inflated, so files may have up to 1 GB, as crawls make them.
    Records that aren't responses, cut off or behind a broken gzip member give no rows; missing header fields are
    empty, and a response without an id is known by the hash of its block. An empty folder gives no rows.
    """
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_from_files, SCHEMA)
