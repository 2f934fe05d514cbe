"""WARC derivatives: from response records to linked metadata and conversion records.

``responses`` makes response records of pages, or takes those of a WARC file
(``read_warc``) as they are. For each one a ``metadata`` record
(application/warc-fields: title, language, character set, outlinks, the
source's HTTP headers) and a ``conversion`` record (text/plain) are built.
Both name the response in WARC-Refers-To, keep its target URI, date and
payload digest, and carry a block digest of their own. ``archive`` writes the
response records with what refers to them.

Defined cases: a null html is an empty payload (its conversion is empty); a
null url gives records without WARC-Target-URI; an empty table gives no rows;
repeated rows give equal records; columns date (string), http (array of name
and value), source_id (string), payload_digest (string), head (binary: the HTTP
status line and headers) and payload (binary) are used where they aren't null, and a fixed date, two made-up headers, an invented id and the
SHA-1 of the payload stand for them otherwise; other columns are ignored.
Every page is converted whole. A record of a WARC file without a whole number
as its length is passed over; a torn last one ends the file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as htmllib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote, urljoin

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import slices

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: RFC 4122's name space of URLs
DATE = "1970-01-01T00:00:00Z"
_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|head)\b[^<>]*>", re.I)
_ENDS = {"": re.compile("-->")} | {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template", "title")}
_ATTRS = r"""(?:(?:[^<>"']++|"[^"]*"|'[^']*')*+>|[^<>]*>)"""
# Blanks, void elements and stray end tags: what may stand in a head besides elements with content.
_IN_HEAD = re.compile(rf"(?:\s+|<(?:meta|link|base|basefont|bgsound|html|head)\b{_ATTRS}|</(?!(?:head|body|html|br)\b)[a-z][^<>]*>|<[!?](?!--)[^<>]*>)*+", re.I)
_TITLE_OPEN = re.compile(r"<(title)\b[^<>]*>", re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|thead|tbody|section|article|aside|nav|header|footer|main|form|pre|blockquote|figure|figcaption|title|body|html|option|select)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title|\Z)", re.S | re.I)
_LANG = re.compile(r"<html\b[^<>]*\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_CHARSET = re.compile(r"<meta\b[^<>]*\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_LINK = re.compile(r"<(a|area|img|link|iframe)\b[^<>]*?\b(href|src)\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
_FOLD = re.compile(r"\s*[\r\n]+\s*")
_HTTP_END = re.compile(rb"\r?\n\r?\n")
HTTP = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
FIELDS = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, payload_digest string, block_digest string, headers string, content string"


def sha1(b: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def _without_hidden(page: str) -> str:
    """The page without comments, scripts, styles, noscript, templates and its head.

    Unclosed comments, scripts and styles run to the end of the page; an
    unclosed noscript or template hides nothing. A head ends where HTML ends
    it: at its end tag, or else at the first thing that can't stand in a head.
    """
    out, at, unclosed = [], 0, set()

    def after(m: re.Match) -> int:
        kind = (m[1] or "").lower()
        if kind in unclosed:
            return m.end()
        if end := _ENDS[kind].search(page, m.end()):
            return end.end()
        if kind in ("", "script", "style"):
            return len(page)
        unclosed.add(kind)
        return m.end()

    while m := _HIDDEN.search(page, at):
        out.append(page[at : m.start()])
        if (m[1] or "").lower() == "head":
            at = _IN_HEAD.match(page, m.end()).end()
            while inner := _HIDDEN.match(page, at) or _TITLE_OPEN.match(page, at):
                at = _IN_HEAD.match(page, after(inner)).end()
        else:
            at = after(m)
    return " ".join([*out, page[at:]])


def to_text(page: str) -> str:
    """Visible text: one line a block, entities resolved, blanks collapsed. Linear in the page."""
    s = _without_hidden(page)
    s = _BLANK.sub(" ", s.replace("\n", " "))
    s = _TAG.sub("", _BLOCK.sub("\n", s))
    if "&" in s:
        s = htmllib.unescape(s)
    return _LINES.sub("\n", _BLANK.sub(" ", s)).strip()


def about(page: str, url: str | None, http: list[tuple[str, str]]) -> str:
    """The metadata record's block: warc-fields, one a line."""
    out = []
    one = lambda s: " ".join(htmllib.unescape(_TAG.sub("", s)).split())
    for name, m in (("title", _TITLE.search(page)), ("language", _LANG.search(page)), ("charset", _CHARSET.search(page))):
        if m:
            out.append(f"{name}: {one(m[1])}")
    out += [f"http-header: {k}: {v}" for k, v in http]
    for tag, attr, a, b, c in _LINK.findall(page):
        link = htmllib.unescape(a or b or c).strip()
        try:
            link = urljoin(url or "", link)
        except ValueError:
            pass
        out.append(f"outlink: {' '.join(link.split())} {'E' if tag.lower() in ('img', 'iframe', 'link') else 'L'} {tag.lower()}/@{attr.lower()}")
    return "".join(x + "\r\n" for x in out)


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join('' if p is None else str(p) for p in parts))}>"


def header_block(fields: list[tuple[str, str | None]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)


RESPONSE = "page_id long, source_id string, url string, date string, http array<struct<name: string, value: string>>, payload_digest string, html string, head binary, payload binary"


def _unchunked(payload: bytes) -> bytes:
    """The payload without its chunks' sizes; what is no chunk ends it."""
    out, at = [], 0
    while (end := payload.find(b"\r\n", at)) >= 0:
        size = payload[at:end].split(b";")[0].strip()
        if not size or len(size) > 12 or size.strip(b"0123456789abcdefABCDEF") or not int(size, 16):
            break
        n = int(size, 16)
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def decoded(payload: bytes, http: list[tuple[str, str]]) -> str:
    """The page in a payload: chunks and gzip or deflate undone, then decoded by the header's character set, or the page's, or as UTF-8. What can't be undone stays; bytes that are no text become U+FFFD."""
    field = lambda name: " ".join(v for k, v in http if k.lower() == name).lower()
    if "chunked" in field("transfer-encoding"):
        payload = _unchunked(payload) or payload
    if any(x in field("content-encoding") for x in ("gzip", "deflate")):
        unpack = zlib.decompressobj(47)  # either form's header
        try:
            payload = unpack.decompress(payload) + unpack.flush()
        except zlib.error:
            pass
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", field("content-type"))
    meta = _CHARSET.search(payload[:4096].decode("latin-1"))
    for name in [m[1] for m in (named, meta) if m] + ["utf-8"]:
        try:
            return payload.decode(name, "replace")
        except (LookupError, ValueError):
            continue
    return ""


def respond(page_id: int | None, url: str | None, page: str | None, date: str | None = None, http: list[tuple[str, str]] | None = None, source_id: str | None = None, payload_digest: str | None = None, head: bytes | None = None, payload: bytes | None = None) -> tuple:
    """One response record, as a tuple of RESPONSE: what is None is made up. ``head`` (status line, headers and the blank line) and ``payload`` stay as they are."""
    if payload is None:
        body = page or ""
        payload = body.encode("utf-8", "surrogatepass")
    else:
        body = decoded(payload, http or [])
    sha = hashlib.sha1(payload)
    if http is None:
        http = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    if head is None:
        head = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in http) + "\r\n").encode("utf-8", "surrogatepass")
    uri = None if url is None else " ".join(url.split())
    digest = payload_digest or "sha1:" + base64.b32encode(sha.digest()).decode()
    return page_id, source_id or record_id("response", page_id, url, sha.hexdigest()), uri, date or DATE, http, digest, body, head, payload


def derive(page_id: int | None, source: str, uri: str | None, date: str, http: list[tuple[str, str]], digest: str, body: str, *_: object) -> list[tuple]:
    """The two records of one response (a tuple of RESPONSE), as tuples of FIELDS."""
    out = []
    for kind, mime, content in (("metadata", "application/warc-fields", about(body, uri, http)), ("conversion", "text/plain", to_text(body))):
        out.append(_record(page_id, kind, record_id(kind, source), source, uri, date, mime, digest, content))
    return out


def source_record(page_id: int | None, source: str, uri: str | None, date: str, http: list[tuple[str, str]], digest: str, body: str, head: bytes, payload: bytes) -> tuple:
    """The response itself, as a tuple of FIELDS with its block: header and payload byte by byte."""
    block = head + payload
    return *_record(page_id, "response", source, None, uri, date, "application/http; msgtype=response", digest, None, block), block


def _record(page_id: int | None, kind: str, rid: str, refers: str | None, uri: str | None, date: str, mime: str, digest: str, content: str | None, block: bytes | None = None) -> tuple:
    block = content.encode("utf-8", "surrogatepass") if block is None else block
    own = sha1(block)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Refers-To", refers), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", own), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return page_id, kind, rid, refers, uri, date, mime, len(block), digest, own, header_block(fields), content


def _each(pages: DataFrame, make, schema: str, types: list[pa.DataType]) -> DataFrame:
    """make(*response) gives the rows of each page's response; one pass, no shuffle."""
    names = [f.split()[0] for f in re.sub("<.*>", "", schema).split(", ")]
    have = [c for c in ("date", "http", "source_id", "payload_digest", "head", "payload") if c in pages.columns]

    def known(values: tuple) -> dict:
        x = {k: v for k, v in zip(have, values, strict=True) if v is not None}
        if "http" in x:
            x["http"] = [(h["name"], _FOLD.sub(" ", h["value"] or "")) for h in x["http"]]
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                rows = [r for i, u, h, *rest in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in make(*respond(i, u, h, **known(rest)))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return pages.select("page_id", "url", "html", *have).mapInArrow(run, schema)


#: FIELDS of records among which are responses, whose content is null and whose ``block`` is bytes.
BLOCKS = f"{FIELDS}, block binary"
_RECORD_TYPES = [pa.int64() if f.endswith("long") else pa.string() for f in FIELDS.split(", ")]


def responses(pages: DataFrame) -> DataFrame:
    """Response records (RESPONSE) of pages: page_id, url, html, and those of date, http, source_id, payload_digest, head and payload that there are."""
    back = lambda *r: [(*r[:4], [{"name": k, "value": v} for k, v in r[4]], *r[5:])]
    return _each(pages, back, RESPONSE, [pa.int64(), pa.string(), pa.string(), pa.string(), HTTP, pa.string(), pa.string(), pa.binary(), pa.binary()])


def derivatives(pages: DataFrame, sources: bool = False) -> DataFrame:
    """Two rows of FIELDS for each page or response record; with ``sources`` three rows of BLOCKS, the response itself before them."""
    if sources:
        return _each(pages, lambda *r: [source_record(*r), *((*x, None) for x in derive(*r))], BLOCKS, [*_RECORD_TYPES, pa.binary()])
    return _each(pages, derive, FIELDS, _RECORD_TYPES)


def from_warc(records: DataFrame) -> DataFrame:
    """The responses among records of ``read_warc`` (page_id null), as ``responses`` has them: ids, dates, digests, status lines, headers and payloads stay as they are; html is what the payload says (``decoded``)."""
    some = records.where("record_type = 'response'")
    none = F.lit(None)
    own = some.select(none.cast("long").alias("page_id"), F.col("record_id").alias("source_id"), F.col("target_uri").alias("url"), "date", "http", "payload_digest", none.cast("string").alias("html"), "head", "payload")
    return responses(own)


def archive(pages: DataFrame, path: str) -> None:
    """Write the responses of pages and their derivatives as WARC files."""
    write_warc(derivatives(pages, sources=True), path)


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write headers and content as WARC files: the record separator is the writer's line separator, so Spark's committer does the work.

    Files are plain: Spark's writer compresses whole files, not records one by one as readers that seek expect; ``compression`` takes its names.
    """
    block = F.coalesce(F.col("block"), F.col("content").cast("binary")) if "block" in records.columns else F.col("content").cast("binary")
    # Bytes pass through a string column as they are: it is only written.
    value = F.concat(F.concat("headers", F.lit("\r\n")).cast("binary"), block).cast("string")
    records.select(value.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


_PIECE = 1 << 20


def _block(f: BinaryIO, n: int) -> bytes:
    """The next n bytes, or what there is of them: a wrong length takes no memory that its file doesn't fill."""
    parts = []
    while n > 0 and (part := f.read(min(n, _PIECE))):
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def parse(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one WARC file, plain or gzip, given as bytes or as an open file: it is unpacked as it is read, and one record is held at a time. Blocks are taken by Content-Length."""
    f: BinaryIO = io.BufferedReader(io.BytesIO(data) if isinstance(data, bytes) else data, _PIECE)
    if f.peek(2)[:2] == b"\x1f\x8b":
        f = gzip.GzipFile(fileobj=f)
    try:
        while line := f.readline(_PIECE):
            if not line.startswith(b"WARC/"):
                continue
            head: dict[str, str] = {}
            while (line := f.readline(_PIECE)).strip():
                k, _, v = line.decode("utf-8", "replace").partition(":")
                head[k.strip().lower()] = v.strip()
            length = head.get("content-length", "0") or "0"
            if not (line and length.isascii() and length.isdigit() and len(length) < 19):
                continue
            block = _block(f, int(length))
            if len(block) < int(length):
                return
            yield head, block
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def http_message(block: bytes) -> tuple[list[dict[str, str]], bytes, bytes]:
    """Headers (folded lines joined), raw header block (status line to blank line) and payload of an HTTP response."""
    end = _HTTP_END.search(block)
    head, payload = (block[: end.end()], block[end.end() :]) if end else (block, b"")
    out: list[dict[str, str]] = []
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1]["value"] = f"{out[-1]['value']} {line.strip()}".strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append({"name": k.strip(), "value": v.strip()})
    return out, head, payload


#: Schemes of paths that executors open by themselves, without Hadoop's libraries.
STREAMED = ("file", "s3", "s3a", "s3n", "gs", "abfs", "abfss")


def open_file(path: str) -> BinaryIO:
    """A file under one of the schemes STREAMED, to be read from its start."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb", buffering=0)
    system, name = FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{quote(rest, safe='/@:.')}")
    return system.open_input_stream(name, compression=None)


def _parts(records: Iterator[tuple[dict[str, str], bytes]], most: int = 200, size: int = 1 << 25) -> Iterator[list[tuple[dict[str, str], bytes]]]:
    """Records in lists of ``most`` or, where they are large, of about ``size`` bytes."""
    part, held = [], 0
    for r in records:
        part.append(r)
        held += len(r[1])
        if len(part) >= most or held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def read_warc(spark: SparkSession, path: str, opener: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """record_type, record_id, refers_to, target_uri, date, payload_digest, block_digest, content_type, block of all records under path; http, head and payload: headers, raw header block and body of records that are HTTP messages, else null, null and the block.

    A task streams its files and holds one batch of records, whatever the size
    of a file. Executors open them by ``opener`` (path to open file), or by
    ``open_file`` for the schemes STREAMED; without an opener, Spark reads files
    of other schemes (hdfs), whole, and they must be under 2 GB.
    """
    keys = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-block-digest", "content-type"]
    names = ["record_type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "block_digest", "content_type"]
    files = spark.read.format("binaryFile").load(path)
    one = None if opener else files.select("path").first()
    streamed = opener or (open_file if one and one["path"].partition(":")[0] in STREAMED else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column(0)[i].as_py()
                with streamed(value) if streamed else io.BytesIO(value) as f:
                    for part in _parts(parse(f)):
                        split = [http_message(b) if h.get("warc-type") == "response" and h.get("content-type", "").lower().startswith("application/http") else (None, None, b) for h, b in part]
                        more = [pa.array([b for _, b in part], pa.binary()), pa.array([x[0] for x in split], HTTP), *[pa.array([x[i] for x in split], pa.binary()) for i in (1, 2)]]
                        yield pa.RecordBatch.from_arrays([*[pa.array([h.get(k) for h, _ in part], pa.string()) for k in keys], *more], [*names, "block", "http", "head", "payload"])

    return files.select("path" if streamed else "content").mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", block binary, http array<struct<name: string, value: string>>, head binary, payload binary")
