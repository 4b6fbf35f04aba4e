"""WARC derivatives: linked metadata and plain-text conversion records of web responses.

``responses`` makes response records of fetched pages. ``derive`` adds to each one a
metadata record (the source's HTTP headers, digests, title and outlinks as
warc-fields) and a conversion record (its visible text), both with WARC-Refers-To the
response and naming each other, so that any of the three leads to the others. Record
ids are name-based UUIDs of the source record, so a run that is repeated after a lost
executor makes the same records. ``serialise`` gives each record's bytes as one gzip
member; members put one after the other are a .warc.gz file.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import re
import sys
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RECORD = ("record_id string, record_type string, refers_to string, concurrent_to string, target_uri string, "
          "record_date string, content_type string, payload_digest string, block_digest string, "
          "content_length bigint, block binary")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")       # the URL name space of RFC 4122
_OPEN = re.compile(r"<(?:(!--)|(script|style|template|noscript)\b|(/?[a-z][a-z0-9]*)|[!?])", re.I)
_ATTRIBUTES = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+")          # up to the tag's end, or a quote left open
_ENDS = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "template", "noscript")}
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header "
                    "hr html li main nav ol option p pre section table td th title tr ul".split())
_TITLE, _TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title\s*>", re.I)
_ANCHOR = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_NUMBER = re.compile(r"&#0*([0-9]+);?")


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def urn(*name: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, name)))}>"


class _TagEnds:
    """Where the tag ends whose attributes begin at a place, or -1. All places cost one pass over the page:
    when the scans that met no end have read the page's length, the ends of all places are worked out at once."""

    def __init__(self, page: str) -> None:
        self.page, self.spent = page, 0
        self.at: list[int] = []
        self.end: list[int] = []

    def __call__(self, start: int) -> int:
        if not self.at:
            end = _ATTRIBUTES.match(self.page, start).end()
            if self.page.startswith(">", end):
                return end
            self.spent += end - start
            if self.spent <= len(self.page):
                return -1
            self._all()
        k = bisect_left(self.at, start)
        return self.end[k] if k < len(self.at) else -1

    def _all(self) -> None:
        marks = [(m.start(), m[0]) for m in re.finditer("[>\"']", self.page)]
        self.at = [i for i, _ in marks] + [len(self.page)]
        self.end = [-1] * (len(marks) + 1)
        closing = {}                                                  # the next quote of each kind
        for k in range(len(marks) - 1, -1, -1):
            i, mark = marks[k]
            self.end[k] = i if mark == ">" else self.end[closing[mark] + 1] if mark in closing else -1
            closing[mark] = k


def visible_text(page: str) -> str:
    """The text a reader sees: markup, comments, scripts and styles go, block elements end lines.

    What opens a tag and never ends one is text; a comment or script left open goes to the end.
    """
    out, done, at, tag_end, closes = [], 0, 0, _TagEnds(page), True
    while m := _OPEN.search(page, at):
        comment, hidden, name = m.groups()
        brk = ""
        if comment:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        elif hidden:
            close = _ENDS[hidden.lower()].search(page, m.end()) if hidden.isascii() else None
            end = close.end() if close else len(page)
        elif name:
            end = tag_end(m.end()) + 1
            brk = "\n" if name.lstrip("/").lower() in _BLOCKS else ""
        else:
            end = page.find(">", m.end()) + 1 if closes else 0
            closes = end > 0
        at = end or m.start() + 1
        if end:
            out += (page[done:m.start()], brk)
            done = end
    text = unescape("".join(out) + page[done:])
    return "\n".join(x for x in (" ".join(x.split()) for x in text.split("\n")) if x)


def unescape(text: str) -> str:
    """Character references resolved; a number of any length beyond the last character is U+FFFD."""
    long = lambda m: m[0] if len(m[0]) < 20 else f"&#{m[1]};" if len(m[1]) < 10 else "\ufffd"
    return html.unescape(_NUMBER.sub(long, text))


def one_line(text: str) -> str:
    return " ".join(unescape(text).split())


def page_title(page: str) -> str | None:
    begin = _TITLE.search(page)
    start = page.find(">", begin.end()) + 1 if begin else 0
    end = _TITLE_END.search(page, start) if start else None
    return page[start:end.start()] if end else None


def links(page: str) -> list[str]:
    """The targets of all anchors: the first href before the tag's first ``>``."""
    out, href, at = [], None, 0
    while m := _ANCHOR.search(page, at):
        if href is None or href.start() < m.end():
            href = _HREF.search(page, m.end())
            if not href:
                break
        close = page.find(">", m.end(), href.start())
        at = href.end() if close < 0 else close
        if close < 0:
            out.append("".join(x or "" for x in href.groups()))
    return out


def derivatives(record_id: str, uri: str, date: str, block: bytes, payload_digest: str) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    head, _, body = block.partition(b"\r\n\r\n")
    page = body.decode("utf-8", "replace")
    meta_id, text_id = urn("metadata", record_id), urn("conversion", record_id)
    title = page_title(page)
    fields = [("source-record", record_id), ("source-payload-digest", payload_digest),
              ("source-block-digest", digest(block)), ("source-length", len(body))]
    fields += [("source-header", one_line(x)) for x in head.decode("latin-1").split("\r\n") if x]
    fields += [("title", one_line(title))] if title is not None else []
    fields += [("outlink", one_line(x)) for x in links(page)]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    text = visible_text(page).encode()
    return [(meta_id, "metadata", record_id, text_id, uri, date, "application/warc-fields", None, digest(meta),
             len(meta), meta),
            (text_id, "conversion", record_id, meta_id, uri, date, "text/plain; charset=utf-8", payload_digest,
             digest(text), len(text), text)]


def responses(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html",
              date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A response record per page. A null or empty page has an empty payload, a null URI stays null.

    The id comes from the page's id, URI and content; repeated rows get the same record.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, uri, page in zip(*(c.to_pylist() for c in b.columns)):
                body = (page or "").encode("utf-8", "replace")
                block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                         f"Content-Length: {len(body)}\r\n\r\n").encode() + body
                of = digest(body)
                rows.append((urn("response", key, uri, of), "response", None, None, uri, date,
                             "application/http; msgtype=response", of, digest(block), len(block), block))
            yield _batch(rows)

    return pages.select(id_col, uri_col, html_col).mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64() if n == "content_length" else pa.binary() if n == "block" else pa.string() for n in names]
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of all response records; other types are passed over.

    A response without a blank line after its headers has an empty payload; its payload
    digest is kept as given, or computed where it is null.
    """
    wanted = ["record_id", "target_uri", "record_date", "block", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows = []
                for i, uri, date, block, of in zip(*(c.slice(lo, 500).to_pylist() for c in b.columns)):
                    block = block or b""
                    rows += derivatives(i, uri, date, block, of or digest(block.partition(b"\r\n\r\n")[2]))
                yield _batch(rows)

    return records.filter("record_type = 'response'").select(*wanted).mapInArrow(run, RECORD)


def header_lines() -> F.Column:
    """The WARC header of a record; absent fields are left out."""
    fields = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "record_date"),
              ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
              ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Payload-Digest", "payload_digest"),
              ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"),
              ("Content-Length", "content_length")]
    lines = [F.concat(F.lit(f"{k}: "), F.col(c).cast("string"), F.lit("\r\n")) for k, c in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *(F.coalesce(x, F.lit("")) for x in lines), F.lit("\r\n"))


def serialise(records: DataFrame) -> DataFrame:
    """record_id and the record's bytes as one gzip member."""
    rows = records.select("record_id", header_lines().alias("header"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [gzip.compress(h.encode() + (x or b"") + b"\r\n\r\n", 6, mtime=0)
                    for h, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["record_id", "record"])

    return rows.mapInArrow(run, "record_id string, record binary")


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a .warc.gz file's bytes."""
    raw, out = gzip.decompress(data), []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        out.append((headers, rest[:n]))
        raw = rest[n + 4:]
    return out
