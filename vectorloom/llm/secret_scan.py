"""Secrets in texts and in whatever the texts encode, by a worklist of decoded layers.

The text is the first layer. Each layer is scanned for secrets and unwrapped in every way
that applies: URL escapes, Unicode and character escapes, base64 runs (at each of the four
places a quantum may begin, also wrapped into lines) and compressed streams. What comes out
is a layer of its own, put on the worklist until no layer yields another. A layer that was
seen before with the same content at the same place is not opened again, so a stream that
decompresses to itself ends.

Every character of a layer knows which characters of the text it came from, so a secret of
any layer is reported as a span of the text.
"""

from __future__ import annotations

import bz2
import lzma
import re
import sys
import zlib
from base64 import b64decode
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")       # a run too short for 18 characters has no longer one inside
HEX = re.compile(r"[0-9a-f]{16,}")

URL = re.compile(r"%([0-9A-Fa-f]{2})")
ESCAPE = re.compile(r"(?:\\u|%u)([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
                    r"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
# 11 bytes is the shortest zlib stream of a 16-character secret, 15 characters in base64
LEAST_BYTES, LEAST_TEXT = 11, 16
RUN = re.compile(r"[A-Za-z0-9+/_-]{15,}")
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}")
STANDARD = str.maketrans("-_", "+/")
STREAM = re.compile(r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
# texts without any of these hold no secret and nothing to unwrap (RE2, over a whole batch at once)
WORTH = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|%[0-9A-Fa-f]{2}|%u"
         r"|\\[uUx]|&#|[A-Za-z0-9+/_-]{15}|\x{1f}\x{8b}|x[\x{01}\x{5e}\x{9c}\x{da}]|BZh|\x{fd}7zXZ")

FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string()),
                     ("secret", pa.string())])
FINDING_DDL = "struct<kind:string,start:bigint,end:bigint,via:string,secret:string>"


def secrets(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of each kind's leftmost non-overlapping matches that are long enough."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            yield 0, m.start(), m.end()
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


@dataclass
class Layer:
    """A text, the span [lo, hi) of the whole text behind each character (None: itself), and its wrappings."""

    text: str
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None
    via: str = ""

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.lo is None else (int(self.lo[start]), int(self.hi[end - 1]))

    def inner(self, text: str, lo: np.ndarray, hi: np.ndarray, via: str) -> Layer:
        """A layer whose characters come from the characters lo to hi of this one."""
        if self.lo is not None:
            lo, hi = self.lo[lo], self.hi[hi - 1]
        return Layer(text, lo, hi, f"{self.via}>{via}" if self.via else via)


def _replaced(layer: Layer, pattern: re.Pattern, value, via: str) -> Iterator[Layer]:
    """The layer with every escape replaced by its one character."""
    starts, ends = [], []

    def one(m: re.Match) -> str:
        code = value(m)
        if code > sys.maxunicode:
            return m[0]
        starts.append(m.start())
        ends.append(m.end())
        return chr(code)
    text = pattern.sub(one, layer.text)
    if not starts:
        return
    s, e = np.asarray(starts), np.asarray(ends)
    inside = np.zeros(len(layer.text) + 1, dtype=np.int8)
    inside[s + 1] += 1          # escapes are at least two characters long and do not overlap
    inside[e] -= 1
    lo = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    hi = lo + 1
    hi[np.searchsorted(lo, s)] = e
    yield layer.inner(text, lo, hi, via)


def _from_base64(layer: Layer, body: str, at: np.ndarray) -> Iterator[Layer]:
    """What the characters ``body``, which stand at ``at``, decode to from each of four beginnings."""
    for first in range(4):
        n = len(body) - first
        n -= n % 4 == 1
        data = b64decode(body[first:first + n] + "=" * (-n % 4))
        if len(data) < LEAST_BYTES or len(data) < LEAST_TEXT and not STREAM.match(data.decode("latin-1")):
            continue
        j = np.arange(len(data))
        lo = first + 4 * (j // 3) + j % 3         # a byte lies in two characters
        yield layer.inner(data.decode("latin-1"), at[lo], at[lo + 1] + 1, "base64")


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in RUN.finditer(layer.text):
        yield from _from_base64(layer, m[0].translate(STANDARD), np.arange(m.start(), m.end()))
    for m in WRAPPED.finditer(layer.text):
        at = m.start() + np.flatnonzero(~np.isin(np.frombuffer(m[0].encode(), np.uint8), (10, 13)))
        yield from _from_base64(layer, m[0].replace("\r", "").replace("\n", ""), at)


class Scan:
    """The worklist of one text. ``budget`` bounds the characters of all its decoded layers."""

    def __init__(self, budget: int) -> None:
        self.left, self.opened, self.unopened = budget, 0, 0

    def _streams(self, layer: Layer) -> Iterator[Layer]:
        data = None
        for m in STREAM.finditer(layer.text):
            if data is None:
                data = memoryview(layer.text.encode("latin-1", "replace"))     # one byte a character
            start, name = m.start(), m[0]
            if name[0] == "x" and (ord("x") * 256 + ord(name[1])) % 31:
                continue
            unpack = (bz2.BZ2Decompressor() if name[0] == "B" else lzma.LZMADecompressor() if name[0] == "\xfd"
                      else zlib.decompressobj(47))
            try:
                out = unpack.decompress(data[start:], self.left + 1)
            except (zlib.error, lzma.LZMAError, OSError, EOFError):
                continue        # chance characters, or a broken stream
            if len(out) > self.left:
                self.unopened += 1
                continue
            end = len(data) - len(unpack.unused_data)
            yield layer.inner(out.decode("latin-1"), np.broadcast_to(np.int64(start), len(out)),
                              np.broadcast_to(np.int64(end), len(out)), "compressed")

    def layers(self, text: str) -> Iterator[Layer]:
        seen: set[tuple[bytes, int, int]] = set()
        work = deque([Layer(text)])
        while work:
            layer = work.popleft()
            yield layer
            for found in (_replaced(layer, URL, lambda m: int(m[1], 16), "url"),
                          _replaced(layer, ESCAPE, lambda m: int(m[6]) if m[6] else int(
                              m[1] or m[2] or m[3] or m[4] or m[5], 16), "escape"),
                          _base64(layer), self._streams(layer)):
                for inner in found:
                    if not inner.text:
                        continue
                    digest = blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    key = digest, *inner.span(0, len(inner.text))
                    if key in seen:
                        continue
                    if len(inner.text) > self.left:
                        self.unopened += 1
                        continue
                    seen.add(key)
                    self.left -= len(inner.text)
                    self.opened += 1
                    work.append(inner)

    def findings(self, text: str) -> list[tuple[int, int, int, str, str]]:
        """(start, kind, end, via, secret); a span that several layers show keeps its shortest way."""
        best: dict[tuple[int, int, int], tuple[str, str]] = {}
        for layer in self.layers(text):
            for kind, start, end in secrets(layer.text):
                lo, hi = layer.span(start, end)
                best.setdefault((lo, kind, hi), (layer.via, layer.text[start:end]))
        return [(*key, *best[key]) for key in sorted(best)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 64 << 20) -> DataFrame:
    """(id, findings, n_layers, n_unopened), one row per row of ``docs``.

    findings: array of (kind, start, end, via, secret) ordered by start, kind and end. start
    and end count code points of the text, end exclusive. ``via`` names the wrappings around
    the secret from the outside in, '' for one that stands in the text itself; those are each
    kind's leftmost non-overlapping matches. A span that several layers show is reported
    once, with the fewest wrappings. n_layers counts the layers opened.

    Null text counts as empty; ids, nulls and repeats among them are passed on; other columns
    are ignored; an empty table gives an empty result. The whole text is scanned, whatever its
    length. Decoded layers of one text hold up to ``budget`` characters in all (64 MB), against
    streams made to exhaust memory; what would exceed that is not opened, and counted in
    n_unopened, never passed over silently.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            worth = pc.match_substring_regex(texts, WORTH).fill_null(False).to_numpy(zero_copy_only=False)
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            layers, unopened = np.zeros((2, b.num_rows), dtype=np.int64)
            for i in np.flatnonzero(worth):
                of = Scan(budget)
                found[i] = [{"kind": KINDS[k], "start": s, "end": e, "via": via,
                             "secret": secret.encode("utf-8", "replace").decode()}
                            for s, k, e, via, secret in of.findings(texts[i].as_py())]
                layers[i], unopened[i] = of.opened, of.unopened
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(found, pa.list_(FINDING)), pa.array(layers), pa.array(unopened)],
                names=["id", "findings", "n_layers", "n_unopened"])

    out = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(
        run, f"id {kind}, findings array<{FINDING_DDL}>, n_layers bigint, n_unopened bigint")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", budget: int = 64 << 20) -> DataFrame:
    """``docs`` with every span that holds a secret, encoded or not, replaced by ``mark``.

    Spans that touch or overlap are replaced as one. Null stays null; rows, ids and other
    columns are passed on as they are.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at)
            worth = pc.match_substring_regex(texts, WORTH).fill_null(False).to_numpy(zero_copy_only=False)
            out = texts.to_pylist()
            for i in np.flatnonzero(worth):
                parts, done = [], 0
                for start, _, end, _, _ in Scan(budget).findings(out[i]):
                    if start > done or not parts:
                        parts += [out[i][done:start], mark]
                    done = max(done, end)
                out[i] = "".join(parts) + out[i][done:]
            columns = list(b.columns)
            columns[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
