"""Interleaved document sequences with media columns.

HTML is parsed into an ordered sequence of text and media-reference items. A media item
carries the digest that its address names, its position and its caption. Media live in a
stored table of bytes keyed by that digest; joining on it resolves each reference while the
position and the caption stay beside it. The media form here is a binary grey map (PGM,
"P5"), 64 samples to a row, 8 bits a sample, so any payload can be kept losslessly.

Media are written where their documents are, each digest once by a task, and never shuffled:
what a read of the stored bytes gives is joined by digest.

Defined results: null text is the empty payload; that is padded like any other, to one row
of zeros. Repeated rows, and rows with equal texts, give equal values, whatever their ids,
which may be null. Very long texts are one medium. A reference whose digest names no medium
is kept with null media columns; one whose address is no digest has a null digest and
resolves to nothing. Extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import saved

ROW = 64
SCHEME = "media:"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
FEATURES = "media_bytes bigint, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string"
_SILENT = ("script", "style", "template")


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.parts: list[str] = []
        self.silent = 0
        self.caption: list[str] | None = None
        self.figure: list[dict] = []
        self.inside = False
        self.held: str | None = None

    def _caption_ends(self) -> None:
        if self.caption is not None:
            self.held, self.caption = " ".join("".join(self.caption).split()), None
            if not self.inside:
                self._figure_ends()

    def _figure_ends(self) -> None:
        """The held caption goes to all media of the figure; without media it is text."""
        self._caption_ends()
        if self.held is not None:
            for item in self.figure:
                item["caption"] = self.held
            if not self.figure:
                self.parts.append(f" {self.held} ")
        self.figure, self.held, self.inside = [], None, False

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figure":
            self._figure_ends()
            self.inside = True
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            known = dict(attrs)
            address = known.get("src") or ""
            self._flush()
            item = {"position": len(self.items), "kind": "media", "text": address, "digest": address[len(SCHEME) :] if address.startswith(SCHEME) else None, "caption": known.get("alt")}
            self.items.append(item)
            self.figure.append(item)
        elif tag in ("p", "div", "li", "br", "h1", "h2", "h3", "tr"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self._caption_ends()
        elif tag == "figure":
            self._figure_ends()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.parts.append(data)

    def done(self) -> list[dict]:
        self.close()
        self._figure_ends()
        self._flush()
        return self.items


def sequence_of(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    return parser.done()


def parse_sequences(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, and `items`: the ordered sequence of the column html."""
    inside = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def work(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                items = pa.array([sequence_of(x) for x in part.column(0).to_pylist()], inside)
                yield pa.RecordBatch.from_arrays([*(part.column(i + 1) for i in range(len(keep))), items], names=[*keep, "items"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(html, *keep).mapInArrow(work, f"{kinds}, items array<{ITEM}>")


def padded(payload: Column) -> Column:
    """The bytes with zeros up to a positive multiple of ROW."""
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / F.lit(ROW))).cast("int") * F.lit(ROW)
    return F.rpad(payload, size, F.lit(b"\x00"))


def grey_map(payload: Column) -> Column:
    """PGM bytes whose samples are the payload, whose size is a multiple of ROW."""
    head = F.concat(F.lit(f"P5\n{ROW} "), F.floor(F.octet_length(payload) / F.lit(ROW)).cast("string"), F.lit("\n255\n"))
    return F.concat(head.cast("binary"), payload)


def samples(medium: bytes) -> bytes:
    """The samples of PGM bytes, read back by what their head says."""
    kind, size, depth, rest = medium.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(rest) != width * height:
        raise ValueError("not an 8-bit grey map")
    return rest


def medium_of(text: str | None) -> bytes:
    """The stored form of a text: its UTF-8 bytes, padded, as the samples of a grey map."""
    payload = (text or "").encode()
    rows = max(1, -(-len(payload) // ROW))
    return b"P5\n%d %d\n255\n" % (ROW, rows) + payload.ljust(rows * ROW, b"\x00")


def store_media(docs: DataFrame, text: str) -> DataFrame:
    """digest and medium of each text, written as a table; equal media are written once by a task."""

    def work(batches):
        met: set[str] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                media = {}
                for body in batch.column(0).slice(start, 64).to_pylist():
                    medium = medium_of(body)
                    digest = hashlib.sha256(medium).hexdigest()
                    if digest not in met:
                        met.add(digest)
                        media[digest] = medium
                if media:
                    yield pa.RecordBatch.from_arrays([pa.array(list(media)), pa.array(list(media.values()), pa.binary())], names=["digest", "medium"])

    return saved(docs.select(text).mapInArrow(work, "digest string, medium binary"))


def read_back(media: pd.Series) -> pd.DataFrame:
    """What the stored bytes of a medium hold: their size and digest, the payload's, and a feature of 16 sample bands and the mean."""
    rows = []
    for medium in media:
        payload = samples(medium)
        count = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
        mean = round(float(count @ np.arange(256)) / len(payload), 4)
        feature = f"{ROW}x{len(payload) // ROW};mean={mean};bands=" + ",".join(map(str, count.reshape(16, 16).sum(1)))
        rows.append((len(medium), hashlib.sha256(medium).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), feature))
    return pd.DataFrame(rows, columns=["media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])


def features_of(store: DataFrame) -> DataFrame:
    """digest and what a read of the stored bytes gives, once a digest."""
    read = F.pandas_udf(read_back, FEATURES)
    return store.select("digest", read("medium").alias("read")).groupBy("digest").agg(F.min("read").alias("read")).select("digest", "read.*")


def resolve(references: DataFrame, media: DataFrame) -> DataFrame:
    """References (digest, ...) with the columns of media (digest once, ...); a reference without a medium has nulls."""
    return references.join(media, "digest", "left")


def html_of(text: Column, digest: Column, n_bytes: Column) -> Column:
    """A text as a page: its first line, a figure whose caption tells the size of its medium, and the other lines."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    first = F.substring_index(text, "\n", 1)
    figure = F.concat(F.lit(f'</p><figure><img src="{SCHEME}'), digest, F.lit('" alt=""><figcaption>'), n_bytes.cast("string"), F.lit(" bytes of text</figcaption></figure><p>"))
    return F.concat(F.lit("<article><p>"), first, figure, F.substring(text, F.length(first) + 1, F.length(text)), F.lit("</p></article>"))


def document_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document as an interleaved sequence of its lines and one medium that holds its bytes; the medium is resolved by digest."""
    said = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("said"))
    said = said.withColumn("payload", F.encode("said", "UTF-8")).withColumn("n_bytes", F.octet_length("payload").cast("bigint"))
    said = said.withColumn("digest", F.sha2(grey_map(padded(F.col("payload"))), 256))
    pages = said.select(html_of(F.col("said"), F.col("digest"), F.col("n_bytes")).alias("html"), key, "n_bytes")
    items = parse_sequences(pages, "html", [key, "n_bytes"])
    words = F.array_join(F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"]), " ")
    references = items.select(key, "n_bytes", F.size("items").alias("n_items"), F.sha2(words, 256).alias("words_sha256"), F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item"))
    references = references.select(key, "n_bytes", "n_items", "words_sha256", "item.position", "item.caption", "item.digest")
    found = resolve(references, features_of(store_media(docs, text)))
    return found.select(key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "words_sha256")
