"""Media columns: interleaved document sequences.

``parse_html`` turns HTML into ordered text and media-reference structs; captions stay with their
media. ``resolve`` joins references to a media table by digest, so positions and captions remain
aligned with payloads that are stored once per digest. ``encode``/``decode`` keep bytes losslessly as
8-bit grey PNG samples.

The query makes a page of each document: its lines as paragraphs, a figure with the document's media
between them and a second reference after them. The page is parsed, and the references of the sequence
are joined by digest with what is decoded from the media table as read back. Only digests, places and
figures are shuffled, never payloads; figures are reduced to one row per digest before the join, so a
third of all documents with one text is one hot key on one side only, which adaptive skew joins split.

Edge cases: null text is empty and gets 576 bytes of 255; equal texts share a digest and all values;
repeated rows give repeated results; references without a digest or payload resolve to null payloads;
of broken HTML nothing is lost: unclosed tags end with their parent, a head ends where an element of the
body begins, a template without an end is read like any element; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm.common import stored, table, text_or_empty

WIDTH, PAD, LEVEL = 576, 255, 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
SKIPPED = {"script", "style", "noscript", "template", "head"}
#: Elements that leave a head open.
IN_HEAD = {"title", "meta", "link", "base", "basefont", "bgsound", "html", "head"} | SKIPPED
BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "table", "tr", "td", "th", "nav", "header", "footer", "blockquote", "pre", "figure", "body"}
MEDIA = {"img", "video", "audio", "source", "embed"}


class _Sequence(HTMLParser):
    def __init__(self, skipped: set[str] = SKIPPED) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped = skipped
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None
        self.skip: list[str] = []

    def flush(self) -> None:
        said = " ".join("".join(self.text).split())
        self.text = []
        if said:
            self.items.append({"kind": "text", "text": said, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if self.skip == ["head"] and tag not in IN_HEAD:
            self.skip = []
        if tag in self.skipped:
            self.skip.append(tag)
        if self.skip:
            return
        own = dict(attrs)
        if tag in MEDIA:
            self.flush()
            if own.get("src"):
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"kind": "media", "text": None, "ref": own["src"].strip(), "caption": own.get("alt") or own.get("title")})
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCKS:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in self.skipped:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[self.skip.index(tag) :]
            return
        if tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for i in self.figure or []:
                self.items[i]["caption"] = said or self.items[i]["caption"]
            if said and not self.figure:
                self.text.append(said)
            self.caption = None
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """Ordered items: position, kind (text or media), text, ref, caption. A caption inside a figure goes to all its media."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    if "template" in parser.skip or "noscript" in parser.skip:  # without an end: read again as plain elements
        parser = _Sequence(SKIPPED - {"template", "noscript"})
        parser.feed(html or "")
        parser.close()
    if parser.caption is not None:
        parser.handle_endtag("figcaption")
    parser.flush()
    return [{"position": i, **x} for i, x in enumerate(parser.items)]


def encode(payload: bytes) -> bytes:
    """8-bit grey PNG, WIDTH samples a row; the payload's length is a positive multiple of WIDTH."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + part(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of a PNG as ``encode`` writes it; chunk checksums are verified."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("checksum of a PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered PNG rows")
    return rows[:, 1:].tobytes()


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % WIDTH or (0 if data else WIDTH))


def feature(payload: bytes) -> str:
    """Size, mean, standard deviation and a 16-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    return f"{WIDTH}x{len(x) // WIDTH};mean={x.mean():.6f};sd={x.std():.6f};hist={'.'.join(map(str, bins.tolist()))}"


def sequences(pages: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """keep columns and ``items`` of every page."""

    @F.pandas_udf(ITEMS)
    def parsed(pages: pd.Series) -> pd.Series:
        return pages.map(parse_html)

    return pages.select(*keep, parsed(F.col(html)).alias("items"))


def references(seqs: DataFrame, *keep: str) -> DataFrame:
    """One row for each media item: keep columns, position, ref, caption, digest (of ``sha256:`` references)."""
    one = seqs.select(*keep, F.explode("items").alias("i")).where("i.kind = 'media'")
    digest = F.regexp_extract(F.col("i.ref"), r"^sha256:([0-9a-f]{64})$", 1)
    return one.select(*keep, "i.position", "i.ref", "i.caption", F.when(digest != "", digest).alias("digest"))


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """References with the columns of the media table, which has a row per digest."""
    return refs.join(media, "digest", "left")


def page_of(text: str, digest: str, n_bytes: int) -> str:
    """A document as an interleaved page: half of its lines, its media as a figure, the other lines, the media again."""
    lines = [f"<p>{escape(x, quote=False)}</p>" for x in text.split("\n") if not x.isspace() and x]
    half = len(lines) // 2
    figure = f'<figure><img src="sha256:{digest}"><figcaption>{n_bytes} bytes</figcaption></figure>'
    return f"<article>{''.join(lines[:half])}{figure}{''.join(lines[half:])}<img src=\"sha256:{digest}\" alt=\"after {len(lines)} lines\"></article>"


def _as_media(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_bytes, media (the stored form) and the media items of each document's parsed page, with the page's number of items."""
    import pyarrow as pa

    schema = docs.select("doc_id").schema.simpleString()[7:-1] + f",digest:string,n_bytes:long,media:binary,n_items:int,items:{ITEMS}"
    struct = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            texts, ids = batch.column(1).cast(pa.large_binary()), batch.column(0)
            at = 0
            while at < len(texts):
                out, size, start = [], 0, at
                while at < len(texts) and size < 1 << 23:
                    data = texts[at].as_py() or b""
                    png = encode(padded(data))
                    digest = hashlib.sha256(png).hexdigest()
                    items = parse_html(page_of(data.decode(), digest, len(data)))
                    out.append((digest, len(data), png, len(items), [x for x in items if x["kind"] == "media"]))
                    size += len(png) + len(data)
                    at += 1
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, at - start), pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int32()), pa.array(cols[4], struct)],
                    names=["doc_id", "digest", "n_bytes", "media", "n_items", "items"],
                )

    return docs.select("doc_id", text_or_empty().alias("t")).mapInArrow(run, schema)


def _figures(media: DataFrame) -> DataFrame:
    """digest and the contract's values, of media bytes as read back."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for digest, n, png in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                png = png.as_py()
                payload = decode(png)
                own = hashlib.sha256(png).hexdigest()
                if own != digest:
                    raise ValueError(f"stored media differs from its digest {digest}")
                out.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), own, feature(payload)))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and of each document's sequence the number of items and the position and caption of each media item."""
    kept = stored(_as_media(table(spark, sf_dir, "documents")), "media")
    # n_bytes belongs to the document: texts that end in byte 255 can't occur in UTF-8, so equal payloads have equal lengths
    figures = _figures(kept.select("digest", "n_bytes", "media"))
    names = [c for c in figures.columns if c != "digest"]
    figures = stored(figures.groupBy("digest").agg(*(F.min(c).alias(c) for c in names)), "media-figures")
    # a document's references meet again; rows that repeat are counted, so that each gets its own result
    refs = references(kept.select("doc_id", "n_items", "items"), "doc_id", "n_items")
    own = refs.groupBy("doc_id", "digest", "n_items").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.struct("position", "caption"))).alias("places"))
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(1), F.expr("n div size(places)"))))
    return resolve(own, figures).select("doc_id", *names, "n_items", F.col("places.position").alias("positions"), F.col("places.caption").alias("captions"))
