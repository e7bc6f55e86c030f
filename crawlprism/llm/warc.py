"""WARC derivatives: metadata and plain-text conversion records of archived responses.

`responses` makes response records of web pages (for tables that hold payloads instead of archives),
`read_records` parses WARC files, `derivatives` builds two records of every response, and `serialise`
gives the bytes of a record, so that any writer can put them into files.

Each response yields a `metadata` record (block `application/warc-fields`: title, language, charset,
number of links, then the outgoing links) and a `conversion` record (block `text/plain`: the page's
text). Both carry WARC-Refers-To (the response's record id), the response's target URI and date, its
payload digest as WARC-Refers-To-Payload-Digest beside their own block digest, and the source headers
of the response. Record ids are UUIDs made from the response's id and the kind, so a rerun gives the same
ids, and two records of one kind meet only where two responses share an id.

Text of a page: comments, scripts, styles and the head's other parts go, block tags break lines,
other tags vanish, entities are decoded once, blanks are squeezed, empty lines dropped.

Defined cases: a null payload is an empty one and yields two records with empty text; a null or empty
target URI stays empty. Repeated responses yield repeated records. Malformed HTML is read as far as its
tags go; an unclosed comment or script runs to the end of the page. Records that `read_records` cannot
parse are kept with type null and their bytes as block.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
CRLF = "\r\n"

#: Fields of a record: its own, those of the response it refers to, and its block.
FIELDS = (
    "record_id", "type", "target_uri", "date", "refers_to", "refers_to_digest", "content_type", "payload_digest",
    "block_digest", "source_headers", "block",
)
RECORD = ", ".join(f"{name} string" for name in FIELDS)


def digest(data: bytes) -> str:
    """`sha1:` and the base32 digest, as archives write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '/'.join(names))}>"


# --- responses -----------------------------------------------------------------------------------------


def responses(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
              date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A response record per page: its id and the record's fields. The block is the payload; the source
    headers are those of an HTTP response that carries it."""
    read = pages.select(
        F.col(id_column).alias("id"),
        F.col(id_column).cast("string").alias("name"),
        F.coalesce(F.col(url_column), F.lit("")).alias("url"),
        F.coalesce(F.col(html_column), F.lit("")).alias("html"),
    )

    def record(name: str | None, url: str, page: str) -> tuple:
        payload = page.encode()
        head = CRLF.join(
            ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
        )
        return (
            record_id("response", name or "", url), "response", url, date, None, None,
            "application/http; msgtype=response", digest(payload), digest(head.encode() + payload), head, page,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [record(*r) for r in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield _batch(batch.column(0), rows)

    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, {RECORD}")


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.string()) for c in columns)], ["id", *FIELDS])


# --- pages -----------------------------------------------------------------------------------------------

_HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|title)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S
)
_BREAKS = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|"
    r"section|table|td|th|tr|ul)\b[^<>]*>",
    re.I,
)
_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")  # no tag spans another "<": broken ones cost no rescans
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title|\Z)", re.I | re.S)
_LANGUAGE = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_CHARSET = re.compile(r"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _one_line(text: str) -> str:
    return " ".join(html.unescape(_TAG.sub("", text)).split())


def page_text(page: str) -> str:
    shown = _TAG.sub("", _BREAKS.sub("\n", _HIDDEN.sub(" ", page).replace("\n", " ")))
    lines = (x.strip() for x in _SPACES.sub(" ", html.unescape(shown)).split("\n"))
    return "\n".join(x for x in lines if x)


def page_fields(page: str) -> list[tuple[str, str]]:
    """The metadata of a page as named fields, in order; outgoing links as they stand, once each."""
    named = (("title", _TITLE), ("languages-declared", _LANGUAGE), ("charset-declared", _CHARSET))
    found = [(name, m[1]) for name, pattern in named if (m := pattern.search(page))]
    visible = re.sub(r"<!--.*?(?:-->|\Z)", " ", page, flags=re.S)
    links = dict.fromkeys(_one_line(a or b or c) for a, b, c in _LINK.findall(visible))
    return [(k, _one_line(v)) for k, v in found] + [("link-count", str(len(links)))] + [("outlink", x) for x in links]


# --- derivatives -------------------------------------------------------------------------------------------


def derivatives(records: DataFrame) -> DataFrame:
    """Two records of each response, linked to it: the response's id and the record's fields. Records of
    other types are left out."""
    read = records.where(F.col("type") == "response").select("id", *FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                page = r["block"] or ""
                fields = "".join(f"{k}: {v}{CRLF}" for k, v in page_fields(page))
                for kind, mime, block in (
                    ("metadata", "application/warc-fields", fields),
                    ("conversion", "text/plain; charset=utf-8", page_text(page)),
                ):
                    own = digest(block.encode())
                    rows.append(
                        (
                            record_id(kind, r["record_id"] or ""), kind, r["target_uri"], r["date"], r["record_id"],
                            r["payload_digest"], mime, own, own, r["source_headers"], block,
                        )
                    )
            twice = pa.array([i // 2 for i in range(len(rows))], pa.int64())
            yield _batch(batch.column(0).take(twice), rows)

    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, {RECORD}")


# --- files -------------------------------------------------------------------------------------------------

#: WARC header names by field.
HEADERS = {
    "type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "refers_to_digest": "WARC-Refers-To-Payload-Digest",
    "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest", "content_type": "Content-Type",
}
SOURCE = "WARC-Source-Header"


def record_bytes(record: dict) -> bytes:
    """A record as it stands in an uncompressed WARC file. A response's source headers begin its block;
    derived records repeat them one by one as `WARC-Source-Header`."""
    block, source = (record["block"] or "").encode(), record["source_headers"] or ""
    head = ["WARC/1.1", *(f"{name}: {record[f]}" for f, name in HEADERS.items() if record[f] is not None)]
    if record["type"] == "response":
        block = source.encode() + block
    else:
        head += [f"{SOURCE}: {line}" for line in source.split(CRLF) if line]
    return CRLF.join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + (CRLF * 2).encode()


_NEXT = re.compile(rb"\n\r?\n(WARC/1\.)")


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes, one gzip member or many, or plain.

    A malformed record, or one whose length reaches over the start of later ones, gives one record of
    type null; reading goes on at the next line after a blank one that begins with `WARC/1.`.
    """
    import gzip

    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "replace").split(CRLF) if end > 0 else []
        named = [line.partition(":")[::2] for line in head[1:]]
        values = {k.strip().lower(): v.strip() for k, v in named}
        if not head or not head[0].startswith("WARC/") or not values.get("content-length", "").isdigit():
            following = _NEXT.search(data, at)
            stop = following.start(1) if following else len(data)
            yield dict.fromkeys(FIELDS) | {"block": data[at:stop].decode("utf-8", "replace")}
            at = stop
            continue
        begin = end + 4
        last = begin + int(values["content-length"])
        after = last
        while data[after : after + 2] == b"\r\n":
            after += 2
        if last > len(data) or not (after == len(data) or data.startswith(b"WARC/", after)):
            following = _NEXT.search(data, end, min(last + 16, len(data)))
            if following and following.start(1) <= last:  # the length reaches over later records
                yield dict.fromkeys(FIELDS) | {"block": data[at : following.start(1)].decode("utf-8", "replace")}
                at = following.start(1)
                continue
        block = data[begin:last]
        at = min(after, len(data))
        record = {f: values.get(name.lower()) for f, name in HEADERS.items()}
        if record["type"] == "response":
            source, cut, body = block.partition(b"\r\n\r\n")
            source, block = (source + cut, body) if cut else (b"", block)
            record["source_headers"] = source.decode("utf-8", "replace")
        else:
            record["source_headers"] = CRLF.join(
                [*(v.strip() for k, v in named if k.strip().lower() == SOURCE.lower()), "", ""]
            )
        yield record | {"block": block.decode("utf-8", "replace")}


def serialise(records: DataFrame) -> DataFrame:
    """The records' ids and bytes."""
    read = records.select("id", *FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([record_bytes(r) for r in batch.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], ["id", "data"])

    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, data binary")


def read_records(files: DataFrame) -> DataFrame:
    """The records of WARC files given as (path, content), as Spark's `binaryFile` source reads them;
    the id is the path and the record's number in the file. A file is one task's work: keep files at the
    usual size of archives (about 1 GB), not more."""
    read = files.select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, rows = [], []
                for i, record in enumerate(parse_records(content.as_py() or b"")):
                    ids.append(f"{path}#{i}")
                    rows.append(tuple(record[f] for f in FIELDS))
                    if len(rows) == 256:
                        yield _batch(pa.array(ids), rows)
                        ids, rows = [], []
                yield _batch(pa.array(ids, pa.string()), rows)

    return read.mapInArrow(run, f"id string, {RECORD}")
