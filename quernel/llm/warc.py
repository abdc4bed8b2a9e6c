"""WARC archives with one Zstandard frame for each record (operator 1).

An archive is a leading skippable frame (magic 0x184D2A5D) with the dictionary, then a frame for each record. It is
written by Spark's own text writer, each frame as a line: the line separator is an empty skippable frame (eight
ASCII bytes that every Zstandard decoder passes over), so whatever file system Spark writes to will do and a task
that is tried again leaves no second archive. A revisit record stands for a payload that another page holds; which
page that is comes from a partial aggregation of digests, and texts meet it through a salted join, so a payload that
a third of all pages share isn't dealt to one task.

The reader finds each frame by its block headers, decodes it alone, and raises ValueError, with file and place, for
a broken frame, a missing or repeated header, a length that isn't that of the block, or a digest that doesn't match.

Edge cases: a null html is an empty payload; a null url has no WARC-Target-URI, and control characters in one are
percent-encoded; null page_ids name no response unless none with that payload has an id (then each of them is one);
rows with the smallest page_id of a payload are responses, repeated or not; extra columns are left out; an empty
table makes an empty folder and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import new_folder, salted

FRAME, DICTIONARY = 0xFD2FB528, 0x184D2A5D
#: An empty skippable frame of magic 0x184D2A50.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
#: The dictionary is trained from about so many payloads, from a window of so many characters of each.
DICTIONARY_PAGES, DICTIONARY_CHARS, DICTIONARY_BYTES = 400, 8_192, 32_768
#: An archive is read as one value, so it is bounded.
ARCHIVE_RECORDS = 2_048
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_ID = re.compile(r"<urn:x-page:(none|-?\d+)>")
_NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(pages: DataFrame, *, html_col: str = "html", n_pages: int | None = None) -> bytes:
    """A dictionary from windows of about ``DICTIONARY_PAGES`` payloads, by a hash of the row's number; empty where there are too few.

    A window lies anywhere in its payload. No task sends more than its share of the sample.
    """
    n_pages = pages.count() if n_pages is None else n_pages
    number = F.xxhash64(F.monotonically_increasing_id())
    rows = pages.select(F.col(f"`{html_col}`").alias("x"), number.alias("h"))
    if n_pages > DICTIONARY_PAGES:
        rows = rows.where(F.pmod("h", F.lit(1 << 40)) < int(DICTIONARY_PAGES / n_pages * (1 << 40)))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("x") - DICTIONARY_CHARS, F.lit(0)) + 1) + 1
    rows = rows.where(F.length("x") > 0).select(F.substring("x", start.cast("int"), F.lit(DICTIONARY_CHARS)).alias("x"))
    samples = [r["x"].encode() for r in rows.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8, level=3).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record without the payload."""
    name = lambda i: f"<urn:x-page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def with_origins(pages: DataFrame, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", n_pages: int | None = None) -> DataFrame:
    """page_id, url, html (never null), refers_to and revisit of every row."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("key", F.sha1(F.encode("html", "UTF-8")))
    shared = rows.select("key", "page_id").groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    rows, shared, on = salted(rows, shared, "key", F.monotonically_increasing_id(), pages.count() if n_pages is None else n_pages)
    out = rows.join(shared.drop("n"), on, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= least_bytes)
    return out.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 0, level: int = 3, **columns) -> None:
    """A record for each row, in archives of ``ARCHIVE_RECORDS`` records at most, each with its dictionary."""
    n_pages = pages.count()
    rows = with_origins(pages, least_bytes=least_bytes, n_pages=n_pages, **columns)
    dictionary = train_dictionary(pages, html_col=columns.get("html_col", "html"), n_pages=n_pages)
    lead = [struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary] if dictionary else []

    def run(batches):
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True, write_checksum=True)
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                page, url, refers, revisit = (part.column(i).to_pylist() for i in (0, 1, 3, 4))
                html = (x.as_py().encode() for x in part.column(2))
                frames = []
                for p, u, h, r, v in zip(page, url, html, refers, revisit, strict=True):
                    frames += lead if n % ARCHIVE_RECORDS == 0 else []
                    frames.append(packer.compress(record_bytes(p, u, h, r, v)))
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    lines = rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    # the writer starts another file after so many lines, and the next line is the dictionary again
    lines.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", ARCHIVE_RECORDS + len(lead)).text(folder)


def frames(data: bytes):
    """(place, magic, end) of every frame."""
    at, size = 0, len(data)
    while at < size:
        if at + 8 > size:
            raise ValueError(f"{at}: a frame breaks off")
        magic, n = struct.unpack_from("<II", data, at)
        if magic >> 4 == DICTIONARY >> 4:
            end = at + 8 + n
        elif magic == FRAME:
            end = at + zstandard.frame_header_size(data[at : at + 18])
            while True:
                if end + 3 > size:
                    raise ValueError(f"{at}: a frame breaks off")
                head = int.from_bytes(data[end : end + 3], "little")
                kind, length = head >> 1 & 3, head >> 3
                if kind == 3:
                    raise ValueError(f"{at}: a block of a kind that doesn't exist")
                end += 3 + (1 if kind == 1 else length)
                if head & 1:
                    break
            end += 4 * bool(data[at + 4] & 4)
        else:
            raise ValueError(f"{at}: not a Zstandard frame")
        if end > size:
            raise ValueError(f"{at}: a frame breaks off")
        yield at, magic, end
        at = end


def _fields(lines: list[str], place: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        key, colon, value = line.partition(":")
        if not colon or not key or key != key.strip():
            raise ValueError(f"{place}: not a header: {line!r}")
        if key.lower() in out:
            raise ValueError(f"{place}: {key} is there twice")
        out[key.lower()] = value.strip()
    return out


def parse_record(data: bytes, place: str = "") -> tuple[dict[str, str], bytes, int, bytes]:
    """Headers, the block's HTTP head, the payload's length, and the payload that the record holds."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"{place}: no WARC head")
    fields = _fields(lines[1:], place)
    for name in _NEEDED:
        if name.lower() not in fields:
            raise ValueError(f"{place}: {name} is missing")
    if not re.fullmatch(r"\d+", fields["content-length"]) or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"{place}: the block isn't as long as its Content-Length")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError(f"{place}: no HTTP head")
    length = _fields(http.decode("utf-8").split("\r\n")[1:], place).get("content-length", "")
    if not re.fullmatch(r"\d+", length):
        raise ValueError(f"{place}: no length of the payload")
    if fields["warc-type"] == "response":
        if int(length) != len(payload) or fields.get("warc-payload-digest") != f"sha1:{digest32(payload)}":
            raise ValueError(f"{place}: the payload's length or digest is wrong")
    elif fields["warc-type"] != "revisit" or payload or "warc-refers-to" not in fields or "warc-payload-digest" not in fields:
        raise ValueError(f"{place}: neither a response nor a revisit record")
    return fields, http, int(length), payload


def archive_records(data: bytes, place: str = ""):
    """(place, record) of one archive, each frame decoded alone."""
    packed, dictionary = zstandard.ZstdDecompressor(), None
    for at, magic, end in frames(data):
        where = f"{place}:{at}"
        if magic == DICTIONARY:
            if at:
                raise ValueError(f"{where}: a dictionary must lead")
            dictionary = data[8:end]
            if dictionary[:4] == struct.pack("<I", FRAME):  # it may be packed itself
                dictionary = packed.decompress(dictionary)
            packed = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        elif magic == FRAME:
            try:
                yield where, packed.decompress(data[at:end], allow_extra_data=False)
            except zstandard.ZstdError as e:
                raise ValueError(f"{where}: {e}") from e


def _page(name: str, place: str) -> int | None:
    if not (m := _ID.fullmatch(name)):
        raise ValueError(f"{place}: not a page's name: {name}")
    return None if m[1] == "none" else int(m[1])


def read_archives(spark: SparkSession, folder: str, *, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload) of every record."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[tuple] = []
                for where, record in archive_records(content.as_py(), path.as_py()):
                    fields, _, length, payload = parse_record(record, where)
                    revisit = fields["warc-type"] == "revisit"
                    rows.append((_page(fields["warc-record-id"], where), length, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], _page(fields["warc-refers-to"], where) if revisit else None, fields.get("warc-target-uri"), payload)[: len(names)])
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload)


def roundtrip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Writes all pages to archives, then reads those."""
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, least_bytes=least_bytes)
    return read_archives(pages.sparkSession, folder).drop("url")
