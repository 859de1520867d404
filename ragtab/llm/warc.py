"""WARC archives in Zstandard: writer and reader.

An archive is a byte string: one skippable frame that holds the dictionary, then one frame per
record. ``write_warc`` makes a table of archives (name, content), each rolled over at a bounded
size, so that Spark's own writer commits them and a task that is run again replaces its output;
``export_files`` puts them into ``.warc.zst`` files of any store pyarrow can write, and
``read_warc`` takes that table or Spark's ``binaryFile`` reader of such files.

The reader loads the dictionary from the leading skippable frame, decodes one frame per record
and checks the version line, the mandatory header fields and the date's form, the block length against
Content-Length, the end of the record, the payload's length, and the digests of block and payload (any algorithm that
hashlib has, in hexadecimal or base32; others are not checked). A revisit may name what it repeats by record id, or by URI and
date: ``with_targets`` finds the record of the latter.

Defined cases: a null html is an empty payload; a null or odd URL is percent-encoded into one
header line; of rows that share a page_id and a payload each is what the smallest id is;
a null page_id never is the one referred to unless all are null; an empty table gives no
archive. A broken archive raises, or with ``strict=False`` gives a row whose ``error`` says why.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the formats: magic numbers of a frame, of the dictionary's skippable frame and of a dictionary.
FRAME, DICT_FRAME, DICTIONARY = b"\x28\xb5\x2f\xfd", b"\x5d\x2a\x4d\x18", b"\x37\xa4\x30\xec"
#: Fixed value: the profile of records that repeat a payload.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-record-id", "warc-date", "warc-type", "content-length")

#: Shorter payloads are never revisits.
MIN_REVISIT = 100
#: An archive is closed when it holds this many bytes; a single larger record has one of its own.
ARCHIVE_BYTES = 8 << 20
#: Records up to this many bytes per task train the task's dictionary.
TRAIN_BYTES, DICT_BYTES = 1 << 20, 16 << 10

RECORDS = ("archive string, record_id string, record_type string, target_uri string, warc_date string, "
           "payload_bytes long, payload_digest string, refers_to string, refers_to_uri string, refers_to_date string, "
           "payload binary, error string")
#: Fixed value: the forms of a date, from a year alone to fractions of a second, in UTC.
DATE = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.\d{1,9})?)?Z)?)?)?")


def with_revisits(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """Adds ``payload_digest`` and ``first_id`` (smallest key of the rows with this payload, null
    for payloads that no other row has or that are short). Only digests are grouped, with partial
    aggregation; only repeated digests take part in the join."""
    rows = pages.select(F.col(key).alias("page_id"), "url",
                        F.coalesce(F.col(body), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    firsts = stored(rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("payload_digest")
                    .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                    .filter("n > 1").drop("n"), "warc-firsts")
    return rows.join(firsts, "payload_digest", "left")


def _quoted(url: str | None) -> str:
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], (url or "").encode()).decode()


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit record (with the HTTP header alone) where ``refers_to`` is given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    fields = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date,
              "WARC-Target-URI": _quoted(url), "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to:
        fields |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": REVISIT}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on the samples; where they are too few to train one, raw content."""
    try:
        if len(samples) >= 16:
            return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict(b"".join(x[:2048] for x in samples[:8]) or b"WARC/1.1\r\n",
                                         dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _archives(records: Iterator[bytes], limit: int) -> Iterator[bytes]:
    """Archives of at most ``limit`` bytes plus one record each, all with the dictionary of the first records."""
    first: list[bytes] = []
    size = 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= TRAIN_BYTES:
            break
    if not first:
        return
    d = _dictionary(first)
    raw = d.as_bytes()
    packer = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True, write_content_size=True)
    lead = DICT_FRAME + len(raw).to_bytes(4, "little") + raw
    out, size = [lead], 0

    def both():
        yield from first
        first.clear()
        yield from records

    for r in both():
        out.append(packer.compress(r))
        size += len(out[-1])
        if size >= limit:
            yield b"".join(out)
            out, size = [lead], 0
    if len(out) > 1:
        yield b"".join(out)


def write_warc(pages: DataFrame, key: str = "page_id", body: str = "html", date: str = "2000-01-01T00:00:00Z",
               archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of a record per row, stored below ``spark.checkpoint.dir``: name, content.
    A record's id is ``urn:page:<page_id>``."""

    def pack(batches):
        def records():
            for b in batches:
                for i, url, payload, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    again = first is not None and first != i
                    yield record(f"urn:page:{'' if i is None else i}", url, payload, digest,
                                 f"urn:page:{first}" if again else None, date)

        part = TaskContext.get().partitionId()
        for k, content in enumerate(_archives(records(), archive_bytes)):
            yield pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{k:04d}.warc.zst"]), pa.array([content], pa.binary())],
                                             ["name", "content"])

    rows = with_revisits(pages, key, body).select("page_id", "url", "payload", "payload_digest", "first_id")
    return stored(rows.mapInArrow(pack, "name string, content binary"), "warc")


def frame_end(buf, pos: int) -> int:
    """Where the Zstandard frame that starts at ``pos`` ends."""
    flags = buf[pos + 4]
    single = flags >> 5 & 1
    pos += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        head = int.from_bytes(buf[pos:pos + 3], "little")
        last, kind = head & 1, head >> 1 & 3
        if kind == 3 or pos + 3 > len(buf):
            raise ValueError("broken block in a frame")
        pos += 3 + (1 if kind == 1 else head >> 3)
    pos += 4 * (flags >> 2 & 1)
    if pos > len(buf):
        raise ValueError("a frame is cut off")
    return pos


def _load_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    if raw[:4] == FRAME:  # the dictionary itself may be compressed
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if raw[:4] == DICTIONARY
                                         else zstandard.DICT_TYPE_RAWCONTENT)


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time."""
    view, pos, opener = memoryview(content), 0, None
    while pos < len(view):
        magic = bytes(view[pos:pos + 4])
        if magic[1:] == b"\x2a\x4d\x18" and 0x50 <= magic[0] <= 0x5F:
            n = int.from_bytes(view[pos + 4:pos + 8], "little")
            if pos + 8 + n > len(view):
                raise ValueError("a skippable frame is cut off")
            if pos == 0 and magic == DICT_FRAME:
                opener = zstandard.ZstdDecompressor(dict_data=_load_dictionary(bytes(view[8:8 + n])))
            pos += 8 + n
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at byte {pos}")
        opener = opener or zstandard.ZstdDecompressor()
        try:
            end = frame_end(view, pos)
        except IndexError:
            raise ValueError("a frame is cut off") from None
        part = bytes(view[pos:end])
        if zstandard.frame_content_size(part) >= 0:
            yield opener.decompress(part)
        else:
            yield opener.decompressobj().decompress(part)
        pos = end


def check_date(value: str) -> None:
    m = DATE.fullmatch(value)
    if not m:
        raise ValueError(f"odd date {value[:40]!r}")
    year, month, day, hour, minute, second = (int(x) if x else None for x in m.groups())
    datetime(year, month or 1, day or 1, hour or 0, minute or 0, min(second or 0, 59))  # raises where there is no such day or time
    if (second or 0) > 60:
        raise ValueError(f"odd date {value[:40]!r}")


def check_digest(value: str | None, data: bytes, what: str) -> None:
    """``value``: algorithm, colon, digest in hexadecimal or base32."""
    if not value:
        return
    name, colon, text = value.partition(":")
    name, text = name.strip().lower().replace("-", ""), text.strip()
    if not colon or not text:
        raise ValueError(f"the {what}'s digest has no algorithm or value")
    if name not in hashlib.algorithms_guaranteed or name.startswith("shake"):
        return
    now = hashlib.new(name, data).digest()
    if text.lower() != now.hex() and text.upper().rstrip("=") != base64.b32encode(now).decode().rstrip("="):
        raise ValueError(f"the {what}'s digest is wrong")


def fields_of(head: bytes) -> tuple[bytes, dict[str, str]]:
    """The first line and the named fields; a line that begins with white space goes on with the one before. Of fields that repeat,
    the last."""
    first, *rows = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    h = {}
    for row in rows:
        k, colon, v = row.partition(b":")
        if not colon or not k.strip():
            raise ValueError(f"odd header line {row[:60]!r}")
        h[k.strip().lower().decode()] = v.strip().decode()
    return first, h


def parse(rec: bytes) -> dict:
    """Fields of a record; raises ValueError where it breaks the format or a length or digest is wrong. payload_digest: the
    payload's SHA-256; of a revisit, which has no payload, the header's digest (bare for SHA-256)."""
    head, sep, rest = rec.partition(b"\r\n\r\n")
    first, h = fields_of(head) if sep else (b"", {})
    if first not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    if missing := [k for k in MANDATORY if not h.get(k)]:
        raise ValueError(f"header lacks {missing}")
    check_date(h["warc-date"])
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    block, kind = rest[:-4], h["warc-type"].lower()
    check_digest(h.get("warc-block-digest"), block, "block")
    payload, n = block, len(block)
    if h.get("content-type", "").startswith("application/http") and (block or kind != "revisit"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise ValueError("no end of the HTTP header")
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        coded = re.search(rb"(?i)\r\ntransfer-encoding:", http) or "warc-truncated" in h  # then the length is not the HTTP header's
        n = int(m[1]) if m and not coded else len(payload)
    digest = h.get("warc-payload-digest")
    if kind != "revisit":
        if n != len(payload):
            raise ValueError("the payload's length is not the HTTP Content-Length")
        if "warc-truncated" not in h and "warc-segment-number" not in h:
            check_digest(digest, payload, "payload")
        digest = hashlib.sha256(payload).hexdigest()
    else:
        by_date = h.get("warc-refers-to-target-uri") and h.get("warc-refers-to-date")
        if payload or not (h.get("warc-refers-to") or by_date):
            raise ValueError("a revisit refers to nothing or has a payload")
        if by_date:
            check_date(h["warc-refers-to-date"])
        digest = digest and re.sub(r"(?i)^sha-?256:([0-9a-f]{64})$", lambda m: m[1].lower(), digest)
    bare = lambda k: h[k].strip("<>") if kind == "revisit" and h.get(k) else None
    return {"record_id": h["warc-record-id"].strip("<>"), "record_type": kind,
            "target_uri": h["warc-target-uri"].strip("<>") if "warc-target-uri" in h else None,
            "warc_date": h["warc-date"], "payload_bytes": n, "payload_digest": digest, "refers_to": bare("warc-refers-to"),
            "refers_to_uri": bare("warc-refers-to-target-uri"), "refers_to_date": bare("warc-refers-to-date"),
            "payload": None if kind == "revisit" else payload, "error": None}


def with_targets(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to`` of revisits that name a URI and a date: the id of the record that has both (the smallest of
    several), null where the archives hold none. A URI and date is one row before the join, so a hot one costs what any other does."""
    named = records.filter("record_type <> 'revisit' and target_uri is not null") \
        .groupBy(F.col("target_uri").alias("refers_to_uri"), F.col("warc_date").alias("refers_to_date")) \
        .agg(F.min("record_id").alias("_named"))
    return records.join(named, ["refers_to_uri", "refers_to_date"], "left") \
        .withColumn("refers_to", F.coalesce("refers_to", "_named")).select(*records.columns)


def read_warc(archives: DataFrame, name: str = "name", content: str = "content", payloads: bool = True,
              strict: bool = True) -> DataFrame:
    """A row per record of the archives (a table of whole archives, each of bounded size)."""
    cols = [c.split()[0] for c in RECORDS.split(", ")]
    schema = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in cols])

    def unpack(batches):
        for b in batches:
            for where, whole in zip(b.column(0), b.column(1), strict=True):
                rows: list[dict] = []
                where, size = where.as_py(), 0
                try:
                    for rec in frames(whole.as_py() or b""):
                        rows.append(parse(rec) | {"archive": where})
                        size += len(rec)
                        if not payloads:
                            rows[-1]["payload"] = None
                        if size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except (ValueError, zstandard.ZstdError, UnicodeDecodeError) as e:
                    if strict:
                        raise ValueError(f"{where}: {e}") from e
                    rows.append({"archive": where, "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(unpack, RECORDS)


def export_files(archives: DataFrame, uri: str) -> DataFrame:
    """Write each archive as a file below ``uri`` (a folder of a store that pyarrow can write); a
    file appears under its name only when it is whole. Returns name, n_bytes; runs when the result is read."""

    def save(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, f"{base}/{name}")
                yield pa.RecordBatch.from_pydict({"name": [name], "n_bytes": [len(content)]})

    return archives.select("name", "content").mapInArrow(save, "name string, n_bytes long")


def warc_roundtrip(pages: DataFrame) -> DataFrame:
    """Write every page to archives, read them back, and give a row per record by page."""
    got = read_warc(write_warc(pages), payloads=False)
    kind = pages.schema["page_id"].dataType.simpleString()
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast(kind)
    return got.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      page("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
                  strlen(coalesce(html, '')) AS payload_bytes FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""
