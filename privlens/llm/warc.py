"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are rows of a table, ``(archive string, content binary)``, so that Spark itself commits them
and a lost task leaves no half-written archive. The reader walks an archive frame by frame, takes the
dictionary from the skippable frame, and validates every record's headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlens.llm.common import configure, materialize

#: Uncompressed payload bytes after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Smallest payload, in bytes, that may become a revisit.
REVISIT_BYTES = 1000
#: Dictionary size, and the most sample bytes it is trained on, per archive.
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20
#: Magic numbers of the public formats: the dictionary's skippable frame, a Zstandard frame, a trained dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
LEVEL = 3


def record_bytes(kind: str, uri: str, page_id, payload: bytes, digest: str, length: int, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has an empty block and names the record it repeats."""
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    clean = "".join(c for c in (uri or "about:blank") if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {length}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_archive(records: list[bytes], samples: list[bytes]) -> bytes:
    """Records as an archive: the dictionary frame (left out if too few samples train one), then a frame per record."""
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=LEVEL) if len(samples) >= 8 else None
    except zstandard.ZstdError:
        trained = None
    out = []
    if trained:
        raw = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
        out.append(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def read_archive(content: bytes):
    """Yield ``(headers, block)`` of each record; raises ValueError on a bad frame, header or length."""
    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", content, 4)[0]
        raw = content[8 : 8 + size]
        if len(raw) != size or size < 4:
            raise ValueError("the dictionary frame is cut short")
        if struct.unpack_from("<I", raw)[0] == FRAME:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if struct.unpack_from("<I", raw)[0] != DICTIONARY:
            raise ValueError("the skippable frame holds no dictionary")
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(content)
    while at < len(content):
        if len(content) - at < 4 or struct.unpack_from("<I", content, at)[0] != FRAME:
            raise ValueError(f"no frame at byte {at}")
        part = unpacker.decompressobj()
        try:
            # a slice as large as a frame of this content can be; what it leaves over is the next frame's
            size = zstandard.get_frame_parameters(content[at : at + 18]).content_size
            bound = size + (size >> 8) + 512 if size not in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR) else len(content)
            chunk = view[at : at + bound]
            record = part.decompress(chunk)
        except zstandard.ZstdError as e:
            raise ValueError(f"bad frame at byte {at}: {e}") from e
        if not part.eof:
            raise ValueError(f"the frame at byte {at} is cut short")
        at += len(chunk) - len(part.unused_data)
        yield _parse(record)


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    cut = record.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError("a record's header has no end")
    lines = record[:cut].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:20]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line: {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"a record lacks {name}")
    length = int(headers["content-length"])
    block = record[cut + 4 : cut + 4 + length]
    if len(block) != length or record[cut + 4 + length :] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its Content-Length")
    return headers, block


def write_archives(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives ``(archive, records, content)`` of one record per row of ``df``.

    Of rows with equal payloads of at least :data:`REVISIT_BYTES` bytes, the one with the largest id is
    the response and the others revisit it; equal ids with equal payloads are all responses. Null html
    is an empty payload. A null id never answers for others unless all ids of a payload are null, and
    then all are responses.
    """
    configure(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("page_id"), df[url].cast("string").alias("url"), F.coalesce(df[html], F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    # only digests that occur twice travel back to the rows: the first pass reads no more than it must
    counts = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("low"))
    repeated = counts.where("n > 1").select("digest", "low")
    marked = rows.join(repeated, "digest", "left")

    def run(batches):
        records, samples, size, sampled, ids = [], [], 0, 0, []

        def close():
            name = hashlib.sha1("\n".join(ids).encode()).hexdigest()
            return pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.zst"], "records": [len(records)], "content": [write_archive(records, samples)]}, schema=out)

        out = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            for page, uri, text, digest, low in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "low"))):
                payload = text.encode()
                revisit = low is not None and page != low
                records.append(record_bytes("revisit" if revisit else "response", uri, page, b"" if revisit else payload, digest, len(payload), low))
                ids.append(f"{page}:{digest}")
                if sampled < SAMPLE_BYTES:
                    samples.append(records[-1])
                    sampled += len(records[-1])
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    records, samples, size, sampled, ids = [], [], 0, 0, []
        if records:
            yield close()

    return marked.select("page_id", "url", "html", "digest", "low").mapInArrow(run, "archive string, records long, content binary")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of a table of archives: ``page_id, record_type, refers_to, payload_bytes, payload_digest`` (and ``payload``).

    A response's digest and length are computed from its block and must agree with its headers; a
    revisit has an empty block, so its headers speak for the payload it repeats.
    """
    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads

    def run(batches):
        fields = [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        out = pa.schema(fields + [("payload", pa.binary())] * payloads)
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in read_archive(content.as_py()):
                    page = head["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                    said = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    length = int(head["x-payload-length"])
                    if head["warc-type"] == "response" and (hashlib.sha1(block).hexdigest() != said or len(block) != length):
                        raise ValueError(f"page {page}: the payload differs from its digest or length")
                    if head["warc-type"] == "revisit" and block:
                        raise ValueError(f"page {page}: a revisit with a block")
                    to = head.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                    rows.append((int(page) if page else None, head["warc-type"], int(to) if to else None, length, said) + (block,) * payloads)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    return archives.select("content").mapInArrow(run, schema)


def warc_round_trip(df: DataFrame) -> DataFrame:
    """Write ``df``'s pages to archives in the shared folder and read the records back."""
    configure(df.sparkSession)
    # a reader's batch holds a row group at most: groups of two archives or so keep it small
    return read_archives(materialize(write_archives(df), "archives", **{"parquet.block.size": str(2 * ARCHIVE_BYTES)}))


#: The registered query in DuckDB SQL.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT payload_digest, max(page_id) AS low, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN low IS NOT NULL AND p.page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN low IS NOT NULL AND p.page_id <> low THEN low END AS refers_to
FROM p LEFT JOIN r USING (payload_digest)
"""
