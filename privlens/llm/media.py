"""Media columns in a content-addressed chunk store.

A payload of 8-bit samples is cut where a rolling gear hash says so, so that equal stretches of
different payloads give equal chunks. Chunks are keyed by digest, de-duplicated by a Spark
aggregation and kept in a table bucketed by digest; each row keeps only its ordered chunk list.
What is stored for a row is a WAV file, 8-bit mono, whose samples are the payload: its header stands in the
row's list, its samples are the chunks. Reading joins the lists with the store (the store's side needs no
shuffle), restores each file in order and verifies the digests of its chunks and of the whole file; payload
and features are taken from the file that was read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlens.llm.common import configure, discard, materialize, shared_dir, utf8, with_fields

#: Payloads are padded with zero bytes to a positive multiple of this.
UNIT = 64
#: Chunk sizes: none shorter than the first (but the last of a payload), none longer than the second; cuts on average every 2**BITS bytes.
MIN_CHUNK, MAX_CHUNK, BITS = 1024, 32768, 12
#: The window of the rolling hash in bytes (its width in bits).
WINDOW = 32
SAMPLE_RATE = 8000
#: Chunk bodies are compressed at this level with a dictionary of this size, trained on the beginnings of so many rows.
LEVEL, DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_CHARS = 16, 112 << 10, 512, 4096
#: The digest under which a store keeps its dictionary.
DICTIONARY_KEY = b""
_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash ``h = (h << 1) + gear[byte]`` after each byte, by doubling windows instead of a loop."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cut_points(data: np.ndarray) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    marks = np.flatnonzero(gear_hash(data) >> np.uint32(32 - BITS) == 0) + 1
    ends, at = [], 0
    while n - at > MIN_CHUNK:
        i = np.searchsorted(marks, at + MIN_CHUNK)
        end = int(marks[i]) if i < len(marks) else n
        end = min(end, at + MAX_CHUNK, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def padded(data: bytes) -> bytes:
    return data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


#: Bytes of a WAV header.
HEADER = 44


def wav_header(n: int) -> bytes:
    """The header of a WAV file of ``n`` unsigned 8-bit samples, one channel."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n & 0xFFFFFFFF)


def wav_samples(file: bytes) -> bytes:
    """The samples of a WAV file made here; another header raises."""
    if file[:HEADER] != wav_header(len(file) - HEADER):
        raise ValueError("not a WAV file of 8-bit samples")
    return file[HEADER:]


def features(payload: bytes) -> str:
    """Mean, root mean square about the midpoint, zero crossings and peak of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={int(x.sum()) / len(x):.6f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.6f};crossings={crossings};peak={int(np.abs(x).max())}"


def _payloads(col):
    buf, at = utf8(col)
    data = buf.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield b - a, padded(data[a:b])


def chunk_lists(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``n_bytes``, ``media_sha256`` of the whole file, its ``head`` and ``chunks``, the ordered list of its samples' digests."""
    schema = with_fields(df, keep, "n_bytes long, media_sha256 binary, head binary, chunks array<binary>")

    def run(batches):
        for batch in batches:
            sizes, shas, heads, lists = [], [], [], []
            for n, data in _payloads(batch.column(batch.num_columns - 1)):
                at, digests = 0, []
                for end in cut_points(np.frombuffer(data, np.uint8)):
                    digests.append(hashlib.blake2b(data[at:end], digest_size=20).digest())
                    at = end
                head = wav_header(len(data))
                sizes.append(n)
                heads.append(head)
                shas.append(hashlib.sha256(head + data).digest())
                lists.append(digests)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(heads, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=[*keep, "n_bytes", "media_sha256", "head", "chunks"])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)


def train_dictionary(df: DataFrame, text: str) -> bytes:
    """A compression dictionary from a bounded sample, the rows of least text digest; empty where too little text is there. It changes sizes, never contents."""
    whole = df.select(F.col(text).alias("t")).where("t <> ''").select(F.xxhash64("t").alias("o"), F.substring("t", 1, SAMPLE_CHARS).alias("t"))
    # digests alone find the sample; its texts are all that reaches the driver
    last = whole.select("o").distinct().orderBy("o").limit(SAMPLE_ROWS).agg(F.max("o")).first()[0]
    rows = whole.where(F.col("o") <= last).dropDuplicates(["o"]).orderBy("o").collect() if last is not None else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r["t"].encode() for r in rows], k=64, d=6).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _with_dictionary(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def chunk_bodies(df: DataFrame, text: str, dictionary: bytes = b"") -> DataFrame:
    """``(digest, body)`` of every chunk, bodies compressed; a chunk that a task has just sent is not sent again."""

    def run(batches):
        more = _with_dictionary(dictionary)
        if more:
            more["dict_data"].precompute_compress(level=LEVEL)
        pack = zstandard.ZstdCompressor(level=LEVEL, **more)
        recent: set[bytes] = set()
        for batch in batches:
            digests, bodies = [], []
            for _, data in _payloads(batch.column(0)):
                at = 0
                for end in cut_points(np.frombuffer(data, np.uint8)):
                    digest = hashlib.blake2b(data[at:end], digest_size=20).digest()
                    if digest not in recent:
                        if len(recent) >= 100_000:
                            recent.clear()
                        recent.add(digest)
                        digests.append(digest)
                        bodies.append(pack.compress(data[at:end]))
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], names=["digest", "body"])

    return df.select(text).mapInArrow(run, "digest binary, body binary")


class MediaStore:
    """A chunk table in the shared folder and the table of chunk lists that refer to it."""

    def __init__(self, spark, table: str, lists: DataFrame):
        self.spark, self.table, self.lists = spark, table, lists

    def drop(self) -> None:
        """Delete the store; what was read from it lazily is gone with it."""
        bodies = self.spark.table(self.table)
        bodies.written_to = f"{shared_dir(self.spark)}/{self.table}"
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        discard(self.lists, bodies)


def store(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> MediaStore:
    """Store each row's payload; null text is an empty one. Rows get a ``media_key``, unique in the store."""
    spark = df.sparkSession
    configure(spark)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("n_bytes", "media_sha256", "head", "chunks", "media_key")]
    src = df.select(*[df[c] for c in keep], df[text].alias("__payload"))
    table = f"media_chunks_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one body per digest: copies of a chunk meet as (digest, row of bodies), folded on the map side by the task's memory of recent chunks
    dictionary = train_dictionary(src, "__payload")
    distinct = chunk_bodies(src, "__payload", dictionary).repartition(n, "digest").dropDuplicates(["digest"])
    distinct = distinct.unionByName(spark.createDataFrame([(bytearray(DICTIONARY_KEY), bytearray(dictionary))], "digest binary, body binary"))
    # bucketed, so a table; its files lie in the shared folder, wherever the warehouse is
    distinct.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").bucketBy(n, "digest").saveAsTable(table)
    lists = materialize(chunk_lists(src, "__payload", keep).withColumn("media_key", F.monotonically_increasing_id()), "media")
    return MediaStore(spark, table, lists)


def read_back(media: MediaStore) -> DataFrame:
    """The stored rows' keys with ``media``, each file restored and verified, one row per stored row."""
    spark = media.spark
    dictionary = bytes(spark.table(media.table).where(F.octet_length("digest") == 0).select("body").first()["body"])
    refs = media.lists.select("media_key", F.posexplode("chunks").alias("at", "digest"))
    parts = refs.join(spark.table(media.table), "digest").select("media_key", "at", "digest", "body")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.select("media_key", "at", F.lit(None).cast("binary").alias("sha"), "digest", "body", F.lit(0).alias("n"))
    heads = media.lists.select("media_key", F.lit(-1).alias("at"), F.col("media_sha256").alias("sha"), F.lit(None).cast("binary").alias("digest"), F.col("head").alias("body"), F.size("chunks").alias("n"))
    sorted_parts = heads.union(parts).repartition(n, "media_key").sortWithinPartitions("media_key", "at")

    def run(batches):
        unpack = zstandard.ZstdDecompressor(**_with_dictionary(dictionary))
        key, want, left, parts = None, b"", 0, []

        def finish():
            payload = b"".join(parts)
            if left or hashlib.sha256(payload).digest() != want:
                raise ValueError(f"media {key}: its chunks do not restore it")
            return payload

        for batch in batches:
            keys, payloads, size = [], [], 0
            for k, at, sha, digest, body, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if at < 0:
                    if key is not None:
                        keys.append(key)
                        payloads.append(finish())
                    key, want, left, parts = k, sha, n, [body]
                    continue
                data = unpack.decompress(body)
                if hashlib.blake2b(data, digest_size=20).digest() != digest:
                    raise ValueError(f"media {key}: chunk {at} differs from its digest")
                parts.append(data)
                left -= 1
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], names=["media_key", "media"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([finish()], pa.binary())], names=["media_key", "media"])

    return sorted_parts.mapInArrow(run, "media_key long, media binary")


def media_features(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text, read it back and describe what was read; equal texts give equal values.

    Columns: id, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``, ``media_bytes``,
    ``media_sha256``, ``feature``. Null and empty texts give one unit of zero samples. Ids may repeat or
    be null; other columns are ignored.
    """
    media = store(df.select(df[id_col].alias("id"), df[text].alias("text")), "text", ["id"])
    restored = read_back(media)

    def run(batches):
        for batch in batches:
            rows = []
            for k, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = wav_samples(file)
                rows.append((k, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), features(data)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["media_key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    described = restored.mapInArrow(run, "media_key long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    names = media.lists.select("media_key", F.col("id").alias(id_col), "n_bytes")
    out = names.join(described, "media_key").select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    # what was read is kept, the store is not
    out = materialize(out, "described")
    media.drop()
    return out
