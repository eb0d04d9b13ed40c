"""Alignment of two tokenizers by distinct segments.

A text is cut before runs of white space, wherever neither vocabulary has a token that reaches across
such a place: what stands between two cuts is then tokenised as it would be in the text. Documents are
read in chunks; a chunk keeps its distinct segments once and every document as numbers of
them. Each distinct segment of the corpus is tokenised and aligned once, the alignments are joined back
to the chunks' segments, and a chunk's documents are composed from them. A document then has the pairs
of ids that it links and how often; how many documents hold a pair is joined back to the chunks, too.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlens.llm.common import configure, discard, materialize, with_fields

#: Bytes of text a chunk: the more, the fewer of its segments stand in other chunks too.
CHUNK_BYTES = 32 << 20
#: Words of a chunk's documents whose links are counted at once; bounds a worker's memory.
WORDS_AT_ONCE = 400_000
#: Alignments that travel to a chunk as one compressed row, at most; bounds a worker's memory.
BUNDLE_ROWS = 100_000
#: A chunk is numbered by its task and its place there, a segment by its chunk and its place there, in one number.
CHUNK_BITS, CODE_BITS = 16, 27
#: White space before which a text may be cut, if the vocabularies allow it.
SPACES = " \n\t\v\f\r"
#: Appended to a serialized piece model, this sets its ``add_dummy_prefix`` to false: repeated fields of a message are merged.
NO_PREFIX = b"\x1a\x02\x18\x00"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE tokenizer file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        value, special = byte_values(), {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        found = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(found.values()) + 1)
        for token, i in found.items():
            if token not in special:
                self.bytes[i] = bytes(map(value.__getitem__, token))
        probe = self.encode([" a b", "a  b\n"])
        if any(b"".join(map(self.bytes.__getitem__, ids)) != text for ids, text in zip(probe, (b" a b", b"a  b\n"))):
            raise ValueError(f"{path} changes white space, so texts cannot be cut at it")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A piece model, without the space that it would put before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            self.model = SentencePieceProcessor(model_proto=f.read() + NO_PREFIX)
        if self.model.normalize("  a  b ") != "▁▁a▁▁b▁":
            raise ValueError(f"{path} changes white space, so texts cannot be cut at it")
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(self.model.id_to_piece(i)[1:-1], 16)])
        return self.model.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def safe_spaces(*vocabularies: list[bytes]) -> str:
    """Those of :data:`SPACES` that follow something other than white space in no token, so that no merge reaches across the place before them."""
    unsafe = set()
    for vocabulary in vocabularies:
        for token in vocabulary:
            text = token.decode("utf-8", "replace")
            unsafe.update(b for a, b in zip(text, text[1:]) if b in SPACES and not a.isspace())
    return "".join(c for c in SPACES if c not in unsafe)


def segment_pattern(spaces: str) -> re.Pattern:
    """Finds segments: each starts at a text's start or at a run of white space whose first character is one of ``spaces``."""
    if not spaces:
        return re.compile(r"(?s).+")
    return re.compile(rf"(?:\s+\S*|\S+)(?:[^\S{re.escape(spaces)}]\s*\S*)*")


class Aligner:
    """Both tokenizers of a worker process, and where texts may be cut."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.split = segment_pattern(safe_spaces(self.a.bytes, self.b.bytes)).findall
        self.size_a, self.size_b = [list(map(len, x.bytes)) for x in (self.a, self.b)]

    def groups(self, a: list[int], b: list[int]):
        """``(ids of A, ids of B)`` between byte offsets where tokens of both end, and the overlapping pairs of groups that have several of both."""
        if len(a) == 1 or len(b) == 1:
            return [(a, b)], []
        found, links, own, i, j, first_i, first_j = [], [], [], 0, 0, 0, 0
        end_a, end_b = self.size_a[a[0]], self.size_b[b[0]]
        while True:
            own.append((a[i], b[j]))
            if end_a == end_b:
                found.append((a[first_i : i + 1], b[first_j : j + 1]))
                if i > first_i and j > first_j:
                    links += own
                i, j, own = i + 1, j + 1, []
                if i == len(a):
                    return found, links
                first_i, first_j, end_a, end_b = i, j, end_a + self.size_a[a[i]], end_b + self.size_b[b[j]]
            elif end_a < end_b:
                i += 1
                end_a += self.size_a[a[i]]
            else:
                j += 1
                end_b += self.size_b[b[j]]

    def align(self, segments: list[str]):
        """Each segment's alignment as text; empty where a tokenizer's bytes are not the segment's."""
        for text, a, b in zip(segments, self.a.encode(segments), self.b.encode(segments)):
            raw = text.encode()
            if b"".join(map(self.a.bytes.__getitem__, a)) != raw or b"".join(map(self.b.bytes.__getitem__, b)) != raw:
                yield ""
                continue
            groups, links = self.groups(a, b)
            said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            yield f"{said}\t{' '.join(f'{x},{y}' for x, y in links)}" if links else said


def read_alignment(groups: str, several: str, width: int) -> tuple[int, int, int, list[int]]:
    """``n_a, n_b, n_groups`` and all links ``a * width + b`` of an alignment's text: in a group with one token on a side all pairs overlap."""
    n_a = n_b = n = 0
    links = [int(x) * width + int(y) for x, y in (p.split(",") for p in several.split(" "))] if several else []
    for group in groups.split(";"):
        a, b = group.split("|")
        n += 1
        if "," not in a:
            n_a += 1
            if "," not in b:
                n_b += 1
                links.append(int(a) * width + int(b))
                continue
            first, y = int(a) * width, b.split(",")
            n_b += len(y)
            links += [first + int(q) for q in y]
        else:
            x = a.split(",")
            n_a += len(x)
            if "," in b:
                n_b += b.count(",") + 1
            else:
                n_b += 1
                y = int(b)
                links += [int(p) * width + y for p in x]
    return n_a, n_b, n, links


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """An :class:`Aligner`; one per worker process, kept between tasks."""
    return Aligner(path_a, path_b)


class Numbers(dict):
    """Numbers of a chunk's distinct segments, in the order of their first use."""

    def __missing__(self, segment: str) -> int:
        made = self[segment] = len(self)
        return made


def packed(codes: list[int], packer: zstandard.ZstdCompressor) -> bytes:
    """Segment numbers as bytes: 32 bits each, all low bytes first, compressed; nothing for none."""
    return packer.compress(np.asarray(codes, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes()) if codes else b""


def unpacked(data: bytes, unpacker: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(np.frombuffer(unpacker.decompress(data), np.uint8).reshape(4, -1).T.tobytes(), "<i4") if data else np.zeros(0, np.int32)


def chunked(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of two kinds: ``chunk, id, codes`` of each document, and ``place, segment`` of each distinct segment of a chunk.

    ``place`` is the chunk's number followed by the segment's. A text gets a space before it; null and empty texts have
    no segments.
    """
    src = df.select(df[id_col].alias("id"), df[text].alias("text"))
    schema = with_fields(src, ["id"], "chunk long, codes binary, place long, segment string")

    def run(batches):
        split, packer = aligner(path_a, path_b).split, zstandard.ZstdCompressor()
        chunk, size, numbers = TaskContext.get().partitionId() << CHUNK_BITS, 0, Numbers()

        def documents(ids: pa.Array, codes: list[bytes]):
            n = len(codes)
            return pa.RecordBatch.from_arrays([ids, pa.array([chunk] * n, pa.int64()), pa.array(codes, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=names)

        def segments():
            n, first = len(numbers), chunk << CODE_BITS
            return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(first, first + n), pa.int64()), pa.array(list(numbers), pa.string())], names=names)

        names, kind = ["id", "chunk", "codes", "place", "segment"], None
        for batch in batches:
            kind, first, codes = batch.column(0).type, 0, []
            for at, t in enumerate(batch.column(1).to_pylist()):
                codes.append(packed(list(map(numbers.__getitem__, split(" " + t))), packer) if t else b"")
                size += len(t or "")
                if size >= CHUNK_BYTES:
                    yield documents(batch.column(0)[first : at + 1], codes)
                    yield segments()
                    first, codes, size, chunk, numbers = at + 1, [], 0, chunk + 1, Numbers()
            if codes:
                yield documents(batch.column(0)[first:], codes)
        if numbers:
            yield segments()

    return src.mapInArrow(run, schema)


def align_segments(segments: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``segment, reply`` of ``segments(segment)``: its alignment as text, the groups and, behind a tab, the links of groups of several tokens on both sides; empty where a tokenizer's bytes are not the segment's."""

    def run(batches):
        made = aligner(path_a, path_b)
        for batch in batches:
            replies = list(made.align(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string())], names=["segment", "reply"])

    return segments.mapInArrow(run, "segment string, reply string")


def bundled(replies: DataFrame) -> DataFrame:
    """``chunk, bundle`` of ``replies(place, reply)``: what a task has for a chunk as one compressed row, a line for each segment."""

    def run(batches):
        places, lines, packer = [], [], zstandard.ZstdCompressor()

        def bundles():
            at = np.concatenate(places)
            order = np.argsort(at, kind="stable")
            chunks, codes = at[order] >> CODE_BITS, (at[order] & ((1 << CODE_BITS) - 1)).tolist()
            starts = np.flatnonzero(np.concatenate(([True], chunks[1:] != chunks[:-1])))
            said = list(map(lines.__getitem__, order.tolist()))
            packed = [packer.compress("\n".join(f"{c}\t{r}" for c, r in zip(codes[a:b], said[a:b])).encode()) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)])]
            return pa.RecordBatch.from_arrays([pa.array(chunks[starts], pa.int64()), pa.array(packed, pa.binary())], names=["chunk", "bundle"])

        for batch in batches:
            places.append(batch.column(0).to_numpy(zero_copy_only=False))
            lines += batch.column(1).to_pylist()
            if len(lines) >= BUNDLE_ROWS:
                yield bundles()
                places, lines = [], []
        if lines:
            yield bundles()

    return replies.mapInArrow(run, "chunk long, bundle binary")


class Replies:
    """A chunk's alignments, by its segments' numbers."""

    def __init__(self, bundles: list[bytes], width: int):
        unpacker = zstandard.ZstdDecompressor()
        rows = [line.split("\t") for b in bundles for line in unpacker.decompress(b).decode().split("\n")]
        rows.sort(key=lambda r: int(r[0]))
        self.groups = [r[1] for r in rows]
        # a segment that a tokenizer changes has no alignment
        read = [read_alignment(r[1], r[2] if len(r) > 2 else "", width) if r[1] else (0, 0, 0, []) for r in rows]
        self.bad = np.array([not r[1] for r in rows], bool)
        self.figures = np.array([r[:3] for r in read], np.int64).reshape(-1, 3)
        self.n_links = np.array([len(r[3]) for r in read], np.int64)
        self.first = np.cumsum(self.n_links) - self.n_links
        # links by their place among the chunk's distinct ones
        self.values, self.which = np.unique(np.array([x for r in read for x in r[3]], np.int64), return_inverse=True)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def composer(width: int):
    """:func:`compose` for a vocabulary B of ``width`` pieces."""

    def run(documents: pa.Table, bundles: pa.Table) -> pa.Table:
        return compose(documents, bundles, width)

    return run


def compose(documents: pa.Table, bundles: pa.Table, width: int) -> pa.Table:
    """A chunk's documents from its segments' alignments: their figures, the digest of their groups, and their distinct links with how often each occurs."""
    unpacker = zstandard.ZstdDecompressor()
    lists = [unpacked(x, unpacker) for x in documents.column("codes").to_pylist()]
    at, n = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64), len(lists)
    codes = np.concatenate([*lists, np.zeros(0, np.int32)])
    replies = Replies(bundles.column("bundle").to_pylist(), width)
    owner = np.repeat(np.arange(n), np.diff(at))
    whole = np.bincount(owner[replies.bad[codes]], minlength=n) == 0
    out = {"chunk": documents.column("of"), "id": documents.column("id")}
    for name, of_segment in zip(FIGURES, (*replies.figures.T, replies.n_links)):
        sums = np.concatenate(([0], np.cumsum(of_segment[codes])))
        out[name] = pa.array(np.where(whole, sums[at[1:]] - sums[at[:-1]], 0).astype(np.int64))
    text, flat = replies.groups.__getitem__, codes.tolist()
    digests = [hashlib.sha256(";".join(map(text, flat[a:b])).encode()).hexdigest() if good and b > a else "" for a, b, good in zip(at[:-1].tolist(), at[1:].tolist(), whole.tolist())]
    keep, distinct, held, links, times = whole[owner], max(1, len(replies.values)), [], [], []
    first = 0
    while first < n:
        # whole documents, as many as WORDS_AT_ONCE bounds: distinct segments of each, then distinct links
        after = max(first + 1, int(np.searchsorted(at, at[first] + WORDS_AT_ONCE, "right")) - 1)
        part = slice(int(at[first]), int(at[after]))
        pairs, often = np.unique(owner[part][keep[part]] * max(1, len(replies.bad)) + codes[part][keep[part]], return_counts=True)
        doc, code = np.divmod(pairs, max(1, len(replies.bad)))
        m = replies.n_links[code]
        spread = np.repeat(replies.first[code] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        found, back = np.unique(np.repeat(doc, m) * distinct + replies.which[spread], return_inverse=True)
        held.append(found // distinct)
        links.append(replies.values[found % distinct])
        times.append(np.bincount(back, np.repeat(often, m), len(found)).astype(np.int64))
        first = after
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64), minlength=n)))).astype(np.int32))
    listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)))
    return pa.table(out | {"groups_sha256": pa.array(digests, pa.string()), "links": listed(links), "times": listed(times)})


def link_counts(composed: DataFrame, width: int) -> DataFrame:
    """``link, docs, is_best``: how many documents hold each linked pair of ids, and whether that is the most of its id of A."""
    counts = materialize(composed.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("docs")), "counts")
    best = counts.groupBy(F.expr(f"link div {width}").alias("a")).agg(F.max("docs").alias("most"))
    judged = counts.join(best, F.expr(f"link div {width}") == F.col("a"))
    return judged.select("link", "docs", (F.col("docs") == F.col("most")).cast("long").alias("is_best"))


RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def summed(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with ``n_best`` and ``count_sum`` from the counts of the chunk's links."""
    counts = counts.sort_by("link").combine_chunks()
    known, docs, best = (counts.column(c).to_numpy() for c in ("link", "docs", "is_best"))
    lists = documents.column("links").combine_chunks()
    at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    where = np.searchsorted(known, lists.flatten().to_numpy(zero_copy_only=False))
    times = documents.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    out = {c: documents.column(c) for c in ("id", *FIGURES)}
    for name, of_link in (("n_best", best), ("count_sum", docs)):
        sums = np.concatenate(([0], np.cumsum(of_link[where] * times)))
        out[name] = pa.array((sums[at[1:]] - sums[at[:-1]]).astype(np.int64))
    return pa.table(out | {"groups_sha256": documents.column("groups_sha256")})


def align_documents(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups_sha256``.

    ``path_a`` is a byte-level BPE file, ``path_b`` a piece model, at the same place on every node; both see the text with a space
    before it. Null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros and
    an empty digest. Of repeated rows each counts as a document. Empty table: no rows.
    """
    configure(df.sparkSession)
    width = len(Pieces(path_b).bytes)
    encoded = materialize(chunked(df, path_a, path_b, id_col, text), "chunks")
    asked = encoded.where("segment is not null").select("place", "segment")
    alignments = materialize(align_segments(asked.select("segment").distinct(), path_a, path_b), "alignments")
    replies = bundled(asked.join(alignments, "segment").select("place", "reply"))
    documents = encoded.where("codes is not null").select(F.col("chunk").alias("of"), "id", "codes")
    schema = with_fields(documents.select(F.col("of").alias("chunk"), "id"), ["chunk", "id"], ", ".join(f"{f} long" for f in FIGURES) + ", groups_sha256 string, links array<long>, times array<long>")
    composed = materialize(documents.groupBy("of").cogroup(replies.groupBy("chunk")).applyInArrow(composer(width), schema), "composed")
    discard(encoded, alignments)
    # every chunk gets the counts of its own links
    wanted = composed.select("chunk", F.explode("links").alias("link")).distinct()
    counts = wanted.join(link_counts(composed, width), "link").select(F.col("chunk").alias("of"), "link", "docs", "is_best")
    schema = with_fields(composed, ["id"], ", ".join(f"{f} long" for f in RESULTS) + ", groups_sha256 string")
    return composed.groupBy("chunk").cogroup(counts.groupBy("of")).applyInArrow(summed, schema).withColumnRenamed("id", id_col)
