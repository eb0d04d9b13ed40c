"""Byte-level BPE as a lazily determinised transducer, and streaming UTF-8 decoding.

The merges are compiled into two relations: the trie of the tokens, and which token may follow which
(``a`` then ``b`` is the encoding of their concatenation). The last token of the encoding of every
prefix is then unique, so a left-to-right machine needs to remember only the positions from which a
token may still be under way. A state is the set of those hypotheses, each with its trie node, the
token before it and the tokens not yet emitted; what all hypotheses agree on is emitted at once, so
the lookahead is bounded by the longest token. States and transitions are made on first use.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import gc
import hashlib
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from privlens.llm.common import configure, spare, with_fields

#: Transitions kept before the machine's memory is dropped and filled anew; bounds a worker's memory.
MAX_TRANSITIONS = 400_000
#: Encodings of matches of the split pattern kept by a worker, and the longest match kept.
MAX_MATCHES, LONGEST_MATCH = 250_000, 48
#: Whether arrays of the machine are the bytes of little-endian unsigned 32-bit ids.
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def id_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes byte strings by the ranks; see the module's docstring."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        # trie nodes: children by byte; the token that ends at a node
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                after = self.children[node].get(b)
                if after is None:
                    after = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = after
            self.ends[node] = rank
        self.follows: dict[tuple[int, int], bool] = {}
        self.as_left: dict[int, tuple[bool, list]] = {}
        self.as_right: dict[int, tuple[bool, list]] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self.ids = {start: 0}
        self.states = [start]
        self.step: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.size = 0

    def _merges(self, token: bytes) -> list[tuple[int, bytes, bytes]]:
        """Merging of ``token`` by lowest rank, leftmost first: before each merge its rank and the first and last part; at the end the parts that are left."""
        parts = [token[i : i + 1] for i in range(len(token))]
        get, steps = self.ranks.get, []
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            steps.append((len(self.ranks) if best is None else best, parts[0], parts[-1]))
            if best is None:
                return steps
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _edge(self, token: int, right: bool) -> tuple[bool, list]:
        """Whether ``token`` merges into itself, and its merges' ranks with the part at its left or right edge before each."""
        known = self.as_right if right else self.as_left
        made = known.get(token)
        if made is None:
            data = self.tokens[token]
            steps = self._merges(data)
            made = known[token] = (steps[-1][1] == data, [(rank, first if right else last) for rank, first, last in steps])
        return made

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` is the encoding of their concatenation.

        Both merge as they would alone until a merge across their border is the lowest there is (of equal ranks the
        leftmost goes first); only the parts at the border and the rank of each side's next merge count.
        """
        if a < 0:
            return self._edge(b, True)[0]
        key = (a, b)
        known = self.follows.get(key)
        if known is not None:
            return known
        if len(self.follows) > MAX_TRANSITIONS:
            self.follows.clear()
        (whole, left), (also, right) = self._edge(a, False), self._edge(b, True)
        known = whole and also
        get, i, j, last_i, last_j = self.ranks.get, 0, 0, len(left) - 1, len(right) - 1
        while known:
            (next_a, x), (next_b, y) = left[i], right[j]
            across = get(x + y)
            if across is not None and across < next_a and across <= next_b:
                known = False
            elif i == last_i and j == last_j:
                break
            elif next_a <= next_b:
                i += 1
            else:
                j += 1
        self.follows[key] = known
        return known

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the transition of ``state`` on ``byte``: the state reached and the tokens emitted."""
        live, ended, children, ends = [], None, self.children, self.ends
        for node, last, pending in self.states[state]:
            after = children[node].get(byte)
            if after is None:
                continue
            if ended is None and (token := ends[after]) is not None and self._may_follow(last, token):
                ended = (*pending, token)
            if children[after]:
                live.append((after, last, pending))
        if ended is None:
            raise ValueError(f"byte {byte} cannot be encoded by this vocabulary")
        # the tokens that every hypothesis has next are emitted
        common = len(ended)
        for _, _, pending in live:
            if pending[:common] != ended[:common]:
                common = next(i for i, (x, y) in enumerate(zip((*pending, -1), ended)) if x != y)
        live.append((0, ended[-1], ended))
        key = tuple([(n, t, p[common:]) for n, t, p in live] if common else live)
        target = self.ids.get(key)
        if target is None:
            target = self.ids[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
        self.size += 1
        made = self.step[state][byte] = (target, ended[:common])
        return made

    def encode(self, data: bytes) -> list[int]:
        if self.size > MAX_TRANSITIONS:
            self._reset()
        out: list[int] = []
        state, step = 0, self.step
        for byte in data:
            after = step[state].get(byte)
            if after is None:
                after = self._advance(state, byte)
            state, emitted = after
            if emitted:
                out += emitted
        return out + list(self.states[state][-1][2])


class MatchEncoder(dict):
    """Whole texts to little-endian unsigned 32-bit ids, each match of the split pattern by itself, remembering matches.

    A full memory becomes the old one, from which matches still in use come back.
    """

    def __init__(self, machine: Transducer, pattern: str):
        super().__init__()
        self.machine, self.split = machine, regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}

    def __missing__(self, match: str) -> bytes:
        made = self.old.get(match)
        if made is None:
            made = id_bytes(self.machine.encode(match.encode()))
        if len(match) <= LONGEST_MATCH:
            if len(self) >= MAX_MATCHES:
                self.old = dict(self)
                self.clear()
            self[match] = made
        return made

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""


@functools.lru_cache(maxsize=1)
def transducer_encoder(path: str, pattern: str) -> MatchEncoder:
    """A :class:`MatchEncoder` over the transducer; one per worker process, kept between tasks."""
    return MatchEncoder(Transducer(load_ranks(path)), pattern)


class Utf8Stream:
    """Incremental UTF-8 decoding of byte chunks; invalid input becomes U+FFFD as in one-shot decoding.

    The state is the incomplete sequence at the end of the last chunk, of three bytes at most.
    """

    #: Sequence length by lead byte; 0 for bytes that continue a sequence or are never valid.
    LENGTH = [1] * 0x80 + [0] * 0x42 + [2] * 0x1E + [3] * 0x10 + [4] * 5 + [0] * 0x0B

    def __init__(self):
        self.pending = b""

    def feed(self, chunk: bytes) -> str:
        data = self.pending + chunk
        cut = len(data)
        for back in range(1, min(4, cut + 1)):
            lead = data[cut - back]
            if lead & 0xC0 != 0x80:
                if self.LENGTH[lead] > back and self._viable(data[cut - back :]):
                    cut -= back
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _viable(tail: bytes) -> bool:
        """Whether a lead byte and what follows can still become a sequence."""
        if len(tail) < 2:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(tail[0], (0x80, 0xBF))
        return low <= tail[1] <= high

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def stream_decoder(path: str):
    """A function from ids to text through :class:`Utf8Stream`, 4,096 ids at a time; one per worker process, kept between tasks. Unknown ids raise."""
    token = {r: t for t, r in load_ranks(path).items()}.__getitem__

    def decode(ids: list[int]) -> str:
        stream = Utf8Stream()
        parts = [stream.feed(b"".join(map(token, ids[i : i + 4096]))) for i in range(0, len(ids), 4096)]
        return "".join(parts) + stream.finish()

    return decode


@functools.lru_cache(maxsize=1)
def decimals(path: str) -> list[str]:
    return [str(i) for i in range(max(load_ranks(path).values()) + 1)]


@contextlib.contextmanager
def uncollected():
    """Without passes of the cycle collector: the machine's memory is a few million tuples, none of them in a cycle."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, out: str = "ids") -> DataFrame:
    """``keep`` columns (default: all) and ``out array<int>``, the ids of the whole text; null counts as empty.

    An input column named like ``out`` is replaced. Repeated rows come out once each.
    """
    configure(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = with_fields(df, keep, f"`{out}` array<int>")

    def run(batches):
        encoder = transducer_encoder(path, pattern)
        for batch in batches:
            with uncollected():
                made = [encoder.ids(t) if t else b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(m) // 4 for m in made]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*keep, out])

    return df.select(*[df[c] for c in keep], df[text].alias(spare("__text", keep))).mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None, out: str = "text") -> DataFrame:
    """``keep`` columns (default: all) and ``out string``, decoded in a stream; null ids give null, unknown ids raise."""
    configure(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = with_fields(df, keep, f"`{out}` string")

    def run(batches):
        decode = stream_decoder(path)
        for batch in batches:
            texts = [decode(row.values.to_numpy(zero_copy_only=False).tolist()) if row.is_valid else None for row in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, out])

    return df.select(*[df[c] for c in keep], df[ids].alias("__ids")).mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, SHA-256 of the ids joined by spaces, and of the text decoded from the ids.

    Encoding, decoding and digests are one pass: the ids never leave the task.
    """
    configure(df.sparkSession)
    src = df.select(df[id_col].alias(id_col), df[text].alias("__text"))
    schema = with_fields(src, [id_col], "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        encoder, decode, name = transducer_encoder(path, pattern), stream_decoder(path), decimals(path).__getitem__
        for batch in batches:
            n, of_ids, of_text = [], [], []
            with uncollected():
                for t in batch.column(1).to_pylist():
                    ids = np.frombuffer(encoder.ids(t or ""), "<u4").tolist()
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, schema)
