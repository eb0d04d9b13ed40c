"""Repeated passages, found with suffix automata of bounded reference shards.

Every window of ``window`` words holds an anchor: a k-gram whose hash is least in the window. Equal
windows hold the same anchor at the same place, so occurrences need to be compared only where they
share an anchor, within the words a window around it can reach (its context). Contexts are folded by
digest first: a context that occurs twice is repeated as a whole, and an anchor that occurs once is
not repeated at all. Only anchors with several different contexts are left. Their contexts are routed
to shards by anchor; a shard builds a suffix automaton of an anchor's contexts, marks the states that
two contexts reach, and streams the contexts through it: a matching statistic of at least a window on
a marked state is a repeated window. Automata are built where their anchor's contexts meet instead of
being broadcast to all tasks, since what a broadcast would hold grows with the corpus. An anchor with
more contexts than an automaton may hold is settled by counting its windows' digests, pre-aggregated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlens.llm.common import Words, configure, discard, materialize, slices, utf8, with_fields, xxh64

WINDOW = 35
#: Words of an anchor.
GRAM = 8
#: Most contexts of one anchor that one automaton takes in.
MAX_CONTEXTS = 256
#: A key that holds more than this share of a table's rows is heavy: its rows are joined where they lie, not shuffled to one task.
HEAVY_SHARE = 0.001
#: Share of the rows that is looked at to find heavy keys.
LOOKED_AT = 0.05

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any range of a word sequence in constant time: polynomial prefix sums modulo 2**64."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE)))) if n else np.ones(1, np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)))
        self.back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _INVERSE)))) if n else np.ones(1, np.uint64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.back[a])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` consecutive values, by doubling."""
    done, out = 1, x
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    if done < width:
        out = pick(out[: len(out) - (width - done)], out[width - done :])
    return out


def anchors(h: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Anchors of some documents' word hashes ``h`` (document ``r``: ``h[first[r]:first[r + 1]]``): document, position, anchor and context digests."""
    none = np.empty(0, np.int64)
    span = window - gram + 1  # k-grams in a window
    if len(h) < window:
        return none, none, none, none
    roll = Rolling(h)
    at = np.arange(len(h) - gram + 1)
    g = roll.of(at, at + gram)
    low = _sliding(g, span, np.minimum)  # low[i]: least k-gram of the window that starts at i
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = doc[: len(low)] == doc[window - 1 : window - 1 + len(low)]
    low = np.where(inside, low, np.uint64(0))
    padded = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)))
    high = _sliding(padded, span, np.maximum)  # largest such least value over the windows that hold a k-gram
    j = np.flatnonzero((high == g) & (high != 0))
    r = doc[j]
    lo = np.maximum(first[r], j - (window - gram))
    hi = np.minimum(first[r + 1], j + window)
    digest = _mix(roll.of(lo, hi) ^ ((j - lo).astype(np.uint64) << np.uint64(20)) ^ (hi - lo).astype(np.uint64))
    return r, j - first[r], g[j].view(np.int64), digest.view(np.int64)


class SuffixAutomaton:
    """A generalised suffix automaton over word sequences that knows which states several sequences reach."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last_seen, self.shared = [-1], [False]

    def _extend(self, last: int, word) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, word, q)
        cur = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return cur

    def _state(self, length: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        self.last_seen.append(-1)
        self.shared.append(False)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone] = self.link[q]
        self.last_seen[clone], self.shared[clone] = self.last_seen[q], self.shared[q]
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)

    def mark(self, key: int, sequence, least: int) -> None:
        """Note that ``sequence``, already added, reaches its states of at least ``least`` words; a state that two keys reach is shared."""
        state = 0
        for word in sequence:
            state = self.next[state][word]
            s = state
            while self.length[s] >= least and self.last_seen[s] != key:
                if self.last_seen[s] >= 0:
                    self.shared[s] = True
                self.last_seen[s] = key
                s = self.link[s]

    def shared_ends(self, sequence, least: int) -> list[int]:
        """Ends of the stretches of ``least`` words of ``sequence`` that another marked sequence holds too."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if matched >= least:
                while self.length[self.link[state]] >= least:
                    state = self.link[state]
                    matched = self.length[state]
                if self.shared[state]:
                    out.append(i + 1)
        return out


#: Stands where the anchor begins, once in every sequence, so that only windows with the anchor in the same place are equal.
_MARK = ""


def _reach(sequences: list[list[str]]) -> list[int]:
    """For each sequence: words at its beginning that another one begins with too, at most."""
    out = [0] * len(sequences)
    order = sorted(range(len(sequences)), key=sequences.__getitem__)
    for i, j in zip(order, order[1:]):
        n = 0
        for x, y in zip(sequences[i], sequences[j]):
            if x != y:
                break
            n += 1
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def shared_windows(contexts: list[tuple[int, list[str]]], window: int = WINDOW) -> list[list[int]]:
    """For each context ``(words before the anchor, words)``: starts of its windows around the anchor that another context holds too.

    A shared window lies within the words that agree with any other context, going out from the anchor; the rest is cut
    off first. Contexts that are equal then share all their windows, the others are settled by the automaton of all.
    """
    before = _reach([words[:left][::-1] for left, words in contexts])
    after = _reach([words[left:] for left, words in contexts])
    holders: dict[tuple, list[int]] = {}
    for k, (left, words) in enumerate(contexts):
        if before[k] + after[k] >= window:
            holders.setdefault((before[k], *words[left - before[k] : left + after[k]]), []).append(k)
    found = {}
    if len(holders) > 1 and any(len(ks) == 1 for ks in holders.values()):
        found = dict(zip(holders, _settled([[*c[1 : c[0] + 1], _MARK, *c[c[0] + 1 :]] for c in holders], window)))
    out: list[list[int]] = [[] for _ in contexts]
    for cut, ks in holders.items():
        starts = range(max(0, cut[0] - window + 1), min(cut[0], len(cut) - 1 - window) + 1) if len(ks) > 1 else found.get(cut, [])
        for k in ks:
            out[k] = [contexts[k][0] - cut[0] + s for s in starts]
    return out


def _settled(sequences: list[list[str]], window: int) -> list[list[int]]:
    """Starts of the windows around the mark of each sequence that another sequence holds too."""
    automaton = SuffixAutomaton()
    for s in sequences:
        automaton.add(s)
    for k, s in enumerate(sequences):
        automaton.mark(k, s, window + 1)
    out = []
    for s in sequences:
        left, ends = s.index(_MARK), automaton.shared_ends(s, window + 1)
        # a window with the mark: it starts at or before it and ends after the anchor's first word
        out.append([e - window - 1 for e in ends if e - window - 1 <= left < e - 1])
    return out


def _ranges(starts) -> list[tuple[int, int]]:
    """Sorted starts as closed ranges."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s == out[-1][1] + 1:
            out[-1] = (out[-1][0], s)
        else:
            out.append((s, s))
    return out


def _packed(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``(keep, body, rid)``: rows numbered and texts compressed, written once; every later pass reads this table."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            buf, at = utf8(batch.column(batch.num_columns - 1))
            data = memoryview(np.ascontiguousarray(buf))
            bodies = [pack.compress(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bodies, pa.binary())], names=[*keep, "body"])

    src = df.select(*[df[c] for c in keep], df[text].alias("__text"))
    return materialize(src.mapInArrow(run, with_fields(df, keep, "body binary")).withColumn("rid", F.monotonically_increasing_id()), "texts")


def _texts(col) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(b).decode() for b in col.to_pylist()], pa.string())


def _anchor_rows(packed: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rid = batch.column(0).to_numpy()
            buf, offsets = utf8(_texts(batch.column(1)))
            for a, b in slices(offsets):
                w = Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                r, pos, anchor, context = anchors(xxh64(w.buf, w.start, w.end, 1), w.first, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(rid[a:b][r]), pa.array(pos, pa.int32()), pa.array(anchor), pa.array(context)], names=["rid", "pos", "anchor", "context"])

    return packed.select("rid", "body").mapInArrow(run, "rid long, pos int, anchor long, context long")


def _context_rows(requests: DataFrame, packed: DataFrame, window: int, gram: int) -> DataFrame:
    """The words of the requested contexts: ``(anchor, n, hot, rid, pos, left, words)``."""
    each = requests.groupBy("rid").agg(F.collect_list(F.struct("anchor", "n", "hot", "pos")).alias("wanted"))

    def run(batches):
        names = ["anchor", "n", "hot", "rid", "pos", "left", "words"]
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            buf, offsets = utf8(_texts(batch.column(1)))
            rids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in slices(offsets):
                w = Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                data, rows = w.buf.tobytes(), []
                start, end, first = w.start.tolist(), w.end.tolist(), w.first.tolist()
                for k in range(a, b):
                    f, e = first[k - a], first[k - a + 1]
                    for x in wanted[k]:
                        j = f + x["pos"]
                        lo, hi = max(f, j - (window - gram)), min(e, j + window)
                        rows.append((x["anchor"], x["n"], x["hot"], rids[k], x["pos"], j - lo, data[start[lo] : end[hi - 1]].decode()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    joined = packed.select("rid", "body").join(each, "rid")
    return joined.mapInArrow(run, "anchor long, n long, hot boolean, rid long, pos int, left int, words string")


def _by_automaton(contexts: DataFrame, window: int) -> DataFrame:
    """``(rid, a, b)``: ranges of repeated window starts of contexts that occur once, per anchor's automaton."""
    routed = contexts.repartition("anchor").sortWithinPartitions("anchor")

    def settle(group):
        if len(group) < 2 or all(g[1] > 1 for g in group):
            return
        found = shared_windows([(g[4], g[5].split(" ")) for g in group], window)
        for (_, n, rid, pos, left, _), starts in zip(group, found):
            if n == 1:
                for a, b in _ranges(starts):
                    yield rid, pos - left + a, pos - left + b

    def run(batches):
        group, key = [], None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "n", "rid", "pos", "left", "words"))):
                if row[0] != key:
                    out += settle(group)
                    group, key = [], row[0]
                group.append(row)
            if out:
                yield _spans(out)
        if out := list(settle(group)):
            yield _spans(out)

    return routed.select("anchor", "n", "rid", "pos", "left", "words").mapInArrow(run, "rid long, a int, b int")


def _spans(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32()))], names=["rid", "a", "b"])


def _by_digest(contexts: DataFrame, window: int) -> DataFrame:
    """As :func:`_by_automaton`, for anchors with too many contexts: windows by digest, counted before they are shuffled."""

    def run(batches):
        for batch in batches:
            rows = []
            for anchor, n, rid, pos, left, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "n", "rid", "pos", "left", "words"))):
                words = words.split(" ")
                for s in range(0, min(left, len(words) - window) + 1):
                    digest = hashlib.blake2b(" ".join(words[s : s + window]).encode(), digest_size=16, salt=str(left - s).encode()).digest()
                    rows.append((anchor, digest, rid if n == 1 else None, pos - left + s))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.int32()))], names=["anchor", "digest", "rid", "a"])

    windows = materialize(contexts.select("anchor", "n", "rid", "pos", "left", "words").mapInArrow(run, "anchor long, digest binary, rid long, a int"), "windows")
    keys = ["anchor", "digest"]
    twice = windows.groupBy(keys).agg(F.count("*").alias("c")).where("c > 1").select(keys)
    return _semi_join(windows.where("rid is not null"), twice, keys, _heavy(windows, keys)).select("rid", "a", F.col("a").alias("b"))


def _heavy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that hold more than ``HEAVY_SHARE`` of the rows, by a sample: at most ``1 / HEAVY_SHARE`` of them, each with two rows at least.

    They only decide where rows are joined: a key that the sample misses takes the shuffled way, with the same result.
    """
    seen = df.select(keys).sample(LOOKED_AT, 1).groupBy(keys).agg(F.count("*").alias("c"))
    most = seen.where(F.col("c") >= max(2, HEAVY_SHARE * LOOKED_AT * df.count())).orderBy(F.desc("c"), *keys).limit(round(1 / HEAVY_SHARE))
    return df.sparkSession.createDataFrame(most.select(keys).collect(), df.select(keys).schema)


def _semi_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """``left``'s rows whose keys are in ``right``; those of the few ``heavy`` keys, known to be in it, are not shuffled."""
    few = F.broadcast(heavy)
    return left.join(few, keys, "left_semi").unionAll(left.join(few, keys, "left_anti").join(right, keys, "left_semi"))


def repeated_windows(packed: DataFrame, window: int = WINDOW, gram: int = GRAM, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``(rid, a, b)``: closed ranges of window starts whose words also start a window elsewhere; ranges may overlap."""
    rows = materialize(_anchor_rows(packed, window, gram), "anchors")
    twice = rows.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    left = materialize(_semi_join(rows, twice, ["anchor"], _heavy(rows, ["anchor"])), "repeated")
    discard(rows)
    # one of a context's places: the hash aggregation of two numbers needs no sort, that of a struct would
    folded = left.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min("rid").alias("rid"), F.min_by("pos", "rid").alias("pos"))
    folded = materialize(folded, "contexts")
    # a context that occurs twice: all its windows do; fewer than 1 / HEAVY_SHARE contexts hold more than that share of the rows
    keys, bound = ["anchor", "context"], max(1, HEAVY_SHARE * left.count())
    whole = _semi_join(left, folded.where("n > 1").select(keys), keys, folded.where(F.col("n") > bound).select(keys))
    whole = whole.select("rid", F.greatest(F.col("pos") - (window - gram), F.lit(0)).alias("a"), F.col("pos").alias("b"))
    several = folded.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1")
    crowded = F.broadcast(_heavy(folded, ["anchor"]))
    counted = folded.join(crowded, "anchor", "left_semi").join(F.broadcast(several.join(crowded, "anchor", "left_semi")), "anchor")
    requests = counted.unionAll(folded.join(crowded, "anchor", "left_anti").join(several, "anchor")).select("anchor", "n", "rid", "pos", (F.col("contexts") > max_contexts).alias("hot"))
    contexts = materialize(_context_rows(requests, packed, window, gram), "words")
    return whole.unionAll(_by_automaton(contexts.where("not hot"), window)).unionAll(_by_digest(contexts.where("hot"), window))


def _apply(packed: DataFrame, spans: DataFrame, keep: list[str], window: int) -> DataFrame:
    """``(keep, n_words, n_removed, kept, written)``: what is left of each row, as words joined by spaces and, if untouched, as it was written."""
    each = spans.groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))

    def run(batches):
        for batch in batches:
            texts = _texts(batch.column(batch.num_columns - 2))
            buf, offsets = utf8(texts)
            ranges = batch.column(batch.num_columns - 1)
            words, removed, kept = [], [], []
            for a, b in slices(offsets):
                w = Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                data, first = w.buf.tobytes(), w.first
                for k in range(a, b):
                    f, e = int(first[k - a]), int(first[k - a + 1])
                    n = e - f
                    words.append(n)
                    if n == 0 or not ranges[k].is_valid:
                        removed.append(0)
                        kept.append(data[w.start[f] : w.end[e - 1]].decode() if n else "")
                        continue
                    edge = np.zeros(n + 1, np.int64)
                    for x in ranges[k].as_py():
                        # starts whose window does not fit the row are no windows
                        lo, hi = x["a"], min(x["b"], n - window)
                        if lo <= hi:
                            edge[lo] += 1
                            edge[hi + window] -= 1
                    stay = np.flatnonzero(np.cumsum(edge[:n]) == 0) + f
                    removed.append(n - len(stay))
                    kept.append(b" ".join([data[s:t] for s, t in zip(w.start[stay].tolist(), w.end[stay].tolist())]).decode())
            written = [t if not r else k for t, r, k in zip(texts.to_pylist(), removed, kept)]
            cols = [pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(written, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *cols], names=[*keep, "n_words", "n_removed", "kept", "written"])

    joined = packed.join(each, "rid", "left").select(*keep, "body", "ranges")
    return joined.mapInArrow(run, with_fields(packed, keep, "n_words long, n_removed long, kept string, written string"))


def _spans_of(packed: DataFrame, window: int, gram: int, max_contexts: int) -> DataFrame:
    return materialize(repeated_windows(packed, window, gram, max_contexts), "spans")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` for every row: the words left, joined by single spaces, after removing repeated windows.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of ``window`` words of its row covers it and
    the window's words also start anywhere else, in this row or another; all windows are judged on the
    input. Null text has no words. Repeated rows, ids included, repeat each other. Other columns are
    ignored. An empty table gives an empty result.
    """
    configure(df.sparkSession)
    packed = _packed(df.select(df[id_col].alias("id"), df[text].alias("text")), ["id"], "text")
    out = _apply(packed, _spans_of(packed, window, gram, max_contexts), ["id"], window)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")


def drop_repeats(df: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """``df``'s columns ``keep`` (default: all) with repeated passages taken out of ``text``.

    A text without any stays as it was written; one that loses words keeps the others, joined by single
    spaces; a row that loses all its words goes. Null text comes back empty.
    """
    configure(df.sparkSession)
    keep = list(df.columns if keep is None else keep)
    others = [c for c in keep if c != text]
    named = [f"c{i}" for i in range(len(others))]
    packed = _packed(df.select(*[df[c].alias(n) for c, n in zip(others, named)], df[text].alias("text")), named, "text")
    out = _apply(packed, _spans_of(packed, window, GRAM, MAX_CONTEXTS), named, window).where("n_removed = 0 or n_removed < n_words")
    back = {text: F.col("written").alias(text)} | {c: F.col(n).alias(c) for c, n in zip(others, named)}
    return out.select(*[back[c] for c in keep])


#: The registered query in DuckDB SQL: all windows of all documents by their text.
SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT rid, s, md5(array_to_string(words[s : s + 34], ' ')) AS h
  FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 34)) AS s FROM w WHERE len(words) >= 35)),
dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT rid, s FROM win WHERE h IN (SELECT h FROM dup)),
gone AS (SELECT DISTINCT rid, unnest(generate_series(s, s + 34)) AS i FROM hit),
kept AS (
  SELECT t.rid, string_agg(t.word, ' ' ORDER BY t.i) AS k, count(*) AS n
  FROM (SELECT rid, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM w WHERE len(words) > 0) t
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.rid = t.rid AND g.i = t.i) GROUP BY t.rid)
SELECT w.doc_id, len(w.words) AS n_words, len(w.words) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""
