"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled rows gives the examples and the vocabulary (words and word beginnings
that tell the classes apart); document frequencies are counted over the whole corpus. A document is a
TF-IDF vector over that vocabulary and a start marker that every document has. Its nearest examples
are found exactly: postings are cut into blocks that know their largest weight, and blocks that cannot
reach the k-th best similarity are skipped. Votes are weighted by inverse distance and calibrated on the
examples themselves.

Both classes weigh the same in votes and calibration, however many rows of each are labelled or drawn, so
a score is the chance of label 1 at even odds and the threshold asks for the same evidence at every size.
Equal texts are one example with the labels of all its rows. A text is always judged without the example
that it equals, in calibration as in scoring: its own label never reaches its score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privlens.llm.common import Words, configure, slices, spare, utf8, with_fields, xxh64

#: Most labelled examples of each class that the index holds; the sample is drawn by a hash of the id.
MAX_EXAMPLES = 3000
#: Most terms of the vocabulary (those of largest chi-squared statistic), least examples a term occurs in, least chi-squared statistic,
#: and least effect, the statistic a row: with more examples ever weaker terms become significant, which tell nothing and are in every text.
MAX_TERMS, LEAST_EXAMPLES, LEAST_CHI2, LEAST_EFFECT = 4000, 4, 12.0, 0.004
NEIGHBOURS = 25
THRESHOLD = 0.7
#: Postings in a block.
BLOCK = 64
#: Remembered queries of a worker; many documents share a vector.
MAX_MEMO = 50_000

#: Bytes that end a term: all ASCII but letters and digits.
_BREAK = np.ones(256, bool)
_BREAK[0x80:] = False
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _BREAK[_a:_b] = False
#: Beginnings of words that count as terms, in bytes, and their hash seeds (words have seed 42).
_PREFIXES = ((4, 101), (5, 102), (6, 103))


def term_hashes(buf: np.ndarray, offsets: np.ndarray):
    """``(row, hash)`` of every term occurrence of a batch: words, and the beginnings of longer words, lower-cased (A-Z)."""
    for a, b in slices(offsets):
        part = buf[offsets[a] : offsets[b]]
        w = Words(np.where(_BREAK[part], np.uint8(0x20), part), offsets[a : b + 1] - offsets[a], lower=True)
        row = np.repeat(np.arange(a, b), np.diff(w.first))
        yield row, xxh64(w.buf, w.start, w.end)
        for size, seed in _PREFIXES:
            on = np.flatnonzero(w.end - w.start > size)
            yield row[on], xxh64(w.buf, w.start[on], w.start[on] + size, seed)


def count_terms(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(row, hash)`` with counts, by row and hash."""
    rows, hashes = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.flatnonzero(np.concatenate(([len(rows) > 0], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))))
    return rows[first], hashes[first], np.diff(np.append(first, len(rows)))


@dataclass
class Vocabulary:
    """Sorted term hashes, each with its inverse document frequency; slot 0 of a vector is the start marker."""

    hashes: np.ndarray
    idf: np.ndarray
    _filter: np.ndarray | None = field(default=None, repr=False)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are terms, and their slots."""
        if self._filter is None:
            self._filter = np.zeros(1 << 17, bool)
            self._filter[self.hashes & np.uint64((1 << 17) - 1)] = True
        on = np.flatnonzero(self._filter[hashes & np.uint64((1 << 17) - 1)])
        if not len(on) or not len(self.hashes):
            return on[:0], on[:0]
        slot = np.searchsorted(self.hashes, hashes[on])
        slot[slot == len(self.hashes)] = 0
        hit = self.hashes[slot] == hashes[on]
        return on[hit], slot[hit] + 1

    def counts(self, col) -> list[tuple[np.ndarray, np.ndarray]]:
        """Slots and counts of each row of a text column."""
        buf, offsets = utf8(col)
        found = []
        for row, h in term_hashes(buf, offsets):
            at, slot = self.lookup(h)
            found.append((row[at], slot.astype(np.uint64)))
        n = len(offsets) - 1
        if not found:
            return [(np.empty(0, np.int64), np.empty(0, np.int64))] * n
        rows, slots, tf = count_terms(found)
        cut = np.searchsorted(rows, np.arange(n + 1))
        return [(slots[a:b].astype(np.int64), tf[a:b]) for a, b in zip(cut, cut[1:])]

    def vector(self, slots: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector; the start marker weighs 1 before scaling."""
        weight = np.concatenate(([1.0], (1.0 + np.log(tf)) * self.idf[slots - 1]))
        return np.concatenate(([0], slots)), weight / np.sqrt((weight * weight).sum())


class BlockMaxIndex:
    """Postings by slot, in blocks with their largest weight; exact top-k by cosine."""

    def __init__(self, vectors, slots: int):
        self.n = len(vectors)
        by_slot: list[list[tuple[int, float]]] = [[] for _ in range(slots)]
        for i, (s, w) in enumerate(vectors):
            for a, b in zip(s.tolist(), w.tolist()):
                by_slot[a].append((i, b))
        self.ids = [np.array([i for i, _ in p], np.int64) for p in by_slot]
        self.weights = [np.array([w for _, w in p]) for p in by_slot]
        self.block_max = [np.maximum.reduceat(w, np.arange(0, len(w), BLOCK)) if len(w) else w for w in self.weights]
        self.most = np.array([w.max() if len(w) else 0.0 for w in self.weights])

    def top(self, slots: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest cosine, ties to the smaller number, and their cosines.

        Slots are taken by falling bound. Once ``k`` examples have a partial sum above what the slots
        still to come can add, unseen examples are out, and of a posting list only blocks are read whose
        largest weight, with everything else at its bound, can still reach the k-th best.
        """
        order = np.argsort(-weights * self.most[slots], kind="stable")
        slots, weights = slots[order], weights[order]
        bound = weights * self.most[slots]
        rest = np.concatenate((np.cumsum(bound[::-1])[::-1], [0.0]))
        sums = np.zeros(self.n)
        k = min(k, self.n)
        floor, look = 0.0, 1
        for j, (s, w) in enumerate(zip(slots.tolist(), weights.tolist())):
            ids, ws = self.ids[s], self.weights[s]
            if not len(ids):
                continue
            if floor > 0.0 and len(ids) > BLOCK:
                # an example's total is at most its partial sum, this block's largest weight and the rest
                lead = np.maximum.reduceat(sums[ids], np.arange(0, len(ids), BLOCK))
                go = lead + w * self.block_max[s] + rest[j + 1] >= floor - 1e-12
                if not go.all():
                    on = np.repeat(go, BLOCK)[: len(ids)]
                    ids, ws = ids[on], ws[on]
            sums[ids] += w * ws
            if self.n > k and j + 1 >= look:
                # any earlier k-th best is a valid bound: it is looked up after 1, 4, 16, ... slots
                floor, look = max(floor, float(np.partition(sums, self.n - k)[self.n - k])), 4 * look
        best = self._best(sums, k)
        return best, np.minimum(sums[best], 1.0)

    @staticmethod
    def _best(sums: np.ndarray, k: int) -> np.ndarray:
        edge = np.partition(sums, len(sums) - k)[len(sums) - k]
        on = np.flatnonzero(sums >= edge - 1e-11)
        return on[np.lexsort((on, -np.round(sums[on], 12)))][:k]


@dataclass
class ToxicityModel:
    """Vocabulary, examples (distinct texts, numbered) with the weight of their toxic and clean rows, index and calibration."""

    vocabulary: Vocabulary
    index: BlockMaxIndex
    ids: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    number: dict[bytes, int]
    steps: np.ndarray
    levels: np.ndarray
    k: int = NEIGHBOURS

    def nearest(self, slots: np.ndarray, weights: np.ndarray, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest examples but ``own``, and their cosines."""
        near, cosine = self.index.top(slots, weights, self.k + (own is not None))
        if own is not None:
            on = near != own
            near, cosine = near[on][: self.k], cosine[on][: self.k]
        return near, cosine

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        closeness = 1.0 / (1.0 - cosine + 0.01)
        toxic, clean = float((self.toxic[near] * closeness).sum()), float((self.clean[near] * closeness).sum())
        return toxic / (toxic + clean) if toxic + clean else 0.5

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, self.steps, self.levels)) if len(self.steps) else raw

    def score(self, slots: np.ndarray, tf: np.ndarray, own: int | None = None) -> tuple[float, list]:
        """Calibrated score and the ids of the nearest examples, nearest first; ``own`` is the number of the example with the same text."""
        if self.index.n <= (own is not None):
            return 0.5, []
        near, cosine = self.nearest(*self.vocabulary.vector(slots, tf), own)
        return self.calibrated(self.vote(near, cosine)), self.ids[near].tolist()


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators fit of ``y`` on ``x``: knots and non-decreasing levels."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weighted sum, first x, last x
    for i in order.tolist():
        pools.append([w[i], w[i] * y[i], x[i], x[i]])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]):
            top = pools.pop()
            pools[-1] = [pools[-1][0] + top[0], pools[-1][1] + top[1], pools[-1][2], top[3]]
    knots, levels = [], []
    for weight, total, a, b in pools:
        level = total / weight
        knots += [a, b] if b > a else [a]
        levels += [level, level] if b > a else [level]
    return np.array(knots), np.array(levels)


def in_training(id_col: Column) -> Column:
    """Whether labels of a row may be learnt from: CRC-32 of the id as text is not 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, most: int) -> DataFrame:
    """A bounded sample of labelled texts, ``(id, toxic, text)``: one row an id, of an id that repeats the one of least digest."""
    ids = labels.select(labels[id_col].alias("id"), labels[label].alias("toxic")).where("id is not null and toxic in (0, 1)")
    ids = ids.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic")).where(in_training(F.col("id")))
    order = F.xxhash64("id", F.lit(9))
    drawn = ids.where("toxic = 1").orderBy(order, "id").limit(most).unionAll(ids.where("toxic = 0").orderBy(order, "id").limit(most))
    rows = docs.select(docs[id_col].alias("id"), docs[text].alias("text")).join(F.broadcast(drawn), "id")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return rows.groupBy("id", "toxic").agg(F.min_by("text", digest).alias("text")).select("id", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> ToxicityModel:
    """Learn from ``most`` labelled rows of each class at most; document frequencies cover all of ``docs``."""
    configure(docs.sparkSession)
    sample = _sample(docs, labels, id_col, text, label, most)
    terms = sample.mapInArrow(_term_rows, "toxic int, hash long").groupBy("hash").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    drawn = sample.groupBy().agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    pos, neg = int(drawn["p"]), int(drawn["n"]) - int(drawn["p"])
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    n = float(pos + neg)
    cross = p * (neg - q) - q * (pos - p)
    chi2 = F.try_divide(F.lit(n) * cross * cross, F.lit(float(pos)) * F.lit(float(neg)) * (p + q) * (F.lit(n) - p - q))
    picked = terms.withColumn("chi2", F.coalesce(chi2, F.lit(0.0))).where((F.col("p") + F.col("q") >= LEAST_EXAMPLES) & (F.col("chi2") >= max(LEAST_CHI2, LEAST_EFFECT * n)))
    hashes = np.sort(np.array([r["hash"] for r in picked.orderBy(F.desc("chi2"), "hash").limit(MAX_TERMS).select("hash").collect()], np.int64).view(np.uint64))
    vocabulary = Vocabulary(hashes, np.ones(len(hashes)))
    counted = docs.select(docs[text].alias("text")).mapInArrow(_frequencies(vocabulary), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(hashes) + 1, np.int64)
    for r in counted.collect():
        frequency[r["slot"]] = r["n"]
    vocabulary = Vocabulary(hashes, np.log((frequency[0] + 1) / (frequency[1:] + 1)) + 1.0)
    rows = sample.select("id", "toxic", "text").mapInArrow(_example_rows(vocabulary), "id long, toxic int, digest binary, slots array<int>, counts array<int>").collect()
    return build(vocabulary, [(r["id"], r["toxic"], bytes(r["digest"]), np.array(r["slots"], np.int64), np.array(r["counts"], np.int64)) for r in rows], k)


def build(vocabulary: Vocabulary, rows: list, k: int = NEIGHBOURS) -> ToxicityModel:
    """A model from labelled rows ``(id, toxic, digest of the text, slots, counts)``; rows of one text are one example, named by its least id."""
    of: dict[bytes, list] = {}
    for i, toxic, digest, slots, counts in rows:
        held = of.setdefault(digest, [i, 0, 0, slots, counts])
        held[0] = min(held[0], i)
        held[2 - toxic] += 1
    # numbered by content: the id decides nothing, not even among ties
    order = sorted(of, key=lambda d: (len(of[d][3]), d))
    examples = [of[d] for d in order]
    vectors = [vocabulary.vector(s, c) for _, _, _, s, c in examples]
    counts = np.array([e[1:3] for e in examples], np.float64).reshape(-1, 2)
    weight = counts / np.maximum(counts.sum(axis=0), 1.0)
    model = ToxicityModel(vocabulary, BlockMaxIndex(vectors, len(vocabulary.hashes) + 1), np.array([e[0] for e in examples], np.int64), weight[:, 0], weight[:, 1], {d: i for i, d in enumerate(order)}, np.empty(0), np.empty(0), k)
    if len(examples) > k and (counts.sum(axis=0) > 0).all():
        raw = np.array([model.vote(*model.nearest(s, w, i)) for i, (s, w) in enumerate(vectors)])
        total = weight.sum(axis=1)
        model.steps, model.levels = isotonic(raw, weight[:, 0] / total, total)
        # no level is certain: each keeps a little of the other class
        model.levels = np.clip(model.levels, 0.001, 0.999)
    return model


def _term_rows(batches):
    for batch in batches:
        label = batch.column("toxic").to_numpy()
        rows, hashes, _ = count_terms(list(term_hashes(*utf8(batch.column("text")))) or [(np.empty(0, np.int64), np.empty(0, np.uint64))])
        yield pa.RecordBatch.from_arrays([pa.array(label[rows], pa.int32()), pa.array(hashes.view(np.int64))], names=["toxic", "hash"])


def _frequencies(vocabulary: Vocabulary):
    def run(batches):
        total = np.zeros(len(vocabulary.hashes) + 1, np.int64)
        for batch in batches:
            total[0] += batch.num_rows
            for slots, _ in vocabulary.counts(batch.column(0)):
                total[slots] += 1
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[on], pa.int64())], names=["slot", "n"])

    return run


def text_digests(col) -> list[bytes]:
    """A 128-bit digest of each whole text; null counts as empty."""
    buf, offsets = utf8(col)
    data, at = memoryview(np.ascontiguousarray(buf)), offsets.tolist()
    return [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(at, at[1:])]


def _example_rows(vocabulary: Vocabulary):
    def run(batches):
        for batch in batches:
            rows = vocabulary.counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), batch.column("toxic"), pa.array(text_digests(batch.column("text")), pa.binary()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))],
                names=["id", "toxic", "digest", "slots", "counts"],
            )

    return run


def score(df: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None, evidence: int = 3) -> DataFrame:
    """``keep`` columns (default: all) with ``score double`` and ``evidence array<long>``, ids of the nearest examples.

    Null and empty texts are judged by the start marker alone. A model without examples of both classes gives 0.5, or 0 or 1
    if all its examples are of one. A text that is an example is judged by the others. Equal texts get equal scores, whatever
    their ids. Input columns named ``score`` or ``evidence`` are replaced.
    """
    configure(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "evidence")]
    schema = with_fields(df, keep, "score double, evidence array<long>")
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_EXAMPLES and MAX_TERMS

    def run(batches):
        m, memo = shared.value, {}
        for batch in batches:
            scores, near = [], []
            texts = batch.column(batch.num_columns - 1)
            for (slots, tf), digest in zip(m.vocabulary.counts(texts), text_digests(texts)):
                own = m.number.get(digest)
                key = (own, slots.astype(np.int32).tobytes(), tf.astype(np.int32).tobytes())
                if (made := memo.get(key)) is None:
                    if len(memo) >= MAX_MEMO:
                        memo.clear()
                    s, e = m.score(slots, tf, own)
                    made = memo[key] = (s, e[:evidence])
                scores.append(made[0])
                near.append(made[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64()))], names=[*keep, "score", "evidence"])

    return df.select(*[df[c] for c in keep], df[text].alias(spare("__text", keep))).mapInArrow(run, schema)

