"""SimHash near-duplicates, found by vantage-point trees over cells of fingerprints.

Fingerprints are computed on whole texts (numpy over Arrow batches). Equal fingerprints fold into one
class before any comparison. For radius ``r`` the 64 bits are cut into ``r + 1`` blocks: two fingerprints
within the radius agree on one block at least, so each visits the ``r + 1`` cells of those that share a
block with it, however many there are. (Partitioning all fingerprints by their distance to vantage points
alone lets each visit the more shards the more there are: random ones lie about 32 bits from any point,
and a shared tree that cuts a shard to 1/2.4 lets a row visit 1.8 times as many at radius 2.)

A cell is searched by a local vantage-point tree with triangle bounds. A dense cell is partitioned by
Hamming distance to one of its members, and a fingerprint also queries the bands that overlap its
boundary. Each task reports a spanning forest of the links it finds, never all pairs of a dense group.
Forests of all tasks go to :func:`connected_components`.

Fingerprints of texts that share four fifths of their shingles lie about 10 bits apart, where the
triangle inequality prunes nothing. :func:`similar_links` finds those pairs: min-wise keys choose the
shards, and candidates are verified on whole shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privlens.llm.common import Words, configure, materialize, slices, spare, utf8, with_fields, xxh64
from privlens.llm.components import connected_components, forest

#: Fingerprints of one task, about, and the number from which a cell is dense and is split by distance.
SHARD = 30_000
#: Tasks at least, so that small inputs too are dealt out.
LEAST_SHARDS = 48
#: Width of a distance band of a dense cell.
BAND = 5
#: Residents of a local leaf that are compared with its queries at once.
LEAF = 48
#: Shingles whose bits are unpacked at once.
BITS_AT_ONCE = 1 << 18
#: Min-wise keys of a text, and minima in a key: of pairs with Jaccard similarity 0.8, 6 in 100,000 share no key.
KEYS, MINIMA = 32, 6
#: Texts of one block, compared with those of one other block at once.
BLOCK = 1000
_FACTORS = np.random.default_rng(5).integers(0, 2**63, KEYS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, shingle: int):
    """``(a, b, n, hashes)`` of slices of rows ``a`` to ``b``: shingles of each row, and the XXH64 of all of them in order."""
    for a, b in slices(offsets):
        w = Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        count = np.diff(w.first)
        n = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
        row = np.repeat(np.arange(b - a), n)
        first = np.cumsum(n) - n
        s = w.first[:-1][row] + np.arange(len(row)) - first[row]
        e = np.minimum(s + shingle, w.first[1:][row]) - 1
        yield a, b, n, xxh64(w.buf, w.start[s], w.end[e])


def _majority(n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """SimHash of rows with ``n`` of the shingle hashes ``h`` each."""
    row = np.repeat(np.arange(len(n)), n)
    sums = np.zeros((len(n), 64), np.int64)
    for i in range(0, len(h), BITS_AT_ONCE):
        part = np.unpackbits(h[i : i + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows, at = np.unique(row[i : i + BITS_AT_ONCE], return_index=True)
        sums[rows] += np.add.reduceat(part, at, axis=0, dtype=np.int64)
    bits = (2 * sums > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """64-bit SimHash of each row: bit set where over half of the shingles' XXH64 have it; no words: zero."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for a, b, n, h in shingle_hashes(buf, offsets, shingle):
        out[a:b] = _majority(n, h)
    return out


def min_keys(n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``KEYS`` min-wise keys of each row with ``n`` of the shingle hashes ``h``; a row without shingles has zeros."""
    out = np.zeros((len(n), KEYS), np.uint64)
    on = np.flatnonzero(n)
    if not len(on):
        return out
    first = (np.cumsum(n) - n)[on]
    for k in range(KEYS):
        key = np.full(len(on), k + 1, np.uint64)
        for f in _FACTORS[k * MINIMA : (k + 1) * MINIMA]:
            key = (key ^ np.minimum.reduceat(h * f, first)) * np.uint64(0x9E3779B185EBCA87)
            key ^= key >> np.uint64(29)
        out[on, k] = key
    return out


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (default: all) and ``out``, the fingerprint as a signed long.

    Null and blank texts have fingerprint 0. A text of fewer words than ``shingle`` counts as one shingle.
    """
    keep = df.columns if keep is None else keep
    src = df.select(*[df[c] for c in keep], df[text].alias(spare("__text", keep)))
    schema = with_fields(df, keep, f"`{out}` long")

    def run(batches):
        for batch in batches:
            h = fingerprints(*utf8(batch.column(batch.num_columns - 1)), shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(h.view(np.int64))], names=[*keep, out])

    return src.mapInArrow(run, schema)


def _band(distance: Column) -> Column:
    return F.floor(distance / F.lit(BAND)).cast("int")


def linked_pairs(items: np.ndarray, resident: np.ndarray, radius: int):
    """Batches of ``(i, j)`` with Hamming distance of at most ``radius``, ``i`` any item and ``j`` a resident, by a local vantage-point tree.

    A node's vantage point is one of its residents; rings are single distances. A query follows the rings within ``radius`` of its own distance.
    """
    rng = np.random.default_rng(7)
    stack = [(np.flatnonzero(resident), np.arange(len(items)), 0)]
    while stack:
        d, q, depth = stack.pop()
        if not len(d) or not len(q):
            continue
        if len(d) <= LEAF or depth > 24:
            for at in range(0, len(d), 256):
                dd = d[at : at + 256]
                for i in range(0, len(q), 4096):
                    near = np.bitwise_count(items[q[i : i + 4096], None] ^ items[None, dd]) <= radius
                    a, b = np.nonzero(near)
                    if len(a):
                        yield q[i + a], dd[b]
            continue
        v = items[d[rng.integers(len(d))]]
        dd, dq = np.bitwise_count(items[d] ^ v).astype(np.int16), np.bitwise_count(items[q] ^ v).astype(np.int16)
        od, oq = np.argsort(dd, kind="stable"), np.argsort(dq, kind="stable")
        sd, sq = dd[od], dq[oq]
        for ring in np.unique(sd).tolist():
            lo, hi = np.searchsorted(sd, [ring, ring + 1])
            ql, qh = np.searchsorted(sq, [ring - radius, ring + radius + 1])
            stack.append((d[od[lo:hi]], q[oq[ql:qh]], depth + 1))


def cells(fp: Column, radius: int) -> Column:
    """The ``radius + 1`` cells of a fingerprint: block numbers and the bits of these blocks."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    blocks = [F.shiftrightunsigned(F.shiftleft(fp, 64 - b), 64 - b + a) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[F.struct(F.lit(i).alias("cell"), block.alias("bits")) for i, block in enumerate(blocks)])


def cell_links(items: np.ndarray, cell: np.ndarray, resident: np.ndarray, radius: int):
    """Batches of ``(i, j)`` of one cell with Hamming distance of at most ``radius``, ``j`` a resident; ``items`` are ordered by ``cell``.

    Small cells are compared by offset, all at once; each larger one by its vantage-point tree.
    """
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.append(first, len(items)))
    small = np.repeat(size <= LEAF, size)
    for step in range(1, int(size[size <= LEAF].max(initial=1))):
        i = np.flatnonzero(small[step:] & (cell[step:] == cell[:-step]))
        i = i[np.bitwise_count(items[i] ^ items[i + step]) <= radius]
        if len(i):
            yield i, i + step
    for a, n in zip(first[size > LEAF].tolist(), size[size > LEAF].tolist()):
        for i, j in linked_pairs(items[a : a + n], resident[a : a + n], radius):
            yield a + i, a + j


def gathered(batches, least: int = 1 << 18):
    """The same pairs in batches of ``least`` and more, but for the last: a batch costs a pass over all items."""
    held, n = [], 0
    for pair in batches:
        held.append(pair)
        n += len(pair[0])
        if n >= least:
            yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held, n = [], 0
    if held:
        yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Spanning links ``(a long, b long)`` between distinct fingerprints ``fp`` at Hamming distance up to ``radius``.

    The links connect exactly what all pairs within ``radius`` connect; each task reports a forest. ``radius`` may be
    0 to 62. A cell's fingerprints are cut into bands and blocks only where it holds over ``SHARD`` of them.
    """
    n = distinct.count()
    visits = distinct.select("fp", F.explode(cells(F.col("fp"), radius)).alias("at")).select("fp", "at.cell", "at.bits")
    dense = visits.groupBy("cell", "bits").agg(F.count("*").alias("size"), F.min("fp").alias("point")).where(F.col("size") > SHARD)
    dense = materialize(dense.select("cell", "bits", "point", F.ceil(F.col("size") / F.lit(4 * SHARD)).cast("int").alias("blocks")), "dense")
    hashed = F.xxhash64("cell", "bits")
    tasks = max(LEAST_SHARDS, math.ceil(n * (radius + 1) / SHARD))
    columns = ["fp", "cell", "bits", "band", "block", "task", "resident"]
    many = dense.limit(1).count()
    sparse = visits.join(dense, ["cell", "bits"], "left_anti") if many else visits
    dealt = sparse.select("fp", "cell", "bits", F.lit(0).alias("band"), F.lit(0).alias("block"), F.pmod(hashed, F.lit(tasks)).alias("task"), F.lit(True).alias("resident"))
    if many:
        inside = visits.join(dense, ["cell", "bits"])
        distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("point")))
        low, high = F.greatest(distance - F.lit(radius), F.lit(0)), F.least(distance + F.lit(radius), F.lit(64))
        inside = inside.select("fp", "cell", "bits", "blocks", _band(distance).alias("home"), F.explode(F.sequence(_band(low), _band(high))).alias("band"))
        own = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("blocks")).cast("int")
        inside = inside.select("fp", "cell", "bits", "home", "band", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        resident = (F.col("home") == F.col("band")) & (F.col("own") == F.col("block"))
        dealt = dealt.unionByName(inside.select("fp", "cell", "bits", "band", "block", hashed.alias("task"), resident.alias("resident")).select(columns))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64)
        order = np.lexsort((fp, pdf["bits"].to_numpy(), pdf["cell"].to_numpy()))
        fp, resident = fp[order], pdf["resident"].to_numpy(bool)[order]
        bits, cell = pdf["bits"].to_numpy(np.int64)[order], pdf["cell"].to_numpy(np.int64)[order]
        number = np.cumsum(np.concatenate(([0], (bits[1:] != bits[:-1]) | (cell[1:] != cell[:-1]))))
        root = np.arange(len(fp))
        for a, b in gathered(cell_links(fp.view(np.uint64), number, resident, radius)):
            root = forest(len(fp), a, b, root)
        on = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[root[on]], "b": fp[on]})

    return dealt.groupBy("task", "band", "block").applyInPandas(run, "a long, b long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``df``.

    Texts are lower-cased (A-Z only); words are ``[^\\x20\\x09-\\x0D]+``. ``component_id`` is the smallest
    id reachable through fingerprints at most ``radius`` bits apart. Null ids take part but name no
    component (a component of null ids only has a null id); repeated rows come out once each; null
    and empty texts share fingerprint zero. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    configure(df.sparkSession)
    src = df.select(df[id_col].alias("id"), df[text].alias("text"))
    marked = materialize(with_fingerprint(src, "text", "fp", shingle, ["id"]), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    roots = connected_components(fingerprint_links(classes, radius))
    of = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = of.groupBy("root").agg(F.min("low").alias("component_id"))
    named = of.join(low, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_keys(src: DataFrame, shingle: int) -> DataFrame:
    """``src(__row, id, text)`` without ``text``, with ``fp``, a digest ``body`` of all shingles in order and the min-wise ``keys`` (none for a text without words)."""
    schema = with_fields(src, ["__row", "id"], "fp long, body long, keys array<long>")

    def run(batches):
        for batch in batches:
            fp, body, keys = [np.empty(0, np.uint64)], [], []
            for _, _, n, h in shingle_hashes(*utf8(batch.column(2)), shingle):
                fp.append(_majority(n, h))
                body += [xxhash.xxh64_intdigest(x.tobytes()) for x in np.split(h, np.cumsum(n)[:-1])]
                keys += [k if m else k[:0] for k, m in zip(min_keys(n, h).view(np.int64), n.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(fp).view(np.int64)), pa.array(np.array(body, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["__row", "id", "fp", "body", "keys"])

    return src.select("__row", "id", "text").mapInArrow(run, schema)


def _with_sets(src: DataFrame, shingle: int) -> DataFrame:
    """``src(__row, text)`` as ``__row`` and ``shingles``, the row's distinct shingle hashes as bytes, sorted."""

    def run(batches):
        for batch in batches:
            sets = []
            for _, _, n, h in shingle_hashes(*utf8(batch.column(1)), shingle):
                sets += [np.unique(x).tobytes() for x in np.split(h, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["__row", "shingles"])

    return src.select("__row", "text").mapInArrow(run, "__row long, shingles binary")


def alike(sets: list[np.ndarray], asks: np.ndarray, asked: np.ndarray, similarity: float, root: np.ndarray) -> np.ndarray:
    """``root`` extended by all links of Jaccard similarity ``similarity`` between members ``asks`` and members ``asked`` of ``sets``.

    Members that are connected already are not compared again.
    """
    size = np.array([len(x) for x in sets], np.int64)
    names, flat = np.unique(np.concatenate([sets[j] for j in asked.tolist()]), return_inverse=True)
    first = np.concatenate(([0], np.cumsum(size[asked])))
    marked = np.zeros(len(names), bool)
    for i in asks.tolist():
        fits = (size[asked] >= similarity * size[i]) & (size[asked] <= size[i] / similarity)
        on = np.flatnonzero((root[asked] != root[i]) & fits)
        if not len(on):
            continue
        slot = np.searchsorted(names, sets[i])
        slot[slot == len(names)] = 0
        slot = slot[names[slot] == sets[i]]
        marked[slot] = True
        n = size[asked[on]]
        start = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(first[on] - start, n)
        both = np.add.reduceat(marked[flat[at]], start, dtype=np.int64)
        marked[slot] = False
        near = asked[on[both >= similarity * (n + size[i] - both) - 1e-9]]
        root = forest(len(sets), np.full(len(near), i), near, root)
    return root


def similar_links(marked: DataFrame, src: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Spanning links ``(a long, b long)`` between the fingerprints of rows of ``marked(__row, fp, body, keys)`` whose shingle sets are alike.

    Texts that share a min-wise key, directly or through others, form a candidate group. A group is cut into
    blocks, every block meets every other, and pairs are verified on the whole sets.
    """
    items = materialize(marked.where("size(keys) > 0").groupBy("fp", "body").agg(F.min("__row").alias("__row"), F.any_value("keys").alias("keys")), "items")
    keyed = items.select("__row", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("__row").alias("low"), F.max("__row").alias("high")).where("low < high").select("key", "low")
    groups = materialize(connected_components(keyed.join(shared, "key").where("__row <> low").select(F.col("low").alias("a"), F.col("__row").alias("b"))), "groups")
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    # small groups share tasks
    few = max(1, math.ceil(groups.count() / BLOCK))
    own = F.pmod(F.xxhash64("node", F.lit(4)), F.col("blocks")).cast("int")
    dealt = groups.join(sizes, "root").select(F.col("node").alias("__row"), "root", "blocks", own.alias("own"))
    dealt = dealt.select("__row", "root", "own", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root", F.lit(6)), F.lit(few))).otherwise(F.col("root")).alias("shard"), (F.col("blocks") > 1).alias("big"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("__row", "root", "own", "shard", "big", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sets = _with_sets(src.join(groups.select(F.col("node").alias("__row")), "__row", "left_semi"), shingle)
    dealt = dealt.join(sets, "__row").join(items.select("__row", "fp"), "__row").drop("__row")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["root", "fp"], kind="stable")
        fp, own = pdf["fp"].to_numpy(np.int64), pdf["own"].to_numpy()
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        group = pdf["root"].to_numpy(np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        root = np.arange(len(fp))
        cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        for a, b in zip(cut.tolist(), cut[1:].tolist()):
            asks, asked = a + np.flatnonzero(own[a:b] == i), a + np.flatnonzero(own[a:b] == j)
            if len(asks) and len(asked):
                part = alike(sets[a:b], asks - a, asked - a, similarity, np.arange(b - a))
                root[a:b] = a + part
        on = np.flatnonzero((root != np.arange(len(fp))) & (fp[root] != fp))
        return pd.DataFrame({"a": fp[root[on]], "b": fp[on]})

    return dealt.groupBy("big", "shard", "i", "j").applyInPandas(run, "a long, b long")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """One row of every group of near-duplicates: the one with the smallest id (nulls last; of equal ids, one).

    Groups are connected through fingerprints of ``shingle``-word shingles at most ``radius`` bits apart, and
    through pairs of texts whose shingle sets have a Jaccard similarity of at least ``similarity``.
    Rows are numbered and written once, so that the surviving numbers mean the same rows when read again.
    """
    configure(df.sparkSession)
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    src = rows.select("__row", F.col(id_col).alias("id"), F.col(text).alias("text"))
    marked = materialize(_with_keys(src, shingle), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row")).alias("first")
    classes = materialize(marked.groupBy("fp").agg(first), "classes")
    links = fingerprint_links(classes, radius).unionAll(similar_links(marked, src, shingle, similarity))
    roots = connected_components(links)
    of = classes.join(roots, classes.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    stay = of.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(stay, "__row", "left_semi").drop("__row")
