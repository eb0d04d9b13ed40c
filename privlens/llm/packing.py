"""Packing token pieces into fixed-length sequences by a grouping genetic algorithm on islands.

Pieces as long as a sequence stand alone. The others are dealt evenly into blocks of bounded size, and
a block is described by how many pieces it has of each length. Every block is evolved on several
islands, dealt out over tasks: a solution is a multiset of bins (a bin: its piece lengths), crossover injects
whole well-filled bins of one parent into the other, bins that would use a piece twice are removed,
mutation empties bins, and the displaced pieces are put back so that they fill bins exactly where they can.
Between epochs each island receives its neighbour's elite. A block is done when no packing can have fewer
bins, or when a whole epoch bettered none of its islands. The best solution of a block then gives every
piece its sequence and offset.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from privlens.llm.bpe import load_ranks
from privlens.llm.common import configure, materialize, with_fields

CAPACITY = 1024
#: Pieces of a block; islands that evolve it; epochs between migrations; generations of an epoch; children of a generation.
#: The numbers of epochs and generations only end what still gets better; see ``PATIENCE`` and ``least_bins``.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, CHILDREN = 25_000, 2, 8, 100, 4
#: Solutions that an island keeps, and generations without a better one after which an epoch ends.
KEPT, PATIENCE = 5, 12
#: Longest pieces that are tried as the first of three which complete a bin.
TRIPLES = 6
#: Encodings of space-delimited pieces kept by a worker, and the longest piece kept.
MAX_PIECES, LONGEST_PIECE = 250_000, 48
#: A space that follows white space and does not end its run: where a text may not be cut at spaces.
_ODD_SPACES = re.compile(r"\s (?:\s|\Z)")
#: A bin filled at least this far may be injected whole.
WELL_FILLED = 0.99


# --- tokens ----------------------------------------------------------------------------------------


class PieceEncoder(dict):
    """Whole texts to little-endian unsigned 32-bit ids, cutting at single spaces and remembering pieces.

    The split pattern never joins a space to what stands before it unless white space does, so a text
    is cut before each space; texts with other runs of white space are encoded uncut. Keys are pieces
    without their leading space, values the bytes of the ids of ``" " + piece``. A full memory becomes the
    old one, from which pieces still in use come back.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        made = self.old.get(piece)
        if made is None:
            made = self.encode(" " + piece)
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= MAX_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = made
        return made

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD_SPACES.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        return (self.encode(first) if first else b"") + b"".join(map(self.__getitem__, rest))


class TokenIds:
    """Whole texts to the ids of a ``tokenizers`` file, as little-endian unsigned 32-bit bytes.

    Pieces without the special token are merged by the rank file of the same vocabulary, which gives the
    same ids several times faster; texts that spell a special token go to the tokenizer itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        self.pieces = PieceEncoder(lambda t: np.array(merges.encode_ordinary(t), "<u4").tobytes())

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.pieces.ids(text)


def token_pieces(df: DataFrame, tokens, id_col: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: each document's ids and ``end_id``, cut where longer than ``capacity``.

    All pieces of a cut document but the first have exactly ``capacity`` ids. Null text is empty: one
    piece that holds ``end_id`` alone. ``tokens()`` makes the function from text to id bytes in a worker.
    """
    configure(df.sparkSession)
    src = df.select(df[id_col].alias("__id"), df[text].alias("__text"))
    schema = with_fields(src, ["__id"], "piece int, start long, length long, ids_crc32 long")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode = tokens()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                data = (encode(t) if t else b"") + end
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["__id", "piece", "start", "length", "ids_crc32"])

    return src.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


# --- the genetic algorithm -------------------------------------------------------------------------

Bins = list[tuple[int, ...]]


def best_fit(bins: Bins, lengths: list[int], capacity: int) -> Bins:
    """Put ``lengths``, longest first, each into the open bin it fills best; new bins where none fits."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    full, open_bins = [], []
    for b in bins:
        room = capacity - sum(b)
        if room:
            rooms[room].append(len(open_bins))
            mask |= 1 << room
            open_bins.append(list(b))
        else:
            full.append(b)
    for size in sorted(lengths, reverse=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
            open_bins[at].append(size)
        else:
            room, at = capacity, len(open_bins)
            open_bins.append([size])
        left = room - size
        rooms[left].append(at)
        mask |= 1 << left
    return full + [tuple(sorted(b, reverse=True)) for b in open_bins]


def complete(bins: Bins, lengths: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Put ``lengths`` into full bins of their own where they can, the rest best-fit into ``bins`` and new ones.

    The longest piece left is completed by the piece, or by two or three pieces, that fill its bin exactly; where
    none do, it takes the longest that fits and is completed from there, or waits for the best-fit at the end. How is
    drawn for each call: which of these two, the most or the least even of several pairs or either by turns, and how often
    pairs come before single pieces. Lengths at hand are the bits of an integer, ``avail`` by length and ``mirror`` by what
    is missing to ``capacity``.
    """
    counts = Counter(lengths)
    avail = mirror = 0
    for x in counts:
        avail |= 1 << x
        mirror |= 1 << (capacity - x)

    def flip(x: int) -> None:
        nonlocal avail, mirror
        avail ^= 1 << x
        mirror ^= 1 << (capacity - x)

    def take(x: int) -> None:
        counts[x] -= 1
        if not counts[x]:
            flip(x)

    def pairs(room: int) -> int:
        """The shorter halves of the pairs that fill ``room``, as bits."""
        found = avail & (mirror >> (capacity - room)) & ((2 << room // 2) - 1)
        if not room % 2 and found >> (room // 2) & 1 and counts[room // 2] < 2:
            found ^= 1 << (room // 2)
        return found

    def completion(room: int, even: bool, single: bool) -> list[int] | None:
        exact = avail >> room & 1
        if exact and single:
            return [room]
        if found := pairs(room):
            x = (found if even else found & -found).bit_length() - 1
            return [x, room - x]
        if exact:
            return [room]
        fits = avail & ((1 << room) - 1)
        for _ in range(TRIPLES):
            if not fits:
                break
            x = fits.bit_length() - 1
            fits ^= 1 << x
            take(x)
            found = pairs(room - x)
            if not counts[x]:
                flip(x)
            counts[x] += 1
            if found:
                y = found.bit_length() - 1
                return [x, y, room - x - y]
        return None

    evenness, singles, aside = rng.choice([0.0, 0.5, 1.0]), 1.0 if rng.random() < 0.75 else rng.random(), rng.random() < 0.5
    draws = rng.random((len(lengths), 2)) < (evenness, singles)
    full, loose, rest = [], [], []
    for even, single in draws.tolist():
        if not avail:
            break
        x = avail.bit_length() - 1
        take(x)
        bin_, room = [x], capacity - x
        while room:
            others = completion(room, even, single)
            fits = 0 if aside or others else avail & ((1 << room) - 1)
            others = others or ([fits.bit_length() - 1] if fits else [])
            if not others:
                break
            for y in others:
                take(y)
            bin_ += others
            room -= sum(others)
        if not room:
            full.append(tuple(sorted(bin_, reverse=True)))
        elif aside:
            rest.append(x)
        else:
            loose.append(tuple(bin_))
    return best_fit(bins + loose, rest, capacity) + full


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, fuller ones (sum of squared fills, negated)."""
    return len(bins), -sum((sum(b) / capacity) ** 2 for b in bins)


def least_bins(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: for each ``k``, pieces over half a bin stand alone, and those of ``k`` and more fill what room they leave."""
    n = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1)
    above = lambda x: x[::-1].cumsum()[::-1]
    number, total = above(n), above(n * np.arange(capacity + 1))
    half = capacity // 2 + 1
    k = np.arange(half)
    # pieces over capacity - k leave no room for those of k and more
    room = (number[half] - np.append(number, 0)[capacity - k + 1]) * capacity - (total[half] - np.append(total, 0)[capacity - k + 1])
    return int(max(number[half] + np.maximum(0, -(-(total[k] - total[half] - room) // capacity))))


def crossover(a: Bins, b: Bins, capacity: int, rng: np.random.Generator) -> Bins:
    """Half of ``b``'s well-filled bins injected whole into ``a``; ``a``'s bins keep their pieces as far as supply lasts, the rest is completed.

    Bins that both have stay: what is left of either is the same pieces.
    """
    mine, theirs = Counter(a), Counter(b)
    child = list((mine & theirs).elements())
    good = [x for x in (theirs - mine).elements() if sum(x) >= WELL_FILLED * capacity]
    a = list((mine - theirs).elements())
    supply = Counter(x for bin_ in a for x in bin_)
    take = rng.random(len(good)) < 0.5
    child += [x for x, t in zip(good, take) if t]
    for bin_, t in zip(good, take):
        if t:
            supply.subtract(bin_)
    displaced = []
    for bin_ in sorted(a, key=sum, reverse=True):
        if sum(bin_) < WELL_FILLED * capacity:
            break
        need = Counter(bin_) if len(set(bin_)) < len(bin_) else dict.fromkeys(bin_, 1)
        if all(supply[x] >= k for x, k in need.items()):
            child.append(bin_)
            for x, k in need.items():
                supply[x] -= k
    for size, k in supply.items():
        displaced += [size] * k
    return complete(child, displaced, capacity, rng)


def mutate(bins: Bins, capacity: int, rng: np.random.Generator) -> Bins:
    """All bins that are not full and a share of the full ones, from one in a thousand to all, are emptied and completed anew."""
    share = 10.0 ** rng.uniform(-3, 0.2)
    kept, emptied = [], []
    for bin_, x in zip(bins, rng.random(len(bins)).tolist()):
        (emptied if x < share or sum(bin_) < capacity else kept).append(bin_)
    return complete(kept, [x for bin_ in emptied for x in bin_], capacity, rng)


def evolve(start: list[Bins], capacity: int, rng: np.random.Generator, generations: int = GENERATIONS, children: int = CHILDREN, patience: int = PATIENCE) -> list[Bins]:
    """Generations from ``start`` until no packing can have fewer bins, or ``patience`` of them found no better one; returns the population, best first."""
    population = sorted(((fitness(s, capacity), s) for s in start), key=lambda s: s[0])
    least = least_bins([x for bin_ in start[0] for x in bin_], capacity)
    keep = max(KEPT, len(population))
    waited = 0
    for _ in range(generations):
        best = population[0][0]
        if best[0] <= least or waited >= patience:
            break
        for k in range(children):
            i, j = rng.permutation(len(population))[:2] if len(population) > 1 else (0, 0)
            # every other child has one parent
            child = mutate(population[i][1], capacity, rng) if k % 2 else crossover(population[i][1], population[j][1], capacity, rng)
            population.append((fitness(child, capacity), child))
        # equal fitness counts once, so that the population does not fill with copies
        population = sorted({f: (f, s) for f, s in population}.values(), key=lambda s: s[0])[:keep]
        waited = 0 if population[0][0] < best else waited + 1
    return [s for _, s in population]


def shuffled_fit(lengths: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """A different start: the longer half first in random order, then best-fit of the rest."""
    sizes = sorted(lengths, reverse=True)
    seeds = [tuple([x]) for x in sizes if 2 * x > capacity]
    rest = [x for x in sizes if 2 * x <= capacity]
    rng.shuffle(rest)
    half = len(rest) // 2
    return best_fit(best_fit(seeds, rest[:half], capacity), rest[half:], capacity)


def pack_lengths(lengths: list[int], capacity: int = CAPACITY, seed: int = 0) -> Bins:
    """One island's packing of a list, for small inputs and tests."""
    rng = np.random.default_rng(seed)
    if not lengths:
        return []
    return evolve([best_fit([], lengths, capacity), shuffled_fit(lengths, capacity, rng)], capacity, rng)[0]


def _solution(bins: Bins) -> tuple[list[list[int]], list[int]]:
    count = Counter(bins)
    return [list(b) for b in count], list(count.values())


def _expand(patterns, counts) -> Bins:
    return [tuple(int(x) for x in p) for p, n in zip(patterns, counts) for _ in range(int(n))]


_POPULATION = "block int, island int, rank int, patterns array<array<int>>, counts array<int>, open boolean"


def _epochs(lengths: DataFrame, blocks: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """The best solution of each block, ``(block, patterns, counts)``; ``lengths`` is ``(block, length, n)``.

    A block ends early when an island has met its bound or an epoch bettered none of its islands.
    """

    def first(key, pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        rng = np.random.default_rng([block, island])
        sizes = np.repeat(pdf["length"].to_numpy(), pdf["n"].to_numpy()).tolist()
        start = [best_fit([], sizes, capacity)] if island == 0 else []
        start += [shuffled_fit(sizes, capacity, rng) for _ in range(1 if island == 0 else 2)]
        return _frame(block, island, start, rng)

    def later(epoch: int):
        def again(key, pdf: pd.DataFrame) -> pd.DataFrame:
            block, island = int(key[0]), int(key[1])
            if not pdf["open"].any():
                return pdf[pdf["source"] == island][["block", "island", "rank", "patterns", "counts", "open"]]
            pdf = pdf.sort_values(["rank", "source"], kind="stable")
            start = [_expand(p, c) for p, c in zip(pdf["patterns"], pdf["counts"])]
            return _frame(block, island, start, np.random.default_rng([block, island, epoch]))

        return again

    def _frame(block: int, island: int, start: list[Bins], rng: np.random.Generator) -> pd.DataFrame:
        population = evolve(start, capacity, rng)
        least = least_bins([x for bin_ in start[0] for x in bin_], capacity)
        better = fitness(population[0], capacity) < min(fitness(s, capacity) for s in start)
        rows = [(block, island, rank, *_solution(s), better and len(population[0]) > least) for rank, s in enumerate(population[:2])]
        return pd.DataFrame(rows, columns=["block", "island", "rank", "patterns", "counts", "open"])

    def each_island(df: DataFrame):
        # a number of one's own keeps adaptive execution from putting all islands, whose rows are few, into one task
        return df.repartition(blocks * islands, "block", "island").groupBy("block", "island")

    each = lengths.select("block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "length", "n")
    population = materialize(each_island(each).applyInPandas(first, _POPULATION), "population")
    for epoch in range(1, epochs):
        if population.where("open").isEmpty():
            break
        own = population.withColumn("source", F.col("island"))
        elite = population.where("rank = 0").withColumn("source", F.col("island")).withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        both = own.unionByName(elite) if islands > 1 else own
        population = materialize(each_island(both).applyInPandas(later(epoch), _POPULATION), "population")
    size = F.aggregate("counts", F.lit(0), lambda x, y: x + y)
    best = population.where("rank = 0").select("block", F.struct(size.alias("bins"), "island", "patterns", "counts").alias("s"))
    return best.groupBy("block").agg(F.min_by("s", F.struct("s.bins", "s.island")).alias("s")).select("block", "s.patterns", "s.counts")


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, block_size: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``pieces`` with ``sequence_id long`` and ``offset long``: offsets run from 0 without gaps in every sequence.

    Lengths must be from 1 to ``capacity``; a null or other length raises. Rows are numbered and written
    once, so that every later read sees the same numbers. An empty table gives an empty result. Input
    columns named like the new ones are replaced.
    """
    configure(pieces.sparkSession)
    ok = F.coalesce(F.col(length).between(1, capacity), F.lit(False))
    rows = materialize(pieces.withColumn("__key", F.monotonically_increasing_id()), "pieces")
    rows = rows.withColumn("__length", F.when(ok, F.col(length).cast("int")).otherwise(F.raise_error(F.lit(f"a length is not from 1 to {capacity}")).cast("int")))
    # full pieces get ids below zero, which no block uses
    full = rows.where(F.col("__length") == capacity).withColumns({"sequence_id": -1 - F.col("__key"), "offset": F.lit(0).cast("long")})
    short = rows.where(F.col("__length") < capacity)
    blocks = max(1, -(-short.count() // block_size))
    short = short.withColumn("__block", F.pmod(F.xxhash64("__key"), F.lit(blocks)).cast("int"))
    lengths = short.groupBy(F.col("__block").alias("block"), F.col("__length").alias("length")).agg(F.count("*").cast("int").alias("n"))
    best = materialize(_epochs(lengths, blocks, capacity, islands, epochs), "packed")

    def place(batches):
        for batch in batches:
            for block, patterns, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seen: Counter = Counter()
                rows = []
                for at, bin_ in enumerate(_expand(patterns, counts)):
                    offset = 0
                    for size in bin_:
                        rows.append((block, size, seen[size], (block << 32) + at, offset))
                        seen[size] += 1
                        offset += size
                names = ["__block", "__length", "__nth", "sequence_id", "offset"]
                types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    places = best.mapInArrow(place, "__block int, __length int, __nth int, sequence_id long, offset long")
    nth = F.row_number().over(Window.partitionBy("__block", "__length").orderBy("__key")) - 1
    # places grow with the pieces, and Spark cannot see their size behind the Python stage: never broadcast them
    placed = short.withColumn("__nth", nth.cast("int")).join(places.hint("merge"), ["__block", "__length", "__nth"])
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")] + ["sequence_id", "offset"]
    return full.select(names).unionByName(placed.select(names))


def pack_documents(df: DataFrame, tokens, id_col: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack every document: ``(id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    return pack(token_pieces(df, tokens, id_col, text, end_id, capacity), "length", capacity)
