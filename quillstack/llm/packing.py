"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces that fill a sequence alone need no search. All others are dealt out by a hash to islands of a bounded number of pieces, one
Spark group each. An island holds a few subpopulations of packings (a packing is a list of bins). Crossover copies whole well-filled
bins of one parent into the other, removes the bins that hold the same pieces, and puts the displaced pieces back by best fit,
largest first; mutation dissolves the worst bins. Every few generations the best packing of each subpopulation migrates to the next
one. An island stops when it reaches the lower bound of its bins.

Between epochs, islands exchange material: full bins are final, and the pieces of all bins that aren't full migrate to new islands,
so that the part-filled rest of many islands is packed together. This ends when one island holds the rest, or when an epoch saves less
than LEAST_SAVING of all sequences.

Nulls and odd rows: a null text counts as empty; every document has at least its end id, so at least one piece. Repeated doc_ids
give rows of their own. An empty table gives an empty result. pack_documents() reads only the two named columns; pack() carries all columns
of the pieces along, but replaces those named sequence_id or offset.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, in_parts, table, written
from .tokens import encoder

#: Pieces of an island (at most about so many), subpopulations of an island, packings in each, generations, generations between migrations.
ISLAND, DEMES, POPULATION, GENERATIONS, MIGRATE = 2048, 3, 4, 12, 4
#: An epoch that saves a smaller share of all sequences is the last one.
LEAST_SAVING = 0.0002
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """Bins under repair: best fit by residual space, found in a bit set of the residuals in use."""

    def __init__(self, size: list[int], capacity: int):
        self.size, self.capacity, self.bins, self.left, self.by_left, self.mask = size, capacity, [], [], {}, 0

    def open(self, items: list[int], left: int) -> None:
        k = len(self.bins)
        self.bins.append(items)
        self.left.append(left)
        self.by_left.setdefault(left, []).append(k)
        self.mask |= 1 << left

    def put(self, item: int) -> None:
        need = self.size[item]
        fits = self.mask >> need
        if not fits:
            self.open([item], self.capacity - need)
            return
        left = need + (fits & -fits).bit_length() - 1
        same = self.by_left[left]
        k = same.pop()
        if not same:
            self.mask &= ~(1 << left)
        self.bins[k] = [*self.bins[k], item]
        self.left[k] = left = left - need
        self.by_left.setdefault(left, []).append(k)
        self.mask |= 1 << left


def best_fit(size: list[int], capacity: int, items: list[int], bins: list[list[int]] = ()) -> list[list[int]]:
    """`bins`, with `items` put into them by best fit, largest first."""
    b = Bins(size, capacity)
    for x in bins:
        b.open(x, capacity - sum(size[i] for i in x))
    for i in sorted(items, key=size.__getitem__, reverse=True):
        b.put(i)
    return b.bins


def fitness(size: list[int], capacity: int, bins: list[list[int]]) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones: a full bin and an empty rest are better than two halves."""
    return -len(bins), sum((sum(size[i] for i in x) / capacity) ** 2 for x in bins)


def crossover(size: list[int], capacity: int, giver: list[list[int]], taker: list[list[int]], rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of `giver` in `taker`; pieces that this displaces are put back by best fit."""
    fill = sorted(giver, key=lambda x: -sum(size[i] for i in x))
    good = fill[: max(1, len(fill) * 3 // 4)]
    chosen = [x for x in good if rng.random() < 0.5] or good[:1]
    inside = {i for x in chosen for i in x}
    kept, loose = list(chosen), []
    for x in taker:
        if inside.isdisjoint(x):
            kept.append(x)
        else:
            loose += [i for i in x if i not in inside]
    return best_fit(size, capacity, loose, kept)


def mutate(size: list[int], capacity: int, bins: list[list[int]], rng: random.Random) -> list[list[int]]:
    """Dissolves the worst-filled bins and a few others."""
    order = sorted(bins, key=lambda x: sum(size[i] for i in x))
    n = max(2, len(order) // 20)
    gone = order[:n] + rng.sample(order[n:], min(n, len(order) - n))
    out = {id(x) for x in gone}
    loose = [i for x in gone for i in x]
    rng.shuffle(loose)
    return best_fit(size, capacity, loose, [x for x in bins if id(x) not in out])


def lower_bound(size: list[int], capacity: int) -> int:
    """Bins that any packing needs (Martello and Toth's L2): pieces over half a bin can't share, and the small ones must fit beside them."""
    count = np.bincount(np.array(size, dtype=np.int64), minlength=capacity + 1)
    n_up, sum_up = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half, best = capacity // 2, -(-int(sum_up[-1]) // capacity)
    for a in range(half + 1):
        large = int(n_up[-1] - n_up[half])
        beside = int(n_up[capacity - a] - n_up[half]) * capacity - int(sum_up[capacity - a] - sum_up[half])
        small = int(sum_up[half] - (sum_up[a - 1] if a else 0))
        best = max(best, large + max(0, -(-(small - beside) // capacity)))
    return best


def evolve(size: list[int], capacity: int, seed: int = 0) -> list[list[int]]:
    """The best packing that the subpopulations of an island find: a list of bins of piece numbers."""
    if not size:
        return []
    rng, bound, items = random.Random(seed), lower_bound(size, capacity), list(range(len(size)))
    score = lambda p: fitness(size, capacity, p)
    best = best_fit(size, capacity, items)
    if len(best) <= bound:
        return best
    demes = [[best] + [mutate(size, capacity, best, rng) for _ in range(POPULATION - 1)] for _ in range(DEMES)]
    for generation in range(1, GENERATIONS + 1):
        for deme in demes:
            giver, taker = rng.sample(deme, 2)
            child = crossover(size, capacity, giver, taker, rng)
            if rng.random() < 0.5:
                child = mutate(size, capacity, child, rng)
            deme.append(child)
            deme.sort(key=score, reverse=True)
            deme.pop()
            if len(deme[0]) <= bound:
                return deme[0]
        if generation % MIGRATE == 0:
            elite = [deme[0] for deme in demes]
            for k, deme in enumerate(demes):
                deme[-1] = elite[k - 1]
                deme.sort(key=score, reverse=True)
    return max((deme[0] for deme in demes), key=score)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each document with its end id, cut into pieces: only documents over `capacity` are cut, and their first piece may be shorter."""

    def cut(batches):
        import pyarrow as pa

        tok, end = encoder(tokenizer), np.array([end_id], dtype=np.uint32)
        for batch in in_parts(batches, 256, 1):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode([x or "" for x in batch.column(1).to_pylist()])):
                ids = np.concatenate([ids, end]).astype("<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            d, k, a, n, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (a, n, c))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(cut, PIECES)


def _islands(capacity: int) -> Callable:
    """Packs the islands of a stream that is sorted by island and row; a bin goes by the least row in it, which no other bin has."""

    def packed(island: int, row: np.ndarray, length: np.ndarray):
        import pyarrow as pa

        size = length.tolist()
        bin_of, offset, fill = (np.zeros(len(size), dtype=np.int64) for _ in range(3))
        for items in evolve(size, capacity, seed=island):
            at = np.cumsum([size[i] for i in items])
            bin_of[items], offset[items], fill[items] = row[items].min(), at - length[items], at[-1]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (row, length, bin_of, offset, fill)], names=["row", "length", "sequence_id", "offset", "fill"])

    def pack(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            island, row, length = (np.asarray(batch.column(k)).astype(np.int64) for k in range(3))
            cuts = [0, *(np.flatnonzero(np.diff(island)) + 1).tolist(), len(island)]
            for a, b in zip(cuts, cuts[1:]):
                if held and a < b and held[0][0][0] != island[a]:
                    yield packed(int(held[0][0][0]), *(np.concatenate([h[k] for h in held]) for k in (1, 2)))
                    held = []
                if a < b:
                    held.append((island[a:b], row[a:b], length[a:b]))
        if held:
            yield packed(int(held[0][0][0]), *(np.concatenate([h[k] for h in held]) for k in (1, 2)))

    return pack


def pack(pieces: DataFrame, capacity: int, island: int = ISLAND, least_saving: float = LEAST_SAVING) -> DataFrame:
    """`pieces` (with a `length` of 1 to `capacity`) with sequence_id and offset.

    Every epoch handles only the bins that the epoch before left part-filled, so the later ones are small.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    key = fresh(pieces, "row")
    pieces = written(pieces.withColumn(key, F.monotonically_increasing_id()), "pieces")
    n, units = pieces.agg(F.count_if(F.col("length") < capacity), F.sum("length")).first()
    rest = pieces.where(F.col("length") < capacity).select(F.col(key).alias("row"), F.col("length").cast("long").alias("length"))
    done = [pieces.where(F.col("length") >= capacity).select(F.col(key).alias("row"), F.col(key).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    bins, epoch, bar = None, 0, max(1, int(least_saving * (units or 0) / capacity))
    while n:
        groups = -(-n // island)
        tasks = min(groups, max(2 * spark.sparkContext.defaultParallelism, groups // 64))
        dealt = rest.select(F.pmod(F.xxhash64("row", F.lit(epoch)), F.lit(groups)).alias("island"), "row", "length")
        dealt = dealt.repartitionById(tasks, (F.col("island") % tasks).cast("int")).sortWithinPartitions("island", "row")
        made = written(dealt.mapInArrow(_islands(capacity), "row long, length long, sequence_id long, offset long, fill long"), f"epoch{epoch}")
        loose = made.where(F.col("fill") < capacity)
        n_loose, n_bins = loose.agg(F.count("*"), F.countDistinct("sequence_id")).first()
        last = groups == 1 or n_loose == n or (bins is not None and bins - n_bins < bar)
        done.append((made if last else made.where(F.col("fill") >= capacity)).select("row", "sequence_id", "offset"))
        rest, n, bins, epoch = loose.select("row", "length"), 0 if last else n_loose, n_bins, epoch + 1
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    return pieces.join(placed.withColumnRenamed("row", key), key).drop(key)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)


def op9_pack_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` in sequences of at most 1024 tokens of the byte-level BPE."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
