"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces; pieces of full length are sequences of their own, the
rest are dealt at random to blocks of about BLOCK pieces. Each block is packed by
several islands. An individual is a packing, its genes are whole sequences. Crossover
injects well-filled sequences of one parent into the other, drops the other's sequences
that now hold duplicates, and puts what those displaced back by best fit. After every
epoch the best packing of an island migrates to its neighbour. Sequences still poorly
filled at the end are pooled over all blocks and packed once more in the same way.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import bpe
from quillstone.llm.common import id_texts, light, partitions, row_ids, small_batches, written

#: An epoch ends after GENERATIONS children, or at once where a packing has as few sequences as the tokens need.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 3, 2, 100, 8
#: A sequence filled to this share is never taken apart by pooling.
WELL_FILLED = 0.97


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: item (unique once written), id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        enc, end, items = bpe.encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), row_ids()
        for batch in light(batches, keeping=True):
            ids, texts = id_texts(batch)
            rows = []
            for i, t in zip(ids, texts):
                b = enc.encode(t) + end
                n = len(b) // 4
                lo, hi, k = 0, (n - 1) % capacity + 1, 0
                while lo < n:
                    rows.append((next(items), i, k, lo, hi - lo, zlib.crc32(memoryview(b)[4 * lo : 4 * hi])))
                    lo, hi, k = hi, hi + capacity, k + 1
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], batch.schema.field(0).type), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[3:])],
                names=["item", "id", "piece", "start", "length", "ids_crc32"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"item long, id {kind}, piece int, start long, length long, ids_crc32 long")


class Shelf:
    """Open sequences by room left; best fit in constant time by the lowest set bit of a mask."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_room = capacity, 0, [[] for _ in range(capacity + 1)]

    def put(self, b: int, room: int) -> None:
        self.by_room[room].append(b)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least size."""
        m = self.mask >> size
        if not m:
            return None
        room = size + (m & -m).bit_length() - 1
        at = self.by_room[room]
        b = at.pop()
        if not at:
            self.mask &= ~(1 << room)
        return b, room


def best_fit(bins: np.ndarray, order, sizes: list[int], used: list[int], capacity: int) -> np.ndarray:
    """Puts the items of order into the sequences with loads `used` or new ones; bins is changed."""
    shelf = Shelf(capacity)
    for b, load in enumerate(used):
        if load < capacity:
            shelf.put(b, capacity - load)
    n = len(used)
    for i in order:
        size = sizes[i]
        b, room = shelf.take(size) or (n, capacity)
        n += b == n
        bins[i] = b
        if room > size:
            shelf.put(b, room - size)
    return bins


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple:
    """Fewer sequences first, then unevenly filled ones, as those leave room to be gained."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return -len(fill), float((fill * fill).sum())


def crossover(giver: np.ndarray, taker: np.ndarray, sizes: np.ndarray, size_list: list[int], capacity: int, rnd: random.Random) -> np.ndarray:
    """A child of two packings: the giver's well-filled sequences, whole, within the taker's."""
    fill = np.bincount(giver, weights=sizes)
    level = capacity * (1 - rnd.choice((0.0, 0.001, 0.004, 0.01)))
    picked = (fill >= level) & (np.random.default_rng(rnd.getrandbits(32)).random(len(fill)) < rnd.choice((0.3, 0.6, 0.95)))
    given = picked[giver]
    broken = np.zeros(int(taker.max()) + 1, bool)
    broken[taker[given]] = True
    kept = ~broken[taker] & ~given
    loose = np.flatnonzero(~given & ~kept)
    child = np.empty_like(taker)
    _, a = np.unique(giver[given], return_inverse=True)
    _, b = np.unique(taker[kept], return_inverse=True)
    k = int(a.max()) + 1 if len(a) else 0
    child[given], child[kept] = a, b + k
    n = k + (int(b.max()) + 1 if len(b) else 0)
    placed = given | kept
    used = np.bincount(child[placed], weights=sizes[placed], minlength=n).astype(int).tolist() if n else []
    return best_fit(child, loose[np.argsort(-sizes[loose], kind="stable")].tolist(), size_list, used, capacity)


def evolve(sizes: np.ndarray, start: list[np.ndarray], seed: int, capacity: int) -> np.ndarray:
    """One epoch of one island; start: packings it begins with. Returns its best packing."""
    rnd, size_list = random.Random(seed), sizes.tolist()
    least = -(-int(sizes.sum()) // capacity)
    people = list(start)
    for k in range(POPULATION - len(people)):
        if people and min(int(p.max()) + 1 for p in people) <= least:
            break
        # decreasing sizes; all but the first individual with a little disorder
        noise = np.random.default_rng(rnd.getrandbits(32)).random(len(sizes)) * (0 if k + len(start) == 0 else 4 ** (k % 5 + 1))
        people.append(best_fit(np.empty(len(sizes), np.int64), np.argsort(-(sizes + noise), kind="stable").tolist(), size_list, [], capacity))
    scored = sorted(((fitness(p, sizes, capacity), n, p) for n, p in enumerate(people)), reverse=True)
    for g in range(GENERATIONS):
        if -scored[0][0][0] <= least:
            break
        giver, taker = rnd.sample(range(len(scored)), 2)
        child = crossover(scored[giver][2], scored[taker][2], sizes, size_list, capacity, rnd)
        scored = sorted([*scored, (fitness(child, sizes, capacity), POPULATION + g, child)], reverse=True)[:POPULATION]
    return scored[0][2]


def _epoch(rows: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """rows: block, island, sizes, packings (binary int32 arrays). Gives the island's best packing in their place."""

    def run(batches):
        for batch in light(batches, keeping=True):
            out = []
            for block, island, sizes, packings in zip(*(batch.column(i).to_pylist() for i in range(4))):
                s = np.array(sizes, np.int64)
                best = evolve(s, [np.frombuffer(p, "<i4").astype(np.int64) for p in packings], hash((block, island, epoch)), capacity)
                n, even = fitness(best, s, capacity)
                out.append((-n, even, best.astype("<i4").tobytes()))
            bins, even, packing = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bins, pa.int64()), pa.array(even, pa.float64()), pa.array(packing, pa.binary())], names=["block", "island", "sizes", "bins", "even", "packing"])

    return rows.mapInArrow(run, "block long, island int, sizes array<long>, bins long, even double, packing binary")


def _migrated(elites: DataFrame, islands: int) -> DataFrame:
    """Each island starts the next epoch with its own elite and its neighbour's; a block has `islands` rows."""
    all_of = elites.groupBy("block").agg(F.first("sizes").alias("sizes"), F.array_sort(F.collect_list(F.struct("island", "packing"))).alias("all"))
    isle = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    return all_of.select("block", isle, "sizes", "all").select("block", "island", "sizes", F.expr(f"array_distinct(array(all[island].packing, all[(island + {islands - 1}) % {islands}].packing))").alias("packings"))


def pack_items(items: DataFrame, capacity: int, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """items: item (unique), length. Returns item, bin (long, unique over all), offset, fill, written."""
    spark = items.sparkSession
    n_blocks = max(1, -(-items.count() // block))
    # a block holds about `block` rows at any input size, as items are unique
    blocks = written(
        items.groupBy(F.pmod(F.xxhash64("item"), F.lit(n_blocks)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("length", "item"))).alias("rows")),
        "pack-blocks",
    )
    sizes = F.expr("transform(rows, r -> r.length)").alias("sizes")
    isles = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    # the search is work for the processor, whatever the bytes
    n = max(partitions(spark), min(n_blocks * islands // 4, 100_000))
    rows = blocks.select("block", isles, sizes, F.expr("array()").cast("array<binary>").alias("packings"))
    for epoch in range(epochs):
        elites = _epoch(rows.repartition(n, "block", "island"), capacity, epoch)
        rows = _migrated(elites, islands)
    best = elites.groupBy("block").agg(F.min(F.struct("bins", -F.col("even"), "island", "packing")).alias("best"))

    def place(batches):
        for batch in batches:
            for b, rows, packing in zip(*(batch.column(i).to_pylist() for i in range(3))):
                size, item = np.array([r["length"] for r in rows]), np.array([r["item"] for r in rows])
                bins = np.frombuffer(packing, "<i4")
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(size[order])
                first = np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0])
                begin = np.repeat((ends - size[order])[first], np.diff(np.r_[first, len(order)]))
                fill = np.bincount(bins, weights=size)[bins[order]] / capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item[order]), pa.array(b * (1 << 32) + bins[order].astype(np.int64)), pa.array(ends - size[order] - begin), pa.array(fill)],
                    names=["item", "bin", "offset", "fill"],
                )

    rows = blocks.join(best.select("block", "best.packing"), "block").select("block", "rows", "packing")
    return written(rows.mapInArrow(place, "item long, bin long, offset long, fill double"), "pack-placed")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the token ids of all docs into sequences of at most `capacity` tokens.

    Returns per piece: id, piece, start, length, ids_crc32, sequence_id, offset. Null and
    empty texts give one piece that holds end_id alone; only documents over the capacity
    are cut, the first piece being the shorter one; repeated rows are packed each; other
    columns are not read; an empty table gives no rows.
    """
    pieces = written(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    short = pieces.filter(F.col("length") < capacity)
    placed = pack_items(short.select("item", "length"), capacity)
    well = F.col("fill") >= WELL_FILLED
    pooled = pack_items(placed.filter(~well).join(short.select("item", "length"), "item").select("item", "length"), capacity)
    at = placed.filter(well).select("item", (F.col("bin") * 4).alias("sequence_id"), "offset").unionAll(pooled.select("item", (F.col("bin") * 4 + 1).alias("sequence_id"), "offset"))
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col("item") * 4 + 2, "offset": F.lit(0).cast("long")})
    return whole.select(columns).unionAll(short.join(at, "item").select(columns))
