"""Benchmark decontamination by greedy string tiling.

Every run of MIN_TILE words of a document or an item is a seed. Seeds of documents are
joined with those of the benchmark by Spark, behind a bitmap of bounded size that tells
most documents apart where they are read: only seeds that may be shared are moved, with
the words around them. Of each pair of a document and an item that share a seed, the
item is tiled against the document: running Karp-Rabin hashes find common runs of the
search length, the longest runs that hold no marked word are marked first, and the search
length falls until MIN_TILE. The share of an item's words under tiles is its coverage,
whatever order its parts stand in.

Documents are read once, however large the benchmark, and texts are not moved.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import flat
from quillstone.llm.common import forget, light, slices, small_batches, written

MIN_TILE, THRESHOLD = 5, 0.5
#: Bits of the bitmap of seeds: 16 a seed, within these bounds (as powers of 2). A fuller one lets more through, nothing is lost.
LEAST_BITS, MOST_BITS = 16, 27
#: Rows of the bitmap as they come to the driver: so many bits each, so 128 rows at most.
BLOCK_BITS = 20
_BASE, _MASK = 0x100000001B3, (1 << 64) - 1


def _karp_rabin(words: list[int], size: int):
    """(start, hash) of each run of `size` words, each from the one before."""
    if len(words) < size:
        return
    top, h = pow(_BASE, size, 1 << 64), 0
    for i, w in enumerate(words):
        h = (h * _BASE + w) & _MASK
        if i >= size:
            h = (h - words[i - size] * top) & _MASK
        if i >= size - 1:
            yield i - size + 1, h


def _free_runs(marked: bytearray, at_least: int):
    """(start, end) of the stretches without a mark."""
    start = None
    for i in range(len(marked) + 1):
        if i < len(marked) and not marked[i]:
            start = i if start is None else start
        elif start is not None:
            if i - start >= at_least:
                yield start, i
            start = None


def _common_runs(item: list[int], text: list[int], in_item: bytearray, in_text: bytearray, size: int) -> list[tuple[int, int, int]]:
    """(length, start in item, start in text) of the maximal unmarked common runs of at least size."""
    starts: dict[int, list[int]] = {}
    for a, b in _free_runs(in_item, size):
        for i, h in _karp_rabin(item[a:b], size):
            starts.setdefault(h, []).append(a + i)
    found = []
    for a, b in _free_runs(in_text, size) if starts else ():
        for j, h in _karp_rabin(text[a:b], size):
            for p in starts.get(h, ()):
                q, n = a + j, 0
                if p and q and not in_item[p - 1] and not in_text[q - 1] and item[p - 1] == text[q - 1]:
                    continue  # found from further left
                while p + n < len(item) and q + n < len(text) and not in_item[p + n] and not in_text[q + n] and item[p + n] == text[q + n]:
                    n += 1
                if n >= size:  # hashes are checked word by word
                    found.append((n, p, q))
    return found


def tiles(item: list[int], text: list[int], min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of each tile: longest first, then by place."""
    in_item, in_text, out = bytearray(len(item)), bytearray(len(text)), []
    size = max(min_tile, min(len(item), len(text)))
    while True:
        found = _common_runs(item, text, in_item, in_text, size)
        queue = [(-n, p, q) for n, p, q in found]
        heapq.heapify(queue)
        while queue:
            n, p, q = heapq.heappop(queue)
            free = bytearray(a or b for a, b in zip(in_item[p : p - n], in_text[q : q - n]))
            if not any(free):
                in_item[p : p - n] = in_text[q : q - n] = b"\1" * -n
                out.append((p, q, -n))
            else:  # cut by longer tiles: what is left of it takes its turn
                for a, b in _free_runs(free, size):
                    heapq.heappush(queue, (a - b, p + a, q + a))
        if size == min_tile:
            return out
        size = max(min_tile, size // 2)


def _items(benchmark: DataFrame, min_tile: int, item_col: str, item_text: str) -> DataFrame:
    """Written: item (unique), id, words (hashes, eight bytes each), seeds, of items of at least min_tile words."""

    def read(batches):
        for batch in light(batches):
            rows = []
            for item, i, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                w = flat.words_of([text])
                h = flat.hashes(w)
                if len(h) >= min_tile:
                    rows.append((item, i, h.tobytes(), np.unique(flat.shingles(h, w.bounds, min_tile)[0]).view(np.int64)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int64()))], names=["item", "id", "words", "seeds"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).filter("text is not null")
    return written(rows.mapInArrow(read, "item long, id long, words binary, seeds array<long>"), "tiling-items")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits of the seeds' leading places; Spark makes blocks of it, the driver gets at most 2 ** MOST_BITS bits."""
    n = seeds.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    place = F.shiftrightunsigned("seed", 64 - bits)
    block = min(bits, BLOCK_BITS)

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for batch in light(batches):
            at = batch.column(0).to_numpy()
            for b in np.unique(at >> block).tolist():
                held.setdefault(b, np.zeros(1 << block, bool))[at[at >> block == b] & ((1 << block) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])

    out = np.zeros(1 << bits, bool)
    # a block is made in one task, from distinct places: 2 ** BLOCK_BITS of them at most
    places = seeds.select(place.alias("at")).distinct().repartition(F.shiftright("at", block))
    for r in places.mapInArrow(fill, "block long, bits binary").toLocalIterator():
        out[r["block"] << block : (r["block"] + 1) << block] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return out


def _runs(words: np.ndarray, hits: np.ndarray, min_tile: int) -> bytes:
    """The words of shared seeds; stretches are kept apart by a word that none has."""
    inside = np.zeros(len(words) + 1, bool)
    for j in range(min_tile):
        inside[hits + j] = True
    edge = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))
    out = []
    for k, (a, b) in enumerate(zip(edge[::2], edge[1::2])):
        out += [words[a:b], np.array([(1 << 64) - 1 - k], np.uint64)]
    return np.concatenate(out).tobytes()


def _scanned(rows: DataFrame, bitmap: np.ndarray, min_tile: int, kind: str) -> DataFrame:
    """rows: id, text, th, row. Adds runs and seeds to rows that may share a seed with an item; others have none."""
    packed, shift = np.packbits(bitmap).tobytes(), np.uint64(64 - (len(bitmap).bit_length() - 1))

    def scan(batches):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in light(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            runs: list = [None] * len(texts)
            seeds: list = [None] * len(texts)
            for lo, hi in slices(texts, 250_000):
                w = flat.words_of(texts[lo:hi])
                h = flat.hashes(w)
                grams, doc = flat.shingles(h, w.bounds, min_tile)
                hits = np.flatnonzero(bits[(grams >> shift).astype(np.int64)])
                first = np.searchsorted(doc, np.arange(hi - lo))
                for d, own in zip(*_split(doc[hits], hits)):
                    runs[lo + d] = _runs(h[w.bounds[d] : w.bounds[d + 1]], own - first[d], min_tile)
                    seeds[lo + d] = np.unique(grams[own]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(runs, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))], names=["id", "th", "row", "runs", "seeds"])

    return rows.mapInArrow(scan, f"id {kind}, th long, row long, runs binary, seeds array<long>")


def _split(keys: np.ndarray, values: np.ndarray):
    """Each key of an ascending list and its values."""
    if not len(keys):
        return [], []
    first = np.flatnonzero(np.r_[True, np.diff(keys) != 0])
    return keys[first].tolist(), np.split(values, first[1:])


def _coverage(pairs: DataFrame, min_tile: int) -> DataFrame:
    """pairs: row, id, runs, words. Returns row, id (of the item), cover."""

    def tile(batches):
        for batch in light(batches):
            cover = []
            for runs, words in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                item = np.frombuffer(words, "<u8").tolist()
                cover.append(sum(n for *_, n in tiles(item, np.frombuffer(runs, "<u8").tolist(), min_tile)) / len(item))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cover, pa.float64())], names=["row", "id", "cover"])

    return pairs.mapInArrow(tile, "row long, id long, cover double")


def _covered(docs: DataFrame, benchmark: DataFrame, min_tile: int, id_col: str, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """Written: every row's id, th (of the text), row (unique); and row, id (of the item), cover of the pairs that share a seed."""
    small_batches(docs.sparkSession)
    items = _items(benchmark, min_tile, item_col, item_text)
    seeds = items.select("item", F.explode("seeds").alias("seed"))
    bitmap = _bitmap(seeds.select("seed").distinct())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"), F.monotonically_increasing_id().alias("row"))
    scanned = written(_scanned(rows, bitmap, min_tile, rows.schema["id"].dataType.simpleString()), "tiling-scan")
    found = scanned.filter("runs is not null")
    pairs = found.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").select("row", "item").distinct()
    pairs = written(pairs, "tiling-pairs").join(found.select("row", "runs"), "row").join(items.select("item", "id", "words"), "item").select("row", "id", "runs", "words")
    # tiling is work for the processor, not for memory: pairs are spread over all tasks
    cover = written(_coverage(pairs.repartition("row", "id"), min_tile), "tiling-cover")
    forget(items)
    return scanned.select("id", "th", "row"), cover


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_tile: int = MIN_TILE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that cover no benchmark item up to threshold; columns unchanged, whatever their names.

    Null texts stay; rows that repeat id and text go or stay alike. Texts are moved only if
    the keys of what goes (id and text's hash) are too many to be broadcast.
    """
    rows, cover = _covered(docs, benchmark, min_tile, id_col, text_col, item_col, item_text)
    bad = written(cover.filter(F.col("cover") >= threshold).select("row").distinct().join(rows, "row").select(F.col("id").alias("i"), F.col("th").alias("t")).distinct(), "tiling-bad")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    kept = own.join(bad, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left_anti")
    return kept.select([F.col("row").getField(c).alias(c) for c in docs.columns])


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_tile: int = MIN_TILE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: id, item_ids, coverage, contaminated.

    item_ids: items whose coverage reaches threshold, ascending; coverage: the greatest of
    any item, 0 if none shares a run of min_tile words. Null texts count as empty; items of
    fewer than min_tile words are never matched, those without id are told as null; equal
    items each count; repeated rows and null ids stay; other columns are not read.
    """
    rows, cover = _covered(docs, benchmark, min_tile, id_col, text_col, item_col, item_text)
    reached = F.array_sort(F.collect_list(F.when(F.col("cover") >= threshold, F.struct("id"))))
    found = cover.groupBy("row").agg(reached.alias("reached"), F.max("cover").alias("coverage"))
    out = rows.select("id", "row").hint("merge").join(found, "row", "left")
    ids = F.expr("coalesce(transform(reached, x -> x.id), cast(array() as array<bigint>))")
    return out.select(F.col("id").alias(id_col), ids.alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage")).withColumn("contaminated", F.size("item_ids") > 0)
