"""N-gram Jaccard self-join by MinHash banding.

Texts with equal sets of word n-grams become one class by pre-aggregation; only one row
of each class goes on. Bands and rows are chosen for a target recall at the threshold.
Band hashes are shuffled. Buckets that hold the same classes are one bucket. Pairs are
verified within buckets, on full n-gram sets: a bucket is dealt to tasks by tiles of TILE
classes, a pair of tiles to each, and a pair that meets in several buckets is verified in
the least of them only. So what is compared is each candidate pair once, and what is moved
grows with the buckets, not with what candidates chain together; no pair is ever a row.
Exact numbers of links are sums over buckets, and components are closed over verified
links alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import flat
from quillstone.llm.common import forget, id_texts, light, row_ids, slices, small_batches, written
from quillstone.llm.components import components

TILE = 256
MOST_HASHES, RECALL = 192, 0.9995


def bands_for(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows a band, so fewest false candidates, with the recall within `most` hashes."""
    best = (most, 1)
    for rows in range(1, 33):
        hit = threshold**rows
        bands = math.ceil(math.log1p(-recall) / math.log1p(-hit)) if hit < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(20240229)
    return rnd.integers(1, 1 << 32, n, np.uint64) | np.uint64(1), rnd.integers(0, 1 << 32, n, np.uint64)


def packed(grams: np.ndarray) -> bytes:
    """Sorted 48-bit values in six bytes each."""
    return grams.astype("<u4").tobytes() + (grams >> np.uint64(32)).astype("<u2").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def signatures(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: rid (unique once written), id, th (of the text), n (distinct n-grams), k1, k2 (of the set), bands, grams (as packed())."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches):
        a, b = _constants(bands * rows)
        salt = flat.mix(np.arange(1, bands + 1, dtype=np.uint64))
        rids = row_ids()
        for batch in light(batches):
            _, texts = id_texts(batch)
            for lo, hi in slices(texts, 250_000):
                w = flat.words_of(texts[lo:hi])
                h = flat.hashes(w)
                out = []
                for d in range(hi - lo):
                    own = h[w.bounds[d] : w.bounds[d + 1]]
                    g = own[: max(0, len(own) - n + 1)].copy()
                    if len(g):
                        for j in range(1, n):
                            g = g * flat._B1 + own[j : len(own) - n + 1 + j]
                    elif len(own):  # fewer words than n: all of them are its one n-gram
                        g = np.array([np.bitwise_xor.reduce(own * (np.arange(len(own), dtype=np.uint64) * np.uint64(2) + np.uint64(1))) + np.uint64(len(own))], np.uint64)
                    g = flat.mix(g)
                    if len(g):
                        full = np.unique(g)
                        small = np.unique(full >> np.uint64(16))
                        keys = (int(full.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(flat.mix(full ^ np.uint64(0x5851F42D4C957F2D)))))
                        s = small >> np.uint64(16)
                        low = np.full(bands * rows, np.uint64(1 << 63))
                        for at in range(0, len(s), 2048):
                            part = s[at : at + 2048, None] * a
                            part += b
                            part &= np.uint64(0xFFFFFFFFFFFF)
                            np.minimum(low, (part >> np.uint64(16)).min(0), out=low)
                        band = salt.copy()
                        for r in range(rows):
                            band = flat.mix(band ^ (low[r::rows] + flat._ODD))
                        out.append((len(small), *keys, band.view(np.int64), packed(small)))
                    else:
                        out.append((0, 0, 0, np.zeros(0, np.int64), b""))
                signed = lambda x: x - (1 << 64) if x >> 63 else x
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([next(rids) for _ in out], pa.int64()),
                        batch.column(0)[lo:hi],
                        batch.column(2)[lo:hi],
                        pa.array([x[0] for x in out], pa.int32()),
                        pa.array([signed(x[1]) for x in out], pa.int64()),
                        pa.array([signed(x[2]) for x in out], pa.int64()),
                        pa.array([x[3] for x in out], pa.list_(pa.int64())),
                        pa.array([x[4] for x in out], pa.binary()),
                    ],
                    names=["rid", "id", "th", "n", "k1", "k2", "bands", "grams"],
                )

    small_batches(docs.sparkSession)
    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    return rows_in.mapInArrow(sign, f"rid long, id {kind}, th long, n int, k1 long, k2 long, bands array<long>, grams binary")


def _links(sets: list[np.ndarray], mine: np.ndarray, threshold: float):
    """Yields (i, partners) of the pairs i, j with mine[i, j] that reach the threshold."""
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    end = np.cumsum(size)
    start = end - size
    seen = np.zeros(int(inverse.max()) + 1, bool)
    mine = mine & (np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size) - 1e-9)
    for i in np.flatnonzero(mine.any(1)).tolist():
        others = np.flatnonzero(mine[i])
        own = inverse[start[i] : end[i]]
        seen[own] = True
        if 3 * len(others) > len(sets):
            common = np.add.reduceat(seen[inverse], start)[others]
        else:
            common = np.array([np.count_nonzero(seen[inverse[start[j] : end[j]]]) for j in others.tolist()])
        seen[own] = False
        yield i, others[common >= threshold * (size[others] + size[i] - common) - 1e-9]


def _owned(bucket: int, own: list[np.ndarray]) -> np.ndarray:
    """Whether each pair of rows shares no bucket less than this one. own: each row's buckets."""
    earlier = [b[b < bucket] for b in own]
    value, inverse, n = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1  # those that one row alone has tell nothing
    member = np.zeros((len(own), int((n > 1).sum())), np.float32)
    row = np.repeat(np.arange(len(own)), [len(e) for e in earlier])
    several = n[inverse] > 1
    member[row[several], column[inverse[several]]] = 1
    return member @ member.T == 0


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: bucket, ti, tj, tile, rid, own, grams; all rows of a (bucket, ti, tj) in one task, in order.

    Returns rid, root (the least rid it is tied to here), n (its links here) of the rows with links.
    """

    def groups(batches):
        key, held = None, []
        for batch in light(batches):
            own = batch.column(5)
            for bucket, ti, tj, tile, rid, buckets, grams in zip(*(batch.column(i).to_pylist() for i in range(5)), (np.asarray(x.values) for x in own), batch.column(6).to_pylist()):
                if (bucket, ti, tj) != key:
                    if len(held) > 1:
                        yield key, held
                    key, held = (bucket, ti, tj), []
                held.append((rid, tile, buckets, unpacked(grams)))
        if len(held) > 1:
            yield key, held

    def verify(batches):
        rid, root, n = [], [], []
        for (bucket, ti, tj), held in groups(batches):
            parent, links = list(range(len(held))), [0] * len(held)

            def find(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            tile = np.array([h[1] for h in held])
            mine = np.triu(_owned(bucket, [h[2] for h in held]), 1)
            if ti != tj:
                mine &= tile[:, None] != tile
            for i, partners in _links([h[3] for h in held], mine, threshold):
                links[i] += len(partners)
                for j in partners.tolist():
                    links[j] += 1
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
            some = [x for x in range(len(held)) if links[x]]
            rid += [held[x][0] for x in some]
            root += [held[find(x)][0] for x in some]  # held is in order of rid, so this is the least
            n += [links[x] for x in some]
            if len(rid) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(root, pa.int64()), pa.array(n, pa.int64())], names=["rid", "root", "n"])
                rid, root, n = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(root, pa.int64()), pa.array(n, pa.int64())], names=["rid", "root", "n"])

    return rows.mapInArrow(verify, "rid long, root long, n long")


def keep_first(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of jaccard_join: that of the least id; columns unchanged, whatever their names.

    Wordless and null texts stay, each row of them. Of rows that repeat both id and text
    one stays, whichever; null ids give way to others; an empty table gives no rows.
    """
    rows, *tables = _joined(docs, threshold, n, id_col, text_col, TILE)
    joined = written(rows, "ngram-joined")
    forget(*tables)
    firsts = joined.groupBy("id", "th").agg(F.count_if("is_first").alias("stay"), F.count("*").alias("n")).filter("stay > 0")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    of = rows.join(firsts.withColumnsRenamed({"id": "i", "th": "t"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    whole = of.filter("stay = n").select(own)
    if firsts.filter("stay < n").isEmpty():
        return whole
    return whole.unionAll(of.filter("stay < n").groupBy("id", "th").agg(F.first("row").alias("row")).select(own))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per row of docs: id, class_id, copy_of, n_links, n_copies, is_first.

    class_id: the least id of the texts tied together by links (similarity of n-gram sets of
    at least threshold, or equal sets); copy_of: the least id with the same set; n_links: the
    number of other sets linked to this one's; n_copies: rows with the same set, this one
    included; is_first: True for one row of each class. Texts of fewer than n words have all
    their words as their one n-gram; null and wordless texts have none and stand alone.
    Repeated rows are copies; null ids count as least of all only where no other id is there.
    Sets are compared by 48-bit n-gram hashes; pairs that share no band are not seen, which
    bands_for() bounds. Other columns are not read.
    """
    return _joined(docs, threshold, n, id_col, text_col, tile)[0].drop("th").withColumnRenamed("id", id_col)


def _joined(docs: DataFrame, threshold: float, n: int, id_col: str, text_col: str, tile: int) -> tuple[DataFrame, ...]:
    """The joined rows and the tables that they are read from."""
    bands, rows = bands_for(threshold)
    base = written(signatures(docs, n, bands, rows, id_col, text_col), "ngram-signatures")
    some = base.filter("n > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "rid")).alias("f")
    classes = written(some.groupBy("k1", "k2").agg(F.min("rid").alias("rep"), F.count("*").alias("n_copies"), F.min("id").alias("copy_of"), first), "ngram-classes")
    # merge joins: what is joined grows with the input, so the plan shall not turn on its size
    firsts = some.select("rid", "bands").hint("merge").join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    # band hashes are salted by band, so one long is the bucket's key
    banded = firsts.select("rid", F.explode("bands").alias("bucket"))
    mixed = F.xxhash64("rid")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(mixed).alias("x"), F.sum(F.shiftright(mixed, 32)).alias("s")).filter("size > 1")
    # of the buckets with the same classes, the least
    kept = written(buckets.groupBy("size", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "ngram-buckets")
    members = banded.hint("merge").join(kept, "bucket").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("bucket", "size"))).alias("own"))  # at most `bands` of them
    sets = written(members.hint("merge").join(some.select("rid", "grams"), "rid"), "ngram-sets")
    dealt = sets.select("rid", "grams", F.col("own.bucket").alias("own"), F.explode("own").alias("b")).select("rid", "grams", "own", "b.bucket", F.ceil(F.col("b.size") / tile).cast("int").alias("tiles"))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rid"), "tiles").cast("int"))
    # every tile meets every other and itself, once
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    dealt = dealt.select("bucket", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "tile", "rid", "own", "grams")
    dealt = dealt.repartition("bucket", "ti", "tj").sortWithinPartitions("bucket", "ti", "tj", "rid")
    verified = written(_verify(dealt, threshold), "ngram-verified")
    links = verified.groupBy("rid").agg(F.sum("n").alias("n_links"))
    roots = written(components(verified.select(F.col("rid").alias("u"), F.col("root").alias("v")), "ngram-tied"), "ngram-roots")
    tied = links.join(roots.withColumnRenamed("v", "rid"), "rid").select(F.col("rid").alias("rep"), "root", "n_links")
    per_set = written(classes.hint("merge").join(tied, "rep", "left").select("k1", "k2", "n_copies", "copy_of", "f", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "ngram-sets-tied")
    forget(kept, sets, verified, classes, roots)
    # written, so that the join can split a root with very many sets
    of_root = written(per_set.groupBy("root").agg(F.min("copy_of").alias("class_id"), F.min("f").alias("f")), "ngram-of-root")
    tied_sets = per_set
    per_set = per_set.hint("merge").join(of_root.select("root", "class_id", F.col("f.rid").alias("first_rid")), "root").select("k1", "k2", "class_id", "copy_of", "n_links", "n_copies", "first_rid")
    tied_rows = some.select("rid", "id", "th", "k1", "k2").hint("merge").join(per_set, ["k1", "k2"])
    out = tied_rows.select("id", "th", "class_id", "copy_of", "n_links", "n_copies", (F.col("first_rid") == F.col("rid")).alias("is_first"))
    # rows without words share no key: they are not joined at all
    alone = base.filter("n = 0").select("id", "th", F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("is_first"))
    return out.unionAll(alone), base, tied_sets, of_root
