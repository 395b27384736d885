"""Repeated substrings by external induced sorting over sampled suffixes.

Which bytes lie in a string of SIZE bytes that starts at two places is read off a suffix
order with common-prefix values (LCP): a start repeats if and only if a neighbour in the
order shares SIZE bytes with it. The order is built as in induced sorting, but out of
core and for those suffixes only that can share that much:

1. Sample. A suffix is sampled if its first K bytes have the least hash (the first such)
   within some SIZE-byte window. Every window is owned by one sampled suffix inside it,
   and equal windows are owned at equal distances. A sampled suffix is named by its first
   K bytes; with the stretch its windows span it is a tuple of a few numbers.
2. Reduction. Names that occur once own no repeated window. Tuples of equal stretches are
   one class by pre-aggregation, and all windows of a class of several are repeated.
3. Recursion. A name of more than MOST classes is taken apart: its tuples' windows are cut
   at fixed distances from their owners, a quarter as wide at each level, each part has a
   longer name (all that its windows must share), and step 2 is done again. At width 1 the
   name is the window itself, so no name, however frequent, is left to one task.
4. Order. What is left, one tuple of each class under a name of several classes, is sorted
   by name and by what follows: Spark's sorter, which spills to disk, is the queue that
   yields suffix tuples in order, each task a range of names far larger than its memory.
5. Induction. From the ordered sampled suffixes the suffixes that start one byte earlier
   are ordered by that byte, stably, and their LCPs follow from the old ones as minima
   over the tuples between; and so on to the left, until no two share what they passed.

The same tuples are made of words (runs of letters, marks and digits, lower-cased) for
passages of PASSAGE words, beside those of bytes and through the same steps.

One row of each text is joined with the tuples to cut out the stretches for 3 to 5; all
texts are joined with the ranges to take out the bytes.
"""

from __future__ import annotations

import functools
import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import flat
from quillstone.llm.common import forget, light, small_batches, written
from quillstone.llm.flat import mix

SIZE, K = 400, 32
#: Words of a passage, and of the names of its samples.
PASSAGE, PASSAGE_K = 50, 8
#: Classes under one name that one task may order.
MOST = 1024
#: Units laid end to end in one numpy pass, and tuples sorted in one, but for a larger name.
PASS_UNITS, PASS_TUPLES = 1 << 19, 20_000
BYTES, WORDS = 0, 1
_B = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_B, -1, 1 << 64)


@functools.cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240311).integers(1, 1 << 63, 256, np.uint64)


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Hashes:
    """Hashes of any stretch of a buffer of bytes or 64-bit words from one running sum."""

    def __init__(self, buf: np.ndarray):
        n = 1 << max(16, int(len(buf) + 1).bit_length())
        self.inverse = _powers(_INVERSE, n)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((_byte_values()[buf] if buf.dtype == np.uint8 else buf) * _powers(_B, n)[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values, by doubling."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def sample(texts: list, size: int = SIZE, k: int = K) -> tuple[np.ndarray, ...]:
    """Per owned run of windows: (text, first start, runs' number of starts, owner less first start, name, stretch hash).

    texts: bytes, or arrays of 64-bit words. Starts are within the text; texts shorter than
    size have none.
    """
    buf = np.concatenate([np.frombuffer(t, np.uint8) if isinstance(t, bytes) else t for t in texts]) if texts else np.zeros(0, np.uint8)
    begin = np.cumsum([0, *map(len, texts)])
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(buf) < size:
        return none
    h = Hashes(buf)
    names = h.grams(k)
    order = (names >> np.uint64(32) << np.uint64(32)) | np.arange(len(names), dtype=np.uint64)
    owner = (_sliding_min(order, size - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(begin[:-1], begin[1:]) if b - a >= size] or [np.zeros(0, np.int64)])
    if not len(start):
        return none
    own = owner[start]
    first = np.flatnonzero(np.r_[True, (np.diff(start) != 1) | (np.diff(own) != 0)])
    lo, n, a = start[first], np.diff(np.r_[first, len(start)]), own[first]
    # windows with much before their owner, and those with much from it on, have different names
    half = (size - k) // 2
    cut = np.clip(a - half, lo, lo + n)
    lo, n, a = np.r_[lo, cut], np.r_[cut - lo, lo + n - cut], np.r_[a, a]
    before = np.arange(len(lo)) < len(cut)
    lo, n, a, before = lo[n > 0], n[n > 0], a[n > 0], before[n > 0]
    name = mix(h.of(np.where(before, a - half - 1, a), np.where(before, a + k, a + size - half)) + before.astype(np.uint64))
    stretch = mix(h.of(lo, lo + n - 1 + size) ^ mix((n * 1024 + (a - lo)).astype(np.uint64)))
    text = np.searchsorted(begin, lo, "right") - 1
    return text, lo - begin[text], n, a - lo, name, stretch


def _common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


def induce(group: np.ndarray, stretch: list[np.ndarray], at: np.ndarray, starts: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """The repeated starts of each tuple, counted from its first.

    Tuples must be in order of group, then of what follows the sampled place `at` of their
    stretch; starts: how many windows each owns.
    """
    n = len(stretch)
    marks: list[list[int]] = [[] for _ in range(n)]
    after = [s[p:] for s, p in zip(stretch, at.tolist())]
    lcp = np.array([0, *(_common_prefix(after[i - 1], after[i]) if group[i] == group[i - 1] else -1 for i in range(1, n))], np.int64) if n else np.zeros(0, np.int64)
    if n:
        lcp[0] = -1
    longest = max(map(len, stretch), default=0)
    del after
    flat_begin = np.cumsum([0, *map(len, stretch)])[:-1] if n else np.zeros(0, np.int64)
    values, symbols = np.unique(np.concatenate(stretch), return_inverse=True) if n else (flat_begin, flat_begin)
    who = np.arange(n)  # tuples in suffix order
    for back in range(longest + 1):
        # lcp[i]: bytes that suffixes who[i - 1] and who[i], `back` bytes before their samples, share
        beside = np.maximum(lcp, np.r_[lcp[1:], -1]) if len(who) else lcp
        offset = at[who] - back
        repeated = (beside >= size) & (offset >= 0) & (offset < starts[who])
        for i in np.flatnonzero(repeated).tolist():
            marks[who[i]].append(int(offset[i]))
        # those that share no more than they passed with any other never will again; nor those without a byte to the left
        alive = (beside > back) & (offset > 0)
        who, lcp = _keep(who, lcp, alive)
        if not len(who):
            break
        who, lcp = _step(who, lcp, group[who], symbols[flat_begin[who] + at[who] - back - 1], len(values))
    return [np.array(sorted(m), np.int64) for m in marks]


def _keep(who: np.ndarray, lcp: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves tuples out of the order; LCPs over a gap are minima."""
    if alive.all():
        return who, lcp
    at = np.flatnonzero(alive)
    if not len(at):
        return who[:0], lcp[:0]
    # from after one kept tuple up to the next kept one
    out = np.minimum.reduceat(lcp[: at[-1] + 1], np.r_[0, at[:-1] + 1])
    out[0] = -1
    return who[at], out


def _step(who: np.ndarray, lcp: np.ndarray, group: np.ndarray, symbol: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One induction: order by (group, symbol in front, one of n), stably, and the LCPs of the new neighbours."""
    key = group * n + symbol
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.full(len(who), -1, np.int64)
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    # minima of lcp over (left, right] of the old order, from a table of powers of two
    left, right = order[same - 1] + 1, order[same] + 1
    span = right - left
    tables, width = [lcp], 1
    while len(span) and width * 2 <= int(span.max()):
        t = tables[-1]
        tables.append(np.minimum(t[:-width], t[width:]))
        width *= 2
    level = np.floor(np.log2(span)).astype(np.int64) if len(span) else span
    low = np.empty(len(span), np.int64)
    for j in range(len(tables)):
        of = np.flatnonzero(level == j)
        low[of] = np.minimum(tables[j][left[of]], tables[j][right[of] - (1 << j)])
    new[same] = low + 1
    other = np.flatnonzero((key[1:] != key[:-1]) & (key[1:] // n == key[:-1] // n)) + 1
    new[other] = 0
    return who[order], new


def spans_of(starts: list[tuple[int, int]], size: int = SIZE) -> list[tuple[int, int]]:
    """Maximal covered runs of the windows that start in the given [from, to) ranges."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b - 1 + size)
        else:
            out.append([a, b - 1 + size])
    return [(a, b) for a, b in out]


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    if not len(x):
        return []
    first = np.flatnonzero(np.r_[True, np.diff(x) > 1])
    return [(int(x[a]), int(x[b - 1]) + 1) for a, b in zip(first, np.r_[first[1:], len(x)])]


def _passes(sizes: list[int], most: int):
    lo = n = 0
    for i, s in enumerate(sizes):
        if n and n + s > most:
            yield lo, i
            lo, n = i, 0
        n += s
    if lo < len(sizes):
        yield lo, len(sizes)


def units_of(text: bytes, unit: int):
    """The text's bytes, or its words' hashes, some of a long text at a time."""
    if unit == BYTES:
        return text
    t, out, lo = text.decode(), [], 0
    while lo < len(t):
        hi = lo + 250_000
        while hi < len(t) and not t[hi].isspace():
            hi += 1
        out.append(flat.hashes(flat.words_of([t[lo:hi]])))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _segments(texts: list[bytes], unit: int, size: int):
    """(text, offset, units) such that each window of a text is whole in one of them."""
    if unit == WORDS and sum(map(len, texts)) <= PASS_UNITS:
        w = flat.words_of([t.decode() for t in texts])
        h = flat.hashes(w)
        units = [h[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    else:
        units = (units_of(t, unit) for t in texts)
    for d, u in enumerate(units):
        for lo in range(0, max(1, len(u) - size + 1), PASS_UNITS):
            yield d, lo, u[lo : lo + PASS_UNITS + size - 1]


def _sampled(docs: DataFrame, sizes: dict) -> DataFrame:
    """sizes: (size, k) of each unit."""

    def run(batches):
        for batch in light(batches):
            th, nb = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 1))
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lo, hi in _passes(list(map(len, texts)), PASS_UNITS):
                for unit, (size, k) in sizes.items():
                    held = list(_segments(texts[lo:hi], unit, size))
                    of, offset = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
                    for a, b in _passes([len(x[2]) for x in held], PASS_UNITS):
                        part, at, n, rel, name, stretch = sample([x[2] for x in held[a:b]], size, k)
                        row, salt = lo + of[a:b][part], np.uint64(0x2545F4914F6CDD1D * unit)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), unit, np.int8)), pa.array(th[row]), pa.array(nb[row]), pa.array(at + offset[a:b][part]), pa.array(n.astype(np.int32)), pa.array(rel.astype(np.int32)), pa.array((name ^ salt).view(np.int64)), pa.array((stretch ^ salt).view(np.int64))],
                            names=["unit", "th", "nb", "at", "n", "rel", "name", "stretch"],
                        )

    return docs.select("th", "nb", "text").mapInArrow(run, "unit byte, th long, nb long, at long, n int, rel int, name long, stretch long")


def _packed(rows: DataFrame) -> DataFrame:
    """rows: id, th, nb, text; with text as compressed UTF-8 in `packed`, as it is moved twice."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in light(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack(t) for t in batch.column(3).cast(pa.binary()).to_pylist()], pa.binary())], names=["id", "th", "nb", "packed"])

    return rows.select("id", "th", "nb", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, th long, nb long, packed binary")


def _unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


_CUT = "unit byte, name long, th long, nb long, at long, n int, rel int, c long, stretch binary"
_KINDS = dict(unit=pa.int8(), name=pa.int64(), th=pa.int64(), nb=pa.int64(), at=pa.int64(), n=pa.int32(), rel=pa.int32(), c=pa.int64(), stretch=pa.binary(), same=pa.int64())


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    names = names.split()
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for c, n in zip(cols, names)], names=names)


def _stretches(joined: DataFrame, sizes: dict) -> DataFrame:
    """joined: th, nb, packed, needs. Cuts each tuple's stretch out of its text; eight bytes for a word."""

    def run(batches):
        for batch in light(batches):
            for th, nb, packed, needs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                b, out = _unpack(packed), []
                for unit, (size, _) in sizes.items():
                    own = [x for x in needs if x["unit"] == unit]
                    u = units_of(b, unit) if own else b
                    out += [(unit, x["name"], th, nb, x["at"], x["n"], x["rel"], x["c"], bytes(u[x["at"] : x["at"] + x["n"] - 1 + size])) for x in own]
                yield _rows(out, "unit name th nb at n rel c stretch")

    return joined.mapInArrow(run, _CUT)


def _widths(size: int, k: int) -> list[int]:
    """Numbers of windows in a part, level by level, down to 1."""
    out = [1]
    while out[-1] * 8 <= size - k:
        out.append(out[-1] * 4)
    return out[::-1]


def _hash(*parts) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True))
    return int.from_bytes(h.digest(), "little", signed=True)


def parts_of(stretch: bytes, n: int, rel: int, size: int, width: int, per: int = 1):
    """(first window, windows, what all windows of the part share, the part's stretch) by distance from the owner."""
    for block in range((rel - n + 1) // width, rel // width + 1):
        lo, hi = max(0, rel - (block + 1) * width + 1), min(n - 1, rel - block * width)
        shared = stretch[per * (rel - block * width) : per * (rel + size - (block + 1) * width + 1)]
        yield lo, hi - lo + 1, block, shared, stretch[per * lo : per * (hi + size)]


def _taken_apart(tuples: DataFrame, sizes: dict, level: int) -> DataFrame:
    """Tuples of narrower parts and longer names; `same`: equal for equal parts under a name."""

    def run(batches):
        for batch in light(batches):
            out = []
            for unit, _, th, nb, at, n, rel, _, stretch in zip(*(batch.column(i).to_pylist() for i in range(9))):
                size, width = sizes[unit][0], _widths(*sizes[unit])
                width = width[min(level, len(width) - 1)]
                for lo, m, block, shared, part in parts_of(stretch, n, rel, size, width, 8 if unit else 1):
                    out.append((unit, _hash(unit, level, block, shared), th, nb, at + lo, m, rel - lo, part, _hash(unit, level, rel - lo, m, part)))
            yield _rows(out, "unit name th nb at n rel stretch same")

    return tuples.mapInArrow(run, "unit byte, name long, th long, nb long, at long, n int, rel int, stretch binary, same long")


def _named(classes: DataFrame) -> DataFrame:
    """Names that can own a repeated window not known yet, and their number of classes c."""
    return classes.groupBy("name").agg(F.count("*").alias("c"), F.min("m").alias("least")).filter("c > 1 and least = 1").select("name", "c")


_RANGE = ("unit", "th", "nb", "at as begin", "at + n as end")


def _recursion(tuples: DataFrame, sizes: dict, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tuples under names of at most `most` classes each, and ranges found repeated on the way down."""
    cold, ranges = [tuples.filter(F.col("c") <= most)], []
    hot = tuples.filter(F.col("c") > most)
    for level in range(max(len(_widths(*s)) for s in sizes.values())):
        if hot.isEmpty():
            break
        parts = written(_taken_apart(hot, sizes, level), "suffix-parts")
        first = [F.first(c).alias(c) for c in ("unit", "name", "n", "rel", "stretch")]
        classes = written(parts.groupBy("same").agg(F.count("*").alias("m"), F.min(F.struct("th", "nb", "at")).alias("p"), *first), "suffix-part-classes")
        ranges.append(parts.hint("merge").join(classes.filter("m > 1").select("same"), "same", "left_semi").selectExpr(*_RANGE))
        columns = ["unit", "name", "p.th", "p.nb", "p.at", "n", "rel", "c", "stretch"]
        left = written(classes.hint("merge").join(written(_named(classes), "suffix-part-names"), "name").select(columns), "suffix-left")
        cold.append(left.filter(F.col("c") <= most))
        hot = left.filter(F.col("c") > most)
    return cold, ranges


def _ordered(tuples: DataFrame, sizes: dict) -> DataFrame:
    """tuples: sorted by name and following units. Returns unit, th, nb, begin, end: ranges of repeated starts."""

    def flush(held):
        out = []
        for unit, (size, _) in sizes.items():
            rows = [r for r in held if r[0] == unit]
            name = np.array([r[1] for r in rows], np.int64)
            group = np.cumsum(np.r_[0, np.diff(name) != 0]) if len(name) else name
            stretch = [np.frombuffer(r[8], np.uint8 if unit == BYTES else "<u8") for r in rows]
            got = induce(group, stretch, np.array([r[6] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64), size)
            out += [(unit, r[2], r[3], r[4] + a, r[4] + b) for r, g in zip(rows, got) for a, b in _runs(g)]
        cols = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int8()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["unit", "th", "nb", "begin", "end"])

    def run(batches):
        held = []
        for batch in light(batches):
            for r in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if len(held) >= PASS_TUPLES and r[1] != held[-1][1]:
                    yield flush(held)
                    held = []
                held.append(r)
        yield flush(held)

    return tuples.mapInArrow(run, "unit byte, th long, nb long, begin long, end long")


def _taken_out(joined: DataFrame, kind: str, sizes: dict) -> DataFrame:
    def run(batches):
        for batch in light(batches):
            out = []
            for i, packed, ranges in zip(*(batch.column(i).to_pylist() for i in range(3))):
                b, at, h, removed = _unpack(packed), 0, hashlib.sha256(), 0
                spans, passages = (spans_of([(x["begin"], x["end"]) for x in ranges or () if x["unit"] == u], sizes[u][0]) for u in (BYTES, WORDS))
                for lo, hi in spans:
                    h.update(memoryview(b)[at:lo])
                    removed, at = removed + hi - lo, hi
                h.update(memoryview(b)[at:])
                out.append((i, len(b), removed, len(spans), h.hexdigest(), [{"begin": a, "end": z} for a, z in spans], sum(z - a for a, z in passages), len(passages)))
            cols = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), *(pa.array(c, pa.int64()) for c in cols[6:])],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passage_words", "n_passages"],
            )

    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>, n_passage_words long, n_passages long")


def remove_repeats(docs: DataFrame, size: int = SIZE, k: int = K, passage: int = PASSAGE, passage_k: int = PASSAGE_K, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed, in bytes), n_passage_words, n_passages.

    A byte goes if a size-byte string over it also starts elsewhere, in the same or another
    row; overlaps count; all is judged on the input. n_passage_words: words in passages of
    `passage` words that also start elsewhere, n_passages: maximal runs of them; these are
    told, not removed. Null texts count as empty; texts shorter than size keep all; repeated
    rows lose all of a text of at least size bytes; null ids stay; other columns are not
    read. k <= size, passage_k <= passage. most: classes under one name that a task orders.
    """
    small_batches(docs.sparkSession)
    sizes = {BYTES: (size, k), WORDS: (passage, passage_k)}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"th": F.xxhash64("text"), "nb": F.octet_length("text").cast("long")})
    long_rows = rows.filter(F.col("nb") >= min(size, 2 * passage - 1))
    tuples = written(_sampled(long_rows, sizes), "suffix-tuples")
    # the stretch's hash stands for its unit and name as well
    columns = ("unit", "name", "n", "rel")
    classes = written(tuples.groupBy("stretch").agg(F.count("*").alias("m"), F.min(F.struct("th", "nb", "at")).alias("p"), *(F.min(c).alias(c) for c in columns)), "suffix-classes")
    whole = written(tuples.hint("merge").join(classes.filter("m > 1").select("stretch"), "stretch", "left_semi").selectExpr(*_RANGE), "suffix-whole")
    forget(tuples)
    names = written(_named(classes), "suffix-names")
    needs = classes.hint("merge").join(names, "name").groupBy("p.th", "p.nb").agg(F.collect_list(F.struct("unit", "name", "p.at", "n", "rel", "c")).alias("needs"))
    texts = _packed(long_rows).drop("id").groupBy("th", "nb").agg(F.first("packed").alias("packed"))
    cut = written(_stretches(texts.hint("merge").join(needs, ["th", "nb"]).select("th", "nb", "packed", "needs"), sizes), "suffix-cut")
    forget(classes, names)
    cold, found = _recursion(cut, sizes, most)
    in_order = reduce(DataFrame.unionAll, cold).withColumn("after", F.expr("substring(stretch, rel * if(unit = 0, 1, 8) + 1)")).repartition("name").sortWithinPartitions("name", "after").drop("after")
    ranges = reduce(DataFrame.unionAll, [whole, *found, _ordered(in_order, sizes)]).distinct()
    ranges = written(ranges.groupBy("th", "nb").agg(F.collect_list(F.struct("unit", "begin", "end")).alias("ranges")), "suffix-ranges")
    forget(cut, whole)
    joined = _packed(rows).hint("merge").join(ranges, ["th", "nb"], "left").select("id", "packed", "ranges")
    return _taken_out(joined, rows.schema["id"].dataType.simpleString(), sizes).withColumnRenamed("id", id_col)
