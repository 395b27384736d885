"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is read as words (runs of letters, marks and digits, lower-cased, cut at eight
characters). Of the K-word windows those are kept whose smallest inner S-word hash
stands at either edge. Whether a window is kept depends on its own words alone, so an
unchanged passage keeps its anchors wherever it stands. A fingerprint holds anchors with
their places: all of them, at any length (level 0). Thinned fingerprints, for callers that
can do with less, hold of longer texts the half or the quarter whose hashes end in one or
two zero bits (level 1 or 2). Two fingerprints are compared by positional matching: anchors
with equal hashes match, and a match counts if another one has the same shift of places,
as those in a common passage have.
"""

from __future__ import annotations

import json
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import partitions

K, S = 5, 2
#: Thinned fingerprints keep all anchors up to so many, up to so many half of them, then a quarter.
ALL, HALF = 256, 1024
#: Ranges of ids at most; each holds any number of rows, which Spark sorts with spilling.
MOST_RANGES = 10_000
WORD = r"[\p{L}\p{M}\p{N}]{1,8}"


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: the kept windows as array<struct<at, hash>>, at: the window's first word.

    Texts of so few words that no window is kept give their single words, texts without
    any word one anchor of the whole text. text must not be null.
    """
    w, h = f"_w_{out}", f"_h_{out}"
    least = f"least({', '.join(f'{h}[i + {j}]' for j in range(K - S + 1))})"
    windows = f"filter(if(size({w}) >= {K}, sequence(0, size({w}) - {K}), cast(array() as array<int>)), i -> {least} in ({h}[i], {h}[i + {K - S}]))"
    df = df.withColumn(w, F.expr(f"regexp_extract_all(lower({text}), r'{WORD}', 0)"))
    df = df.withColumn(h, F.expr(f"zip_with({w}, slice({w}, {S}, size({w})), (a, b) -> xxhash64(a, b))"))
    df = df.withColumn(out, F.expr(f"transform({windows}, i -> struct(i as at, xxhash64({h}[i], {h}[i + 2], {h}[i + 3]) as hash))"))
    few = f"if(size({w}) > 0, transform({w}, (x, i) -> struct(i as at, xxhash64(x) as hash)), array(struct(0 as at, xxhash64({text}) as hash)))"
    return df.withColumn(out, F.expr(f"if(size({out}) > 0, {out}, {few})")).drop(w, h)


def with_fingerprint(df: DataFrame, text: str, out: str, thinned: bool) -> DataFrame:
    """Adds `out`: struct<level, anchors>; anchors: array of longs, hash (30 bits) << 33 | place, ascending.

    Of anchors with equal hashes the first is kept. Thinned ones change with the number of
    anchors, and repetitive texts may be left without any, so that different texts look equal.
    """
    a, s, v = f"_a_{out}", f"_s_{out}", f"_v_{out}"
    df = with_anchors(df, text, a)
    df = df.withColumn(s, F.expr(f"case when size({a}) <= {ALL} then 0 when size({a}) <= {HALF} then 1 else 2 end" if thinned else "0"))
    code = "shiftleft(shiftrightunsigned(x.hash, 34), 33) + x.at"
    df = df.withColumn(v, F.expr(f"array_sort(transform(filter({a}, x -> shiftrightunsigned(x.hash, 34) % shiftleft(1L, {s}) = 0), x -> {code}))"))
    first = f"filter({v}, (x, i) -> i = 0 or shiftright(x, 33) != shiftright(get({v}, i - 1), 33))"
    return df.withColumn(out, F.struct(F.col(s).alias("level"), F.expr(first).alias("anchors"))).drop(a, s, v)


def as_text(f: str) -> Column:
    """Level, then each anchor's hash in eight and its place in as many hexadecimal digits as it takes."""
    return F.expr(f"concat_ws(' ', cast({f}.level as string), array_join(transform({f}.anchors, x -> concat(lpad(lower(hex(shiftright(x, 33))), 8, '0'), lower(hex(x & 2147483647)))), ' '))")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds `out`: matches of two fingerprints that count, over the anchors of either; 0 to 1.

    Anchors are taken at the greater level of the two. A match counts if at least one other
    has its shift, or where either has one anchor alone. Both lists are merged by sorting, so
    that the time is that of a sort at any length.
    """
    x, y, m, d, n = (f"_{k}_{out}" for k in "xymdn")
    at_level = lambda f: f"filter({f}.anchors, v -> shiftright(v, 33) % shiftleft(1L, greatest({a}.level, {b}.level)) = 0)"
    df = df.withColumns({x: F.expr(at_level(a)), y: F.expr(at_level(b))})
    # bit 32 tells the sides apart: where it goes from 0 to 1 under one hash, both have it
    df = df.withColumn(m, F.expr(f"array_sort(concat({x}, transform({y}, v -> v + 4294967296)))"))
    # the place in b follows in the merged list; it is looked up by index
    shifts = f"array_sort(filter(transform({m}, (v, i) -> if(shiftright(v, 32) % 2 = 0 and shiftright(v, 32) + 1 = shiftright(get({m}, i + 1), 32), (v & 2147483647) - (get({m}, i + 1) & 2147483647), null)), v -> v is not null))"
    df = df.withColumn(d, F.expr(shifts))
    counted = f"if(least(size({x}), size({y})) = 1, size({d}), size(filter({d}, (v, i) -> v <=> get({d}, i - 1) or v <=> get({d}, i + 1))))"
    df = df.withColumn(n, F.expr(counted))
    # two fingerprints without an anchor at this level are alike if nothing tells them apart
    return df.withColumn(out, F.expr(f"if(size({x}) + size({y}) = 0, if({a} = {b}, 1D, 0D), {n} / cast(size({x}) + size({y}) - {n} as double))")).drop(x, y, m, d, n)


def matching_positions(a: str, b: str) -> Column:
    """Pairs of places (in a, in b) of equal anchors, for columns made by with_anchors."""
    return F.expr(f"flatten(transform({a}, x -> transform(filter({b}, y -> y.hash = x.hash), y -> struct(x.at as at_a, y.at as at_b))))")


def ranges(ids: DataFrame, col: str, parts: int) -> tuple[Column, DataFrame]:
    """Splits an integer column into about `parts` ranges of like size.

    Returns the range's number as an expression and a table (span, first) of each range's
    smallest value; every range holds a row, null is in range 0. The cuts, at most
    MOST_RANGES, stand in the plan as one constant; a value is placed in two steps of about
    sqrt(parts) comparisons.
    """
    spark = ids.sparkSession
    share = [i / parts for i in range(1, parts)] or [0.5]
    least, cuts = ids.agg(F.min(col), F.percentile_approx(col, share, 20 * parts)).first()
    firsts = [least, *sorted({c for c in cuts or [] if c > least})]
    table = spark.createDataFrame(list(enumerate(firsts)), "span int, first long")
    cuts = firsts[1:]
    if not cuts:
        return F.lit(0), table
    step = isqrt(len(cuts) - 1) + 1
    runs = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads, body = F.from_json(F.lit(json.dumps([r[0] for r in runs])), "array<bigint>"), F.from_json(F.lit(json.dumps(runs)), "array<array<bigint>>")
    run = F.size(F.filter(heads, lambda c: c <= F.col(col)))
    inside = F.size(F.filter(F.get(body, run - 1), lambda c: c <= F.col(col)))
    return F.when(F.col(col).isNull() | (F.col(col) < cuts[0]), 0).otherwise((run - 1) * step + inside), table


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thinned: bool = True) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many (or
    all) of the next text by ascending id; the last one's next is the first. Returns id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts count as empty; null ids come first; rows of one id are ordered by text;
    a lone row is its own next; other columns are not read. ids are integers. With
    thinned=False every anchor of every text is kept and compared.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.count()
    span, firsts = ranges(rows, "id", max(4 * partitions(spark), min(ceil(n / 5000), MOST_RANGES)))
    n_spans = firsts.count()
    # texts alone cross the shuffle; fingerprints are made behind it
    own = with_fingerprint(rows.withColumn("span", span).repartition("span"), "text", "print", thinned)
    by = Window.partitionBy("span").orderBy(F.col("id").asc_nulls_first(), "text")
    led = own.withColumn("next", F.lead(F.struct("text", "print")).over(by))
    # the first row of each range, at most MOST_RANGES of them: nulls, or those of its smallest id
    heads = rows.join(F.broadcast(firsts), F.col("id") == F.col("first")).select("span", "id", "text")
    heads = heads.unionAll(rows.filter("id is null").select(F.lit(0).alias("span"), "id", "text"))
    heads = heads.groupBy("span").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "text")).alias("f")).select("span", F.col("f.text").alias("text"))
    heads = with_fingerprint(heads, "text", "print", thinned).select(F.pmod(F.col("span") - 1, F.lit(n_spans)).alias("of"), F.struct("text", "print").alias("after"))
    out = led.join(heads, (led["span"] == heads["of"]) & led["next"].isNull(), "left").select("id", "text", "print", F.coalesce("next", "after").alias("next"))
    out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    out = out.select("id", "n_chars", "print", F.col("next.print").alias("next_print"), F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next.text, cast(n_chars div 2 as int)))").alias("edited"))
    out = with_fingerprint(out, "edited", "edited_print", thinned)
    out = with_likeness(with_likeness(out, "print", "edited_print", "near_edited"), "print", "next_print", "near_next")
    return out.select(F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("print").alias("fingerprint"), as_text("edited_print").alias("edited_fingerprint"), "near_edited", "near_next")
