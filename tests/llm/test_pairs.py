import collections
import hashlib
import os
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import suffixdedup as S
from quillstone.llm.components import components
from quillstone.llm.decontam import decontaminate, keep_clean, tiles
from quillstone.llm.ngramjoin import bands_for, jaccard_join, keep_first

SCHEMA = "doc_id long, text string, class_id int, ranges string"


def words(text):
    out, now = [], []
    for c in text.lower():
        if unicodedata.category(c)[0] in "LMN":
            now.append(c)
        elif now:
            out.append("".join(now))
            now = []
    return out + ["".join(now)] * bool(now)


def grams(text):
    w = words(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(rows):
    sets = collections.defaultdict(list)
    for i, t in rows:
        sets[grams(t) or (i, t)].append(i)
    reps = [(s, min(v)) for s, v in sets.items() if isinstance(s, frozenset)]
    root, links = {r: r for _, r in reps}, collections.Counter()

    def find(x):
        return x if root[x] == x else find(root[x])

    for k, (s, a) in enumerate(reps):
        for t, b in reps[:k]:
            if len(s & t) >= 0.8 * len(s | t) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = {}
    for s, v in sets.items():
        for i in v:
            out[i] = (find(min(v)), min(v), links[min(v)], len(v)) if isinstance(s, frozenset) else (i, i, 0, 1)
    return out


def corpus(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 160))]
        for _ in range(rnd.randrange(1, 7)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((i, " ".join(copy)))
            i += 1
    return rows + [(i, ""), (i + 1, None), (i + 2, "!!! ..."), (i + 3, "one two"), (i + 4, "One, two."), (i + 5, "x " * 20_000)]


def test_join_against_all_pairs(spark):
    rows = corpus()
    want = brute_join(rows)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    for tile in (256, 3):  # within a task, and over pairs of tiles
        got = {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_links"], r["n_copies"]) for r in jaccard_join(df, tile=tile).collect()}
        assert got == want
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, *_ in want.values()})


def test_join_repeated_rows_null_ids_and_nothing(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text, 1, ""), (4, text, 1, ""), (4, text, 1, ""), (9, text + " eight", 1, ""), (7, None, 1, "")], SCHEMA)
    got = jaccard_join(df).collect()
    assert sum(r["is_first"] for r in got) == 3  # 3 of 4 n-grams are too few
    assert {(r["class_id"], r["n_copies"]) for r in got if r["doc_id"] in (None, 4)} == {(4, 3)}
    assert sorted(str(r["doc_id"]) for r in keep_first(df).collect()) == ["4", "7", "9"]
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_join(empty).count() == 0 and keep_first(empty).count() == 0


def test_bands():
    bands, rows = bands_for(0.8)
    assert bands * rows <= 192 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["v"]: r["root"] for r in got} == root and len(got) == len(root)


def brute_tiles(a, b, least):
    x, y, out = [0] * len(a), [0] * len(b), []
    while True:
        best = None
        for p in range(len(a)):
            for q in range(len(b)):
                n = 0
                while p + n < len(a) and q + n < len(b) and not x[p + n] and not y[q + n] and a[p + n] == b[q + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, p, q)
        if best is None:
            return out
        n, p, q = best
        x[p : p + n] = y[q : q + n] = [1] * n
        out.append((p, q, n))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=16), st.lists(st.integers(0, 3), max_size=20), st.integers(1, 3))
def test_tiles_against_greedy_search(a, b, least):
    assert tiles(a, b, least) == brute_tiles(a, b, least)


def brute_coverage(items, text):
    """Greedy tiles of every item against the whole text."""
    w = words(text or "")
    return {i: sum(n for *_, n in brute_tiles(words(t), w, 5)) / len(words(t)) for i, t in items if i is not None and len(words(t or "")) >= 5}


def test_decontamination(spark):
    rnd = random.Random(8)
    make = lambda n: [f"v{rnd.randrange(500)}" for _ in range(n)]
    a, b = make(30), make(24)
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, None), (4, "too short"), (None, " ".join(make(9)))]
    reordered = make(40) + a[15:] + make(10) + a[:15] + make(5)
    rows = [(10, " ".join(make(50) + a + make(30))), (11, " ".join(reordered)), (12, " ".join(make(60))), (13, " ".join(make(9) + b[:8] + make(9))), (14, None), (15, ""), (16, "X, ".join(b).upper() + " " + " ".join(a)), (16, "dup"), (17, " ".join((a + make(3)) * 40))]
    docs = spark.createDataFrame([(i, t, 1, "") for i, t in rows], "doc_id long, text string, coverage int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs, bench).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        c = brute_coverage(items, t)
        want.append((i, sorted(k for k, v in c.items() if v >= 0.5), max(c.values()), any(v >= 0.5 for v in c.values())))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert [w[3] for w in want[:4]] == [True, True, False, False]
    kept = keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, _, bad in want if not bad)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate(docs, none).collect())
    assert decontaminate(docs.limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    from quillstone.llm import decontam

    monkeypatch.setattr(decontam, "BLOCK_BITS", 3)
    monkeypatch.setattr(decontam, "LEAST_BITS", 5)
    items = [(i, " ".join(f"t{i}x{j}" for j in range(8))) for i in range(6)]
    docs = spark.createDataFrame([(1, items[0][1] + " and " + items[5][1]), (2, "nothing of it"), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_ids"]) for r in decontaminate(docs, bench).collect()) == [(1, [0, 5]), (2, []), (2, [])]
    assert keep_clean(docs, bench).count() == 2


def test_decontamination_of_repetitive_texts(spark):
    """One word over and over, and a short period, in items and texts; and a text that is one very long word."""
    items = [(1, "a " * 12), (2, "a b " * 8), (3, "a b c d e f"), (4, "a b c d e f")]
    rows = [(1, "a " * 300), (2, "b a " * 60), (3, "x a b c y"), (4, "w" * 200_000), (5, "e f a b c d e f a b"), (6, " ".join("ab"[i * i % 7 % 2] for i in range(80)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["coverage"]) for r in decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in rows:
        c = brute_coverage(items, t)
        assert got[i] == (sorted(k for k, v in c.items() if v >= 0.5), max(c.values()))
    assert got[1][0] == [1] and got[5][0] == [3, 4] and got[4] == ([], 0.0)


def test_decontamination_by_an_item_without_id(spark):
    text = " ".join(f"t{j}" for j in range(8))
    docs = spark.createDataFrame([(1, text), (None, text), (3, "nothing of it"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (2, text)], "item_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["coverage"], r["contaminated"]) for r in decontaminate(docs, bench).collect()}
    assert got[1] == got[None] == ([None, 2], 1.0, True) and got[3] == got[4] == ([], 0.0, False)
    assert sorted(r["doc_id"] for r in keep_clean(docs, bench).collect()) == [3, 4]


def brute_repeats(rows, size):
    seen = collections.Counter(t[i : i + size] for t in rows for i in range(len(t) - size + 1))
    out = []
    for t in rows:
        marks = [False] * len(t)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                marks[i : i + size] = [True] * size
        out.append(marks)
    return out


def brute_passages(rows, size):
    """Words in passages of `size` words that start elsewhere too, and runs of them, of each text."""
    ws = [words(t or "") for t in rows]
    seen = collections.Counter(tuple(w[i : i + size]) for w in ws for i in range(len(w) - size + 1))
    out = []
    for w in ws:
        marks = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                marks[i : i + size] = [True] * size
        # passages that touch are one run, as spans of bytes are
        out.append((sum(marks), sum(b and not a for a, b in zip([False, *marks], marks))))
    return out


@pytest.mark.parametrize("most", [1024, 3])
def test_repeats_against_all_windows(spark, most):
    rnd = random.Random(6)
    for alphabet, size, k, passage in (("ab", 12, 4, 3), ("abcdefgh", 20, 6, 2), ("a", 9, 3, 2)):
        base = "".join(rnd.choice(alphabet) for _ in range(300))
        rows = []
        for i in range(40):
            parts = []
            for _ in range(rnd.randrange(0, 6)):
                a = rnd.randrange(300)
                parts.append(base[a : a + rnd.randrange(60)] if rnd.random() < 0.5 else "".join(rnd.choice(alphabet + "éz ") for _ in range(rnd.randrange(40))))
            rows.append((i, "".join(parts)))
        rows += [(90, None), (91, ""), (3, rows[3][1]), (None, rows[4][1])]
        df = spark.createDataFrame([(i, t, 1, "") for i, t in rows], SCHEMA)
        got = S.remove_repeats(df, size, k, passage, 2, most).collect()
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_passage_words"], r["n_passages"]) for r in got)
        texts = [(t or "").encode() for _, t in rows]
        want = []
        for (i, _), t, m, p in zip(rows, texts, brute_repeats(texts, size), brute_passages([t for _, t in rows], passage)):
            runs = sum(b and not a for a, b in zip([False, *m], m))
            want.append((str(i), len(t), sum(m), runs, hashlib.sha256(bytes(c for c, x in zip(t, m) if not x)).hexdigest(), *p))
        assert got == sorted(want)
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [1024, 4])
def test_a_passage_under_one_name(spark, most):
    """A passage that many texts share, each time between other words: one frequent name."""
    rnd = random.Random(11)
    make = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    common, short = make(90), make(52)
    rows = [(i, f"{make(rnd.randrange(30))} {common if i % 3 else short} {make(rnd.randrange(30))}") for i in range(60)]
    got = {r["doc_id"]: r for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()}
    texts = [t.encode() for _, t in rows]
    for i, m, p in zip(range(60), brute_repeats(texts, 400), brute_passages([t for _, t in rows], 50)):
        assert (got[i]["n_removed"], got[i]["n_passage_words"], got[i]["n_passages"]) == (sum(m), *p)
        assert got[i]["n_removed"] == 0 or i % 3
        assert p[0] >= 50  # the shorter passage too


def test_parts_cover_every_window_once():
    for size, k, rel, n in ((12, 4, 7, 8), (12, 4, 5, 2), (400, 32, 300, 250), (9, 9, 0, 1)):
        stretch = bytes(range(256)) * 3
        for width in S._widths(size, k):
            got = list(S.parts_of(stretch[: n - 1 + size], n, rel, size, width))
            assert sorted(j for lo, m, *_ in got for j in range(lo, lo + m)) == list(range(n))
            for lo, m, _, shared, part in got:
                assert len(part) == m - 1 + size and all(shared in part[j : j + size] for j in range(m)) and len(shared) == size - width + 1
        assert S._widths(size, k)[-1] == 1


def test_repeats_of_a_table(spark):
    """All of sf0.1, against a count of every 400-byte window by other hashes."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    df = spark.read.parquet(path)
    rows = df.select("doc_id", "text").collect()
    base = np.uint64(6364136223846793005)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    value = np.random.default_rng(99).integers(1, 1 << 63, 256, np.uint64)
    texts = [(r["text"] or "").encode() for r in rows]
    all_hashes = []
    for t in texts:
        x = value[np.frombuffer(t, np.uint8)]
        powers = np.cumprod(np.full(len(x) + 1, base, np.uint64))[: len(x)] * inverse
        sums = np.r_[np.uint64(0), np.cumsum(x * powers)]
        back = np.cumprod(np.full(len(x) + 1, inverse, np.uint64)) * base
        all_hashes.append((sums[400:] - sums[:-400]) * back[: max(0, len(x) - 399)] if len(x) >= 400 else np.zeros(0, np.uint64))
    flat = np.concatenate(all_hashes)
    order = np.sort(flat)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    want = {}
    for r, t, h in zip(rows, texts, all_hashes):
        marks = np.zeros(len(t) + 1, np.int64)
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        starts = np.flatnonzero(twice[at] == h)
        marks[starts] += 1
        marks[starts + 400] -= 1
        inside = np.cumsum(marks)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~inside].tobytes()
        want[r["doc_id"]] = (len(t), int(inside.sum()), int(np.count_nonzero(np.diff(np.r_[False, inside].astype(np.int8)) == 1)), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(df).collect()}
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", max_size=40).map(str.encode), max_size=6), st.sampled_from([(6, 2), (8, 3), (5, 5)]))
def test_every_window_has_one_owner(texts, sizes):
    size, k = sizes
    text, at, n, rel, name, stretch = S.sample(texts, size, k)
    windows = sorted((int(t), int(a) + j) for t, a, m in zip(text, at, n) for j in range(m))
    assert windows == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - size + 1)]
    by_window = collections.defaultdict(set)
    for t, a, m, r, x in zip(text, at, n, rel, name):
        for j in range(m):
            s = texts[t][a + j : a + j + size]
            by_window[s].add((int(r) - j, x))
            assert 0 <= r - j <= size - k
    assert all(len(v) == 1 for v in by_window.values())
    assert len(np.unique(stretch)) == len({(texts[t][a : a + m - 1 + size], int(r)) for t, a, m, r in zip(text, at, n, rel)})
