import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstone.llm import tokenfiles
from quillstone.llm.bpe import PieceEncoder
from quillstone.llm.packing import best_fit, crossover, evolve, fitness, pack
from quillstone.llm.tokencount import CountTransducer, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER, MACHINE = PieceEncoder(PATH), CountTransducer(PATH, 500)
PARTS = ["a", "the", "Straße", " ", "  ", "\n", "\t", "'s", "'", ".", "!", "1", "23", "é", "中文", "\u00a0", "<|endoftext|>", "<|end", "\x1c", "\x85", "😀", "\u200b"]
texts = st.lists(st.sampled_from(PARTS), max_size=25).map("".join)
ROWS = [(1, "The cat sat. " * 400, 7), (2, None, 7), (3, "", 7), (None, "no id", 7), (5, "the cat  sat\n\n<|endoftext|> x ", 7), (5, "the cat  sat\n\n<|endoftext|> x ", 7), (4, "w" * 5000, 7)]
SCHEMA = "doc_id long, text string, n_tokens int"


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(texts)
def test_pieces_give_the_librarys_ids(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", ["w" * 300_000, " " * 300_000 + "x", "\n" * 100_000 + " y", "a b " * 100_000, "1" * 100_000, "é" * 100_000])
def test_long_runs(text, monkeypatch):
    from quillstone.llm import bpe

    monkeypatch.setattr(bpe, "PASS", 1000)
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(1, 9))
def test_state_maps_compose_to_the_librarys_count(text, chunk):
    assert MACHINE.count(text, chunk) == len(ids(text))


SMALL = CountTransducer(PATH, 5, 40)  # tables that are full at once


@settings(max_examples=400, deadline=None)
@given(st.one_of(texts, st.text("aehnorstÄé中ー한0123 -'", max_size=30), st.text(max_size=20)), st.integers(1, 9))
def test_the_machine_gives_the_librarys_count(text, chunk):
    assert SMALL.count(text, chunk) == len(ids(text))


def test_the_machine_reads_bytes():
    """Each arc is compiled once, and the weights of a path add up to the count of each beginning."""
    machine = CountTransducer(PATH).machine
    for word in (b" internationalisation", b" aaaaaaaaaaaaaaaaaaaaaaa", "Stra\u00dfe".encode(), b"zqxjkvb" * 3, b"1234567"):
        for k in range(1, len(word) + 1):
            assert machine.read(word[:k]) == len(machine.one(word[:k]))
        before = machine.compiled
        machine.read(word)
        assert machine.compiled == before
    assert len(machine.states) < machine.most and len(SMALL.machine.states) <= 40


@settings(max_examples=200, deadline=None)
@given(texts, texts, texts)
def test_state_maps_are_a_monoid(a, b, c):
    m, f = MACHINE.map_of, MACHINE.compose
    left, right = f(f(m(a), m(b)), m(c)), f(m(a), f(m(b), m(c)))
    assert left == right and MACHINE.total(left) == len(ids(a + b + c))
    assert [MACHINE.total(p) for p in MACHINE.prefixes([m(a), m(b), m(c)])] == [len(ids(x)) for x in (a, a + b, a + b + c)]


def test_counts(spark):
    got = sorted((tuple(r) for r in count_tokens(spark.createDataFrame(ROWS, SCHEMA), PATH, limit=100).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 100) for i, t, _ in ROWS), key=repr)
    assert count_tokens(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    got = sorted((tuple(r) for r in count_tokens(spark.createDataFrame(ROWS, SCHEMA), PATH, limit=100, chunk=7).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 100) for i, t, _ in ROWS), key=repr)
    model = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {r["n_tokens"] for r in count_tokens(spark.createDataFrame([(1, "hello there")], "doc_id long, text string"), model).collect()} == {len(lib.encode("hello there"))}
    words = public_tokenizers.path("word_bpe_49k.json")
    assert count_tokens(spark.createDataFrame([(1, "hello there")], "doc_id long, text string"), words).first()["n_tokens"] == len(Tokenizer.from_file(words).encode("hello there", add_special_tokens=False).ids)


@pytest.mark.parametrize("planes", [4, 32])
@settings(max_examples=40, deadline=None)
@given(values=st.lists(st.integers(0, (1 << 32) - 1), max_size=60), a=st.integers(0, 60), b=st.integers(0, 60))
def test_segments_round_trip(planes, values, a, b):
    x = np.array(values, "<u4")
    data = tokenfiles.encode_segment(x, planes, block_ids=16)
    assert tokenfiles.decode_segment(data).tolist() == values
    assert tokenfiles.decode_segment(data, a, b).tolist() == values[a:b]
    assert tokenfiles.chunk_index(data)[2][:, 0].sum() == len(values)


def test_segments_reject_other_data():
    with pytest.raises(ValueError):
        tokenfiles.chunk_index(b"x" * 40)
    with pytest.raises(ValueError):
        tokenfiles.encode_segment(np.zeros(1, "<u4"), planes=3)


def test_token_files(spark):
    got = tokenfiles.token_files(spark.createDataFrame(ROWS, SCHEMA), PATH, shards=3).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, t, _) in zip(got, order):
        own = np.array([*ids(t), 2], "<u4")
        assert tuple(r) == (i, at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert len(got) == len(ROWS)
    assert tokenfiles.token_files(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def check_packing(rows, docs, capacity):
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["start"] == 0 and 0), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    want = []
    for i, t, _ in docs:
        x = np.array([*ids(t), 0], "<u4")
        first = (len(x) - 1) % capacity + 1
        for k, lo in enumerate([0, *range(first, len(x), capacity)]):
            hi = first if k == 0 else lo + capacity
            want.append((i, k, lo, hi - lo, zlib.crc32(x[lo:hi].tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    return len(sequences)


def test_pack(spark):
    docs = ROWS + [(i, "word " * (i % 37), 7) for i in range(10, 200)]
    rows = pack(spark.createDataFrame(docs, SCHEMA), PATH, capacity=64).collect()
    n = check_packing(rows, docs, 64)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 64 + 1
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_crossover_keeps_every_item_once():
    import random

    rnd, sizes = random.Random(1), np.random.default_rng(2).integers(1, 100, 300)
    size_list = sizes.tolist()
    a, b = (best_fit(np.empty(300, np.int64), rnd.sample(range(300), 300), size_list, [], 100) for _ in range(2))
    for _ in range(20):
        child = crossover(a, b, sizes, size_list, 100, rnd)
        load = np.bincount(child, weights=sizes)
        assert len(child) == 300 and load.max() <= 100 and load.min() > 0
        a, b = b, child
    best = evolve(sizes, [], 3, 100)
    assert fitness(best, sizes, 100) >= fitness(best_fit(np.empty(300, np.int64), np.argsort(-sizes, kind="stable").tolist(), size_list, [], 100), sizes, 100)


def test_the_search_beats_best_fit():
    """Triples that fill a sequence exactly, and sizes between a seventh and a half of it."""
    rng = np.random.default_rng(5)
    a = rng.integers(380, 490, 60)
    b = np.array([rng.integers(250, (1000 - x) // 2 + 1) for x in a])
    for sizes, capacity, at_least in ((np.concatenate([a, b, 1000 - a - b]), 1000, 3), (rng.integers(300, 1100, 2000), 2048, 2)):
        n = len(sizes)
        best_fit_alone = best_fit(np.empty(n, np.int64), np.argsort(-sizes, kind="stable").tolist(), sizes.tolist(), [], capacity).max() + 1
        found = evolve(sizes, [], 7, capacity)
        assert np.bincount(found, weights=sizes).max() <= capacity and len(found) == n
        assert found.max() + 1 <= best_fit_alone - at_least
