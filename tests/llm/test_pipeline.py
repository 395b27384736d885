import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from quillstone.llm import common
from quillstone.llm.common import written
from quillstone.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(1)
    voc = {"en": [f"the{i}" for i in range(300)], "de": [f"und{i}" for i in range(300)]}
    make = lambda lang, n: [rnd.choice(voc[lang]) for _ in range(n)]
    rows = [(i, " ".join(make(lang := ("en", "de")[i % 2], 60)), lang) for i in range(40)]
    item = make("en", 30)
    base = make("en", 120)
    rows += [(100, " ".join(base), "en"), (101, " ".join([*base[:50], "changed", *base[51:]]), "en"), (102, " ".join(base), "en")]
    rows += [(110, " ".join(make("en", 20) + item[15:] + make("en", 8) + item[:15]), "en"), (120, "mail me@mail.example.com " + " ".join(make("en", 20)), "en"), (130, None, "en"), (131, "12345", "de"), (132, "", None)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, {i: t for i, t, _ in rows}


def test_stages_against_what_was_planted(spark, folder):
    at, texts = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, at), name)
        assert docs.columns == columns
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = set(range(40)) | {100, 120}
    assert ids == [set(texts) - {130, 131, 132}, clean | {110}, clean, clean]
    after = {r["doc_id"]: r for r in docs.collect()}
    for i in clean - {120}:
        assert after[i]["text"] == texts[i]
    assert after[120]["text"].startswith("mail [EMAIL] the") and after[120]["n_chars"] == len(after[120]["text"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in pieces) == sum(len(tok.encode(r["text"]).ids) + 1 for r in after.values())
    before = common.tables_so_far()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, at).select("doc_id").collect()} == clean
    assert common.tables_so_far() == before + 1  # the result alone is left


def masked(text):
    """Base spans and secrets as [KIND], of texts whose spans do not overlap."""
    from test_texts import base_spans

    spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base_spans(text).split(",") if x)]
    spans += [(m.start(1), m.end(1), "secret") for m in re.finditer(r'token = "([A-Za-z0-9+/_-]{16,})"', text)]
    for a, b, kind in sorted(spans, reverse=True):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def test_each_stage_against_brute_force(spark, tmp_path):
    from test_pairs import brute_coverage, brute_join
    from test_tokens import check_packing

    rnd = random.Random(12)
    voc = [f"the{i}" for i in range(150)]
    make = lambda n: [rnd.choice(voc) for _ in range(n)]
    items = [(k, " ".join(make(rnd.randrange(8, 30)))) for k in range(6)]
    private = ["a.b@mail.example.com", "10.20.30.40", "4111 1111 1111 1111", "+1 (555) 010-9999", 'token = "0123456789abcdef0123"']
    rows, i = [], 0
    for _ in range(30):
        base = make(rnd.randrange(5, 120))
        for _ in range(rnd.randrange(1, 5)):
            ws = list(base)
            for _ in range(rnd.randrange(0, 5)):
                ws[rnd.randrange(len(ws))] = rnd.choice(voc)
            if rnd.random() < 0.2:
                ws += ["and", rnd.choice(private), "so"]
            if rnd.random() < 0.2:
                own = rnd.choice(items)[1].split()
                cut = rnd.randrange(len(own))
                ws = own[cut:] + ws + own[:cut]
            rows.append((i, " ".join(ws)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "123 !!"), (i + 3, "\u0301 1"), (i + 4, "ありがとう ございます"), (i + 5, rows[3][1])]
    at = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    want = {k: t for k, t in rows if t is not None and any("a" <= c <= "z" for c in t)}
    got = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, at), name)
        got.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert got[0] == want
    least = {c for c, *_ in brute_join(list(want.items())).values()}
    want = {k: t for k, t in want.items() if k in least}
    assert got[1] == want
    want = {k: t for k, t in want.items() if max(brute_coverage(items, t).values()) < 0.5}
    assert got[2] == want and len(got[2]) < len(got[1])
    want = {k: masked(t) for k, t in want.items()}
    assert got[3] == want and got[3] != got[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    check_packing(pieces, [(k, t, None) for k, t in want.items()], 2048)


def test_stages_take_empty_tables(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).count() == 0


def test_a_cluster_has_to_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace

    made = {}
    conf = SimpleNamespace(get=lambda k, d=None: made.get(k, d), set=made.__setitem__)
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://host:7077"):
        with pytest.raises(ValueError):
            common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    assert not made
    assert common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))) == made["spark.checkpoint.dir"]


def test_registry():
    assert {re.match(r"op(\d+)_", q)[1] for q in QUERIES} == {str(n) for n in range(1, 11)} and len(QUERIES) == 10
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
