"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers

from quillstone.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_best_fit_packing(spark, sf_dir):
    from quillstone.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_token_counts(spark, sf_dir):
    from quillstone.llm.tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_token_files(spark, sf_dir):
    from quillstone.llm.tokenfiles import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_token_counts, op6_token_files)}
ORACLE_SQL: dict[str, str] = {}


def op3_fingerprints(spark, sf_dir):
    from quillstone.llm.fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"), thinned=False)


def op8_pii(spark, sf_dir):
    from quillstone.llm.pii import find

    return find(table(spark, sf_dir, "documents"), everywhere=True).drop("all_spans")


QUERIES |= {f.__name__: f for f in (op3_fingerprints, op8_pii)}


def op10_language_id(spark, sf_dir):
    from quillstone.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


QUERIES[op10_language_id.__name__] = op10_language_id


def op7_ngram_jaccard_join(spark, sf_dir):
    from quillstone.llm.ngramjoin import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES[op7_ngram_jaccard_join.__name__] = op7_ngram_jaccard_join


def op5_decontamination(spark, sf_dir):
    from quillstone.llm.decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filters(spark, sf_dir):
    from quillstone.llm.urlfilter import judge

    return judge(table(spark, sf_dir, "pages"))


QUERIES |= {f.__name__: f for f in (op5_decontamination, op9_url_filters)}


def op4_suffix_array_dedup(spark, sf_dir):
    from quillstone.llm.suffixdedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


QUERIES[op4_suffix_array_dedup.__name__] = op4_suffix_array_dedup

ORACLE_SQL[op7_ngram_jaccard_join.__name__] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS ws FROM documents),
s AS (
    SELECT doc_id,
        CASE WHEN len(ws) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))))
             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g
    FROM w
),
c AS (SELECT g, min(doc_id) AS rep, count(*) AS n_copies FROM s WHERE len(g) > 0 GROUP BY g),
e AS (SELECT rep, unnest(g) AS x, len(g) AS n FROM c),
p AS (
    SELECT a.rep AS a, b.rep AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.rep <> b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
),
reach AS (SELECT rep AS v, rep AS u FROM c UNION SELECT reach.v, p.b FROM reach JOIN p ON reach.u = p.a),
k AS (SELECT v, min(u) AS root FROM reach GROUP BY v),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT s.doc_id, coalesce(k.root, s.doc_id) AS class_id, coalesce(c.rep, s.doc_id) AS copy_of,
    coalesce(l.n, 0) AS n_links, coalesce(c.n_copies, 1) AS n_copies, s.doc_id = coalesce(k.root, s.doc_id) AS is_first
FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN k ON k.v = c.rep LEFT JOIN l ON l.a = c.rep
"""


def _islands(windows: str, size: int) -> str:
    """Maximal covered runs [a, z) of the windows (r, i, x) of which another has the same x, numbered by k in each r."""
    return f"""(SELECT r, k, min(i) AS a, max(i) + {size} AS z FROM (
        SELECT r, i, sum(CASE WHEN i <= p + {size} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM (
            SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM {windows} SEMI JOIN (SELECT x FROM {windows} GROUP BY x HAVING count(*) > 1) USING (x)))
    GROUP BY r, k)"""


ORACLE_SQL[op4_suffix_array_dedup.__name__] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT r, i, hash(b[i:i + 399]) AS x FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
v AS MATERIALIZED (SELECT r, i, hash(ws[i:i + 49]) AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
s AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, CAST(sum(z - a) AS BIGINT) AS n, count(*) AS k FROM {_islands("w", 400)} GROUP BY r),
p AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS n, count(*) AS k FROM {_islands("v", 50)} GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(s.n, 0) AS n_removed, coalesce(s.k, 0) AS n_spans,
    CASE WHEN s.r IS NULL THEN sha256(b) ELSE sha256(unhex(array_to_string(list_transform(range(0, s.k + 1), lambda j: hex(b[CASE WHEN j = 0 THEN 1 ELSE s.z[j] END:CASE WHEN j = s.k THEN octet_length(b) ELSE s.a[j + 1] - 1 END])), ''))) END AS kept_sha256,
    coalesce(p.n, 0) AS n_passage_words, coalesce(p.k, 0) AS n_passages
FROM d LEFT JOIN s ON s.r = d.r LEFT JOIN p ON p.r = d.r
"""
