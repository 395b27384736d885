"""URL filters: exact rules first, gradient-boosted trees on lexical features for the rest.

Lengths, depth, counts, ratios and the statistics of host suffixes and first path sections
are columns that Spark computes; the statistics are counted over all distinct labelled
urls and joined to the rows. Entropies and trees run in numpy, a batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import light, small_batches

#: (verdict, host, path) of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The weight of the base rate in a suffix's or section's own rate, in urls.
PRIOR = 5
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "parameters", "query_length", "longest_word", "has_fragment", "has_extension", "suffix_rate", "suffix_share", "section_rate", "section_share", "entropy", "host_entropy")


def parts(df: DataFrame, url_col: str) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty for null urls and those without ://."""
    rest = F.expr(f"if(locate('://', {url_col}) > 0, substring({url_col}, locate('://', {url_col}) + 3), '')")
    df = df.withColumn("rest", F.coalesce(rest, F.lit("")))
    raw = F.regexp_extract("rest", r"(?s)^[^/?#]*+", 0)
    df = df.withColumn("host", F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return df.withColumn("path", F.regexp_extract("rest", r"(?s)^[^/?#]*+([^?#]*+)", 1)).drop("rest")


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (the longest that fits host and path, or null) and rule_verdict."""
    rule = verdict = F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


_LEXICAL = {
    "length": "length(url)",
    "host_length": "length(host)",
    "path_length": "length(path)",
    "depth": "length(path) - length(replace(path, '/', ''))",
    "labels": "length(host) - length(replace(host, '.', '')) + 1",
    "digit_ratio": "length(regexp_replace(url, '[^0-9]', '')) / greatest(1, length(url))",
    "host_digit_ratio": "length(regexp_replace(host, '[^0-9]', '')) / greatest(1, length(host))",
    "hyphens": "length(url) - length(replace(url, '-', ''))",
    "parameters": "length(query) - length(replace(query, '=', ''))",
    "query_length": "length(query)",
    "longest_word": r"coalesce(array_max(transform(split(url, '[^\\p{L}\\p{N}_]+'), w -> length(w))), 0)",
    "has_fragment": "if(locate('#', url) > 0, 1, 0)",
    "has_extension": r"if(path rlike r'\.\w{2,5}$', 1, 0)",
}


def lexical(df: DataFrame) -> DataFrame:
    """df: url (null as empty), host, path. Adds the features that need no statistics, suffix and section."""
    query = r"regexp_extract(url, r'(?s)^[^?]*+\?([^#]*+)', 1)"
    df = df.withColumn("query", F.expr(query))
    df = df.withColumns({f: F.expr(e).cast("double") for f, e in _LEXICAL.items()}).drop("query")
    section = "if(length(path) - length(replace(path, '/', '')) > 1, split(path, '/')[1], '')"
    return df.withColumns({"suffix": F.substring_index("host", ".", -2), "section": F.expr(section)})


@dataclass
class Statistics:
    """Of distinct labelled urls: their number, the share blocked, and tables of key, n, blocked of suffixes and sections."""

    total: int
    base: float
    tables: dict[str, DataFrame]

    def joined(self, df: DataFrame, own: str | None = None) -> DataFrame:
        """Adds rate and share of each row's suffix and section. own: the row's label, which is taken out of its own statistics."""
        for key, table in self.tables.items():
            df = df.join(table.withColumnsRenamed({"n": "k_n", "blocked": "k_blocked"}), key, "left").withColumns({"k_n": F.coalesce("k_n", F.lit(0)), "k_blocked": F.coalesce("k_blocked", F.lit(0))})
            if own is not None:
                df = df.withColumns({"k_n": F.col("k_n") - 1, "k_blocked": F.col("k_blocked") - F.col(own).cast("int")})
            rate = (F.col("k_blocked") + PRIOR * self.base) / (F.col("k_n") + PRIOR)
            df = df.withColumns({f"{key}_rate": rate.cast("double"), f"{key}_share": (F.col("k_n") / max(1, self.total)).cast("double")}).drop("k_n", "k_blocked")
        return df


def statistics(labelled: DataFrame) -> Statistics:
    """labelled: distinct, with suffix, section, blocked. Counts all of them."""
    total, base = labelled.agg(F.count("*"), F.avg(F.col("blocked").cast("int"))).first()
    counted = lambda key: labelled.groupBy(key).agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked"))
    return Statistics(total, base or 0.0, {key: counted(key) for key in ("suffix", "section")})


def entropies(texts: list[str]) -> np.ndarray:
    """Bits per character of each text; 0 for an empty one."""
    n = np.array([len(t) for t in texts])
    if not n.sum():
        return np.zeros(len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    key, count = np.unique(np.repeat(np.arange(len(texts)), n) << 21 | points, return_counts=True)
    of = key >> 21
    share = count / n[of]
    return np.bincount(of, -share * np.log2(share), len(texts))


def vectors(columns: list[np.ndarray], urls: list[str], hosts: list[str]) -> np.ndarray:
    """Rows of FEATURES; columns: all but the entropies."""
    return np.stack([*columns, entropies(urls), entropies(hosts)], 1)


@dataclass
class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    start: float
    cuts: list[np.ndarray]
    trees: list[list[tuple[int, int, float]]]  #: heap order: (feature or -1, last bin to the left, value)
    rate: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.start)
        for tree in self.trees:
            f, cut, value = (np.array(c) for c in zip(*tree))
            at = np.zeros(len(x), np.int64)
            for _ in range(len(tree).bit_length()):
                inner = f[at] >= 0
                right = b[np.arange(len(x)), np.maximum(f[at], 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += self.rate * value[at]
        return 1 / (1 + np.exp(-out))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> Trees:
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Trees(float(np.log(p / (1 - p))), cuts, [], rate)
    b, raw = model.bins(x), np.full(len(x), model.start)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-raw))
        g, h = y - q, q * (1 - q)
        tree = [(-1, 0, 0.0)] * (2 ** (depth + 1) - 1)
        at = np.zeros(len(x), np.int64)
        for node in range(len(tree)):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            total_g, total_h, best = g[rows].sum(), h[rows].sum(), (1e-6, -1, 0)
            if node < 2**depth - 1:
                for j in range(x.shape[1]):
                    left_g, left_h = (np.cumsum(np.bincount(b[rows, j], weights=v[rows], minlength=len(cuts[j]) + 1))[:-1] for v in (g, h))
                    right_g, right_h = total_g - left_g, total_h - left_h
                    gain = np.where((left_h >= least) & (right_h >= least), left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1), 0)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
            tree[node] = (best[1], best[2], float(total_g / (total_h + 1)))
            if best[1] >= 0:
                at[rows] = 2 * node + 1 + (b[rows, best[1]] > best[2])
            else:
                raw[rows] += rate * tree[node][2]
        model.trees.append(tree)
    return model


_COLUMNS = FEATURES[:-2]


def train(labelled: DataFrame, most_rows: int = 20_000) -> tuple[Statistics, Trees] | None:
    """labelled: url, host, path, blocked. Statistics are of all distinct urls; trees learn from about most_rows of them at most, chosen by hash; None without both labels."""
    rows = lexical(labelled.select(F.coalesce("url", F.lit("")).alias("url"), "host", "path", "blocked").distinct())
    s = statistics(rows)
    few = rows if s.total <= most_rows else rows.filter(F.pmod(F.xxhash64("url", F.lit(7)), F.lit(1_000_000)) < 1_000_000 * most_rows // s.total)
    few = s.joined(few, own="blocked").select("url", "host", "blocked", *_COLUMNS)
    # distinct urls have hashes of their own, so that no more than about most_rows come
    got = sorted(tuple(r) for r in few.toLocalIterator())
    if len({r[2] for r in got}) < 2:
        return None
    x = vectors([np.array([r[3 + j] for r in got]) for j in range(len(_COLUMNS))], [r[0] for r in got], [r[1] for r in got])
    return s, boost(x, np.array([float(r[2]) for r in got]))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, score.

    The longest fitting rule decides; else the trees do (block from 0.5 on), learned from
    labelled (url, blocked) or, without it, from the urls that rules decide. score: the
    trees' probability of block. Null urls have an empty host and path and are scored as
    empty; if nothing can be learned, allow with score 0. Repeated rows stay; equal urls
    are judged alike; other columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = with_rule(parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url"), rules)
    if labelled is None:
        known = rows.filter("rule is not null").select("url", "host", "path", (F.col("rule_verdict") == "block").alias("blocked"))
    else:
        known = parts(labelled.select("url", "blocked"), "url").filter("blocked is not null")
    model = train(known)
    own = ["id", "host", "path", "rule", "rule_verdict"]
    if model is None:
        scored = rows.select(*own, F.lit(0.0).alias("score"))
    else:
        stats, trees = model
        kind = rows.schema["id"].dataType.simpleString()

        def score(batches):
            for batch in light(batches):
                x = vectors([batch.column(len(own) + 1 + j).to_numpy() for j in range(len(_COLUMNS))], batch.column(len(own)).to_pylist(), batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(trees.score(x))], names=[*own, "score"])

        full = stats.joined(lexical(rows.withColumn("url", F.coalesce("url", F.lit("")))))
        scored = full.select(*own, "url", *_COLUMNS).mapInArrow(score, f"id {kind}, host string, path string, rule string, rule_verdict string, score double")
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
