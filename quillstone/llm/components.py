"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import forget, written


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """Each vertex links its neighbours (larger ones, or smaller and itself) to the least of them all."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written, so that the join can split a vertex with very many links
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
    linked = both.hint("merge").join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    star = written(out.filter("u != v").distinct(), name)
    forget(least)
    return star


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: u, v (long). Returns v, root for every vertex, root: the least vertex of its component.

    Rounds of a few shuffles each, their number growing with the logarithm of the size;
    each round is written, no list of links leaves the executors. A vertex with many links
    meets them in pre-aggregated minima and one skew-split join.
    """
    now = written(edges.select("u", "v").filter("u != v").distinct(), name)
    while True:
        # done when every edge leads to a root: no vertex has two, and none is both an end and a root
        several = now.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).filter("a != b")
        if several.isEmpty() and now.filter("u <= v").isEmpty() and now.select("v").distinct().join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        large = _star(now, True, name)
        small = _star(large, False, name)
        forget(now, large)
        now = small
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionAll(now.select("v", F.col("v").alias("root")).distinct())
