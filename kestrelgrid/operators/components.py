"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is two equi-joins or aggregations over tables in the shared folder; nothing is collected.
Both sides of the join that meets a hub's edges are plain exchanges, so adaptive execution can split
a hub's rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop_path, materialise


def _state(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); a component is its smallest node.

    Loops, repeated and reversed edges are allowed; rows with a null end are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = materialise(pairs, "edges")
    before = _state(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least, least_path = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        # large star: larger neighbours of u hang on the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large, large_path = materialise(large, "large")
        # small star: smaller neighbours of a hang on the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        small, small_path = materialise(small, "small")
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, after_path = materialise(moved.unionAll(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = _state(after)
        for p in (path, least_path, large_path, small_path):
            drop_path(spark, p)
        now, path = after, after_path
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
