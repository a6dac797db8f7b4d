"""Seeded sampling and thinning: every draw is a hash of stable keys, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import drop_path, materialise
from .occurrence import value_counts
from .spatial import knn
from .stats import prefix_sums


def uniform(keys: list[str], seed: int) -> Column:
    """A number in (0, 1) from the first 48 bits of a digest of integer or string keys."""
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def weighted_stratified_sample(df: DataFrame, stratum: str, weight: str, quotas: dict[str, int], keys: list[str], seed: int = 42) -> DataFrame:
    """At most ``quotas[s]`` rows of each stratum without replacement, drawn in proportion to the root of the weight (at least 1e-12).

    A row's key is exponential with its weight as rate (-ln u / w); the smallest keys of a stratum win. The
    largest quota bounds the rank first, so that every partition passes on that many rows a stratum at most.
    """
    w = F.greatest(F.sqrt(F.col(weight)), F.lit(1e-12))
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(F.col("__key"), *keys))
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    rows = df.where(F.col(stratum).isin(*quotas)).withColumn("__key", -F.ln(uniform(keys, seed)) / w)
    rows = rows.withColumn("__rank", rank).where(F.col("__rank") <= max(quotas.values(), default=0))
    return rows.where(F.col("__rank") <= quota[F.col(stratum)]).drop("__key", "__rank")


def greedy_thin(points: DataFrame, radius: float, seed: int = 42) -> DataFrame:
    """Points that stay when they are visited in a random order and each removes its neighbours within ``radius``.

    The same set without a sequence: in each round, points that come before all their remaining neighbours
    stay, and their neighbours go. Ranks are unique (digest, then id). Cells are so small that all points of
    one are neighbours; only a cell's first point can stay, so a round compares every point with one
    candidate of each cell about it, however dense the points are.
    """
    spark = points.sparkSession
    side = radius / 2**0.5 * (1 - 1e-12)
    rank = F.struct(uniform(["id"], seed).alias("u"), F.col("id").alias("i"))
    open_ = points.where("x IS NOT NULL AND y IS NOT NULL").select("id", "x", "y", rank.alias("rank"), F.floor(F.col("y") / side).alias("cy"), F.floor(F.col("x") / side).alias("cx"))
    open_, path = materialise(open_, "thin-open")
    kept, old = None, []
    offsets = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    while open_.take(1):
        first = open_.groupBy("cy", "cx").agg(F.min(F.struct("rank", "x", "y")).alias("f"))
        first = first.select(F.col("f.rank").alias("mine"), F.col("f.x").alias("fx"), F.col("f.y").alias("fy"), "cy", "cx")
        about = first.withColumn("dy", offsets).withColumn("dx", offsets).select("mine", "fx", "fy", (F.col("cy") + F.col("dy")).alias("cy"), (F.col("cx") + F.col("dx")).alias("cx"))
        close = (F.col("x") - F.col("fx")) ** 2 + (F.col("y") - F.col("fy")) ** 2 <= radius * radius
        pairs, pairs_path = materialise(about.join(open_, ["cy", "cx"]).where(close).select("mine", "id", (F.col("rank") < F.col("mine")).alias("before")), "thin-pairs")
        stay = pairs.groupBy("mine").agg(F.max("before").alias("late")).where("NOT late").select("mine")
        fresh, fresh_path = materialise(stay, "thin-kept")
        gone = pairs.join(fresh, "mine", "left_semi").select("id").distinct()
        rest, rest_path = materialise(open_.join(gone, "id", "left_anti"), "thin-open")
        for p in (path, pairs_path):
            drop_path(spark, p)
        open_, path = rest, rest_path
        old.append(fresh_path)
        kept = fresh if kept is None else kept.unionByName(fresh)
    drop_path(spark, path)
    if kept is None:
        return points.limit(0)
    final, _ = materialise(kept.select(F.col("mine.i").alias("id")), "thin-kept")
    for p in old:
        drop_path(spark, p)
    return points.join(final, "id", "left_semi")


def temporal_borrow(background: DataFrame, presence: DataFrame, k: int = 25, seed: int = 42, columns: tuple[str, ...] = ("year", "month")) -> DataFrame:
    """Background points with the (year, month) of one of their k nearest presences, drawn by a hash; with fewer than k, of those there are."""
    near = knn(background, presence, k)
    n = F.count(F.lit(1)).over(W.partitionBy("left_id"))
    pick = F.floor(uniform(["left_id"], seed) * F.col("__n")) + 1
    chosen = near.withColumn("__n", n).where(F.col("rank") == pick).select(F.col("left_id").alias("id"), "right_id")
    lent = presence.select(F.col("id").alias("right_id"), *columns)
    return background.join(chosen, "id").join(lent, "right_id").drop("right_id")


def leakage_audit(background: DataFrame, presence: DataFrame) -> DataFrame:
    """One row: least distance to a presence, and the percent of background whose nearest presence has its year, its month."""
    near = knn(background, presence, 1)
    both = near.join(background.select(F.col("id").alias("left_id"), "year", "month"), "left_id").join(presence.select(F.col("id").alias("right_id"), F.col("year").alias("__y"), F.col("month").alias("__m")), "right_id")
    share = lambda c: (F.avg(F.coalesce(c, F.lit(False)).cast("double")) * 100)
    return both.agg(F.min("distance").alias("min_dist"), share(F.col("year") == F.col("__y")).alias("same_year_overlap_pct"), share(F.col("month") == F.col("__m")).alias("same_month_overlap_pct"))


def split(df: DataFrame, label: str, keys: list[str], share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds is_validation: the first ``share`` of each class in hash order; ``keys`` name a row. Places are running counts within ranges, so no task sees a whole class."""
    rows = df.withColumns({"__order": F.struct(label, uniform(keys, seed).alias("u"), *keys), "__one": F.lit(1)})
    placed = prefix_sums(rows, "__order", ["__one"])
    classes = placed.groupBy(F.col(label).alias("__class")).agg(F.min(F.col("__one_upto") - 1).alias("__before"), F.count(F.lit(1)).alias("__n"))
    out = placed.join(classes, F.col(label).eqNullSafe(F.col("__class")))
    return out.withColumn("is_validation", F.col("__one_upto") - F.col("__before") <= F.round(F.col("__n") * share)).select(*df.columns, "is_validation")


def permute(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Labels dealt anew among the rows: the row at a place in key order gets the label at that place in hash order.

    ``key`` is unique. Places are running counts within ranges, so no task sees all rows.
    """
    one = df.select(key, label, F.lit(1).alias("n"), F.struct(uniform([key], seed).alias("u"), F.col(key).alias("k")).alias("draw"))
    a = prefix_sums(one.select(key, "n"), key, ["n"]).select(key, F.col("n_upto").alias("__place"))
    b = prefix_sums(one.select("draw", label, "n"), "draw", ["n"]).select(F.col(label).alias("__label"), F.col("n_upto").alias("__place"))
    dealt = a.join(b, "__place").select(key, F.col("__label").alias(label))
    return df.drop(label).join(dealt, key)


def season_alignment(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Shares of each value in two tables, zero where one lacks it."""
    share = lambda df, name: value_counts(df, column, normalised=True).select(column, F.col("share").alias(name))
    return share(a, "presence_prop").join(share(b, "background_prop"), column, "full_outer").fillna(0.0, ["presence_prop", "background_prop"])
