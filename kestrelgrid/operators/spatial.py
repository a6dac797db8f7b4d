"""Distance joins by bucket equi-joins. Points are (id long, x double, y double) in one plane's units; other columns pass through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import drop_path, materialise


def _cell(c: str, size: Column | float) -> Column:
    return F.floor(F.col(c) / (size if isinstance(size, Column) else F.lit(float(size))))


def _around(df: DataFrame, size: float) -> DataFrame:
    """Each point in its own bucket and the eight about it."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    out = df.withColumn("__dy", F.explode(near)).withColumn("__dx", F.explode(near))
    return out.withColumns({"__cy": _cell("y", size) + F.col("__dy"), "__cx": _cell("x", size) + F.col("__dx")}).drop("__dy", "__dx")


#: Right points of a bucket that one task meets with the left ones about it; a fuller bucket is dealt to several tasks.
CROWD = 4_096


def within(left: DataFrame, right: DataFrame, radius: float, on: list[str] | None = None, crowd: int = CROWD) -> DataFrame:
    """(left columns, right_id, distance) of all pairs at most ``radius`` apart, with equal ``on`` columns.

    Buckets have the radius as their side, so a partner is in one of nine. The points of a crowded bucket are
    dealt by hash into parts of about ``crowd``, and the left points about it meet each part.
    """
    keys = ["__cy", "__cx", *(on or [])]
    r = right.select(F.col("id").alias("right_id"), F.col("x").alias("__rx"), F.col("y").alias("__ry"), *(on or []), _cell("y", radius).alias("__cy"), _cell("x", radius).alias("__cx"))
    crowded, _ = materialise(r.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / crowd).alias("__parts")).where("__parts > 1"), "crowded")
    parts = F.coalesce("__parts", F.lit(1))
    r = r.join(crowded, keys, "left").withColumn("__part", F.pmod(F.xxhash64("right_id"), parts)).drop("__parts")
    l = _around(left, radius).join(crowded, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")  # noqa: E741
    pairs = l.join(r, [*keys, "__part"])
    d2 = (F.col("x") - F.col("__rx")) ** 2 + (F.col("y") - F.col("__ry")) ** 2
    return pairs.where(d2 <= radius * radius).withColumn("distance", F.sqrt(d2)).drop("__cy", "__cx", "__rx", "__ry", "__part")


def radius_anti_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Left points with no right point within ``radius``.

    The partners' buckets and points are first reduced to distinct positions, and the test is an existence
    test: no pair of points is given out.
    """
    r = right.select(F.col("x").alias("__rx"), F.col("y").alias("__ry"), _cell("y", radius).alias("__cy"), _cell("x", radius).alias("__cx")).distinct()
    l = _around(left.select("id", "x", "y"), radius)  # noqa: E741
    close = (l["x"] - r["__rx"]) ** 2 + (l["y"] - r["__ry"]) ** 2 <= radius * radius
    hit = l.join(r, (l["__cy"] == r["__cy"]) & (l["__cx"] == r["__cx"]) & close, "left_semi").select("id").distinct()
    return left.join(hit, "id", "left_anti")


#: A node has FAN x FAN children; points that a leaf holds at most, but at the deepest level.
FAN, LEAF, DEEPEST = 4, 64, 20


def _nodes(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__rx").alias("x0"), F.max("__rx").alias("x1"), F.min("__ry").alias("y0"), F.max("__ry").alias("y1"))


def _tree(r: DataFrame, on: list[str], leaf: int) -> tuple[dict[int, DataFrame], DataFrame, int]:
    """A tree of square cells over the points (right_id, __rx, __ry, on): nodes by level (on, cy, cx, n and box), the points with their leaf (level, cy, cx), and the first level that has leaves.

    All points are counted once at the level where a cell would hold ``leaf`` of evenly spread ones; the
    levels above are sums of these. Points of cells that hold more go on, level by level, alone.
    """
    span = r.agg(F.min("__rx"), F.max("__rx"), F.min("__ry"), F.max("__ry"), F.count(F.lit(1))).first()
    side = max(span[1] - span[0], span[3] - span[2]) or 1.0
    start, cells = 0, 1
    while cells * leaf < span[4]:
        start, cells = start + 1, cells * FAN * FAN
    keys = [*on, "cy", "cx"]

    def at(level: int) -> dict:
        inner = lambda c, low: F.least(F.floor((F.col(c) - low) / side * FAN**level), F.lit(FAN**level - 1)).cast("long")
        return {"cy": inner("__ry", span[2]), "cx": inner("__rx", span[0])}

    levels: dict[int, DataFrame] = {}
    active, leaves, level = r, None, start
    while True:
        active, _ = materialise(active.withColumns(at(level)), "knn-points")
        levels[level], _ = materialise(_nodes(active, keys), "knn-nodes")
        crowded = levels[level].where(F.col("n") > leaf).select(*keys)
        last = level == DEEPEST or not crowded.take(1)
        mine = (active if last else active.join(crowded, keys, "left_anti")).withColumn("level", F.lit(level))
        leaves = mine if leaves is None else leaves.unionByName(mine)
        if last:
            break
        active, level = active.join(crowded, keys, "left_semi").drop("cy", "cx"), level + 1
    for up in range(start - 1, -1, -1):
        parents = levels[up + 1].withColumns({c: F.floor(F.col(c) / FAN) for c in ("cy", "cx")})
        levels[up] = parents.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return levels, leaves, start


def knn(left: DataFrame, right: DataFrame, k: int, others_only: bool = False, on: list[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """(left_id, on, right_id, distance, rank): the k nearest right points of each left one, ties to smaller ids; exact.

    With ``on``, only right points with equal columns count, and (id, on) names a left row. All left points
    go down a tree of cells together, a level a round: the boxes of a point's cells, taken by their farthest
    corners, say how far k partners are at most, and cells beyond that are left. So a point meets the points
    of a few leaves, wherever it stands and however crowded the right points are.
    """
    spark, on = left.sparkSession, on or []
    need = k + others_only
    left = left.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("id").alias("left_id"), "x", "y", *on)
    # of points at one place only the k (and perhaps the point itself) with the smallest ids can be among the nearest
    here = F.row_number().over(W.partitionBy("x", "y", *on).orderBy("id"))
    right = right.where("x IS NOT NULL AND y IS NOT NULL").select("id", "x", "y", *on).withColumn("__n", here).where(F.col("__n") <= need)
    r, _ = materialise(right.select(F.col("id").alias("right_id"), F.col("x").alias("__rx"), F.col("y").alias("__ry"), *on), "knn-right")
    if not r.take(1):
        return left.limit(0).select(F.col("left_id").cast("long").alias("left_id"), *on, F.lit(0).cast("long").alias("right_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    levels, leaves, start = _tree(r, on, leaf)
    bottom, who, box = max(levels), ["left_id", "x", "y", *on], ["n", "x0", "x1", "y0", "y1"]

    def meet(rows: DataFrame, level: int) -> DataFrame:
        """Rows with the children of their node, or with the root."""
        nodes = levels[level].withColumns({"py": F.floor(F.col("cy") / FAN), "px": F.floor(F.col("cx") / FAN)})
        if level == 0:
            got = rows.join(nodes, on) if on else rows.crossJoin(nodes)
        else:
            got = rows.select(*who, F.col("cy").alias("py"), F.col("cx").alias("px")).join(nodes, [*on, "py", "px"])
        is_leaf = F.lit(level == bottom) | (F.lit(level >= start) & (F.col("n") <= leaf))
        return got.select(*who, F.lit(level).alias("level"), "cy", "cx", *box, is_leaf.alias("leaf"))

    def near_ones(rows: DataFrame) -> DataFrame:
        """Without the cells whose nearest side is farther than ``need`` partners are at most."""
        off = [F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1")) for c in "xy"]
        end = [F.greatest(F.abs(F.col(c) - F.col(f"{c}0")), F.abs(F.col(c) - F.col(f"{c}1"))) for c in "xy"]
        rows = rows.withColumns({"__near": F.sqrt(off[0] ** 2 + off[1] ** 2), "__far": F.sqrt(end[0] ** 2 + end[1] ** 2)})
        of = W.partitionBy("left_id", *on)
        so_far = F.sum("n").over(of.orderBy("__far", "level", "cy", "cx").rowsBetween(W.unboundedPreceding, W.currentRow))
        rows = rows.withColumn("__sum", so_far).withColumn("__limit", F.min(F.when(F.col("__sum") >= need, F.col("__far"))).over(of))
        return rows.where(F.col("__limit").isNull() | (F.col("__near") <= F.col("__limit") * (1 + 1e-9))).drop("__near", "__far", "__sum", "__limit")

    reached, path = materialise(meet(left, 0), "knn-reached")
    for level in range(1, bottom + 1):
        further, further_path = materialise(near_ones(reached.where("leaf").unionByName(meet(reached.where("NOT leaf"), level))), "knn-reached")
        drop_path(spark, path)
        reached, path = further, further_path
    pairs = reached.select(*who, "level", "cy", "cx").join(leaves, [*on, "level", "cy", "cx"])
    if others_only:
        pairs = pairs.where("left_id <> right_id")
    d = F.sqrt((F.col("x") - F.col("__rx")) ** 2 + (F.col("y") - F.col("__ry")) ** 2)
    rank = F.row_number().over(W.partitionBy("left_id", *on).orderBy("distance", "right_id"))
    return pairs.select("left_id", *on, "right_id", d.alias("distance")).withColumn("rank", rank).where(F.col("rank") <= k)


def seam_trim(points: DataFrame, fold: str, radius: float) -> tuple[DataFrame, DataFrame]:
    """Points of earlier folds near later ones, and what that does to the folds' distance.

    Gives (kept, report): a point goes if a point of a fold later in order is closer than ``radius``. The
    report has the pair of folds, the least distance before and after trimming and the points dropped. All
    pairs of folds are searched together: a point stands once for each later fold.
    """
    folds = points.select(F.col(fold).alias("right_fold")).distinct()  # a row a fold

    def nearest(df: DataFrame) -> DataFrame:
        left = df.join(F.broadcast(folds), F.col(fold) < F.col("right_fold")).select("id", "x", "y", "right_fold", F.col(fold).alias("left_fold"))
        near = knn(left, df.select("id", "x", "y", F.col(fold).alias("right_fold")), 1, on=["right_fold"])
        return near.join(df.select(F.col("id").alias("left_id"), F.col(fold).alias("left_fold")), "left_id")

    before, _ = materialise(nearest(points), "seam-before")
    drop = before.where(F.col("distance") < radius)
    kept = points.join(drop.select(F.col("left_id").alias("id")).distinct(), "id", "left_anti")
    pair = [F.col("left_fold").cast("string").alias("fold_1"), F.col("right_fold").cast("string").alias("fold_2")]
    was = before.groupBy(*pair).agg(F.min("distance").alias("min_dist_before"), F.count_if(F.col("distance") < radius).alias("dropped"))
    now = nearest(kept).groupBy(*pair).agg(F.min("distance").alias("min_dist_after"))
    return kept, was.join(now, ["fold_1", "fold_2"], "left").select("fold_1", "fold_2", "min_dist_before", "min_dist_after", "dropped")


def pixel_lookup(points: DataFrame, layers: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the values of their pixel (and year); points outside the layers go."""
    return points.join(layers, keys)


def year_lookup(points: DataFrame, layers: DataFrame, features: list[str], least_valid: int, layer_count: int) -> DataFrame:
    """Points with their pixel's and year's layers, wide: only years that have all layers, only rows with enough valid features.

    Layers are made wide by one aggregate on (year, pixel) and then joined once, not once a layer.
    """
    full = layers.groupBy("year").agg(F.count_distinct("layer").alias("n")).where(F.col("n") == layer_count).select("year")
    wide = layers.join(F.broadcast(full), "year", "left_semi").groupBy("year", "pixel_y", "pixel_x").pivot("layer", features).agg(F.first("value", ignorenulls=True))
    valid = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0))
    return points.join(wide, ["year", "pixel_y", "pixel_x"]).where(valid >= least_valid)
