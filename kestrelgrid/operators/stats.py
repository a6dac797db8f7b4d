"""Distribution statistics and scores of predictions. Each is an aggregate, or an aggregate over a histogram of distinct values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise

def _everything():
    return W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def prefix_sums(df: DataFrame, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Adds <c>_upto, the running sum in ``order`` with equal values together, and <c>_all, the total, for each c of ``sums``.

    ``order`` has distinct values. Rows are dealt to partitions by ranges of it; a partition's sums run alone
    and start from the totals of the partitions before it, so no task sees all rows.
    """
    by = F.desc(order) if descending else F.asc(order)
    rows, _ = materialise(df.repartitionByRange(by).withColumn("__part", F.spark_partition_id()), "ordered")
    parts = rows.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}_before") for c in sums], *[F.sum(f"__{c}").over(_everything()).alias(f"{c}_all") for c in sums])
    within = W.partitionBy("__part").orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.join(F.broadcast(parts), "__part")  # one row a partition
    out = out.withColumns({f"{c}_upto": F.sum(c).over(within) + F.col(f"__{c}_before") for c in sums})
    return out.drop("__part", *[f"__{c}_before" for c in sums])


def ks_statistic(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row, ks_stat: largest gap between the two groups' empirical distributions (``group`` is boolean or 0/1).

    Values are counted first, so ties stand together and the ordered window sees distinct values only.
    """
    one = F.col(group).cast("int") == 1
    hist = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(value).agg(F.count_if(one).alias("a"), F.count_if(~one).alias("b"))
    gap = F.abs(F.col("a_upto") / F.col("a_all") - F.col("b_upto") / F.col("b_all"))
    return prefix_sums(hist, value, ["a", "b"]).agg(F.max(gap).alias("ks_stat"))


def cohens_d(df: DataFrame, values: list[str], group: str) -> DataFrame:
    """(feature, cohens_d): difference of means over the root of the mean of both sample variances (at least 1e-8), from one pass."""
    one = F.col(group).cast("int") == 1
    both = lambda f, c, n: [f(F.when(one, F.col(c))).alias(f"{c}__{n}1"), f(F.when(~one, F.col(c))).alias(f"{c}__{n}0")]
    aggs = [a for c in values for f, n in ((F.avg, "m"), (F.var_samp, "v")) for a in both(f, c, n)]
    row = df.agg(*aggs)

    def d(c: str):
        pooled = F.sqrt((F.col(f"{c}__v1") + F.col(f"{c}__v0")) / 2)
        return ((F.col(f"{c}__m1") - F.col(f"{c}__m0")) / F.greatest(pooled, F.lit(1e-8))).alias(c)

    return row.select(*[d(c) for c in values]).unpivot([], values, "feature", "cohens_d")


def correlation(df: DataFrame, values: list[str]) -> DataFrame:
    """(feature_1, feature_2, correlation) of all pairs, each over the rows that have both; one pass."""
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    out = row.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "correlation")
    return out.select(F.split("pair", r"\|")[0].alias("feature_1"), F.split("pair", r"\|")[1].alias("feature_2"), "correlation")


def vif(df: DataFrame, values: list[str]) -> DataFrame:
    """(feature, vif) over complete rows, without an intercept: diagonals of the Gram matrix and of its inverse, multiplied.

    The Gram matrix is one distributed aggregate; the driver inverts a matrix of the features' number. Columns
    that are constant or repeat others have no inverse: constant ones are left out, the rest use the
    pseudo-inverse.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in values]).dropna()
    moments = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(values) for j, b in enumerate(values) if j >= i]
    r = rows.agg(*moments, *[(F.max(c) > F.min(c)).alias(f"varies_{i}") for i, c in enumerate(values)]).first()
    use = [i for i in range(len(values)) if r[f"varies_{i}"]]
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in use] for i in use], dtype=float)
    out = np.diag(g) * np.diag(np.linalg.pinv(g)) if use else []
    return df.sparkSession.createDataFrame([(values[i], float(v)) for i, v in zip(use, out, strict=True)], "feature string, vif double")


def quantiles(df: DataFrame, wanted: dict[str, tuple[float, ...]]) -> DataFrame:
    """(feature, p, value): exact quantiles of numeric columns, with linear interpolation between neighbours; nulls don't count.

    The distinct values of all columns are ordered together by running sums within ranges, so no task holds
    a column; the two neighbours of each quantile are then picked by their places. A column without values
    gives no rows.
    """
    names = list(wanted)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "feature", "v").where("v IS NOT NULL")
    hist = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = prefix_sums(hist.withColumn("__order", F.struct("feature", "v")), "__order", ["n"]).select("feature", "v", "n", "n_upto")
    ends = placed.groupBy("feature").agg(F.min(F.col("n_upto") - F.col("n")).alias("before"), F.sum("n").alias("total"))  # a row a column
    at = df.sparkSession.createDataFrame([(c, float(p)) for c in names for p in wanted[c]], "feature string, p double")
    asked = ends.join(F.broadcast(at), "feature").withColumn("place", F.col("p") * (F.col("total") - 1))
    low, high = F.floor("place"), F.ceil("place")
    holds = lambda k: (F.col("n_upto") - F.col("n") - F.col("before") <= k) & (k < F.col("n_upto") - F.col("before"))
    near = placed.join(F.broadcast(asked), "feature").where(holds(low) | holds(high))
    pair = near.groupBy("feature", "p", "place").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return pair.select("feature", "p", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - low)).alias("value"))


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of named quantiles, each of (column, p); null where a column has no values."""
    by_column: dict[str, tuple[float, ...]] = {}
    for c, p in wanted.values():
        by_column[c] = (*by_column.get(c, ()), p)
    pick = lambda c, p: F.max(F.when((F.col("feature") == c) & (F.col("p") == float(p)), F.col("value")))
    return quantiles(df, by_column).agg(*[pick(c, p).alias(name) for name, (c, p) in wanted.items()])


def describe(df: DataFrame, values: list[str], percentiles: tuple[float, ...] = (0.01, 0.5, 0.99), population: bool = False) -> DataFrame:
    """(feature, count, mean, std, min, percentiles, max) of numeric columns: one pass over all of them, and their :func:`quantiles`."""
    std = F.stddev_pop if population else F.stddev_samp
    names = [f"p{round(p * 100):02d}" for p in percentiles]
    stats = [("count", lambda c: F.count(c).cast("double")), ("mean", F.avg), ("std", std), ("min", lambda c: F.min(c).cast("double")), ("max", lambda c: F.max(c).cast("double"))]
    row = df.agg(*[F.array(*[f(F.col(c).cast("double")) for _, f in stats]).alias(c) for c in values])
    out = row.unpivot([], values, "feature", "v").select("feature", *[F.col("v")[k].cast("long" if n == "count" else "double").alias(n) for k, (n, _) in enumerate(stats)])
    pick = lambda p: F.max(F.when(F.col("p") == float(p), F.col("value")))
    found = quantiles(df, {c: percentiles for c in values}).groupBy("feature").agg(*[pick(p).alias(n) for n, p in zip(names, percentiles, strict=True)])
    return out.join(found, "feature", "left").select("feature", "count", "mean", "std", "min", *names, "max")


def infinite_share(df: DataFrame, values: list[str]) -> DataFrame:
    """(feature, missing_pct, invalid_pct): percent null, percent infinite."""
    pick = lambda c: F.array(F.avg(F.col(c).isNull().cast("double")) * 100, F.avg(F.coalesce(F.abs(F.col(c).cast("double")) == float("inf"), F.lit(False)).cast("double")) * 100).alias(c)
    out = df.agg(*[pick(c) for c in values]).unpivot([], values, "feature", "v")
    return out.select("feature", F.col("v")[0].alias("missing_pct"), F.col("v")[1].alias("invalid_pct"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, ecdf) of the distinct values."""
    hist = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(hist, value, ["n"]).select(value, (F.col("n_upto") / F.col("n_all")).alias("ecdf"))


def confidence_bins(df: DataFrame, value: str, out: str = "confidence_flag") -> DataFrame:
    """LOW up to half the largest value, MEDIUM up to 80 %, HIGH above."""
    top = df.agg(F.max(value).alias("__top"))
    v = F.col(value)
    level = F.when(v <= F.col("__top") * 0.5, "LOW").when(v <= F.col("__top") * 0.8, "MEDIUM").when(v.isNotNull(), "HIGH")
    return df.crossJoin(F.broadcast(top)).withColumn(out, level).drop("__top")


def _score_histogram(df: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label).cast("int") == 1
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row, roc_auc: the share of (positive, negative) pairs in order, ties half; null without both classes."""
    return auc_of_histogram(_score_histogram(df, label, score), score)


def auc_of_histogram(hist: DataFrame, score: str) -> DataFrame:
    """:func:`roc_auc` from counts p and n of positives and negatives by distinct score."""
    h = prefix_sums(hist, score, ["n"])
    below = F.col("n_upto") - F.col("n")
    parts = h.select((F.col("p") * (below + F.col("n") / 2)).alias("won"), "p", "n")
    return parts.agg(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("n").cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row, avg_precision: precision at each distinct score, weighed by the recall gained there."""
    h = prefix_sums(_score_histogram(df, label, score), score, ["p", "n"], descending=True)
    precision = F.col("p_upto") / (F.col("p_upto") + F.col("n_upto"))
    return h.select((precision * F.col("p")).alias("part"), "p").agg(F.try_divide(F.sum("part"), F.sum("p").cast("double")).alias("avg_precision"))


def brier_ece(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """One row, brier and ece: mean squared error, and the unweighted mean over non-empty bins of |observed - predicted|."""
    y = F.col(label).cast("double")
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    per = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(at.alias("bin")).agg(F.avg(y).alias("observed"), F.avg(score).alias("predicted"), F.sum((F.col(score) - y) ** 2).alias("error"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum("error") / F.sum("n")).alias("brier"), F.avg(F.abs(F.col("observed") - F.col("predicted"))).alias("ece"))


def confusion(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    y, hit = F.col(label).cast("int") == 1, F.col(score) >= threshold
    return df.agg(F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(y & hit).alias("tp"))


def tss_threshold(df: DataFrame, label: str, score: str, steps: int = 99) -> DataFrame:
    """One row, threshold and tss: the first of the thresholds 1/(steps+1), ... with the largest sensitivity + specificity - 1.

    A row counts at each threshold up to its score; rows are first counted by the highest threshold they
    reach, so the sweep runs over a histogram of at most steps + 1 rows.
    """
    y = F.col(label).cast("int") == 1
    # thresholds up to the score: a guess by multiplication, set right by comparing with the thresholds beside it
    guess, s = F.floor(F.col(score) * (steps + 1)), F.col(score)
    exact = guess + ((guess + 1) / (steps + 1) <= s).cast("int") - (guess / (steps + 1) > s).cast("int")
    reach = F.greatest(F.lit(0), F.least(F.lit(steps), exact)).cast("int")
    hist = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(reach.alias("reach")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    grid = df.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("k"), (F.col("id") / (steps + 1)).alias("threshold"))
    both = grid.join(F.broadcast(hist), F.lit(True)).groupBy("k", "threshold").agg(
        (F.sum(F.when(F.col("reach") >= F.col("k"), F.col("p")).otherwise(0)) / F.sum("p")).alias("sensitivity"), (F.sum(F.when(F.col("reach") < F.col("k"), F.col("n")).otherwise(0)) / F.sum("n")).alias("specificity")
    )
    tss = both.withColumn("tss", F.col("sensitivity") + F.col("specificity") - 1)
    return tss.agg(F.max_by("threshold", F.struct("tss", -F.col("k"))).alias("threshold"), F.max("tss").alias("tss"))


def display_roc(spark, auc: float, points: int = 100) -> DataFrame:
    """A curve of the given area for display: y = x ^ ((1 - auc) / auc)."""
    x = F.col("id") / (points - 1)
    return spark.range(points).select(x.alias("fpr"), F.pow(x, (1 - auc) / auc).alias("tpr"))


def row_ids(df: DataFrame, key: str, out: str = "original_row_id") -> DataFrame:
    """Adds the row's place in the order of a unique key, from 0; counted within ranges, so no task sees all rows."""
    places = prefix_sums(df.select(key, F.lit(1).alias("n")), key, ["n"])
    return df.join(places.select(key, (F.col("n_upto") - 1).cast("long").alias(out)), key)


def downcast(df: DataFrame) -> DataFrame:
    """Doubles as floats and longs as ints where their range allows it (one pass finds that)."""
    longs = [c for c, t in df.dtypes if t == "bigint"]
    fits = df.agg(*[F.max(F.abs(c)).alias(c) for c in longs]).first() if longs else {}
    small = {c for c in longs if fits[c] is None or fits[c] < 1 << 31}
    return df.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c).cast("int").alias(c) if c in small else F.col(c) for c, t in df.dtypes])


def first_rows(report: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` rows of a report in a total order."""
    return report.orderBy(*order).limit(n)
