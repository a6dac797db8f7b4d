"""Spatially blocked training of calibrated boosted trees.

Every fold's model is fitted in a task of its own, all folds side by side, from at most FIT_ROWS rows that a
hash chooses; models are a row each, and scoring sends the few models of a species to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import safe_file_name
from ..sources.scratch import materialise
from . import boosting, stats
from .sampling import uniform


@dataclass(frozen=True)
class Tier:
    depth: int
    trees: int
    rate: float


#: Model size by number of presences: over 500, over 100, fewer; fixed values.
TIERS = (Tier(4, 500, 0.05), Tier(3, 300, 0.03), Tier(2, 150, 0.02))
LEAST_PRESENCES = 25
#: Rows that one model is fitted on at most; a training set that has more is thinned by hash. Species trained at once.
FIT_ROWS, AT_ONCE = 500_000, 4
METRICS = ("auc", "pr_auc", "tss", "th", "brier", "ece", "time")


def tier(presences: int) -> Tier:
    return TIERS[0] if presences > 500 else TIERS[1] if presences > 100 else TIERS[2]


def eligible_species(rows: DataFrame, least: int = LEAST_PRESENCES) -> DataFrame:
    """(species_name, presences) of species with enough presences."""
    return rows.where("target = 1").groupBy("species_name").agg(F.count(F.lit(1)).alias("presences")).where(F.col("presences") >= least)


def species_rows(rows: DataFrame, species: str) -> DataFrame:
    """A species' presences and all background rows."""
    return rows.where((F.col("species_name") == species) | (F.col("target") == 0))


def assign_folds(df: DataFrame, group: str, folds: int = 4) -> DataFrame:
    """Adds fold: groups are dealt whole, the largest first, each to the fold with the fewest rows so far."""
    sizes = df.groupBy(group).count().orderBy(F.desc("count"), group).collect()
    load = [0] * folds
    deal = []
    for r in sizes:
        k = load.index(min(load))
        load[k] += r["count"]
        deal.append((r[group], k))
    table = df.sparkSession.createDataFrame(deal, T.StructType([df.schema[group], T.StructField("fold", T.IntegerType())]))
    return df.join(F.broadcast(table), group)  # a row a group: as few as there are spatial folds


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows.features.tolist(), dtype=float)


def fold_models(rows: DataFrame, key: str, t: Tier, null_model: bool = False, seed: int = 42) -> DataFrame:
    """(fold, model, seconds): for each fold the model of all other folds' rows (key, features, target, fold).

    ``null_model`` deals the training labels anew first. Early stopping needs more than 25 presences.
    """
    total = max(1, rows.count())
    dealt = rows.select(uniform([key], seed).alias("u"), uniform([key], seed + 1).alias("v"), "features", "target", "fold")
    dealt = dealt.where(F.col("v") < FIT_ROWS / total) if total > FIT_ROWS else dealt
    folds = [r.fold for r in rows.select("fold").distinct().orderBy("fold").collect()]
    each = dealt.withColumn("of", F.explode(F.array(*[F.lit(k) for k in folds]))).where(F.col("of") != F.col("fold"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        import time

        began, pdf = time.perf_counter(), pdf.sort_values("u", kind="stable")
        k, y, u = int(pdf.of.iloc[0]), pdf.target.to_numpy(float), pdf.u.to_numpy(float)
        if null_model:
            y = y[np.random.default_rng(seed + k).permutation(len(y))]
        model = boosting.calibrated(_matrix(pdf), y, u, t.depth, t.trees, t.rate, seed, not null_model and y.sum() > 25)
        return pd.DataFrame({"fold": [k], "model": [model.pack()], "seconds": [time.perf_counter() - began]})

    return each.groupBy("of").applyInPandas(fit, "fold int, model binary, seconds double")


def predict(rows: DataFrame, models: dict[int, bytes], keep: list[str], own_fold: bool = True) -> DataFrame:
    """``keep`` with fold and score: of each row by its own fold's model, or by every model."""
    sent = rows.sparkSession.sparkContext.broadcast(models)
    given = rows.select(*keep, "features", *(["fold"] if own_fold else []))
    fields = [rows.schema[c] for c in keep] + [T.StructField("fold", T.IntegerType()), T.StructField("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {k: boosting.unpack(m) for k, m in sent.value.items()}
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            fold = batch.column("fold").to_numpy() if own_fold else None
            for k, m in ready.items():
                at = np.flatnonzero(fold == k) if own_fold else np.arange(batch.num_rows)
                if len(at):
                    some = batch.take(pa.array(at))
                    cols = [*(some.column(c) for c in keep), pa.array(np.full(len(at), k, np.int32)), pa.array(m.score(x[at]))]
                    yield pa.RecordBatch.from_arrays(cols, [*keep, "fold", "score"])

    return given.mapInArrow(run, T.StructType(fields))


def _features(df: DataFrame, features: list[str]) -> DataFrame:
    return df.dropna(subset=features).withColumn("features", F.array(*[F.col(f).cast("double") for f in features]))


def fold_scores(scored: DataFrame) -> DataFrame:
    """(fold, auc, pr_auc, tss, th, brier, ece) of rows (fold, target, score); a row a fold."""
    out = None
    for k in [r.fold for r in scored.select("fold").distinct().orderBy("fold").collect()]:
        s = scored.where(F.col("fold") == k)
        one = stats.roc_auc(s, "target", "score").crossJoin(stats.average_precision(s, "target", "score")).crossJoin(stats.tss_threshold(s, "target", "score")).crossJoin(stats.brier_ece(s, "target", "score"))
        one = one.select(F.lit(k).alias("fold"), F.col("roc_auc").alias("auc"), F.col("avg_precision").alias("pr_auc"), "tss", F.col("threshold").alias("th"), "brier", "ece")
        out = one if out is None else out.unionByName(one)
    return out


def spatial_cv(df: DataFrame, features: list[str], key: str, fold: str = "spatial_fold", t: Tier | None = None, null_model: bool = False, seed: int = 42, save_to: str | None = None, species: str = "") -> DataFrame:
    """(fold, auc, pr_auc, tss, th, brier, ece, time) of models that are trained without the fold they are scored on; time in seconds.

    ``null_model`` deals the training labels anew first. With ``save_to``, the models are written there.
    """
    rows = _features(df, features).select(key, "features", F.col("target").cast("double").alias("target"), fold)
    rows, _ = materialise(assign_folds(rows, fold), "training")
    t = t or tier(rows.where("target = 1").count())
    found = fold_models(rows, key, t, null_model, seed)
    if save_to and not null_model:
        path = model_path(df.sparkSession, save_to, species)
        found.write.mode("overwrite").partitionBy("fold").parquet(path)
        found = df.sparkSession.read.parquet(path)
    found = found.collect()  # a row a fold
    scored, _ = materialise(predict(rows, {r.fold: bytes(r.model) for r in found}, ["target"]), "scored")
    times = df.sparkSession.createDataFrame([(r.fold, r.seconds) for r in found], "fold int, time double")
    return fold_scores(scored).join(F.broadcast(times), "fold")


def model_path(spark, folder: str, species: str) -> str:
    name = spark.range(1).select(safe_file_name(F.lit(species)).alias("n")).first().n
    return f"{folder}/{name}"


def load_models(spark, folder: str, species: str) -> dict[int, bytes]:
    """Saved fold models of a species; none if it has no folder. A folder that can't be read is an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(model_path(spark, folder, species))
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return {}
    return {int(r.fold): bytes(r.model) for r in spark.read.parquet(at.toString()).collect()}


def fold_summary(folds: DataFrame, by: str = "species", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and sample deviation over folds of every metric."""
    return folds.groupBy(by).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def governance(folds: DataFrame, null_auc: DataFrame) -> DataFrame:
    """Per species: :func:`fold_summary` and verdicts. ``null_auc``: (species, null_auc_mean)."""
    out = fold_summary(folds, metrics=tuple(m for m in METRICS if m in folds.columns)).join(null_auc, "species", "left")
    return out.withColumns({"stability": F.when(F.col("auc_std") < 0.1, "PASS").otherwise("WARN"), "governance": F.when(F.col("auc_mean") > F.col("null_auc_mean") + 0.1, "PASS").otherwise("FAIL")})


def train_all(rows: DataFrame, features: list[str], key: str, save_to: str | None = None, choose=tier) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Fold metrics of every eligible species, and (species, error) of those that failed; one failure doesn't stop the others.

    Species are trained AT_ONCE side by side; a species gives a row a fold.
    """

    def one(r):
        try:
            got = spatial_cv(species_rows(rows, r.species_name), features, key, t=choose(r.presences), save_to=save_to, species=r.species_name)
            return [(r.species_name, *x) for x in got.select("fold", *METRICS).collect()], None
        except Exception as e:  # noqa: BLE001  noted and left out
            return [], (r.species_name, str(e)[:500])

    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = list(pool.map(one, eligible_species(rows).orderBy("species_name").collect()))
    found, failed = [x for good, _ in done for x in good], [bad for _, bad in done if bad]
    if not found:
        return None, failed
    return rows.sparkSession.createDataFrame(found, "species string, fold int, " + ", ".join(f"{m} double" for m in METRICS)), failed


def ensemble_scores(spark, rows: DataFrame, features: list[str], folder: str, species: str, least: int = 3) -> DataFrame:
    """(pixel_y, pixel_x, fold, score) of all saved fold models of a species; raises with fewer than ``least``."""
    models = load_models(spark, folder, species)
    if len(models) < least:
        raise ValueError(f"{species} has {len(models)} fold models, fewer than {least}")
    return predict(_features(rows, features), models, ["pixel_y", "pixel_x"], own_fold=False)


def importance(df: DataFrame, features: list[str], t: Tier, key: str, seed: int = 42) -> DataFrame:
    """(feature, importance, direction, rank) by the gain of trees on all rows (at most FIT_ROWS, by hash); direction is a display convention by the feature's name."""
    rows = _features(df, features).select(uniform([key], seed).alias("u"), "features", F.col("target").cast("double").alias("target"))
    total = max(1, rows.count())
    rows = rows.where(F.col("u") < FIT_ROWS / total) if total > FIT_ROWS else rows

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u", kind="stable")
        gain = boosting.fit(_matrix(pdf), pdf.target.to_numpy(float), t.depth, t.trees, t.rate, seed).gain
        return pd.DataFrame({"feature": features, "importance": gain / max(gain.sum(), 1e-300)})

    values = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "feature string, importance double").collect()
    ranked = sorted(((r.feature, r.importance) for r in values), key=lambda x: (-x[1], x[0]))
    out = df.sparkSession.createDataFrame([(f, v, k + 1) for k, (f, v) in enumerate(ranked)], "feature string, importance double, rank int")
    return out.withColumn("direction", F.when(F.col("feature").rlike("night|dist|d2|coast"), -1).otherwise(1))
