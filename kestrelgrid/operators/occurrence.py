"""Occurrence records: cleaning, reports, seasonality scores, thinning and the gate after them.

Input columns are the canonical ones (latitude, longitude, observation_date, species_name,
observer_name, occurrence_id, year, month). Every function returns a new DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.coords import decimal_places, in_box, region, valid_position
from ..functions.names import INVALID, binomial, was_modified

#: Columns kept however sparse they are, and species never taken as migratory; fixed values.
PROTECTED = ("latitude", "longitude", "species_name", "observation_date", "year", "month", "occurrence_id", "source_file", "observer_name")
ENDEMIC = ("Rhyticeros narcondami", "Psittacula caniceps", "Columba palumboides", "Ninox affinis", "Macropygia rufipennis", "Accipiter butleri", "Sturnia erythropygia", "Megapodius nicobariensis", "Spilornis elgini")
SUMMER, WINTER = (5, 6, 7, 8), (11, 12, 1, 2)


def missing_report(df: DataFrame, limit: float = 50.0, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """(column_name, missing_percent, retained_or_removed), from one pass over all columns."""
    shares = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in df.columns])
    out = shares.unpivot([], df.columns, "column_name", "missing_percent")
    keep = (F.col("missing_percent") <= limit) | F.col("column_name").isin(*protected)
    return out.withColumn("retained_or_removed", F.when(keep, "retained").otherwise("removed"))


def drop_sparse(df: DataFrame, limit: float = 50.0, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """Without the columns that :func:`missing_report` removes; one row a column reaches the driver."""
    keep = {r.column_name for r in missing_report(df, limit, protected).collect() if r.retained_or_removed == "retained"}
    return df.select(*[c for c in df.columns if c in keep])


def observer_counts(df: DataFrame, observer: str = "observer_name") -> DataFrame:
    return df.where(F.col(observer).isNotNull()).groupBy(observer).agg(F.count(F.lit(1)).alias("records"))


def observer_share(df: DataFrame, observer: str = "observer_name", tops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: observers, and the share of all rows (those without an observer too) made by the most active p %.

    Which of equally active observers counts makes no difference, so the shares come from the histogram of
    activity, whose size is the number of different counts and not of observers.
    """
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    hist = observer_counts(df, observer).groupBy("records").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("records")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hist = hist.withColumns({"before": before, "observers": F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    hist = hist.crossJoin(F.broadcast(total))
    part = lambda p: F.sum(F.greatest(F.lit(0), F.least(F.col("n"), F.greatest(F.lit(1), F.floor(F.col("observers") * (p / 100.0))) - F.col("before"))) * F.col("records")) / F.first("rows")
    return hist.agg(F.coalesce(F.max("observers"), F.lit(0)).cast("long").alias("total_observers"), *[part(p).alias(f"top_{p}_pct_contribution") for p in tops])


def parse_date(value: Column, formats: tuple[str, ...] = ()) -> Column:
    """A timestamp without time zone; null for what doesn't parse. Formats are tried in order, then Spark's own."""
    tries = [F.try_to_timestamp(value, F.lit(f)) for f in formats] + [F.try_to_timestamp(value)]
    return F.coalesce(*tries).cast("timestamp_ntz")


def fill_dates(df: DataFrame, date: str = "observation_date") -> DataFrame:
    """year and month from the date where they are null; rows that then lack either go."""
    at = F.col(date)
    out = df.withColumns({"year": F.coalesce(F.col("year").cast("int"), F.year(at)) if "year" in df.columns else F.year(at), "month": F.coalesce(F.col("month").cast("int"), F.month(at)) if "month" in df.columns else F.month(at)})
    return out.dropna(subset=["year", "month"])


def temporal_filter(df: DataFrame, years: tuple[int, int] = (2005, 2025)) -> DataFrame:
    return df.where(F.col("year").between(*years))


def temporal_report(df: DataFrame, years: tuple[int, int] = (2005, 2025)) -> DataFrame:
    """Span of years before the filter, rows after it."""
    return df.agg(F.min("year").alias("min_year_before"), F.max("year").alias("max_year_before"), F.count_if(F.col("year").between(*years)).alias("records_after"))


def monthly_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("month").agg(F.count("month").alias("records"), F.count_distinct("species_name").alias("species"))


def spatial_filter(df: DataFrame, box: tuple[float, float, float, float] = (6.0, 14.0, 92.0, 94.5)) -> DataFrame:
    """Numeric coordinates other than (0, 0) inside an inclusive box."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude")})
    return out.where(valid_position(F.col("latitude"), F.col("longitude")) & in_box(F.col("latitude"), F.col("longitude"), box))


def precision_report(df: DataFrame) -> DataFrame:
    """Rows by the decimal places of latitude and longitude."""
    places = df.select(decimal_places(F.col("latitude")).alias("lat_precision"), decimal_places(F.col("longitude")).alias("lon_precision"))
    return places.groupBy("lat_precision", "lon_precision").agg(F.count(F.lit(1)).alias("count"))


def first_of(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row of each key, the first in a total order; null keys are equal."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def dedupe(df: DataFrame, order: list[str | Column], keys: tuple[str, ...] = ("species_name", "latitude", "longitude", "observation_date")) -> DataFrame:
    """Exact repeats of the keys reduced to one; undated repeats are repeats too."""
    return first_of(df, list(keys), order)


def first_non_null(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, with each other column's first value that isn't null in the given order; rows with a null key go."""
    full = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = [c for c in df.columns if c not in keys]
    out = df.dropna(subset=keys).withColumns({f"__{c}": F.first(c, ignorenulls=True).over(full) for c in rest} | {"__n": F.row_number().over(W.partitionBy(*keys).orderBy(*order))})
    return out.where("__n = 1").select(*[F.col(c) if c in keys else F.col(f"__{c}").alias(c) for c in df.columns])


def taxonomy_report(df: DataFrame, name: str = "species_name") -> DataFrame:
    """Distinct (original_name, cleaned_name, modified_flag)."""
    out = df.where(F.col(name).isNotNull()).select(F.col(name).alias("original_name")).distinct()
    out = out.withColumn("cleaned_name", binomial(F.col("original_name")))
    return out.withColumn("modified_flag", was_modified(F.col("original_name"), F.col("cleaned_name")))


def clean_names(df: DataFrame, name: str = "species_name") -> DataFrame:
    return df.withColumn(name, binomial(F.col(name))).where(F.col(name).isNotNull() & (F.col(name) != INVALID))


def monthly_presence(df: DataFrame) -> DataFrame:
    return df.groupBy("species_name", "month").agg(F.count(F.lit(1)).alias("records"))


def species_score(df: DataFrame, least: int = 50, summer_max: float = 0.01, score_min: float = 1.5, score_summer_max: float = 0.05, blocked: tuple[str, ...] = ENDEMIC) -> DataFrame:
    """Seasonality of each species and whether it is retained as migratory.

    migration_score = 2 * winter share - 3 * summer share + 1 / (entropy + 0.1), with the natural-log entropy
    of the months' shares. Ties for the peak month go to the earliest. Counts come from one aggregate by
    (species, month), so the second works on twelve rows a species.
    """
    m = monthly_presence(df)
    per = m.groupBy("species_name").agg(
        F.sum("records").alias("total_count"),
        F.sum(F.when(F.col("month").isin(*SUMMER), F.col("records")).otherwise(0)).alias("summer"),
        F.sum(F.when(F.col("month").isin(*WINTER), F.col("records")).otherwise(0)).alias("winter"),
        F.count(F.lit(1)).alias("active_months"),
        F.max_by("month", F.struct("records", -F.col("month"))).alias("peak_month"),
        F.sum(F.col("records") * F.ln("records")).alias("weighed"),
    )
    total = F.col("total_count")
    per = per.withColumns({"summer_ratio": F.col("summer") / total, "winter_ratio": F.col("winter") / total, "entropy_score": F.when(F.col("active_months") > 1, F.ln(total) - F.col("weighed") / total).otherwise(0.0)})
    per = per.withColumn("migration_score", F.col("winter_ratio") * 2 - F.col("summer_ratio") * 3 + 1 / (F.col("entropy_score") + 0.1))
    enough = total >= least
    meets = enough & ((F.col("summer_ratio") <= summer_max) | ((F.col("migration_score") >= score_min) & (F.col("summer_ratio") <= score_summer_max)))
    kept = ~F.col("species_name").isin(*blocked) & meets
    return per.select("species_name", "total_count", "summer_ratio", "winter_ratio", "peak_month", "active_months", "entropy_score", "migration_score", F.when(kept, "retained").otherwise("removed").alias("retained_or_removed"))


def keep_species(df: DataFrame, scores: DataFrame) -> DataFrame:
    return df.join(scores.where("retained_or_removed = 'retained'").select("species_name"), "species_name", "left_semi")


def draw_order(keys: list[str], seed: int = 42) -> Column:
    """A seeded random order that depends on the row's keys alone."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))


def thin(df: DataFrame, keys: list[str], places: int = 3, per_cell: int = 4, seed: int = 42) -> DataFrame:
    """At most one record a species and ``per_cell`` records in each rounded cell, drawn at random; rounding is half to even."""
    out = df.withColumns({"latitude": F.bround("latitude", places), "longitude": F.bround("longitude", places), "__draw": draw_order(keys, seed)})
    one = F.row_number().over(W.partitionBy("latitude", "longitude", "species_name").orderBy("__draw"))
    some = F.row_number().over(W.partitionBy("latitude", "longitude").orderBy("__draw"))
    return out.withColumn("__n", one).where("__n = 1").withColumn("__n", some).where(F.col("__n") <= per_cell).drop("__n", "__draw")


def thinning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: records and species before and after, largest and mean density of a cell."""
    cells = after.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("max_grid_density"), F.avg("n").alias("mean_grid_density"))
    count = lambda f, k: f.agg(F.count(F.lit(1)).alias(f"{k}_records"), F.count_distinct("species_name").alias(f"{k}_species"))
    return count(before, "original").crossJoin(count(after, "final")).crossJoin(cells)


def grid_density(df: DataFrame) -> DataFrame:
    """Records and species richness of each cell."""
    return df.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("density"), F.count_distinct("species_name").alias("richness"))


def attrition(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """(step, records, species) of each named stage."""
    rows = [f.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("species_name").alias("species")).select(F.lit(name).alias("step"), "records", "species") for name, f in steps]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def step_counts(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """(step, records, species) of steps that are conditions on the same rows, from one pass: counts by species, then over these."""
    flags = {name: F.coalesce(c, F.lit(False)) for name, c in steps.items()}
    per = df.groupBy("species_name").agg(*[F.count_if(c).alias(name) for name, c in flags.items()])
    counted = F.col("species_name").isNotNull()
    row = per.agg(*[F.array(F.coalesce(F.sum(F.col(f"`{n}`")), F.lit(0)), F.count_if(counted & (F.col(f"`{n}`") > 0))).alias(n) for n in steps])
    out = row.unpivot([], [f"`{n}`" for n in steps], "step", "v")
    return out.select("step", F.col("v")[0].alias("records"), F.col("v")[1].alias("species"))


def region_year_coverage(df: DataFrame, split: float = 10.5) -> DataFrame:
    """Per year: records of each region and in all, and species richness; zero where a region has none."""
    where = region(F.col("latitude"), split)
    return df.groupBy("year").agg(F.count_if(where == "Andaman").alias("andaman_records"), F.count_if(where == "Nicobar").alias("nicobar_records"), F.count(F.lit(1)).alias("total_records"), F.count_distinct("species_name").alias("richness"))


def validation_gate(df: DataFrame, species_before: DataFrame, box: tuple[float, float, float, float] = (6.0, 14.0, 92.0, 94.5), years: tuple[int, int] = (2005, 2025), density: int = 4, retention: float = 90.0) -> DataFrame:
    """(status, message): PASS, or FAIL with what failed, joined by `` | ``. No species at all can't be retained and fails nothing."""
    cells = df.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("densest"))
    named = df.agg(F.count_distinct("species_name").alias("after"))
    total = species_before.agg(F.count_distinct("species_name").alias("before"))
    critical = [F.col(c).isNull().cast("int") for c in ("latitude", "longitude", "species_name", "year", "month")]
    rows = df.agg(
        F.count_if(~in_box(F.col("latitude"), F.col("longitude"), box)).alias("outside"), F.count_if(~F.col("year").between(*years)).alias("off_years"), F.coalesce(F.sum(sum(critical[1:], critical[0])), F.lit(0)).alias("nulls")
    )
    one = rows.crossJoin(cells).crossJoin(named).crossJoin(total)
    kept = F.try_divide(F.col("after") * 100.0, F.col("before"))
    messages = [  # the report's texts, fixed values
        F.when(kept < retention, F.concat(F.lit("Species retention "), F.round(kept, 1).cast("string"), F.lit(f"% < {retention:.0f}%"))),
        F.when(F.col("densest") > density, F.concat(F.lit("Max grid density "), F.col("densest").cast("string"), F.lit(f" > {density}"))),
        F.when(F.col("outside") > 0, F.lit("Coordinates outside bounds")),
        F.when(F.col("off_years") > 0, F.lit(f"Years outside {years[0]}-{years[1]}")),
        F.when(F.col("nulls") > 0, F.concat(F.lit("Found "), F.col("nulls").cast("string"), F.lit(" nulls in critical columns"))),
    ]
    failed = F.array_compact(F.array(*messages))
    return one.select(F.when(F.size(failed) > 0, "FAIL").otherwise("PASS").alias("status"), F.when(F.size(failed) > 0, F.array_join(failed, " | ")).otherwise("All thresholds passed").alias("message"))


def assert_gate(gate: DataFrame) -> None:
    """Raises if the gate's one row says FAIL, so that nothing after it is written."""
    row = gate.first()
    if row.status == "FAIL":
        raise ValueError(f"validation failed: {row.message}")


def value_counts(df: DataFrame, column: str, normalised: bool = False) -> DataFrame:
    """Counts of non-null values, or their shares."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    if not normalised:
        return out
    total = out.agg(F.sum("count").alias("__all"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.col("count") / F.col("__all")).drop("__all")
