import datetime as dt

import pytest
from pyspark.sql import functions as F

from kestrelgrid.functions.coords import decimal_places
from kestrelgrid.functions.names import binomial
from kestrelgrid.operators import occurrence as occ


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Anas sp.", "INVALID_TAXON"), ("Anas cf. crecca", "INVALID_TAXON"), ("A x B", "INVALID_TAXON"), ("Calidris alba (Pallas, 1764)", "Calidris alba"),
        ("Corvus", "INVALID_TAXON"), ("", "INVALID_TAXON"), ("CALIDRIS ALBA", "Calidris alba"), ("white-throated  kingfisher", "White-throated kingfisher"), ("Anas crecca", "Anas crecca"), (None, None),
    ],
)
def test_binomial(spark, name, want):
    assert rows(spark, [(name,)], "n string").select(binomial(F.col("n")).alias("b")).first().b == want


@pytest.mark.parametrize(("value", "want"), [(1.5, 1), (11.6234, 4), (0.0001, 4), (1e-7, 7), (12.0, 1), (-93.25, 2), (1.5e10, 0)])
def test_decimal_places(spark, value, want):
    assert rows(spark, [(value,)], "v double").select(decimal_places(F.col("v")).alias("p")).first().p == want


def test_species_score_limits_and_ties(spark):
    data = [("Winter bird", 1)] * 50 + [("Rare bird", 1)] * 49 + [("Ninox affinis", 1)] * 60 + [("Summer bird", 6)] * 60 + [("Tie bird", 3), ("Tie bird", 2)]
    got = {r.species_name: r for r in occ.species_score(rows(spark, data, "species_name string, month int")).collect()}
    assert {k for k, r in got.items() if r.retained_or_removed == "retained"} == {"Winter bird"}
    assert got["Tie bird"].peak_month == 2
    assert got["Winter bird"].entropy_score == 0.0
    assert got["Winter bird"].migration_score == pytest.approx(12.0)


def test_undated_repeats_collapse(spark):
    data = [(1, "a b", 7.0, 93.0, None), (2, "a b", 7.0, 93.0, None), (3, "a b", 7.0, 93.0, dt.datetime(2010, 1, 1))]
    df = rows(spark, data, "id int, species_name string, latitude double, longitude double, observation_date timestamp_ntz")
    assert sorted(r.id for r in occ.dedupe(df, ["id"]).collect()) == [1, 3]


def test_box_edges_are_inside_and_zero_goes(spark):
    data = [("6.0", "92.0"), ("14.0", "94.5"), ("0", "0"), ("5.999", "93"), ("x", "93"), (None, "93")]
    assert occ.spatial_filter(rows(spark, data, "latitude string, longitude string")).count() == 2


def test_unparseable_dates_are_null_and_years_fill(spark):
    df = rows(spark, [("2010-05-03", None), ("junk", 2011), ("junk", None)], "d string, year int")
    df = df.withColumns({"observation_date": occ.parse_date(F.col("d")), "month": F.lit(None).cast("int")})
    assert [(r.year, r.month) for r in occ.fill_dates(df).collect()] == [(2010, 5)]


def test_thinning_keeps_one_a_species_and_four_a_cell(spark):
    data = [(i, f"s{i % 6}", 7.0001 + (i % 3) * 1e-5, 93.0) for i in range(60)]
    out = occ.thin(rows(spark, data, "id int, species_name string, latitude double, longitude double"), ["id"])
    got = [(r.species_name, r.latitude) for r in out.collect()]
    assert len(got) == 4 == len(set(got))


def test_gate_reports_every_failure(spark):
    df = rows(spark, [(7.0, 93.0, "a b", 2010, 1), (20.0, 93.0, "a b", 1999, None)], "latitude double, longitude double, species_name string, year int, month int")
    g = occ.validation_gate(df, df).first()
    assert g.status == "FAIL"
    assert g.message == "Coordinates outside bounds | Years outside 2005-2025 | Found 1 nulls in critical columns"
    with pytest.raises(ValueError, match="validation failed"):
        occ.assert_gate(occ.validation_gate(df, df))


def test_gate_without_species_passes(spark):
    df = rows(spark, [], "latitude double, longitude double, species_name string, year int, month int")
    assert occ.validation_gate(df, df).first().status == "PASS"


def test_observer_share_counts_rows_without_an_observer(spark):
    df = rows(spark, [("a",)] * 6 + [("b",)] * 2 + [(None,)] * 2, "observer_name string")
    r = occ.observer_share(df).first()
    assert (r.total_observers, r.top_1_pct_contribution, r.top_10_pct_contribution) == (2, 0.6, 0.6)


def test_first_non_null_is_by_column(spark):
    df = rows(spark, [(1, None, "x", 1), (1, "v", None, 2), (None, "w", "y", 3)], "k int, a string, b string, o int")
    (r,) = occ.first_non_null(df, ["k"], [F.col("o")]).collect()
    assert (r.k, r.a, r.b) == (1, "v", "x")


def test_retention_percent_has_one_decimal_and_attrition_counts(spark):
    df = rows(spark, [("a",), ("a",), (None,)], "species_name string")
    assert [tuple(r) for r in occ.attrition([("1", df), ("2", df.limit(0))]).collect()] == [("1", 3, 1), ("2", 0, 0)]
