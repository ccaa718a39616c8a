import pytest
from pyspark.sql import functions as F

from obsmill.operators.measures import (
    aggregate, duplicate_observations, paired_yield_area, total, weighted_yield, yield_coverage,
)


def yields(df, groups=("Year",)):
    return {tuple(r[g] for g in groups): r.Value for r in weighted_yield(df, list(groups)).collect()}


def test_weighted_yield(sample):
    assert yields(sample) == {(2024,): 20000.0}


def test_missing_yield_is_neither_zero_nor_rebuilt(sample):
    gone = F.when((F.col("Area") == "B") & (F.col("Element") == "Yield"), None).otherwise(F.col("Value"))
    assert yields(sample.withColumn("Value", gone)) == {(2024,): None}
    assert yields(sample.where("not (Area = 'B' and Element = 'Yield')")) == {(2024,): None}


def test_zero_or_missing_area_in_a_larger_group(sample):
    hit = (F.col("Area") == "B") & (F.col("Element") == "Area harvested")
    assert yields(sample.withColumn("Value", F.when(hit, 0.0).otherwise(F.col("Value")))) == {(2024,): None}
    assert yields(sample.where(~hit)) == {(2024,): None}


def test_single_observation_keeps_its_published_yield(sample):
    alone = sample.where("Area = 'A' and Element <> 'Area harvested'")
    assert yields(alone) == {(2024,): 5000.0}
    assert yields(sample, ("Area", "Year")) == {("A", 2024): 5000.0, ("B", 2024): 30000.0}


def test_documented_row_uses_published_figures(observe):
    rows = observe(
        [
            ("E", "Cocoa", 2024, "Production", "t", 403698.83),
            ("E", "Cocoa", 2024, "Area harvested", "ha", 541588.0),
            ("E", "Cocoa", 2024, "Yield", "kg/ha", 745.4),
        ]
    )
    assert yields(rows) == {(2024,): 745.4}


def test_unknown_yield_unit_stays_in_the_universe(sample, observe):
    rows = sample.unionByName(observe([("C", "Crop", 2024, "Yield", "lb/acre", 9.0)]))
    assert yields(rows) == {(2024,): None}


def test_null_keys_pair_up_and_form_groups(observe):
    rows = observe(
        [(None, "Crop", 2024, "Yield", "kg/ha", 7.0), (None, "Crop", 2024, "Area harvested", "ha", 2.0)]
    )
    assert [tuple(r) for r in paired_yield_area(rows).collect()] == [(None, "Crop", 2024, 7.0, 2.0)]
    assert yields(rows, ("Area",)) == {(None,): 7.0}


def test_two_yields_for_one_key_are_an_error(sample, observe):
    rows = sample.unionByName(observe([("A", "Crop", 2024, "Yield", "hg/ha", 1.0)]))
    assert [tuple(r) for r in duplicate_observations(rows).collect()] == [("A", "Crop", 2024, 2, 1)]
    with pytest.raises(Exception, match="more than one"):
        paired_yield_area(rows).collect()


def test_yields_group_by_keys_only(sample):
    with pytest.raises(ValueError):
        weighted_yield(sample, ["Unit"])


def test_sums_do_not_mix_units_and_keep_missing(sample, observe):
    rows = sample.unionByName(
        observe([("A", "Crop", 2024, "Production", "kg", 1.0), ("C", "Crop", 2024, "Production", "t", None)])
    )
    got = {(r.Area, r.Unit): r.Value for r in aggregate(rows, "Production", ["Area", "Year"]).collect()}
    assert got == {("A", "t"): 10.0, ("A", "kg"): 1.0, ("B", "t"): 90.0, ("C", "t"): None}


def test_total(sample):
    assert total(sample, "Production", 2024, "t").first().Value == 100.0
    assert total(sample, "Production", 1999, "t").first().Value is None


def test_coverage(sample):
    row = yield_coverage(sample.where("not (Area = 'B' and Element = 'Yield')"), ["Year"]).first()
    assert tuple(row) == (2024, 2, 1, 2, 2)
