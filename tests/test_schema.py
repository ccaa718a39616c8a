import pytest
from pyspark.sql import functions as F

from obsmill.schema import bad_cells, require_columns, typed


def raw(spark, *values, year="2024"):
    rows = [("A", "Crop", "Production", year, "t", v) for v in values]
    return spark.createDataFrame(
        rows, "Area string, Item string, Element string, Year string, Unit string, Value string"
    )


def test_required_columns(spark):
    with pytest.raises(ValueError, match="Value"):
        require_columns(raw(spark, "1").drop("Value"))


def test_typed_keeps_other_columns_and_turns_nan_into_null(spark):
    rows = typed(raw(spark, "12", "NaN", None).withColumn("Note", F.lit("x")))
    assert rows.schema["Year"].dataType.simpleString() == "int"
    assert [r.Value for r in rows.collect()] == [12.0, None, None]
    assert rows.columns[-1] == "Note"


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_malformed_cell_fails_the_load(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="INVALID"):
            typed(raw(spark, "12", "INVALID")).collect()
        with pytest.raises(Exception, match="20x4"):
            typed(raw(spark, "12", year="20x4")).collect()
        assert typed(raw(spark, "12")).first().Value == 12.0
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_bad_cells_names_column_and_content(spark):
    found = bad_cells(raw(spark, "12", "INVALID", None, year="20x4")).collect()
    assert sorted((r.bad_column, r.bad_cell) for r in found) == [
        ("Value", "INVALID"), ("Year", "20x4"), ("Year", "20x4"), ("Year", "20x4"),
    ]
