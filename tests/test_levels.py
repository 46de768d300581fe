"""One-hot encoding without levels on the driver."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from attrition.operators import features as FE


def test_slots_equal_the_indexer(spark):
    rows = [(i, v) for i, v in enumerate(["b"] * 5 + ["a"] * 5 + ["c"] * 2 + ["é"] * 9 + ["z"])]
    df = spark.createDataFrame(rows, "id int, c string").repartition(4)
    for drop in (True, False):
        mine, tables = FE.encode_levels(df, ["c"], drop_last=drop)
        other, labels = FE.encode_features(df, ["c"], drop_last=drop)
        assert ({r.id: r.v for r in mine.select("id", vector_to_array("cohe").alias("v")).collect()}
                == {r.id: r.v for r in other.select("id", vector_to_array("cohe").alias("v")).collect()})
    assert [r.level for r in tables["cohe"].orderBy("index").collect()] == ["é", "a", "b", "c", "z"] == labels["cohe"]


def test_null_levels(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "x")], "id int, c string")
    kept, _ = FE.encode_levels(df, ["c"], handle_invalid="keep", drop_last=False)
    got = {r.id: r.v for r in kept.select("id", F.array_position(vector_to_array("cohe"), F.lit(1.0)).alias("v")).collect()}
    assert got == {1: 1, 2: 3, 3: 2, 4: 1}
    with pytest.raises(Exception, match="null level"):
        FE.encode_levels(df, ["c"])[0].collect()


def test_a_million_levels(spark):
    df = spark.range(1_100_000).selectExpr("CASE WHEN id % 11 = 0 THEN 'hot' ELSE concat('l', id) END AS c")
    levels = FE.level_index(df, "c")
    assert levels.agg(F.count(F.lit(1)), F.min("index"), F.max("index")).first() == (1_000_001, 0.0, 1_000_000.0)
    assert levels.where("index = 0").first().level == "hot"
