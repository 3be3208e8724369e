import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import columns as fn
from chronoloom.operators import prepare, scale
from chronoloom.operators.split import chrono_split
from chronoloom.operators.scale import COMBINED, NORMALIZATION, STANDARDIZATION, ScaleStep


def column(df, name="value"):
    return [r[0] for r in df.orderBy("series_id", "seq").select(name).collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_minmax_and_zscore_of_h(make, h):
    df = make({"a": h})
    assert column(scale.minmax_scale(df))[:3] == pytest.approx([0, 1 / 45, 3 / 45])
    z = column(scale.zscore_scale(df))
    assert z[0] == pytest.approx(-1.056665, abs=1e-6)
    assert np.std(z, ddof=1) == pytest.approx(1.0)


def test_constant_series(make):
    df = make({"a": [3, 3, 3]})
    assert column(scale.minmax_scale(df)) == [0.5] * 3
    assert column(scale.zscore_scale(df)) == [0.0] * 3


def test_chain_equals_two_passes(make, h):
    df = make({"a": h, "b": [5, 1, 9], "c": [4, 4]})
    plan = [ScaleStep("value", COMBINED)]
    chained = column(scale.apply_scaler(df, scale.scale_fit(df, plan), plan))
    twice = column(scale.minmax_scale(scale.zscore_scale(df)))
    assert chained == pytest.approx(twice)


@pytest.mark.parametrize("method", [NORMALIZATION, STANDARDIZATION, COMBINED])
@pytest.mark.parametrize("chunk_rows", [1000, 4])
def test_invert_is_identity(make, h, method, chunk_rows):
    df = make({"a": h, "b": [2, 2, 2]}, chunk_rows=chunk_rows)
    plan = [ScaleStep("value", method)]
    scaler = scale.scale_fit(df, plan)
    back = scale.invert_scaler(scale.apply_scaler(df, scaler, plan), scaler, plan)
    assert column(back) == pytest.approx(column(df))


def test_test_part_uses_training_parameters(make, h):
    df = chrono_split(make({"a": h}))
    plan = [ScaleStep("value", NORMALIZATION)]
    scaler = scale.scale_fit(df.where("split = 'train'"), plan)
    assert column(scale.apply_scaler(df.where("split = 'test'"), scaler, plan)) == pytest.approx([36 / 28, 45 / 28])


def test_unknown_method():
    with pytest.raises(ValueError):
        scale._expand([ScaleStep("value", "log")])


def test_validate_counts(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [("a", t, 1.0), ("a", t, None), ("a", None, float("nan")), ("a", None, 2.0), ("a", t, float("inf"))]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")
    assert tuple(prepare.validate_series(df).first()) == ("a", 5, 2, 2, 3)
    with pytest.raises(ValueError):
        prepare.check_schema(df.drop("value"))
    with pytest.raises(ValueError):
        prepare.check_schema(df.withColumn("ts", F.col("ts").cast("string")))


def test_parse_time(spark):
    for text, want in [("2020-02-01", dt.datetime(2020, 2, 1)), ("2020-02-01 10:00:05", dt.datetime(2020, 2, 1, 10, 0, 5)),
                       ("2020-02-01T10:00:05.25", dt.datetime(2020, 2, 1, 10, 0, 5, 250000)),
                       ("02/01/2020", dt.datetime(2020, 2, 1)), ("soon", None)]:
        assert one(spark, fn.parse_time(F.lit(text)).cast("timestamp_ntz")) == want


def test_truncate_and_fill(spark):
    assert [one(spark, fn.truncate_value(F.lit(v))) for v in (2.9, -2.9)] == [2, -2]
    assert [one(spark, fn.fill_missing(F.lit(v).cast("double"))) for v in (None, float("nan"), 3.0)] == [0.0, 0.0, 3.0]


def test_absolute_percentage_with_zero_actual(spark):
    pct = lambda a, f: one(spark, fn.absolute_percentage(F.lit(a), F.lit(f).cast("double")))
    assert pct(0.0, 1.0) == math.inf
    assert math.isnan(pct(0.0, 0.0))
    assert pct(-4.0, -3.0) == 0.25
    assert pct(0.0, None) is None


def test_text_fields(spark):
    assert one(spark, fn.int_list(F.lit("[1, 2,3]"))) == [1, 2, 3]
    assert one(spark, fn.int_list(F.lit("0"))) == [0]
    parsed = one(spark, fn.order_from_text(F.lit("(1.5e-05, (2, 1, 0))")))
    assert tuple(parsed) == (1.5e-05, 2, 1, 0)
    text = one(spark, fn.order_to_text(F.lit(7.25), F.lit(1), F.lit(0), F.lit(2)))
    assert text == "(7.25, (1, 0, 2))"


def test_filter_date_range_is_inclusive(make, h):
    df = make({"a": h})
    assert prepare.filter_date_range(df, "2020-01-02", "2020-01-02").count() == 1
    assert prepare.filter_date_range(df, "2020-01-02", "2020-01-04").count() == 3
