"""Models carried forward: forecasts equal the recursion from the start, however the rows come in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import carry

MODELS = [("a", 1, 0, 1, 2.0, [0.5], [-0.4]), ("b", 2, 1, 2, 0.0, [0.3, -0.1], [0.4, 0.2]), ("c", 1, 0, 0, 1.0, [0.7], []),
          ("d", 0, 2, 1, 0.0, [], [-0.99]), ("none", 1, 1, 1, 0.0, [0.1], [0.1])]
SCHEMA = "series_id string, p int, d int, q int, const double, ar array<double>, ma array<double>"


def direct(y, p, d, const, ar, ma):
    """Forecasts by the recursion, written out."""
    w = np.diff(y, n=d)
    e, out = [], [None] * d
    for t in range(len(w)):
        expected = const + sum(f * w[t - 1 - i] for i, f in enumerate(ar) if t > i) + sum(m * e[t - 1 - j] for j, m in enumerate(ma) if t > j)
        e.append(w[t] - expected)
        out.append(y[t + d] - e[-1])
    return out, e


@pytest.fixture
def values():
    rng = np.random.default_rng(3)
    return {"a": rng.normal(3, 1, 130), "b": np.cumsum(rng.normal(size=97)), "c": rng.normal(size=41), "d": np.cumsum(rng.normal(size=64)), "x": [1.0]}


def rows_of(spark, values, low, high):
    rows = [(k, i + 1, float(v)) for k, y in values.items() for i, v in enumerate(y) if low <= i < high]
    return spark.createDataFrame(rows, "series_id string, seq bigint, value double").repartition(3)


@pytest.mark.parametrize("chunk_rows", [1000, 16, 5])
def test_in_parts_as_from_the_start(spark, values, chunk_rows):
    models = carry.without_history(spark.createDataFrame(MODELS, SCHEMA))
    found = {}
    for low, high in ((0, 30), (20, 31), (31, 200)):  # older rows come again and are left out
        forecasts, models = carry.carry_forward(models, rows_of(spark, values, low, high), chunk_rows)
        for r in forecasts.collect():
            assert (r["series_id"], r["seq"]) not in found
            found[r["series_id"], r["seq"]] = r["forecast"]
        models = spark.createDataFrame(models.collect(), models.schema)  # as if stored
    state = {r["series_id"]: r for r in models.collect()}
    for series, p, d, q, const, ar, ma in MODELS:
        if series == "none":
            assert (state[series]["n"], state[series]["last"], state[series]["residuals"]) == (0, [], [])
            continue
        want, e = direct(values[series], p, d, const, ar, ma)
        assert [found.pop((series, k + 1)) for k in range(len(want))] == [None if x is None else pytest.approx(x, abs=1e-9) for x in want]
        assert state[series]["n"] == len(values[series])
        assert state[series]["last"] == pytest.approx(list(values[series][len(values[series]) - p - d:]))
        assert state[series]["residuals"] == pytest.approx(e[len(e) - q:], abs=1e-9)
    assert not found


def test_nothing_new(spark, values):
    models = carry.without_history(spark.createDataFrame(MODELS, SCHEMA))
    forecasts, same = carry.carry_forward(models, rows_of(spark, values, 0, 0))
    assert forecasts.collect() == [] and same.where(F.col("n") == 0).count() == len(MODELS)
    forecasts, same = carry.carry_forward(models.limit(0), rows_of(spark, values, 0, 9))
    assert forecasts.collect() == [] and same.collect() == []
