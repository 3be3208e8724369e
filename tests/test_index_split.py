import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators.index import (as_series, index_series, longest_of, rechunk, single_chunk, with_halo,
                                        with_series_mean)
from chronoloom.operators.split import chrono_split, holdout_split


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def tied(spark):
    """Many rows per instant; one series holds two thirds of the rows."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"s{i % 4}", rng.randrange(20), i, rng.random()) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, id int, v double")
    return as_series(df.withColumn("t", F.expr("timestamp_ntz'2020-01-01' + make_interval(0,0,0,t)")),
                     ["t", "v"], "k", ["id"])


def test_ranged_index_equals_window_index(tied):
    a = index_series(tied, ["id"])
    b = index_series(tied, ["id"], rows_per_task=0, chunk_rows=50)
    assert rows_of(a, "series_id", "seq", "n", "value") == rows_of(b, "series_id", "seq", "n", "value")
    assert single_chunk(a) and not single_chunk(b)
    assert b.agg(F.max("chunk")).first()[0] == (longest_of(b) - 1) // 50


def test_index_does_not_depend_on_partitions(tied):
    a = index_series(tied.repartition(1), ["id"])
    b = index_series(tied.repartition(7, "value"), ["id"])
    assert rows_of(a, "series_id", "seq", "value") == rows_of(b, "series_id", "seq", "value")


def test_no_single_partition_exchange(tied):
    plan = index_series(tied, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_halo_gives_each_chunk_the_rows_before_it(make):
    df = make({"a": range(1, 23)}, chunk_rows=5)
    got = with_halo(df, 7).groupBy("chunk").agg(F.sort_array(F.collect_list("seq")).alias("seqs")).orderBy("chunk")
    for r in got.collect():
        start = r["chunk"] * 5
        assert r["seqs"] == list(range(max(1, start - 6), min(start + 5, 22) + 1))


def test_series_mean_in_chunks(make):
    df = make({"a": range(1, 23), "b": [5, 5]}, chunk_rows=5)
    got = {(r[0], r[1]) for r in with_series_mean(with_halo(df, 3)).select("series_id", "mean").distinct().collect()}
    assert got == {("a", 11.5), ("b", 5.0)}


def test_two_columns_rule(tied):
    with pytest.raises(ValueError):
        as_series(tied, ["ts"])
    with pytest.raises(ValueError):
        as_series(tied, ["ts", "value", "id"])


@pytest.mark.parametrize("ratio,n,k", [
    ("0.8", 10, 8), ("0.29", 100, 28), ("0.57", 100, 56), ("0.58", 100, 56), ("0.58", 200, 113), ("1", 5, 5)])
def test_chrono_split_point(make, ratio, n, k):
    """Twice truncated in double arithmetic: "0.58" is 57 %, and 57 % of 100 rows are 56."""
    assert k == int(n * (int(float(ratio) * 100) / 100))
    counts = dict(chrono_split(make({"a": range(n)}), ratio).groupBy("split").count().collect())
    assert counts["train"] == k and counts.get("test", 0) == n - k


@pytest.mark.parametrize("n", [1, 10, 90, 170, 180, 330, 340])
def test_holdout_point_uses_double_arithmetic(make, n):
    df = holdout_split(make({"a": range(n)}))
    assert df.select("k").first()[0] == int(n * 0.7)
    assert df.where("scored").count() == n - int(n * 0.7)


def test_empty_input(spark):
    df = index_series(spark.createDataFrame([], "series_id string, ts timestamp_ntz, value double"))
    assert chrono_split(df).count() == 0 and longest_of(df) == 0


def test_rechunk(make):
    df = rechunk(make({"a": range(10)}, chunk_rows=3), 4)
    assert rows_of(df, "seq", "chunk") == [(i, (i - 1) // 4) for i in range(1, 11)]


def _two(make):
    """A short and a longer series, each indexed on its own with chunks of 4 rows, and both together."""
    a, b = {"a": [0.0, 1.0, 4.0]}, {"b": [float(i * i) for i in range(10)]}
    return make(a, chunk_rows=4), make(b, chunk_rows=4), make(a | b, chunk_rows=4)


def _results(df):
    """What operators make of a table, whatever its counts say."""
    from chronoloom.operators import arima, correlation, forecast, scale, search, stationarity
    from chronoloom.operators.difference import difference

    grid = search.candidate_grid(df, search.OrderGrid([1], [0, 1], [0]))
    plan = [scale.ScaleStep("value", scale.NORMALIZATION)]
    frames = {
        "difference": difference(df).select("series_id", "seq", "value"),
        "acf": correlation.acf(df).select("series_id", "lag", F.round("value", 9)),
        "adf": stationarity.adf_test(df, 1).select("series_id", "d", "lags", F.round("statistic", 6)),
        "forecast": forecast.closed_form_forecasts(df).select("series_id", "seq", *[F.round(c, 9) for c in ("f_0_0_0", "f_1_0_0")]),
        "scaled": scale.apply_scaler(df, scale.scale_fit(df, plan), plan).select("series_id", "seq", "value"),
        "arima": arima.rolling_steps(df, grid, max_p=1, max_d=1, max_q=0).select("series_id", "p", "d", "seq", F.round("forecast", 6)),
    }
    return {k: sorted(map(tuple, f.collect()), key=repr) for k, f in frames.items()}


def test_counts_of_one_side_do_not_speak_for_a_union(make):
    a, b, both = _two(make)
    want = _results(both)
    assert want["difference"][-1] == ("b", 9, 15.0) or ("b", 9, 15.0) in want["difference"]
    assert _results(a.unionByName(b)) == want
    assert _results(b.unionByName(a)) == want


def test_counts_of_one_file_do_not_speak_for_a_folder(make, spark, tmp_path):
    a, b, both = _two(make)
    path = str(tmp_path / "indexed")
    a.write.parquet(path)
    b.write.mode("append").parquet(path)
    assert _results(spark.read.parquet(path)) == _results(both)


def test_counts_may_be_missing(make, spark):
    _, _, both = _two(make)
    bare = spark.createDataFrame(both.collect(), both.schema.simpleString()[7:-1].replace(":", " "))
    assert _results(bare) == _results(both)


def test_broadcast_bounds_are_counted_again_after_a_union(make, monkeypatch):
    from chronoloom.operators import index

    a, b, _ = _two(make)
    union = a.unionByName(b)
    assert index.counted(a) is a
    assert index._metadata(index.counted(union), "seq", "series") == 2
    monkeypatch.setattr(index, "BROADCAST_ROWS", 1)
    per_series = union.groupBy("series_id").agg(F.max("value").alias("top"))
    plan = index.few_series(per_series, index.counted(union))._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plan and "broadcast" not in plan.lower()


def test_no_id_and_an_empty_id_are_two_series(spark):
    rows = spark.createDataFrame([(None, 1, 1.0), ("", 1, 2.0), (None, 2, 3.0), ("", 2, 5.0)], "id string, t int, v double")
    df = index_series(as_series(rows.withColumn("t", F.date_add(F.lit("2020-01-01"), F.col("t"))), ["t", "v"], "id"))
    assert sorted((r["n"], r["seq"], r["value"]) for r in df.collect()) == [(2, 1, 1.0), (2, 1, 2.0), (2, 2, 3.0), (2, 2, 5.0)]
    assert df.select("series_id").distinct().count() == 2
