"""What the physical plans must and must not contain."""

import pytest

from chronoloom.operators import arima, correlation, difference, scale, search, stationarity
from chronoloom.operators.index import index_series, longest_of
from chronoloom.operators.split import chrono_split


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def shuffles(df):
    return plan_of(df).count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    spark.range(2000).selectExpr(
        "concat('s', id % 7) AS series_id", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, id) AS ts",
        "cast(id * id % 101 AS double) AS value").write.parquet(path)
    return spark.read.parquet(path)


def test_short_series_keep_the_one_shuffle_of_the_index(table):
    rows = index_series(table)
    for df in (rows, chrono_split(rows), difference.difference(rows, 2), correlation.acf(rows), correlation.pacf(rows),
               stationarity.adf_test(rows, 2)):
        assert shuffles(df) == 1
        assert "SinglePartition" not in plan_of(df)


def test_scaling_broadcasts_the_parameters(table):
    rows = index_series(table)
    assert "BroadcastHashJoin" in plan_of(scale.minmax_scale(rows))
    assert "SortMergeJoin" not in plan_of(scale.minmax_scale(rows))


def test_no_broadcast_without_a_bound(table, monkeypatch):
    from chronoloom.operators import index
    monkeypatch.setattr(index, "BROADCAST_ROWS", 0)
    rows = index_series(table, chunk_rows=50)
    table.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = scale.minmax_scale(rows)
        assert "Broadcast" not in plan_of(got)
        assert got.count() == 2000
    finally:
        table.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_series_are_grouped_by_chunk(table):
    rows = index_series(table, rows_per_task=0, chunk_rows=64)
    for df in (difference.difference(rows), correlation.acf(rows), stationarity.adf_test(rows)):
        plan = plan_of(df)
        assert "SinglePartition" not in plan
        assert "hashpartitioning(series_id" in plan and "chunk" in plan


def test_columns_are_pruned_and_counts_travel(table, spark, tmp_path):
    wide = table.withColumn("extra", table["value"] * 2)
    rows = index_series(wide)
    assert "extra" not in plan_of(rows)
    rows.write.parquet(str(tmp_path / "indexed"))
    back = spark.read.parquet(str(tmp_path / "indexed"))
    assert longest_of(back) == 286 == longest_of(rows)
    assert back.schema["seq"].metadata["rows"] == 2000


def test_search_has_no_cartesian_product(table):
    rows = index_series(table)
    candidates = search.candidate_grid(rows, search.OrderGrid([0, 1], [0, 1], [0, 1]))
    scored = search.score_candidates(rows, candidates)
    assert "CartesianProduct" not in plan_of(scored) and "NestedLoop" not in plan_of(scored)
    steps = arima.rolling_steps(rows, candidates, max_p=1, max_d=1, max_q=1)
    assert "SinglePartition" not in plan_of(steps)
