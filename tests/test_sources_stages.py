import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators.search import OrderGrid
from chronoloom.operators.scale import NORMALIZATION, ScaleStep
from chronoloom.plans import stages
from chronoloom.sources import files, store
from chronoloom.sources.store import Layout
from chronoloom.sources.tables import (TableSource, range_predicates, read_table, read_table_range, reader_options,
                                       rows_to_frame, run_query)


@pytest.fixture
def prices(spark, tmp_path):
    """A Parquet table of two series, 90 days each."""
    day, rng = dt.datetime(2021, 1, 1), np.random.default_rng(2)
    rows = [(s, day + dt.timedelta(days=i), float(100 + rng.normal() + (i if s == "up" else 0)))
            for s in ("up", "flat") for i in range(90)]
    df = spark.createDataFrame(rows, "item string, day timestamp_ntz, price double")
    df.write.parquet(str(tmp_path / "tables/prices.parquet"))
    return TableSource("parquet", {"path": str(tmp_path / "tables")})


def test_database_options():
    source = TableSource.mysql("db.example.org", "shop", "u", "secret")
    options = reader_options(source, "shop.sales", "day", partitions=8, bounds=("2020-01-01", "2021-01-01"))
    assert options["url"] == "jdbc:mysql://db.example.org:3306/shop"
    assert options["dbtable"] == "shop.sales" and options["partitionColumn"] == "day"
    assert options["numPartitions"] == "8"
    assert "secret" not in repr(source)
    pg = reader_options(TableSource.postgres("h", "d", "u", "x"), "t", "day")
    assert pg["driver"] == "org.postgresql.Driver" and "partitionColumn" not in pg
    snow = TableSource.snowflake("acme", "D", "u", "x", schema="S", warehouse="W")
    assert snow.format == "snowflake" and reader_options(snow, "t", "day")["sfWarehouse"] == "W"
    with pytest.raises(ValueError):
        TableSource("paper")
    with pytest.raises(ValueError):
        reader_options(source, "sales; drop table x", "day")


def test_range_predicates_cover_everything_once():
    got = range_predicates("day", ["2020-01-01", "2021-01-01"])
    assert got == ["day < '2020-01-01' OR day IS NULL", "day >= '2020-01-01' AND day < '2021-01-01'", "day >= '2021-01-01'"]
    assert range_predicates("day", []) == ["1 = 1"]


def test_read_table_prunes_and_pushes(spark, prices):
    df = read_table_range(spark, prices, "prices", ["day", "price"], "2021-01-02", "2021-01-03")
    assert df.count() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day" in plan and "LessThanOrEqual(day" in plan
    assert "item" not in plan
    with pytest.raises(ValueError):
        read_table(spark, prices, "prices", ["day"])


def test_run_query_and_names(spark, prices):
    df = run_query(spark, prices, "SELECT day, CAST(price AS DECIMAL(10,2)) FROM prices WHERE item = 'up'", ["prices"])
    named = rows_to_frame(df)
    assert named.columns == ["ts", "value"] and named.schema["value"].dataType.simpleString() == "double"
    assert named.count() == 90
    with pytest.raises(ValueError):
        rows_to_frame(df, ["a"])


def test_raw_csv(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([("2020-01-01", "1.5"), ("2020-01-02", "oops"), ("never", "2")], "x string, y string").coalesce(
        1).write.option("header", True).csv(path)
    rows = files.read_series_csv(spark, path).orderBy("value").collect()
    assert sum(r["bad"] for r in rows) == 2 and len(rows) == 3
    assert (dt.date(2020, 1, 1), 1.5) in [(r["ts"], r["value"]) for r in rows]


def test_all_part_files_are_read(spark, tmp_path):
    path = str(tmp_path / "parts")
    df = spark.range(40).select(F.expr("timestamp_ntz'2020-01-01' + make_interval(0,0,0,id)").alias("ts"),
                                F.col("id").cast("double").alias("value")).repartition(4)
    files.write_raw_csv(df, path)
    assert files.read_series_dir(spark, path).count() == 40
    with pytest.raises(Exception):
        files.write_raw_csv(df, path)
    files.write_raw_csv(df, path, overwrite=True)
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(Exception):
        files.read_series_dir(spark, str(empty))


def test_newest_result_counts(spark, tmp_path):
    layout = Layout(str(tmp_path / "lay"))
    row = lambda m, p: spark.createDataFrame([("a", m, p, 0, 0, m, p, 0, 0, 3)], "series_id string, mape double, p int, d int, "
        "q int, ref_mape double, ref_p int, ref_d int, ref_q int, n_candidates bigint")
    for i, (m, p) in enumerate([(9.0, 1), (8.0, 2)]):
        for stage in ("tune", "train"):
            store.write_result(row(m, p), layout, "s", stage, dt.datetime(2024, 1, 1 + i))
    store.write_result(row(1.0, 7), layout, "other", "tune")
    results = store.read_results(spark, layout)
    assert tuple(store.best_hyperparameters(results, "s").first()) == ("a", 8.0, 2.0, 0.0, 0.0)
    assert tuple(store.load_trained_order(results, "s").first()) == ("a", 2, 0, 0)
    with pytest.raises(ValueError):
        store.write_result(row(1.0, 1), layout, "s", "guess")


def test_stages_end_to_end(spark, prices, tmp_path):
    layout = Layout(str(tmp_path / "run"))
    raw = stages.ingest(spark, prices, "prices", ["day", "price"], layout, "s", series="item")
    assert raw.count() == 180
    with pytest.raises(Exception):
        stages.ingest(spark, prices, "prices", ["day", "price"], layout, "s", series="item")

    split = stages.preprocess(raw, layout, "s", ratio="0.8", plan=[ScaleStep("value", NORMALIZATION)])
    assert dict(split.groupBy("split").count().collect()) == {"train": 144, "test": 36}
    assert split.where("split = 'train'").agg(F.max("value")).first()[0] == 1.0
    assert split.where("split = 'test'").agg(F.min("value")).first()[0] > 90  # test stays in original units
    both = stages.preprocess(raw, layout, "s", plan=[ScaleStep("value", NORMALIZATION)], scale_test=True)
    assert both.where("split = 'test' AND series_id = 'up'").agg(F.min("value")).first()[0] < 2

    hints = {r["series_id"]: r["d"] for r in stages.suggest(raw).collect()}
    assert set(hints) == {"up", "flat"}
    grid = OrderGrid(p=(0, 1), d=(0, 1), q=(0, 1))
    tuned = {r["series_id"]: r for r in stages.tune(raw, layout, "s", grid).collect()}
    assert tuned["up"]["mape"] < 2 and tuned["up"]["n_candidates"] == 8
    results = store.read_results(spark, layout)
    best = {r["series_id"]: r for r in store.best_hyperparameters(results, "s").collect()}
    assert [best["up"][c] for c in "PDQ"] == [tuned["up"][c] for c in "pdq"]

    trained = {r["series_id"]: r for r in stages.train(raw, layout, "s", grid).collect()}
    models = {r["series_id"]: r for r in store.load_model(spark, layout, "s").collect()}
    for s, r in trained.items():
        assert (models[s]["p"], models[s]["d"], models[s]["q"]) == (r["p"], r["d"], r["q"])
        assert models[s]["n"] == 90
    first_version = models["up"]["version"]

    again = stages.retrain(spark, prices, "prices", ["day", "price"], layout, "s", "2021-01-11", "2021-03-11", series="item")
    got = {r["series_id"]: r for r in again.collect()}
    assert got["up"]["n_candidates"] == 1
    assert (got["up"]["p"], got["up"]["d"], got["up"]["q"]) == (trained["up"]["p"], trained["up"]["d"], trained["up"]["q"])
    newest = {r["series_id"]: r for r in store.load_model(spark, layout, "s").collect()}
    assert newest["up"]["n"] == 48 and newest["up"]["version"] > first_version  # 80 % of 60 days
    assert raw.count() == 180  # the first raw files stay


def test_stages_refuse_rows_without_a_time(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2020, 1, 1 + i), float(i)) for i in range(20)] + [("a", None, 1.0)],
                                 "series_id string, ts timestamp_ntz, value double")
    layout = Layout(str(tmp_path / "lost"))
    for stage in (lambda: stages.tune(rows, layout, "s", OrderGrid((0,), (0,), (0,))), lambda: stages.suggest(rows),
                  lambda: stages.preprocess(rows, layout, "s")):
        with pytest.raises(ValueError, match="1 of 21 rows"):
            stage()


def test_filled_values_are_counted(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2020, 1, 1 + i), None if i in (3, 4) else float(i)) for i in range(25)],
                                 "series_id string, ts timestamp_ntz, value double")
    layout = Layout(str(tmp_path / "filled"))
    stages.tune(rows, layout, "s", OrderGrid((0,), (0, 1), (0,)))
    stages.train(rows.fillna(0.0, ["value"]), layout, "s", OrderGrid((0,), (0, 1), (0,)))
    got = {r["stage"]: r["n_filled"] for r in store.read_results(spark, layout).collect()}
    assert got == {"tune": 2, "train": 0}


def test_ties_reach_every_stage(spark, tmp_path):
    # the order of equal times by ``id`` is the reverse of that by value
    rows = spark.createDataFrame([(dt.datetime(2020, 1, 1 + i // 2), 100.0 - i, i) for i in range(56)], "day timestamp_ntz, price double, id int")
    path = str(tmp_path / "tables")
    rows.write.parquet(f"{path}/ties.parquet")
    source, layout = TableSource("parquet", {"path": path}), Layout(str(tmp_path / "run"))
    raw = stages.ingest(spark, source, "ties", ["day", "price"], layout, "s", tie=["id"])
    split = stages.preprocess(raw, layout, "s", tie=["id"])
    ordered = [r["value"] for r in split.orderBy("seq").collect()]
    assert ordered == [100.0 - i for i in range(56)]
    grid = OrderGrid((0,), (1,), (0,))
    train = split.where("split = 'train'").drop("split")
    naive = 100 * sum(1 / v for v in ordered[:44][30:]) / 14
    assert stages.train(train, layout, "s", grid).first()["mape"] == pytest.approx(naive)
    again = stages.retrain(spark, source, "ties", ["day", "price"], layout, "s", "2020-01-01", "2020-01-28", tie=["id"])
    assert again.first()["mape"] == pytest.approx(naive)
    with pytest.raises(ValueError):
        stages.ingest(spark, source, "ties", ["day", "price"], layout, "c", fmt="csv", tie=["id"])


def test_csv_folder_headers_and_bad_rows(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("ts,value\n2020-01-01 00:00:00.000000,1.5\n2020-01-02 00:00:00.000000,oops\nnever,3\n2020-01-04 00:00:00.000000,4,5\n")
    got = sorted((r["value"] or -1.0, r["bad"]) for r in files.read_series_dir(spark, str(folder)).collect())
    assert got == [(-1.0, True), (1.5, False), (3.0, True), (4.0, True)]
    (folder / "b.csv").write_text("value,ts\n2.5,2020-01-03 00:00:00.000000\n")
    with pytest.raises(Exception):
        files.read_series_dir(spark, str(folder)).collect()
