import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from chronoloom.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("tests", **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        }).master("local[4]").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Series from a dict of id -> values, one row per day; optional layout for chunk tests."""
    import datetime as dt

    from chronoloom.operators.index import index_series

    def build(values: dict, **layout):
        day = dt.datetime(2020, 1, 1)
        rows = [(k, day + dt.timedelta(days=i), None if x is None else float(x))
                for k, v in values.items() for i, x in enumerate(v)]
        df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")
        return index_series(df.repartition(3), **layout)

    return build


H = [1, 2, 4, 7, 11, 16, 22, 29, 37, 46]


@pytest.fixture
def h():
    return list(H)
