"""The registered queries: each operator over the given tables, with its SQL twin.

Series used here: ``monthly`` (mean order price per priority and month),
``events`` (raw event values per type) and ``event_log`` (all events as one
series). Queries without ``sql`` have no practical SQL form; the tests compare
them with direct computations.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions import unitroot
from ..operators import arima, correlation, evaluate, forecast, prepare, scale, search, stationarity
from ..operators.difference import difference as differenced
from ..operators.index import as_series, index_series, some_rows
from ..operators.split import chrono_split as split_rows
from ..operators.split import holdout_split as holdout_rows
from ..session import checkpointed, use_checkpoint_dir
from ..sources import files, store
from ..sources import tables as table_sources
from . import stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GRID = search.OrderGrid(p=(0, 1, 2), d=(0, 1), q=(0, 1, 2))
CLOSED_GRID = search.OrderGrid(p=(0,), d=(0, 1, 2), q=(0,))
PLAN = [scale.ScaleStep("value", scale.COMBINED)]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def source(sf: str) -> table_sources.TableSource:
    return table_sources.TableSource("parquet", {"path": sf})


def in_scratch(f: Callable[[SparkSession, str, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """For queries that write and read back: a new folder in the shared checkpoint folder, which goes when the result is made."""
    @functools.wraps(f)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        use_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
        try:
            return checkpointed(f(spark, sf, folder))
        finally:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return run


def monthly_rows(spark: SparkSession, sf: str) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")
    rows = table(spark, sf, "orders").groupBy("o_orderpriority", month).agg(F.avg("o_totalprice").alias("value"))
    return as_series(rows, ["ts", "value"], "o_orderpriority")


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    return index_series(monthly_rows(spark, sf))


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return as_series(table(spark, sf, "events"), ["ts", "value"], "event_type", ["event_id"])


def events(spark: SparkSession, sf: str) -> DataFrame:
    return index_series(event_rows(spark, sf), ["event_id"])


def event_log(spark: SparkSession, sf: str, **options) -> DataFrame:
    rows = as_series(table(spark, sf, "events"), ["ts", "value"], tie=["event_id"])
    return index_series(rows, ["event_id"], **options)


def rounded(column: str | Column, digits: int = 6, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits).alias(name or column)


MONTHLY = """monthly AS (
  SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts,
         avg(o_totalprice) AS value
  FROM orders GROUP BY 1, 2)"""
EVENTS = "raw AS (SELECT event_type AS series_id, ts, value, event_id FROM events)"
LOG = "raw AS (SELECT 'all' AS series_id, ts, value, event_id FROM events)"
INDEX = """idx AS (
  SELECT series_id, ts, value, row_number() OVER (PARTITION BY series_id ORDER BY ts{tie}) AS seq,
         count(*) OVER (PARTITION BY series_id) AS n
  FROM {rows})"""
MONTHLY_IDX = MONTHLY + ", " + INDEX.format(rows="monthly", tie="")
EVENTS_IDX = EVENTS + ", " + INDEX.format(rows="raw", tie=", event_id")
LOG_IDX = LOG + ", " + INDEX.format(rows="raw", tie=", event_id")


# ---------------------------------------------------------------- sources

@query("SELECT o_orderdate AS ts, o_totalprice AS value FROM orders")
def read_table(spark, sf):
    df = table_sources.read_table(spark, source(sf), "orders", ["o_orderdate", "o_totalprice"])
    return table_sources.rows_to_frame(df)


@query("""SELECT o_orderdate, o_totalprice FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'""")
def read_table_range(spark, sf):
    return table_sources.read_table_range(
        spark, source(sf), "orders", ["o_orderdate", "o_totalprice"], "1996-01-01", "1997-12-31")


@query("SELECT l_shipdate, l_extendedprice FROM lineitem WHERE l_quantity > 45")
def run_query(spark, sf):
    text = "SELECT l_shipdate, l_extendedprice FROM lineitem WHERE l_quantity > 45"
    return table_sources.run_query(spark, source(sf), text, ["lineitem"])


@query("SELECT l_shipdate AS ts, CAST(l_quantity AS DOUBLE) AS value FROM lineitem")
def rows_to_frame(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_shipdate", F.col("l_quantity").cast("decimal(12,2)"))
    return table_sources.rows_to_frame(rows)


@query("""SELECT CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) AS value, FALSE AS bad FROM orders GROUP BY 1""")
@in_scratch
def read_series_csv(spark, sf, folder):
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.avg("o_totalprice").alias("price"))
    files.write_raw_csv(days, folder)
    return files.read_series_csv(spark, folder).drop("series_id")


@query("SELECT event_type AS series_id, ts, value, FALSE AS bad FROM events")
@in_scratch
def read_series_dir(spark, sf, folder):
    files.write_series(event_rows(spark, sf), folder, "csv")
    return files.read_series_dir(spark, folder).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""WITH {EVENTS_IDX} SELECT series_id, ts, value,
  CASE WHEN seq > CAST(trunc(n * (80 / 100.0::DOUBLE)) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM idx""")
@in_scratch
def write_split_csv(spark, sf, folder):
    files.write_split_csv(split_rows(events(spark, sf), "0.8"), folder)
    halves = [files.read_series_dir(spark, f"{folder}/{part}").drop("bad").withColumn("split", F.lit(part)) for part in ("train", "test")]
    return halves[0].unionByName(halves[1]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT event_type AS series_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
  CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, min(value) AS min_value,
  max(value) AS max_value, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def dataset_info(spark, sf):
    return prepare.dataset_info(event_rows(spark, sf)).withColumn("mean_value", F.round("mean_value", 6))


@query("SELECT event_type AS series_id, ts, value FROM events ORDER BY ts, 1 LIMIT 10")
def dataset_sample(spark, sf):
    return prepare.dataset_sample(event_rows(spark, sf).drop("event_id"))


# ---------------------------------------------------------------- projection, filters, checks

@query("SELECT 'all' AS series_id, l_shipdate AS ts, l_extendedprice AS value FROM lineitem")
def project_pair(spark, sf):
    return as_series(table(spark, sf, "lineitem"), ["l_shipdate", "l_extendedprice"])


@query("""SELECT event_type AS series_id, ts, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def filter_date_range(spark, sf):
    rows = event_rows(spark, sf).drop("event_id")
    return prepare.filter_date_range(rows, "2024-01-10 00:00:00", "2024-01-20 12:00:00")


@query("SELECT o_orderpriority AS series_id, o_orderdate AS ts, o_totalprice AS value FROM orders ORDER BY 2, 1, 3")
def order_by_time(spark, sf):
    rows = as_series(table(spark, sf, "orders"), ["o_orderdate", "o_totalprice"], "o_orderpriority")
    return prepare.order_by_time(rows)


@query(f"WITH {EVENTS_IDX} SELECT series_id, ts, value FROM idx WHERE seq > 100")
def filter_seq(spark, sf):
    return prepare.drop_helper(prepare.filter_seq(events(spark, sf), 100, "rest"))


@query("SELECT o_orderkey, o_orderdate AS ts FROM orders")
def parse_time(spark, sf):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    ts = fn.parse_time(text).cast("timestamp_ntz")
    return table(spark, sf, "orders").select("o_orderkey", ts.alias("ts"))


@query("SELECT o_orderkey, CAST(trunc(-o_totalprice) AS BIGINT) AS value FROM orders")
def truncate_value(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fn.truncate_value(-F.col("o_totalprice")).alias("value"))


@query("SELECT event_id, CASE WHEN value > 10 THEN 0.0 ELSE value END AS value FROM events")
def fill_missing(spark, sf):
    gaps = F.when(F.col("value") <= 10, F.col("value")).when(
        F.col("event_id") % 2 == 0, F.lit(float("nan")))
    return table(spark, sf, "events").select("event_id", fn.fill_missing(gaps).alias("value"))


@query("""WITH t AS (SELECT o_orderpriority AS series_id, o_orderdate AS ts, count(*) AS c,
  sum(CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END) AS b FROM orders GROUP BY 1, 2)
SELECT series_id, CAST(sum(c) AS BIGINT) AS n, CAST(sum(CASE WHEN ts IS NULL THEN c ELSE 0 END) AS BIGINT) AS n_null_ts,
  CAST(sum(CASE WHEN ts IS NULL THEN 0 ELSE c - 1 END) AS BIGINT) AS n_dup_ts, CAST(sum(b) AS BIGINT) AS n_bad_value
FROM t GROUP BY 1""")
def validate_series(spark, sf):
    return prepare.validate_series(
        as_series(table(spark, sf, "orders"), ["o_orderdate", "o_totalprice"], "o_orderpriority"))


# ---------------------------------------------------------------- index and split

@query("SELECT event_type AS series_id, count(*) AS n FROM events GROUP BY 1")
def series_count(spark, sf):
    return prepare.series_count(event_rows(spark, sf))


@query("""SELECT o_orderpriority AS series_id, o_totalprice AS value,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS seq,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders""")
def seq_index(spark, sf):
    rows = as_series(table(spark, sf, "orders"), ["o_orderdate", "o_totalprice"], "o_orderpriority", ["o_orderkey"])
    return index_series(rows, ["o_orderkey"]).select("series_id", "value", "seq", "n")


@query(f"WITH {LOG_IDX} SELECT series_id, ts, value, seq, n FROM idx")
def seq_index_distributed(spark, sf):
    """One long series numbered without gathering it: always the range-partitioned way."""
    return event_log(spark, sf, rows_per_task=0, chunk_rows=4096).select("series_id", "ts", "value", "seq", "n")


@query(f"""WITH {EVENTS_IDX} SELECT series_id, ts, value, seq,
  CASE WHEN seq <= CAST(trunc(n * (57 / 100.0::DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM idx""")
def chrono_split(spark, sf):
    return split_rows(events(spark, sf), "0.58").select("series_id", "ts", "value", "seq", "split")


@query(f"""WITH {EVENTS_IDX} SELECT series_id, seq, value, CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) AS k,
  seq > CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) AS scored FROM idx""")
def holdout_split(spark, sf):
    return holdout_rows(events(spark, sf)).select("series_id", "seq", "value", "k", "scored")


# ---------------------------------------------------------------- scaling

TRAIN = "train AS (SELECT * FROM idx WHERE seq <= CAST(trunc(n * (80 / 100.0::DOUBLE)) AS BIGINT))"


def _split(spark, sf):
    """All rows and the training part of them, indexed once."""
    rows = split_rows(events(spark, sf), "0.8")
    return rows, some_rows(rows, F.col("split") == "train")


def _train(spark, sf):
    return _split(spark, sf)[1]


@query(f"""WITH {EVENTS_IDX}, {TRAIN} SELECT series_id, 'value' AS "column", 'normalization' AS method,
  min(value) AS p1, max(value) AS p2 FROM train GROUP BY 1""")
def minmax_fit(spark, sf):
    return scale.minmax_fit(_train(spark, sf))


@query(f"""WITH {EVENTS_IDX}, {TRAIN} SELECT series_id, 'value' AS "column", 'standardization' AS method,
  round(avg(value), 6) AS p1, round(stddev_samp(value), 6) AS p2 FROM train GROUP BY 1""")
def standard_fit(spark, sf):
    return scale.standard_fit(_train(spark, sf)).withColumns({p: F.round(p, 6) for p in ("p1", "p2")})


@query(f"""WITH {EVENTS_IDX}, {TRAIN}, s AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM train GROUP BY 1)
SELECT series_id, seq, round((value - lo) / (hi - lo), 8) AS value FROM train JOIN s USING (series_id)""")
def minmax_scale(spark, sf):
    return scale.minmax_scale(_train(spark, sf)).select("series_id", "seq", rounded("value", 8))


@query(f"""WITH {EVENTS_IDX}, {TRAIN},
s AS (SELECT series_id, avg(value) AS m, stddev_samp(value) AS sd FROM train GROUP BY 1)
SELECT series_id, seq, round((value - m) / sd, 6) AS value FROM train JOIN s USING (series_id)""")
def zscore_scale(spark, sf):
    return scale.zscore_scale(_train(spark, sf)).select("series_id", "seq", rounded("value"))


CHAIN = f"""{EVENTS_IDX}, {TRAIN},
s AS (SELECT series_id, avg(value) AS m, stddev_samp(value) AS sd FROM train GROUP BY 1),
s2 AS (SELECT series_id, m, sd, min((value - m) / sd) AS lo, max((value - m) / sd) AS hi
       FROM train JOIN s USING (series_id) GROUP BY ALL)"""


@query(f"""WITH {CHAIN} SELECT series_id, seq, round(((value - m) / sd - lo) / (hi - lo), 8) AS value
FROM train JOIN s2 USING (series_id)""")
def scale_chain(spark, sf):
    train = _train(spark, sf)
    return scale.apply_scaler(train, scale.scale_fit(train, PLAN), PLAN).select(
        "series_id", "seq", rounded("value", 8))


@query(f"""WITH {CHAIN} SELECT series_id, seq, round(((value - m) / sd - lo) / (hi - lo), 8) AS value
FROM idx JOIN s2 USING (series_id) WHERE seq > CAST(trunc(n * (80 / 100.0::DOUBLE)) AS BIGINT)""")
@in_scratch
def apply_scaler(spark, sf, folder):
    """Parameters fitted on the training part, saved, loaded and applied to the rest."""
    layout = store.Layout(folder)
    rows, train = _split(spark, sf)
    store.save_scaler(scale.scale_fit(train, PLAN), layout, "s")
    test = some_rows(rows, F.col("split") == "test")
    return scale.apply_scaler(test, store.load_scaler(spark, layout, "s"), PLAN).select(
        "series_id", "seq", rounded("value", 8))


@query(f"WITH {EVENTS_IDX} SELECT series_id, seq, round(value, 6) AS value FROM idx")
def invert_scaler(spark, sf):
    rows, train = _split(spark, sf)
    scaler = scale.scale_fit(train, PLAN)
    back = scale.invert_scaler(scale.apply_scaler(rows, scaler, PLAN), scaler, PLAN)
    return back.select("series_id", "seq", rounded("value"))


# ---------------------------------------------------------------- differences

D1 = "d1 AS (SELECT series_id, seq, n, coalesce(value - lag(value) OVER w, 0.0) AS v FROM idx WINDOW w AS (PARTITION BY series_id ORDER BY seq))"
D2 = "d2 AS (SELECT series_id, seq, n, coalesce(v - lag(v) OVER w, 0.0) AS v FROM d1 WINDOW w AS (PARTITION BY series_id ORDER BY seq))"


@query(f"WITH {EVENTS_IDX}, {D1} SELECT series_id, seq, round(v, 6) AS value FROM d1")
def difference(spark, sf):
    return differenced(events(spark, sf)).select("series_id", "seq", rounded("value"))


@query(f"WITH {LOG_IDX}, {D1}, {D2} SELECT series_id, seq, round(v, 6) AS value FROM d2")
def difference_twice(spark, sf):
    """Second difference of one long series in chunks."""
    return differenced(event_log(spark, sf, chunk_rows=1024), 2).select("series_id", "seq", rounded("value"))


# ---------------------------------------------------------------- correlation

LAGS = """cen AS (SELECT series_id, seq, n, value - avg(value) OVER (PARTITION BY series_id) AS x FROM {rows}),
sums AS (SELECT a.series_id, a.n, a.seq - b.seq AS lag, sum(a.x * b.x) AS s
  FROM cen a JOIN cen b ON a.series_id = b.series_id AND b.seq BETWEEN
    a.seq - greatest(least(CAST(floor(10 * log10(a.n)) AS BIGINT), a.n - 1), 0) AND a.seq
  GROUP BY 1, 2, 3)"""
ACF = """r AS (SELECT series_id, n, lag, s / first_value(s) OVER (PARTITION BY series_id ORDER BY lag) AS value FROM sums),
acf AS (SELECT series_id, CAST(lag AS INTEGER) AS lag, value, CASE WHEN lag = 0 THEN 0.0 ELSE
  1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN value * value END) OVER (
    PARTITION BY series_id ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS bound FROM r)"""
ACF_MONTHLY = f"{MONTHLY_IDX}, {LAGS.format(rows='idx')}, {ACF}"
ACF_EVENTS = f"{EVENTS_IDX}, {LAGS.format(rows='idx')}, {ACF}"


@query(f"WITH {EVENTS_IDX}, {LAGS.format(rows='idx')} "
       "SELECT series_id, CAST(lag AS INTEGER) AS lag, round(s, 3) AS s FROM sums")
def acf_sums(spark, sf):
    sums = correlation.lag_products(events(spark, sf))
    sums = sums.select("series_id", "n", F.posexplode("sums").alias("lag", "s"))
    return sums.where(F.col("lag") <= correlation.acf_lags(F.col("n"))).select("series_id", "lag", rounded("s", 3))


@query(f"WITH {ACF_EVENTS} SELECT series_id, lag, round(value, 6) AS value FROM acf")
def acf(spark, sf):
    return correlation.acf(events(spark, sf)).select("series_id", "lag", rounded("value"))


@query(f"WITH {LOG_IDX}, {LAGS.format(rows='idx')}, {ACF} SELECT series_id, lag, round(value, 6) AS value FROM acf")
def acf_long_series(spark, sf):
    """One long series in chunks that hand their last rows on."""
    return correlation.acf(event_log(spark, sf, chunk_rows=2048)).select("series_id", "lag", rounded("value"))


@query(f"WITH {ACF_MONTHLY} SELECT series_id, lag, round(-bound, 6) AS low, round(bound, 6) AS high FROM acf")
def acf_bounds(spark, sf):
    bounds = correlation.error_range(correlation.acf(monthly(spark, sf)))
    return bounds.select("series_id", "lag", F.round(F.col("low"), 6).alias("low"), rounded("high"))


@query(f"WITH {ACF_MONTHLY} SELECT series_id, lag, round(value, 6) AS value FROM acf WHERE abs(value) >= bound")
def sig_lags_acf(spark, sf):
    found = correlation.significant_lags(correlation.acf(monthly(spark, sf)))
    return found.select("series_id", "lag", rounded("value"))


def _text(df: DataFrame, column: str) -> DataFrame:
    return df.select("series_id", F.array_join(column, ",").alias(column))


FULL = "SELECT series_id, string_agg(CAST(lag AS VARCHAR), ',' ORDER BY lag) FILTER (WHERE abs(value) >= bound) AS {name} FROM {rows} GROUP BY 1"
RUN = """m AS (SELECT series_id, coalesce(min(CASE WHEN lag >= 1 AND abs(value) < bound THEN lag END) - 1, max(lag)) AS k
  FROM {rows} GROUP BY 1)
SELECT series_id, array_to_string(list_transform(range(1, k + 1), lambda x: CAST(x AS VARCHAR)), ',') AS {name} FROM m"""


@query(f"WITH {ACF_MONTHLY} {FULL.format(rows='acf', name='q_values')}")
def q_range_full(spark, sf):
    return _text(correlation.full_range(correlation.acf(monthly(spark, sf)), "q_values"), "q_values")


ACF_D1 = f"{MONTHLY_IDX}, {D1}, dd AS (SELECT series_id, seq, n, v AS value FROM d1), {LAGS.format(rows='dd')}, {ACF}"


@query(f"WITH {ACF_D1}, {RUN.format(rows='acf', name='q_values')}")
def q_range_immediate(spark, sf):
    rows = differenced(monthly(spark, sf))
    return _text(correlation.immediate_range(correlation.acf(rows), "q_values"), "q_values")


PACF = """c AS (SELECT series_id, n, list(s / (n - lag) ORDER BY lag) AS c FROM sums GROUP BY 1, 2),
rho AS (SELECT series_id, n, list_transform(c, lambda v: v / c[1]) AS r,
  greatest(least(CAST(floor(10 * log10(n)) AS BIGINT), n // 2 - 1), 1) AS top FROM c),
dl AS (
  SELECT series_id, n, r, top, 1 AS k, [r[2]] AS phi FROM rho
  UNION ALL
  SELECT series_id, n, r, top, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - a * phi[k - j + 1]), a)
  FROM (SELECT *, (r[k + 2] - list_dot_product(phi, list_reverse(r[2:k + 1])))
               / (1 - list_dot_product(phi, r[2:k + 1])) AS a FROM dl WHERE k < top)),
pacf AS (SELECT series_id, 0 AS lag, 1.0::DOUBLE AS value, 0.0::DOUBLE AS bound FROM rho UNION ALL
  SELECT series_id, k AS lag, phi[k] AS value, 1.959963984540054 / sqrt(n) AS bound FROM dl)"""
PACF_MONTHLY = f"WITH RECURSIVE {MONTHLY_IDX}, {LAGS.format(rows='idx')}, {PACF}"
PACF_D1 = f"WITH RECURSIVE {MONTHLY_IDX}, {D1}, dd AS (SELECT series_id, seq, n, v AS value FROM d1), {LAGS.format(rows='dd')}, {PACF}"


@query(f"{PACF_MONTHLY} SELECT series_id, CAST(lag AS INTEGER) AS lag, round(value, 6) AS value, round(bound, 6) AS bound FROM pacf")
def pacf(spark, sf):
    return correlation.pacf(monthly(spark, sf)).select("series_id", "lag", rounded("value"), rounded("bound"))


@query(f"WITH RECURSIVE {EVENTS_IDX}, {LAGS.format(rows='idx')}, {PACF} "
       "SELECT series_id, CAST(lag AS INTEGER) AS lag, round(value, 6) AS value FROM pacf")
def pacf_events(spark, sf):
    return correlation.pacf(events(spark, sf)).select("series_id", "lag", rounded("value"))


@query(f"{PACF_D1} {FULL.format(rows='pacf', name='p_values')}")
def p_range_full(spark, sf):
    rows = differenced(monthly(spark, sf))
    return _text(correlation.full_range(correlation.pacf(rows), "p_values"), "p_values")


@query(f"{PACF_D1}, {RUN.format(rows='pacf', name='p_values')}")
def p_range_immediate(spark, sf):
    rows = differenced(monthly(spark, sf))
    return _text(correlation.immediate_range(correlation.pacf(rows), "p_values"), "p_values")


# ---------------------------------------------------------------- stationarity

@query(f"""WITH {EVENTS_IDX}, {D1}, v AS (
  SELECT series_id, 0 AS d, seq, n, value - avg(value) OVER (PARTITION BY series_id) AS y FROM idx
  UNION ALL SELECT series_id, 1 AS d, seq, n, v AS y FROM d1),
s AS (SELECT *, y - lag(y) OVER w AS dy, lag(y) OVER w AS level,
        least(CAST(ceil(12 * (n / 100.0::DOUBLE) ** 0.25) AS BIGINT), n // 2 - 2) AS top
      FROM v WINDOW w AS (PARTITION BY series_id, d ORDER BY seq)),
g AS (SELECT a.series_id, a.d, a.seq - b.seq AS lag, sum(a.dy * b.dy) AS dd, sum(a.level * b.dy) AS yd
      FROM s a JOIN s b ON a.series_id = b.series_id AND a.d = b.d AND b.seq BETWEEN a.seq - a.top AND a.seq
      WHERE a.seq >= a.top + 2 GROUP BY 1, 2, 3)
SELECT series_id, CAST(d AS INTEGER) AS d, CAST(lag AS INTEGER) AS lag,
  round(dd / first_value(dd) OVER w, 6) AS dd, round(yd / first_value(dd) OVER w, 6) AS yd
FROM g WINDOW w AS (PARTITION BY series_id, d ORDER BY lag)""")
def adf_gram(spark, sf):
    sums = stationarity.adf_sums(events(spark, sf), 1)
    k = ((F.size("sums") - 8) / 4).cast("int") + 1
    pairs = F.arrays_zip(F.slice("sums", F.lit(1), k).alias("dd"), F.slice("sums", k + 1, k).alias("yd"))
    first = F.element_at("sums", 1).alias("first")
    out = sums.select("series_id", "d", first, F.posexplode(pairs).alias("lag", "s"))
    ratio = lambda c: F.round(F.col(f"s.{c}") / F.col("first"), 6).alias(c)
    return out.select("series_id", "d", "lag", ratio("dd"), ratio("yd"))


# The test written out. Rows x = (constant, level, lagged differences 1..top, target); eliminating one regressor after the other from
# their products leaves the residual sum of every nested regression in the last corner. At the lag of the least AIC all rows
# that it allows are taken again, with the level last, so that one 2 x 2 corner holds its coefficient and error. The p-value
# grows with the statistic: p <= 0.05 is a bound on the statistic.
STATIONARY_AT = unitroot.critical_value(stationarity.STATIONARY_P)
NTH = "SELECT series_id, {d} AS d, seq, n, v AS y FROM d{d}"
D_ALL = ", ".join(f"d{d} AS (SELECT series_id, seq, n, coalesce(v - lag(v) OVER w, 0.0) AS v FROM d{d - 1} WINDOW w AS (PARTITION BY series_id ORDER BY seq))"
                  for d in (1, 2, 3))
V_ALL = ("d0 AS (SELECT series_id, seq, n, value - avg(value) OVER (PARTITION BY series_id) AS v FROM idx), " + D_ALL
         + ", v AS (" + " UNION ALL ".join(NTH.format(d=d) for d in range(4)) + ")")
PRODUCTS = """{name}_g AS (SELECT series_id, d, n, m, i, j, sum(x[i] * x[j]) AS s FROM {rows}, unnest(range(1, m + 1)) a(i), unnest(range(1, m + 1)) b(j) GROUP BY ALL),
{name}_m AS (SELECT series_id, d, n, m, list(line ORDER BY i) AS a FROM (SELECT series_id, d, n, m, i, list(s ORDER BY j) AS line FROM {name}_g GROUP BY ALL) GROUP BY ALL),
{name} AS (SELECT series_id, d, n, m, 0 AS k, a FROM {name}_m UNION ALL
  SELECT series_id, d, n, m, k + 1, list_transform(range(1, m + 1), lambda i: list_transform(range(1, m + 1),
    lambda j: a[i][j] - a[i][k + 1] * a[k + 1][j] / a[k + 1][k + 1])) FROM {name} WHERE k < m - {left})"""
ADF = """x AS (SELECT *, least(CAST(ceil(12 * (n / 100.0::DOUBLE) ** 0.25) AS BIGINT), n // 2 - 2) AS top, y - lag(y) OVER w AS dy, lag(y) OVER w AS level
  FROM v WINDOW w AS (PARTITION BY series_id, d ORDER BY seq)),
l AS (SELECT *, list_reverse(list(dy) OVER (PARTITION BY series_id, d ORDER BY seq ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING)) AS past FROM x),
r1 AS (SELECT series_id, d, n, top + 3 AS m, list_concat([1.0::DOUBLE, level], past[1:top], [dy]) AS x FROM l WHERE seq >= top + 2),
{nested},
aic AS (SELECT series_id, d, k - 2 AS lags, (n - m + 2) * ln(a[m][m] / (n - m + 2)) + 2 * k AS aic FROM e1 WHERE k >= 2),
best_lag AS (SELECT series_id, d, arg_min(lags, aic) AS lags FROM aic GROUP BY 1, 2),
r2 AS (SELECT series_id, d, n, lags + 3 AS m, list_concat([1.0::DOUBLE], past[1:lags], [level, dy]) AS x
  FROM l JOIN best_lag USING (series_id, d) WHERE seq >= lags + 2),
{final},
adf AS (SELECT series_id, CAST(d AS INTEGER) AS d, n, CAST(m - 3 AS INTEGER) AS lags, a[m - 1][m] / a[m - 1][m - 1]
  / sqrt((a[m][m] - a[m - 1][m] ** 2 / a[m - 1][m - 1]) / (n - m + 2 - (m - 1)) / a[m - 1][m - 1]) AS statistic FROM e2 WHERE k = m - 2)""".format(
    nested=PRODUCTS.format(name="e1", rows="r1", left=1), final=PRODUCTS.format(name="e2", rows="r2", left=2))
BEST_D = f"best_d AS (SELECT series_id, min(d) FILTER (statistic <= {STATIONARY_AT!r}) AS d FROM adf GROUP BY 1)"

@query(f"WITH RECURSIVE {EVENTS_IDX}, {V_ALL.replace(' UNION ALL ' + NTH.format(d=2) + ' UNION ALL ' + NTH.format(d=3), '')}, {ADF} "
       f"SELECT series_id, d, n, lags, round(statistic, 5) AS statistic, statistic <= {STATIONARY_AT!r} AS stationary FROM adf")
def adf_test(spark, sf):
    found = stationarity.adf_test(events(spark, sf), 1)
    return found.select("series_id", "d", "n", "lags", rounded("statistic", 5), (F.col("p_value") <= stationarity.STATIONARY_P).alias("stationary"))


@query(f"WITH RECURSIVE {MONTHLY_IDX}, {V_ALL}, {ADF}, {BEST_D} SELECT series_id, d FROM best_d")
def get_d(spark, sf):
    return stationarity.get_d(monthly(spark, sf))


SUGGEST = f"""dd AS (SELECT series_id, seq, n, CASE d WHEN 0 THEN d0.v WHEN 1 THEN d1.v WHEN 2 THEN d2.v ELSE d3.v END AS value
  FROM d0 JOIN d1 USING (series_id, seq, n) JOIN d2 USING (series_id, seq, n) JOIN d3 USING (series_id, seq, n) JOIN best_d USING (series_id)),
{LAGS.format(rows='dd')}, {ACF}, {PACF},
runs AS (SELECT series_id, 'p' AS kind, lag, abs(value) >= bound AS inside FROM pacf WHERE lag > 0
  UNION ALL SELECT series_id, 'q', lag, abs(value) >= bound FROM acf WHERE lag > 0),
ends AS (SELECT series_id, kind, coalesce(min(lag) FILTER (NOT inside), max(lag) + 1) - 1 AS run FROM runs GROUP BY 1, 2)
SELECT best_d.series_id, d, array_to_string(range(1, CAST(p.run AS BIGINT) + 1), ',') AS p_values, array_to_string(range(1, CAST(q.run AS BIGINT) + 1), ',') AS q_values
FROM best_d JOIN ends p ON p.series_id = best_d.series_id AND p.kind = 'p' JOIN ends q ON q.series_id = best_d.series_id AND q.kind = 'q'"""


def _suggested(df: DataFrame) -> DataFrame:
    return df.select("series_id", "d", F.array_join("p_values", ",").alias("p_values"), F.array_join("q_values", ",").alias("q_values"))


@query(f"WITH RECURSIVE {MONTHLY_IDX}, {V_ALL}, {ADF}, {BEST_D}, {SUGGEST}")
def suggest_orders(spark, sf):
    return _suggested(search.suggest_orders(monthly(spark, sf)))


SUGGEST_FULL = SUGGEST[:SUGGEST.index("runs AS (")] + """runs AS (SELECT series_id, 'p' AS kind, lag FROM pacf WHERE abs(value) >= bound
  UNION ALL SELECT series_id, 'q', lag FROM acf WHERE abs(value) >= bound),
lists AS (SELECT series_id, kind, string_agg(CAST(lag AS VARCHAR), ',' ORDER BY lag) AS lags FROM runs GROUP BY 1, 2)
SELECT best_d.series_id, d, p.lags AS p_values, q.lags AS q_values
FROM best_d JOIN lists p ON p.series_id = best_d.series_id AND p.kind = 'p' JOIN lists q ON q.series_id = best_d.series_id AND q.kind = 'q'"""


@query(f"WITH RECURSIVE {MONTHLY_IDX}, {V_ALL}, {ADF}, {BEST_D}, {SUGGEST_FULL}")
def suggest_orders_full(spark, sf):
    """All significant lags as candidates."""
    return _suggested(search.suggest_orders(monthly(spark, sf), full=True))


@query(f"WITH RECURSIVE {EVENTS}, idx AS (SELECT * REPLACE (trunc(value) AS value) FROM ({INDEX.format(rows='raw', tie=', event_id')[8:-1]})), "
       f"{V_ALL.replace(' UNION ALL ' + NTH.format(d=2) + ' UNION ALL ' + NTH.format(d=3), '')}, {ADF}, {BEST_D}, {SUGGEST}")
def suggest_orders_events(spark, sf):
    return _suggested(stages.suggest(event_rows(spark, sf), tie=["event_id"]))


# ---------------------------------------------------------------- candidates, forecasts, search

@query("""SELECT event_type AS series_id, CAST(p AS INTEGER) AS p, CAST(d AS INTEGER) AS d, CAST(q AS INTEGER) AS q
FROM (SELECT DISTINCT event_type FROM events), range(0, 3) a(p), range(0, 2) b(d), range(0, 3) c(q)""")
def candidate_grid(spark, sf):
    grid = search.OrderGrid(p=[0, 1, 2, 0], d=[0, 1], q=[0, 1, 2, 0])
    return search.candidate_grid(event_rows(spark, sf), grid)


@query("""SELECT event_type AS series_id, CAST(d AS INTEGER) AS d, count(*) AS n_rows, round(sum(value), 4) AS total
FROM events, range(0, 3) a(d) GROUP BY 1, 2""")
def series_candidates(spark, sf):
    """The candidates of a series attached to its chunks as one array; no row is multiplied."""
    rows = events(spark, sf)
    orders = search.candidate_grid(rows, CLOSED_GRID).groupBy("series_id").agg(F.collect_set("d").alias("orders"))
    chunks = rows.groupBy("series_id", "chunk").agg(F.count("*").alias("rows"), F.sum("value").alias("part"))
    each = chunks.join(orders, "series_id").select("series_id", "rows", "part", F.explode("orders").alias("d"))
    return each.groupBy("series_id", "d").agg(F.sum("rows").alias("n_rows"), F.round(F.sum("part"), 4).alias("total"))


HIST = """h AS (SELECT series_id, seq, n, value AS actual, CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) AS k,
  avg(value) OVER past AS mean_f, lag(value, 1) OVER w AS y1, lag(value, 2) OVER w AS y2 FROM idx
  WINDOW w AS (PARTITION BY series_id ORDER BY seq),
  past AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {EVENTS_IDX}, {HIST} SELECT series_id, seq, actual, round(mean_f, 6) AS forecast FROM h WHERE seq > k")
def mean_forecast(spark, sf):
    rows = forecast.closed_form_forecasts(events(spark, sf), [(0, 0, 0)])
    return rows.select("series_id", "seq", "actual", rounded("f_0_0_0", 6, "forecast"))


@query(f"""WITH {LOG_IDX}, {HIST} SELECT series_id, seq, actual, round(mean_f, 6) AS mean_f, round(y1, 6) AS last_f,
  round(2 * y1 - y2, 6) AS line_f FROM h WHERE seq > k""")
def long_series_forecast(spark, sf):
    """One long series: running sums per chunk plus the totals of the chunks before."""
    rows = forecast.closed_form_forecasts(event_log(spark, sf, chunk_rows=2048), [(0, 0, 0), (0, 1, 0), (0, 2, 0)])
    return rows.select("series_id", "seq", "actual", rounded("f_0_0_0", 6, "mean_f"),
                       rounded("f_0_1_0", 6, "last_f"), rounded("f_0_2_0", 6, "line_f"))


@query(f"WITH {EVENTS_IDX}, {HIST} SELECT series_id, seq, actual, round(y1, 6) AS forecast FROM h WHERE seq > k")
def naive_forecast(spark, sf):
    rows = forecast.closed_form_forecasts(events(spark, sf), [(0, 1, 0)])
    return rows.select("series_id", "seq", "actual", rounded("f_0_1_0", 6, "forecast"))


@query(f"""WITH {EVENTS_IDX}, x AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY seq) AS y1 FROM idx),
f AS (SELECT series_id, seq, n, value AS actual, y1, regr_slope(value, y1) OVER past AS b,
        regr_intercept(value, y1) OVER past AS a FROM x
      WINDOW past AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT series_id, seq, round(a + b * y1, 5) AS forecast FROM f WHERE seq > CAST(trunc(n * 0.7::DOUBLE) AS BIGINT)""")
def ar1_rolling_forecast(spark, sf):
    rows = forecast.closed_form_forecasts(events(spark, sf), [(1, 0, 0)])
    return rows.select("series_id", "seq", rounded("f_1_0_0", 5, "forecast"))


W = """w AS (SELECT series_id, seq, n, value, value - lag(value, 1) OVER s AS w0, lag(value, 1) OVER s - lag(value, 2) OVER s AS w1,
  lag(value, 2) OVER s - lag(value, 3) OVER s AS w2, lag(value, 1) OVER s AS y1 FROM {rows} WINDOW s AS (PARTITION BY series_id ORDER BY seq)),
g AS (SELECT series_id, seq, n, value, w1, w2, y1, sum(w0 * w1) OVER p AS s01, sum(w1 * w1) OVER p AS s11,
  sum(CASE WHEN w2 IS NOT NULL THEN w0 * w1 END) OVER p AS t01, sum(w0 * w2) OVER p AS t02,
  sum(CASE WHEN w2 IS NOT NULL THEN w1 * w1 END) OVER p AS t11, sum(w1 * w2) OVER p AS t12, sum(w2 * w2) OVER p AS t22
  FROM w WINDOW p AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT series_id, seq, n, value AS actual, y1 + w1 * s01 / s11 AS f1,
  y1 + (w1 * (t01 * t22 - t02 * t12) + w2 * (t02 * t11 - t01 * t12)) / (t11 * t22 - t12 * t12) AS f2 FROM g
  WHERE seq > CAST(trunc(n * 0.7::DOUBLE) AS BIGINT))"""
STEPS_AR = """SELECT series_id, CAST(1 AS INTEGER) AS p, seq, round(f1, 4) AS forecast FROM f UNION ALL
SELECT series_id, CAST(2 AS INTEGER) AS p, seq, round(f2, 4) AS forecast FROM f"""


@query(f"WITH {EVENTS_IDX}, {W.format(rows='idx')} {STEPS_AR}")
def ar_difference_forecast(spark, sf):
    """(1,1,0) and (2,1,0) through the chunked least-squares solver."""
    return _ar_steps(events(spark, sf))


@query(f"WITH {LOG_IDX}, {W.format(rows='idx')} {STEPS_AR}")
def ar_difference_long_series(spark, sf):
    return _ar_steps(event_log(spark, sf), chunk_rows=1024)


def _ar_steps(rows, **options):
    grid = search.OrderGrid(p=(1, 2), d=(1,), q=(0,))
    steps = arima.rolling_steps(rows, search.candidate_grid(rows, grid), max_p=2, max_d=1, max_q=0, **options)
    return steps.select("series_id", "p", "seq", rounded("forecast", 4))


CLOSED = """e AS (SELECT series_id, 0 AS d, actual, mean_f AS f FROM h WHERE seq > k
  UNION ALL SELECT series_id, 1, actual, y1 FROM h WHERE seq > k
  UNION ALL SELECT series_id, 2, actual, 2 * y1 - y2 FROM h WHERE seq > k),
mape AS (SELECT series_id, CAST(0 AS INTEGER) AS p, CAST(d AS INTEGER) AS d, CAST(0 AS INTEGER) AS q, count(*) AS n_steps,
  avg(CASE WHEN actual = 0 THEN CASE WHEN f = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END
      ELSE abs((actual - f) / actual) END) * 100 AS mape FROM e GROUP BY 1, 3)"""


@query(f"WITH {EVENTS_IDX}, {HIST}, {CLOSED} SELECT series_id, p, d, q, n_steps, round(mape, 4) AS mape FROM mape")
def mape(spark, sf):
    rows = events(spark, sf)
    steps = search.closed_form_steps(rows, [(0, 0, 0), (0, 1, 0), (0, 2, 0)])
    return evaluate.mape(steps).select("series_id", "p", "d", "q", "n_steps", rounded("mape", 4))


BEST = """b AS (SELECT series_id, min(mape) AS mape, arg_min(d, mape) AS d FROM mape GROUP BY 1),
best AS (SELECT series_id, round(mape, 4) AS mape, CAST(0 AS INTEGER) AS p, d, CAST(0 AS INTEGER) AS q,
  CASE WHEN mape < 100 THEN round(mape, 4) ELSE 100.0 END AS ref_mape, CAST(0 AS INTEGER) AS ref_p,
  CASE WHEN mape < 100 THEN d ELSE 0 END AS ref_d, CAST(0 AS INTEGER) AS ref_q, CAST(3 AS BIGINT) AS n_candidates FROM b)"""


def _rounded_best(best: DataFrame) -> DataFrame:
    return best.withColumns({"mape": F.round("mape", 4), "ref_mape": F.round("ref_mape", 4)})


@query(f"WITH {EVENTS_IDX}, {HIST}, {CLOSED}, {BEST} SELECT * FROM best")
def select_best(spark, sf):
    rows = events(spark, sf)
    return _rounded_best(evaluate.select_best(search.closed_form_scores(rows, [(0, 0, 0), (0, 1, 0), (0, 2, 0)]), rows))


@query(f"WITH {MONTHLY_IDX}, {HIST}, {CLOSED}, {BEST} SELECT * FROM best")
def order_search_closed_form(spark, sf):
    return _rounded_best(search.order_search(monthly(spark, sf), CLOSED_GRID))


@query()
def rolling_origin_eval(spark, sf):
    rows = monthly(spark, sf)
    return search.rolling_origin_eval(rows, search.candidate_grid(rows, GRID))


@query()
def order_search_arma(spark, sf):
    return search.order_search(monthly(spark, sf), GRID)


@query()
def order_search_auto(spark, sf):
    """Orders proposed by the data itself."""
    return search.order_search(monthly(spark, sf), search.OrderGrid(include_zero=True))


@query()
def arima_fit(spark, sf):
    rows = monthly(spark, sf)
    grid = search.candidate_grid(rows, GRID)
    return arima.arima_fit(rows, grid, max_p=2, max_d=1, max_q=2)


# (0,1,1) by brute force: the residual recursion runs for a grid of theta at once, then for ever finer grids around the best one.
# A fit is (series_id, t): the history before row t. Residuals from the third on count.
def _ma1_sql(steps: tuple[float, ...]) -> str:
    """Fits by grids of theta, each around the best value of the one before; f{k} is the answer of the k-th finer one."""
    grids = [f"""r{k} AS (SELECT f{k - 1}.series_id, t, u, list_transform(range(-100, 101), lambda i: theta + i * {step}) AS theta,
         list_transform(range(-100, 101), lambda i: w) AS e, list_transform(range(-100, 101), lambda i: 0.0::DOUBLE) AS s
       FROM f{k - 1} JOIN w ON w.series_id = f{k - 1}.series_id AND u = 0
       UNION ALL SELECT series_id, t, u, theta, e, list_transform(e, lambda v, i: s[i] + CASE WHEN u >= 2 THEN v * v ELSE 0 END)
       FROM (SELECT w.series_id, t, w.u, theta, s, list_transform(e, lambda v, i: w.w - theta[i] * v) AS e
             FROM r{k} JOIN w ON w.series_id = r{k}.series_id AND w.u = r{k}.u + 1 AND w.u <= t - 3)),
f{k} AS (SELECT series_id, t, theta[list_position(s, list_min(s))] AS theta, list_min(s) AS s, e[list_position(s, list_min(s))] AS e
       FROM r{k} WHERE u = t - 3)""" for k, step in enumerate(steps, 1)]
    return """w AS (SELECT series_id, seq - 2 AS u, value - lag(value) OVER (PARTITION BY series_id ORDER BY seq) AS w FROM idx QUALIFY seq >= 2),
r0 AS (SELECT series_id, u, list_transform(range(0, 421), lambda i: -1.05 + i * 0.005) AS theta, list_transform(range(0, 421), lambda i: w) AS e,
         list_transform(range(0, 421), lambda i: 0.0::DOUBLE) AS s FROM w WHERE u = 0
       UNION ALL SELECT series_id, u, theta, e, list_transform(e, lambda v, i: s[i] + CASE WHEN u >= 2 THEN v * v ELSE 0 END)
       FROM (SELECT w.series_id, w.u, theta, s, list_transform(e, lambda v, i: w.w - theta[i] * v) AS e
             FROM r0 JOIN w ON w.series_id = r0.series_id AND w.u = r0.u + 1)),
f0 AS (SELECT fits.series_id, t, theta[list_position(s, list_min(s))] AS theta FROM fits JOIN r0 ON r0.series_id = fits.series_id AND u = t - 3),
""" + ",\n".join(grids)


MA1 = _ma1_sql((0.0001, 0.000002))
MA1_FINE = _ma1_sql((0.0001, 0.000002, 0.00000004))
MA1_FIT = "SELECT series_id, t - 1 AS n, round(theta, 3) AS ma1, round(s / (t - 4) / var, 6) AS sigma2 FROM f2 JOIN (SELECT series_id, var_pop(w) AS var FROM w GROUP BY 1) USING (series_id)"


def _ma1(rows):
    """(0,1,1) on whole series; the residual variance as a share of that of the differences."""
    models = arima.arima_fit(rows, search.candidate_grid(rows, search.OrderGrid(p=(0,), d=(1,), q=(1,))), max_p=0, max_d=1, max_q=1)
    spread = differenced(rows).where("seq >= 2").groupBy("series_id").agg(F.var_pop("value").alias("var"))
    return models.join(spread, "series_id").select(
        "series_id", "n", rounded(F.element_at("ma", 1), 3, "ma1"), rounded(F.col("sigma2") / F.col("var"), 6, "sigma2"))


@query(f"WITH RECURSIVE {MONTHLY_IDX}, fits AS (SELECT series_id, max(seq) + 1 AS t FROM idx GROUP BY 1), {MA1} {MA1_FIT}")
def arima_fit_ma1(spark, sf):
    return _ma1(monthly(spark, sf))


@query(f"WITH RECURSIVE {EVENTS_IDX}, fits AS (SELECT series_id, max(seq) + 1 AS t FROM idx GROUP BY 1), {MA1} {MA1_FIT}")
def arima_fit_ma1_events(spark, sf):
    """Differences of noise: theta near -1, where no lag may be cut, on chunked series."""
    return _ma1(events(spark, sf))


ROLLING_MA1 = """SELECT f.series_id, f.t AS seq, round(y.value + f.theta * f.e, 2) AS forecast
FROM {last} f JOIN idx y ON y.series_id = f.series_id AND y.seq = f.t - 1"""


@query(f"""WITH RECURSIVE {EVENTS_IDX}, fits AS (SELECT series_id, seq AS t FROM idx WHERE seq > CAST(trunc(n * 0.98::DOUBLE) AS BIGINT)),
{MA1_FINE} {ROLLING_MA1.format(last='f3')}""")
def rolling_ma1(spark, sf):
    """(0,1,1) fitted again before each of the last rows, theta near -1, where no lag may be cut, on chunked series."""
    rows = events(spark, sf)
    orders = search.candidate_grid(rows, search.OrderGrid(p=(0,), d=(1,), q=(1,)))
    steps = arima.rolling_steps(rows, orders, max_p=0, max_d=1, max_q=1, ratio=0.98)
    return steps.select("series_id", "seq", rounded("forecast", 2))


MA1_GRID = search.OrderGrid(p=(0,), d=(1,), q=(0, 1))
AR_GRID = search.OrderGrid(p=(0, 1, 2), d=(1,), q=(0,))
# steps (series_id, p, q, actual, f) to the best order
SCORED = """scored AS (SELECT series_id, CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q, avg(abs((actual - f) / actual)) * 100 AS mape FROM steps GROUP BY ALL),
best AS (SELECT series_id, round(mape, 4) AS mape, p, CAST(1 AS INTEGER) AS d, q, CASE WHEN mape < 100 THEN round(mape, 4) ELSE 100.0 END AS ref_mape,
  CASE WHEN mape < 100 THEN p ELSE 0 END AS ref_p, CASE WHEN mape < 100 THEN 1 ELSE 0 END AS ref_d, CASE WHEN mape < 100 THEN q ELSE 0 END AS ref_q,
  (SELECT count(DISTINCT (p, q)) FROM steps) AS n_candidates
  FROM scored QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mape, p + q, p, q) = 1)"""
MA1_STEPS = """steps AS (SELECT i.series_id, 0 AS p, 1 AS q, i.value AS actual, y.value + f3.theta * f3.e AS f FROM f3
    JOIN idx i ON i.series_id = f3.series_id AND i.seq = t JOIN idx y ON y.series_id = f3.series_id AND y.seq = t - 1
  UNION ALL SELECT series_id, 0, 0, actual, y1 FROM h WHERE seq > k)"""
AR_STEPS = """steps AS (SELECT series_id, 0 AS p, 0 AS q, actual, y1 AS f FROM h WHERE seq > k
  UNION ALL SELECT series_id, 1, 0, actual, f1 FROM f UNION ALL SELECT series_id, 2, 0, actual, f2 FROM f)"""


# an account that even orders fill and odd ones empty: its steps are near white noise, so that a fit has one minimum
BALANCE_IDX = """steps_by_month AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts,
  avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END) AS step FROM orders GROUP BY 1, 2),
balance AS (SELECT series_id, ts, 1000000 + sum(step) OVER (PARTITION BY series_id ORDER BY ts) AS value FROM steps_by_month), """ + INDEX.format(
    rows="balance", tie="")


def balance_rows(spark: SparkSession, sf: str) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    steps = table(spark, sf, "orders").groupBy("o_orderpriority", month).agg(F.avg(signed).alias("step"))
    value = 1000000 + F.sum("step").over(Window.partitionBy("o_orderpriority").orderBy("ts"))
    return as_series(steps.withColumn("value", value), ["ts", "value"], "o_orderpriority")


@query(f"""WITH RECURSIVE {BALANCE_IDX}, {HIST}, fits AS (SELECT series_id, seq AS t FROM h WHERE seq > k), {MA1_FINE}, {MA1_STEPS}, {SCORED}
SELECT 's' AS session_id, 'tune' AS stage, CAST(0 AS BIGINT) AS n_filled, * FROM best""")
@in_scratch
def tune_ma1(spark, sf, folder):
    """The result table of ``tune`` over (0,1,0) and (0,1,1)."""
    layout = store.Layout(folder)
    stages.tune(balance_rows(spark, sf), layout, "s", MA1_GRID)
    return _stored_stage(spark, layout, "tune")


@query(f"""WITH RECURSIVE {BALANCE_IDX}, {HIST}, fits AS (SELECT series_id, seq AS t FROM h WHERE seq > k), {MA1_FINE}, {MA1_STEPS}
SELECT series_id, CAST(p AS INTEGER) AS p, CAST(1 AS INTEGER) AS d, CAST(q AS INTEGER) AS q, count(*) AS n_steps,
  round(avg(abs((actual - f) / actual)) * 100, 4) AS mape FROM steps GROUP BY ALL""")
def score_candidates_ma1(spark, sf):
    """Every candidate's score, (0,1,0) in closed form and (0,1,1) by refits."""
    rows = index_series(balance_rows(spark, sf))
    scored = search.score_candidates(rows, search.candidate_grid(rows, MA1_GRID))
    return scored.select("series_id", "p", "d", "q", "n_steps", rounded("mape", 4))


@query(f"WITH {MONTHLY_IDX}, {HIST}, {W.format(rows='idx')}, {AR_STEPS}, {SCORED} SELECT * FROM best")
def order_search_ar(spark, sf):
    return _rounded_best(search.order_search(monthly(spark, sf), AR_GRID))


# least squares of d = 1, p = 1 and 2 without constant on whole series
AR_MODELS = """x AS (SELECT series_id, seq, n, value, value - lag(value, 1) OVER s AS w0, lag(value, 1) OVER s - lag(value, 2) OVER s AS w1,
  lag(value, 2) OVER s - lag(value, 3) OVER s AS w2 FROM idx WINDOW s AS (PARTITION BY series_id ORDER BY seq)),
sums AS (SELECT series_id, any_value(n) AS n, arg_max(value, seq) AS y, arg_max(w0, seq) AS l1, arg_max(w1, seq) AS l2,
  sum(w0 * w0) FILTER (w1 IS NOT NULL) AS s00, sum(w0 * w1) AS s01, sum(w1 * w1) AS s11, sum(w0 * w0) FILTER (w2 IS NOT NULL) AS t00,
  sum(w0 * w1) FILTER (w2 IS NOT NULL) AS t01, sum(w0 * w2) AS t02, sum(w1 * w1) FILTER (w2 IS NOT NULL) AS t11, sum(w1 * w2) AS t12, sum(w2 * w2) AS t22
  FROM x GROUP BY 1),
ab AS (SELECT *, s01 / s11 AS a, (t01 * t22 - t02 * t12) / (t11 * t22 - t12 * t12) AS a1, (t02 * t11 - t01 * t12) / (t11 * t22 - t12 * t12) AS a2 FROM sums),
models AS (SELECT series_id, n, CAST(0 AS INTEGER) AS p, NULL::DOUBLE AS ar1, NULL::DOUBLE AS ar2, y AS next_value, NULL::DOUBLE AS share FROM ab
  UNION ALL SELECT series_id, n, CAST(1 AS INTEGER), a, NULL, y + a * l1, (s00 - a * s01) / s00 FROM ab
  UNION ALL SELECT series_id, n, CAST(2 AS INTEGER), a1, a2, y + a1 * l1 + a2 * l2, (t00 - a1 * t01 - a2 * t02) / t00 FROM ab)"""


def _ar_models(models: DataFrame) -> DataFrame:
    return models.select("series_id", "n", "p", *[rounded(F.get("ar", F.lit(k)), 6, f"ar{k + 1}") for k in (0, 1)], rounded("next_value", 2))


@query(f"""WITH {EVENTS_IDX}, {AR_MODELS} SELECT series_id, n, p, round(ar1, 6) AS ar1, round(ar2, 6) AS ar2, round(next_value, 2) AS next_value
FROM models WHERE p > 0""")
def arima_fit_ar(spark, sf):
    """(1,1,0) and (2,1,0) on whole, chunked series."""
    rows = events(spark, sf)
    return _ar_models(arima.arima_fit(rows, search.candidate_grid(rows, search.OrderGrid(p=(1, 2), d=(1,), q=(0,))), max_p=2, max_d=1, max_q=0))


@query(f"""WITH {MONTHLY_IDX}, {HIST}, {W.format(rows='idx')}, {AR_STEPS}, {SCORED}, {AR_MODELS}
SELECT series_id, n, p, round(ar1, 6) AS ar1, round(ar2, 6) AS ar2, round(next_value, 2) AS next_value FROM models JOIN best b USING (series_id, p)
WHERE b.ref_d = 1""")
@in_scratch
def train_ar_models(spark, sf, folder):
    """``train`` over autoregressive orders: the models that it leaves are the least-squares fits of the winners."""
    layout = store.Layout(folder)
    stages.train(monthly_rows(spark, sf), layout, "s", AR_GRID)
    return _ar_models(store.load_model(spark, layout, "s").where("d = 1"))


AR1_FIT = f"""WITH {EVENTS_IDX}, x AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY seq) AS y1 FROM idx),
m AS (SELECT series_id, any_value(n) AS n, regr_slope(value, y1) AS b, regr_intercept(value, y1) AS a,
  arg_max(value, seq) AS last FROM x GROUP BY 1)
SELECT series_id, n, round(a, 5) AS const, round(b, 6) AS ar1, round(a + b * last, 5) AS next_value FROM m"""


@query(AR1_FIT)
@in_scratch
def load_model(spark, sf, folder):
    """AR(1) models fitted on whole series, saved, and the latest version loaded."""
    rows = events(spark, sf)
    layout = store.Layout(folder)
    orders = search.candidate_grid(rows, search.OrderGrid(p=(1,), d=(0,), q=(0,)))
    # an older version first, fitted on all but the last values
    older = rows.where(F.col("seq") < F.col("n")).withColumn("n", F.col("n") - 1)
    for part in (older, rows):
        store.save_model(arima.arima_fit(part, orders, max_p=1, max_d=0, max_q=0), layout, "s")
    found = store.load_model(spark, layout, "s")
    return found.select("series_id", "n", rounded("const", 5), rounded(F.element_at("ar", 1), 6, "ar1"),
                        rounded("next_value", 5))


@query(f"""WITH RECURSIVE {EVENTS_IDX}, r AS (SELECT series_id, seq, n, value, 10.0::DOUBLE AS f FROM idx WHERE seq = 1
  UNION ALL SELECT i.series_id, i.seq, i.n, i.value, 10 + 0.3 * r.value - 0.4 * (r.value - r.f)
  FROM r JOIN idx i ON i.series_id = r.series_id AND i.seq = r.seq + 1)
SELECT series_id, seq, n, round(f, 6) AS forecast, round(value - f, 6) AS residual FROM r WHERE seq > CAST(trunc(n * 0.7::DOUBLE) AS BIGINT)""")
@in_scratch
def follow(spark, sf, folder):
    """Stored models go over the older rows, are stored with their state and forecast the newer ones, by chunks."""
    rows, layout = events(spark, sf), store.Layout(folder)
    number = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<double>")
    models = rows.groupBy("series_id").agg(F.max("n").alias("n")).select(
        "series_id", *[F.lit(v).cast("int").alias(c) for c, v in (("p", 1), ("d", 0), ("q", 1))], F.lit(10.0).alias("const"),
        number([0.3]).alias("ar"), number([-0.4]).alias("ma"))
    store.save_model(models, layout, "s")
    older = rows.where(F.col("seq") <= F.floor(F.col("n").cast("double") * 0.7))
    stages.follow(older, layout, "s", chunk_rows=256)
    # the last rows alone: what lies before them comes from the stored state
    newer = rows.where(F.col("seq") > F.floor(F.col("n").cast("double") * 0.65))
    found = stages.follow(newer, layout, "s", chunk_rows=256)
    seen = store.load_model(spark, layout, "s").select("series_id", "n")
    return found.join(seen, "series_id").select("series_id", "seq", "n", rounded("forecast"), rounded(F.col("actual") - F.col("forecast"), 6, "residual"))


def _stored_results(spark, sf, folder: str, stage: str) -> DataFrame:
    """Two runs of the closed-form search in a result table; the later one counts."""
    layout = store.Layout(folder)
    rows = monthly(spark, sf)
    for grid in (search.OrderGrid(p=(0,), d=(2,), q=(0,)), CLOSED_GRID):
        store.write_result(search.order_search(rows, grid), layout, "s1", stage)
    return store.read_results(spark, layout)


@query(f"""WITH {MONTHLY_IDX}, {HIST}, {CLOSED}, {BEST} SELECT series_id, ref_mape AS "MAPE", CAST(ref_p AS DOUBLE) AS "P",
  CAST(ref_d AS DOUBLE) AS "D", CAST(ref_q AS DOUBLE) AS "Q" FROM best""")
@in_scratch
def best_hyperparameters(spark, sf, folder):
    return store.best_hyperparameters(_stored_results(spark, sf, folder, "tune"), "s1").withColumn("MAPE", F.round("MAPE", 4))


@query(f"WITH {MONTHLY_IDX}, {HIST}, {CLOSED}, {BEST} SELECT series_id, ref_p AS p, ref_d AS d, ref_q AS q FROM best")
@in_scratch
def load_trained_order(spark, sf, folder):
    return store.load_trained_order(_stored_results(spark, sf, folder, "train"), "s1")


@query(f"WITH {MONTHLY_IDX}, {HIST}, {CLOSED}, {BEST} SELECT series_id, ref_mape AS mape, ref_p AS p, ref_d AS d, ref_q AS q FROM best")
def order_text(spark, sf):
    """Results written as interchange text and parsed back into typed columns."""
    best = _rounded_best(search.order_search(monthly(spark, sf), CLOSED_GRID))
    text = fn.order_to_text(*[F.col(f"ref_{c}") for c in ("mape", "p", "d", "q")])
    return best.select("series_id", fn.order_from_text(text).alias("r")).select("series_id", "r.*")


# ---------------------------------------------------------------- stages

@query(f"""WITH {EVENTS.replace(', event_id', '')}, {INDEX.format(rows='raw', tie=', value')}, {TRAIN},
s AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM train GROUP BY 1)
SELECT series_id, ts, round(CASE WHEN seq <= CAST(trunc(n * (80 / 100.0::DOUBLE)) AS BIGINT)
  THEN (value - lo) / (hi - lo) ELSE value END, 8) AS value,
  CASE WHEN seq <= CAST(trunc(n * (80 / 100.0::DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM idx JOIN s USING (series_id)""")
@in_scratch
def preprocess(spark, sf, folder):
    """Ingest and preprocess as stages: raw table, split, training part scaled."""
    layout = store.Layout(folder)
    raw = stages.ingest(spark, source(sf), "events", ["ts", "value"], layout, "s", series="event_type")
    done = stages.preprocess(raw, layout, "s", plan=[scale.ScaleStep("value", scale.NORMALIZATION)])
    return done.select("series_id", "ts", rounded("value", 8), F.col("split").cast("string").alias("split"))


# values left out, among the training rows so that no scored value is 0
GAP = "(event_id % 10 = 3 AND ts < TIMESTAMP '2024-01-10 00:00:00')"


@query(f"""WITH raw AS (SELECT event_type AS series_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
  CASE WHEN {GAP} THEN 0 ELSE value END AS value, event_id, {GAP} AS gap FROM events),
{INDEX.format(rows='raw', tie=', event_id')}, {HIST}, {CLOSED}, {BEST}, g AS (SELECT count(*) FILTER (gap) AS n_filled FROM raw)
SELECT series_id, mape, d, ref_mape, ref_d, n_filled FROM best, g""")
@in_scratch
def stage_checks(spark, sf, folder):
    """Times rounded to the hour and values left out: the stages order equal times by the tie column and count what they fill."""
    rows = table(spark, sf, "events").select(
        "event_type", F.date_trunc("hour", "ts").alias("ts"), F.when(~F.expr(GAP), F.col("value")).alias("value"), "event_id")
    rows.write.parquet(f"{folder}/tables/hours.parquet")
    layout = store.Layout(folder)
    hours = table_sources.TableSource("parquet", {"path": f"{folder}/tables"})
    raw = stages.ingest(spark, hours, "hours", ["ts", "value"], layout, "s", series="event_type", tie=["event_id"])
    stages.tune(raw, layout, "s", CLOSED_GRID, tie=["event_id"])
    best = _rounded_best(store.read_results(spark, layout).where("stage = 'tune'"))
    return best.select("series_id", "mape", "d", "ref_mape", "ref_d", "n_filled")


@query()
@in_scratch
def tune(spark, sf, folder):
    return stages.tune(monthly_rows(spark, sf), store.Layout(folder), "s", GRID).drop("run_ts")


@query()
@in_scratch
def train(spark, sf, folder):
    return stages.train(monthly_rows(spark, sf), store.Layout(folder), "s", GRID).drop("run_ts")


BEST_STORED = f"""WITH {MONTHLY_IDX}, {HIST}, {CLOSED}, {BEST}
SELECT 's' AS session_id, series_id, mape, p, d, q, ref_mape, ref_p, ref_d, ref_q, n_candidates,
  CAST(0 AS BIGINT) AS n_filled, 'STAGE' AS stage FROM best"""


def _stored_stage(spark, layout, stage) -> DataFrame:
    rows = store.read_results(spark, layout).where(F.col("stage") == stage).drop("run_ts")
    return _rounded_best(rows).withColumn("stage", F.col("stage").cast("string"))


@query(BEST_STORED.replace("STAGE", "tune"))
@in_scratch
def tune_closed_form(spark, sf, folder):
    """The result table as ``tune`` leaves it."""
    layout = store.Layout(folder)
    stages.tune(monthly_rows(spark, sf), layout, "s", CLOSED_GRID)
    return _stored_stage(spark, layout, "tune")


@query(BEST_STORED.replace("STAGE", "train"))
@in_scratch
def train_closed_form(spark, sf, folder):
    layout = store.Layout(folder)
    stages.train(monthly_rows(spark, sf), layout, "s", CLOSED_GRID)
    return _stored_stage(spark, layout, "train")


@query(f"""WITH {MONTHLY_IDX}, {HIST}, {CLOSED}, {BEST},
part AS (SELECT * FROM monthly WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2001-12-31'),
part_idx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS seq,
  count(*) OVER (PARTITION BY series_id) AS n FROM part),
late AS (SELECT series_id, value, seq, count(*) OVER (PARTITION BY series_id) AS n FROM part_idx
  WHERE seq <= CAST(trunc(n * (80 / 100.0::DOUBLE)) AS BIGINT)),
{HIST.replace("h AS", "h2 AS").replace("FROM idx", "FROM late")},
{CLOSED.replace("FROM h ", "FROM h2 ").replace("e AS", "e2 AS").replace("FROM e ", "FROM e2 ").replace("mape AS (", "mape2 AS (")}
SELECT b.series_id, round(m.mape, 4) AS mape, m.p, m.d, m.q, CASE WHEN m.mape < 100 THEN round(m.mape, 4) ELSE 100.0 END AS ref_mape,
  m.p AS ref_p, CASE WHEN m.mape < 100 THEN m.d ELSE 0 END AS ref_d, m.q AS ref_q, CAST(1 AS BIGINT) AS n_candidates,
  CAST(0 AS BIGINT) AS n_filled FROM best b JOIN mape2 m ON b.series_id = m.series_id AND b.ref_d = m.d""")
@in_scratch
def retrain(spark, sf, folder):
    """Train on all order months, then read a later date window again and score the stored orders."""
    layout = store.Layout(folder)
    rows = monthly_rows(spark, sf)
    rows.write.parquet(f"{folder}/tables/monthly.parquet")
    monthly_source = table_sources.TableSource("parquet", {"path": f"{folder}/tables"})
    stages.train(spark.read.parquet(f"{folder}/tables/monthly.parquet"), layout, "s", CLOSED_GRID)
    return stages.retrain(spark, monthly_source, "monthly", ["ts", "value"], layout, "s",
                          "1996-01-01", "2001-12-31", series="series_id").drop("run_ts").transform(_rounded_best)
