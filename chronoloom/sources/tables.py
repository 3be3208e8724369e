"""Two-column reads from relational tables or table files, filtered at the source."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.prepare import filter_date_range

JDBC_KINDS = ("mysql", "postgres", "jdbc")
FILE_KINDS = ("parquet", "orc")

_IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*)*$")


@dataclass(frozen=True)
class TableSource:
    """Where tables live.

    ``kind`` is ``mysql``, ``postgres``, ``jdbc``, ``snowflake``, ``parquet`` or
    ``orc``. ``options`` are the reader's own (url, user, password, ...; ``path``
    for files). They are used at read time only: never stored, and kept out of
    ``repr``.
    """

    kind: str
    options: Mapping[str, str] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        if self.kind not in (*JDBC_KINDS, "snowflake", *FILE_KINDS):
            raise ValueError(f"unknown source kind: {self.kind}")

    @classmethod
    def mysql(cls, host: str, database: str, user: str, password: str, port: int = 3306, **options) -> "TableSource":
        return cls("mysql", {"url": f"jdbc:mysql://{host}:{port}/{database}", "user": user, "password": password,
                             "driver": "com.mysql.cj.jdbc.Driver", **options})

    @classmethod
    def postgres(cls, host: str, database: str, user: str, password: str, port: int = 5432, **options) -> "TableSource":
        return cls("postgres", {"url": f"jdbc:postgresql://{host}:{port}/{database}", "user": user,
                                "password": password, "driver": "org.postgresql.Driver", **options})

    @classmethod
    def snowflake(cls, account: str, database: str, user: str, password: str, schema: str = "PUBLIC",
                  warehouse: str | None = None, **options) -> "TableSource":
        found = {"sfURL": f"{account}.snowflakecomputing.com", "sfUser": user, "sfPassword": password,
                 "sfDatabase": database, "sfSchema": schema}
        if warehouse:
            found["sfWarehouse"] = warehouse
        return cls("snowflake", {**found, **options})

    @property
    def format(self) -> str:
        return "jdbc" if self.kind in JDBC_KINDS else self.kind


def check_identifier(name: str) -> str:
    if not _IDENTIFIER.match(name):
        raise ValueError(f"not a plain table or column name: {name!r}")
    return name


def range_predicates(column: str, boundaries: Sequence[str]) -> list[str]:
    """Disjoint conditions that together cover every row, one per read task."""
    check_identifier(column)
    quoted = ["'" + str(b).replace("'", "''") + "'" for b in boundaries]
    if not quoted:
        return ["1 = 1"]
    first = f"{column} < {quoted[0]} OR {column} IS NULL"
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(quoted, quoted[1:])]
    return [first, *middle, f"{column} >= {quoted[-1]}"]


def reader_options(source: TableSource, table: str, ts_column: str, *, partitions: int | None = None,
                   bounds: tuple[str, str] | None = None) -> dict[str, str]:
    """Options for one table read; with ``partitions`` and ``bounds`` JDBC reads in parallel."""
    options = dict(source.options)
    if source.kind in FILE_KINDS:
        options["path"] = f"{options['path'].rstrip('/')}/{table}.{source.kind}"
        return options
    options["dbtable"] = check_identifier(table)
    if source.kind in JDBC_KINDS and partitions and bounds:
        options |= {"partitionColumn": check_identifier(ts_column), "lowerBound": str(bounds[0]),
                    "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return options


def time_bounds(spark: SparkSession, source: TableSource, table: str, ts_column: str) -> tuple[str, str] | None:
    """First and last time of a table, asked of the database itself; None when it has none."""
    text = f"SELECT MIN({check_identifier(ts_column)}) AS lo, MAX({ts_column}) AS hi FROM {check_identifier(table)}"
    row = run_query(spark, source, text).first()
    return None if row is None or row[0] is None else (str(row[0]), str(row[1]))


def read_table(spark: SparkSession, source: TableSource, table: str, columns: Sequence[str], *,
               extra: Sequence[str] = (), partitions: int | None = None,
               bounds: tuple[str, str] | None = None, boundaries: Sequence[str] = ()) -> DataFrame:
    """A time and a value column (plus ``extra`` id or tie columns) of a table.

    ``partitions`` cuts a JDBC read into equal steps of the time column between
    ``bounds`` (asked of the database if not given). Where rows crowd in a few
    periods, ``boundaries`` names the cuts instead, so that no one read task gets
    them all. A JDBC read with neither is one task that reads the whole table: fine
    for small tables only.
    """
    if len(columns) != 2:
        raise ValueError(f"expected exactly two columns (time, value), got {len(columns)}")
    wanted = [*columns, *extra]
    if source.kind not in FILE_KINDS:
        for c in wanted:
            check_identifier(c)
    if boundaries and source.kind in JDBC_KINDS:
        options = {k: v for k, v in source.options.items() if k != "url"}
        df = spark.read.jdbc(source.options["url"], check_identifier(table),
                             predicates=range_predicates(columns[0], boundaries), properties=options)
    else:
        if partitions and bounds is None and source.kind in JDBC_KINDS:
            bounds = time_bounds(spark, source, table, columns[0])
        options = reader_options(source, table, columns[0], partitions=partitions, bounds=bounds)
        df = spark.read.format(source.format).options(**options).load()
    return df.select(*wanted)


def read_table_range(spark: SparkSession, source: TableSource, table: str, columns: Sequence[str],
                     start, end, **options) -> DataFrame:
    """``read_table`` between two instants, both included; the filter reaches the source."""
    return filter_date_range(read_table(spark, source, table, columns, **options), start, end, columns[0])


def run_query(spark: SparkSession, source: TableSource, query: str, tables: Sequence[str] = ()) -> DataFrame:
    """The result of a query. Databases run it themselves, and one task reads what they
    return: let the query reduce or cut its rows, or use ``read_table`` with
    ``partitions``. For files Spark runs it, with each of ``tables`` as a view of that name."""
    if source.kind in FILE_KINDS:
        for table in tables:
            options = reader_options(source, check_identifier(table), "")
            spark.read.format(source.format).options(**options).load().createOrReplaceTempView(table)
        return spark.sql(query)
    return spark.read.format(source.format).options(**source.options).option("query", query.rstrip("; \n")).load()


def rows_to_frame(df: DataFrame, names: Sequence[str] = ("ts", "value")) -> DataFrame:
    """Name columns by position; the value becomes a double."""
    if len(df.columns) != len(names):
        raise ValueError(f"{len(df.columns)} columns, {len(names)} names")
    out = df.toDF(*names)
    return out.withColumn(names[-1], out[names[-1]].cast("double"))
