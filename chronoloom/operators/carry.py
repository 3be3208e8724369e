"""Models that carry their state: forecasts of newer rows without a refit.

A model with state holds, beside its parameters, the last values and residuals of the rows it has seen. ``carry_forward`` runs its residual
recursion e_t = w_t - const - sum phi_i w_{t-i} - sum theta_j e_{t-j} on over newer rows, chunk by chunk: every chunk is swept from a zero state,
a scan over the chunks of a series composes these affine maps (``functions.affine``), and every chunk is swept again from the state that
really enters it. The result are one-step forecasts and the models with their state after the last row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine
from ..session import checkpointed
from .index import BROADCAST_ROWS, CHUNK_ROWS, shuffle_partitions

#: What a model with state has beyond its parameters: rows seen, their last p + d values and last q residuals, oldest first.
STATE = "n bigint, last array<double>, residuals array<double>"
FORECAST_SCHEMA = "series_id string, seq bigint, actual double, forecast double"
_PARAMS = ["p", "d", "q", "const", "ar", "ma", "residuals"]


def without_history(models: DataFrame) -> DataFrame:
    """The models as they are before any row: to be carried over a series from its start."""
    empty = F.array().cast("array<double>")
    return models.withColumns({"n": F.lit(0).cast("bigint"), "last": empty, "residuals": empty})


def _packed(rows: DataFrame, models: DataFrame, chunk_rows: int) -> DataFrame:
    """One row per (series, chunk) of newer rows: values in order behind those before them that lags and differences need."""
    reach = models.agg(F.max(F.col("p") + F.col("d"))).first()[0] or 0
    starts = models.select("series_id", "n", "last")
    newer = rows.select("series_id", "seq", F.col("value").cast("double").alias("value")).join(
        _small(starts.select("series_id", "n"), starts), "series_id").where(F.col("seq") > F.col("n"))
    seen = starts.select("series_id", "n", F.posexplode("last").alias("at", "value"), F.size("last").alias("held")).select(
        "series_id", (F.col("n") - F.col("held") + F.col("at") + 1).alias("seq"), "value", "n")
    each = newer.select("series_id", "seq", "value", "n").unionByName(seen)
    place = F.col("seq") - F.col("n") - 1
    size = F.lit(chunk_rows)
    copies = F.sequence(F.floor(place / size), F.floor((place + reach) / size)).cast("array<bigint>")
    each = each.select("series_id", "seq", "value", "n", F.explode(copies).alias("chunk")).where("chunk >= 0")
    packed = each.groupBy("series_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("s"), F.first("n").alias("n"))
    first = F.col("n") + F.col("chunk") * size + 1
    return packed.select("series_id", "chunk", first.alias("first"), F.get("s", F.lit(0))["seq"].alias("seq0"),
                         F.transform("s", lambda s: s["value"]).alias("values")).where(F.col("seq0") + F.size("values") > F.col("first"))


def _small(table: DataFrame, counted: DataFrame) -> DataFrame:
    return F.broadcast(table) if counted.count() <= BROADCAST_ROWS else table


def _residuals(row: dict, values: np.ndarray, state: np.ndarray | None):
    """(place of the first own value among all, actual values, their residuals, recursion, state after them); NaN where differences are undefined."""
    p, d, q = row["p"], row["d"], row["q"]
    recursion = affine.Recursion(np.array([[*row["ar"], *row["ma"]]], dtype=float).reshape(1, p + q), p, q, False, order=0)
    w = np.diff(values, n=d) if d else values
    own = row["first"] - row["seq0"]
    known = max(own - d, 0)
    inputs = affine.input_rows(w[known:], p, w[:known])[:-1].copy()
    inputs[:, 0] -= row["const"] or 0.0
    e, after = recursion.sweep(inputs, None if state is None else state[None])
    lost = len(values) - own - len(inputs)
    return values[own:], np.concatenate([np.full(lost, np.nan), e[0, :, 0]]), recursion, after[0]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        lists = batch.column(batch.schema.names.index("values"))
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for i, row in enumerate(batch.drop_columns(["values"]).to_pylist()):
            yield row, values[offsets[i]:offsets[i + 1]]


_OFFSETS = "series_id string, chunk bigint, p int, q int, ar array<double>, ma array<double>, residuals array<double>, rows bigint, offset array<double>"


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for row, values in _rows(batches):
        actual, e, _, after = _residuals(row, values, None)
        out.append((row["series_id"], row["chunk"], row["p"], row["q"], row["ar"], row["ma"], row["residuals"], int((~np.isnan(e)).sum()), after.tolist()))
    floats = pa.list_(pa.float64())
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), floats, floats, floats, pa.int64(), floats]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in _OFFSETS.split(", ")])


def _scan(group: pd.DataFrame) -> pd.DataFrame:
    """The residuals, latest first, that enter each chunk of a series, and those after the last one."""
    group = group.sort_values("chunk")
    one = group.iloc[0]
    p, q = int(one["p"]), int(one["q"])
    recursion = affine.Recursion(np.array([[*one["ar"], *one["ma"]]], dtype=float).reshape(1, p + q), p, q, False, order=0)
    held = np.asarray(one["residuals"], dtype=float)[::-1][:q]
    state, states, through = np.concatenate([held, np.zeros(q - len(held))]), [], {}
    for rows, offset in zip(group["rows"], group["offset"], strict=True):
        states.append(state)
        if rows not in through:
            through[rows] = recursion.transfer(int(rows))[0]
        state = through[rows] @ state + np.asarray(offset, dtype=float)
    final = [None] * (len(group) - 1) + [state[::-1]]
    return pd.DataFrame({"series_id": group["series_id"].to_numpy(), "chunk": group["chunk"].to_numpy(), "state": states, "after": final})


def _forecasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, values in _rows(batches):
        actual, e, _, _ = _residuals(row, values, np.array(row["state"], dtype=float))
        n = len(actual)
        yield pa.RecordBatch.from_arrays([pa.array([row["series_id"]] * n), pa.array(row["first"] + np.arange(n), pa.int64()), pa.array(actual),
                                          pa.array(actual - e, mask=np.isnan(e))], [c.split()[0] for c in FORECAST_SCHEMA.split(", ")])


def carry_forward(models: DataFrame, rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(FORECAST_SCHEMA rows, models): one-step forecasts of all rows after the ones a model has seen, and the models after them.

    ``models`` has one row a series with p, d, q, const, ar, ma and the STATE columns (``without_history`` for none); ``rows`` (series_id, seq,
    value) may hold older rows, which are left out, and have to be without gaps after the last seen one. Rows of series without a
    model, and models without newer rows, stay as they are or give no forecast. The first d rows of a series have none (null).
    """
    packed = checkpointed(_packed(rows, models, chunk_rows).repartition(shuffle_partitions(rows), "series_id", "chunk"))
    few = models.count() <= BROADCAST_ROWS
    params = models.select("series_id", *_PARAMS)

    def attached(table: DataFrame, keys: list[str], small: bool) -> DataFrame:
        if small:
            return packed.join(F.broadcast(table), keys)
        if "chunk" not in keys:
            table = packed.select("series_id", "chunk").join(table, "series_id")
        return packed.join(table, ["series_id", "chunk"])

    ready = checkpointed(attached(params, ["series_id"], few))
    states = checkpointed(ready.mapInArrow(_offsets, _OFFSETS).groupBy("series_id").applyInPandas(
        _scan, "series_id string, chunk bigint, state array<double>, after array<double>"))
    entering = states.select("series_id", "chunk", "state")
    forecasts = ready.join(F.broadcast(entering) if states.count() <= BROADCAST_ROWS else entering, ["series_id", "chunk"]).mapInArrow(
        _forecasts, FORECAST_SCHEMA)
    keep = F.col("p") + F.col("d")
    end: Column = F.struct("chunk", (F.col("seq0") + F.size("values") - 1).alias("n"), F.when(keep > 0, F.slice(
        "values", F.greatest(F.size("values") - keep + 1, F.lit(1)), F.greatest(keep, F.lit(1)))).otherwise(F.array().cast("array<double>")).alias("last"))
    newest = ready.select("series_id", end.alias("end")).groupBy("series_id").agg(F.max_by("end", "end.chunk").alias("end"))
    after = states.where("after IS NOT NULL").select("series_id", "after")
    moved = newest.join(after, "series_id").select("series_id", F.col("end.n").alias("new_n"), F.col("end.last").alias("new_last"), "after")
    kept = models.join(moved, "series_id", "left").withColumns(
        {"n": F.coalesce("new_n", "n"), "last": F.coalesce("new_last", "last"), "residuals": F.coalesce("after", "residuals")})
    return forecasts, kept.drop("new_n", "new_last", "after")
