"""Exact refits of moving-average orders on long histories, chunk by chunk.

The residual recursion of given parameters is affine in the state that enters a chunk (``functions.affine``). A round takes one
anchor, a parameter row, for each run of successive refits of a (series, order):

1. every chunk is swept from a zero state and returns an offset of a few numbers; a scan over the chunks of a series composes
   these maps into the state that really enters each chunk;
2. every chunk is swept from that state and returns the sums of products of its residuals and their derivatives; running sums
   of them give what lies before each chunk;
3. chunks with refits solve each from the sums before its row. Those too far from the anchor form the runs of the next round, with an
   anchor from the expansion at their middle.

Nothing is grouped but rows of a chunk, and chunk summaries of a series, of which there are no more than a chunk has rows. A round
reads each row twice, whatever the number of refits, and rounds go on until every run is done.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import affine
from ..functions.arima import burn_in
from ..session import checkpointed
from .index import BROADCAST_ROWS, CHUNK_ROWS, longest_of, rechunk, shuffle_partitions, with_halo

#: Bytes of values in a partition of packed chunks, at most about.
PART_BYTES = 32_000_000

RUN = "series_id string, p int, d int, q int, lo long, hi long, anchor array<double>"
RUN_KEYS = ["series_id", "p", "d", "q", "lo", "hi"]
ORDER_KEYS = ["series_id", "p", "d", "q"]
FOUND = "series_id string, p int, d int, q int, done boolean, first long, last long, params array<double>, s double, following double"


def pack(rows: DataFrame, pivots: DataFrame, max_p: int, max_d: int, chunk_rows: int | None = None) -> DataFrame:
    """One row per (series, chunk): its values in order as an array, behind them the few rows before it that lags and differences need.

    ``pivots`` (series_id, pivot) is what levels are measured from.
    """
    longest = longest_of(rows)
    size = max(CHUNK_ROWS, math.isqrt(longest)) if chunk_rows is None else chunk_rows
    halo = with_halo(rechunk(rows.select("series_id", "seq", "n", "chunk", "value"), size), max_p + max_d)
    packed = halo.groupBy("series_id", "chunk").agg(
        F.max("n").alias("n"), F.min("seq").alias("seq0"), (F.min(F.when(F.col("own"), F.col("seq")))).alias("seq"),
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"]).alias("values"))
    total = rows.schema["seq"].metadata.get("rows") or 0
    parts = max(shuffle_partitions(rows), 8 * total // PART_BYTES)
    return checkpointed(packed.join(pivots, "series_id").repartition(parts, "series_id", "chunk"))


class _Chunk:
    """Rows of one packed chunk: position of the first differenced value in the series, the values after differencing, and lags."""

    def __init__(self, n: int, seq0: int, seq: int, values: np.ndarray, pivot: float):
        self.n, self.seq0, self.seq, self.values, self.pivot = n, seq0, seq, values, pivot

    def inputs(self, p: int, d: int) -> tuple[int, np.ndarray, bool]:
        """(place of the first own value, [w, lags] for each own value and the one after, whether the series ends here)."""
        w = np.diff(self.values, n=d) if d else self.values - self.pivot
        place = max(self.seq - d - 1, 0)
        own = place - (self.seq0 - 1)
        return place, affine.input_rows(w[own:], p, w[:own]), self.seq0 + len(self.values) - 1 >= self.n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, _Chunk, list[dict]]]:
    """(series, chunk, rows, runs) of packed rows with an array ``runs``."""
    for batch in batches:
        names = batch.schema.names
        lists = batch.column(names.index("values"))
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        rest = batch.drop_columns(["values"]).to_pylist()
        for i, row in enumerate(rest):
            yield row["series_id"], row["chunk"], _Chunk(row["n"], row["seq0"], row["seq"], values[offsets[i]:offsets[i + 1]], row["pivot"]), row["runs"]


def _by_order(runs: list[dict]) -> Iterator[tuple[tuple[int, int, int], list[dict]]]:
    orders: dict[tuple[int, int, int], list[dict]] = {}
    for r in runs:
        orders.setdefault((r["p"], r["d"], r["q"]), []).append(r)
    yield from orders.items()


def _stacks(runs: list[dict], p: int, d: int, q: int, rows: int) -> Iterator[tuple[list[dict], affine.Recursion]]:
    """Runs of one order, as many at a time as memory for a sweep over these rows allows."""
    width = len(affine.derivatives(p, q))
    block = max(affine.BLOCK, q)
    together = max(1, affine.STACK_VALUES // (width * max(rows, 1) + (1 + p) * width * block * block))
    for lo in range(0, len(runs), together):
        part = runs[lo:lo + together]
        yield part, affine.Recursion(np.array([r["anchor"] for r in part], dtype=float), p, q, d == 0)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(),
             "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


_OFFSETS = f"{RUN}, chunk long, place long, rows long, offset array<double>"
_STATES = f"{RUN}, chunk long, state array<double>"
_SUMS = f"{RUN}, chunk long, place long, rows long, state array<double>, sums array<double>"
_READY = f"{RUN}, chunk long, state array<double>, sums array<double>"


def _run_of(series: str, r: dict) -> tuple:
    return series, r["p"], r["d"], r["q"], r["lo"], r["hi"], r["anchor"]


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each chunk adds to the state, if it enters as zero."""
    for series, chunk, rows, runs in _chunks(batches):
        out = []
        for (p, d, q), some in _by_order(runs):
            place, inputs, _ = rows.inputs(p, d)
            some = [r for r in some if place <= r["hi"]]
            for part, recursion in _stacks(some, p, d, q, len(inputs)):
                _, state = recursion.sweep(inputs[:-1])
                out += [(*_run_of(series, r), chunk, place, len(inputs) - 1, state[k].tolist()) for k, r in enumerate(part)]
        yield _batch(out, _OFFSETS)


def _scan(group: pd.DataFrame) -> pd.DataFrame:
    """The state that enters each chunk of a run."""
    group = group.sort_values("chunk")
    first = group.iloc[0]
    recursion = affine.Recursion(np.array([first["anchor"]], dtype=float), int(first["p"]), int(first["q"]), first["d"] == 0)
    state, through, states = np.zeros(recursion.size), {}, []
    for rows, offset in zip(group["rows"], group["offset"], strict=True):
        states.append(state)
        if rows not in through:
            through[rows] = recursion.transfer(int(rows))[0]
        with np.errstate(all="ignore"):
            state = through[rows] @ state + offset
    return group.assign(state=states)[[*RUN_KEYS, "anchor", "chunk", "state"]]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products over each chunk, from the state that enters it."""
    for series, chunk, rows, runs in _chunks(batches):
        out = []
        for (p, d, q), some in _by_order(runs):
            place, inputs, _ = rows.inputs(p, d)
            skip, n = max(burn_in(p, q) - place, 0), len(inputs) - 1
            for part, recursion in _stacks(some, p, d, q, n):
                values, _ = recursion.sweep(inputs[:-1], np.array([r["state"] for r in part], dtype=float))
                terms = recursion.terms(values)
                for k, r in enumerate(part):
                    sums = affine.products(terms[k, skip:], np.array([max(n - skip, 0)]))[0]
                    out.append((*_run_of(series, r), chunk, place, n, r["state"], sums.tolist()))
        yield _batch(out, _SUMS)


def _before(group: pd.DataFrame) -> pd.DataFrame:
    """Sums over all earlier chunks, for the chunks in which a run has refits."""
    group = group.sort_values("chunk")
    sums = np.stack(group["sums"].to_numpy())
    with np.errstate(all="ignore"):
        group = group.assign(sums=list(np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)[:-1]])))
    return group[group["place"] + group["rows"] >= group["lo"]][[*RUN_KEYS, "anchor", "chunk", "state", "sums"]]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Refits whose row lies in the chunk: found ones, and ranges of those that need a nearer anchor."""
    for series, _, rows, runs in _chunks(batches):
        out = []
        for (p, d, q), some in _by_order(runs):
            place, inputs, final = rows.inputs(p, d)
            n, burn = len(inputs) - 1, burn_in(p, q)
            skip = max(burn - place, 0)
            some = [r for r in some if r["lo"] < place + n + final and r["hi"] >= place]
            for part, stack in _stacks(some, p, d, q, n):
                states = np.array([r["state"] for r in part], dtype=float)
                values, _ = stack.sweep(inputs[:-1], states)
                for k, r in enumerate(part):
                    recursion = affine.Single(stack, k)
                    at = np.arange(max(r["lo"], place), min(r["hi"], place + n - 1 + final) + 1) - place
                    triangle = np.array(r["sums"], dtype=float) + affine.products(recursion.terms(values[k:k + 1])[0][skip:], np.maximum(at - skip, 0))
                    params, s, good, _ = affine.expand(recursion, triangle, at + place - burn)
                    nxt = affine.following(recursion, values[k], states[k], inputs, at, params)
                    out += [(series, p, d, q, True, int(at[i]) + place, int(at[i]) + place, params[i].tolist(), float(s[i]), float(nxt[i]))
                            for i in np.flatnonzero(good)]
                    out += [(series, p, d, q, False, int(at[a]) + place, int(at[b - 1]) + place, anchor.tolist(), None, None)
                            for a, b, anchor in affine.open_pieces(good, params)]
        yield _batch(out, FOUND)


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Ranges that touch, over chunk borders, in up to affine.PIECES runs; the anchor of a run is that of the range where its middle lies."""
    touching: list[list] = []
    for r in group.sort_values("first").itertuples():
        if touching and r.first == touching[-1][-1].last + 1:
            touching[-1].append(r)
        else:
            touching.append([r])
    out = []
    for ranges in touching:
        first, rows = ranges[0].first, ranges[-1].last + 1 - ranges[0].first
        runs: dict[int, list] = {}
        for r in ranges:
            runs.setdefault((r.first - first) * affine.PIECES // rows, []).append(r)
        for run in runs.values():
            middle = (run[0].first + run[-1].last) // 2
            at = next(r for r in run if r.last >= middle)
            out.append((at.series_id, at.p, at.d, at.q, run[0].first, run[-1].last, at.params))
    return pd.DataFrame(out, columns=[*RUN_KEYS, "anchor"])


def _with_runs(packed: DataFrame, runs: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Packed chunks with the array of the runs that concern them; a shuffled join is keyed on (series, chunk)."""
    fields = [c for c in runs.columns if c not in ("series_id", "chunk")]
    arrays = runs.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("runs"))
    if few:
        return packed.join(F.broadcast(arrays), keys)
    if "chunk" not in keys:
        arrays = packed.select("series_id", "chunk").join(arrays, "series_id")
    return packed.join(arrays, ["series_id", "chunk"])


def refit(packed: DataFrame, runs: DataFrame) -> DataFrame:
    """(series_id, p, d, q, place, params, s, following): the fit on the first ``place`` differenced values, for each place of each run.

    ``runs`` has RUN columns: places from ``lo`` to ``hi`` and parameters to start from. ``s`` is the sum of squares and ``following`` the
    expected next difference. Places that find no fit in affine.MAX_ROUNDS rounds have no row.
    """
    runs = checkpointed(runs)
    chunks = packed.count()
    found = []
    for _ in range(affine.MAX_ROUNDS):
        n = runs.count()
        if not n:
            break
        few, few_summaries = n <= BROADCAST_ROWS, n * chunks <= BROADCAST_ROWS
        offsets = _with_runs(packed, runs, ["series_id"], few).mapInArrow(_offsets, _OFFSETS)
        states = offsets.groupBy(*RUN_KEYS).applyInPandas(_scan, _STATES)
        sums = _with_runs(packed, states, ["series_id", "chunk"], few_summaries).mapInArrow(_sums, _SUMS)
        ready = sums.groupBy(*RUN_KEYS).applyInPandas(_before, _READY)
        solved = checkpointed(_with_runs(packed, ready, ["series_id", "chunk"], few_summaries).mapInArrow(_solve, FOUND))
        found.append(solved.where("done"))
        runs = checkpointed(solved.where("NOT done").groupBy(*ORDER_KEYS).applyInPandas(_merge, RUN))
    out = found[0] if found else packed.sparkSession.createDataFrame([], FOUND)
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(*ORDER_KEYS, F.col("first").alias("place"), "params", "s", "following")
