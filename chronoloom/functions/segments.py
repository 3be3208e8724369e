"""Sums over runs of rows that lie next to each other in one batch.

``mapInArrow`` hands over batches that cut groups anywhere; ``whole_groups`` puts
them back together so that many short groups are handled in one numpy call.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# Mean group length from which one call per group beats one call for all groups.
LONG_GROUP = 256

Columns = dict[str, np.ndarray]


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Columns, pa.Array, np.ndarray]]:
    """Complete groups as columns, their ids, and the position of each group's first row.

    ``series_id`` is set on the first row of a group and NULL on the others. Only
    the last, maybe unfinished group of a batch is held back.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("series_id").is_valid().to_numpy(zero_copy_only=False))
        if starts.size:
            last = int(starts[-1])
            yield from _columns([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    yield from _columns(held)


def _columns(parts: list[pa.RecordBatch]):
    parts = [p for p in parts if p.num_rows]
    if not parts:
        return
    join = lambda name: pa.concat_arrays([p.column(name) for p in parts])
    ids = join("series_id")
    starts = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
    names = [c for c in parts[0].schema.names if c != "series_id"]
    yield {c: join(c).to_numpy(zero_copy_only=False) for c in names}, ids.drop_null(), starts


def to_batch(ids: pa.Array, arrays: list[np.ndarray], **columns) -> pa.RecordBatch:
    """One row per group: its id, further columns, and an array named ``sums``."""
    sums = pa.array(arrays, type=pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([ids, *[pa.array(v) for v in columns.values()], sums],
                                      names=["series_id", *columns, "sums"])


def group_numbers(rows: int, starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows)))


def lag_sums(a: np.ndarray, b: np.ndarray, starts: np.ndarray, lags: int) -> np.ndarray:
    """(groups, lags + 1): per group the sum of ``a[t] * b[t - k]`` for k = 0..lags."""
    out = np.zeros((len(starts), lags + 1))
    if len(a) > LONG_GROUP * len(starts):
        for g, (lo, hi) in enumerate(zip(starts, np.append(starts[1:], len(a)))):
            for k in range(min(lags + 1, hi - lo)):
                out[g, k] = a[lo + k:hi] @ b[lo:hi - k]
        return out
    group = group_numbers(len(a), starts)
    for k in range(min(lags + 1, len(a))):
        product = np.zeros(len(a))
        product[k:] = a[k:] * b[:len(b) - k] * (group[k:] == group[:len(a) - k])
        out[:, k] = np.add.reduceat(product, starts)
    return out
