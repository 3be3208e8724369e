"""Hard-negative mining over Parquet blocks in Hilbert order, chosen by zone maps and interval arithmetic."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import use_checkpoint_dir
from .common import by_value, checkpointed

#: Rows of a block; blocks of a range (a task reads a range of blocks for a group of anchors); zone maps that meet a group at once.
BLOCK, RANGE, ZONES = 64, 128, 4096
#: The curve runs through this many components, those of greatest variance, at this many levels (as bits) each.
CURVE_TERMS, CURVE_BITS = 9, 7
#: Windows that are compared with a range at a time.
STACK = 512

_LEAST, _MOST = -2 ** 62, 2 ** 62
BLOCK_SCHEMA = "block long, range long, ids array<long>, labels array<int>, v array<long>, least array<long>, most array<long>, kinds array<int>"
FOUND_SCHEMA = "anchor_id long, tag long, vec_id long, score long"


def hilbert(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of non-negative levels below 2**bits (Skilling's transposition, published 2004)."""
    x = levels.astype(np.int64).T.copy()
    n, top = len(x), 1 << bits - 1
    q = top
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, 0)
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> b & 1)
    return place


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def _terms(rows: DataFrame, width: int) -> list[tuple[int, float, float]]:
    """(component, mean, deviation) of the components of greatest variance: sums where the rows are, merged by aggregation."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            v = _matrix(batch.column(0), width).astype(float)
            n, one, two = n + len(v), one + v.sum(axis=0), two + (v * v).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(one), pa.array(two)],
                                         ["term", "n", "one", "two"])

    sums = rows.select("v").mapInArrow(task, "term int, n long, one double, two double").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).collect()
    spread = [(r["term"], r["one"] / max(r["n"], 1), math.sqrt(max(r["two"] / max(r["n"], 1) - (r["one"] / max(r["n"], 1)) ** 2, 0.0))) for r in sums]
    return sorted(spread, key=lambda t: (-t[2], t[0]))[:CURVE_TERMS]


def write_blocks(rows: DataFrame, path: str, n: int, width: int) -> DataFrame:
    """Write the rows (vec_id, label, v) as Parquet blocks in the order of a Hilbert curve and return the table.

    A row of the table is a block of up to BLOCK vectors with its zone map: the least and the greatest value of every component, and
    which labels it holds. Rows are sorted by (place on the curve, vec_id) over partitions, so that copies of one vector spread as well;
    a range is RANGE successive blocks of a partition.
    """
    by_value()
    terms = _terms(rows, width)
    at, mean, wide = (np.array([t[k] for t in terms], dtype=kind) for k, kind in ((0, int), (1, float), (2, float)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), width)[:, at]
            levels = np.clip((v - mean) / np.where(wide > 0, wide * 5, 1.0) + 0.5, 0, 1) * (2 ** CURVE_BITS - 1)
            places = hilbert(levels.astype(np.int64), CURVE_BITS) if len(at) and len(v) else np.zeros(len(v), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["vec_id", "label", "v", "place"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held, k = TaskContext.get().partitionId() << 32, [], 0

        def block(part: pa.Table) -> pa.RecordBatch:
            v, labels = _matrix(part["v"], width), part["label"].to_numpy()
            return pa.RecordBatch.from_arrays([
                pa.array([first + k], pa.int64()), pa.array([(first + k) // RANGE], pa.int64()), _lists([part["vec_id"].to_pylist()], pa.int64()),
                _lists([labels], pa.int32()), _lists([v.ravel()], pa.int64()), _lists([v.min(axis=0)], pa.int64()),
                _lists([v.max(axis=0)], pa.int64()), _lists([np.unique(labels)], pa.int32())],
                ["block", "range", "ids", "labels", "v", "least", "most", "kinds"])

        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            while table.num_rows >= BLOCK:
                yield block(table.slice(0, BLOCK))
                table, k = table.slice(BLOCK), k + 1
            held = table.to_batches()
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield block(table)

    spark = rows.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (BLOCK * 8)))
    placed = rows.select("vec_id", "label", "v").mapInArrow(place, "vec_id long, label int, v array<long>, place long")
    ordered = placed.repartitionByRange(parts, "place", "vec_id").sortWithinPartitions("place", "vec_id").select("vec_id", "label", "v")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """A number type in which inner products of rows of these two are exact."""
    size = float(max(abs(a).max(initial=0), 1)) * float(max(abs(b).max(initial=0), 1)) * max(a.shape[1], 1)
    return np.float64 if size < 2 ** 53 else np.int64


class _Windows:
    """The windows of some anchors: ``row`` of the anchor in ``v``, ``tag``, least and greatest score, for its own label or the others."""

    def __init__(self, table: pa.Table, width: int):
        self.ids, self.labels = table["anchor_id"].to_numpy(), table["label"].to_numpy()
        self.v = _matrix(table["v"], width)
        low = table["low"].combine_chunks()
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(low.offsets.to_numpy()))
        self.tag, self.low, self.high = (table[c].combine_chunks().flatten().to_numpy().copy() for c in ("tag", "low", "high"))

    def needed(self, zones: pa.Table, same: bool, width: int) -> np.ndarray:
        """Which blocks hold a label that counts and an interval of scores that meets a window, for any anchor here."""
        least, most = _matrix(zones["least"], width), _matrix(zones["most"], width)
        kind = _kind(self.v, np.concatenate([least, most]))
        up, down = np.maximum(self.v, 0).astype(kind), np.minimum(self.v, 0).astype(kind)
        highest = up @ most.T.astype(kind) + down @ least.T.astype(kind)
        lowest = up @ least.T.astype(kind) + down @ most.T.astype(kind)
        lists = zones["kinds"].combine_chunks()
        kinds, n_kinds = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        block = np.repeat(np.arange(len(n_kinds)), n_kinds)
        out = np.zeros(len(n_kinds), dtype=bool)
        for label in np.unique(self.labels):
            has = np.zeros(len(n_kinds), dtype=bool)
            has[block[kinds == label]] = True
            counts = np.flatnonzero((has if same else n_kinds - has > 0) & ~out)
            mine = np.flatnonzero(self.labels[self.row] == label)
            for lo in range(0, len(mine), STACK):
                w = mine[lo:lo + STACK]
                meets = (highest[self.row[w]][:, counts] >= self.low[w, None]) & (lowest[self.row[w]][:, counts] <= self.high[w, None])
                out[counts[meets.any(axis=0)]] = True
        return out

    def best(self, blocks: pa.Table, same: bool, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, vec_id, score) of the k best rows of each window among these blocks, ties to smaller numbers."""
        ids, labels = (blocks[c].combine_chunks().flatten().to_numpy() for c in ("ids", "labels"))
        v = blocks["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), width)
        order = np.argsort(ids, kind="stable")
        ids, labels, v = ids[order], labels[order], v[order]
        kind = _kind(self.v, v)
        found = []
        for lo in range(0, len(self.row), STACK):
            w = np.arange(lo, min(lo + STACK, len(self.row)))
            anchor, of = np.unique(self.row[w], return_inverse=True)
            scores = (self.v[anchor].astype(kind) @ v.T.astype(kind)).astype(np.int64)
            allowed = ((labels == self.labels[anchor][:, None]) == same) & (ids != self.ids[anchor][:, None])
            scores = np.where(allowed, scores, _LEAST - 1)[of]
            scores[(scores < self.low[w, None]) | (scores > self.high[w, None])] = _LEAST - 1
            every = np.arange(len(w))
            for _ in range(min(k, len(ids))):
                top = scores.argmax(axis=1)
                good = scores[every, top] >= _LEAST
                found.append((w[good], ids[top[good]], scores[every[good], top[good]]))
                scores[every, top] = _LEAST - 1
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate([f[j] for f in found]) for j in range(3))


def _together(left: DataFrame, right: DataFrame, keys: list[str], task, schema: str) -> DataFrame:
    """``task(left rows, right rows)`` for each key; a set number of partitions, since sizes say little about the work."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # both sides may come from one table, hence the renaming
    right = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns]).withColumnsRenamed({f"right_{c}": c for c in right.columns if c not in keys})
    theirs = [f"right_{k}" for k in keys]
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *theirs).groupBy(*theirs)).applyInArrow(task, schema)


def window_search(windows: DataFrame, blocks: DataFrame, same: bool, k: int, width: int) -> DataFrame:
    """(anchor_id, tag, vec_id, score): for each window of each anchor the k best rows with a score inside it, ties to smaller numbers.

    ``windows`` (anchor_id, label, v, group, tag array, low array, high array): ``group`` is the range of blocks where the anchor lies.
    ``same`` picks rows of the anchor's label, else those of the others; rows with the anchor's number are its own.

    First the anchor's own range raises the lower end of every window that has k rows there. Then interval arithmetic on the zone maps
    chooses the blocks that may hold a row inside a window, for a group of anchors together; only those are read.
    """
    by_value()

    def at_home(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left
        w = _Windows(left, width)
        which, _, scores = w.best(right, same, k, width)
        which, scores = which[np.lexsort((-scores, which))], scores[np.lexsort((-scores, which))]
        last = np.flatnonzero(np.append(which[1:] != which[:-1], True)) if len(which) else which
        full = last[np.bincount(which, minlength=len(w.row))[which[last]] == k] if len(which) else last
        w.low[which[full]] = np.maximum(w.low[which[full]], scores[full])
        low = pa.ListArray.from_arrays(left["low"].combine_chunks().offsets, pa.array(w.low))
        return left.set_column(left.column_names.index("low"), "low", low)

    schema = "anchor_id long, label int, v array<long>, group long, tag array<long>, low array<long>, high array<long>"
    windows = windows.select("anchor_id", "label", "v", "group", "tag", "low", "high")
    windows = checkpointed(_together(windows, blocks.withColumnRenamed("range", "group"), ["group"], at_home, schema))

    zones = blocks.select("block", "least", "most", "kinds")
    shards = max(1, math.ceil(zones.count() / ZONES))
    groups = windows.select("group").distinct()

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, names=["group", "block"])
        chosen = right.filter(pa.array(_Windows(left, width).needed(right, same, width)))
        return pa.table([pa.array([left["group"][0].as_py()] * chosen.num_rows, pa.int64()), chosen["block"]], names=["group", "block"])

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    dealt = zones.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)))
    per_group = groups.withColumn("shard", every).join(dealt, "shard")
    chosen = checkpointed(_together(windows.withColumn("shard", every), per_group, ["group", "shard"], choose, "group long, block long"))

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "tag", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        w = _Windows(left, width)
        which, ids, scores = w.best(right, same, k, width)
        return pa.table([w.ids[w.row[which]], w.tag[which], ids, scores], names=names)

    taken = chosen.join(blocks.select("block", "range", "ids", "labels", "v"), "block")
    wanted = windows.join(chosen.select("group", F.floor(F.col("block") / RANGE).alias("range")).distinct(), "group")
    near = _together(wanted, taken, ["group", "range"], read, FOUND_SCHEMA)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows`` (vec_id long, label int, v array<long>).

    Scores are inner products, higher ones first, ties to the smaller number. A positive is one of the best ``positives`` rows of the
    anchor's label; its negatives are the best ``negatives`` rows of other labels whose score is from ``low`` to ``high`` hundredths of the
    positive's. An anchor or positive without any has no rows; neither has an empty table.

    Rows without number, label or vector take no part. Rows that repeat number, label and vector are one; other rows of a number
    are rows of their own, but an anchor's number never meets itself, and an anchor with several is the smallest (label, vector).
    Missing components count as 0. Scores have to fit a long.
    """
    spark = rows.sparkSession
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").select("vec_id", "label", "v", is_anchor.alias("anchor"))
    rows = checkpointed(rows.dropDuplicates(["vec_id", "label", "v"]))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = int(size["n"]), max(int(size["width"] or 0), 1)
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/blocks-{uuid.uuid4().hex}"
    blocks = write_blocks(rows, path, n, width)
    anchors = rows.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one"))
    home = blocks.select("range", F.explode("ids").alias("anchor_id")).groupBy("anchor_id").agg(F.min("range").alias("group"))
    anchors = anchors.select(F.col("vec_id").alias("anchor_id"), "one.label", "one.v").join(home, "anchor_id")

    def windows(*arrays: Column) -> list[str | Column]:
        return ["anchor_id", "label", "v", "group", *[a.cast("array<bigint>").alias(name) for a, name in zip(arrays, ("tag", "low", "high"), strict=True)]]

    anchors = checkpointed(anchors)
    ends = windows(F.array(F.lit(0)), F.array(F.lit(_LEAST)), F.array(F.lit(_MOST)))
    best = checkpointed(window_search(anchors.select(*ends), blocks, True, positives, width))
    # the window's ends in whole numbers: low * p <= 100 * s <= high * p
    up = F.expr(f"cast(-floor(-({low} * cast(score as decimal(20,0))) / 100) as bigint)")
    down = F.expr(f"cast(floor({high} * cast(score as decimal(20,0)) / 100) as bigint)")
    spans = best.select("anchor_id", F.col("rank").cast("long").alias("tag"), up.alias("low"), down.alias("high")).where("low <= high")
    spans = spans.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("tag", "low", "high"))).alias("w"))
    found = window_search(anchors.join(spans, "anchor_id").select(*windows(F.col("w.tag"), F.col("w.low"), F.col("w.high"))), blocks, False, negatives, width)
    pairs = best.select("anchor_id", F.col("rank").cast("long").alias("tag"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["anchor_id", "tag"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                                                          F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
