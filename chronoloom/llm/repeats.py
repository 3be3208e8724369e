"""Substring dedup: repeated word windows, found by sorting suffixes cut at the window and partitioned by prefix.

The words that a repeat of at least a window covers are those that its windows cover, so no tree beyond that depth is built:
leaves are sorted by a hash of their window. A first round, by 32 bits of it, only says which windows may be repeated; a second one
compares these by all 64 bits and by a second, independent 64-bit hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, by_value, byte_texts, mix, only, runs

#: Suffixes of a group: a subtree is built in memory by one task.
GROUP_SUFFIXES = 3_000_000
#: Words that a task gathers before it deals their suffixes out.
RUN_WORDS = 2_000_000
#: Bytes of text for each word that group numbers are planned with.
BYTES_A_WORD = 6
#: Buckets of prefixes for each group. A bucket over 1/FINE of a group is split by a longer prefix.
BUCKETS_A_GROUP, FINE = 32, 4
_STEP, _STEP_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Words of more bytes have a digest as second number.
_LONG = 255
_UNNAMED = 2 ** 63 - 1


def prefix_lengths(window: int) -> list[int]:
    """1, 2, 4, ... and the window itself."""
    return [*(1 << k for k in range(window.bit_length()) if 1 << k < window), window]


def prefix_hashes(h: np.ndarray, window: int) -> list[np.ndarray]:
    """For each prefix length a 64-bit number of the words from each place on (places within ``window`` of the end are of no use)."""
    with np.errstate(over="ignore"):
        def joined(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
            out = a * np.uint64(pow(_STEP, m, 2 ** 64))
            out[:max(len(b) - n, 0)] += b[n:]
            return out

        doubled = {1: h}
        while 2 * max(doubled) < window:
            n = max(doubled)
            doubled[2 * n] = joined(doubled[n], n, doubled[n], n)
        n = max(doubled)
        whole = doubled[n]
        for m in sorted(doubled, reverse=True):
            while n + m <= window:
                whole, n = joined(whole, n, doubled[m], m), n + m
        return [mix(x ^ np.uint64(k)) for k, x in [*doubled.items(), (window, whole)]] if window > 1 else [mix(h ^ np.uint64(1))]


def word_seconds(words: Words) -> np.ndarray:
    """A second 64-bit number per word, of another base; of long words, where polynomials can agree whatever the base, a digest."""
    out = words.hashes(5)
    for k in np.flatnonzero(words.ends - words.starts > _LONG):
        out[k] = int.from_bytes(hashlib.blake2b(words.raw[words.starts[k]:words.ends[k]], digest_size=8).digest(), "little")
    return out


def window_seconds(h: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """The second 64-bit number of the windows at these places."""
    out = np.zeros(len(places), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            out = out * np.uint64(_STEP_2) + h[places + k]
    return mix(out)


class Run:
    """The words of some texts: 64-bit word hashes, the first word of each text, and the places where a whole window starts.

    With ``asked`` (first and last place of rows of starts, and the text of each) and ``seconds`` only the places asked for.
    """

    def __init__(self, hashes: list[np.ndarray], counts: list[np.ndarray], window: int, asked: tuple[list, list] | None = None,
                 seconds: list[np.ndarray] | None = None):
        self.h = np.concatenate(hashes)
        self.counts = np.concatenate(counts)
        self.first = np.cumsum(self.counts) - self.counts
        sizes = np.maximum(self.counts - window + 1, 0)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.places = np.arange(len(self.doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.first[self.doc]
        self.second = None if seconds is None else np.concatenate(seconds)
        if asked is not None:
            pairs, owner = np.concatenate(asked[0]), np.concatenate(asked[1])
            sizes = pairs[:, 1] - pairs[:, 0] + 1
            start = pairs[:, 0] + self.first[owner]
            self.places = np.unique(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes))
            self.doc = np.searchsorted(self.first, self.places, side="right") - 1


def _runs(batches: Iterator[pa.RecordBatch], window: int, confirm: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, Run]]:
    """(ids, salts, run) for about RUN_WORDS words at a time; ``confirm``: of the places in the fourth column, with second hashes."""
    ids, salts, hashes, counts, pairs, owners, seconds, rows, held = [], [], [], [], [], [], [], 0, 0

    def run() -> tuple[np.ndarray, np.ndarray, Run]:
        asked = ((pairs, owners), seconds) if confirm else ()
        return np.concatenate(ids), np.concatenate(salts), Run(hashes, counts, window, *asked)

    for batch in batches:
        texts = byte_texts(batch.column(2))
        for a, b in runs(batch.column(2)):
            words = Words(texts[a:b], NOT_SPACE, lower=False)
            hashes.append(words.hashes(3))
            counts.append(np.diff(words.first))
            ids.append(batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False))
            salts.append(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False))
            if confirm:
                lists = batch.column(3).slice(a, b - a)
                pairs.append(lists.flatten().to_numpy().astype(np.int64).reshape(-1, 2))
                owners.append(rows + np.repeat(np.arange(b - a), pa.compute.list_value_length(lists).to_numpy() // 2))
                seconds.append(word_seconds(words))
            rows += b - a
            held += len(words)
            if held >= RUN_WORDS:
                yield run()
                ids, salts, hashes, counts, pairs, owners, seconds, rows, held = [], [], [], [], [], [], [], 0, 0
    if ids:
        yield run()


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as differences, byte by byte of equal weight, compressed."""
    import zstandard

    wide = numbers.astype(np.uint64)
    wide[1:] -= wide[:-1].copy()
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _three_bytes(numbers: np.ndarray) -> bytes:
    """Small numbers without order: four bytes each, or three where that is enough."""
    plain = numbers.astype("<u4")
    wide = 4 if plain.max(initial=0) >= 1 << 24 else 3
    return bytes([wide]) + np.ascontiguousarray(plain.view(np.uint8).reshape(-1, 4)[:, :wide]).tobytes()


def _from_three_bytes(data: bytes) -> np.ndarray:
    wide = data[0]
    raw = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, wide)
    out = np.zeros((len(raw), 4), dtype=np.uint8)
    out[:, :wide] = raw
    return out.view("<u4").reshape(-1).astype(np.int64)


class Routes:
    """The group of each suffix: by the shortest of its prefixes whose bucket is not overfull."""

    def __init__(self, groups: int, overfull: list[tuple[int, int]], window: int):
        self.groups, self.buckets, self.levels = groups, groups * BUCKETS_A_GROUP, len(prefix_lengths(window))
        self.overfull = [np.array(sorted(b for level, b in overfull if level == k), dtype=np.int64) for k in range(self.levels)]

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.buckets)).astype(np.int64)

    def group(self, hashes: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(hashes[0]), -1, dtype=np.int64)
        open_rows = np.arange(len(out))
        for level, h in enumerate(hashes):
            bucket = self.bucket(h[open_rows])
            last = level == self.levels - 1
            here = np.ones(len(bucket), dtype=bool) if last else ~np.isin(bucket, self.overfull[level])
            out[open_rows[here]] = (mix((bucket[here] * self.levels + level).astype(np.uint64)) % np.uint64(self.groups)).astype(np.int64)
            open_rows = open_rows[~here]
        return out


DEALT = ["group", "run", "paths", "seconds", "places", "done", "ids", "salts", "firsts"]
HITS = ["run", "places", "ids", "salts", "firsts"]
FOUND = pa.schema([("id", pa.int64()), ("salt", pa.int64()), ("ranges", pa.list_(pa.int32()))])


def _deal(number: int, ids: np.ndarray, salts: np.ndarray, run: Run, routes: Routes, window: int) -> pa.RecordBatch:
    """One row per group with the suffixes of a run. Of equal windows only those of the smallest document travel; the others are
    already known to repeat and are just noted. Without second hashes the smallest document's are noted with them, and
    half of the path is enough: all have to be confirmed."""
    hashes = [h[run.places] for h in prefix_hashes(run.h, window)]
    group = routes.group(hashes)
    path, doc = hashes[-1] if run.second is not None else hashes[-1] >> np.uint64(32), ids[run.doc]
    second = np.zeros(len(path), np.uint64) if run.second is None else window_seconds(run.second, run.places, window)
    order = np.lexsort((doc, second, path, group))
    second = second[order]
    group, path, doc, place, row = group[order], path[order], doc[order], run.places[order], run.doc[order]
    new = np.ones(len(path), dtype=bool)
    new[1:] = (path[1:] != path[:-1]) | (second[1:] != second[:-1]) | (group[1:] != group[:-1])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    noted = known = doc > least
    if run.second is None and len(known):
        noted = np.logical_or.reduceat(known, np.flatnonzero(new))[np.cumsum(new) - 1]
    out: list[list] = [[] for _ in DEALT]
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(group)), strict=True):
        some, gone = slice(a, b), known[a:b]
        rows = np.unique(row[some])
        values = (int(group[a]), number, packed(path[some][~gone]), b"" if run.second is None else second[some][~gone].tobytes(),
                  _three_bytes(place[some][~gone]), packed(np.sort(place[some][noted[some]])),
                  packed(ids[rows].view(np.uint64)), packed(salts[rows].view(np.uint64)), packed(run.first[rows]))
        for column, value in zip(out, values, strict=True):
            column.append(value)
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * (len(DEALT) - 2)]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], DEALT)


def _repeats(rows: pa.Table, window: int) -> pa.Table:
    """The leaves of a group in the order of their hashes, a node wherever these are equal. With second hashes a leaf that does not
    belong to the smallest document of its node starts a repeat; without, every leaf of a node of two documents may and is asked for.
    One row for each row of the group."""
    paths, seconds, docs, parts, places, owners = [], [], [], [], [], []
    table = rows.to_pydict()
    for k in range(rows.num_rows):
        path, place = unpacked(table["paths"][k]), _from_three_bytes(table["places"][k])
        ids, first = unpacked(table["ids"][k]).view(np.int64), unpacked(table["firsts"][k]).view(np.int64)
        owner = np.searchsorted(first, place, side="right") - 1
        paths.append(path)
        seconds.append(np.frombuffer(table["seconds"][k], dtype=np.uint64))
        docs.append(ids[owner])
        places.append(place)
        owners.append(owner)
        parts.append(np.full(len(path), k, dtype=np.int32))
    path, second, doc = np.concatenate(paths), np.concatenate(seconds), np.concatenate(docs)
    confirm = len(second) == len(path)
    order = np.lexsort((second, path)) if confirm else np.argsort(path, kind="stable")
    new = np.ones(len(path), dtype=bool)
    new[1:] = path[order][1:] != path[order][:-1]
    if confirm:
        new[1:] |= second[order][1:] != second[order][:-1]
    doc = doc[order]
    least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1] if len(doc) else doc
    repeat = doc > least
    if not confirm:
        repeat = np.logical_or.reduceat(repeat, np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = order[repeat]
    part, place, owner = np.concatenate(parts)[hit], np.concatenate(places)[hit], np.concatenate(owners)[hit]
    out: list[list] = [[] for _ in HITS]
    for k in range(rows.num_rows):
        mine, done = part == k, unpacked(table["done"][k]).view(np.int64)
        first = unpacked(table["firsts"][k]).view(np.int64)
        at = np.unique(np.concatenate([place[mine], done]))
        if len(at):
            docs_here = np.unique(np.searchsorted(first, at, side="right") - 1)
            ids, salts = (unpacked(table[c][k])[docs_here] for c in ("ids", "salts"))
            for column, value in zip(out, (table["run"][k], packed(at), packed(ids), packed(salts), packed(first[docs_here])), strict=True):
                column.append(value)
    kinds = [pa.int64(), *[pa.binary()] * (len(HITS) - 1)]
    return pa.table([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=HITS)


def _ranges(rows: pa.Table) -> pa.Table:
    """The repeats of a run put back together: per document first and last place of every unbroken row of window starts."""
    ids, salts, starts = [], [], []
    for row in rows.to_pylist():
        at, first = (unpacked(row[c]).view(np.int64) for c in ("places", "firsts"))
        owner = np.searchsorted(first, at, side="right") - 1
        ids.append(unpacked(row["ids"]).view(np.int64)[owner])
        salts.append(unpacked(row["salts"]).view(np.int64)[owner])
        starts.append(at - first[owner])
    doc, salt, start = (np.concatenate(x) for x in (ids, salts, starts))
    order = np.lexsort((start, salt, doc))
    doc, salt, start = doc[order], salt[order], start[order]
    new_doc = np.ones(len(doc), dtype=bool)
    new_doc[1:] = (doc[1:] != doc[:-1]) | (salt[1:] != salt[:-1])
    new = new_doc.copy()
    new[1:] |= start[1:] > start[:-1] + 1
    begins = np.flatnonzero(new)
    pairs = np.stack([start[begins], start[np.append(begins[1:], len(start)) - 1]], axis=1).astype(np.int32)
    docs = np.flatnonzero(new_doc)
    offsets = 2 * np.append(np.searchsorted(begins, docs), len(begins)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs.reshape(-1)))
    return pa.Table.from_arrays([pa.array(doc[docs]), pa.array(salt[docs]), lists], schema=FOUND)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, salt, doc_id, text) and the bytes of all texts. Rows that share an id, or have none, are told apart by a hash of their text."""
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_UNNAMED)))
    each = rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    most, size = each.agg(F.max("n"), F.sum("size")).first()
    salt = F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")) if (most or 0) > 1 else F.lit(0).cast("long")
    return rows.select("id", salt.alias("salt"), "doc_id", "text"), size or 0


def repeated_windows(rows: DataFrame, size: int, window: int = 13) -> DataFrame:
    """(id, salt, ranges array<int>): where windows start (words from 0) that also start in a document of a smaller id, as first and last
    place of unbroken rows of starts. ``rows`` (id, salt, text), ``size`` the bytes of all texts.

    Suffixes are partitioned by prefix. One pass counts the buckets of prefixes of 1, 2, 4, ... words over all texts; a bucket
    that would fill a large part of a group is split by the next longer prefix, so common words or passages do not make a
    group too large. A second pass sends each suffix, as half the path of its ``window`` words (32 of 64 bits) and place, to its group.
    What is found returns to the run that it came from, packed, so that a document gets one row however many groups it is in.
    A third pass does the same with the windows found only, by the whole path and a second 64-bit number of other word hashes; what
    does not agree in both is no repeat. ``rows`` may have more columns; they go along with the third pass.
    """
    by_value()
    spark = rows.sparkSession
    groups = max(1, math.ceil(size / BYTES_A_WORD / GROUP_SUFFIXES))
    plain = Routes(groups, [], window)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((plain.levels, plain.buckets), dtype=np.int64)
        for _, _, run in _runs(batches, window):
            for level, h in enumerate(prefix_hashes(run.h, window)[:-1]):
                total[level] += np.bincount(plain.bucket(h[run.places]), minlength=plain.buckets)
        level, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(bucket), pa.array(total[level, bucket])], ["level", "bucket", "n"])

    texts = rows.select("id", "salt", "text")
    counts = texts.mapInArrow(counted, "level long, bucket long, n long").groupBy("level", "bucket").agg(F.sum("n").alias("n"))
    overfull = [(r["level"], r["bucket"]) for r in counts.where(F.col("n") > GROUP_SUFFIXES // FINE).collect()]
    # plain values, since workers need not have this package
    overfull = spark.sparkContext.broadcast(overfull)

    def repeated(parts: DataFrame, confirm: bool) -> DataFrame:
        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            routes = Routes(groups, overfull.value, window)
            for k, (ids, salts, run) in enumerate(_runs(batches, window, confirm)):
                yield _deal(TaskContext.get().partitionId() << 32 | k, ids, salts, run, routes, window)

        by_group = parts.mapInArrow(dealt, "group int, run long, " + ", ".join(f"{c} binary" for c in DEALT[2:])).groupBy("group")
        by_run = by_group.applyInArrow(lambda group: _repeats(group, window), "run long, " + ", ".join(f"{c} binary" for c in HITS[1:])).groupBy("run")
        return by_document(by_run.applyInArrow(lambda run: _ranges(run), "id long, salt long, ranges array<int>"))

    # all columns of the rows, so that the exchange of the texts can serve the caller's join as well
    asked = rows.join(repeated(texts, False), ["id", "salt"])
    others = [c for c in rows.columns if c not in texts.columns]
    return repeated(asked.select("id", "salt", "text", "ranges", *others), True)


def by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("id", "salt").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every text without the words covered by a window that also starts in a document of a
    smaller id; kept words joined by one space.

    Words are separated by space and 0x09 to 0x0D and compared as they are; windows are judged on the input. Null and empty
    texts have no words. Null ids come after all others and are not smaller than each other. Rows that share an id do not
    make each other's windows repeats; each has its own result. An empty table gives an empty result.
    """
    rows, size = _keyed(docs, id_col, text_col)
    joined = rows.join(repeated_windows(rows, size, window), ["id", "salt"], "left").select("doc_id", "text", "ranges")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            offsets, places = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            for i, text in enumerate(byte_texts(batch.column(1))):
                words = (text or b"").split()
                at = places[offsets[i]:offsets[i + 1]].reshape(-1, 2)
                n_words.append(len(words))
                if len(at):
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(step, at[:, 0], 1)
                    np.add.at(step, at[:, 1] + window, -1)
                    words = [w for w, gone in zip(words, (np.cumsum(step[:-1]) > 0).tolist(), strict=True) if not gone]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(task, f"doc_id {kind}, n_words long, n_removed long, kept string")
