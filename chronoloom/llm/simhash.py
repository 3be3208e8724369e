"""SimHash near-duplicates: Golay-decoded keys find fingerprints a few bits apart."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, by_value, byte_texts, checkpointed, only, spread, unused
from .components import connected_components

SEED = 42
#: Shingles hashed at a time.
BLOCK = 1 << 16
#: The (23, 12) Golay code: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: First bit and width of the three segments of a fingerprint. 23 is the length of a code word; shorter ones have zeros above.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 values of the text's word shingles (repeats included).

    ASCII letters are lower-cased, words are separated by space and 0x09 to 0x0D. Fewer words than a shingle: the whole
    sequence is the one shingle. Null or no words: 0.
    """
    from xxhash import xxh64_digest

    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return int.from_bytes(xxh64_digest(b" ".join(words), SEED), "big")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = len(words) - shingle + 1
    starts = np.concatenate(([0], ends[:n - 1] + 1))
    ends, ones = ends[shingle - 1:], np.zeros(64, dtype=np.int64)
    for i in range(0, n, BLOCK):
        digests = b"".join([xxh64_digest(line[a:b], SEED) for a, b in
                            zip(starts[i:i + BLOCK].tolist(), ends[i:i + BLOCK].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one row per input row."""
    by_value()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in byte_texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = only(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _remainder(x: int) -> int:
    for bit in range(22, 10, -1):
        if x >> bit & 1:
            x ^= GENERATOR << bit - 11
    return x


class Golay:
    """Nearest code word of 23-bit numbers. The code is perfect: each number is within 3 bits of exactly one code word."""

    def __init__(self):
        self.bytes = [np.array([_remainder(b << shift & 0x7FFFFF) for b in range(256)], dtype=np.int32) for shift in (0, 8, 16)]
        self.error = np.zeros(2048, dtype=np.int32)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                self.error[_remainder(e)] = e

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Index (12 bits) of the nearest code word."""
        low, mid, high = self.bytes
        s = low[x & 255] ^ mid[x >> 8 & 255] ^ high[x >> 16]
        return (x ^ self.error[s]) >> 11


def home_keys(fp: np.ndarray, golay: Golay) -> np.ndarray:
    """One code word index per segment: shape (n, 3)."""
    return np.stack([golay.decode((fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int32)) for at, width in SEGMENTS], 1)


def near_keys(fp: np.ndarray, golay: Golay) -> list[np.ndarray]:
    """Per segment, the indices that the segment and all segments one bit away decode to: (n, width + 1), repeats as -1."""
    out = []
    for at, width in SEGMENTS:
        x = (fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int32)
        flips = np.concatenate(([0], 1 << np.arange(width))).astype(np.int32)
        keys = np.sort(golay.decode(x[:, None] ^ flips[None, :]), axis=1)
        keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
        out.append(keys)
    return out


def _key(pair: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (pair << 24 | a.astype(np.int64) << 12 | b).astype(np.int32)


PAIRS = ((0, 1), (0, 2), (1, 2))


def _home_rows(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    keys = home_keys(fp, golay)
    return np.concatenate([_key(k, keys[:, i], keys[:, j]) for k, (i, j) in enumerate(PAIRS)]), np.tile(fp, len(PAIRS))


def _near_rows(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    near, keys, owners = near_keys(fp, golay), [], []
    for k, (i, j) in enumerate(PAIRS):
        a, b = near[i][:, :, None], near[j][:, None, :]
        row, x, y = np.nonzero((a >= 0) & (b >= 0))
        keys.append(_key(k, near[i][row, x], near[j][row, y]))
        owners.append(fp[row])
    return np.concatenate(keys), np.concatenate(owners)


def _keyed(fps: DataFrame, rows, step: int, names: tuple[str, str]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), step):
                key, owner = rows(fp[i:i + step], golay)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner.view(np.int64))], list(names))

    return fps.mapInArrow(task, f"{names[0]} int, {names[1]} long")


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b), a < b as signed numbers: all pairs of different fingerprints in the column ``fp`` that differ in at most
    ``max_bits`` (3 at most) bits; a pair may come more than once.

    At most 3 differing bits over three segments leave two segments with at most one each. So one of a pair is filed
    under its code word indices of each two segments, the other looks under all index pairs that one flipped bit per
    segment can lead to (5 indices a segment on average); whatever they share is compared in full inside the join.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("three segments find up to 3 differing bits")
    by_value()
    home = _keyed(fps, _home_rows, 1 << 14, ("key", "a"))
    near = _keyed(fps, _near_rows, 1 << 10, ("key", "b"))
    return home.join(near.hint("merge"), "key").where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per input row; component_id is the smallest doc_id that links can reach.

    Rows with equal fingerprints are linked through the fingerprint, without pairs: only distinct fingerprints are
    searched. Null and empty texts have fingerprint 0. Null ids take part and never become a component_id, unless all
    ids of a component are null. Repeated rows share their component. An empty table gives an empty result.
    """
    rows = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(spread(distinct.select("fp"), "fp"), max_bits), "a", "b")
    placed = distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    root = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(root, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows without near copies: of the rows whose texts are in one component, the one of the smallest id stays.

    Each row is judged by its own text, also where rows share an id. Among rows of the smallest id the one of the smallest text
    key (MD5) stays, of rows that repeat both any one. A null id comes after all others. Null and empty texts are one component.
    """
    key, name = unused(docs, "text_key"), unused(docs, "kept_key")
    rows = docs.withColumn(key, F.coalesce(F.md5(F.col(f"`{text_col}`").cast("binary")), F.lit("")))
    groups = simhash_groups(rows, shingle, max_bits, key, text_col).select(F.col("doc_id").alias("key"), "component_id").distinct()
    own = F.struct(F.col(f"`{id_col}`").isNull().alias("unnamed"), F.col(f"`{id_col}`").alias("id"))
    texts = rows.groupBy(F.col(key).alias("key")).agg(F.min(own).alias("own"), F.count("*").alias("n"))
    first = F.min(F.struct("own.unnamed", "own.id", "key")).alias("first")
    kept = checkpointed(texts.join(groups, "key").groupBy("component_id").agg(first).select(
        F.col("first.id").alias(f"{name}_id"), F.col("first.key").alias(name)))
    left = rows.join(kept, (F.col(key) == F.col(name)) & F.col(f"`{id_col}`").eqNullSafe(F.col(f"{name}_id")), "left_semi")
    twice = checkpointed(rows.groupBy(key, F.col(f"`{id_col}`").alias(f"{name}_id")).count().where("count > 1").select(F.col(key).alias(name)).distinct())
    if twice.isEmpty():
        return left.drop(key)
    # one of the rows that repeat id and text
    again = left.join(twice, F.col(key) == F.col(name), "left_semi").dropDuplicates([key])
    return left.join(twice, F.col(key) == F.col(name), "left_anti").unionByName(again).drop(key)
