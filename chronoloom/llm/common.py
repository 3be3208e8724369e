"""Shared helpers: input columns, words of a batch as byte ranges, reliable checkpoints."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_checkpoint_dir

#: Keys of 32 characters that are sent to every task rather than joined by shuffle, at most.
BROADCAST_KEYS = 200_000
#: Texts of one batch are worked on in runs of about this many bytes (a longer text is a run of its own).
RUN_BYTES = 2_000_000
#: Bytes of text that Spark sends a Python task at a time, at most about.
BATCH_BYTES = 4_000_000

LOWER = bytes(range(256)).lower()
#: Bytes of words that white space (space and 0x09 to 0x0D) separates.
NOT_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Bytes of words made of ASCII letters, digits and anything beyond ASCII.
ALNUM = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def by_value() -> None:
    """Send this package's functions with the task, so that workers need no copy of it on their path."""
    package = __name__.rpartition(".")[0]
    for name, module in list(sys.modules.items()):
        if name == package or name.startswith(package + "."):
            cloudpickle.register_pickle_by_value(module)


def small_batches(spark: SparkSession) -> None:
    """Have Spark fill Arrow batches to BATCH_BYTES rather than to 10000 rows, whatever these hold; a limit that the session has stays.

    A batch is held several times over outside the heap: where it is built, in the worker, and where its result is read. The
    setting holds for whatever the session plans from here on. It changes no result.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named input columns under this package's own names; whatever else the input has stays out of the way."""
    return df.select(*[F.col(f"`{name}`").alias(alias) for alias, name in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column of ``gone``; rows without an id stay."""
    name = unused(docs, "gone_id")
    return docs.join(gone.toDF(name), F.col(f"`{id_col}`") == F.col(name), "left_anti")


def without_texts(docs: DataFrame, text_col: str, judged: Callable[[DataFrame, str], DataFrame], among: Column | None = None) -> DataFrame:
    """The rows of ``docs`` (of ``among``) whose own text is not rejected: ``judged(rows, key)`` gives the keys (doc_id) of rejected texts."""
    key = unused(docs, "text_key")
    of_text = F.coalesce(F.md5(F.col(f"`{text_col}`").cast("binary")), F.lit(""))
    rows = docs.withColumn(key, of_text if among is None else F.when(among, of_text))
    gone = checkpointed(judged(rows, key).where("doc_id IS NOT NULL").select("doc_id").distinct())
    # few keys go to the rows; many are joined by shuffle
    return without(rows, key, F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone).drop(key)


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the cluster's shared checkpoint folder and read from there."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def worker_cache(key: object, make):
    """What ``make`` returned for this key in this worker process, for all its tasks."""
    held = sys.modules.setdefault("chronoloom_worker_cache", types.ModuleType("chronoloom_worker_cache")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


class Kept(dict):
    """A worker's cache of ``make``: a full one becomes the old generation, from which keys still in use return. Long keys are not kept."""

    ENTRIES, CHARS = 200_000, 64

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.CHARS:
            if len(self) >= self.ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_alphabet() -> list[str]:
    """The printable stand-ins of byte-level BPE by byte: visible Latin-1 characters for themselves, the rest from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def public_tokenizer(name: str) -> str:
    """Path of an installed public tokenizer file (on the driver)."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """By these keys over as many partitions as the session uses for shuffles."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes of text each."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


class Words:
    """The words of some texts, as byte ranges of one buffer.

    ``data`` all bytes, ``starts``/``ends`` the words, ``doc`` the row of each word, ``first`` the first word of each
    row (one entry more than rows). A null text has no words.
    """

    def __init__(self, texts: list[bytes | None], word_bytes: np.ndarray, lower: bool):
        joined = b" ".join(t or b"" for t in texts)
        if lower:
            joined = joined.translate(LOWER)
        self.raw = joined
        self.data = np.frombuffer(joined, dtype=np.uint8)
        inside = np.zeros(len(self.data) + 2, dtype=np.int8)
        inside[1:-1] = word_bytes[self.data]
        turn = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive) joined by one space."""
        return b" ".join(self.raw[s:e] for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit number per word: a polynomial of its bytes modulo 2**64, mixed. Equal words have equal numbers."""
        return mix(polynomial(self.data, self.starts, self.ends, seed))


def _odd(seed: int) -> int:
    return (0x9E3779B97F4A7C15 * (2 * seed + 1) ^ 0xD1B54A32D192ED03) % 2**64 | 1


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Sum of value times base**place over each range, from running sums (modulo 2**64, where an odd base has an inverse)."""
    base = _odd(seed)
    n = len(values)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, base, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        back = np.full(n + 1, pow(base, -1, 2**64), dtype=np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        return (total[ends] - total[starts]) * back[starts]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a published finalizer: xor-shift and multiply, twice)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def each_text(texts: pa.Array, step: int = 512) -> Iterator[str]:
    """The texts as strings, few at a time in memory; null as empty."""
    for i in range(0, len(texts), step):
        for text in texts.slice(i, step).to_pylist():
            yield text or ""


def byte_texts(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary()).to_pylist()
