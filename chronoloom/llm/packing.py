"""Packing of documents into sequences: dominance reduction, then best fit, on the histogram of lengths."""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, by_value, byte_alphabet, checkpointed, each_text, only, worker_cache

#: Pre-tokens of the tokenizer below; characters from here on are left to the library.
PATTERN, BEYOND = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", "\u0250"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit numbers, for lower-casing byte-level BPE that drops white space.

    Such a tokenizer never joins characters across a space, so a text's ids are the ids of its space-separated parts,
    and these repeat. A part that was not seen before and has only Latin characters is split into pre-tokens here, which
    the library's model turns into tokens; any other part goes through the whole library.
    """

    def __init__(self, definition: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.letters = regex.compile(PATTERN).findall, dict(enumerate(byte_alphabet()))
        self.tokenize = self.tokenizer.model.tokenize
        self.part = Kept(self._part).__getitem__

    def fits(self) -> bool:
        """Whether the tokenizer behaves as said above, on a text with every Latin character in several places."""
        chars = [chr(c) for c in range(1, ord(BEYOND))]
        texts = [" ".join(f"{c} a{c} {c}b {c}{c}" for c in chars), "it's I'LL a'sx 'S we'd''t 12 3a!?.b", "a \n b\nc  d"]
        return all(self.encode(t) == self._direct(t) for t in texts)

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._direct(text)
        return b"".join(map(self.part, text.replace("\n", " ").split(" ")))

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        if part.isascii() and part.isalpha() and part.islower():
            return self._piece(part)
        if max(part) >= BEYOND or "\u0130" in part:
            return self._direct(part)
        pieces = self.pieces(part.lower())
        if pieces == [part]:
            return self._piece(part.encode().decode("latin-1").translate(self.letters))
        return b"".join(map(self.part, pieces))

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(piece)]).tobytes()


PIECE = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("part", pa.int64()), ("place", pa.int64())])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place[, ids binary]): the pieces of every text with its end token.

    Only texts longer than ``capacity`` are cut, into full pieces and a rest. A null text counts as an empty one: its
    piece is the end token. ``place`` counts the pieces of equal length in partition ``part``.
    """
    by_value()
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    if not Encoder(definition).fits():
        raise ValueError("this needs a lower-casing byte-level BPE that drops white space")
    shared, last = docs.sparkSession.sparkContext.broadcast(definition), np.array([end_id], dtype="<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_cache(("packing", shared.value), lambda: Encoder(shared.value))
        part, places = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            row, rest, ids = [], [], []
            for i, text in enumerate(each_text(batch.column(1))):
                data = encoder.encode(text) + last
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at:at + 4 * capacity]
                    n = len(piece) // 4
                    row.append(i)
                    rest.append((k, at // 4, n, zlib.crc32(piece), part, int(places[n])))
                    places[n] += 1
                    if keep_ids:
                        ids.append(piece)
            columns = [pa.array([x[j] for x in rest], f.type) for j, f in enumerate(PIECE)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns,
                                              *([pa.array(ids, pa.binary())] if keep_ids else [])],
                                             ["doc_id", *PIECE.names, *(["ids"] if keep_ids else [])])

    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, place long"
                           + (", ids binary" if keep_ids else ""))


@dataclass
class Bins:
    """``count`` sequences that all hold the same: ``content`` lists (length, copies)."""

    count: int
    content: list[tuple[int, int]]


class Lengths:
    """How many pieces of each length are still to be placed, in order of length."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.order = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            del self.order[bisect.bisect_left(self.order, length)]

    def largest(self, room: int) -> int | None:
        i = bisect.bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def smallest(self, k: int) -> list[int]:
        """The k smallest pieces (equal ones counted singly); fewer if there are not so many."""
        out: list[int] = []
        for length in self.order:
            out += [length] * min(self.counts[length], k - len(out))
            if len(out) == k:
                break
        return out

    def best_two(self, room: int) -> int:
        """The largest sum of two pieces that is at most ``room`` (0: none)."""
        best, i, j = 0, 0, len(self.order) - 1
        while i <= j:
            total = self.order[i] + self.order[j]
            if total > room:
                j -= 1
            else:
                if i < j or self.counts[self.order[i]] > 1:
                    best = max(best, total)
                i += 1
        return best


def reduced(lengths: Lengths, capacity: int) -> list[Bins]:
    """Martello-Toth reduction: fix sets that dominate every other set with their largest piece. Takes them out of ``lengths``.

    With the largest piece a and the room it leaves: nothing fits: {a}. The largest piece b that fits fills the room, or no
    two pieces fit, or no three fit and the best two sum to at most b: {a, b} dominates, since whatever else stood with a
    would fit in the place of b. Otherwise a is left for best fit.
    """
    fixed: list[Bins] = []
    for a in reversed(list(lengths.order)):
        while lengths.counts.get(a):
            lengths.take(a, 1)  # look at the others
            others = lengths.counts.get(a, 0)
            b = lengths.largest(capacity - a)
            alone = b is None
            if not alone and b != capacity - a:
                few = lengths.smallest(3)
                one = len(few) < 2 or few[0] + few[1] > capacity - a
                two = len(few) < 3 or sum(few) > capacity - a
                if not one and not (two and lengths.best_two(capacity - a) <= b):
                    lengths.counts[a] = others + 1
                    if not others:
                        bisect.insort(lengths.order, a)
                    break
            if alone:
                fixed.append(Bins(1 + others, [(a, 1)]))
                if others:
                    lengths.take(a, others)
            elif a == b:
                more = (others - 1) // 2
                fixed.append(Bins(1 + more, [(a, 2)]))
                lengths.take(a, 1 + 2 * more)
            else:
                m = min(1 + others, lengths.counts[b])
                fixed.append(Bins(m, [(a, 1), (b, 1)]))
                lengths.take(b, m)
                if m > 1:
                    lengths.take(a, m - 1)
    return fixed


def best_fit(lengths: Lengths, capacity: int) -> list[Bins]:
    """Longest first, each into the fullest sequence that has room; equal pieces and equal sequences move together."""
    free: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    for a in reversed(lengths.order):
        n, room = lengths.counts[a], a
        while n:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:
                each = capacity // a
                if n >= each:
                    free[capacity - each * a].append(Bins(n // each, [(a, each)]))
                if n % each:
                    free[capacity - n % each * a].append(Bins(1, [(a, n % each)]))
                break
            bins = free[room].pop()
            m = min(n, bins.count)
            if m < bins.count:
                free[room].append(Bins(bins.count - m, bins.content))
            free[room - a].append(Bins(m, bins.content + [(a, 1)]))
            n -= m
            room = a
    return [b for same in free for b in same]


def solve(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: for the ranks from ``rank`` on, ``copies`` at a time to one sequence.

    Arrays sorted by (length, rank): key = length << 40 | rank, sequence (of the first), offset, copies. Their size depends on
    the number of distinct lengths (at most ``capacity``), not on the number of pieces.
    """
    lengths = Lengths(counts)
    bins = reduced(lengths, capacity)
    bins += best_fit(lengths, capacity)
    used, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for b in bins:
        offset = 0
        for length, copies in b.content:
            rows.append((length << 40 | used[length], sequence, offset, copies))
            used[length] += copies * b.count
            offset += copies * length
        sequence += b.count
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2], "copies": table[:, 3]}


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """The rows of pieces(), with sequence_id and offset instead of part and place.

    The driver sees the histogram of lengths (at most ``capacity`` rows) and sends back the plan; ranks of equal lengths come
    from counts per partition. No piece travels for the plan, and equal lengths, however many, share no task.
    """
    by_value()
    cut = checkpointed(cut)
    each = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = cut.sparkSession.sparkContext.broadcast(solve(counts, capacity))
    before = each.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(p["key"], length << 40 | rank, side="right") - 1
            beyond, copies = rank - (p["key"][at] & (1 << 40) - 1), p["copies"][at]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(p["sequence"][at] + beyond // copies),
                 pa.array(p["offset"][at] + beyond % copies * length)], [*kept, "sequence_id", "offset"])

    out = ranked.drop("rank").schema.simpleString()[7:-1].replace(":", " ")
    return ranked.mapInArrow(task, f"{out}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every text packed into sequences of ``capacity`` tokens.

    Rows that repeat are packed as often as they come; null ids are kept; an empty table gives an empty result.
    """
    cut = pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "sequence_id", "offset"]
    return pack(cut, capacity).select(*names)
