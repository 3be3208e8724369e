"""Benchmark decontamination by winnowed word fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, by_value, byte_texts, checkpointed, mix, only, runs, without_texts

#: Words of a shared span that is always found, and words of a fingerprint. A window of SPAN - GRAM + 1 grams keeps its least hash.
SPAN, GRAM = 10, 5
#: log2 of the bits of the filter of benchmark fingerprints; its size does not depend on the data.
FILTER_BITS = 24
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One number per run of k words (as many numbers as words; the last k - 1 are of no use)."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(h), dtype=np.uint64)
        for j in range(min(k, len(h))):
            out[:len(h) - j] = out[:len(h) - j] * _STEP + h[j:]
    return mix(out ^ np.uint64(k))


def winnowed(grams: np.ndarray, first: np.ndarray, gram: int, span: int) -> np.ndarray:
    """Places of the grams that are the least (the rightmost of equals) of some window of ``span - gram + 1`` grams.

    ``first`` has the first word of each text and the end. Texts of fewer than ``span`` words have no window.
    """
    n, w = len(grams), span - gram + 1
    windows = n - span + 1
    if windows <= 0:
        return np.zeros(0, dtype=np.int64)
    best, place = grams[:windows].copy(), np.arange(windows)
    for j in range(1, w):
        new = grams[j:j + windows]
        less = new <= best
        best[less] = new[less]
        place[less] = np.flatnonzero(less) + j
    sizes = np.diff(first)
    starts = np.repeat(first[:-1], np.maximum(sizes - span + 1, 0))
    offset = np.arange(len(starts)) - np.repeat(np.cumsum(np.maximum(sizes - span + 1, 0)) - np.maximum(sizes - span + 1, 0),
                                               np.maximum(sizes - span + 1, 0))
    return np.unique(place[starts + offset])


def item_rows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(fp, item_id string, before, gram, after): the fingerprints of all items, with up to ``span - gram`` words around.

    An item of 1 to span - 1 words has one row: all its words are the gram.
    """
    by_value()
    side = span - gram

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, out = batch.column(0).to_pylist(), byte_texts(batch.column(1)), []
            for a, b in runs(batch.column(1)):
                words = Words(texts[a:b], ALNUM, lower=True)
                h = words.hashes(1)
                for i, doc in _places(words, _gram_hashes(h, gram), gram, span):
                    lo, hi = words.first[doc], words.first[doc + 1]
                    out.append((_fp(h, i, gram), ids[a + doc], words.text(max(lo, i - side), i), words.text(i, i + gram),
                                words.text(i + gram, min(hi, i + gram + side))))
                for doc in np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < span)):
                    lo, hi = words.first[doc], words.first[doc + 1]
                    out.append((_fp(h, lo, hi - lo), ids[a + doc], b"", words.text(lo, hi), b""))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()),
                 *[pa.array([x[k].decode() for x in out], pa.string()) for k in (2, 3, 4)]],
                ["fp", "item_id", "before", "gram", "after"])

    rows = only(items, item_id=id_col, text=text_col).withColumn("item_id", F.col("item_id").cast("string"))
    return rows.mapInArrow(task, "fp long, item_id string, before string, gram string, after string")


def _places(words: Words, grams: np.ndarray, gram: int, span: int) -> Iterator[tuple[int, int]]:
    places = winnowed(grams, words.first, gram, span)
    return zip(places.tolist(), words.doc[places].tolist(), strict=True)


def _fp(h: np.ndarray, start: int, k: int) -> int:
    return int(_gram_hashes(h[start:start + k], k)[0].view(np.int64))


def _slots(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return fp & mask, fp >> np.uint64(FILTER_BITS) & mask


def fingerprint_filter(items: DataFrame) -> tuple[bytes, list[int]]:
    """A Bloom filter of 2**FILTER_BITS bits over the item fingerprints, and the lengths of the items shorter than a span.

    Tasks set the bits of their rows; words of 64 bits that have any are merged by aggregation. Both have a fixed bound.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS - 6, dtype=np.uint64)
        for batch in batches:
            for slot in _slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                np.bitwise_or.at(bits, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used].view(np.int64))], ["word", "bits"])

    merged = items.select("fp").mapInArrow(task, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(1 << FILTER_BITS - 6, dtype=np.uint64)
    bits[merged["word"].to_numpy(dtype=np.int64)] = merged["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return bits.tobytes()


def short_lengths(items: DataFrame, gram: int, span: int) -> list[int]:
    """Word counts of the items that are one short window."""
    n = F.size(F.split("gram", " "))
    lone = items.where((F.col("before") == "") & (F.col("after") == ""))
    return sorted(r[0] for r in lone.select(n).distinct().collect() if r[0] < span)


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(row, doc_id, n_words, spans array<struct<start, end, item_id>>): for every input row, the word ranges that it shares with
    items (whole windows), each with its item. ``items`` is the result of item_rows().

    A text sends on only fingerprints that pass the filter, each with the words around it; the join with the item
    fingerprints then compares and extends the words themselves, so hashes cannot cause a hit.
    """
    by_value()
    spark, side = docs.sparkSession, span - gram
    lengths = short_lengths(items, gram, span)
    shared = spark.sparkContext.broadcast(fingerprint_filter(items))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits, seen, part = np.frombuffer(shared.value, dtype=np.uint64), 0, TaskContext.get().partitionId() << 40

        def known(fp: np.ndarray) -> np.ndarray:
            ok = np.ones(len(fp), dtype=bool)
            for slot in _slots(fp):
                ok &= (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            return ok

        for batch in batches:
            ids, texts = batch.column(0), byte_texts(batch.column(1))
            for a, b in runs(batch.column(1)):
                words = Words(texts[a:b], ALNUM, lower=True)
                h, found = words.hashes(1), [[] for _ in range(b - a)]
                grams = _gram_hashes(h, gram)
                places = winnowed(grams, words.first, gram, span)
                for i in places[known(grams[places])].tolist():
                    doc = words.doc[i]
                    lo, hi = words.first[doc], words.first[doc + 1]
                    found[doc].append({"fp": int(grams[i].view(np.int64)), "start": i - int(lo), "before": words.text(max(lo, i - side), i).decode(),
                                       "gram": words.text(i, i + gram).decode(), "after": words.text(i + gram, min(hi, i + gram + side)).decode()})
                for k in lengths:
                    fps = _gram_hashes(h, k)
                    at = np.flatnonzero(known(fps))
                    at = at[at + k <= words.first[words.doc[at] + 1]]
                    for i in at.tolist():
                        found[words.doc[i]].append({"fp": int(fps[i].view(np.int64)), "start": i - int(words.first[words.doc[i]]), "before": "",
                                                    "gram": words.text(i, i + k).decode(), "after": ""})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part + seen + np.arange(b - a)), ids[a:b], pa.array(np.diff(words.first)),
                     pa.array(found, FOUND)], ["row", "doc_id", "n_words", "found"])
                seen += b - a

    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = checkpointed(rows.mapInArrow(task, f"row long, doc_id {kind}, n_words long, found array<struct<fp long, start long, "
                                               "before string, gram string, after string>>"))
    each = found.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    matched = _extended(each, items, span, gram).groupBy("row").agg(F.collect_set(F.struct("start", "end", "item_id")).alias("spans"))
    return found.join(matched, "row", "left").select("row", "doc_id", "n_words", F.coalesce("spans", F.array().cast(
        "array<struct<start:bigint,end:bigint,item_id:string>>")).alias("spans"))


FOUND = pa.list_(pa.struct([("fp", pa.int64()), ("start", pa.int64()), ("before", pa.string()), ("gram", pa.string()), ("after", pa.string())]))


def _words(text: str) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def _same(a, b):
    """How many leading elements of two arrays are equal."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x != y), True)
    return F.when(differ > 0, differ - 1).otherwise(n)


def _extended(found: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    other = items.select("fp", "item_id", *[F.col(c).alias("i_" + c) for c in ("before", "gram", "after")])
    both = found.join(other, "fp").where("gram = i_gram")
    left = _same(F.reverse(_words("before")), F.reverse(_words("i_before")))
    right = _same(_words("after"), _words("i_after"))
    short = F.size(_words("i_gram")) + F.size(_words("i_before")) + F.size(_words("i_after"))
    size = F.size(_words("gram"))
    ranged = both.select("row", "item_id", "start", left.alias("l"), right.alias("r"), size.alias("k"), short.alias("whole"))
    return ranged.where((F.col("l") + F.col("r") + F.col("k") >= span) | ((F.col("whole") == F.col("k")) & (F.col("k") < span))).select(
        "row", "item_id", (F.col("start") - F.col("l")).alias("start"), (F.col("start") + F.col("k") + F.col("r")).alias("end"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids array<string>, spans): one row per input row.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A window is ``span`` consecutive words
    of an item, or all words of a shorter item; ``n_hit`` counts the words inside occurrences of windows. Null and empty
    texts have no words; items without words have no window; an item without an id counts as the id ''. Empty tables
    give no rows or no hits. Rows that repeat are judged alike.
    """
    known = checkpointed(item_rows(items.withColumn(item_id_col, F.coalesce(F.col(f"`{item_id_col}`").cast("string"), F.lit(""))),
                                   item_id_col, item_text_col, span, gram).distinct())
    rows = hits(docs, known, id_col, text_col, span, gram)
    ordered = F.array_sort(F.array_distinct(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    covered = F.aggregate(ordered, start, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["to"]))).alias("n"),
        F.greatest(acc["to"], s["b"]).alias("to")), lambda acc: acc["n"])
    ids = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    return rows.select("doc_id", "n_words", covered.alias("n_hit"), ids.alias("item_ids"), "spans")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows without those whose text holds a window of an item, also where rows share an id. Rows without an id stay."""
    def judged(rows: DataFrame, key: str) -> DataFrame:
        return contamination(rows, items, key, text_col, **options).where("n_hit > 0")

    return without_texts(docs, text_col, judged, F.col(f"`{id_col}`").isNotNull())
