"""Phrase collocations mined with stripes: each prefix keys a counter of the words that follow it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, by_value, checkpointed, mix, only

#: Texts of about this many bytes are counted together before they leave a task; a longer text is counted alone.
RUN_BYTES = 10_000_000
#: Buckets that stripes are dealt into; those of one bucket and language leave a run as one row. At least four for each task that merges.
BUCKETS = 4096
#: Prefixes with at least this share of all words, of which there are no more than 1 / HOT, have stripes that are dealt to all tasks by the next word.
HOT = 0.001
#: Bits of a filter for each phrase in it, and log2 of the least and the greatest filter.
FILTER_SHARE, FILTER_BITS = 16, (16, 27)
#: Parts of a language, so that no key is hot.
SALTS = 64
MAX_WORDS = 4

#: Bytes that end a piece, and bytes that end a word.
PIECE_END = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_END = PIECE_END + b"\x20\x09"
_SPLITS = np.isin(np.arange(256), list(PIECE_END))
_WORD = ~np.isin(np.arange(256), list(WORD_END))

STRIPE_SCHEMA = "bucket int, lang string, stripes string"
#: What words never hold separates stripes, a prefix from its counter, entries, and a word from a count above one.
LINE, FIELD, ENTRY, COUNT = "\n", "\t", " ", ":"
#: Stands for the prefix of the number of words of a language.
TOTAL = "\r"


class _Run:
    """The words of some texts as numbers: ``word`` (language and word), ``joined`` (whether the next word follows in the same piece)."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, lang_names: list[str]):
        data = np.frombuffer(b"\n".join(texts).translate(LOWER), dtype=np.uint8)
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = _WORD[data]
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        lang = langs[np.searchsorted(begins, starts, side="right") - 1]
        piece = np.searchsorted(np.flatnonzero(_SPLITS[data]), starts)
        self.joined = np.append(piece[1:] == piece[:-1], False)[:len(starts)]
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        letters = pa.py_buffer(data[inside[1:-1].astype(bool)].tobytes())
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), letters]).dictionary_encode()
        size = max(len(coded.dictionary), 1)
        keys, self.word = np.unique(lang * size + coded.indices.to_numpy(), return_inverse=True)
        self.lang, self.lang_names = keys // size, lang_names
        self.text = coded.dictionary.cast(pa.large_string()).take(pa.array(keys % size))
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        """What ``_hash`` gives for each numbered word and its language."""
        import xxhash

        seeds = [xxhash.xxh64_intdigest(name.encode(), 42) for name in self.lang_names]
        return np.fromiter((xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(self.text.to_pylist(), self.lang.tolist(), strict=True)),
                           dtype=np.uint64, count=len(self.lang))


def _hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


def _spot(first: Column, second: Column) -> Column:
    """Where a pair of words stands in a filter: one hash and the other, turned by one bit."""
    return first.bitwiseXOR(F.shiftleft(second, 1).bitwiseXOR(F.shiftrightunsigned(second, 63)))


def _spots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first ^ (second << np.uint64(1) | second >> np.uint64(63))


def _filter(spots: DataFrame, rows: int) -> np.ndarray:
    """Bits that are set where a ``spot`` of the table falls, packed in 64-bit words; merged by aggregation, at most 2**27 bits.

    A set bit may belong to another phrase, which costs a count and changes none.
    """
    least, most = FILTER_BITS
    size = min(max(math.ceil(math.log2(max(rows, 1) * FILTER_SHARE)), least), most)
    at = F.col("spot").bitwiseAND(F.lit((1 << size) - 1))
    marks = spots.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    merged = marks.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(1 << size - 6, dtype=np.uint64)
    bits[merged["w"].to_numpy(dtype=np.int64)] = merged["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return bits


def _passes(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    at = spots & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _grouped(texts: pa.Array, begin: np.ndarray, separator: str) -> pa.Array:
    """Successive texts joined, a new one from each place in ``begin``."""
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(begin, len(texts)), pa.int64()), texts)
    return pa.compute.binary_join(lists, pa.scalar(separator, pa.large_string()))


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Places where any of the columns has a new value."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _stripes(run: _Run, prefix_lang: np.ndarray, prefix_text: pa.Array, prefix_hash: np.ndarray, prefix: np.ndarray, following: np.ndarray,
             counts: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of STRIPE_SCHEMA for counts of (prefix, following): a place among the prefixes and a word. ``hot`` marks prefixes whose
    stripes are dealt by the next word."""
    if not len(prefix):
        return
    spot = np.where(hot[prefix], mix(prefix_hash[prefix] + run.hashes[following]), prefix_hash[prefix])
    bucket = (spot % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((prefix, bucket, prefix_lang[prefix]))
    prefix, following, counts, bucket = prefix[order], following[order], counts[order], bucket[order]
    entries = run.text.take(pa.array(following))
    many = np.flatnonzero(counts > 1)
    if len(many):
        numbered = _joined(entries.take(pa.array(many)), pa.array(counts[many]).cast(pa.large_string()), COUNT)
        entries = pa.compute.replace_with_mask(entries, pa.array(counts > 1), numbered)
    begin = _edges(prefix, bucket)
    lines = _joined(prefix_text.take(pa.array(prefix[begin])), _grouped(entries, begin, ENTRY), FIELD)
    lang = prefix_lang[prefix[begin]]
    row = _edges(lang, bucket[begin])
    yield pa.RecordBatch.from_arrays([pa.array(bucket[begin][row], pa.int32()), pa.array(run.lang_names, pa.string()).take(pa.array(lang[row])),
                                      _grouped(lines, row, LINE).cast(pa.string())], ["bucket", "lang", "stripes"])


def _word_stripes(run: _Run, buckets: int) -> Iterator[pa.RecordBatch]:
    """The empty prefix of each language: its words, and under the prefix TOTAL how many there are."""
    langs = len(run.lang_names)
    counts = np.bincount(run.word, minlength=len(run.lang))
    empty, zero = pa.array([""] * langs, pa.large_string()), np.zeros(langs, dtype=np.uint64)
    yield from _stripes(run, np.arange(langs), empty, zero, run.lang, np.arange(len(run.lang)), counts, np.ones(langs, dtype=bool), buckets)
    total = np.bincount(run.lang, weights=counts, minlength=langs).astype(np.int64).tolist()
    yield pa.RecordBatch.from_arrays([pa.array([0] * langs, pa.int32()), pa.array(run.lang_names, pa.string()),
                                      pa.array([f"{TOTAL}{FIELD}{COUNT}{n}" for n in total])], ["bucket", "lang", "stripes"])


def _pairs(run: _Run, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs in one piece whose words are ``ok``, the distinct pairs and which pair each place has."""
    at = np.flatnonzero(run.joined[:-1] & ok[run.word[:-1]] & ok[run.word[1:]]) if len(run.word) else np.zeros(0, dtype=np.int64)
    keys, which = np.unique(run.word[at] * len(run.lang) + run.word[at + 1], return_inverse=True)
    return at, keys, which


def _pair_stripes(run: _Run, words: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Stripes of one-word prefixes, of words that pass the filter alone."""
    n = max(len(run.lang), 1)
    _, keys, which = _pairs(run, _passes(words, run.hashes))
    yield from _stripes(run, run.lang, run.text, run.hashes, keys // n, keys % n, np.bincount(which, minlength=len(keys)),
                        np.isin(run.hashes, hot), buckets)


def _joined(left: pa.Array, right: pa.Array, separator: str = " ") -> pa.Array:
    return pa.compute.binary_join_element_wise(left, right, pa.scalar(separator, pa.large_string()))


def _long_stripes(run: _Run, words: np.ndarray, pairs: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Stripes of prefixes of two and three words, where every pair of neighbours passes the filter."""
    n, h = max(len(run.lang), 1), run.hashes
    at, keys, which = _pairs(run, _passes(words, h))
    spots = _spots(h[keys // n], h[keys % n])
    good, many = _passes(pairs, spots), np.isin(spots, hot)
    pair = np.full(len(run.word), -1)
    pair[at] = np.where(good[which], which, -1)
    lang, text = run.lang[keys // n], _joined(run.text.take(pa.array(keys // n)), run.text.take(pa.array(keys % n)))
    gram = pair
    for size in (2, 3):
        # the next word makes a pair with the last one of the gram
        at = np.flatnonzero((gram[:1 - size] >= 0) & (pair[size - 1:] >= 0))
        grams, which = np.unique(gram[at] * n + run.word[at + size], return_inverse=True)
        yield from _stripes(run, lang, text, spots, grams // n, grams % n, np.bincount(which, minlength=len(grams)), many, buckets)
        gram = np.full(len(run.word), -1)
        gram[at] = which
        text = _joined(text.take(pa.array(grams // n)), run.text.take(pa.array(grams % n)))
        lang, many, spots = lang[grams // n], many[grams // n], mix(spots[grams // n] + h[grams % n])


def _counted(docs: DataFrame, tasks: int, stripes) -> DataFrame:
    """(lang, prefix, next, n): the stripes of all texts, merged entry by entry. They travel packed and are taken apart where they meet."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        langs: list[str] = []
        held = 0

        def count() -> Iterator[pa.RecordBatch]:
            names = sorted(set(langs))
            place = {name: k for k, name in enumerate(names)}
            yield from stripes(_Run(texts, np.array([place[x] for x in langs], dtype=np.int64), names), max(BUCKETS, 4 * tasks))

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held + len(text) > RUN_BYTES and texts:
                    yield from count()
                    texts, langs, held = [], [], 0
                texts.append(text.encode())
                langs.append(lang)
                held += len(text)
        if texts:
            yield from count()

    by_value()
    found = docs.mapInArrow(task, STRIPE_SCHEMA).repartition(tasks, "bucket")
    lines = found.select("bucket", "lang", F.explode(F.split("stripes", LINE)).alias("line"))
    entries = lines.select("bucket", "lang", F.substring_index("line", FIELD, 1).alias("prefix"),
                           F.explode(F.split(F.substring_index("line", FIELD, -1), ENTRY)).alias("entry"))
    n = F.when(F.instr("entry", COUNT) > 0, F.substring_index("entry", COUNT, -1).cast("long")).otherwise(1)
    each = entries.select("bucket", "lang", "prefix", F.substring_index("entry", COUNT, 1).alias("next"), n.alias("n"))
    return each.groupBy("bucket", "lang", "prefix", "next").agg(F.sum("n").alias("n")).drop("bucket")


def frequent_phrases(docs: DataFrame, min_count: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, prefix, next, n): words (empty prefix) and phrases of 2 to 4 words that occur at least ``min_count`` times in their
    language; and (lang, n_words).

    Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends, and into words at spaces and tabs; phrases lie
    within a piece. Null texts are empty, a null language is ``und``.

    Three passes over the texts, words, pairs, longer phrases. A phrase can only be frequent if its words and pairs are, so the
    later passes count what a filter of the frequent ones lets through. Filters have a greatest size; a full one
    lets more through, whose counts are then found too small.
    """
    rows = only(docs, text=text_col, lang=lang_col).select(F.coalesce("text", F.lit("")).alias("text"),
                                                           F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    enough = F.col("n") >= min_count
    first = checkpointed(_counted(rows, tasks, _word_stripes).where(enough | (F.col("prefix") == TOTAL)))
    words, totals = first.where(F.col("prefix") == ""), first.where(F.col("prefix") == TOTAL).select("lang", F.col("n").alias("n_words"))
    hot_from = (totals.agg(F.sum("n_words")).first()[0] or 0) * HOT

    def shared(table: DataFrame, spot: Column):
        """A filter of the table's phrases, and the spots of the hot ones among them, sent to all tasks."""
        spots = table.select(spot.alias("spot"), "n")
        hot = [r[0] for r in spots.where(F.col("n") >= hot_from).select("spot").collect()]
        return spark.sparkContext.broadcast((_filter(spots, table.count()), np.array(hot, dtype=np.int64).view(np.uint64)))

    of_words = shared(words, _hash(F.col("lang"), F.col("next")))
    pairs = checkpointed(_counted(rows, tasks, lambda run, k: _pair_stripes(run, *of_words.value, k)).where(enough))
    of_pairs = shared(pairs, _spot(_hash(F.col("lang"), F.col("prefix")), _hash(F.col("lang"), F.col("next"))))
    longer = checkpointed(_counted(rows, tasks, lambda run, k: _long_stripes(run, of_words.value[0], *of_pairs.value, k)).where(enough))
    return words.unionByName(pairs).unionByName(longer), totals


def _salted(df: DataFrame, n: int) -> DataFrame:
    """Every row once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def collocations(docs: DataFrame, min_count: int = 30, most: int = 2000, subsumed: tuple[int, int] = (80, 100), scale: int = 2_000_000,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of 2 to 4 words of each language.

    ``a`` is the count of the phrase; of its cuts into a first part (count ``l``) and a rest (``r``) the one with the smallest
    floor(scale * a / (l + r)) counts, ties to the shorter first part. A phrase goes when a longer one that holds it has at least
    80 / 100 of its count. Score, then count, both descending, then the phrase in byte order give the rank. Numbers are exact.
    No phrase often enough, or an empty table: no rows.

    It suffices to look at phrases one word longer: what holds the phrase in a still longer one is at least as frequent as
    that. All three come from the stripes: extensions are entries, counts of prefixes are entries of shorter stripes, the greatest
    extension of a prefix or suffix is the greatest entry that has it.
    """
    counts, totals = frequent_phrases(docs, min_count, text_col, lang_col)
    named = counts.select("lang", F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase"),
                          "n").withColumn("words", F.split("phrase", " "))
    phrases = named.where(F.size("words") > 1).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS // 4)))
    share, of = subsumed
    long_ = named.where(F.size("words") > 2)
    inner = [F.array_join(F.slice("words", start, F.size("words") - 1), " ") for start in (1, 2)]
    held = long_.select("lang", F.explode(F.array(*inner)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("more"))
    open_ = phrases.join(held, ["lang", "phrase"], "left").where(F.col("more").isNull() | (F.col("more") * of < F.col("n") * share)).drop("more")
    cuts = open_.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "salt", "k", F.col("n").alias("a"), F.array_join(F.expr("slice(words, 1, k)"), " ").alias("first"),
                       F.array_join(F.expr("slice(words, k + 1, size(words) - k)"), " ").alias("rest"))
    sides = _salted(named.select("lang", "phrase", "n"), SALTS // 4)
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(sides.select("lang", "salt", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", "salt", part])
    whole = F.col("a").cast("decimal(28,0)") * F.lit(scale).cast("decimal(10,0)")
    both = F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")
    scored = cuts.withColumns({"whole": whole, "both": both}).withColumn("score", F.expr("whole div both"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.first("a").alias("a"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    some = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    n_words = totals.select("lang", F.col("n_words").alias("n"))
    return ranked.join(n_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
