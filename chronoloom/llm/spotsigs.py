"""SpotSigs document fingerprints in DataFrame operations alone.

A signature is a common word (the anchor) and the chain of content words that follow it; the set of a text's signatures
is its fingerprint. Likeness of two texts is the Jaccard share of their sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, unused

#: A word is common, an anchor, when it makes up at least this share of all words; so there are at most 1 / SHARE of them.
SHARE = 0.001
#: Content words in a chain.
CHAIN = 2
#: Keys drawn for each range of neighbouring documents; ranges for each partition of a shuffle.
DRAWN, RANGES = 64, 4
#: Copies of a row of the smaller side, so that no key is hot.
SALTS = 16

_LEAST_ID = -2 ** 63


def _hashes(text: Column) -> Column:
    """A 64-bit hash for each word: runs of letters, marks and digits of any script, lower case."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def anchors(docs: DataFrame, text_col: str = "text", share: float = SHARE) -> list[int]:
    """Hashes of the words that make up at least ``share`` of all words of all texts: at most 1 / share numbers, whatever the corpus.

    Words are counted where they are and merged by aggregation; one row a text brings its number of words, so that the total
    comes out of the same pass.
    """
    most = math.floor(1 / share)
    words = only(docs, text=text_col).select(_hashes(F.coalesce("text", F.lit(""))).alias("h"))
    each = words.select(F.size("h").alias("n"), F.explode(F.concat("h", F.array(F.lit(None).cast("long")))).alias("h"))
    counts = each.groupBy("h").agg(F.sum(F.when(F.col("h").isNull(), F.col("n")).otherwise(1)).alias("n"))
    top = counts.orderBy(F.col("h").isNotNull(), F.desc("n"), "h").limit(most + 1).collect()
    total = sum(r["n"] for r in top if r["h"] is None)
    return sorted(r["h"] for r in top if r["h"] is not None and r["n"] >= share * total)


def with_signatures(df: DataFrame, name: str, text: Column, anchor_words: list[int], chain: int = CHAIN) -> DataFrame:
    """Add the sorted set of a text's signatures, 32-bit numbers.

    The words after an anchor that are no anchors make its chain; one that the end of the text cuts short does not count. A text
    without any signature gets chains that follow each of its words, and one of at most ``chain`` words a single signature for all of
    them. Null texts and texts without words have none.
    """
    h, at, rest, own = (unused(df, f"{name}_{part}") for part in ("words", "anchors", "content", "spots"))

    def is_anchor(word: Column) -> Column:
        return word.isin(anchor_words) if anchor_words else F.lit(False)

    def short(*parts: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*parts), 32)

    df = df.withColumn(h, _hashes(F.coalesce(text, F.lit(""))))
    df = df.withColumns({
        at: F.filter(F.transform(h, lambda w, i: F.when(is_anchor(w), i)), lambda i: i.isNotNull()),
        rest: F.filter(h, lambda w: ~is_anchor(w))})
    # the j-th anchor, at word i, has i - j content words before it
    spots = F.transform(at, lambda i, j: F.when(i - j + chain <= F.size(rest), short(
        F.get(h, i), *[F.get(rest, i - j + k) for k in range(chain)])))
    df = df.withColumn(own, F.filter(spots, lambda s: s.isNotNull()))
    every = F.transform(F.slice(h, 1, F.greatest(F.size(h) - chain, F.lit(0))), lambda w, i: short(w, *[F.get(h, i + k) for k in range(1, chain + 1)]))
    found = (F.when(F.size(own) > 0, F.col(own)).when(F.size(h) > chain, every)
             .when(F.size(h) > 0, F.array(short(F.col(h)))).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(name, F.sort_array(F.array_distinct(found))).drop(h, at, rest, own)


def fingerprint(signatures: str | Column) -> Column:
    """The set as a string: eight hexadecimal digits a signature, ascending."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard share of two sorted sets; two empty ones are alike. Sets whose ranges lie apart are not intersected."""
    x, y = F.col(a), F.col(b)
    both = F.size(x) + F.size(y)
    shared = F.size(F.array_intersect(x, y))
    apart = (F.size(x) == 0) | (F.size(y) == 0) | (F.get(x, F.size(x) - 1) < F.get(y, F.lit(0))) | (F.get(y, F.size(y) - 1) < F.get(x, F.lit(0)))
    return F.when(both == 0, F.lit(1.0)).when(apart, F.lit(0.0)).otherwise(shared / (both - shared))


def with_next(docs: DataFrame, columns: dict[str, str], id_col: str = "doc_id", text_col: str = "text", prepare=lambda df: df) -> DataFrame:
    """The rows with ``columns`` (new name: column) of the next one by descending id; after the last comes the first.

    A null id counts as the smallest; rows of one id follow each other by a hash of their text, and rows that repeat id and text are
    interchangeable. A single row is its own next.

    Rows are dealt into ranges of (id, hash) that a drawn sample of keys balances, a function of the row alone, so that texts move
    once and a recomputed task deals alike. The first row of each range goes to the range above as well, where the last row
    looks for it. ``prepare`` runs where the rows have arrived.
    """
    of_id, of_text, part, guest, first = (unused(docs, n) for n in ("order_id", "order_text", "order_range", "order_guest", "order_first"))
    rows = docs.withColumns({of_id: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LEAST_ID)),
                             of_text: F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))})
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = docs.count()
    ranges = max(1, min(RANGES * spread, n // DRAWN))
    drawn = rows.select(of_id, of_text).where(F.rand(7) < min(1.0, DRAWN * ranges / max(n, 1))).collect() if ranges > 1 else []
    keys = sorted((r[0], r[1]) for r in drawn)
    edges = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []
    if edges:
        # edges in rows of about their square root: the row first, then the place in it
        wide = math.isqrt(len(edges)) + 1
        edge = F.arrays_zip(F.lit([i for i, _ in edges]).alias("i"), F.lit([t for _, t in edges]).alias("t"))
        heads = F.arrays_zip(F.lit([i for i, _ in edges[::wide]]).alias("i"), F.lit([t for _, t in edges[::wide]]).alias("t"))

        def not_above(some: Column) -> Column:
            return F.size(F.filter(some, lambda e: (e["i"] < F.col(of_id)) | ((e["i"] == F.col(of_id)) & (e["t"] <= F.col(of_text)))))

        lead_rows = F.greatest(not_above(heads) - 1, F.lit(0))
        rows = rows.withColumn(part, lead_rows * wide).withColumn(part, F.col(part) + not_above(F.slice(edge, F.col(part) + 1, wide)))
    else:
        rows = rows.withColumn(part, F.lit(0))
    tops = {r[0]: r[1] for r in rows.groupBy(part).agg(F.max(F.struct(of_id, of_text))).collect()}
    full = sorted(tops)
    above = dict(zip(full, full[1:] + full[:1], strict=True))
    if full:
        held = range(full[-1] + 1)
        top_id, top_text = ([tops[k][j] if k in tops else 0 for k in held] for j in (0, 1))
        goes = F.get(F.lit([above.get(k, 0) for k in held]), F.col(part))
        is_top = (F.get(F.lit(top_id), F.col(part)) == F.col(of_id)) & (F.get(F.lit(top_text), F.col(part)) == F.col(of_text))
        home = F.struct(F.col(part).alias("part"), F.lit(False).alias("guest"))
        places = F.when(is_top, F.array(home, F.struct(goes.alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(home))
    else:
        places = F.array(F.struct(F.col(part).alias("part"), F.lit(False).alias("guest")))
    rows = rows.withColumn(first, F.explode(places)).withColumns({part: F.col(f"{first}.part"), guest: F.col(f"{first}.guest")}).drop(first)
    rows = prepare(rows.repartition(spread, part))
    following = Window.partitionBy(part).orderBy(guest, F.desc(of_id), F.desc(of_text))
    rows = rows.withColumns({new: F.lead(column).over(following) for new, column in columns.items()})
    return rows.where(~F.col(guest)).drop(of_id, of_text, part, guest)


def edited_fingerprints(docs: DataFrame, share: float = SHARE, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, edited, signatures, edited_signatures, next_signatures) for each row.

    ``edited`` is the text with its last floor(n / 2) characters replaced by as many first ones (or all) of the next document by
    descending id (see ``with_next``). A null text counts as empty. Empty table: no rows.
    """
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    words = anchors(rows, "text", share)
    rows = with_next(rows, {"next_text": "text", "next_signatures": "signatures"},
                     prepare=lambda df: with_signatures(df, "signatures", F.col("text"), words, chain))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_signatures(rows.drop("next_text"), "edited_signatures", F.col("edited"), words, chain)
    return rows.select("doc_id", "text", "edited", "signatures", "edited_signatures", "next_signatures")


def classes(sets: DataFrame, id_col: str = "doc_id", set_col: str = "signatures") -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, class_id) and classes (class_id, signatures): rows with equal sets are a class, named by its smallest id.

    Rows without an id are no members; rows without signatures are members of no class (null).
    """
    rows = only(sets, doc_id=id_col, signatures=set_col).where("doc_id IS NOT NULL")
    rows = rows.withColumn("key", F.when(F.size("signatures") > 0, F.md5(fingerprint("signatures"))))
    heads = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("signatures").alias("signatures"))
    salted = rows.select("doc_id", "key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    names = heads.select("key", "class_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return salted.join(names, ["key", "salt"], "left").select("doc_id", "class_id"), heads.select("class_id", "signatures")


def similar(heads: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness), a < b: all pairs of classes whose sets have a Jaccard share of at least ``threshold`` (above 0).

    Sets are partitioned by their length: partition k holds lengths from 1 / threshold ** k on, so that partners lie in the same
    or in neighbouring ones. A set is found by its rarest signatures alone, as many as it cannot share with no partner; pairs
    whose lengths, or the signatures left after the shared one, allow no sufficient overlap go before the sets are compared.
    """
    each = heads.select("class_id", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("df")).select(
        "s", "df", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    ranked = each.withColumn("salt", F.pmod(F.xxhash64("class_id"), F.lit(SALTS))).join(counts, ["s", "salt"])
    at = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "s"))
    needed = F.ceil(F.col("n") * F.lit(threshold) - 1e-9)
    spots = ranked.withColumn("at", at).where(F.col("at") <= F.col("n") - needed + 1)
    spots = spots.withColumn("part", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9) if threshold < 1 else F.col("n").cast("long"))
    left = spots.select("s", "part", F.col("class_id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ix"))
    right = spots.select("s", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("class_id").alias("y"),
                         F.col("n").alias("ny"), F.col("at").alias("iy"))
    overlap = F.least("ix", "iy") + F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy"))
    fits = (F.struct("nx", "x") < F.struct("ny", "y")) & (F.col("nx") >= F.col("ny") * threshold - 1e-9) & (
        overlap >= (F.col("nx") + F.col("ny")) * (threshold / (1 + threshold)) - 1e-9)
    pairs = left.join(right, ["s", "part"]).where(fits).select("x", "y").distinct()
    one = heads.select(F.col("class_id").alias("x"), F.col("signatures").alias("sx"))
    two = heads.select(F.col("class_id").alias("y"), F.col("signatures").alias("sy"))
    compared = pairs.join(one, "x").join(two, "y").withColumn("likeness", likeness("sx", "sy"))
    return compared.where(F.col("likeness") >= threshold).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")
