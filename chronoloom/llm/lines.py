"""Line dedup by distinct-site spread, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, unused

#: log2 of the sketch size: a relative error of 1.04 / 2**6.
LOG_K = 12
#: Estimates within this share (three standard errors) and one site of the threshold are counted exactly.
BAND = 0.05


def _keys(line: Column) -> list[Column]:
    """Two independent 64-bit hashes stand for a line."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b")]


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """One row per line of at least ``min_chars`` characters: its hashes, site, document key and place."""
    text = F.col(f"`{text_col}`")
    each = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), F.col(f"`{site_col}`").alias("site"),
                       F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    return each.where(F.length("line") >= min_chars).select(*_keys(F.col("line")), "site", "id", "hash", "place")


def line_spread(docs: DataFrame, min_sites: int = 5, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text",
                site_col: str = "source") -> DataFrame:
    """(a, b, first): lines found on at least ``min_sites`` sites, by their hashes, and where each comes first.

    A sketch of the sites of each line hash is built where the lines are and merged by aggregation. Lines whose estimate is
    near the threshold, and only those, get an exact count of distinct sites (distinct pairs first, so that a line on
    very many pages is no hot key).
    """
    rows = _lines(docs, id_col, text_col, site_col, min_chars)
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "hash", "place")
    sketched = rows.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sites"), F.min(first).alias("first"))
    estimated = sketched.select("a", "b", "first", F.hll_sketch_estimate("sites").alias("estimate"))
    margin = BAND * min_sites + 1
    sure = estimated.where(F.col("estimate") > min_sites + margin).select("a", "b", "first")
    near = estimated.where(F.abs(F.col("estimate") - min_sites) <= margin).select("a", "b", "first")
    pairs = rows.select("a", "b", "site").distinct().join(near, ["a", "b"])
    exact = pairs.groupBy("a", "b").agg(F.count("site").alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_sites)
    return sure.unionByName(exact.drop("n"))


def dedup_lines(docs: DataFrame, min_sites: int = 5, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text",
                site_col: str = "source", counts: tuple[str, str] | None = None) -> DataFrame:
    """The input rows, with lines that spread over ``min_sites`` sites left only where they come first (smallest id, then place).

    Lines are what line feeds separate, compared as they are; shorter ones than ``min_chars`` characters stay. A null text
    stays null and has no lines, an empty one has one empty line; a text may become empty, its row stays. A null site
    counts as no site. A null id comes after all others. Rows that repeat an id and a text are treated alike. Other
    columns pass through. ``counts`` names two added columns, the number of lines and of removed lines.
    """
    spread = checkpointed(line_spread(docs, min_sites, min_chars, id_col, text_col, site_col))
    rows = _lines(docs, id_col, text_col, site_col, min_chars)
    own = F.struct(F.col("id").isNull().alias("unnamed"), "id", "hash", "place")
    gone = rows.join(spread, ["a", "b"]).where(~own.eqNullSafe(F.col("first"))).groupBy("id", "hash").agg(
        F.collect_set("place").alias("places")).toDF(*(names := [unused(docs, n) for n in ("gone_id", "gone_hash", "gone_places")]))
    text = F.col(f"`{text_col}`")
    gone_id, gone_hash, gone_places = map(F.col, names)
    joined = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(gone_id) & (F.xxhash64(text) == gone_hash), "left")
    lines = F.split(text, "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_places)
    cut = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    new = F.when(gone_places.isNull(), text).otherwise(cut)
    out = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        out += [F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias(counts[0]),
                F.when(gone_places.isNull(), 0).otherwise(F.size(gone_places)).cast("long").alias(counts[1])]
    return joined.select(*out)
