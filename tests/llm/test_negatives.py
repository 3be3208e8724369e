"""Hard negatives: the curve, the zone maps and the result against brute force."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from chronoloom.llm import negatives

from .conftest import SF

SCHEMA = "vec_id long, label int, v array<long>, block int, least string, `group` int"


def direct(rows, is_anchor, positives=5, negs=3, low=50, high=95):
    """Rows of (vec_id, label, vector), by comparing everything."""
    def dot(x, y):
        return sum(a * b for a, b in zip(x, y, strict=False))

    rows = sorted({(i, x, tuple(v)) for i, x, v in rows if None not in (i, x, v)})
    anchors = {}
    for i, x, v in rows:
        if is_anchor(i):
            anchors.setdefault(i, (x, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-dot(v, w), i, x) for i, x, w in rows if i != a)
        for s, p, _ in [t for t in scored if t[2] == label][:positives]:
            fit = [(-t, i) for t, i, x in scored if x != label and low * -s <= 100 * -t <= high * -s][:negs]
            out += [(a, p, r + 1, i, -s, t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        place = negatives.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("block, around", [(64, 128), (4, 2)])
def test_against_brute_force(spark, monkeypatch, block, around):
    """Clusters, ties, copies of one vector, anchors without positives or negatives, small blocks over several partitions."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "RANGE", around)
    monkeypatch.setattr(negatives, "ZONES", 16)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(4)), [int(x) for x in rng.integers(-9, 30, 6) + 20 * (i % 3)]) for i in range(300)]
    rows += [(1000 + i, i % 2, [5, 5, 5, 5, 5, 5]) for i in range(150)] + [(2000, 9, [1, 2, 3, 4, 5, 6]), (2010, 1, [0] * 6)]
    rows += [(3000, 1, [7, 7]), (3000, 2, [8, 8, 1]), (3000, 2, [8, 8, 1]), (None, 1, [1, 1]), (5, None, [1]), (6, 1, None)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    expected = direct(rows, lambda i: i % 10 == 0)
    assert found(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)) == expected and len(expected) > 300


def test_query_is_the_direct_count(spark):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [int(np.floor(256 * float(x))) for x in r["embedding"]])
            for r in table]
    assert found(registered.queries()["op13_hard_negatives"](spark, SF)) == direct(rows, lambda i: i % 50 == 0)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(negatives.hard_negatives(none, F.lit(True))) == []
    one = spark.createDataFrame([(0, 1, [1, 2], 1, "x", 2), (1, 1, [2, 2], 1, "x", 2)], SCHEMA)
    assert found(negatives.hard_negatives(one, F.lit(True))) == []
    large = [(i, i % 2, [2 ** 30 + i, 2 ** 29]) for i in range(12)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in large], SCHEMA)
    assert found(negatives.hard_negatives(df, F.col("vec_id") == 0, low=1, high=100)) == direct(large, lambda i: i == 0, low=1, high=100)


def test_zone_maps_choose_blocks(spark, tmp_path):
    """Every row inside a window lies in a chosen block, and blocks far from the window are not chosen."""
    rng = np.random.default_rng(1)
    v = (rng.normal(0, 3, (2000, 4)) + rng.integers(0, 5, (2000, 1)) * 50).astype(int)
    df = spark.createDataFrame([(i, i % 3, [int(x) for x in r]) for i, r in enumerate(v)], "vec_id long, label int, v array<long>")
    blocks = negatives.write_blocks(df, str(tmp_path / "blocks"), 2000, 4).toArrow()
    assert sorted(itertools.chain(*blocks["ids"].to_pylist())) == list(range(2000))
    scores = v @ v[0]
    low, high = int(np.quantile(scores, 0.45)), int(np.quantile(scores, 0.55))
    window = pa.table({"anchor_id": [0], "label": [0], "v": [v[0].tolist()], "tag": [[0]], "low": [[low]], "high": [[high]]})
    chosen = negatives._Windows(window, 4).needed(blocks, False, 4)
    inside = {i for i in range(2000) if i % 3 and low <= scores[i] <= high}
    read = set(itertools.chain(*[b for b, c in zip(blocks["ids"].to_pylist(), chosen, strict=True) if c]))
    assert inside <= read and chosen.mean() < 0.6
