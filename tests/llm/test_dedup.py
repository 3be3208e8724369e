"""SimHash near-dedup, substring dedup, line dedup: against brute force."""

import hashlib
import random

import numpy as np
import pytest

import __spark_entry__ as registered
from chronoloom.llm import components, lines, repeats, simhash

from .conftest import LINE, SF, odd_rows, rows_by_id


def direct_fingerprint(text, shingle=3):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def direct_components(pairs, nodes):
    """Smallest node that can be reached."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def direct_groups(rows, max_bits=3):
    """(doc_id, fingerprint, component) of (doc_id, text) rows."""
    fps = [direct_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= max_bits]
    comp = direct_components(near, range(len(fps)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[k]] = min(i, least.get(comp[k], i))
    return [(i, fps[k], least.get(comp[k])) for k, (i, _) in enumerate(rows)]


def key(rows):
    return sorted(rows, key=repr)


def test_fingerprint_counts_blocks(monkeypatch):
    text = " ".join(f"w{i % 37} V{i}" for i in range(500))
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text.encode()) == direct_fingerprint(text)
    assert simhash.fingerprint(b"A\x0bB") == direct_fingerprint("a b")
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \t") == 0


def test_golay_code_is_perfect():
    golay = simhash.Golay()
    x = np.random.default_rng(1).integers(0, 1 << 23, 20000).astype(np.int32)
    index = golay.decode(x)
    assert len(np.unique(golay.error)) == 2048 and index.max() < 4096
    assert (golay.decode(x ^ golay.error[np.random.default_rng(2).integers(0, 2048, len(x))] & 0) == index).all()
    word = np.array([i << 11 | simhash._remainder(i << 11) for i in index], dtype=np.int32)
    assert (np.bitwise_count(word ^ x) <= 3).all()


def test_links_find_every_pair_up_to_three_bits(spark):
    rng, base = random.Random(3), [random.Random(i).getrandbits(64) for i in range(40)]
    fps = set(base) | {0, 2 ** 64 - 1, 7}
    for x in base:
        for n in (1, 2, 3, 4, 5):
            y = x
            for bit in rng.sample(range(64), n):
                y ^= 1 << bit
            fps.add(y)
    fps = sorted(fps)
    signed = [x - 2 ** 64 if x >> 63 else x for x in fps]
    got = {frozenset(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {frozenset((signed[i], signed[j])) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert got == want
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + k) for k in range(1, 40)] + [
        (rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(500, 500)]
    got = dict(tuple(r) for r in components.connected_components(
        spark.createDataFrame([*pairs, (None, 1)], "a long, b long"), "a", "b").collect())
    want = direct_components(pairs, {n for p in pairs for n in p if p[0] != p[1]} | {500})
    want.pop(500)
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_simhash_groups(odd, none):
    got = key((r["doc_id"], r["fp"] % 2 ** 64, r["component_id"]) for r in simhash.simhash_groups(odd).collect())
    assert got == key(direct_groups([r[:2] for r in odd_rows()]))
    assert simhash.simhash_groups(none).collect() == []


def test_simhash_keeps_one_of_each_component(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert key((r["doc_id"], r["text"]) for r in kept.collect()) == key(direct_kept([r[:2] for r in odd_rows()]))
    assert simhash.keep_one(none).collect() == []


def direct_kept(rows):
    """One (doc_id, text) of each component of texts: smallest id, none last, then smallest hash of the text."""
    fps = [direct_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    best = {}
    for k, c in direct_components(near, range(len(fps))).items():
        i, text = rows[k]
        own = (i is None, i or 0, "" if text is None else hashlib.md5(text.encode()).hexdigest(), text)
        best[c] = min(best.get(c, own), own, key=lambda x: x[:3])
    return [(None if unnamed else i, text) for unnamed, i, _, text in best.values()]


@pytest.mark.parametrize("ids", [(1, 1, 2), (1, 2, 2), (None, None, 3), (2, 2, 2)])
def test_simhash_judges_rows_by_their_own_text(spark, ids):
    """A text that is unlike all others stays, also where its id has a near copy of another one."""
    copy, other = "a text of quite a few words that is here twice", "something else with no likeness to the first"
    for texts in ((copy, other, copy), (copy, copy, other)):
        rows = list(zip(ids, texts, strict=True))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert key(tuple(r) for r in simhash.keep_one(df).collect()) == key(direct_kept(rows))
        assert {t for _, t in direct_kept(rows)} == {copy, other}


def test_op8_against_brute_force(spark, documents):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in registered.queries()["op8_simhash"](spark, SF).collect()}
    assert got == {i: (fp, c) for i, fp, c in direct_groups([(d["doc_id"], d["text"]) for d in documents])}


def direct_repeats(rows, window=13):
    """(doc_id, n_words, n_removed, kept) of (doc_id, text) rows."""
    big, first = 2 ** 63 - 1, {}
    words = [(big if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for a in range(len(w) - window + 1):
            k = tuple(w[a:a + window])
            first[k] = min(i, first.get(k, big))
    out = []
    for (shown, _), (i, w) in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a:a + window])] < i:
                gone[a:a + window] = [True] * window
        out.append((shown, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize("window", [1, 2, 8, 13])
def test_remove_repeats(odd, window):
    got = key(tuple(r) for r in repeats.remove_repeats(odd, window).collect())
    assert got == key(direct_repeats([r[:2] for r in odd_rows()], window))


def test_remove_repeats_of_nothing(none):
    assert repeats.remove_repeats(none).collect() == []


def test_small_groups_and_long_prefixes_change_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_SUFFIXES", 3000)
    monkeypatch.setattr(repeats, "RUN_WORDS", 2000)
    rows = [(d["doc_id"], d["text"]) for d in documents[:120]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert key(tuple(r) for r in repeats.remove_repeats(df).collect()) == key(direct_repeats(rows))


def test_windows_of_equal_hash_but_other_words_stay(spark, documents, monkeypatch):
    plain = repeats.prefix_hashes
    monkeypatch.setattr(repeats, "prefix_hashes", lambda h, window: [x % np.uint64(1021) for x in plain(h, window)])
    monkeypatch.setattr(repeats, "RUN_WORDS", 2000)
    rows = [(d["doc_id"], d["text"]) for d in documents[:120]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert key(tuple(r) for r in repeats.remove_repeats(df).collect()) == key(direct_repeats(rows))


def test_prefix_hashes_are_of_the_words():
    h = np.random.default_rng(4).integers(0, 2 ** 63, 50).astype(np.uint64)
    h[20:33], h[35:48] = h[0:13], h[0:13]
    for w in (1, 2, 3, 5, 8, 13):
        last = repeats.prefix_hashes(h, w)[-1]
        assert len(repeats.prefix_hashes(h, w)) == len(repeats.prefix_lengths(w))
        assert last[0] == last[20] == last[35] and len({int(x) for x in last[:20 - w + 1]}) == 20 - w + 1


def test_numbers_pack_and_unpack():
    for n in (np.zeros(0, np.uint64), np.array([5, 7, 2 ** 63], np.uint64), np.array([-4, 9, -1]).view(np.uint64)):
        assert (repeats.unpacked(repeats.packed(n)) == n).all()
    for n in (np.array([], int), np.array([3, 1, 2]), np.array([1 << 24, 5])):
        assert (repeats._from_three_bytes(repeats._three_bytes(n)) == n).all()


def test_op5_against_brute_force(spark, documents):
    want = {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in direct_repeats([(d["doc_id"], d["text"]) for d in documents])}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in registered.queries()["op5_substring_dedup"](spark, SF).collect()}
    assert got == want


def direct_lines(rows, min_sites=5, min_chars=20):
    """(doc_id, text, n_lines, n_removed) of (doc_id, text, source) rows."""
    sites, first = {}, {}
    for i, t, s in rows:
        for place, line in enumerate((t or "").split("\n")):
            if t is not None and len(line) >= min_chars:
                if s is not None:
                    sites.setdefault(line, set()).add(s)
                at = (i is None, i or 0, place)
                first[line] = min(at, first.get(line, at))
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        all_lines = t.split("\n")
        kept = [x for p, x in enumerate(all_lines) if len(sites.get(x, ())) < min_sites or first[x] == (i is None, i or 0, p)]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return out


@pytest.mark.parametrize("min_sites", [2, 5, 7, 8])
def test_dedup_lines(odd, min_sites):
    got = lines.dedup_lines(odd, min_sites, counts=("n_lines", "n_removed"))
    assert got.columns == [*odd.columns, "n_lines", "n_removed"]
    assert key((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == key(
        direct_lines([(r[0], r[1], r[3]) for r in odd_rows()], min_sites))


def test_lines_far_above_the_threshold_need_no_exact_count(spark):
    rows = [(i, f"{LINE}\nown line of this document is number {i}", f"site{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert got == {i: t for i, t, _, _ in direct_lines(rows)} and got[0].startswith(LINE) and not got[1].startswith(LINE)


def test_dedup_lines_of_nothing(none):
    assert lines.dedup_lines(none).collect() == []


def test_lines_stay_in_the_jvm(odd):
    plan = lines.dedup_lines(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_by_id_helper(odd):
    assert len(rows_by_id(odd)[20]) == 2
