"""SpotSigs fingerprints, the next document, similar sets: against brute force."""

import collections
import hashlib

import pytest
import regex

import __spark_entry__ as registered
from chronoloom.llm import spotsigs

from .conftest import SF


def words_of(text):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


def direct_anchors(texts, share):
    counts = collections.Counter(w for t in texts for w in words_of(t))
    return {w for w, n in counts.items() if n >= share * sum(counts.values())}


def direct_set(text, anchors, chain=2):
    words = words_of(text)
    found = set()
    for i, w in enumerate(words):
        content = [x for x in words[i + 1:] if x not in anchors][:chain]
        if w in anchors and len(content) == chain:
            found.add((w, *content))
    if not found and len(words) > chain:
        found = {tuple(words[i:i + chain + 1]) for i in range(len(words) - chain)}
    return found or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def direct_rows(rows, share):
    """(doc_id, n_chars, sha of edited, size of set, near_edited, near_next) for rows with different ids."""
    anchors = direct_anchors([t for _, t in rows], share)
    order = sorted(rows, key=lambda r: -2 ** 63 if r[0] is None else r[0], reverse=True)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own = direct_set(text, anchors)
        yield (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(own), jaccard(own, direct_set(edited, anchors)),
               jaccard(own, direct_set(following, anchors)))


def shaped(rows):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], len(r["fingerprint"]) // 8, pytest.approx(r["near_edited"]),
                    pytest.approx(r["near_next"])) for r in rows), key=lambda r: repr(r[0]))


def test_query_is_the_direct_count(spark, documents):
    rows = registered.queries()["op11_spotsigs"](spark, SF).collect()
    direct = sorted(direct_rows([(d["doc_id"], d["text"]) for d in documents], spotsigs.SHARE), key=lambda r: repr(r[0]))
    assert shaped(rows) == direct
    text = {d["doc_id"]: d["text"] for d in documents}
    prints = collections.defaultdict(set)
    for r in rows:
        prints[text[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_odd_rows(spark, odd, none):
    found = spotsigs.edited_fingerprints(odd).collect()
    assert len(found) == odd.count()
    for r in found:
        assert (r["signatures"] == []) == (not words_of(r["text"]))
        assert r["signatures"] == sorted(set(r["signatures"]))
    by_text = collections.defaultdict(set)
    for r in found:
        by_text[r["text"]].add(tuple(r["signatures"]))
    assert all(len(s) == 1 for s in by_text.values())
    assert spotsigs.edited_fingerprints(none).collect() == []
    one = odd.where("doc_id = 23")
    assert [r["next_signatures"] == r["signatures"] and r["edited"] == "z" * 100_000 for r in spotsigs.edited_fingerprints(one).collect()] == [True]


@pytest.mark.parametrize("drawn", [1, 64])
def test_next_row(spark, monkeypatch, drawn):
    """Many ranges, repeated rows, a hot id, a missing id."""
    monkeypatch.setattr(spotsigs, "DRAWN", drawn)
    rows = [(i * 7 % 501, f"t{i}") for i in range(400)] + [(77, f"hot{i % 50}") for i in range(300)] + [(None, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = spotsigs.with_next(df, {"next_id": "doc_id", "next_text": "text"}).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in found))) == sorted(map(repr, rows))
    least = -2 ** 63
    ids = sorted({least if r[0] is None else r[0] for r in rows}, reverse=True)
    below = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    steps = collections.Counter()
    for r in found:
        a, b = (least if x is None else x for x in (r["doc_id"], r["next_id"]))
        assert b in (a, below[a])
        steps[a] += b != a
    assert all(steps[i] == 1 for i in ids)  # every id is left once
    arrived = collections.Counter((r["next_id"], r["next_text"]) for r in found)
    assert set(arrived) == set(rows)


def test_similar_sets(spark, documents):
    texts = [(d["doc_id"], d["text"]) for d in documents] + [(5000 + d["doc_id"], d["text"] + " one more end") for d in documents[::3]]
    texts += [(9000, documents[0]["text"]), (9001, ""), (None, "no id")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    words = spotsigs.anchors(df)
    sets = spotsigs.with_signatures(df, "signatures", df["text"], words)
    members, heads = spotsigs.classes(sets)
    own = {r["doc_id"]: frozenset(r["signatures"]) for r in sets.collect() if r["doc_id"] is not None}
    least = {}
    for i in sorted(own):
        least.setdefault(own[i], i)
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {i: least[s] if s else None for i, s in own.items()}
    kinds = [(i, s) for s, i in least.items() if s]
    for threshold in (0.8, 0.3):
        direct = {(min(a, b), max(a, b)) for k, (a, x) in enumerate(kinds) for b, y in kinds[:k] if jaccard(x, y) >= threshold}
        found = spotsigs.similar(heads, threshold).collect()
        assert sorted((r["a"], r["b"]) for r in found) == sorted(direct) and direct
        assert all(r["likeness"] == pytest.approx(jaccard(own[r["a"]], own[r["b"]])) for r in found)
    assert spotsigs.similar(heads.limit(0)).collect() == []
