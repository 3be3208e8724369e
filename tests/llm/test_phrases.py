"""Phrase collocations: against brute force."""

import collections
import re
import string

import pytest

import __spark_entry__ as registered
from chronoloom.llm import phrases

from .conftest import SF

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def direct(rows, min_count, most=2000):
    """The contract's rows from (text, lang) pairs."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    often = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= min_count}
    gone = set()
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            gone.update((lang, w[i:i + k]) for i in range(len(w) - k + 1) if 100 * a >= 80 * f[lang, w[i:i + k]])
    found = []
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found.append((lang, -score, -a, " ".join(w).encode(), left, right))
    out, place = [], collections.Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        place[lang] += 1
        if place[lang] <= most:
            out.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def shaped(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_query_is_the_direct_count(spark, documents):
    found = shaped(registered.queries()["op12_phrases"](spark, SF))
    assert found == direct([(d["text"], d["lang"]) for d in documents], 30) and found


@pytest.mark.parametrize("run, hot, bits", [(12_000_000, 0.001, (16, 27)), (300, 1e-9, (6, 6)), (12_000_000, 2.0, (16, 27))])
def test_small_runs_full_filters(spark, monkeypatch, documents, run, hot, bits):
    """Short runs, all or no stripes dealt by the next word, a filter that lets nearly everything through change nothing; ties keep byte order."""
    monkeypatch.setattr(phrases, "RUN_BYTES", run)
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    rows = [(d["text"][:4000], d["lang"] if d["doc_id"] % 3 else None) for d in documents[:60]]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for most in (2000, 5):
        assert shaped(phrases.collocations(df, 5, most)) == direct(rows, 5, most)


def test_odd_rows(spark, odd, none):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    found = shaped(phrases.collocations(odd, 2))
    assert found == direct(rows, 2) and found
    assert phrases.collocations(none, 2).collect() == []
    assert phrases.collocations(odd.where("doc_id IN (4, 5, 6)"), 1).collect() == []
    assert shaped(phrases.collocations(odd, 10 ** 6)) == []


def test_overlaps_and_exact_numbers(spark):
    rows = [("a a a a a a", "x"), ("a\vb c\x00 d,E f;É f É f", None), ("b c", "und")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert shaped(phrases.collocations(df, 1)) == direct(rows, 1)


def test_frequent_word_is_no_hot_key(spark):
    """The joins are on salted keys."""
    rows = [("the " + " the ".join(f"w{k % 50}" for k in range(300)), "x")] * 40
    df = spark.createDataFrame(rows, "text string, lang string")
    assert shaped(phrases.collocations(df, 30)) == direct(rows, 30)
    plan = phrases.collocations(df, 30)._jdf.queryExecution().toString()
    assert "salt" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
