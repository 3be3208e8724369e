"""Token counts, packing, decontamination, secrets, language ID: against brute force, the libraries or held-out labels."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as registered
from chronoloom.llm import decontaminate, langid, packing, secrets, tokens
from chronoloom.llm.common import public_tokenizer

from .conftest import PASSAGE, SF, odd_rows

BYTE, WORD = public_tokenizer("byte_bpe_50k.json"), public_tokenizer("word_bpe_49k.json")
ODD = ["a<|endoftext|>b", "  x  \n\n y\t\x0b\x1c\x85z", "don't''s !'s ２３½  x y " + "z" * 500, "é ́x İSΣ ΑΣ ΑΣ\nx", "ﬁ ǅ 漢字 12345 's", "",
       "\x00a\x1fb \xa0c", "\U0001f600\U0001f600", "<|startoftext|><|endoftext|>"]


def key(rows):
    return sorted(rows, key=repr)


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_token_counts(odd, none, spark):
    got = key(tuple(r) for r in tokens.token_counts(odd, BYTE, limit=20).collect())
    want = [(i, len((t or "").encode()), len(library_ids(BYTE, t)), len(library_ids(BYTE, t)) > 20) for i, t, *_ in odd_rows()]
    assert got == key(want)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert [r["n_tokens"] for r in tokens.token_counts(df, BYTE).orderBy("doc_id").collect()] == [len(library_ids(BYTE, t)) for t in ODD]
    assert tokens.token_counts(none, BYTE).collect() == []


def test_small_caches_change_nothing(monkeypatch):
    from chronoloom.llm.common import Kept

    monkeypatch.setattr(Kept, "ENTRIES", 3)
    monkeypatch.setattr(Kept, "CHARS", 4)
    text = " ".join(f"word{i % 11} of{i}" for i in range(60))
    with open(BYTE, encoding="utf-8") as f:
        definition = f.read()
    assert tokens.Counter(definition, {}).count(text) == len(library_ids(BYTE, text))
    with open(WORD, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == library_ids(WORD, text)


def test_op6_is_what_the_library_says(spark, documents):
    got = {r["doc_id"]: r["n_tokens"] for r in registered.queries()["op6_token_counts"](spark, SF).collect()}
    assert got == {d["doc_id"]: len(library_ids(BYTE, d["text"])) for d in documents}


def check_packing(rows, docs, capacity):
    """Pieces hold the documents' ids in order; sequences are gapless and no longer than the capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, text in docs:
        ids = np.array([*library_ids(WORD, text), 0], dtype="<u4")
        want[i] += [(k, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert {i: sorted(v) for i, v in by_doc.items()} == {i: sorted(v) for i, v in want.items()}
    for content in by_sequence.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(n for v in want.values() for _, _, n, _ in v)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_pack_documents(odd, capacity):
    rows = packing.pack_documents(odd, WORD, capacity, keep_ids=True).collect()
    used, total = check_packing(rows, [r[:2] for r in odd_rows()], capacity)
    assert used <= -(-total // capacity) + 2
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)


def test_pack_nothing_and_other_tokenizers(none):
    assert packing.pack_documents(none, WORD).collect() == []
    with pytest.raises(ValueError):
        packing.pieces(none, BYTE)


def test_encoder_is_the_library():
    with open(WORD, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    for text in ODD:
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == library_ids(WORD, text)


def least_bins(lengths, capacity):
    """The optimum, by trying all assignments."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k, room in enumerate(bins):
            if room >= lengths[i] and room not in bins[:k]:
                place(i + 1, [*bins[:k], room - lengths[i], *bins[k + 1:]])
        place(i + 1, [*bins, capacity - lengths[i]])

    place(0, [])
    return best


def bins_used(lengths, capacity):
    counts = Counter(lengths)
    plan = packing.solve(dict(counts), capacity)
    content = defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            at = np.searchsorted(plan["key"], length << 40 | rank, side="right") - 1
            beyond = rank - (plan["key"][at] & (1 << 40) - 1)
            content[plan["sequence"][at] + beyond // plan["copies"][at]].append((plan["offset"][at] + beyond % plan["copies"][at] * length, length))
    for pieces in content.values():
        assert sum(n for _, n in pieces) <= capacity
        assert [o for o, _ in sorted(pieces)] == list(np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1])
    assert sum(map(len, content.values())) == len(lengths)
    return len(content)


def test_reduction_loses_no_optimum():
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice([10, 13, 20])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        rest = packing.Lengths(dict(Counter(lengths)))
        fixed = packing.reduced(rest, capacity)
        left = [n for n, c in rest.counts.items() for _ in range(c)]
        assert sum(b.count for b in fixed) + (least_bins(sorted(left, reverse=True), capacity) if left else 0) == least_bins(lengths, capacity)
        assert bins_used(lengths, capacity) >= least_bins(lengths, capacity)


def test_plan_does_not_grow_with_the_rows():
    counts = {n: 10 + n % 7 for n in range(1, 300)}
    many = {n: c * 1_000_000 for n, c in counts.items()}
    assert len(packing.solve(many, 2048)["key"]) < 4 * len(packing.solve(counts, 2048)["key"]) + 300


def test_op4_packs_all_documents(spark, documents):
    used, total = check_packing(registered.queries()["op4_best_fit_packing"](spark, SF).collect(), [(d["doc_id"], d["text"]) for d in documents], 2048)
    assert used <= -(-total // 2048) + 1


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def direct_contamination(docs, items, span=10):
    """(doc_id, n_words, n_hit, item ids)."""
    windows = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        n = min(span, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a:a + n])].add("" if i is None else str(i))
    sizes, out = {len(k) for k in windows}, []
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[a:a + n])):
                    hit |= set(range(a, a + n))
                    found |= ids
        out.append((i, len(w), len(hit), sorted(found)))
    return out


ITEMS = [(1, PASSAGE), (2, PASSAGE), (10, "Words in ENGLISH, here"), (3, "z"), (4, None), (5, ""), (6, "?!"), (None, "id, first text of the two"),
         (7, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15 word16 x"), (8, "ça va"), (1, PASSAGE), (9, "漢字 ﬁ"),
         (11, "one two three four five"), (12, "x " * 12)]


def test_contamination(spark, odd, none):
    items = spark.createDataFrame([(i, t, "row") for i, t in ITEMS], "item_id long, text string, fp string")
    got = decontaminate.contamination(odd, items)
    want = direct_contamination([r[:2] for r in odd_rows()], ITEMS)
    assert key((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in got.collect()) == key(want)
    kept = decontaminate.clean(odd, items)
    bad = {i for i, _, n, _ in want if n and i is not None}
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r[0] or -1 for r in odd_rows() if r[0] not in bad)
    assert decontaminate.contamination(none, items).collect() == []
    empty = items.limit(0)
    assert all(r["n_hit"] == 0 and r["item_ids"] == [] for r in decontaminate.contamination(odd, empty).collect())


def test_winnowing_marks_every_window():
    rng = np.random.default_rng(1)
    for n in (0, 3, 9, 10, 11, 200):
        grams = rng.integers(0, 9, n).astype(np.uint64)
        places = set(decontaminate.winnowed(grams, np.array([0, n]), 5, 10).tolist())
        assert all(places & set(range(a, a + 6)) for a in range(n - 9))
        want = {max(p for p in range(a, a + 6) if grams[p] == grams[a:a + 6].min()) for a in range(n - 9)}
        assert places == want


def test_op9_against_brute_force(spark, documents):
    import pyarrow.parquet as pq

    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
           for r in registered.queries()["op9_decontamination"](spark, SF).collect()}
    want = direct_contamination([(d["doc_id"], d["text"]) for d in documents], items)
    assert got == {i: (n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for i, n, h, f in want}


def tlv(tag, *content):
    body = b"".join(content)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def integer(n, size=1):
    return tlv(2, n.to_bytes(size, "big"))


RNG = random.Random(9)
PKCS1 = tlv(0x30, integer(0), *[integer(RNG.getrandbits(255), 32) for _ in range(8)])
OID = tlv(6, bytes([0x2A, 0x86, 0x48, 0x86, 0xF7, 13, 1, 1, 1]))
PKCS8 = tlv(0x30, integer(0), tlv(0x30, OID, tlv(5)), tlv(4, PKCS1))
SEC1 = tlv(0x30, integer(1), tlv(4, RNG.randbytes(32)), tlv(0xA0, OID))


def string(b):
    return len(b).to_bytes(4, "big") + b


OPENSSH = secrets.CONTAINER + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(b"public") + string(b"private" * 9)


def url64(data):
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


TOKEN = f"{url64(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{url64(json.dumps({'sub': 'x'}).encode())}.{url64(RNG.randbytes(32))}"


def test_structures_are_parsed():
    for data, kind in ((PKCS1, "pkcs1"), (PKCS8, "pkcs8"), (SEC1, "sec1"), (OPENSSH, "openssh")):
        assert secrets.key_kind(data) == kind
        assert secrets.key_kind(data[:-1]) is None and secrets.key_kind(data + b"\0") is None
        for text, start in ((base64.b64encode(data).decode(), 0), ("key: " + base64.b64encode(data).decode() + " end", 5)):
            found = [s for s in secrets.spans(text) if s[2] not in secrets.BASE]
            assert found == [(start, start + len(base64.b64encode(data)), kind)], text
        armoured = f"-----BEGIN PRIVATE KEY-----\n{base64.encodebytes(data).decode()}-----END PRIVATE KEY-----"
        assert [s for s in secrets.spans("é " + armoured) if s[2] not in secrets.BASE] == [(2, 2 + len(armoured), kind)]
    for data, kind in ((PKCS1, "pkcs1"), (SEC1, "sec1")):
        assert (0, 2 * len(data), kind) in secrets.spans(data.hex())
    assert [s for s in secrets.spans(f"a {TOKEN} b") if s[2] == "jwt"] == [(2, 2 + len(TOKEN), "jwt")]
    for wrong in ("eyJhIjoxfQ.eyJhIjoxfQ.x", "M" * 80, "MIIEpAIBAAKCAQEA" + "A" * 64, "30" + "0" * 62):
        assert [s for s in secrets.spans(wrong) if s[2] not in secrets.BASE] == []


def structured(text):
    return [s for s in secrets.spans(text) if s[2] not in secrets.BASE]


def test_keys_in_strings_quotes_and_with_headers():
    for data, kind in ((PKCS1, "pkcs1"), (PKCS8, "pkcs8"), (SEC1, "sec1"), (OPENSSH, "openssh")):
        body = base64.encodebytes(data).decode()
        plain = f"-----BEGIN PRIVATE KEY-----\n{body}-----END PRIVATE KEY-----"
        headed = f"-----BEGIN PRIVATE KEY-----\nProc-Type: 4,CLEAR\nComment: MII\n\n{body}-----END PRIVATE KEY-----"
        literals = "\n".join(f'  "{line}\\n" +' for line in plain.split("\n"))
        for armoured in (json.dumps(plain)[1:-1], json.dumps(json.dumps(plain))[3:-3], headed, plain.replace("\n", "\n> "), headed.replace("\n", "\r\n>> "),
                         literals[3:-5], plain.replace("/", "\\/").replace("\n", "\\n")):
            assert structured("é '" + armoured + "'") == [(3, 3 + len(armoured), kind)], armoured
        lone = base64.b64encode(data).decode()
        assert structured("x\\n" + lone + "\\n") == [(3, 3 + len(lone), kind)]
        for hexed in (data.hex(), data.hex().upper()):
            assert structured(f"0x{hexed} ") == [(2, 2 + len(hexed), kind)]
    assert structured("-----BEGIN PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n" + "A" * 64 + "\n-----END PRIVATE KEY-----") == []


def test_token_headers_with_white_space():
    for header in ('{ "alg": "HS256"}', '{\n"alg":"HS256"}', '\n{"alg":"HS256"}', '\t{"typ":"JWT","alg":"HS256"}'):
        token = f"{url64(header.encode())}.{url64(b'{ }')}.{url64(RNG.randbytes(32))}"
        assert structured(f"a {token} b") == [(2, 2 + len(token), "jwt")]
        assert structured(f"a_long_enough_name.{token}") == [(19, 19 + len(token), "jwt")]
        assert structured(f"x\\n{token}") == [(3, 3 + len(token), "jwt")]


def direct_base(text):
    text = text or ""
    names = "|".join("".join(f"[{c}{c.upper()}]" for c in n) for n in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def base_of(spans):
    return [f"{k}:{a}:{b}" for a, b, k in spans if k in secrets.BASE]


def test_base_patterns():
    texts = [r[1] for r in odd_rows()] + [
        "ToKeN=short token = abcdefghijkl", "paſſword=abcdefghijklmn", "api_key: 'abcdefghijkl'", "toKen=aaaaaaaaaaaaaaa", "AKIA" + "A" * 13, "AKIA" + "AKIA" * 5,
        "secret=secret=abcdefghijklmnop", "0" * 15, "g" + "f" * 16 + "G" + "0123456789abcdef" * 3, "apikey\":   \"0123456789abcdef\"", "passwd==========="]
    for text in texts:
        assert base_of(secrets.spans(text or "")) == direct_base(text), text


def test_secret_spans(odd, none):
    got = key((r["doc_id"], [(s["start"], s["end"], s["kind"]) for s in r["spans"]]) for r in secrets.secret_spans(odd).collect())
    assert got == key((i, secrets.spans(t or "")) for i, t, *_ in odd_rows())
    assert secrets.secret_spans(none).collect() == []


def test_op10_against_the_plain_patterns(spark, documents):
    got = {r["doc_id"]: r for r in registered.queries()["op10_secret_scan"](spark, SF).collect()}
    assert sorted(got) == sorted(d["doc_id"] for d in documents)
    for d in documents:
        base, r = direct_base(d["text"]), got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secrets.BASE] == [sum(b.startswith(k) for b in base) for k in secrets.BASE]
        assert set(base) <= set(r["spans"].split(",")) or not base


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    p = {"embed": rng.normal(0, 0.5, (2, 9, 256)), "carry": rng.normal(0, 0.5, (2, 9, 3)), "out": rng.normal(0, 0.5, (2, 2, 3)), "bias": rng.normal(0, 1, 2)}
    data, label = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 0, 1])

    def loss(q):
        net = langid.Network(["a", "b"], q["embed"], q["carry"], q["out"], q["bias"])
        total = 0.0
        scores = np.zeros((5, 2, 4))
        for way in (0, 1):
            for t, h in net._states(way, data, np.full(4, 5), True):
                scores[t] += q["out"][way] @ h
        scores += q["bias"][:, None]
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
        for k, c in enumerate(label):
            total -= scores[:, c, k].sum() / 20
        return total

    grads = langid._gradients(p, data, label)
    for name, g in grads.items():
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in g.shape)
            if name == "embed":
                at = (at[0], at[1], int(data[rng.integers(5), rng.integers(4)]))
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-2
            down[name][at] -= 1e-2
            assert abs((loss(up) - loss(down)) / 2e-2 - g[at]) < 2e-3, (name, at)


def test_stretches_cover_every_byte():
    net = langid.train([b"abc abd abe " * 9, b"xyz xyw xyq " * 9], ["a", "x"], steps=60, batch=16, span=16)
    texts = [b"abc", b"x" * langid.STRETCH, b"abc xyz " * 100, b"", b"abd " * 500]
    got = net.document_probabilities(texts)
    for text, p in zip(texts, got, strict=True):
        if text:
            parts = [net.position_sums(np.frombuffer(text[i:i + langid.STRETCH], np.uint8)[None, :].copy(), np.array([len(text[i:i + langid.STRETCH])]))[0]
                     for i in range(0, len(text), langid.STRETCH)]
            assert np.allclose(p, np.sum(parts, axis=0) / len(text), atol=1e-4) and abs(p.sum() - 1) < 1e-3
        else:
            assert (p == 0).all()
    assert got[0].argmax() == 0 and got[1].argmax() == 1


def test_language_of_odd_texts(odd, none):
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.identify(odd, per_lang=20).collect()}
    assert len(got) >= 20
    for (i, lang), score in got.items():
        assert 0 <= score <= 1 and (lang == "und") == (score == 0)
        assert (lang == "und") == (i in (4, 5, 6, 8) or (i is None and lang == "und"))
    assert langid.identify(none).collect() == []
    unlabelled = odd.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(unlabelled).collect()} == {("und", 0.0)}
    assert langid.known_language(unlabelled).count() == odd.count()
    kept = langid.known_language(odd, per_lang=20)
    assert kept.columns == odd.columns and not {4, 5, 6, 8} & {r["doc_id"] for r in kept.collect()}
    assert langid.known_language(none).collect() == []


def test_rows_are_judged_by_their_own_text(odd, spark):
    rows = [(1, PASSAGE, "en"), (1, "a text of its own, with nothing of the kind in it", "en"), (2, "12345 67890", "en"), (2, "words that stay here", "en"),
            (None, "12345", "en"), (None, "no id, but words", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    items = spark.createDataFrame([("i", PASSAGE)], "item_id string, text string")
    assert key(r["text"] for r in decontaminate.clean(df, items).collect()) == key(t for _, t, _ in rows if t != PASSAGE)
    kept = langid.known_language(df.unionByName(odd.select(*df.columns).where("doc_id = 7")), least=0.0, per_lang=20)
    assert {t for _, t, _ in rows if any(c.isalpha() for c in t)} <= {r["text"] for r in kept.collect()}
    assert not {"12345 67890", "12345"} & {r["text"] for r in kept.collect()}


def test_language_id_holds_few_texts_at_a_time(spark, monkeypatch):
    texts = [f"text {k} " + "some plain words " * 1200 for k in range(450)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    runs = langid.runs

    def watched(column):
        if column.nbytes > 6_000_000:
            raise ValueError(f"{column.nbytes} bytes of text at once")
        return runs(column)

    monkeypatch.setattr(langid, "runs", watched)
    kept = langid.known_language(df, per_lang=20)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == list(enumerate(texts))
    assert {r["lang_pred"] for r in langid.identify(df.limit(300), per_lang=20).collect()} == {"en"}


def test_op7_on_held_out_documents(spark, documents):
    got = {r["doc_id"]: r for r in registered.queries()["op7_language_id"](spark, SF).collect()}
    assert len(got) == len(documents)
    for d in documents:
        assert got[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
    held = [d for d in documents if got[d["doc_id"]]["held_out"] and d["lang"] and len(d["text"] or "") > 40]
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) >= 0.97




def test_runs_of_marks_take_linear_time():
    """Long runs of backslashes, marks and quotes between armour marks."""
    import time

    for run in ("\\" * 2_000_000, "a" + "!" * 2_000_000 + "a", '"' * 2_000_000, " \\" * 1_000_000):
        start = time.perf_counter()
        assert structured("-----BEGIN PRIVATE KEY-----" + run + "-----END PRIVATE KEY-----") == []
        assert time.perf_counter() - start < 20


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def test_encrypted_and_dsa_keys():
    oid = bytes.fromhex("2a864886f70d01050d")
    encrypted = der(0x30, der(0x30, der(0x06, oid), der(0x30, der(0x04, b"s" * 8))), der(0x04, b"\x91" * 160))
    digest = der(0x30, der(0x30, der(0x06, bytes.fromhex("608648016503040201")), der(0x05)), der(0x04, b"h" * 32))
    number = lambda n: der(0x02, b"\x01" + b"\x5a" * (n - 1))
    dsa = der(0x30, der(0x02, b"\0"), number(128), number(20), number(128), number(128), number(20))
    for data, kind in ((encrypted, "encrypted"), (dsa, "dsa"), (digest, None)):
        assert secrets.key_kind(data) == kind
        run = base64.b64encode(data).decode()
        assert structured(f"key {run} end") == ([(4, 4 + len(run), kind)] if kind else [])


def test_workers_without_the_package(tmp_path):
    """Task functions and what they are sent are plain values: queries run where workers cannot import this package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from chronoloom.session import builder
spark = builder("bare", **{{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": {str(tmp_path / "c")!r}}}).master("local[2]").getOrCreate()
import __spark_entry__ as registered
for name in ("op5_substring_dedup", "op7_language_id", "op12_phrases", "op13_hard_negatives", "rolling_ma1"):
    print(name, registered.queries()[name](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
