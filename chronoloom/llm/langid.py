"""Language ID: a small bidirectional gated recurrent network over the bytes of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, byte_texts, only, runs, small_batches

UNDETERMINED = "und"
#: Bytes that the network reads in one go; longer texts are several such stretches, all of them read.
STRETCH = 128
#: Stretches that one task computes at a time.
LANES = 2048


@dataclass
class Network:
    """Two recurrent layers, one from each end. Gate rows: update, reset (H each), candidate (H).

    ``embed`` (2, 3H, 256) what each byte adds to the gates, ``carry`` (2, 3H, H) what the state adds, ``out`` (2, K, H) and
    ``bias`` (K,) the labels' scores at a position. Update and reset rows hold half weights: sigmoid(x) = (1 + tanh(x/2)) / 2.
    """

    langs: list[str]
    embed: np.ndarray
    carry: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def position_sums(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Summed label probabilities over the positions of each stretch: (n, K). ``data`` (n, T) bytes, ``sizes`` bytes in use."""
        n, steps = data.shape
        bytes_at, whole = np.ascontiguousarray(data.T), bool((sizes == steps).all())
        scores = np.empty((steps, len(self.langs), n), dtype=np.float32)
        for t, h in self._states(0, bytes_at, sizes, whole):
            np.matmul(self.out[0], h, out=scores[t])
        total = np.zeros((len(self.langs), n), dtype=np.float32)
        for t, h in self._states(1, bytes_at, sizes, whole):
            s = scores[t]
            s += self.out[1] @ h
            s += self.bias[:, None]
            np.exp(s, out=s)
            s /= s.sum(axis=0)
            if not whole:
                s *= t < sizes
            total += s
        return total.T

    def _states(self, way: int, bytes_at: np.ndarray, sizes: np.ndarray, whole: bool) -> Iterator[tuple[int, np.ndarray]]:
        embed, carry = self.embed[way], self.carry[way]
        hidden, n = carry.shape[1], bytes_at.shape[1]
        h = np.zeros((hidden, n), dtype=np.float32)
        for t in range(len(bytes_at)) if way == 0 else range(len(bytes_at) - 1, -1, -1):
            x, g = embed.take(bytes_at[t], axis=1), carry @ h
            gates = x[:2 * hidden]
            gates += g[:2 * hidden]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new = g[2 * hidden:]
            new *= gates[hidden:]
            new += x[2 * hidden:]
            np.tanh(new, out=new)
            h -= new
            h *= gates[:hidden]
            h += new
            if not whole:
                h *= t < sizes
            yield t, h

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean over all positions of each text: (n, K); zeros for an empty text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts) + bytes(STRETCH), dtype=np.uint8)
        begins, count = np.cumsum(lengths) - lengths, -(-lengths // STRETCH)
        doc = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        sizes = np.minimum(lengths[doc] - place * STRETCH, STRETCH)
        starts, sums = begins[doc] + place * STRETCH, np.zeros((len(texts), len(self.langs)))
        for some in (np.flatnonzero(sizes == STRETCH), np.flatnonzero(sizes < STRETCH)):
            for i in range(0, len(some), LANES):
                at = some[i:i + LANES]
                found = self.position_sums(data[starts[at][:, None] + np.arange(STRETCH)], sizes[at])
                np.add.at(sums, doc[at], found)
        return sums / np.maximum(lengths, 1)[:, None]


def train(texts: list[bytes], labels: list[str], hidden: int = 6, steps: int = 300, batch: int = 96, span: int = 48,
          rate: float = 0.02, seed: int = 7) -> Network:
    """Fit by backpropagation through time on random stretches, all labels alike often; cross-entropy at every position."""
    rng, langs = np.random.default_rng(seed), sorted(set(labels))
    k = len(langs)
    by_lang = [[t for t, lab in zip(texts, labels, strict=True) if lab == lang and t] for lang in langs]
    by_lang = [own or [b" "] for own in by_lang]
    p = {"embed": rng.normal(0, 0.3, (2, 3 * hidden, 256)), "carry": rng.normal(0, 0.3, (2, 3 * hidden, hidden)),
         "out": rng.normal(0, 0.3, (2, k, hidden)), "bias": np.zeros(k)}
    p = {name: v.astype(np.float32) for name, v in p.items()}
    first, second = ({name: np.zeros_like(v) for name, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        label = np.arange(batch) % k
        data = np.stack([_stretch(by_lang[c], span, rng) for c in label], axis=1)
        grads = _gradients(p, data, label)
        for name, g in grads.items():
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            p[name] -= rate * (1 - step / (steps + 1)) * (first[name] / (1 - 0.9 ** step)) / (
                np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-6)
    return Network(langs, p["embed"], p["carry"], p["out"], p["bias"])


def _stretch(texts: list[bytes], span: int, rng: np.random.Generator) -> np.ndarray:
    text = texts[rng.integers(len(texts))]
    while len(text) < span:
        text += b" " + text
    at = rng.integers(len(text) - span + 1)
    return np.frombuffer(text[at:at + span], dtype=np.uint8)


def _gradients(p: dict[str, np.ndarray], data: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    steps, n = data.shape
    hidden = p["carry"].shape[2]
    kept: list[list[tuple]] = [[], []]
    states = np.zeros((2, steps, hidden, n), dtype=np.float32)
    for way in (0, 1):
        h = np.zeros((hidden, n), dtype=np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            x, g = p["embed"][way][:, data[t]], p["carry"][way] @ h
            gates = 0.5 + 0.5 * np.tanh(x[:2 * hidden] + g[:2 * hidden])
            z, r, inner = gates[:hidden], gates[hidden:], g[2 * hidden:]
            new = np.tanh(x[2 * hidden:] + r * inner)
            kept[way].append((t, h, z, r, inner, new))
            h = new + z * (h - new)
            states[way, t] = h
    scores = np.einsum("wkh,wthn->tkn", p["out"], states) + p["bias"][:, None]
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    scores /= scores.sum(axis=1, keepdims=True)
    scores[:, label, np.arange(n)] -= 1
    scores /= steps * n
    out = {"out": np.einsum("tkn,wthn->wkh", scores, states), "bias": scores.sum(axis=(0, 2)),
           "embed": np.zeros_like(p["embed"]), "carry": np.zeros_like(p["carry"])}
    for way in (0, 1):
        later = np.zeros((hidden, n), dtype=np.float32)
        each = np.zeros((steps, 3 * hidden, n), dtype=np.float32)
        for t, h, z, r, inner, new in reversed(kept[way]):
            d = later + p["out"][way].T @ scores[t]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (h - new) * z * (1 - z) * 2
            d_r = d_new * inner * r * (1 - r) * 2
            each[t, :hidden], each[t, hidden:2 * hidden], each[t, 2 * hidden:] = d_z, d_r, d_new
            d_gates = np.concatenate([d_z, d_r, d_new * r])
            out["carry"][way] += d_gates @ h.T
            later = d * z + p["carry"][way].T @ d_gates
        flat = each.transpose(0, 2, 1).reshape(-1, 3 * hidden)
        sums = np.zeros((256, 3 * hidden), dtype=np.float32)
        np.add.at(sums, data.reshape(-1), flat)
        out["embed"][way] = sums.T
    return out


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_lang: int = 256, chars: int = 1500, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> list[tuple[str, str]]:
    """(lang, stretch of text) of at most ``per_lang`` labelled documents of each language that are not held out.

    Counts per language come from all rows (the driver gets one number a language); a hash of the id then picks about twice
    the number wanted where the rows are and a window cuts that to ``per_lang``, so that no language's rows ever travel or
    meet in one task. A stretch starts at a hashed place.
    """
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col).where(
        F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    among = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("lang")]
    share = rows.where(F.pmod(hashed, F.lit(1 << 20)) * among < F.lit(2 * per_lang) * (1 << 20))
    start = 1 + F.pmod(F.shiftright(hashed, 20), F.greatest(F.length("text") - chars, F.lit(1)))
    picked = share.select("lang", hashed.alias("h"), F.substring("text", start.cast("int"), F.lit(chars)).alias("text"))
    ranked = picked.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= per_lang)
    return sorted((r["lang"], r["text"]) for r in ranked.select("lang", "text").collect())


def fit(docs: DataFrame, per_lang: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network for the languages of the labelled rows; None without any."""
    sample = training_sample(docs, per_lang, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return train([text.encode() for _, text in sample], [lang for lang, _ in sample]) if sample else None


def _shared(docs: DataFrame, network: Network | None):
    """The network's arrays, sent to all tasks; plain values, since workers need not have this package."""
    parts = None if network is None else tuple(getattr(network, f.name) for f in fields(network))
    return docs.sparkSession.sparkContext.broadcast(parts)


def _judged(net: Network | None, letter, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """The rows of the batches, a run at a time, with language and score of each text in column ``at``."""
    for batch in batches:
        for a, b in runs(batch.column(at)):
            part = batch.slice(a, b - a)
            texts, raw = part.column(at).to_pylist(), byte_texts(part.column(at))
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            rows = [i for i, text in enumerate(texts) if net is not None and text and letter(text)]
            if rows:
                p = net.document_probabilities([raw[i] for i in rows])
                for i, best, s in zip(rows, p.argmax(axis=1), p.max(axis=1), strict=True):
                    lang[i], score[i] = net.langs[best], min(float(s), 1.0)
            yield part, lang, score


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per input row, from the whole text; ``score`` is the mean probability over all bytes.

    ``und`` and 0 for null texts, texts without a letter, and without a network. Repeated rows give repeated rows; an
    empty table gives an empty result.
    """
    by_value()
    small_batches(docs.sparkSession)
    shared = _shared(docs, network)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        net, letter = shared.value and Network(*shared.value), regex.compile(r"\p{L}").search
        for part, lang, score in _judged(net, letter, batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, per_lang: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the labelled rows that are not held out, then predict every row: (doc_id, lang_pred, score)."""
    return predict(docs, fit(docs, per_lang, id_col, text_col, lang_col), id_col, text_col)


def known_language(docs: DataFrame, least: float = 0.3, per_lang: int = 256, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang") -> DataFrame:
    """The input rows whose language is one of the learned ones with a score of at least ``least``.

    Each row is judged by its own text, also where rows share an id or have none. Without labelled rows nothing can be learned and all rows stay.
    """
    network = fit(docs, per_lang, id_col, text_col, lang_col)
    if network is None:
        return docs
    by_value()
    small_batches(docs.sparkSession)
    shared, at = _shared(docs, network), docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        net, letter = Network(*shared.value), regex.compile(r"\p{L}").search
        for part, lang, score in _judged(net, letter, batches, at):
            yield part.filter(pa.array((score >= least) & np.array([x != UNDETERMINED for x in lang], dtype=bool)))

    # rows are judged and dropped where they are: nothing is shuffled; whole rows travel, so a few megabytes at a time
    return docs.mapInArrow(task, docs.schema)
