"""Token counts by a two-tier lookup of pre-token lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import Kept, by_value, byte_alphabet, each_text, only, worker_cache

#: Pre-tokens of byte-level BPE, as the tokenizer library splits them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def frequent_lengths(definition: str) -> dict[str, int]:
    """Pre-token -> number of tokens, for the pre-tokens that the vocabulary itself holds.

    A BPE vocabulary is the list of the strings that were frequent when it was made; it bounds this table (50,257
    entries here) whatever the corpus is, so it can be broadcast.
    """
    import json

    import regex
    from tokenizers import Tokenizer

    tokenizer, pattern, alphabet = Tokenizer.from_str(definition), regex.compile(PATTERN), {c: b for b, c in enumerate(byte_alphabet())}
    words = []
    for piece in json.loads(definition)["model"]["vocab"]:
        if all(c in alphabet for c in piece):
            try:
                word = bytes(alphabet[c] for c in piece).decode()
            except UnicodeDecodeError:
                continue
            if pattern.findall(word) == [word]:
                words.append(word)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    words = [w for w in words if w not in special]
    return {w: len(e) for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True)}


class Counter:
    """Tokens of whole texts: pre-token lengths from the frequent table, then from this worker's cache, then from the tokenizer's model."""

    def __init__(self, definition: str, frequent: dict[str, int]):
        import regex
        from tokenizers import Tokenizer

        tokenizer, letters = Tokenizer.from_str(definition), dict(enumerate(byte_alphabet()))
        tokenize = tokenizer.model.tokenize
        special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special, self.split = special, regex.compile("|".join(map(regex.escape, special))).split
        self.pieces = regex.compile(PATTERN).findall

        def length(piece: str) -> int:
            return frequent.get(piece) or len(tokenize(piece.encode().decode("latin-1").translate(letters)))

        self.length = Kept(length).__getitem__

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):  # the library gives their strings one token each
            parts = self.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        return sum(map(self.length, self.pieces(text)))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per input row; a null text counts as an empty one (no tokens).

    One pass without a shuffle. ``tokenizer_path`` is a byte-level BPE file of the tokenizers library, read on the
    driver. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    by_value()
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((definition, frequent_lengths(definition)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(("tokens", shared.value[0]), lambda: Counter(*shared.value))
        for batch in batches:
            counts = [counter.count(t) for t in each_text(batch.column(1))]
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
