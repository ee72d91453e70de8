"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import text_buffer

#: The pre-tokenizer of byte-level BPE vocabularies. It never joins a single space to the non-space before it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def split_safely(text: str, most: int) -> list[str]:
    """Cuts a text into pieces whose token counts add up to the text's. A cut is made before a lone space between two non-spaces,
    where the pre-tokenizer always begins a new word; a stretch without such a place stays whole, however long it is."""
    out, at = [], 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


_ENCODERS: dict[int, object] = {}


def encoder(ranks: bytes):
    """A tiktoken encoding of a vocabulary in its file form, kept for the worker's life."""
    import tiktoken

    key = hash(ranks)
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", batch_bytes: int = 1 << 20, most_bytes: int = 1 << 18) -> DataFrame:
    """(key, n_tokens) for every row of `docs`.

    tokenizer: a vocabulary file read once on the driver and broadcast (its size doesn't depend on the data).
    batch_bytes: texts are encoded together up to so many bytes of UTF-8, in batches of about the same size; most_bytes: longer texts are split at safe boundaries first.
    Null text: null count. Empty text: 0. Null keys and repeated rows are kept, one output row for each input row. Other columns of
    `docs`, whatever their names, are neither read nor returned. No shuffle.
    """
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_ordinary_batch
        for b in batches:
            size = np.diff(text_buffer(b.column(1))[1])
            rows, parts, sizes = [], [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                if t is not None:
                    # a character has 1 to 4 bytes, so pieces of this many characters have about most_bytes
                    own = split_safely(t, max(1, most_bytes * len(t) // int(size[row]))) if size[row] > most_bytes else [t]
                    rows += [row] * len(own)
                    parts += own
                    sizes += [len(x.encode()) for x in own] if len(own) > 1 else [int(size[row])]
            lengths = np.zeros(b.num_rows, np.int64)
            for i, j in balanced(np.array(sizes, np.int64), batch_bytes):
                np.add.at(lengths, rows[i:j], [len(x) for x in encode(parts[i:j], num_threads=1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, mask=np.asarray(b.column(1).is_null()))], [key, "n_tokens"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(count, f"{key} long, n_tokens long")


def balanced(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of successive pieces whose bytes are about the same in each, and about `most` at most but for larger single pieces."""
    if not sizes.size:
        return []
    total = np.cumsum(sizes)
    n = max(1, -(-int(total[-1]) // most))
    cut = np.unique(np.concatenate([[0], np.searchsorted(total, total[-1] * np.arange(1, n) / n, "right"), [sizes.size]]))
    return list(zip(cut[:-1].tolist(), cut[1:].tolist()))
