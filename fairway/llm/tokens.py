"""Token counts of whole texts, lengths only.

Rows of an Arrow batch are encoded in groups of about equal bytes. A text over ``PIECE_CHARS`` is
cut first, only where a single space stands between two non-space characters: the pre-tokenizer
starts a new pre-token at such a space whatever follows, and no special string holds a space, so the
counts of the parts add up to the count of the whole.

Null and empty texts have 0 tokens. Repeated rows are counted each; other columns pass through.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fairway.session import bounded_batches

PIECE_CHARS = 1 << 14
GROUP_BYTES = 1 << 18
_SAFE = re.compile(r"(?<=[^\s]) (?=[^\s])")
_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """Parts of a text whose token counts add up to its own."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def lengths(texts: list[str], path: str) -> list[int]:
    """Tokens of each text."""
    tokenizer = _tokenizer(path)
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    counts = [0] * len(texts)
    group: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for row, e in zip(owner, encode(group, add_special_tokens=False), strict=True):
            counts[row] += len(e)
        group.clear()
        owner.clear()
        held = 0

    for row, text in enumerate(texts):
        for part in pieces(text) if len(text) > PIECE_CHARS else (text,):
            if part:
                group.append(part)
                owner.append(row)
                held += len(part) if part.isascii() else len(part.encode())
                if held >= GROUP_BYTES:
                    flush()
    if group:
        flush()
    return counts


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then n_bytes and n_tokens. ``vocabulary`` is a path every worker can open."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or default_vocabulary()
        for b in batches:
            column = pc.fill_null(b.column("__text"), "")
            n = lengths(column.to_pylist(), path)
            size = pc.binary_length(column).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), size, pa.array(n, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)
