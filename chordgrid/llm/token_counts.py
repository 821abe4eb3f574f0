"""Token counts: texts are encoded in Arrow batches of balanced bytes, and only lengths come back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chordgrid.llm.common import text_of
from chordgrid.llm.tokenizing import encoder, segments


def balanced(texts: list[bytes], batch_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """(row, segment) lists of about ``batch_bytes`` each; a long text is split at white space over several lists."""
    batch, size = [], 0
    for row, text in enumerate(texts):
        for segment in segments(text, batch_bytes, marks=True):
            batch.append((row, segment))
            size += len(segment)
            if size >= batch_bytes:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def count_tokens(
    df: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 2048, batch_bytes: int = 1 << 20
) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) for each row of ``df``.

    ``tokenizer`` is the path of a ``tokenizers`` file on every executor. A null or empty text has 0 bytes and 0
    tokens; repeated rows each give a row; a null doc_id stays null; other columns are not read, so their names can't
    clash; an empty table gives an empty result. Memory is bounded by ``batch_bytes``, the word table, and one Arrow
    batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = np.zeros(len(texts), np.int64)
            for part in balanced(texts, batch_bytes):
                split = [(row, segment.split()) for row, segment in part]
                flat = [word for _, words in split for word in words]
                words_of.learn(flat)
                for row, words in split:
                    tokens[row] += sum(map(len, map(words_of.ids.__getitem__, words))) // 4
                words_of.forget_long(flat)
            n_bytes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
