"""Problem 8: token ids of every text of a corpus, by a public byte-level vocabulary."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokenizers import FOLDER, ByteEncoder


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``key`` and ids (array<int>), without special tokens. Empty and null texts have an empty list; other columns are dropped.

    One pass without a shuffle; the model is made once per task, and ids leave it in Arrow batches of bounded size.
    """

    def part(batches):
        model = ByteEncoder(tokenizer, folder)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                some = b.slice(i, 1000)
                ids = [model.ids(t) for t in some.column(1).to_pylist()]
                ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(part, f"`{key}` {kind}, ids array<int>")


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``key`` and text: the inverse of encoded(). Null ids give a null text."""

    def part(batches):
        model = ByteEncoder(tokenizer, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else model.text(x) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(part, f"`{key}` {kind}, text string")
