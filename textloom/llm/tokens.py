"""Token counts by a public tokenizer; its vocabulary file stays where it is, the path is a parameter."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from textloom.runtime import extended

#: A rank file of byte-level BPE, 50,256 ids.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that goes with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_KEPT: dict = {}  # workers are reused, so a vocabulary is read once each


def encoding(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    if (vocabulary, pattern) not in _KEPT:
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _KEPT[vocabulary, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _KEPT[vocabulary, pattern]


def counted(df: DataFrame, id_col: str, text_col: str, keep: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, *keep, n_tokens, task): whole texts in tokens; null texts have 0, rows with null ids are left out.

    ``task`` numbers the task that counted the row. Special tokens' names in a text are ordinary text.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), *keep)

    def run(batches):
        enc, task = encoding(vocabulary, pattern), TaskContext.get().partitionId()
        for batch in batches:
            n = [len(enc.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in batch.column(1).to_pylist()]
            others = [batch.column(k) for k in range(batch.num_columns) if k != 1]
            yield pa.RecordBatch.from_arrays([*others, pa.array(n, pa.int64()), pa.array([task] * len(n), pa.int32())], names=[*(f for f in batch.schema.names if f != "__text"), "n_tokens", "task"])

    return rows.mapInArrow(run, extended(rows.drop("__text"), "n_tokens bigint, task int"))
