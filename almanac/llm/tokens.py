"""Public tokenizers as parameters: vocabulary files are read where they lie and never copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.session import ship

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pre-tokenizer pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokenizer:
    """Byte-level BPE of a ``.tiktoken`` vocabulary file; loaded once in each Python worker."""

    _loaded: dict[tuple[str, str], tuple] = {}

    def __init__(self, path: str | None = None, pattern: str = PATTERN):
        self.path, self.pattern = path or os.environ.get("ALMANAC_VOCABULARY", DEFAULT_VOCABULARY), pattern

    def _load(self) -> tuple:
        got = self._loaded.get((self.path, self.pattern))
        if got is None:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            lens = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                lens[i] = len(token)
            got = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}), lens
            self._loaded[self.path, self.pattern] = got
        return got

    def encode(self, text: str) -> list[int]:
        return self._load()[0].encode_ordinary(text)

    def sizes(self, text: str) -> np.ndarray:
        """Bytes of each token."""
        enc, lens = self._load()
        return lens[np.array(enc.encode_ordinary(text), np.int64)]


def token_counts(docs: DataFrame, keep: list[str], text_col: str, tokenizer: ByteTokenizer) -> DataFrame:
    """The columns ``keep`` and ``tokens`` (long; null texts have 0), whole texts, without a shuffle."""
    ship(docs.sparkSession)
    schema = docs.select(*keep).schema.add("tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            n = pa.array([len(tokenizer.encode(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), n], names=[*keep, "tokens"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)
