"""Token counts by a public tokenizer whose file every executor can read."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in a process; strings of special tokens count as ordinary text."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.encode_special_tokens = True
        found.no_truncation()
        found.no_padding()
        _loaded[path] = found
    return _loaded[path]


def counted(docs: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """docs with the column `text` replaced by `tokens`, its number of tokens; null and empty texts have none."""
    rest = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*rest).dtypes) + ", tokens long"

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sizes: list[int] = []
            for i in range(0, len(texts), 256):
                sizes += [len(e.ids) for e in tokenizer(path).encode_batch([t or "" for t in texts[i : i + 256]], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*rest, "tokens"])

    return docs.select(*rest, F.col(text)).mapInArrow(run, schema)
