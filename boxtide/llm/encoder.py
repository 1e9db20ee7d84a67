"""Ids of whole texts by the tokenizers library."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa

from .common import cut_by_bytes

#: Bytes of texts that the library is given at a time, about; what it returns is some 30 times as large and stays in a core's cache.
AT_ONCE = 1 << 12


@lru_cache(maxsize=1)
def tokenizer(path: str):
    """One for each process; its own threads stay off, as tasks already use the cores."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoded(texts: pa.Array, path: str, most: int = AT_ONCE) -> Iterator[np.ndarray]:
    """For each text its ids as little-endian unsigned 32-bit integers; a null text is empty.

    Texts go to the library whole, in batches of about `most` bytes or of one text.
    """
    own = tokenizer(path)
    for part in cut_by_bytes([pa.RecordBatch.from_arrays([texts], ["text"])], 0, most):
        for found in own.encode_batch_fast([t or "" for t in part.column(0).to_pylist()], add_special_tokens=False):
            yield np.array(found.ids, "<u4")
