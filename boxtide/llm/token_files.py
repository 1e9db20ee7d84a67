"""Token ids in Arrow files of fixed-size lists."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, new_folder
from .encoder import encoded
from .encoder import tokenizer as tokenizer_of

SEQUENCE = 2048
ROWS = 64
MANIFEST = "part int, tokens string, docs string, n_tokens long, n_docs long"


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


class _TokenFile:
    """Ids in rows of `length`; the last row is filled up with 0, and masked there."""

    def __init__(self, fs, path: str, length: int, kind: pa.DataType) -> None:
        self.length, self.kind, self.rest, self.n, self.last = length, kind, [], 0, 0
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.n += len(ids)
        self.last += len(ids)
        if self.last >= ROWS * self.length:
            self._rows(self.last // self.length)

    def _rows(self, rows: int) -> None:
        flat = np.concatenate([*self.rest, np.zeros(max(0, rows * self.length - self.last), self.rest[0].dtype)])
        mask = np.arange(rows * self.length) < self.last
        cut, self.rest = flat[: rows * self.length], [flat[rows * self.length :]]
        self.last = max(0, self.last - rows * self.length)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (cut, mask)]
        for at in range(0, rows, ROWS):
            self.writer.write_batch(pa.RecordBatch.from_arrays([x.slice(at, ROWS) for x in lists], schema=self.schema))

    def close(self) -> None:
        if self.last:
            self._rows(-(-self.last // self.length))
        self.writer.close()
        self.sink.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int, length: int = SEQUENCE, key: str = "doc_id") -> DataFrame:
    """Writes the ids of `docs`, in ascending order of the key, below `folder`; the manifest.

    Each document is its whole text's ids and `end`; a null text counts as empty, and other columns are not read. Documents
    are dealt by range of (key, md5 of the text), null keys first, so that ties and
    repeated rows have an order and a frequent key is spread; each partition writes a file of
    rows of `length` ids with masks, and a file with each document's key, place and number
    of ids. Ids are 16 bits wide where the vocabulary allows, else 32. File names
    are new in each attempt of a task and only those of attempts that Spark took are in
    the manifest, a row a file pair, in the order of `part`. No rows: files without rows.
    """
    spark = docs.sparkSession
    wide = pa.uint16() if max(end, _vocabulary(tokenizer)) < 1 << 16 else pa.uint32()
    dealt = docs.select(key, "text").repartitionByRange(F.col(key), F.md5(F.col("text").cast("binary")))
    dealt = dealt.sortWithinPartitions(F.col(key), F.md5(F.col("text").cast("binary")))
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        part, tail = TaskContext.get().partitionId(), np.array([end], wide.to_pandas_dtype())
        name = f"{part:06d}-{uuid.uuid4().hex}"
        out, index, n_docs = None, None, 0
        for b in batches:
            if out is None:
                out = _TokenFile(fs, f"{path}/{name}.tokens.arrow", length, wide)
                schema = pa.schema([("key", b.schema.field(0).type), ("place", pa.int64()), ("n_tokens", pa.int64())])
                sink = fs.open_output_stream(f"{path}/{name}.docs.arrow")
                index = pa.ipc.new_file(sink, schema)
            places, sizes = [], []
            for found in encoded(b.column(1), tokenizer):
                ids = found.astype(tail.dtype)
                places.append(out.n)
                out.add(np.append(ids, tail))
                sizes.append(len(ids) + 1)
            index.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
            n_docs += b.num_rows
        if out is not None:
            out.close()
            index.close()
            sink.close()
            row = [part], [f"{folder}/{name}.tokens.arrow"], [f"{folder}/{name}.docs.arrow"], [out.n], [n_docs]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "tokens", "docs", "n_tokens", "n_docs"])

    return checkpoint(dealt.mapInArrow(write, MANIFEST))


def _vocabulary(path: str) -> int:
    return tokenizer_of(path).get_vocab_size()


def sequence(uri: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row `k` of a token file: its ids, a view of the file where it is local, and its mask."""
    with pa.ipc.open_file(_open(uri)) as f:
        batch = f.get_batch(k // ROWS)
        return batch.column(0)[k % ROWS].values.to_numpy(), batch.column(1)[k % ROWS].values.to_numpy(zero_copy_only=False)


def read_token_files(manifest: DataFrame, key_type: str = "bigint", key: str = "doc_id") -> DataFrame:
    """Key, start, n_tokens, ids_crc32 of each document, from the files of a manifest.

    start counts the ids of all documents before it in all files. A task opens its files and
    looks up each document by its place; files of one machine are mapped into memory.
    """
    before = manifest.selectExpr(
        "tokens", "docs", "coalesce(sum(n_tokens) over (order by part rows between unbounded preceding and 1 preceding), 0L) as before"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            with _open(row["tokens"]) as source, _open(row["docs"]) as listed:
                tokens, index = pa.ipc.open_file(source), pa.ipc.open_file(listed)
                each = [tokens.get_batch(k).column(0) for k in range(tokens.num_record_batches)]
                length = tokens.schema.field("ids").type.list_size
                flat = [x.values.to_numpy()[x.offset * length : (x.offset + len(x)) * length] for x in each]
                edge = np.r_[0, np.cumsum([len(x) for x in flat])]

                def ids(at: int, n: int, flat=flat, edge=edge) -> np.ndarray:
                    k = int(np.searchsorted(edge, at, "right")) - 1
                    got = flat[k][at - edge[k] : at - edge[k] + n]
                    while len(got) < n:
                        k += 1
                        got = np.append(got, flat[k][: n - len(got)])
                    return got

                for k in range(index.num_record_batches):
                    b = index.get_batch(k)
                    place, n = b.column(1).to_numpy(), b.column(2).to_numpy()
                    crc = [zlib.crc32(ids(p, m).astype("<u4").tobytes()) for p, m in zip(place.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place + row["before"]), b.column(2), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    out = before.repartition(files).mapInArrow(read, f"key {key_type}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("key", key)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, encoded with the byte-level vocabulary, written and read back; end id 2."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return read_token_files(manifest, docs.schema["doc_id"].dataType.simpleString())
