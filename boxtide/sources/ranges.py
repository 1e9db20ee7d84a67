"""One large JSON document read by as many tasks as it has byte ranges."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint, shared_dir

#: Bytes that are looked at together, how far back a key is looked for, and bytes of objects in a row, about.
CHUNK, KEY, RUN = 1 << 22, 1 << 12, 1 << 16
#: Ranges whose states are sent to all tasks, at most.
MOST_RANGES = 1 << 20
_ESCAPED = re.compile(rb"\\.", re.S)
_NAMED = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)
_QUOTE, _OBJECT, _ARRAY_END, _ARRAY = (ord(c) for c in '"{][')
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_MARK = _STEP != 0
_MARK[_QUOTE] = True
PIECES = "file string, block long, idx long, kind string, key string, n int, json array<string>"


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value, shared): what ends with each closing brace, in its order within a byte range, whose start is `block`; whether the file has more ranges."""
    meta = [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_path", "file"), ("file_block_start", "block"))]
    shared = (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("shared")
    return spark.read.text(path, lineSep="}").select(*meta, F.concat(F.col("value").cast("binary"), F.lit(b"}")).alias("value"), shared)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """Each range of a task, with its bytes in chunks."""

    def slices() -> Iterator[tuple[tuple[str, int], bytes]]:
        for b in batches:
            place = np.c_[b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy()]
            edges = [0, *(np.flatnonzero((np.diff(place, axis=0) != 0).any(axis=1)) + 1).tolist(), b.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if end > start:
                    values = b.column(2).slice(start, end - start)
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), b"")
                    yield (b.column(0)[start].as_py(), b.column(1)[start].as_py()), joined[0].as_py()

    def chunks(own: Iterator) -> Iterator[bytes]:
        held, size = [], 0
        for _, text in own:
            held.append(text)
            size += len(text)
            if size >= CHUNK:
                yield b"".join(held)
                held, size = [], 0
        if held:
            yield b"".join(held)

    for place, own in groupby(slices(), key=lambda x: x[0]):
        yield place, chunks(own)


def _marks(text: bytes, odd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of the brackets in `text`, which they are, whether they lie in a string, and the quotes; `odd` quotes come before."""
    plain = np.frombuffer(_ESCAPED.sub(b"__", text) if b"\\" in text else text, np.uint8)
    at = np.flatnonzero(_MARK[plain])
    mark = plain[at]
    quote = mark == _QUOTE
    inside = ((np.cumsum(quote) + odd) & 1)[~quote]
    return at[~quote], mark[~quote], inside, int(quote.sum())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range its quotes, and by how much the depth changes if it begins outside of a string, and inside."""
    for (file, block), chunks in _ranges(batches):
        quotes, change = 0, [0, 0]
        for text in chunks:
            _, mark, inside, more = _marks(text, quotes)
            quotes += more
            for k in (0, 1):
                change[k] += int(_STEP[mark[inside == k]].sum())
        yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "quotes": quotes, "outside": change[0], "inside": change[1]}])


def _cut(states: dict[tuple[str, int], tuple[int, int]]):
    """Pieces of ranges whose state at the start, (in a string, depth), is known; a file's first has none.

    Kinds: o, objects of an array of the document that follow each other, the first being the `idx`-th of its key in the range; h and t, the
    end and the beginning of one that ranges share; m, a range within one; s, the array that is open at the range's
    end ("" for none, null if it is that of the start).
    """

    def of(file: str, block: int, chunks: Iterator[bytes]) -> Iterator[tuple]:
        odd, depth = states[file, block] if block else (0, 0)
        key, seen, before = None if depth >= 2 else "", Counter(), b""
        kind, held = ("h" if depth >= 3 else None), []  # what is open: an object, or one from an earlier range

        def row(kind: str, texts: list[bytes]) -> tuple:
            own = kind in "ot"
            seen[key] += len(texts) if own else 0
            return seen[key] - len(texts) if own else -1, kind, key, texts

        for text in chunks:
            at, mark, inside, quotes = _marks(text, odd)
            at, mark = at[inside == 0], mark[inside == 0]
            step = _STEP[mark]
            level = depth + np.cumsum(step)
            opening, closing = (step == 1) & (level == 2), (step == -1) & ((level == 1) | ((level == 2) & (mark == _ARRAY_END)))
            special = opening | closing
            edge = np.flatnonzero(special | ((step == 1) & (level == 3) & (mark == _OBJECT)) | ((step == -1) & (level == 2)))
            places, opens, ends, arrays = at[edge], opening[edge], level[edge] == 1, mark[edge] == _ARRAY
            start, done = 0, 0
            for turn in [*np.flatnonzero(special[edge]).tolist(), None]:
                # Up to the next border of an array, objects begin and end by turns.
                own, done = places[done:turn], len(places) if turn is None else turn + 1
                if key != "" and len(own):
                    if kind is not None:
                        held.append(text[start : own[0] + 1])
                        yield row(kind, [b"".join(held)])
                        kind, held, own = None, [], own[1:]
                    begin, end = own[: len(own) // 2 * 2 : 2], own[1::2] + 1
                    if len(begin):
                        texts = [text[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
                        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(end - begin) // RUN)) + 1).tolist(), len(texts)]
                        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                            yield row("o", texts[i:j])
                    if len(own) % 2:
                        kind, start, held = "o", int(own[-1]), []
                if turn is None:
                    break
                i = int(places[turn])
                if opens[turn]:
                    named = _NAMED.search((before + text[:i])[-KEY:]) if i < KEY else _NAMED.search(text[i - KEY : i])
                    if named is None and depth >= 1 and not before and block:
                        raise ValueError(f"{file}: a key begins before the range at {block}, and its array in it")
                    key = named[1].decode() if named and arrays[turn] else ""
                elif ends[turn]:
                    key = ""
                else:  # an array within the array, begun in an earlier range
                    kind, held = None, []
            if kind is not None:
                held.append(text[start:])
            odd, depth, before = odd + quotes, depth + int(step.sum()), (before + text[-KEY:])[-KEY:]
        if kind is not None:
            yield row("t" if kind == "o" else "m", [b"".join(held)])
        yield -1, "s", key, []

    def batch(file: str, block: int, rows: list[tuple]) -> pa.RecordBatch:
        idx, kind, key, texts = zip(*rows, strict=True)
        n = np.array([len(x) for x in texts])
        json = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array([t for x in texts for t in x], pa.string()))
        columns = [[file] * len(rows), [block] * len(rows), idx, kind, key, n]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns, kinds, strict=True)), json], [c.split()[0] for c in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), chunks in _ranges(batches):
            rows, size = [], 0
            for row in of(file, block, chunks):
                rows.append(row)
                size += sum(map(len, row[3]))
                if size >= CHUNK:
                    yield batch(file, block, rows)
                    rows, size = [], 0
            if rows:
                yield batch(file, block, rows)

    return run


def array_runs(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, position, json): the objects in the arrays that are values of a JSON document's own keys, each as its text, up to some `RUN` bytes of them in a row.

    The file is read in byte ranges, as Spark splits text files. A first pass counts each range's quotes and
    brackets, from which follow its depth at the start and whether it begins in a string; files of one range need none. A
    second one cuts the objects at their borders. Objects that ranges share are put together
    again. `position` is the first object's place in the array, from 0. Braces, quotes and escapes in strings, nested objects and blanks are no
    border. Values that are no arrays, and elements that are no objects, have no row. No range is held whole.
    """
    fragments = _fragments(spark, path)
    counted = fragments.where("shared").select("file", "block", "value").mapInArrow(_counted, "file string, block long, quotes long, outside long, inside long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    counted = counted.withColumn("change", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
    counted = counted.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    rows = counted.where("block > 0").select("file", "block", "odd", "depth").take(MOST_RANGES + 1)
    if len(rows) > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges; raise spark.sql.files.maxPartitionBytes")
    where = f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex}"
    states = {(r.file, r.block): (r.odd, r.depth) for r in rows}
    fragments.select("file", "block", "value").mapInArrow(_cut(states), PIECES).write.parquet(where)
    pieces = spark.read.schema(PIECES).parquet(where)
    open_before = F.last("key", ignorenulls=True).over(before)
    opened = pieces.where("kind = 's'").withColumn("open", open_before).where("block > 0").select("file", "block", "open")
    shared = pieces.where("kind in ('h', 'm', 't')").withColumn("turn", (F.col("kind") == "t").cast("int")).withColumn("json", F.get("json", F.lit(0)))
    earlier = Window.partitionBy("file").orderBy("block", "turn").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(F.col("kind") == "t", F.col("block")).otherwise(F.last(F.when(F.col("kind") == "t", F.col("block")), ignorenulls=True).over(earlier))
    shared = shared.withColumn("begun", begun).where("begun is not null")
    # Pieces after an object's end are those of values that are no object of an array.
    own = Window.partitionBy("file", "begun").orderBy("block", "turn").rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.withColumn("ended", F.coalesce(F.sum((F.col("kind") == "h").cast("int")).over(own), F.lit(0))).where("ended = 0").groupBy("file", F.col("begun").alias("b"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "turn", "json"))), lambda x: x["json"]), "")
    whole = shared.agg(texts.alias("json"), F.max(F.when(F.col("kind") == "t", F.struct("idx", "key"))).alias("x"), F.count_if(F.col("kind") == "h").alias("n"))
    whole = whole.where("n > 0").select("file", F.col("b").alias("block"), "x.idx", "x.key", F.lit(1).alias("n"), F.array("json").alias("json"))
    every = pieces.where("kind = 'o'").select("file", "block", "idx", "key", "n", "json").unionByName(whole)
    every = every.join(F.broadcast(opened), ["file", "block"], "left").withColumn("key", F.coalesce("key", "open")).where("key <> ''").drop("open")
    ahead = Window.partitionBy("file", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = every.groupBy("file", "key", "block").agg(F.sum("n").alias("n"))
    sizes = sizes.withColumn("shift", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where("block > 0").select("file", "key", "block", "shift")
    out = every.join(F.broadcast(checkpoint(sizes)), ["file", "key", "block"], "left")
    return out.select("file", "key", (F.col("idx") + F.coalesce("shift", F.lit(0))).alias("position"), "json")


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """`array_runs` with a row for each object: (file, key, position, json)."""
    runs = array_runs(spark, path).select("file", "key", "position", F.posexplode("json").alias("k", "json"))
    return runs.select("file", "key", (F.col("position") + F.col("k")).alias("position"), "json")
