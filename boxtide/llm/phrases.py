"""Collocations: frequent phrases grown by joining vertical lists of word positions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FEW, batches_of, checkpoint, cut_by_bytes, few, new_folder

#: A phrase's least frequency, its words at most, and how many of a language are returned.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Language of rows that name none.
NONE = "und"
#: Bytes of text in one block of positions, about.
BLOCK = 1 << 21
#: What ends a piece of a text, and what stands between words.
BREAKS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
_LOWER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_LOWER + BREAKS + BLANKS, _LOWER.lower() + b"\n" * len(BREAKS) + b" " * len(BLANKS))
WORDS = "block long, lang string, words array<string>, counts array<long>, ids array<int>"
NAMED = "block long, lang string, ids array<int>, own array<int>, name array<long>"
KEPT = "block long, lang string, ids array<int>, word array<long>, size array<int>, positions array<int>, at array<int>, name array<long>"
#: Cells that phrases are counted in, at most, and in one slice of them, as powers of two; places, and lists, that a task counts at once.
CELLS, SLICE, AT_ONCE, LISTS_AT_ONCE = 28, 20, 1 << 23, 1 << 20
#: Cells of the sums that one row holds, as a power of two.
SUMS = 16
LISTS = "block long, lang string, ids array<int>, word array<long>, a array<long>, b array<long>, size array<int>, positions array<int>"


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The texts' different words, and for each place the number of its word; -1 ends a piece."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    number[b""], number[b"\n"] = 0, 1
    folded = b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(number.__getitem__, folded), np.int32, len(folded))
    return list(number)[2:], ids[ids > 0] - 2


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId() << 32, 0
    for b in cut_by_bytes(batches, 1, BLOCK):
        by = sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), key=lambda x: x[0])
        for lang, texts in groupby(by, key=lambda x: x[0]):
            words, ids = words_of([t for _, t in texts])
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            row = [[part + k], [lang], [[w.decode("utf-8", "replace") for w in words]], [counts], [ids]]
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["block", "lang", "words", "counts", "ids"])


def extended(ids: np.ndarray, word: np.ndarray, phrase: np.ndarray, positions: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(a, b, size, positions): the lists of all phrases of k + 1 words, by phrase and next word.

    `positions` are the places where the occurrences of `phrase`, of k words, begin. Joined with
    the postings, laid out by position in `ids`, k places on, they give each occurrence's next word.
    """
    after = positions.astype(np.int64) + k
    there = after < len(ids)
    phrase, positions, after = phrase[there], positions[there], after[there]
    following = ids[after]
    phrase, positions, b = phrase[following >= 0], positions[following >= 0], word[following[following >= 0]]
    by = np.lexsort((positions, b, phrase))
    a, b, positions = phrase[by], b[by], positions[by]
    begin = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)]) if len(a) else np.empty(0, np.int64)
    return a[begin], b[begin], np.diff(np.r_[begin, len(a)]).astype(np.int32), positions.astype(np.int32)


def _row(block: int, lang: str, ids: np.ndarray, word: np.ndarray, lists: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), *(pa.list_(t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
    names = ["block", "lang", "ids", "word", "a", "b", "size", "positions"]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, lang, ids, word, *lists), kinds, strict=True)], names)


def _numpy(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


#: Of a block: its number, language, ids, their words' names; the name of the phrase at each of some positions, and those; a frequent word follows each.
Grown = tuple[int, str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _frequent_words(shared: Broadcast | None):
    """Blocks of frequent words alone, others being -1. Their names come from `shared`, or as `own`, their numbers, and `name`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[Grown]:
        for b in batches:
            for k in range(b.num_rows):
                lang, ids = b.column(1)[k].as_py(), _numpy(b.column(2), k)
                if shared is None:
                    own, name = _numpy(b.column(3), k), _numpy(b.column(4), k)
                else:
                    words, names = shared.value.get(lang, (pa.array([], pa.string()), np.empty(0, np.int64)))
                    found = pc.index_in(b.column(3)[k].values, value_set=words)
                    own = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                    name = names[found.drop_null().to_numpy()]
                new = np.full(max(int(ids.max(initial=-1)), int(own.max(initial=-1))) + 2, -1, np.int32)
                new[own] = np.arange(len(own))
                ids = new[ids]  # the last is that of -1
                at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
                yield b.column(0)[k].as_py(), lang, ids, name, name[ids[at]], at

    return run


def cells_of(phrase: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """The cell, one of 2^bits, that a phrase of these two parts counts in."""
    x = phrase.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - bits)).astype(np.uint32)


def _counted_cells(source, length: int, bits: int, least: int):
    """Rows (slice, n, cells): a task's counts of cells, no more than `least` each, as gaps and counts, byte by byte, compressed."""
    low = min(SLICE, bits)

    def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(cells, np.arange(1, 1 << (bits - low)) << low)
        for own, n in zip(np.split(cells, edges), np.split(counts, edges), strict=True):
            if len(own):
                gaps = np.diff(own & ((1 << low) - 1), prepend=np.uint32(0))
                planes = np.concatenate([gaps, np.minimum(n, least)]).astype("<u4").view(np.uint8).reshape(-1, 4).T
                row = [int(own[0]) >> low], [len(own)], [pa.compress(planes.tobytes(), "zstd", asbytes=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["slice", "n", "cells"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, ids, word, phrase, at in source(batches):
            held.append(cells_of(phrase, word[ids[at + length]], bits))
            size += len(held[-1])
            if size >= AT_ONCE:
                yield from rows(held)
                held, size = [], 0
        if size:
            yield from rows(held)

    return run


def _full_cells(bits: int, least: int):
    """A slice's cells that have `least` places or more, as bits, compressed."""
    low = min(SLICE, bits)

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << low, np.int64)
        for n, cells in zip(table.column("n").to_pylist(), table.column("cells"), strict=True):
            planes = np.frombuffer(pa.decompress(cells.as_buffer(), 8 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1)
            gaps, counts = np.split(np.ascontiguousarray(planes.T).view("<u4").ravel(), 2)
            total[np.cumsum(gaps)] += counts
        full = pa.compress(np.packbits(total >= least).tobytes(), "zstd", asbytes=True)
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "full": pa.array([full], pa.binary())})

    return run


def _full_lists(source, length: int, full: Broadcast, bits: int):
    """Lists of the phrases of a word more than `length` whose cells are full; all frequent ones are among them."""
    low = min(SLICE, bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << (bits - low), (1 << low) // 8), np.uint8)
        for k, own in full.value.items():
            held[k] = np.frombuffer(pa.decompress(own, held.shape[1], "zstd", asbytes=True), np.uint8)
        held = held.ravel()
        for block, lang, ids, word, phrase, at in source(batches):
            cells = cells_of(phrase, word[ids[at + length]], bits)
            on = (held[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
            phrase, at = phrase[on], at[on]
            ids = _kept(ids, at, length + 1)
            yield _row(block, lang, ids, word, extended(ids, word, phrase, at, length))

    return run


def _kept(ids: np.ndarray, positions: np.ndarray, length: int) -> np.ndarray:
    """`ids` with -1 for all that lies in none of the stretches of `length` words that begin at `positions`."""
    held = np.zeros(len(ids), bool)
    for d in range(length):
        held[positions + d] = True
    return np.where(held, ids, -1).astype(np.int32)


class Pairs:
    """The names of pairs of numbers."""

    def __init__(self, a: np.ndarray, b: np.ndarray, name: np.ndarray) -> None:
        self.a, self.b = np.unique(a), np.unique(b)
        key = self._keys(a, b)
        by = np.argsort(key)
        self.key, self.name = key[by], name[by]

    def _keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for each pair; -1 for those with a part that is unknown."""
        parts = []
        for known, x in ((self.a, a), (self.b, b)):
            at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
            parts.append(np.where(known[at] == x, at, -1) if len(known) else np.full(len(x), -1))
        return np.where((parts[0] < 0) | (parts[1] < 0), -1, parts[0] * len(self.b) + parts[1])

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The name of each pair, -1 for those that have none."""
        key = self._keys(a, b)
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return np.where(self.key[at] == key, self.name[at], -1) if len(self.key) else np.full(len(key), -1)


def _frequent_lists(length: int, shared: Broadcast | None):
    """Where phrases of `length` words can go on. Which of a block's lists are frequent `shared` says, or `at`, their places, and `name`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[Grown]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, word, size, positions, x, y = (_numpy(batch.column(c), k) for c in range(2, 8))
                if shared is None:
                    names = np.full(len(size), -1, np.int64)
                    names[x] = y
                else:
                    names = shared.value.find(x, y)
                phrase = np.repeat(names, size)
                phrase, positions = phrase[phrase >= 0], positions[phrase >= 0]
                begins = np.zeros(len(ids) + 1, bool)  # a longer phrase is frequent only if the one without its first word is
                begins[positions] = True
                on = begins[positions + 1]
                yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), ids, word, phrase[on], positions[on]

    return run


def _together(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows a, b, size; the sizes of equal pairs are summed."""
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    begin = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)])
    return np.stack([a[begin], b[begin], np.add.reduceat(size[by], begin)])


def _sizes(bits: int):
    """Rows (slice, n, sums): a task's lists, those of one phrase put together, as a's gaps, b and size, byte by byte, compressed."""
    low = min(SUMS, bits)

    def rows(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = cells_of(found[0], found[1], bits) >> low
        by = np.argsort(part, kind="stable")
        found, part = found[:, by], part[by]
        for own in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
            a, b, size = found[:, own]
            planes = np.stack([np.diff(a, prepend=0), b, size]).astype("<i8").view(np.uint8).reshape(-1, 8).T
            row = [int(part[own[0]])], [len(own)], [pa.compress(planes.tobytes(), "zstd", asbytes=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["slice", "n", "sums"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                held.append(np.stack([_numpy(batch.column(c), k).astype(np.int64) for c in range(3)]))
                size += held[-1].shape[1]
                if size >= 2 * LISTS_AT_ONCE:
                    held = [_together(*np.concatenate(held, axis=1))]
                    size = held[0].shape[1]
                    if size >= LISTS_AT_ONCE:
                        yield from rows(held[0])
                        held, size = [], 0
        if size:
            yield from rows(_together(*np.concatenate(held, axis=1)))

    return run


def _frequent(least: int):
    """(a, b, f) of a slice's phrases that have `least` places or more."""

    def run(table: pa.Table) -> pa.Table:
        held = []
        for n, own in zip(table.column("n").to_pylist(), table.column("sums"), strict=True):
            planes = np.frombuffer(pa.decompress(own.as_buffer(), 24 * n, "zstd", asbytes=True), np.uint8).reshape(8, -1)
            gaps, b, size = np.ascontiguousarray(planes.T).view("<i8").reshape(3, -1)
            held.append(np.stack([np.cumsum(gaps), b, size]))
        found = _together(*np.concatenate(held, axis=1))
        return pa.table(dict(zip(("a", "b", "f"), found[:, found[2] >= least], strict=True)))

    return run


def _written(df: DataFrame, what: str, kind: str) -> DataFrame:
    """`df`, rows of some MB, as a table whose readers hold two of them at once."""
    folder = new_folder(df.sparkSession, what)
    with batches_of(df.sparkSession, BLOCK):
        df.write.option("parquet.block.row.count.limit", "2").parquet(folder)
    return df.sparkSession.read.schema(kind).parquet(folder)


def _lists(frame: DataFrame, source, length: int, bits: int, least: int) -> DataFrame:
    """Lists of phrases of a word more than `length`, of the rows of `frame` as `source` reads them.

    Places are counted first, in cells by their phrase's hash, and only phrases whose cell holds `least` places or more have lists: the
    others can't be frequent. Of the counts a task sends a byte or two a cell, the driver gets a bit a cell at most.
    """
    spark = frame.sparkSession
    counts = frame.mapInArrow(_counted_cells(source, length, bits, least), "slice int, n int, cells binary")
    with batches_of(spark, BLOCK):
        full = counts.groupBy("slice").applyInArrow(_full_cells(bits, least), "slice int, full binary").collect()
    sent = spark.sparkContext.broadcast({r.slice: bytes(r.full) for r in full})
    return frame.mapInArrow(_full_lists(source, length, sent, bits), LISTS)


def _pair_lists(blocks: DataFrame, each: DataFrame, known: DataFrame, at_most: int, bits: int, least: int) -> DataFrame:
    """Lists of pairs of frequent words (`known`), which tasks get whole if they are `at_most`, and else by a join."""
    if known.count() <= at_most:
        table = known.select("lang", "phrase", "name").toArrow().combine_chunks()
        by: dict[str, tuple] = {}
        for lang in table.column("lang").unique().to_pylist():
            own = table.filter(pc.equal(table.column("lang"), lang)).combine_chunks()
            by[lang] = own.column("phrase").combine_chunks(), own.column("name").to_numpy()
        shared = blocks.sparkSession.sparkContext.broadcast(by)
        return _lists(blocks.select("block", "lang", "ids", "words"), _frequent_words(shared), 1, bits, least)
    own = each.select("block", "lang", "own", F.col("words").alias("phrase")).join(known.select("lang", "phrase", "name"), ["lang", "phrase"])
    found = own.groupBy("block").agg(F.collect_list(F.struct("own", "name")).alias("x"))
    joined = blocks.select("block", "lang", "ids").join(found, "block").select("block", "lang", "ids", F.col("x.own").alias("own"), F.col("x.name").alias("name"))
    return _lists(_written(joined, "phrase-names", NAMED), _frequent_words(None), 1, bits, least)


def _grown_lists(lists: DataFrame, told: DataFrame, length: int, at_most: int, bits: int, least: int) -> DataFrame:
    """Lists of phrases of a word more than the frequent ones (`told`) of `length` words; those are handed out as above."""
    if told.count() <= at_most:
        table = told.select("a", "b", "name").toArrow()
        shared = lists.sparkSession.sparkContext.broadcast(Pairs(*(table.column(c).to_numpy() for c in ("a", "b", "name"))))
        return _lists(lists.select("block", "lang", "ids", "word", "size", "positions", "a", "b"), _frequent_lists(length, shared), length, bits, least)
    places = lists.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("at", "x")).select("block", "at", "x.*")
    found = places.join(told.select("a", "b", "name"), ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("at", "name")).alias("x"))
    kept = lists.select("block", "lang", "ids", "word", "size", "positions").join(found, "block")
    kept = kept.select("block", "lang", "ids", "word", "size", "positions", F.col("x.at").alias("at"), F.col("x.name").alias("name"))
    return _lists(_written(kept, "phrase-kept", KEPT), _frequent_lists(length, None), length, bits, least)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, at_most: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to `longest` words that occur `least` times or more, and (lang, n) of all words.

    The texts lie in blocks; a block holds for each phrase the list of the positions where it
    begins. Lists of phrases grow by a word: their positions are joined with the postings of
    frequent words that lie next to them, and a list's length is the phrase's exact frequency in
    its block. Lengths are summed over blocks, blocks get back the names of what is frequent
    in all, and only its lists grow on, by words whose own phrase of that length is frequent too. Phrases have lists only where the cell that their hash counts in is full. Lists never leave their block; up to `at_most` frequent phrases
    of a length are sent to all tasks, more are joined with the blocks that have them.
    """
    texts = docs.select(F.coalesce("lang", F.lit(NONE)).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    blocks = _written(texts.mapInArrow(_blocks, WORDS), "phrase-words", WORDS)
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("own", "x")).select("block", "lang", "own", "x.*")
    words = checkpoint(each.groupBy("lang", F.col("words").alias("phrase")).agg(F.sum("counts").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = checkpoint(words.where(F.col("f") >= least).withColumn("name", F.monotonically_increasing_id()))
    levels = [known.select("lang", "phrase", F.lit(1).alias("k"), "f")]
    # A cell for every four words: phrases that aren't frequent seldom fill one.
    bits = min(CELLS, max(8, (int(totals.agg(F.sum("n")).first()[0] or 0) // 4).bit_length()))
    lists = _pair_lists(blocks, each, known, at_most, bits, least)
    parts, last = known.select("name", "phrase"), known.select(F.col("name").alias("b"), F.col("phrase").alias("word"), "lang")
    for k in range(2, longest + 1):
        lists = _written(lists, "phrase-lists", LISTS) if k < longest else lists
        sums = lists.select("a", "b", "size").mapInArrow(_sizes(bits), "slice int, n int, sums binary").groupBy("slice").applyInArrow(_frequent(least), "a long, b long, f long")
        with batches_of(docs.sparkSession, BLOCK):
            grown = checkpoint(sums.withColumn("name", F.monotonically_increasing_id()))
        # The longer phrase's words are those of `a` and `b`.
        told = grown.join(few(parts).withColumnsRenamed({"name": "a", "phrase": "head"}), "a").join(few(last), "b")
        told = checkpoint(told.select("name", "lang", F.concat_ws(" ", "head", "word").alias("phrase"), F.lit(k).alias("k"), "f", "a", "b"))
        levels.append(told.select("lang", "phrase", "k", "f"))
        if k == longest or told.isEmpty():
            break
        parts = told.select("name", "phrase")
        lists = _grown_lists(lists, told, k, at_most, bits, least)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out, totals


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language that are more frequent than their parts tell.

    Texts are split at punctuation and line ends into pieces and those at blanks into words,
    A-Z lower-cased. Candidates have 2 to `longest` words and a frequency a >= `least`
    (`frequent_phrases`). Of the cuts into two parts with frequencies l and r, the one of the
    least score floor(1000 a n / (l r)) counts, the first of ties; n is the number of words of the language. A
    candidate goes if a longer one that holds it is as frequent; it is enough to look at
    those longer by a word, as frequency never grows with length. All numbers are exact.
    Ranks go by score, then a, both descending, then the phrase's bytes.

    Null texts are empty, a null language is `und`; texts without a word add nothing; repeated rows and null ids count
    like all others; a table without a candidate gives no rows. A block of texts is one row of some MB;
    columns but text and lang are not read.
    """
    all_of, totals = frequent_phrases(docs, least, longest)
    parts = all_of.select("lang", "phrase", "f")
    found = all_of.where("k > 1")
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cut)")).withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    cuts = cuts.join(parts.withColumnsRenamed({"phrase": "head", "f": "l"}), ["lang", "head"])
    cuts = cuts.join(parts.withColumnsRenamed({"phrase": "tail", "f": "r"}), ["lang", "tail"]).join(F.broadcast(totals) if totals.count() <= 1 << 16 else totals, "lang")
    whole = [F.col(c).cast("decimal(19,0)") for c in ("f", "n", "l", "r")]
    product = (whole[0] * whole[1]).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("over", product.cast("decimal(38,0)")).withColumn("under", (whole[2] * whole[3]).cast("decimal(38,0)"))
    least_cut = F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r", "n"))
    scored = cuts.groupBy("lang", "phrase", F.col("f").alias("a")).agg(least_cut.alias("x")).select("lang", "phrase", "a", "x.*")
    longer = all_of.where("k > 2").select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring(phrase, locate(' ', phrase) + 1)"))).alias("phrase"))
    held = longer.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    left = scored.join(held, ["lang", "phrase"], "left").where(F.col("held").isNull() | (F.col("held") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of `documents`, by language."""
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
with docs as (
    select row_number() over () as d, coalesce(lang, 'und') as lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select d, lang, unnest(range(len(ps))) as p, unnest(ps) as piece from (select d, lang, regexp_split_to_array(t, '[.,;:!?\n\x0b\f\r]') as ps from docs)),
lists as (select d, lang, p, list_filter(regexp_split_to_array(piece, '[ \t]'), lambda w: w <> '') as ws from pieces),
words as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from lists),
totals as (select lang, count(*) as n from words group by lang),
spans as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase from words, range(1, 6) as t(k) where i + k - 1 <= len(ws)),
counts as (select lang, k, phrase, count(*) as f from spans group by all having count(*) >= 100),
cuts as (
    select c.lang, c.phrase, c.k, c.f as a, j, array_to_string(string_split(c.phrase, ' ')[1:j], ' ') as head,
        array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') as tail
    from counts c, range(1, 5) as t(j) where j < c.k),
scored as (
    select x.lang, x.phrase, x.k, a, l.f as l, r.f as r, n, j, (1000::hugeint * a * n) // (l.f::hugeint * r.f) as score
    from cuts x join counts l on l.lang = x.lang and l.phrase = x.head join counts r on r.lang = x.lang and r.phrase = x.tail
    join totals t on t.lang = x.lang),
least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
kept as (
    select * from least x where not exists (
        select 1 from counts c where c.lang = x.lang and c.k > x.k and contains(' ' || c.phrase || ' ', ' ' || x.phrase || ' ') and c.f >= x.a))
select lang, rank, phrase, a, l, r, n, score::bigint as score from (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
where rank <= 2000
"""
