"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_by_bytes

SIMILARITY = 0.8
SAMPLED = 3
#: Share of an item's occurrences with as many edits as are allowed that its repeats are to find, by simulation of TRIALS of them.
RECALL, TRIALS = 0.99, 400
#: Items whose length asks for more repeats are verified wherever enough of their rare words stand, which misses none.
MOST_REPEATS = 64
SEED = 42
#: Characters of items that one pass over the documents looks for.
BLOCK_CHARS = 4_000_000
#: Bytes of texts that are searched together, about.
AT_ONCE = 1 << 23

WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


def embed(symbols: np.ndarray, places: np.ndarray, seed: int = SEED) -> np.ndarray:
    """CGK: for each repeat and each row of symbols (0 beyond its end), what its walk meets at places[repeat].

    At each step a walk writes the symbol it stands on and moves on if the random bit of
    (repeat, step, symbol) is set. Rows within a small edit distance meet the same symbol
    at most steps, as walks that fell apart come together again. Only the steps up to the last
    place are walked.
    """
    (n, wide), (repeats, sampled) = symbols.shape, places.shape
    flat = np.concatenate([symbols, np.zeros((n, 1), symbols.dtype)], axis=1).astype(np.uint64).ravel()
    row, at = np.arange(n) * (wide + 1), np.zeros((repeats, n), np.int64)
    salt = ((np.arange(repeats, dtype=np.uint64) + np.uint64(seed)) * np.uint64(1_000_003))[:, None]
    out = np.zeros((repeats, n, sampled), np.uint64)
    for j in range(int(places.max(initial=-1)) + 1):
        met = flat[row + at]
        r, k = np.nonzero(places == j)
        out[r, :, k] = met[r]
        mixed = (met + (salt + np.uint64(j))) * _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.minimum(at + (mixed >> np.uint64(63)).astype(np.int64), wide)
    return out


def edit_span(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """The least edits that turn `item` into a run of `text`, and that run's start and end."""
    best = [(0, -k) for k in range(len(text) + 1)]  # edits, minus the start
    for i, a in enumerate(item, 1):
        line = [(i, best[0][1])]
        for j, b in enumerate(text, 1):
            (e, p), (f, q), (g, r) = best[j - 1], best[j], line[j - 1]
            line.append(min((e + (a != b), p), (f + 1, q), (g + 1, r)))
        best = line
    end = min(range(len(best)), key=best.__getitem__)
    return best[end][0], -best[end][1], end


def best_end(item: list[int], text: list[int]) -> tuple[int, int]:
    """The least edits that turn `item` into a run of `text`, and the first such run's end (bits in parallel)."""
    bits: dict[int, int] = {}
    for i, a in enumerate(item):
        bits[a] = bits.get(a, 0) | 1 << i
    full, last = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, edits = full, 0, len(item)
    best = (edits, 0)
    for j, b in enumerate(text, 1):
        eq = bits.get(b, 0)
        x, h = eq | down, (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(h | up)), up & h
        edits += 1 if more & last else -1 if less & last else 0
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (full & ~(x | more)), more & x
        if edits < best[0]:
            best = (edits, j)
    return best


def sampled_steps(size: int, repeats: int) -> np.ndarray:
    """The steps of each repeat's walk whose symbols make its key."""
    steps = 2 * size
    return np.stack([np.random.default_rng((SEED, r, size)).choice(steps, min(SAMPLED, steps), replace=False) for r in range(repeats)])


def edited(item: np.ndarray, edits: int, draw: np.random.Generator) -> np.ndarray:
    """`item` after so many replacements, insertions and deletions at drawn places, each by a symbol of its own."""
    out = item.tolist()
    for k in range(edits):
        kind, at, new = draw.integers(3), int(draw.integers(len(out) + 1)), 10**9 + int(draw.integers(10**9))
        if kind == 0 or not out:
            out.insert(at, new)
        elif kind == 1:
            out[min(at, len(out) - 1)] = new
        else:
            del out[min(at, len(out) - 1)]
    return np.array(out, np.int64)


@lru_cache(maxsize=4096)
def repeats_for(size: int, edits: int, recall: float = RECALL, trials: int = TRIALS) -> int | None:
    """How many repeats find that share of items of `size` words after `edits` edits, by simulation; None if over MOST_REPEATS."""
    draw = np.random.default_rng((SEED, size, edits))
    items = draw.integers(1, 10**9, (trials, size))
    windows = np.zeros((trials, size), np.int64)
    for k, item in enumerate(items):
        own = edited(item, edits, draw)[:size]
        windows[k, : len(own)] = own
    found = np.zeros(trials, bool)
    own, other = (embed(x, sampled_steps(size, MOST_REPEATS)) for x in (items, windows))
    for r, same in enumerate((own == other).all(2), 1):
        found |= same
        if found.mean() >= recall:
            return r
    return None


@dataclass
class Index:
    """Items by the sampled places of their embeddings, for windows of each item length; those that no number of repeats finds by their rare words."""

    similarity: float
    item_ids: list
    vocabulary: dict[str, int] = field(default_factory=dict)
    items: list[list[int]] = field(default_factory=list)
    tables: dict[int, dict[tuple, list[int]]] = field(default_factory=dict)

    @classmethod
    def build(cls, rows: list[tuple], similarity: float) -> Index:
        own = cls(similarity, [r[0] for r in rows])
        own.items = [[own.vocabulary.setdefault(w, len(own.vocabulary) + 1) for w in words(t)] for _, t in rows]
        own.sizes = np.array([len(x) for x in own.items], np.int64)
        own.allowed = (own.sizes * (1 - similarity) + 1e-9).astype(np.int64)
        own.repeats = {x: repeats_for(x, int(x * (1 - similarity) + 1e-9)) for x in set(own.sizes.tolist()) if x}
        own.walked = np.array([bool(x and own.repeats[x]) for x in own.sizes.tolist()], bool)
        for size in sorted(x for x, r in own.repeats.items() if r):
            same = np.flatnonzero(own.sizes == size).tolist()
            table = own.tables.setdefault(size, {})
            for r, keys in enumerate(own.keys(np.array([own.items[k] for k in same]), size)):
                for k, key in zip(same, keys, strict=True):
                    table.setdefault((r, key), []).append(k)
        own._choose_anchors()
        return own

    def _choose_anchors(self) -> None:
        """Of each item its rarest words, and how many of these a match must hold.

        A run within the allowed edits of an item lacks so many of its words at most; of any
        `allowed` + m of them it holds m.
        """
        spread = Counter(w for x in self.items for w in set(x))
        spelt = {k: w for w, k in self.vocabulary.items()}
        self.needed = np.maximum(1, self.sizes // 4)
        pairs = set()
        for k, x in enumerate(self.items):
            rare = sorted(x, key=lambda w: (spread[w], -len(spelt[w]), w))[: int(self.allowed[k] + self.needed[k])]
            pairs.update((w, k) for w in rare)
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.anchor_items = table[:, 1]
        self.anchor_edges = np.searchsorted(table[:, 0], np.arange(len(self.vocabulary) + 2))

    def keys(self, windows: np.ndarray, size: int) -> Iterator[list[bytes]]:
        """For each repeat, a key of each window: the symbols at the sampled steps of its walk."""
        for got in embed(windows, sampled_steps(size, self.repeats[size])):
            yield [x.tobytes() for x in got]

    def _starts(self, symbols: np.ndarray, text_of: np.ndarray) -> tuple[dict[int, np.ndarray], list[tuple[int, int, int, int]]]:
        """For each item length, where windows can start that hold enough of one such item's rare words.

        This leaves out no match: it bounds what any run within the allowed edits must hold. Of
        items that are not walked: (text, item, begin, end) of the places that such runs lie in.
        """
        at = np.flatnonzero(symbols)
        lo, hi = self.anchor_edges[symbols[at]], self.anchor_edges[symbols[at] + 1]
        n = hi - lo
        place = np.repeat(at, n)
        item = self.anchor_items[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        order = np.argsort(item * len(symbols) + place)
        place, item = place[order], item[order]
        last = np.arange(len(item)) + self.needed[item] - 1
        ok = np.flatnonzero(last < len(item))
        first, last = ok, last[ok]
        width = (self.sizes + self.allowed)[item[first]]
        near = (item[last] == item[first]) & (place[last] - place[first] < width)
        first, last, width = first[near], last[near], width[near]
        sizes = self.sizes[item[first]]
        walked = self.walked[item[first]]
        far = np.flatnonzero(~walked)
        which, begin, end = item[first[far]], np.maximum(place[last[far]] - width[far] + 1, 0), place[first[far]] + width[far]
        text = np.searchsorted(text_of, place[first[far]], "right") - 1
        new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (text[1:] != text[:-1]) | (begin[1:] > end[:-1])][: len(far)])
        ends = np.r_[new[1:], len(far)][: len(new)] - 1
        places = list(zip(text[new].tolist(), which[new].tolist(), begin[new].tolist(), end[ends].tolist(), strict=True))
        first, last, width, sizes = (x[walked] for x in (first, last, width, sizes))
        out = {}
        for size in np.unique(sizes).tolist():
            mine = sizes == size
            begin, end = np.maximum(place[last[mine]] - width[mine] + 1, 0), place[first[mine]] + 1
            n = end - begin
            out[size] = np.unique(np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return out, places

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, words) of each item that occurs in each whole text."""
        gap = int((self.sizes + self.allowed).max(initial=0)) + 1
        get = self.vocabulary.get
        parts, starts, total = [], [], 0
        for text in texts:
            found = words(text)
            starts.append(total)
            parts += [np.fromiter(map(get, found, repeat(0)), np.int64, len(found)), np.full(gap, -1)]
            total += len(found) + gap
        symbols = np.concatenate([*parts, np.full(gap, -1)])
        text_of = np.array(starts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        begins_of, places = self._starts(np.maximum(symbols, 0), text_of)

        def verify(n: int, k: int, lo: int, hi: int) -> None:
            """The best place of item k in a run of text n: by bits in parallel, then cell by cell near its end alone."""
            item, most = self.items[k], int(self.allowed[k])
            run = symbols[lo:hi].tolist()
            edits, end = best_end(item, run)
            if edits <= most and edits < best.get((n, k), (most + 1,))[0]:
                cut = max(0, end - len(item) - most)
                _, a, b = edit_span(item, run[cut:end])
                best[n, k] = (edits, lo + cut + a - starts[n], b - a)

        for n, k, lo, hi in places:
            verify(n, k, max(lo, starts[n]), min(hi, starts[n + 1] - gap if n + 1 < len(starts) else total - gap))
        for size, begins in begins_of.items():
            hits: dict[tuple[int, int], list[int]] = {}
            for lo in range(0, len(begins), 2_000):
                own = begins[lo : lo + 2_000]
                windows = symbols[own[:, None] + np.arange(size)]
                seen: set[tuple[int, int]] = set()
                for r, keys in enumerate(self.keys(np.where(windows < 0, 0, windows), size)):
                    seen.update((k, s) for s, key in enumerate(keys) for k in self.tables[size].get((r, key), ()))
                for k, s in sorted(seen):
                    at = int(own[s])
                    n = int(np.searchsorted(text_of, at, "right")) - 1
                    hits.setdefault((max(n, 0), k), []).append(at)
            for (n, k), at in hits.items():
                item, most = self.items[k], int(self.allowed[k])
                same = next((s for s in at if symbols[s : s + size].tolist() == item), None)
                if same is not None:
                    best[n, k] = (0, same - starts[n], size)
                    continue
                edge, runs = starts[n + 1] - gap if n + 1 < len(starts) else total - gap, []
                for s in at:
                    lo, hi = max(starts[n], s - most), min(edge, s + size + most)
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = hi
                    else:
                        runs.append([lo, hi])
                for lo, hi in runs:
                    verify(n, k, lo, hi)
        return [(n, k, *best[n, k]) for n, k in sorted(best)]


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The items, in the order of their ids, in blocks of bounded size."""
    block, held = [], 0
    for row in items.toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if held >= most:
            yield block
            block, held = [], 0
    yield block


def _wanted(benchmark: DataFrame, item: str) -> DataFrame:
    return benchmark.where(F.col("text").isNotNull()).select(item, "text").distinct().orderBy(item, "text")


def contaminations(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", item: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, item, edits, item_words, first_word, n_words: each document's best place of each item in it.

    An item occurs where a run of a document's words is within (1 - similarity) * item_words
    edits of it, a word each; words are runs of letters and digits in lower case. Candidates
    share the sampled steps of an embedding of an item-sized window in one of its repeats, as
    many as find RECALL of the occurrences with all edits that are allowed, by simulation
    for each length; equal ones are found always. Where a length asks for over MOST_REPEATS, candidates are all
    places that hold enough of an item's rare words, which misses none. All candidates are
    verified exactly. Other columns are not read.
    Null and empty texts hold nothing, and items without a word occur nowhere. Equal
    items are found each; equal documents too. No rows on either side: no rows.

    The items are broadcast in blocks of bounded size, each with a pass over the documents.
    """
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    spark = docs.sparkSession

    def search(rows: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index.build(rows, similarity))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            item_kind = pa.array(index.item_ids).type
            for b in cut_by_bytes(batches, 1, AT_ONCE):
                got = index.search([t or "" for t in b.column(1).to_pylist()])
                numbers = [pa.array([g[k] for g in got], pa.int32()) for k in (2, 3, 4)]
                size = pa.array([len(index.items[g[1]]) for g in got], pa.int32())
                ids = pa.array([index.item_ids[g[1]] for g in got], item_kind)
                of = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), ids, numbers[0], size, *numbers[1:]], ["key", "item", "edits", "item_words", "first_word", "n_words"])

        return docs.select(key, "text").mapInArrow(run, f"key {kinds[0]}, item {kinds[1]}, edits int, item_words int, first_word int, n_words int")

    found = reduce(DataFrame.union, [search(rows) for rows in _blocks(_wanted(benchmark, item), block_chars)])
    return found.withColumnRenamed("key", key).withColumnRenamed("item", item)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, item: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs` that hold no item of `benchmark`, as `contaminations` tells; rows stay where they are."""
    names, at = docs.columns, docs.columns.index("text")

    def without(docs: DataFrame, rows: list[tuple]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(Index.build(rows, similarity))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in cut_by_bytes(batches, at, AT_ONCE):
                keep = np.ones(b.num_rows, bool)
                keep[[hit[0] for hit in shared.value.search([t or "" for t in b.column(at).to_pylist()])]] = False
                yield b.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    return reduce(without, _blocks(_wanted(benchmark, item), block_chars), docs.select(*names))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` against every item of `benchmark`: a row for each item that a document holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
