"""Removal of long strings that occur more than once, by suffix arrays of sampled contexts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, cut_by_bytes, few, new_folder

#: Bytes of a string that counts as repeated, and of the seeds that sample it.
WIDTH, SEED = 200, 32
#: Bytes that one symbol of a suffix array stands for.
CHUNK = 40
#: Contexts of one group that a task sorts at once, at most; larger groups are split by what more of their bytes share.
MOST = 1 << 14
#: Contexts that a task sorts at once where groups are smaller, about.
AT_ONCE = 1 << 12
#: Ranges that a larger group's offsets are split into.
SPLIT = 8
#: Bytes of a text that are sampled at once.
PIECE = 1 << 20
#: Any odd factor, its inverse, and a random number for each byte: the rolling hash.
FACTOR = 0x9E3779B97F4A7C15
BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
ITEMS = "key long, item long, lo int, hi int, left binary, right binary, n long"


def suffix_order(symbols: list[int]) -> list[int]:
    """The starts of all suffixes in ascending order; the last symbol is less than all others and occurs once.

    Linear grouping: suffixes begin in groups by their first symbol. Groups are taken in
    descending order; when a group's turn comes its suffixes share their Lyndon prefix. Each
    is given a pointer to the nearest suffix before it whose group is smaller, and a suffix
    that k pointers meet has a longer prefix now, by k times the group's: it moves to a group
    just above its own, the higher the larger k. Then the order is emitted group by group
    in ascending order: each suffix puts the one before it, and what pointers lead to
    from there, at the front of their groups. No names are given and nothing recurs.
    """
    n = len(symbols)
    codes = np.asarray(symbols)
    by_symbol = np.argsort(codes, kind="stable")
    first = np.r_[True, np.diff(codes[by_symbol]) != 0]
    begin = np.flatnonzero(first)
    order = by_symbol.tolist()
    place = np.argsort(by_symbol).tolist()
    group = np.empty(n, np.int64)
    group[by_symbol] = np.repeat(begin, np.diff(np.r_[begin, n]))
    group = group.tolist()
    size = [0] * n
    for at, many in zip(begin.tolist(), np.diff(np.r_[begin, n]).tolist(), strict=True):
        size[at] = many
    smaller = [-1] * n

    def up(s: int) -> None:
        """Moves s to the end of its group, which no longer counts it."""
        g = group[s]
        size[g] -= 1
        last, now = g + size[g], place[s]
        other = order[last]
        order[now], place[other] = other, now
        order[last], place[s] = s, last

    end = n - 1
    while end >= 0:
        at = group[order[end]]
        members = order[at : end + 1]
        end = at - 1
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > at:
                p = smaller[p]
            smaller[s] = p
        if len(members) == 1:
            p = smaller[members[0]]
            if p >= 0 and size[group[p]] > 1:
                up(p)
                group[p] += size[group[p]]
                size[group[p]] = 1
            continue
        met: dict[int, int] = {}
        for s in members:
            p, chain = smaller[s], []
            while p >= 0 and group[p] == at:
                chain.append(s)
                s, p = p, smaller[p]
            for s in chain:
                smaller[s] = p
            if p >= 0:
                met[p] = met.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, k in met.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            rest: dict[int, int] = {}
            for p in by_count[k]:
                up(p)
                rest[group[p]] = size[group[p]]
            for g in rest:
                size[g + rest[g]] = 0
            for p in by_count[k]:
                group[p] += rest[group[p]]
                size[group[p]] += 1
    free, placed = list(range(n)), [False] * n
    placed[order[0]] = True
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = smaller[j]
    return order


def _best(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each `width` consecutive numbers."""
    span = 1
    while span * 2 <= width:
        x, span = best(x[:-span], x[span:]), span * 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Sampler:
    """Places of a text that any two equal strings of `width` bytes have in common: where a seed's hash is the least of those within such a string."""

    def __init__(self, width: int, seed: int) -> None:
        self.width, self.seed, self.starts = width, seed, width - seed + 1
        most = PIECE + width
        self.up = np.cumprod(np.full(most, FACTOR, np.uint64))
        self.down = np.cumprod(np.full(most, pow(FACTOR, -1, 1 << 64), np.uint64))

    def _piece(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(BYTES[x] * self.up[: len(x)])]
        h = (sums[self.seed :] - sums[: -self.seed]) * self.down[: len(x) - self.seed + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        edge = np.zeros(self.starts - 1, np.uint64)
        least = _best(h, self.starts, np.minimum)
        at = np.flatnonzero(_best(np.concatenate([edge, least, edge]), self.starts, np.maximum) == h)
        return at, h[at]

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places in ascending order, and the hashes of the seeds there."""
        x = np.frombuffer(text, np.uint8)
        if len(x) < self.width:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        found = []
        for at in range(0, len(x) - self.width + 1, PIECE):
            place, h = self._piece(x[at : at + PIECE + self.width - 1])
            found.append((place + at, h))
        place, h = (np.concatenate(y) for y in zip(*found, strict=True))
        place, own = np.unique(place, return_index=True)
        return place, h[own]


def _sample(width: int, seed: int):
    """(_row, tid, h, c, p): a text's seeds, the hash of each one's context, and its place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, reach = Sampler(width, seed), width - seed
        for b in cut_by_bytes(batches, 2, 1 << 22):
            hs, cs, ps, sizes = [], [], [], []
            for text in b.column(2).to_pylist():
                place, h = sampler(text)
                at = place.tolist()
                cs.append(np.array([xxhash.xxh3_64_intdigest(text[max(0, p - reach) : p + width], min(p, reach)) for p in at], np.uint64))
                hs.append(h)
                ps.append(place)
                sizes.append(len(at))
            ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int64))) for x in (hs, cs)]
            lists.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ps).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["_row", "tid", "h", "c", "p"])

    return run


def _ranges(lo: int, hi: int) -> list[tuple[int, int]]:
    """lo to hi in `SPLIT` parts of about one size, or in single offsets."""
    edge = sorted(set(np.linspace(lo, hi + 1, SPLIT + 1).astype(int).tolist()))
    return [(a, b - 1) for a, b in zip(edge, edge[1:], strict=False)]


def split_context(key: int, lo: int, hi: int, left: bytes, right: bytes, width: int) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """A context's parts (key, item, lo, hi, left, right): one for each range of offsets before the seed, with the bytes that its strings can hold.

    All strings of a part hold the least number of bytes on both sides; parts that differ there have different keys.
    """
    for a, b in _ranges(lo, hi):
        if len(left) < a or len(right) < width - b:
            continue
        core = left[len(left) - a :] + right[: width - b]
        x, y = left[max(0, len(left) - b) :], right[: width - a]
        own = xxhash.xxh3_64_intdigest(core, (key + a) & (1 << 64) - 1)
        item = xxhash.xxh3_64_intdigest(x + y, len(x))
        yield _signed(own), _signed(item), a, b, x, y


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _contexts(width: int, seed: int):
    """Items of the drawn occurrences: whole contexts of calm groups, parts of those of large groups, named by h and c."""
    reach = width - seed

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_by_bytes(batches, 0, 1 << 20):
            rows = []
            for text, drawn in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x in drawn:
                    p = x["p"]
                    left, right = text[max(0, p - reach) : p], text[p : p + width]
                    if x["large"]:
                        rows += [(x["h"], x["c"], *part, x["n"]) for part in split_context(x["h"], 0, reach, left, right, width)]
                    else:
                        rows.append((x["h"], x["c"], x["h"], x["c"], 0, reach, left, right, x["n"]))
                    if len(rows) >= 4096:
                        yield _items(rows)
                        rows = []
            if rows:
                yield _items(rows)

    return run


def _items(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    names = ["h", "c", "key", "item", "lo", "hi", "left", "right", "n"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _matrix(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of bytes for each text, filled up with zeros, and their lengths."""
    full = -(-width // CHUNK) * CHUNK
    return np.frombuffer(b"".join(x.ljust(full, b"\0") for x in texts), np.uint8).reshape(len(texts), full), np.array([len(x) for x in texts])


def ordered(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the texts, of `width` bytes at most, and the bytes that each shares with the next.

    They are sorted as suffixes of one string, whose symbols are their chunks in byte order;
    each ends with its length, so that a text comes right before those that only end later.
    """
    rows, lengths = _matrix(texts, width)
    chunks = rows.view(f"S{CHUNK}")
    names = np.unique(chunks.ravel(), return_inverse=True)[1].reshape(chunks.shape)
    each = np.column_stack([names + width + 2, lengths + 1])
    starts = np.array(suffix_order([*each.ravel().tolist(), 0]))
    order = starts[(starts % each.shape[1] == 0) & (starts < each.size)] // each.shape[1]
    a, b = order[:-1], order[1:]
    differ = rows[a] != rows[b]
    shared = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.minimum(shared, np.minimum(lengths[a], lengths[b]))


def _classes(texts: list[bytes], width: int, depths: np.ndarray) -> np.ndarray:
    """For each depth and text a number that those have in common whose first `depth` bytes are equal; -1 for shorter ones."""
    order, shared = ordered(texts, width)
    out = np.empty((len(depths), len(texts)), np.int64)
    out[:, order] = np.c_[np.zeros(len(depths), np.int64), np.cumsum(shared[None] < depths[:, None], axis=1)]
    out[np.array([len(x) for x in texts])[None] < depths[:, None]] = -1
    return out


def repeated_offsets(left: list[bytes], right: list[bytes], n: np.ndarray, width: int, reach: int) -> np.ndarray:
    """For each offset 0 to reach and context, whether the string of `width` bytes that begins so far before its seed occurs again.

    Two orders tell: that of the suffixes from the seeds on, and that of the reversed prefixes
    before them. A string is known by its class in both; a context that occurs n > 1 times repeats all its strings.
    """
    offsets = np.arange(reach + 1)
    after = _classes(right, width, width - offsets)
    before = _classes([x[::-1] for x in left], max(reach, 1), offsets)
    whole = (after >= 0) & (before >= 0)
    both = np.where(whole, before * (len(n) + 1) + after, -1 - np.arange(len(n)))
    by = np.argsort(both, axis=1)
    same = np.diff(np.take_along_axis(both, by, 1), axis=1) == 0
    again = np.zeros(both.shape, bool)
    edge = np.zeros((len(offsets), 1), bool)
    np.put_along_axis(again, by, np.c_[same, edge] | np.c_[edge, same], 1)
    return whole & (again | (n > 1))


def _solve(width: int, seed: int):
    """(key, item, d, e): offsets d to e of an item's strings that occur more than once. A task's rows come by key."""
    reach = width - seed

    def of(rows: list[dict]) -> pa.RecordBatch:
        keys, items, lo, hi, left, right, n = ([r[c] for r in rows] for c in ("key", "item", "lo", "hi", "left", "right", "n"))
        # Groups share no string at the same offset, so several can be sorted as one.
        again = repeated_offsets(left, right, np.array(n), width, reach)
        offsets = np.arange(reach + 1)[:, None]
        again &= (offsets >= np.array(lo)) & (offsets <= np.array(hi))
        step = np.diff(again.astype(np.int8), axis=0, prepend=0, append=0).T
        (who, d), (_, e) = np.nonzero(step == 1), np.nonzero(step == -1)
        out = np.array(keys, np.int64)[who], np.array(items, np.int64)[who], d.astype(np.int32), (e - 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "item", "d", "e"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = [], []
        for row in (r for b in batches for r in b.to_pylist()):
            if held and row["key"] != held[-1]["key"]:
                done, held = done + held, []
                if len(done) >= AT_ONCE:
                    yield of(done)
                    done = []
            held.append(row)
        if done or held:
            yield of(done + held)

    return run


def _kept(df: DataFrame, what: str) -> DataFrame:
    """`df` as a compressed table of the shared folder, which takes less of it than a checkpoint."""
    folder = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _calm_and_large(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items of groups of at most `MOST`, and the others."""
    sizes = items.groupBy("key").agg(F.count("*").alias("_size"))
    large = checkpoint(sizes.where(F.col("_size") > MOST).select("key"))
    return items.join(large, "key", "left_anti"), items.join(large, "key", "left_semi")


def repeated_strings(named: DataFrame, width: int = WIDTH, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(_row, start, end) of strings to remove, not merged, for one row of each text; and (_row, tid, n) of every row of `named` with its number of copies.

    `named` (_row, tid, text) is a table: texts of at least `width` bytes, tid a hash of 128 bits.
    """
    sampled = _kept(named.mapInArrow(_sample(width, seed), "_row long, tid binary, h array<long>, c array<long>, p array<int>"), "samples")
    texts = sampled.groupBy("tid").agg(F.count("*").alias("n"), F.min("_row").alias("own"))
    rows = checkpoint(sampled.select("_row", "tid").join(texts, "tid"))
    own = rows.where(F.col("_row") == F.col("own")).select("_row")
    each = sampled.select("_row", "tid", F.explode(F.arrays_zip("h", "c", "p")).alias("x")).select("_row", "x.*", F.xxhash64("tid", "x.p").alias("u"))
    # A seed in one place alone, whatever the copies of its text, begins no repeated string.
    twice = each.groupBy("h").agg(F.min("u").alias("a"), F.max("u").alias("b")).where("a <> b").select("h")
    twice = checkpoint(twice)  # two plain exchanges then, of which hot ones can be split
    met = _kept(each.drop("u").join(twice, "h").join(own, "_row", "left_semi"), "seeds")
    drawn = met.groupBy("h", "c").agg(F.count("*").alias("n"), F.max(F.struct("_row", "p")).alias("x"))
    drawn = checkpoint(drawn.select("h", "c", "n", "x.*"))
    large = checkpoint(drawn.groupBy("h").agg(F.count("*").alias("_size")).where(F.col("_size") > MOST))
    drawn = drawn.join(few(large), "h", "left").select("_row", F.struct("h", "c", "n", "p", F.col("_size").isNotNull().alias("large")).alias("x"))
    wanted = drawn.groupBy("_row").agg(F.collect_list("x").alias("drawn"))
    items = named.join(wanted, "_row").select("text", "drawn").mapInArrow(_contexts(width, seed), f"h long, c long, {ITEMS}")
    items = _kept(items, "contexts")
    split = (F.col("h") != F.col("key")) | (F.col("c") != F.col("item"))
    found = _solved(items.where(~split), width, seed)
    parts, ways = items.where(split), []
    while True:
        merged = checkpoint(parts.groupBy("key", "item", "lo", "hi", "left", "right").agg(F.sum("n").alias("n")))
        ways.append(parts.select("h", "c", "key", "item"))
        calm, rest = _calm_and_large(merged)
        of = _solved(calm, width, seed)
        for way in reversed(ways):
            of = of.join(way, ["key", "item"]).select(F.col("h").alias("key"), F.col("c").alias("item"), "d", "e")
        found = found.union(of)
        if rest.isEmpty():
            break
        parts = checkpoint(rest.mapInArrow(_split_again(width), f"h long, c long, {ITEMS}"))
    found = found.select(F.col("key").alias("h"), F.col("item").alias("c"), "d", "e")
    spans = met.join(found, ["h", "c"]).select("_row", (F.col("p") - F.col("e")).alias("start"), (F.col("p") - F.col("d") + width).alias("end"))
    return spans, rows.select("_row", "tid", "n")


def _split_again(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["key"], r["item"], *part, r["n"]) for r in b.to_pylist() for part in split_context(r["key"], r["lo"], r["hi"], r["left"], r["right"], width)]
            if rows:
                yield _items(rows)

    return run


def _solved(items: DataFrame, width: int, seed: int) -> DataFrame:
    dealt = items.select("key", "item", "lo", "hi", "left", "right", "n").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_solve(width, seed), "key long, item long, d int, e int")


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's text without its spans, n_removed and n_spans, after _row."""
    for b in cut_by_bytes(batches, 1, 1 << 22):
        kept, removed, runs = [], [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            text, out, at, many = text or b"", [], 0, 0
            for start, end in sorted((x["start"], x["end"]) for x in spans or ()):
                if start > at or not many:
                    out.append(text[at:start])
                    many += 1
                at = max(at, end)
            out.append(text[at:])
            kept.append(b"".join(out))
            removed.append(len(text) - len(kept[-1]))
            runs.append(many)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], ["_row", "kept", "n_removed", "n_spans"])


def dedup_substrings(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, n_bytes, kept, n_removed, n_spans): what stays of each text's bytes after every byte goes that a string of `width` bytes covers which also starts elsewhere.

    Strings are judged on the input, over all rows, the same text included; overlaps
    count, and no string crosses two texts. Each repeated string holds a seed, drawn by
    content, at the same offset in all its places. Occurrences of seeds with equal contexts
    are counted, one of them goes on; a seed's different contexts are sorted by suffix
    arrays (`suffix_order`), on both sides of the seed, and neighbours in these orders tell
    which strings repeat. Groups of over `MOST` contexts are split by the range of
    offsets and by what such strings share, as often as it takes, so that no task
    holds an unbounded group.

    Null and empty texts have 0 bytes and keep none. Texts that are repeated whole, at least
    `width` bytes long, are removed from all rows in one span; shorter ones stay. Rows keep their own
    ids, null and tied ones too. No rows: no rows. `docs` (doc_id, text) is read several times and
    its rows are known by partition and place: give a table or a checkpointed frame. Other columns are not read.
    """
    named = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("text").cast("binary").alias("text"))
    long = named.where(F.octet_length("text") >= width).select("_row", F.unhex(F.md5("text")).alias("tid"), "text")
    spans, rows = repeated_strings(long, width, seed)
    whole = F.when(F.col("n") > 1, F.array(F.struct(F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("end"))))
    gone = spans.groupBy("_row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    gone = rows.join(gone, "_row", "left").select("_row", F.coalesce(whole, "spans").alias("spans")).where("spans is not null")
    joined = named.join(gone, "_row", "left").select(F.struct("_row", "doc_id").alias("_row"), "text", "spans")
    key = docs.schema["doc_id"].dataType.simpleString()
    out = joined.mapInArrow(_cut, f"_row struct<_row:long,doc_id:{key}>, kept binary, n_removed long, n_spans long")
    n_bytes = F.octet_length("kept").cast("long") + F.col("n_removed")
    return out.select("_row.doc_id", n_bytes.alias("n_bytes"), "kept", "n_removed", "n_spans")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, for strings of 200 bytes."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes are two hexadecimal digits each.
OP11_SQL = r"""
with docs as (select row_number() over () as r, doc_id, lower(hex(encode(coalesce(text, '')))) as x from documents),
sizes as (select r, doc_id, x, length(x) // 2 as n from docs),
starts as (select r, unnest(range(n - 199)) as i, x from sizes where n >= 200),
strings as (select r, i, md5_number(substr(x, 2 * i + 1, 400)) as h from starts),
again as (select r, i from (select r, i, count(*) over (partition by h) as k from strings) where k > 1),
edges as (select r, i, case when i > 200 + lag(i) over (partition by r order by i) then 1 else 0 end as fresh from again),
runs as (select r, i, sum(fresh) over (partition by r order by i) as g from edges),
spans as (select r, g, min(i) as a, max(i) + 200 as b from runs group by all),
gaps as (
    select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as since from spans),
kept as (
    select r, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' order by a) as head, max(b) as last, sum(b - a) as gone, count(*) as k
    from gaps join sizes using (r) group by r)
select doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(k, 0)::bigint as n_spans,
    sha256(unhex(coalesce(head || substr(x, 2 * last + 1), x))) as kept_sha256
from sizes left join kept using (r)
"""
