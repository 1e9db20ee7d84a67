"""SimHash near-duplicates: fingerprints, and a binary trie self-join that links them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, cut_by_bytes, few, new_folder
from .components import named_components, roots_of

SEED = 42
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: A walk's trie is dealt out by its top nodes, of about half as many fingerprints each; fuller ones are dealt anew.
BLOCK = 1 << 15
#: Bits by which a full node is dealt anew, at most.
DEEP = 10
#: Pairs of nodes with so few pairs of leaves are compared leaf by leaf.
LEAVES = 16
#: Pairs that are held at a time.
HELD = 1 << 16
#: Words of a fingerprint that stands for a set of shingles.
LANES = 4
#: Words by which texts are compared that do have neighbours: the more bits, the closer to the similarity do they part.
WIDE = 8
#: Shingles that a task holds of a class, about, while other texts are compared with it.
SHINGLES = 1 << 20
#: What it costs to deal a fingerprint out once more, in pairs of leaves compared, about.
COPY = 100
#: Share of the pairs at just the similarity asked for that the walks are to find.
RECALL = 0.997


def shingle_hashes(raw: bytes, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of `shingle` words of a text's UTF-8 bytes; of a shorter text, the whole."""
    words = raw.lower().split()  # bytes: A-Z only; white space is \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    found = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)]
    return np.array(found, dtype="<u8")


def fingerprint(raw: bytes, shingle: int, lanes: int = 1, repeats: bool = True) -> list[int]:
    """64 bits a lane of a text's UTF-8 bytes: a bit is set if it is in over half the shingles' hashes.

    The first lane's hash is XXH64 with seed 42; the others mix that one further. Without
    `repeats` each different shingle counts once.
    """
    hashes = shingle_hashes(raw, shingle)
    return _bits(hashes if repeats else np.unique(hashes), lanes)


def _bits(hashes: np.ndarray, lanes: int) -> list[int]:
    out = []
    for lane in range(lanes):
        own = (_mixed(hashes, lane) if lane else hashes).view(np.uint8).reshape(-1, 8)
        set_in = np.concatenate([np.bincount(own[:, k], minlength=256) @ BITS_OF_BYTE for k in range(8)])
        out.append(int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0]))
    return out


def _mixed(x: np.ndarray, lane: int) -> np.ndarray:
    x = x + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id") -> DataFrame:
    """(key, fp) of each row of `docs`: its bits as a signed long."""
    kind = docs.schema[key].dataType

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x.as_py() or b"", shingle)[0] for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["key", "fp"])

    named = docs.select(F.col(key).alias("key"), "text").mapInArrow(of, f"key {kind.simpleString()}, fp long")
    return named.withColumnRenamed("key", key)


def fingerprints_of_sets(docs: DataFrame, shingle: int, key: str, lanes: int) -> DataFrame:
    """(key, w0, w1 ..., id, text) of each row of `docs`: a lane's bits each without repeats, the hash of its set of shingles."""
    kind = docs.schema[key].dataType
    names = [f"w{k}" for k in range(lanes)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x.as_py() or b"", shingle)) for x in b.column(1).cast(pa.binary())]
            fps = np.array([_bits(x, lanes) for x in sets], np.uint64).reshape(-1, lanes).view(np.int64)
            ids = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(x)) for x in fps.T), pa.array(ids), b.column(1)], ["key", *names, "id", "text"])

    out = docs.select(F.col(key).alias("key"), "text")
    out = out.mapInArrow(of, f"key {kind.simpleString()}, {', '.join(f'{x} long' for x in names)}, id long, text string")
    return out.withColumnRenamed("key", key)


@dataclass(frozen=True)
class Search:
    """Fingerprints of `lanes` words of 64 bits link at `budget` or fewer differing bits.

    Each walk is a trie of its own: `orders` has the bits by which it branches (0 is the highest of the
    first lane), `allowed` how many of these may differ down to each depth. At its end,
    and where few leaves are left, leaves are compared in all bits. With `jaccard` links
    only propose: the exact similarity of the sets of shingles decides.
    """

    lanes: int
    budget: int
    orders: tuple[tuple[int, ...], ...]
    allowed: tuple[tuple[int, ...], ...]
    jaccard: float | None = None

    @classmethod
    def exact(cls, budget: int) -> Search:
        """Misses no link of 64 bits.

        The bits are cut into a ring of budget + 1 bands, and a walk begins at each. Around a ring
        whose bands hold `budget` differing bits in all, some band begins a round in which
        the first band has none, the first two one at most, and so on (the cycle lemma); its
        walk finds the link.
        """
        bands = budget + 1
        edge = [64 * k // bands for k in range(bands + 1)]
        rings = [[(at + k) % bands for k in range(bands)] for at in range(bands)]
        orders = tuple(tuple(bit for k in ring for bit in range(edge[k], edge[k + 1])) for ring in rings)
        allowed = tuple(tuple(n for n, k in enumerate(ring) for _ in range(edge[k], edge[k + 1])) for ring in rings)
        return cls(1, budget, orders, allowed)

    @classmethod
    def of_similarity(cls, jaccard: float, n: int, recall: float = RECALL, lanes: int = LANES) -> Search:
        """For the sets of shingles of `n` texts that are so similar or more.

        The budget is 3.5 deviations above the bits expected to differ at `jaccard`. A walk branches
        by drawn bits until a node is expected to hold one text. None of them may differ where the trie is dealt
        out, and a few further down. There are as many walks as find `recall` of the pairs at
        just `jaccard`, reckoned for drawn bits given how many of all bits differ; of the numbers of
        bits that may differ the one is taken whose walks cost least.
        """
        bits = 64 * lanes
        p, budget = differing(jaccard), budget_of(jaccard, bits)
        depth, none = int(np.clip(np.ceil(np.log2(max(n, 2))) + 1, 8, 60)), top_bits(n)
        total = np.arange(budget + 1)
        chance = np.exp(_log_choose(bits, total) + total * np.log(p) + (bits - total) * np.log(1 - p))
        plans = []
        for errors in range(1, 7):
            allowed = (0,) * none + tuple(1 + k * errors // (depth - none) for k in range(depth - none))
            missed = np.array([1 - survival(allowed, bits, k) for k in total])
            low, walks = 0, 1
            while (chance * missed**walks).sum() > 1 - recall:
                low, walks = walks, 2 * walks
            while walks - low > 1:
                mid = (low + walks) // 2
                low, walks = (mid, walks) if (chance * missed**mid).sum() > 1 - recall else (low, mid)
            plans.append((walks * (COPY + patterns(allowed)), walks, allowed))
        _, walks, allowed = min(plans)
        draw = np.random.default_rng(SEED)
        orders = tuple(tuple(draw.permutation(bits)[:depth].tolist()) for _ in range(walks))
        return cls(lanes, budget, orders, (allowed,) * walks, jaccard)


def differing(jaccard: float) -> float:
    """The share of bits in which two equally large sets of such similarity are expected to differ."""
    return float(np.arccos(2 * jaccard / (1 + jaccard)) / np.pi)


def budget_of(jaccard: float, bits: int) -> int:
    """3.5 deviations above the bits that are expected to differ."""
    p = differing(jaccard)
    return int(bits * p + 3.5 * (bits * p * (1 - p)) ** 0.5)


def top_bits(n: int, block: int = BLOCK) -> int:
    """By how many bits the tries of n fingerprints are dealt out; by none where one node holds them all."""
    return int(np.clip(np.ceil(np.log2(max(n, 1) / block)) + 1, 0, 40)) if n > block else 0


def _log_choose(n: int, k: np.ndarray) -> np.ndarray:
    logs = np.r_[0, np.cumsum(np.log(np.arange(1, n + 1)))]
    return logs[n] - logs[k] - logs[n - k]


def survival(allowed: tuple[int, ...], bits: int, apart: int) -> float:
    """How likely a walk by drawn bits finds two fingerprints that differ in `apart` of `bits`."""
    p = np.zeros(max(allowed) + 2)
    p[0] = 1
    for depth, most in enumerate(allowed):
        q = np.clip((apart - np.arange(len(p))) / (bits - depth), 0, 1)
        p = p * (1 - q) + np.r_[0, (p * q)[:-1]]
        p[most + 1 :] = 0
    return float(p.sum())


def patterns(allowed: tuple[int, ...]) -> int:
    """In how many ways a node can differ from those that a walk pairs it with."""
    ways = [1] + [0] * max(allowed)
    for most in allowed:
        ways = [w + (ways[e - 1] if e else 0) if e <= most else 0 for e, w in enumerate(ways)]
    return sum(ways)


def in_order(words: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    """The bits of each column of `words` (a row a lane) in this order, from the highest bit on."""
    out = np.zeros(words.shape[1], np.uint64)
    for to, bit in enumerate(order):
        out |= ((words[bit // 64] >> np.uint64(63 - bit % 64)) & np.uint64(1)) << np.uint64(63 - to)
    return out


def walk(prefix: np.ndarray, pairs: np.ndarray, depths: np.ndarray, allowed: np.ndarray, visit: Callable, dull: Callable, held: int = HELD) -> int:
    """Traverses pairs of trie nodes together; how many pairs of nodes and leaves it met.

    A node is a range of `prefix`, which is sorted within each starting node. `pairs` has columns
    (begin, end, begin, end, differing bits so far, row of `allowed`), which start at
    `depths`. A pair's children take over its differing bits, plus one where they go apart,
    and are pruned beyond what is allowed at their depth. Pairs of few leaves, or at the last depth,
    go to visit(i, j), place by place. Pairs of which dull(pairs) says that nothing new can
    come are left out. A node's pair with itself comes before it meets others; about `held`
    pairs are worked on at a time.
    """
    met, last = 0, allowed.shape[1]
    ones: dict[int, np.ndarray] = {}
    stack = [(d, pairs[:, depths == d]) for d in np.unique(depths).tolist()]
    while stack:
        depth, p = stack.pop()
        if p.shape[1] > held:
            stack.append((depth, p[:, held:]))
            p = p[:, :held]
        if p.shape[1] > 256:
            p = p[:, ~dull(p)]
        met += p.shape[1]
        size = (p[1] - p[0]) * (p[3] - p[2])
        ends = size <= LEAVES if depth < last else np.ones(len(size), bool)
        for i, j in _leaf_pairs(p[:, ends], held):
            met += len(i)
            visit(i, j)
        p = p[:, ~ends]
        if not p.size:
            continue
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum(prefix >> np.uint64(63 - depth) & np.uint64(1), dtype=np.int32)]
        n = ones[depth]
        lo1, hi1, lo2, hi2, diff, row = p
        mid1, mid2 = hi1 - (n[hi1] - n[lo1]), hi2 - (n[hi2] - n[lo2])
        own = lo1 == lo2
        same = [np.stack([lo1, mid1, lo2, mid2, diff, row]), np.stack([mid1, hi1, mid2, hi2, diff, row])]
        apart = [np.stack([lo1, mid1, mid2, hi2, diff + 1, row]), np.stack([mid1, hi1, lo2, mid2, diff + 1, row])[:, ~own]]
        for children in (apart, same) if p.shape[1] > held // 4 else ([*same, *apart],):
            c = np.concatenate(children, axis=1)
            c = c[:, (c[0] < c[1]) & (c[2] < c[3]) & (c[4] <= allowed[c[5], depth])]
            c = c[:, (c[0] != c[2]) | (c[1] - c[0] > 1)]
            if c.size:
                stack.append((depth + 1, c))
    return met


def _leaf_pairs(p: np.ndarray, held: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places i < j of the leaves of pairs of nodes, about `held` at a time."""
    if not p.size:
        return
    wide = p[3] - p[2]
    step = np.maximum(1, held // wide)
    parts = -(-(p[1] - p[0]) // step)
    of = np.repeat(np.arange(len(wide)), parts)
    lo = p[0][of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * step[of]
    hi, second, wide = np.minimum(lo + step[of], p[1][of]), p[2][of], wide[of]
    size = (hi - lo) * wide
    bins = (np.cumsum(size) - 1) // held
    for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(bins)) + 1):
        s, w = size[part], np.repeat(wide[part], size[part])
        at = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        i, j = np.repeat(lo[part], s) + at // w, np.repeat(second[part], s) + at % w
        yield i[i < j], j[i < j]


class _Block:
    """What a task finds among fingerprints (a column of `words` each) that lie in places of a trie."""

    def __init__(self, words: np.ndarray, ids: np.ndarray, classes: np.ndarray, sizes: np.ndarray, budget: int, sure: int) -> None:
        self.words, self.ids, self.classes, self.sizes, self.budget, self.sure = words, ids, classes, sizes, budget, sure
        self.label = np.unique(classes, return_inverse=True)[1]

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        apart = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in self.words)
        ok = apart <= self.budget
        return i[ok], j[ok], apart[ok]

    def dull(self, p: np.ndarray) -> np.ndarray:
        """Nodes of a single class, the same one."""
        turns = np.r_[0, np.cumsum(self.label[1:] != self.label[:-1])]
        alone = (turns[p[1] - 1] == turns[p[0]]) & (turns[p[3] - 1] == turns[p[2]])
        return alone & (self.label[p[0]] == self.label[p[2]])


class Joined(_Block):
    """Links join at once; the result is a link for each member of a class but one."""

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.label = np.arange(len(self.ids))

    def visit(self, i: np.ndarray, j: np.ndarray) -> None:
        roots_of(*self.near(i, j)[:2], self.label)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.ids[at], self.ids[self.label[at]]


class Nearest(_Block):
    """For each fingerprint the nearest one that it met; once that is near enough to be sure, none is sought any more."""

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.apart, self.who = np.full(len(self.ids), self.budget + 1), np.full(len(self.ids), -1)

    def visit(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j, apart = self.near(i, j)
        x, y, d = np.r_[i, j], np.r_[j, i], np.r_[apart, apart]
        order = np.lexsort((y, d, x))
        x, y, d = x[order], y[order], d[order]
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
        first = first[d[first] < self.apart[x[first]]]
        self.apart[x[first]], self.who[x[first]] = d[first], y[first]

    def dull(self, p: np.ndarray) -> np.ndarray:
        unsure = np.r_[0, np.cumsum(self.apart > self.sure)]
        return (unsure[p[1]] == unsure[p[0]]) & (unsure[p[3]] == unsure[p[2]])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.who >= 0)
        return self.ids[at], self.ids[self.who[at]]


class Apart(_Block):
    """For links between different classes: the id of the end in the smaller class, and the larger class."""

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.met, self.rank = [np.zeros(0, np.int64)], np.empty(len(self.ids), np.int64)
        self.rank[np.lexsort((self.label, self.sizes))] = np.arange(len(self.ids))

    def visit(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j, _ = self.near(i, j)
        other = self.label[i] != self.label[j]
        i, j = i[other], j[other]
        less = self.rank[i] < self.rank[j]
        self.met.append(np.unique(np.where(less, i, j) * len(self.ids) + np.where(less, self.label[j], self.label[i])))
        if sum(map(len, self.met)) > 1 << 20:
            self.met = [np.unique(np.concatenate(self.met))]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        who, label = np.divmod(np.unique(np.concatenate(self.met)), max(1, len(self.ids)))
        return self.ids[who], np.unique(self.classes)[label]


def trie_links(nodes: DataFrame, how: Search, n: int, kind: type[_Block] = Joined, block: int = BLOCK) -> DataFrame:
    """(a, b): what the walks of `how` find among `nodes` (w0, ..., id, class, size), as `kind` tells; n: about the rows.

    Every walk's trie is dealt out by its top nodes, as far down as none of the bits may differ. Of a node with over `block` fingerprints the
    pairs of its descendants, some bits deeper, that may hold links are dealt out instead.
    Each place is then walked in a task, as `walk` tells.
    """
    lanes = how.lanes
    top = min(top_bits(n, block), *(sum(most == 0 for most in x) for x in how.allowed))
    deep = min(DEEP, 60 - top)
    words = [f"w{k}" for k in range(lanes)]
    depth = max(map(len, how.allowed))
    allowed = np.array([[*x, *[x[-1]] * (depth - len(x))] for x in how.allowed], np.int64)
    sure = int(64 * lanes * differing((1 + how.jaccard) / 2)) if how.jaccard else how.budget

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.stack([b.column(k).to_numpy() for k in range(lanes)]).view(np.uint64)
            for r, order in enumerate(how.orders):
                bits = in_order(own, order)
                key = np.uint64(r << top) + (bits >> np.uint64(64 - top) if top else np.uint64(0))
                sub = bits >> np.uint64(64 - top - deep) & np.uint64((1 << deep) - 1)
                key = np.broadcast_to(key, bits.shape)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(sub.astype(np.int64)), *b.columns], ["key", "sub", *b.schema.names])

    columns = ", ".join(f"{x} long" for x in ["key", "sub", *words, "id", "class", "size"])
    each = nodes.select(*words, "id", "class", "size").mapInArrow(spread, columns)
    node = F.lit(0).cast("long")
    if n > block:
        full = each.groupBy("key").count().where(F.col("count") > block)
        full = checkpoint(full.select("key", F.least(F.lit(deep), F.ceil(F.log2(F.col("count") / block)) + 1).cast("int").alias("deep")))
        if full.count():
            most = F.array(*[F.lit(int(allowed[:, min(top + d, depth) - 1].max()) if top + d else 0) for d in range(deep + 1)])
            mine = F.expr(f"shiftrightunsigned(sub, {deep} - deep)")
            others = F.filter(
                F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, deep) - 1")),
                lambda o: F.bit_count(o.bitwiseXOR(mine)) <= F.get(most, F.col("deep")),
            )
            dealt = F.transform(others, lambda o: F.expr("shiftleft(cast(deep as bigint), 32)") + F.least(o, mine) * (1 << 16) + F.greatest(o, mine))
            each = each.join(few(full), "key", "left").withColumn("node", F.explode(F.when(F.col("deep").isNull(), F.array(node)).otherwise(dealt)))
            node = F.col("node")
    each = each.select("key", node.alias("node"), *words, "id", "class", "size").repartition("key", "node").sortWithinPartitions("key", "node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        n = 0
        for b in batches:
            rows.append(np.stack([np.asarray(x) for x in b.columns]))
            n += b.num_rows
            if n >= 4 * BLOCK:
                whole = np.concatenate(rows, axis=1)
                last = (whole[0] == whole[0, -1]) & (whole[1] == whole[1, -1])
                yield from linked(whole[:, ~last])
                rows, n = [whole[:, last]], int(last.sum())
        if rows:
            yield from linked(np.concatenate(rows, axis=1))

    def linked(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not x.shape[1]:
            return
        own, walks = x[2 : 2 + lanes].view(np.uint64), x[0] >> top
        prefix = np.zeros(x.shape[1], np.uint64)
        for r in np.unique(walks).tolist():
            mine = walks == r
            prefix[mine] = in_order(own[:, mine], how.orders[r])
        order = np.lexsort((prefix, x[1], x[0]))
        x, prefix, walks = x[:, order], prefix[order], walks[order]
        lo = np.flatnonzero(np.r_[True, (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])])
        hi = np.r_[lo[1:], x.shape[1]]
        down, first, second = x[1, lo] >> 32, x[1, lo] >> 16 & 0xFFFF, x[1, lo] & 0xFFFF
        bits = (prefix >> np.uint64(64 - top - deep) & np.uint64((1 << deep) - 1)).astype(np.int64)
        below = np.r_[0, np.cumsum(bits >> (deep - np.repeat(down, hi - lo)) == np.repeat(first, hi - lo))]
        mid = np.where(first == second, hi, lo + below[hi] - below[lo])
        pairs = np.stack([lo, mid, np.where(first == second, lo, mid), hi, np.bitwise_count(first ^ second).astype(np.int64), walks[lo]])
        some = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & ((first != second) | (hi - lo > 1))
        found = kind(x[2 : 2 + lanes].view(np.uint64), *x[2 + lanes :], how.budget, sure)
        walk(prefix, pairs[:, some], (top + down)[some], allowed, found.visit, found.dull)
        yield pa.RecordBatch.from_arrays([pa.array(y) for y in found.result()], ["a", "b"])

    return each.mapInArrow(join, "a long, b long").distinct()


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, s): the sorted hashes of the different shingles of `texts` (id, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_by_bytes(batches, 1, 1 << 22):
            sets = [np.unique(shingle_hashes(x.as_py() or b"", shingle)).view(np.int64) for x in b.column(1).cast(pa.binary())]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in sets])], pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "s"])

    return texts.select("id", "text").mapInArrow(of, "id long, s array<long>")


def fingerprints_of(sets: DataFrame, lanes: int) -> DataFrame:
    """(id, w0, w1 ...) of `sets` (id, s)."""
    names = [f"w{k}" for k in range(lanes)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edge, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy().view(np.uint64)
            fps = np.array([_bits(flat[x:y], lanes) for x, y in zip(edge[:-1], edge[1:], strict=True)], np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(x)) for x in fps.T)], ["id", *names])

    return sets.select("id", "s").mapInArrow(of, f"id long, {', '.join(f'{x} long' for x in names)}")


def verified(queries: DataFrame, members: DataFrame, sets: DataFrame, jaccard: float, held: int = SHINGLES) -> DataFrame:
    """(a, b): for each of `queries` (q, t) a member of class t, of `members` (t, id), whose set is so similar or more, if there is one.

    `sets` has (id, s) of all these. A class is dealt out in parts of about `held` shingles and
    its queries to all of them; each part may give a member. A task holds the sets of
    a part and compares each query with all of them at once, so no pairs are rows.
    """
    members = members.join(sets, "id")
    parts = members.groupBy("t").agg(F.ceil(F.sum(F.size("s")) / held).cast("int").alias("parts"))
    parts = few(checkpoint(parts.withColumn("parts", F.greatest("parts", F.lit(1)))))
    lying = members.join(parts, "t").select("t", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "s")
    asked = queries.join(parts, "t").select("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), F.col("q").alias("id"))
    asked = asked.join(sets, "id").select("t", "part", "side", "id", "s")
    dealt = lying.union(asked).repartition("t", "part").sortWithinPartitions("t", "part", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, index = None, [], [], None
        for b in batches:
            edge, flat = b.column(4).offsets.to_numpy(), b.column(4).values.to_numpy()
            rows, out = zip(*(b.column(k).to_numpy().tolist() for k in range(4)), strict=True), ([], [])
            for k, (t, part, side, one) in enumerate(rows):
                own = flat[edge[k] : edge[k + 1]]
                if now != (t, part):
                    now, ids, sets, index = (t, part), [], [], None
                if not side:
                    ids.append(one)
                    sets.append(own.copy())
                    continue
                if index is None:
                    sizes = np.array([len(x) for x in sets], np.int64)
                    tokens = np.concatenate([*sets, np.zeros(0, np.int64)])
                    order = np.argsort(tokens, kind="stable")
                    index = tokens[order], np.repeat(np.arange(len(ids)), sizes)[order], sizes
                tokens, of, sizes = index
                lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(of[at], minlength=len(ids))
                share = np.where(common > 0, common / np.maximum(1, sizes + len(own) - common), 0)
                share[[x for x, other in enumerate(ids) if other == one] if len(ids) < 3 else np.flatnonzero(np.array(ids) == one)] = 0
                if len(ids) and share.max() >= jaccard - 1e-12:
                    out[0].append(one)
                    out[1].append(ids[int(share.argmax())])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return dealt.mapInArrow(meet, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 5, jaccard: float = 0.8, how: Search | None = None, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """key, fp (signed long, the first lane's bits) and component_id of each row of `docs`.

    Without `how`, documents link whose sets of shingles have a similarity of `jaccard` or more,
    exactly verified, among the pairs that `Search.of_similarity` proposes; each different
    shingle counts once. With `how` fingerprints link as it says. component_id is the
    least key among the documents that links reach, the row's own included (null where all
    are null). Null, empty and blank texts have fingerprint 0; they link like any other by
    fingerprints, and with each other alone by sets. Equal rows and equal keys are rows of their own; long texts are hashed
    whole; other columns are not read. No rows: no rows.

    Equal fingerprints, or equal sets, count once from the start, so a group of copies is one
    node; all that is joined afterwards has one row for each on the other side.
    """
    if how is None:
        return _groups_of_sets(docs, shingle, jaccard, key, block)
    each = checkpoint(fingerprints(docs, shingle, key))
    nodes = checkpoint(each.groupBy("fp").agg(F.min(key).alias("least")).selectExpr("fp as id", "fp as w0", "fp as class", "1L as size", "least"))
    links = checkpoint(trie_links(nodes, how, nodes.count(), block=block))
    named = named_components(nodes, links).select(F.col("id").alias("fp"), "component_id")
    return each.join(named, "fp").select(key, "fp", "component_id")


def _groups_of_sets(docs: DataFrame, shingle: int, jaccard: float, key: str, block: int) -> DataFrame:
    """Proposed links are verified in two rounds, so that no group is expanded into all its pairs.

    The first takes for each text the nearest one that each walk meets, and joins what is verified. The
    second is given the texts that met any, with wider fingerprints: each that a link may join with a larger class than its own is compared with that class.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "fingerprints")
    words = [f"w{k}" for k in range(LANES)]
    fingerprints_of_sets(docs, shingle, key, LANES).withColumn("_n", F.monotonically_increasing_id()).write.parquet(folder)
    each = spark.read.parquet(folder)
    nodes = checkpoint(each.groupBy("id").agg(F.min(key).alias("least"), F.min("_n").alias("_n"), *[F.min(x).alias(x) for x in words]))
    n = nodes.count()
    how = Search.of_similarity(jaccard, n)

    def sets(ids: DataFrame) -> DataFrame:
        rows = checkpoint(nodes.join(few(checkpoint(ids.distinct())), "id").select("id", "_n"))
        return checkpoint(sets_of(each.select("_n", "text").join(few(rows), "_n"), shingle))

    pairs = checkpoint(trie_links(nodes.withColumn("class", F.col("id")).withColumn("size", F.lit(1).cast("long")), how, n, Nearest, block))
    pairs = pairs.select(F.greatest("a", "b").alias("q"), F.least("a", "b").alias("t")).distinct()
    met = checkpoint(pairs.select(F.col("q").alias("id")).union(pairs.select(F.col("t").alias("id"))).distinct())
    own = sets(met)
    links = checkpoint(verified(pairs, met.select(F.col("id").alias("t"), "id"), own, jaccard))
    how = replace(how, lanes=WIDE, budget=budget_of(jaccard, 64 * WIDE))
    joined = checkpoint(fingerprints_of(own, WIDE).join(named_components(nodes, links).select("id", "class"), "id"))
    joined = joined.join(few(checkpoint(joined.groupBy("class").agg(F.count("*").alias("size")))), "class")
    pairs = checkpoint(trie_links(joined, how, n, Apart, block).toDF("q", "t"))
    members = joined.join(few(checkpoint(pairs.select(F.col("t").alias("class")).distinct())), "class", "left_semi").select(F.col("class").alias("t"), "id")
    links = links.union(checkpoint(verified(pairs, members, own, jaccard)))
    named = named_components(nodes, links).drop("class")
    return each.select(key, F.col("w0").alias("fp"), "id").join(named, "id").select(key, "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`: doc_id, fingerprint (16 hex digits), component_id; 4-word shingles, 4 bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash_groups(docs, shingle=4, how=Search.exact(4))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
