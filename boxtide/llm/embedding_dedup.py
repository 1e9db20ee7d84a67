"""Near-duplicate embeddings by an inverted multi-index and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, few
from .components import named_components, roots_of

THRESHOLD = 0.9
#: Vectors that the codebooks are fitted on, about, and queries that measure recall.
SAMPLE, QUERIES = 20_000, 1024
#: Share of the drawn queries' true links that is to be found, and of the pairs at just the threshold that are made for measuring.
RECALL, WORST = 0.995, 0.95
#: Nearest cells that are ranked at first; twice as many each time that they don't reach the recall.
CELLS = 64
#: Vectors of a cell, and probes of it, that meet in one place at most, about.
BLOCK = 4096
HASHES = ["_a", "_b"]


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centres of k classes of the rows of x, or of fewer where rows are few."""
    draw = np.random.default_rng(seed)
    centres = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        size = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, x[:, d], len(centres)) for d in range(x.shape[1])], axis=1)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[draw.integers(len(x), size=len(centres))])
    return centres


class MultiIndex:
    """Two codebooks, for the halves of unit vectors; their product is a grid of cells."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.books = first, second

    @property
    def dims(self) -> int:
        return self.books[0].shape[1] + self.books[1].shape[1]

    def distances(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.books[0].shape[1]
        halves = u[:, :cut], u[:, cut:]
        return tuple((h**2).sum(1)[:, None] + (c**2).sum(1) - 2 * h @ c.T for h, c in zip(halves, self.books, strict=True))

    def nearest(self, u: np.ndarray, cells: int) -> np.ndarray:
        """For each row, its nearest cells in ascending distance; cell = i * len(second) + j.

        The multi-sequence: with both codebooks sorted by distance, the cell (i, j) can be among
        the `cells` nearest only if (i + 1) * (j + 1) <= cells; those are ordered by the
        sum of their two distances.
        """
        a, b = self.distances(u)
        cells = min(cells, a.shape[1] * b.shape[1])
        oa, ob = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        i, j = np.array([(i, j) for i in range(min(cells, a.shape[1])) for j in range(min(cells // (i + 1), b.shape[1]))]).T
        sums = np.take_along_axis(a, oa, 1)[:, i] + np.take_along_axis(b, ob, 1)[:, j]
        order = sums.argsort(1, kind="stable")[:, :cells]
        return np.take_along_axis(oa, i[order], 1) * b.shape[1] + np.take_along_axis(ob, j[order], 1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors, in double precision, of vectors as bytes of floats or doubles."""
    raw = b"".join(x.as_py() for x in column)
    x = np.frombuffer(raw, "<f8" if len(raw) == 8 * dims * len(column) else "<f4").astype(float).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distinct_vectors(vectors: DataFrame, key: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(all keys, the distinct `_v` with id, copies, least key and number of dimensions d).

    `_v` holds the components as doubles. It is missing where the vector links with nothing:
    it is null, empty or zero, or holds a null or non-finite component. Both relations
    have 128 bits of hash of `_v`, null where it is missing, by which they are joined
    later; so the vectors themselves are shuffled no more.
    """
    x = F.col(embedding).cast("array<double>")
    fine = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(key).alias("_key"), F.when(fine, F.transform(x, lambda c: c + 0.0)).alias("_v"))
    hashes = [F.when(F.col("_v").isNotNull(), F.xxhash64(F.lit(k), "_v")).alias(h) for k, h in enumerate(HASHES)]
    once = rows.where("_v is not null").groupBy("_v").agg(F.count("*").alias("copies"), F.min("_key").alias("least"))
    once = once.select("*", *hashes, F.size("_v").alias("d"), F.monotonically_increasing_id().alias("id"))
    return rows.select("_key", *hashes), checkpoint(once)


def _packed(once: DataFrame, dims: int, wide: bool) -> DataFrame:
    """(id, copies, u): vectors as bytes of doubles if `wide`, else of floats, as they came."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(-1, dims).astype("<f8" if wide else "<f4")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "copies", "u"])

    return once.select("id", "copies", "_v").mapInArrow(pack, "id long, copies long, u binary")


def fit(units: DataFrame, n: int, dims: int) -> MultiIndex:
    """Codebooks fitted on about SAMPLE vectors drawn by the hash of their id.

    Their size follows the fourth root of n, so that a cell of the grid holds about sqrt(n)
    vectors at most times a constant.
    """
    k = int(np.clip(round(2 * n**0.25), 2, 1024))
    rows = units.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 40)) < min(1.0, SAMPLE / max(n, 1)) * (1 << 40)).select("id", "u").toArrow()
    order = np.argsort(rows.column(0).to_numpy())
    x = _matrix(rows.column(1), dims)[order] if len(order) else np.eye(1, dims)
    cut = (dims + 1) // 2
    return MultiIndex(k_means(x[:, :cut], k), k_means(x[:, cut:], k, seed=1))


def made_pairs(q: np.ndarray, threshold: float, seed: int = 0) -> np.ndarray:
    """For each unit vector another one at just the threshold, in a drawn direction."""
    r = np.random.default_rng(seed).normal(size=q.shape)
    r -= (r * q).sum(1, keepdims=True) * q
    r /= np.maximum(1e-300, np.sqrt((r * r).sum(1, keepdims=True)))
    return threshold * q + np.sqrt(max(0.0, 1 - threshold**2)) * r


def _ranks(index: MultiIndex, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """For pairs of rows, at which of its nearest cells either meets the other's own; `most` if at none of them."""
    out = np.full(len(x), most)
    for at in range(0, len(x), 2048):
        near = [index.nearest(z[at : at + 2048], most) for z in (x, y)]
        for one, other in (near, near[::-1]):
            hit = one == other[:, :1]
            out[at : at + 2048] = np.minimum(out[at : at + 2048], np.where(hit.any(1), hit.argmax(1), most))
    return out


def cells_for_recall(units: DataFrame, n: int, dims: int, index: MultiIndex, threshold: float, recall: float = RECALL, worst: float = WORST, cells: int = CELLS) -> tuple[int, float, float]:
    """How many nearest cells a probe visits, and the shares of true links and of made pairs that are then found.

    About QUERIES vectors, drawn by hash, are compared with all vectors: for each true link the
    rank at which either end meets the other's cell is counted; counts by rank reach the driver, not
    links. As links may be few, each query also gets partners made at just the threshold,
    where links are hardest to find. Both shares are to be reached; if the nearest
    `cells` do not, twice as many are ranked, until they do or all cells are: nothing is missed then.
    """
    drawn = units.where(F.pmod(F.xxhash64("id", F.lit("ask")), F.lit(1 << 40)) < min(1.0, QUERIES / max(n, 1)) * (1 << 40)).select("id", "u").toArrow()
    ids = drawn.column(0).to_numpy()
    every = len(index.books[0]) * len(index.books[1])
    if not len(ids):
        return every, 1.0, 1.0
    q = _matrix(drawn.column(1), dims)
    made = np.concatenate([q] * -(-QUERIES // len(q)))[: max(QUERIES, len(q))]
    partners = made_pairs(made, threshold) if dims > 1 else made
    while True:
        most = min(cells, every)
        shared = units.sparkSession.sparkContext.broadcast((ids, q, index))

        def ranks(batches: Iterator[pa.RecordBatch], most: int = most, shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, index = shared.value
            total = np.zeros(most + 1, np.int64)
            for b in batches:
                u = _matrix(b.column(2), dims)
                i, j = np.nonzero((q @ u.T >= threshold) & (ids[:, None] != b.column(0).to_numpy()))
                total += np.bincount(_ranks(index, q[i], u[j], most), minlength=most + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(most + 1)), pa.array(total)], ["rank", "n"])

        true = np.zeros(most + 1, np.int64)
        for rank, k in units.mapInArrow(ranks, "rank long, n long").groupBy("rank").agg(F.sum("n")).collect():
            true[rank] = k
        shares = []
        for counts, aim in ((true, recall), (np.bincount(_ranks(index, made, partners, most), minlength=most + 1), worst)):
            share = np.cumsum(counts[:most]) / max(1, counts.sum()) if counts.sum() else np.ones(most)
            shares.append((share, int(np.searchsorted(share, aim - 1e-12)) + 1))
        shared.destroy()
        need = max(k for _, k in shares)
        if need <= most or most == every:
            need = min(need, most)
            return need, float(shares[0][0][need - 1]), float(shares[1][0][need - 1])
        cells = 2 * most


def links(units: DataFrame, dims: int, index: MultiIndex, cells: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, more, other): what to add to the id's number of links, and a link that joins its class.

    Each vector lies in its nearest cell and probes its `cells` nearest. A link is found if
    either end probes the other's cell; where only one does, it is counted for both. Within a
    place only links that join classes are returned, one a vector at most. A cell of
    more than `block` vectors or probes is spread: its vectors over several places by
    hash, its probes over several slots of each.
    """
    shared = units.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = shared.value.nearest(_matrix(b.column(2), dims), cells).astype(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["id", "copies", "u", "near"])

    each = checkpoint(units.mapInArrow(assign, "id long, copies long, u binary, near array<long>"))
    probes = each.select(F.explode("near").alias("cell")).groupBy("cell").agg(F.count("*").alias("p"))
    homes = each.groupBy(F.get("near", F.lit(0)).alias("cell")).agg(F.count("*").alias("h"))
    grid = probes.join(homes, "cell").select(
        "cell", F.ceil(F.col("h") / block).cast("int").alias("_h"), F.ceil(F.col("p") / (4 * block)).cast("int").alias("_p")
    )
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")
    grid = F.broadcast(checkpoint(grid))  # a row for each cell that holds a vector: 2^20 at most, by the codebooks' size
    home = each.withColumn("cell", F.get("near", F.lit(0))).join(grid, "cell")
    home = home.select("cell", (hashed % F.col("_h")).alias("place"), F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("slot"), F.lit(0).alias("side"), "id", "copies", "u", "near")
    probe = each.withColumn("cell", F.explode("near")).join(grid, "cell")
    probe = probe.select("cell", F.explode(F.sequence(F.lit(0), F.col("_h") - 1)).alias("place"), (hashed % F.col("_p")).alias("slot"), F.lit(1).alias("side"), "id", "copies", "u", F.array(F.get("near", F.lit(0))).alias("near"))
    where = ["cell", "place", "slot"]
    dealt = home.union(probe).repartition(*where).sortWithinPartitions(*where, "side", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lying = None, []
        for b in batches:
            place = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
            edge = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1), True])
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if now != tuple(place[lo]):
                    now, lying = tuple(place[lo]), []
                run = b.slice(lo, hi - lo)
                n_home = int((run.column(3).to_numpy() == 0).sum())
                if n_home:
                    lying.append(run.slice(0, n_home))
                if n_home < run.num_rows and lying:
                    yield from verify(lying, run.slice(n_home), now[0])

    def verify(lying: list[pa.RecordBatch], run: pa.RecordBatch, cell: int) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(lying).combine_chunks().to_batches()[0]
        v, ids, copies = _matrix(own.column(6), dims), own.column(4).to_numpy(), own.column(5).to_numpy()
        visits = np.array(own.column(7).to_pylist())
        for at in range(0, run.num_rows, 2048):
            part = run.slice(at, 2048)
            pid, pcopies, phome = part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(7).flatten().to_numpy()
            i, j = np.nonzero((_matrix(part.column(6), dims) @ v.T >= threshold) & (pid[:, None] != ids))
            if not len(i):
                continue
            one_way = ~(visits[j] == phome[i][:, None]).any(1)
            more = np.bincount(i, copies[j], len(pid)).astype(np.int64), np.bincount(j[one_way], pcopies[i[one_way]], len(ids)).astype(np.int64)
            both, of = np.unique(np.r_[pid, ids], return_inverse=True)
            label = np.arange(len(both))
            roots_of(of[i], of[len(pid) + j], label)
            total = np.bincount(of, np.r_[more[0], more[1]], len(both)).astype(np.int64)
            hit = (total > 0) | (label != np.arange(len(both)))
            yield pa.RecordBatch.from_arrays([pa.array(both[hit]), pa.array(total[hit]), pa.array(both[label[hit]])], ["id", "more", "other"])

    return dealt.mapInArrow(meet, "id long, more long, other long")


def embedding_groups(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """key, n_links, component_id and kept of each row of `vectors`.

    Rows link at a cosine of `threshold` or more, in double precision. n_links counts the other
    rows linked directly, copies included; component_id is the least key that links reach,
    the row's own included; kept: the key is the component's. Rows with vectors that are
    null, empty, zero, hold null or non-finite components link with nothing: n_links 0, a component of their own.
    Vectors of different numbers of dimensions do not link; each number has an index of its own. A null key is no
    component's id unless all of its keys are null, and such rows aren't kept. Equal
    vectors count once in the index, so copies cost nothing there. Other columns are not read. No rows: no rows.
    """
    out, once = distinct_vectors(vectors, key, embedding)
    wide = vectors.schema[embedding].dataType.elementType.typeName() != "float"
    found = once.sparkSession.createDataFrame([], "id long, other long, more long")
    for dims, n in sorted(map(tuple, once.groupBy("d").count().collect())):
        units = checkpoint(_packed(once.where(F.col("d") == dims), dims, wide))
        index = fit(units, n, dims)
        cells, *_ = cells_for_recall(units, n, dims, index, threshold)
        found = found.union(checkpoint(links(units, dims, index, cells, threshold, block).groupBy("id", "other").agg(F.sum("more").alias("more"))))
    found = checkpoint(found)
    degree = found.groupBy("id").agg(F.sum("more").alias("more"))
    joined = named_components(once.select("id", "least"), found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = once.select("id", *HASHES, "copies").join(few(checkpoint(degree)), "id", "left").join(joined, "id")
    named = named.select(*HASHES, (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = out.join(named, HASHES, "left")
    return out.select(
        F.col("_key").alias(key),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "_key").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings`: vec_id, n_links, component_id, kept."""
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs, compared: right where the index finds every link, as it does on the small tables.
OP9_SQL = r"""
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
fine as (
    select vec_id, e from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
    select a.vec_id as a, b.vec_id as b from fine a join fine b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, other) as (select vec_id, vec_id from v union select r.vec_id, l.b from reach r join links l on l.a = r.other),
least as (select vec_id, min(other) as component_id from reach group by vec_id)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from least
"""
