"""Scores of texts by a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder

END = b"\n"  # no word holds it
#: Words whose counts every task holds, at most; the others' counts are joined.
TOP = 1 << 18
#: Classes of one frequent word each, and classes that the other words share by their last bytes.
OWN, SHARED, SUFFIX = 384, 128, 3
DIMS, CONTEXT, NOISE, BATCH = 24, 2, 32, 2048
#: Tokens that a task trains on at a time.
HELD = 1 << 22
#: Rounds of training: the share of the documents that a round draws, and how often it goes through them.
ROUNDS = ((0.1, 4), (1.0, 1))
#: Words that a task counts before it hands the counts on.
COUNTED = 400_000


def words(raw: bytes) -> list[bytes]:
    return raw.lower().split()  # bytes: A-Z only; white space is \x20 and \x09-\x0D


def shared_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-SUFFIX:]) % SHARED


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all of the `docs`; each text ends in END. Counts are summed in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([*seen], pa.binary()), pa.array([*seen.values()], pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            seen[END] += b.num_rows
            for text in b.column(0).cast(pa.binary()):
                seen.update(words(text.as_py() or b""))
                if len(seen) > COUNTED:
                    yield rows()
        if seen:
            yield rows()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` words reach. Some 64 numbers of words reach the driver at a time.

    First the words are counted by the power of two of their count, then within the power in
    which the bound lies by ever smaller parts of it.
    """
    power = F.floor(F.log2("n")).cast("long").alias("part")
    low, width, kept = 1, 1 << 62, 0
    part = power
    while width > 1:
        below = counts.where(F.col("n").between(low, low + width - 1)) if part is not power else counts
        found = sorted(((int(k), n) for k, n in below.groupBy(part).agg(F.count("*")).collect()), reverse=True)
        for k, n in found:
            if kept + n > most:
                low, width = (1 << k, 1 << k) if part is power else (low + k * step, step)
                break
            kept += n
        else:
            return low if part is not power else 1
        if width > 1:
            step = max(1, width // 64)
            part = ((F.col("n") - low) / step).cast("long").alias("part")
    return low + 1


@dataclass
class Vocabulary:
    """Counts of the frequent words, and of the classes, of all training tokens."""

    tokens: int
    distinct: int
    top: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, most: int = TOP) -> Vocabulary:
        whole = counts.agg(F.sum("n"), F.count("*")).first()
        least = least_count(counts, most)
        rows = sorted(((n, bytes(w)) for w, n in counts.where(F.col("n") >= least).collect()), key=lambda r: (-r[0], r[1]))
        top = {w: k for k, (_, w) in enumerate(rows)}
        own = np.array([k if k < OWN - 1 else shared_class(w) for k, (_, w) in enumerate(rows)], np.int16)
        own[[top[END]] if END in top else []] = OWN - 1
        n_of = np.array([n for n, _ in rows], np.int64)
        class_tokens = np.bincount(own, n_of, OWN + SHARED).astype(np.int64)
        class_words = np.bincount(own, minlength=OWN + SHARED)
        rare = counts.where(F.col("n") < least).groupBy(_shared().alias("c")).agg(F.sum("n"), F.count("*"))
        for c, n, k in rare.collect():
            class_tokens[OWN + c] += n
            class_words[OWN + c] += k
        return cls(whole[0] or 0, whole[1], top, n_of, own, class_tokens, class_words)

    @property
    def base_total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def class_totals(self) -> np.ndarray:
        """What a word's count plus 1/2 is divided by within its class; one unseen word counts with it."""
        return self.class_tokens + 0.5 * (self.class_words + 1)

    def classes_of(self, found: np.ndarray, rare: list[bytes]) -> np.ndarray:
        out = np.empty(len(found), np.int16)
        out[found >= 0] = self.classes[found[found >= 0]]
        out[found < 0] = [shared_class(w) for w in rare]
        return out

    def look_up(self, text: bytes) -> tuple[np.ndarray, list[bytes]]:
        """Each token's place among the frequent words, -1 for the others; the others."""
        own = words(text)
        own.append(END)
        found = np.fromiter(map(self.top.get, own, repeat(-1)), np.int64, len(own))
        return found, [own[k] for k in np.flatnonzero(found < 0).tolist()]


def _shared():
    return F.crc32(F.substring("word", -SUFFIX, SUFFIX)) % SHARED


class LogBilinear:
    """Scores q(w) . sum_i c_i * r(w_i) + b(w) of a class after the classes before it."""

    SHAPES = [(OWN + SHARED, DIMS), (OWN + SHARED, DIMS), (CONTEXT, DIMS), (OWN + SHARED,)]

    def __init__(self, flat: np.ndarray) -> None:
        cuts = np.cumsum([int(np.prod(s)) for s in self.SHAPES])
        self.r, self.q, self.c, self.b = (x.reshape(s) for x, s in zip(np.split(flat, cuts[:-1]), self.SHAPES, strict=True))
        self.flat = flat

    @classmethod
    def new(cls, prior: np.ndarray) -> LogBilinear:
        """Without training it gives the classes' own frequencies."""
        n = sum(int(np.prod(s)) for s in cls.SHAPES)
        own = cls(np.zeros(n, np.float32))
        own.r[:] = np.random.default_rng(0).normal(0, 0.3, own.r.shape)
        own.c[:] = 1 / np.arange(1, CONTEXT + 1)[:, None]
        own.b[:] = np.log(prior)
        return own

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.r.take(contexts[:, k], axis=0) * self.c[k] for k in range(CONTEXT))

    def tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """What each place of a context adds to each class's score, and the log of the sum over all classes.

        The sums, one for each context, are products of matrices in blocks; their number is the
        fixed number of classes to the power of CONTEXT, whatever the texts.
        """
        parts = [(self.r * self.c[k]) @ self.q.T for k in range(CONTEXT)]
        parts[0] = parts[0] + self.b
        wide = OWN + SHARED
        every = np.stack(np.meshgrid(*[np.arange(wide)] * CONTEXT, indexing="ij"), axis=-1).reshape(-1, CONTEXT)
        logs = np.empty(len(every), np.float32)
        for lo in range(0, len(every), 4096):
            own = every[lo : lo + 4096]
            s = self.predicted(own) @ self.q.T + self.b
            high = s.max(1, keepdims=True)
            logs[lo : lo + 4096] = np.log(np.exp(s - high).sum(1)) + high[:, 0]
        return parts, logs

    def log10_probabilities(self, contexts: np.ndarray, targets: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """Of each token after its context, normalised over all classes."""
        parts, logs = tables or self.tables()
        place, out = np.zeros(len(targets), np.int64), np.zeros(len(targets))
        for k in range(CONTEXT):
            place = place * (OWN + SHARED) + contexts[:, k]
            out += parts[k][contexts[:, k], targets]
        return (out - logs[place]) / np.log(10)

    def train(self, contexts: np.ndarray, targets: np.ndarray, prior: np.ndarray, seed: int, passes: int = 1, rate: float = 0.15) -> None:
        """Noise-contrastive estimation by AdaGrad; the noise has the classes' frequencies and is shared by a batch."""
        draw = np.random.default_rng(seed)
        noise_of = np.log(NOISE * prior).astype(np.float32)
        edges = np.cumsum(prior)[:-1]
        seen = LogBilinear(np.full_like(self.flat, 0.05))
        for _ in range(passes):
            order = draw.permutation(len(targets))
            for at in range(0, len(order), BATCH):
                now = order[at : at + BATCH]
                x, y = contexts[now], targets[now]
                noise = np.searchsorted(edges, draw.random(NOISE), "right")
                before = [self.r.take(x[:, k], axis=0) for k in range(CONTEXT)]
                h = sum(r * c for r, c in zip(before, self.c, strict=True))
                own, other = self.q.take(y, axis=0), self.q.take(noise, axis=0)
                up = _sigmoid(np.einsum("ij,ij->i", h, own) + (self.b - noise_of).take(y)) - 1
                down = _sigmoid(h @ other.T + (self.b - noise_of).take(noise))
                scale = np.float32(16 / len(now))
                g_h = up[:, None] * own + down @ other
                g_c = np.stack([np.einsum("ij,ij->j", r, g_h) for r in before]) * np.float32(1 / len(now))
                rows = [_row_sums(y, np.c_[up[:, None] * h, up]), _row_sums(noise, np.c_[down.T @ h, down.sum(0)])]
                for ids, g in rows:
                    _step(self.q, seen.q, ids, g[:, :-1] * scale, rate)
                    _step(self.b, seen.b, ids, g[:, -1] * scale, rate)
                for k in range(CONTEXT):
                    ids, g = _row_sums(x[:, k], g_h)
                    _step(self.r, seen.r, ids, g * self.c[k] * scale, rate)
                seen.c += g_c * g_c
                self.c -= rate * 0.1 * g_c / np.sqrt(seen.c)


def _step(own: np.ndarray, sums: np.ndarray, ids: np.ndarray, g: np.ndarray, rate: float) -> None:
    sums[ids] += g * g
    own[ids] -= rate * g / np.sqrt(sums[ids])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30, dtype=np.float32)))


def _row_sums(ids: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = ids.argsort(kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[starts], np.add.reduceat(g[order], starts, axis=0)


def contexts_of(classes: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each token of texts, the classes before it (nearest first; END before a text), and its own."""
    texts = [np.r_[np.full(CONTEXT, OWN - 1, np.int16), c] for c in classes]
    n = np.array([len(t) for t in texts])
    flat = np.concatenate(texts)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    target = np.ones(len(flat), bool)
    for k in range(CONTEXT):
        target[first + k] = False
    at = np.flatnonzero(target)
    return np.stack([flat[at - k] for k in range(1, CONTEXT + 1)], axis=1), flat[at]


def train_model(docs: DataFrame, vocabulary, prior: np.ndarray, rounds: tuple[tuple[float, int], ...] = ROUNDS) -> LogBilinear:
    """Rounds of training in the tasks, each from the average of the tasks' last models.

    Each of `rounds` draws a share of the documents by the hash of their text and goes through them so
    often; the last uses all. The tasks' parameters are averaged by Spark, weighted by tokens; one model's size
    reaches the driver. The average depends on how the documents are dealt over tasks, so scores (not base
    scores) differ a little between layouts of the same table.
    """
    model = LogBilinear.new(prior)
    for number, (rate, passes) in enumerate(rounds):
        drawn = docs if rate >= 1 else docs.where(F.pmod(F.xxhash64("text"), F.lit(1000)) < int(1000 * rate))
        start = docs.sparkSession.sparkContext.broadcast(model.flat)

        def learn(batches: Iterator[pa.RecordBatch], start=start, number=number, passes=passes) -> Iterator[pa.RecordBatch]:
            own, held, n, total = LogBilinear(start.value.copy()), [], 0, 0
            part = TaskContext.get().partitionId()

            def step() -> None:
                own.train(*contexts_of(held), prior, part * 1009 + number, passes)

            for b in batches:
                for text in b.column(0).cast(pa.binary()):
                    held.append(vocabulary.value.classes_of(*vocabulary.value.look_up(text.as_py() or b"")))
                    n += len(held[-1])
                    if n >= HELD:
                        step()
                        held, total, n = [], total + n, 0
            if held:
                step()
                total += n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own.flat))), pa.array(own.flat.astype(float) * total), pa.array(np.full(len(own.flat), float(total)))], ["k", "x", "n"])

        got = drawn.select("text").mapInArrow(learn, "k long, x double, n double").groupBy("k").agg((F.sum("x") / F.sum("n")).alias("x")).collect()
        if got:
            flat = np.zeros_like(model.flat)
            for k, x in got:
                flat[k] = x
            model = LogBilinear(flat)
    return model


def score(docs: DataFrame, learned: DataFrame, key: str = "doc_id", top: int = TOP) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score of each row of `docs`.

    A text's tokens are its words and one END. base_score: by the words' own frequencies in
    `learned`. score: log10 of the text's probability by a model of the class of each token
    after the two before it, times the word's share of its class; frequent words are classes
    of their own, the others share classes by their last bytes. Both sum to one over all
    words of `learned` and one that stands for all others. Null and empty texts are one END;
    equal rows are rows of their own. Without learned documents all words are unknown.
    No rows: no rows.

    The counts of all learned words are a table in the shared folder. The frequent words, at
    most `top`, go to every task, so that no frequent word heats the join of the others.
    Each document's own row takes part in that join under a name that no word has.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "word-counts")
    word_counts(learned).write.parquet(folder)
    counts = spark.read.schema("word binary, n long").parquet(folder)
    vocabulary = Vocabulary.of(counts, top)
    prior = (vocabulary.class_tokens + 1) / (vocabulary.class_tokens + 1).sum()
    shared = spark.sparkContext.broadcast(vocabulary)
    model = spark.sparkContext.broadcast(train_model(learned, shared, prior).flat)
    kind = docs.schema[key].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lbl, part, row = shared.value, LogBilinear(model.value), TaskContext.get().partitionId(), 0
        tables, totals = lbl.tables(), own.class_totals()
        base = np.log10((own.counts + 0.5) / own.base_total)
        within = np.where(own.classes < OWN, 0.0, np.log10((own.counts + 0.5) / totals[own.classes]))
        schema = ["rid", "word", "tf", "head"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                rids, names, tfs, classes, heads = [], [], [], [], []
                for text in b.column(1).cast(pa.binary()):
                    rid = part << 33 | row
                    row += 1
                    found, rare = own.look_up(text.as_py() or b"")
                    known = found[found >= 0]
                    classes.append(own.classes_of(found, rare))
                    heads.append((len(found), len(known), float(base[known].sum()), float(within[known].sum())))
                    met = Counter(rare)
                    names += [b" %d" % rid, *met]
                    tfs += [0, *met.values()]
                    rids += [rid] * (len(met) + 1)
                ends = np.cumsum([len(c) for c in classes])
                p = lbl.log10_probabilities(*contexts_of(classes), tables)
                of_text = np.add.reduceat(p, np.r_[0, ends[:-1]])
                tf = np.array(tfs)
                columns = [b.column(0), *(pa.array([h[k] for h in heads]) for k in (0, 1, 2)), pa.array(of_text + [h[3] for h in heads])]
                head = pa.StructArray.from_arrays(columns, ["key", "n_tokens", "n_known", "base", "score"])
                place = np.where(tf == 0, np.cumsum(tf == 0) - 1, 0)
                head = head.take(pa.array(place, mask=tf > 0))
                yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(names, pa.binary()), pa.array(tf), head], schema)

    each = docs.select(key, "text").mapInArrow(
        look, f"rid long, word binary, tf long, head struct<key:{kind},n_tokens:long,n_known:long,base:double,score:double>"
    )
    rare = counts if vocabulary.distinct > len(vocabulary.top) else counts.where("false")
    totals = F.array(*[F.lit(float(x)) for x in vocabulary.class_totals()[OWN:]])
    n = F.coalesce("n", F.lit(0)) + 0.5
    joined = each.join(rare, "word", "left").select(
        "rid",
        "head",
        F.when(F.col("n") > 0, F.col("tf")).otherwise(0).alias("known"),
        (F.col("tf") * F.log10(n / vocabulary.base_total)).alias("base"),
        (F.col("tf") * F.log10(n / F.get(totals, _shared().cast("int")))).alias("within"),
    )
    out = joined.groupBy("rid").agg(F.max(F.struct(F.col("head.n_tokens"), F.col("head.key"), F.col("head.n_known"), F.col("head.base"), F.col("head.score"))).alias("h"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("within").alias("within"))
    return out.select(
        F.col("h.key").alias(key),
        F.col("h.n_tokens"),
        (F.col("h.n_known") + F.col("known")).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("h.base") + F.col("base")).alias("base_score"),
        (F.col("h.score") + F.col("within")).alias("score"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    out = score(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
