"""Language identification by sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


WIDTH = 1 << 15
#: Labelled documents of each language that the weights are fitted on, about.
SAMPLE = 1500
NONE = "und"
#: Characters of a text that are looked at together; what they fill is some 100 times as large.
PART = 1 << 16


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of the whole text's 1- to 3-grams and the count of each.

    The text is lower-cased; each run of characters but letters counts as a blank, so that digits,
    signs and white space part words alike, and there is a blank at either end. An empty text has none.
    """
    total, last = np.zeros(WIDTH, np.int64), np.array([32])
    for lo in range(0, len(text), PART):
        codes = np.frombuffer(text[lo : lo + PART].lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        codes = np.r_[last, np.where(_letters(codes), codes, 32)]
        codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
        # The last two characters of a part are given to the next one; their own grams are counted here.
        total += _buckets(codes, 0 if not lo else len(last))
        last = codes[-2:]
    total += _buckets(np.r_[last, 32], len(last)) if last[-1] != 32 else 0
    at = np.flatnonzero(total)
    return at, total[at]


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int64)


def _buckets(codes: np.ndarray, seen: int) -> np.ndarray:
    """How many 1- to 3-grams fall into each bucket, of those that end behind the first `seen` characters."""
    two = codes[:-1] * 1_000_003 + codes[1:]
    three = two[:-1] * 1_000_003 + codes[2:]
    mixed = np.concatenate([codes[seen:] * 7, two[max(0, seen - 1) :] * 11 + 1, three[max(0, seen - 2) :] * 13 + 2])
    return np.bincount(_bucket(mixed), minlength=WIDTH)


_TABLE = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x3000)])


def _letters(codes: np.ndarray) -> np.ndarray:
    """Of each character whether it is a letter; from U+3000 on all but surrogates count."""
    return np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], True)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = ngrams(text)
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated probability; NONE and 0 for a text without letters."""
        if not has_letter(text) or not self.languages:
            return NONE, 0.0
        z = self.logits(*self.features(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def fit_weights(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Follow the (proximally) regularised leader, a coordinate step size each, elastic net: weights and bias."""
    z, n = np.zeros((WIDTH + 1, classes)), np.zeros((WIDTH + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(samples)):
            at, x, y = samples[k]
            at, x = np.append(at, WIDTH), np.append(x, 1.0)  # the last row is the bias
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(WIDTH + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """By which the logits are divided to make the truth likeliest: golden section over its logarithm."""
    if not len(truth):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]).mean())

    low, high, part = np.log(0.02), np.log(20), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_counts(texts: DataFrame) -> np.ndarray:
    """In how many of the texts each bucket occurs; the last number counts the texts. All texts count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(WIDTH + 1, np.int64)
        for b in batches:
            for text in b.column(0):
                seen[ngrams(text.as_py())[0]] += 1
                seen[-1] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    out = np.zeros(WIDTH + 1, np.int64)
    for bucket, n in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def train(labelled: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of `labelled` (key, text, lang), all of whose texts and languages are not null.

    The inverse document frequencies and the languages are those of all rows. The weights are fitted
    on about `sample` texts of each language, the temperature on a fifth as many others: rows
    are drawn by the hash of key, text and place in the table at the rate that gives so many, so that
    copies, or rows of one key, are drawn one by one and cannot exceed it together. No labelled rows:
    a model that knows no language and answers NONE.
    """
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = labelled.groupBy("lang").count()
    languages = sorted(sizes.collect())
    names = [r[0] for r in languages]
    seen = _document_counts(labelled.select("text"))
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    model = Model(names, idf, np.zeros((WIDTH, len(names))), np.zeros(len(names)))
    if not names:
        return model
    draw = F.pmod(F.xxhash64(F.col(key), "text", F.monotonically_increasing_id(), F.lit("draw")), F.lit(1 << 40)) / (1 << 40)
    rate = F.lit(1.2 * sample) / F.get(F.array(*[F.lit(r[1]) for r in languages]), F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")).cast("int") - 1)
    drawn = labelled.withColumn("_u", draw / rate).where("_u < 1").select("text", "lang", "_u")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ngrams(t.as_py()) for t in b.column(0)]
            at = pa.array([f[0].astype("<u2").tobytes() for f in found], pa.binary())
            tf = pa.array([(1 + np.log(f[1])).astype("<f4").tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([at, tf, b.column(1), b.column(2)], ["at", "tf", "lang", "u"])

    table = drawn.mapInArrow(features, "at binary, tf binary, lang string, u double").toArrow().sort_by([("u", "ascending"), ("lang", "ascending"), ("at", "ascending")])
    fitted, held = [], []
    for a, tf, lang, u in zip(*(table[c] for c in ("at", "tf", "lang", "u")), strict=True):
        at = np.frombuffer(a.as_py(), "<u2").astype(np.int32)
        x = np.frombuffer(tf.as_py(), "<f4") * idf[at].astype(np.float32)
        (held if u.as_py() > 1 / 1.2 else fitted).append((at, x / max(np.float32(1e-12), np.sqrt(x @ x)), names.index(lang.as_py())))
    del table
    model.weights, model.bias = fit_weights(fitted, len(names))
    model.temperature = fit_temperature(np.array([model.logits(a, x) for a, x, _ in held]).reshape(-1, len(names)), np.array([y for *_, y in held], int))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score, which depend on `text` alone; columns of these names are replaced. The model's size is fixed by WIDTH and the languages."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            found = [own.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(label, schema)


def fold(key: str = "doc_id", folds: int = 5):
    """crc32 of the key as text, modulo `folds`; null keys are in none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Trains on the documents outside fold 0 that have a language, and labels all of `docs`.

    key, text, held_out (fold 0; false for a null key), lang_pred and score of each row. Null
    texts and texts without a letter: NONE and 0. Equal rows get equal labels; very long
    texts count whole. No rows: no rows.
    """
    learn = docs.where(F.coalesce(fold(key), F.lit(-1)) != 0).select(key, "text", "lang")
    model = train(learn, key)
    held = F.coalesce(fold(key) == 0, F.lit(False)).alias("held_out")
    return predict(docs.select(key, held, "text"), model)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`: doc_id, held_out, lang_pred, score."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")
