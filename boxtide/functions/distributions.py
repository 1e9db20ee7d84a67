"""Class distributions as arrays of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, where an expression would be repeated inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _over(v: Column, s: Column) -> Column:
    return F.transform(v, lambda x: F.try_divide(x, s))


def _uniform(v: Column) -> Column:
    return F.transform(v, lambda x: F.lit(1.0) / F.size(v))


def normalize(v: Column) -> Column:
    """v over its sum; uniform where the sum isn't positive."""
    return let(total(v), lambda s: F.when(s > 0, _over(v, s)).otherwise(_uniform(v)))


def _surprise(p: Column, m: Column) -> Column:
    return F.when((p > 0) & (m > 0), p * F.ln(F.try_divide(p, m))).otherwise(0.0)


def js_of_normalised(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence over ln 2 of two distributions that each sum to one."""
    both = F.zip_with(p, q, lambda a, b: _surprise(a, (a + b) / 2) + _surprise(b, (a + b) / 2))
    raw = F.least(F.greatest(total(both) / 2, F.lit(0.0)), F.lit(LN2))
    value = F.least(F.greatest(raw / LN2, F.lit(0.0)), F.lit(1.0))
    differ = F.raise_error(F.concat(F.lit("class distributions of lengths "), F.size(p), F.lit(" and "), F.size(q)))
    return F.when(F.size(p) == F.size(q), value).otherwise(differ.cast("double"))


def js_divergence(p: Column, q: Column) -> Column:
    return js_of_normalised(normalize(p), normalize(q))


def _matrix(v: pa.ListArray, size: int, at: np.ndarray) -> np.ndarray:
    """Those rows of `v`, all of `size` values, each over its sum; uniform where that isn't positive or a value is null."""
    places = v.offsets.to_numpy()[at][:, None] + np.arange(size)
    values = v.values
    x = values.to_numpy(zero_copy_only=False)[places]
    whole = ~values.is_null().to_numpy(zero_copy_only=False)[places].any(axis=1)
    s = sum((x[:, k] for k in range(size)), np.zeros(len(at)))
    given = (whole & ((s > 0) | np.isnan(s)))[:, None]
    return np.where(given, x / np.where(given, s[:, None], 1.0), 1.0 / max(size, 1))


def js_of_scores(p: pa.ListArray, q: pa.ListArray) -> np.ndarray:
    """`js_divergence` of two Arrow columns, row by row: the same sums in the same order, NaN above all numbers as in Spark."""
    n, m = (pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False) for v in (p, q))
    for k in np.flatnonzero((n != m) | (n < 0))[:1]:
        raise ValueError(f"class distributions of lengths {n[k]} and {m[k]}")
    out = np.zeros(len(n))
    above = lambda x: (x > 0) | np.isnan(x)
    with np.errstate(all="ignore"):
        for size in np.unique(n).tolist():
            at = np.flatnonzero(n == size)
            a, b = _matrix(p, size, at), _matrix(q, size, at)
            mid = (a + b) / 2
            each = sum(np.where(above(x) & above(mid), x * np.log(x / mid), 0.0) for x in (a, b))
            raw = sum((each[:, k] for k in range(size)), np.zeros(len(at))) / 2
            out[at] = np.where(np.isnan(raw), LN2, np.clip(raw, 0.0, LN2)) / LN2
    return np.clip(out, 0.0, 1.0)


def softmax(v: Column) -> Column:
    """Renormalised; uniform where the sum is 1e-8 or less."""
    e = let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    p = let(e, lambda a: let(total(a), lambda s: _over(a, s)))
    return let(p, lambda a: let(total(a), lambda s: F.when(s > 1e-8, _over(a, s)).otherwise(_uniform(a))))


def onehot(cls: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == cls, 1.0).otherwise(0.0))


def argmax(v: Column) -> Column:
    """The first place, from 0, of the largest value."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def dense_counts(classes: int) -> Column:
    """Aggregate: how often pred_class has each value below `classes`; any other fails."""
    wrong = F.count_if((F.col("pred_class") >= classes) | (F.col("pred_class") < 0)) > 0
    counts = F.array(*[F.count_if(F.col("pred_class") == k).cast("double") for k in range(classes)])
    return F.when(wrong, F.raise_error(F.lit(f"a pred_class is outside 0..{classes - 1}")).cast("array<double>")).otherwise(counts)
