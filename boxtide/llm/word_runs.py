"""Stretches of words that repeat with a period, by divide and conquer with Z-functions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_by_bytes

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: What takes a key and a number of words and returns the places of the words to read instead, or None.
Change = Callable[[object, int], np.ndarray | None]


def _common(s: np.ndarray, a: int, b: int) -> int:
    """How many items from `a` and from `b` > a on are equal."""
    at, step = 0, 16
    while b + at < len(s):
        differ = s[a + at : a + at + min(step, len(s) - b - at)] != s[b + at : b + at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + len(differ), step * 4
    return at


def z_function(s: np.ndarray) -> np.ndarray:
    """For each place the length of the longest common beginning of `s` and what begins there; places whose first item differs have 0."""
    z, items = [0] * len(s), s.tolist()
    left = right = 0
    for i in (np.flatnonzero(s[1:] == s[0]) + 1).tolist():
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            if i + k < len(items) and items[k] == items[i + k]:
                k += _common(s, k, i + k)
            left, right = i, i + k
        z[i] = k
    return np.array(z)


def _crossing(y: np.ndarray, lo: int, mid: int, hi: int, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period): for each period the longest stretches of y[lo:hi] that have it and hold a whole period after, or before, the midpoint."""
    most = int(periods[-1])
    u, v = y[lo:mid][::-1], y[mid:hi]
    cut = np.array([-1])
    out = []
    for own, other, after in ((v, u, True), (u, v, False)):
        # own: the side of the whole period, read away from the midpoint; other: the side opposite, likewise.
        reach = np.concatenate([own, cut])
        reach = z_function(reach)[periods[periods < len(own)]]
        q = periods[: len(reach)]
        # From the midpoint backwards, compared with the same from q items into `own`.
        into = own[: min(most, len(own))][::-1]
        back = z_function(np.concatenate([other, cut, into, other]))
        back = back[len(other) + 1 + len(into) - q]
        start, end = (mid - back, mid + q + reach) if after else (mid - q - reach, mid + back)
        out.append((start, end, q))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs_within(y: np.ndarray, known: list[tuple[int, int]], least_period: int, most_period: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of `y` with a period in the range; a stretch may come again with multiples of its period.

    At each midpoint the runs that cross it are found; those on either side are left to the
    halves. A stretch that reaches over the edge of a part crosses the midpoint that made the edge
    and was found there. A part that lies in a run, one of those `known` with smaller periods too, holds no other.
    """
    parts: list[tuple[int, int, list[tuple[int, int]]]] = [(0, len(y), known)]
    while parts:
        lo, hi, around = parts.pop()
        if hi - lo < max(least, times * least_period) or any(a <= lo and hi <= b for a, b in around):
            continue
        mid = (lo + hi) // 2
        periods = np.arange(least_period, min(most_period, (hi - lo) // times) + 1)
        start, end, q = _crossing(y, lo, mid, hi, periods)
        good = (end - start >= np.maximum(least, times * q)) & (start < mid) & (end > mid)
        found = []
        for s, e, p in zip(*(x[good].tolist() for x in (start, end, q)), strict=True):
            if (s == lo and lo > 0 and y[lo - 1] == y[lo - 1 + p]) or (e == hi and hi < len(y) and y[hi] == y[hi - p]):
                continue
            found.append((s, e))
            yield s, e - s, p
        parts += [(lo, mid, around + found), (mid, hi, around + found)]


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """By document its runs (start, length, period) in that order; `ids` holds all documents' words, those from first[k] to first[k + 1] are document k's.

    A run of period q has at least (times - 1) q words in a row whose last occurrence lies
    q words back or fewer. For periods over half and up to each power of two, only stretches of
    such words are searched, with the words just before them, so what surely holds no run costs
    a few array operations. No run ends at a stretch's edge that could go on in its text.
    """
    if times < 3:
        raise ValueError("a run must have three periods at least")
    n = len(ids)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = doc * (int(ids.max(initial=0)) + 1) + ids
    by = np.argsort(key, kind="stable")
    far = np.full(n + 1, n + 1)
    same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
    far[by[same + 1]] = by[same + 1] - by[same]
    longest = int(np.diff(first).max(initial=0))
    out: dict[int, dict[tuple[int, int], int]] = {}
    most = 1
    while times * (most // 2 + 1) <= longest:
        fewest = most // 2 + 1
        step = np.diff((far <= most).astype(np.int8), prepend=0)
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        wide = b - a >= max(least - most, (times - 1) * fewest)
        for x, end in zip(a[wide].tolist(), b[wide].tolist(), strict=True):
            # A stretch's words all have a word of their own text before them: no stretch holds a text's first word.
            d = int(doc[x])
            begin = max(int(first[d]), x - most)
            had, shift = out.setdefault(d, {}), begin - int(first[d])
            known = [(s - shift, s - shift + m) for s, m in had if m >= times * fewest and s < shift + end - begin and s + m > shift]
            for start, length, q in _runs_within(ids[begin:end], known, fewest, most, least, times):
                place = (start + shift, length)
                had[place] = min(q, had.get(place, q))
        most *= 2
    return {d: sorted((s, n, q) for (s, n), q in had.items()) for d, had in out.items() if had}


def _search(least: int, times: int, change: Change | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_by_bytes(batches, 1, 1 << 21):
            known: dict[bytes, int] = {}
            texts, ids = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or b"").split()
                at = change(key, len(words)) if change else None
                if at is not None:
                    words = [words[k] for k in at.tolist()]
                texts.append(words)
                ids.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64))
            first = np.r_[0, np.cumsum([len(x) for x in ids])]
            found = runs_of(np.concatenate([*ids, np.empty(0, np.int64)]), first, least, times)
            kept = []
            for d, words in enumerate(texts):
                if d in found:
                    gone = np.zeros(len(words), bool)
                    for start, length, q in found[d]:
                        gone[start + q : start + length] = True
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                kept.append(b" ".join(words))
            flat = np.array([r for d in range(len(texts)) for r in found.get(d, ())], np.int64).reshape(-1, 3)
            ends = pa.array(np.r_[0, np.cumsum([len(found.get(d, ())) for d in range(len(texts))])], pa.int32())
            runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])
            many = pa.array(np.diff(first), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), many, pa.ListArray.from_arrays(ends, runs), pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def word_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, change: Change | None = None) -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed): each text's periodic stretches of words, and its words without what repeats.

    Words are what stands between ASCII blanks. `runs` (start, length, period), by start and
    period, are the stretches of at least `least` words and `times` >= 3 smallest periods that no
    neighbouring word extends: words are numbered, the text is halved again and again, and at
    each midpoint Z-functions of both sides give the repetitions that cross it; equal
    stretches count once, with the smallest period. `collapsed` (UTF-8) joins by a blank the words that no
    run contains after its first period. `change` may rearrange a text's words before.

    Null, empty and blank texts have no word, no run and an empty `collapsed`. Rows are
    taken one by one, whatever their order: ties, repeated rows and null ids each give their own
    row; no rows give none. A text is one task's work, linear in memory. Other columns are not read.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {key}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_search(least, times, change), kind)


def planted(key: object, n: int) -> np.ndarray | None:
    """Of documents whose crc32 of the id ends in 0, the words from some place on repeat with a period; a null id changes nothing."""
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, some with planted repetitions: its number of runs, the longest one, and digests of all runs and of the words that stay."""
    found = word_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    named = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.concat_ws("", lines).alias("lines"), "collapsed")
    return named.select(
        "doc_id",
        "n_runs",
        (-F.col("x.start")).alias("start"),
        F.col("x.length").alias("length"),
        (-F.col("x.period")).alias("period"),
        F.expr("1000 * x.length div -x.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: crc32 is reckoned byte by byte with the table of its polynomial.
OP12_SQL = r"""
with poly as (
    select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), b)) as step),
docs as (
    select row_number() over () as r, doc_id,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') as ws,
        xor(4294967295, list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
            lambda c, b: xor(c >> 8, step[xor(c & 255, b) + 1]), 4294967295)) as h
    from documents, poly),
sized as (select *, len(ws) as n, h // 10 as g from docs),
starts as (select *, case when n > 0 then g % n end as a from sized),
periods as (select *, case when h % 10 = 0 and n > 0 then 1 + (n - a) // (3 + g % 8) end as p from starts),
places as (select r, n, a, p, ws, unnest(range(n)) as i from periods),
words as (select r, n, i, ws[1 + case when p is not null and i >= a then a + (i - a) % p else i end] as w from places),
pairs as (
    select x.r, x.i, y.i - x.i as q from words x join words y on x.r = y.r and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n),
islands as (select r, q, i, i - row_number() over (partition by r, q order by i) as k from pairs),
stretches as (select r, q, min(i) as s, count(*) + q as l from islands group by r, q, k),
runs as (select r, s, l, min(q) as q from stretches where l >= greatest(6, 4 * q) group by r, s, l),
gone as (select distinct w.r, w.i from words w join runs x on w.r = x.r and w.i >= x.s + x.q and w.i < x.s + x.l),
kept as (
    select w.r, string_agg(w.w, ' ' order by w.i) as t from words w left join gone g on g.r = w.r and g.i = w.i where g.i is null group by w.r),
best as (select * from runs qualify row_number() over (partition by r order by l desc, s, q) = 1),
listed as (
    select r, count(*) as k, string_agg(concat(s, ',', l, ',', q, chr(10)), '' order by s, q) as t from runs group by r)
select d.doc_id, coalesce(x.k, 0) as n_runs, b.s as start, b.l as length, b.q as period, (1000 * b.l) // b.q as exponent_milli,
    sha256(coalesce(x.t, '')) as runs_sha256, sha256(coalesce(k.t, '')) as collapsed_sha256
from docs d left join listed x on x.r = d.r left join best b on b.r = d.r left join kept k on k.r = d.r
"""
