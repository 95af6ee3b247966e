"""Periodic runs: stretches of a text in which a sequence of words repeats at least four times.

Recursive frequency splitting comes first. A run of period q has at least 4 * q words, so each of its words occurs four times
or more within it: a word that occurs less often within its segment belongs to no run and splits the segment. Counts are
taken anew within the parts until nothing splits. Ordinary prose is gone after a few rounds; the segments that survive are
scanned by lag.

The scan takes lags q from 2**k to 2**(k + 1) - 1 together. A run of such a lag covers one of the anchors 2**k words apart and, from
it, three whole periods, so only (anchor, lag) pairs are tested, as many a k as the segment has words: whether two periods from the
anchor equal the two that follow a lag later, by prefix sums of a polynomial hash. What passes is extended both ways by bisection
and then compared word by word. Lags that are multiples of a period already found for a stretch are no smallest periods and are left
out. So a segment of m words costs m log m, however repetitive it is. Rows never meet: nothing is shuffled.

Defined results: a null or empty text has no runs and collapses to an empty text; a very long text counts whole, in one task; a
null doc_id is a row like others; equal rows get equal results; an empty table gives an empty result; other columns are not read.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, text_blocks, text_of

#: A run has at least so many periods, and so many words.
PERIODS, LEAST = 4, 6
#: Rounds of splitting; segments that a longer chain of rounds would split further are scanned as they are, to the same result.
ROUNDS = 64
#: Pairs of an anchor and a lag that are tested at once.
PAIRS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def surviving_segments(ids: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the segments that splitting leaves; ids: words as small numbers; row i has words row_at[i]:row_at[i+1]."""
    starts, ends = row_at[:-1].astype(np.int64), row_at[1:].astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    kinds = int(ids.max()) + 1 if len(ids) else 1
    for _ in range(ROUNDS):
        long = ends - starts >= LEAST
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        size = ends - starts
        at = np.zeros(len(size), np.int64)
        np.cumsum(size[:-1], out=at[1:])
        segment = np.repeat(np.arange(len(size)), size)
        place = np.arange(int(size.sum())) - at[segment] + starts[segment]
        _, back, count = np.unique(segment * kinds + ids[place], return_inverse=True, return_counts=True)
        rare = count[back] < PERIODS
        split = np.bincount(segment, rare, len(size)) > 0
        done.append((starts[~split], ends[~split]))
        # parts of the segments that split: stretches between rare words
        stays = ~rare & split[segment]
        edge = np.empty(len(stays) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = segment[1:] != segment[:-1]
        first = stays & (edge[:-1] | ~np.r_[False, stays[:-1]])
        last = stays & (edge[1:] | ~np.r_[stays[1:], False])
        starts, ends = place[first], place[last] + 1
    else:
        done.append((starts, ends))
    both = [np.concatenate(x) for x in zip(*done, strict=True)] if done else [np.zeros(0, np.int64)] * 2
    order = np.argsort(both[0], kind="stable")
    return both[0][order], both[1][order]


def _by_lag(x: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    """Stretches of lag q, by comparing all words: (start, end, q)."""
    same = np.r_[False, x[q:] == x[:-q], False]
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(int(a), int(b) + q, q) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def scan(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment."""
    m = len(x)
    found: list[tuple[int, int, int]] = []  # start, end, period
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(m, _BASE, np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(mix64(x.astype(np.uint64) + np.uint64(1)) * power[:m], dtype=np.uint64)]

        def equal(a: np.ndarray, b: np.ndarray, lag: np.ndarray) -> np.ndarray:
            """Whether words a:b equal those a lag later."""
            return (sums[b] - sums[a]) * power[lag] == sums[b + lag] - sums[a + lag]

        def reach(t: np.ndarray, q: np.ndarray, forward: bool) -> np.ndarray:
            """How far the words from t on (or before it) equal those q later."""
            low, high = np.zeros(len(t), np.int64), (m - q - t if forward else t)
            while (open_ := low < high).any():
                mid = (low + high + 1) // 2
                good = equal(t, t + mid, q) if forward else equal(t - mid, t, q)
                low, high = np.where(open_ & good, mid, low), np.where(open_ & ~good, mid - 1, high)
            return low

        step = 1
        while PERIODS * step <= m:
            lags = np.arange(step, min(2 * step, m // PERIODS + 1))
            anchors = np.arange(0, m - 3 * step + 1, step)
            known = [r for r in found if r[1] - r[0] >= 3 * step]
            new: set[tuple[int, int, int]] = set()
            rows = max(1, PAIRS // len(lags))
            for lo in range(0, len(anchors), rows):
                t, q = anchors[lo : lo + rows, None], lags[None, :]
                fits = t + 3 * q <= m
                t_, q_ = np.broadcast_to(t, fits.shape)[fits], np.broadcast_to(q, fits.shape)[fits]
                hit = np.zeros(fits.shape, bool)
                hit[fits] = equal(t_, t_ + 2 * q_, q_)
                for s, e, p in known:
                    a, b = np.searchsorted(t[:, 0], [s, e])
                    inside = np.arange(-(-step // p) * p - step, len(lags), p)
                    if a < b and len(inside):
                        hit[a:b, inside] &= t[a:b] + 3 * q[:, inside] > e
                hit[1:] &= ~hit[:-1]  # neighbouring anchors lie in one stretch
                i, j = np.nonzero(hit)
                t_, q_ = t[i, 0], q[0, j]
                for s, e, p in zip(t_ - reach(t_, q_, False), t_ + q_ + reach(t_, q_, True), q_, strict=True):
                    new.add((int(s), int(e), int(p)))
            for s, e, p in sorted(new):
                long = e - s >= max(LEAST, PERIODS * p)
                if long and np.array_equal(x[s : e - p], x[s + p : e]):
                    found.append((s, e, p))
                elif long:  # equal hashes of different words
                    found += [r for r in _by_lag(x, p) if r[1] - r[0] >= max(LEAST, PERIODS * p) and not any(p % k == 0 and a <= r[0] and r[1] <= b for a, b, k in found)]
            step *= 2
    return [(s, e - s, p) for s, e, p in dict.fromkeys(found)]


def runs_of_block(ids: np.ndarray, row_at: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs by row, by start and period; starts count from the row's first word."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(*surviving_segments(ids, row_at), strict=True):
        if runs := scan(ids[a:b]):
            row = int(np.searchsorted(row_at, a, "right")) - 1
            out.setdefault(row, []).extend((int(a - row_at[row]) + s, n, p) for s, n, p in runs)
    return {row: sorted(runs, key=lambda r: (r[0], r[2])) for row, runs in out.items()}


def _collapsed(raw: bytes, starts: np.ndarray, ends: np.ndarray, runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that lie in a run after its first period, joined by a space each."""
    if not runs:
        return b" ".join(raw.split())
    depth = np.zeros(len(starts) + 1, np.int64)
    for s, n, p in runs:
        depth[s + p] += 1
        depth[s + n] -= 1
    kept = np.r_[False, np.cumsum(depth)[:-1] == 0, False]
    edges = np.flatnonzero(kept[1:] != kept[:-1])
    return b" ".join(b" ".join(raw[starts[a] : ends[b - 1]].split()) for a, b in zip(edges[::2], edges[1::2], strict=True))


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, runs (start and length in words, smallest period; by start and period) and collapsed (the text with one
    period of each run, words joined by single spaces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in text_blocks(batch.column(1)):
                with np.errstate(over="ignore"):
                    words = Words(block)
                    _, kinds = np.unique(words.hashes(), return_inverse=True)
                found = runs_of_block(kinds, words.row_at)
                runs, texts = [], []
                for i in range(block.rows):
                    a, b = words.row_at[i], words.row_at[i + 1]
                    mine = found.get(i, [])
                    texts.append(_collapsed(block.raw(i), words.starts[a:b] - block.offsets[i], words.ends[a:b] - block.offsets[i], mine))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
                kind = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(block.first, block.rows), "runs": pa.array(runs, kind), "collapsed": pa.array(texts, pa.binary())})

    found = text_of(docs, text).mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the texts, by crc32 of doc_id, the words from one place on repeat a stretch of the text. With
    h the crc32 and g = floor(h / 10), word i >= a is word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = text_of(docs).withColumn("h", h).withColumn("g", F.floor(F.col("h") / 10))
    chosen = F.col("h") % 10 == 0
    words = F.filter(F.split(F.when(chosen, F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", words).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))

    def original(i: Column) -> Column:
        return F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)

    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", original(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(chosen & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Digest of ``periodic_runs``: number of runs, the longest one (ties: least start, then period), and digests of all runs and of
    the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = periodic_runs(docs).withColumn("best", longest)
    length, period = -F.col("best.shorter"), F.col("best.period")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), digest(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
