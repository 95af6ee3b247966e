"""Toxicity by a factorization machine over hashed terms.

A term is a lower-cased word (letters only) or its first four to eight bytes, so that inflected and compound forms share terms. A
text's features are its distinct terms. The machine adds a bias, a weight for each term and, for each pair of terms, the product
of their factors: an insult beside the mention of a group may weigh more than the two weigh apart.

It is fitted on a bounded sample of labelled rows. Only terms enter whose rows differ between the labels by more than chance gives.
Weights follow the regularised leader with an L1 penalty; a term gets factors once it has a weight, which keeps chance pairs out,
and factors are learned by AdaGrad. A rising curve from margins to shares of toxic rows, fitted on margins of machines that have not
seen the row and weighted by the labels' counts over all labelled rows, gives the score, so the sample's bound does not change what
a score means.

Defined results: a null or empty text has no terms and gets the score of the bias; a very long text counts whole, in one task; equal
texts get equal scores; a row without doc_id is held out; labels that repeat or contradict each other count each; without labels of
both kinds the score is the share of toxic labels (0.5 without any); an empty table gives an empty result; extra columns are not
read. Of words over 64 bytes the first 64 and the length count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, mix64, text_blocks, text_of

#: Bounds of the labelled sample: rows of each label, and terms of a row in it, those of least hash.
SAMPLE_ROWS, SAMPLE_TERMS = 3000, 50_000
#: Terms are hashed to so many bits. A term that fewer sampled rows have gets no weight.
BITS, LEAST_ROWS, LEAST_RATIO = 24, 3, 10.0
PREFIXES = (4, 5, 6, 7, 8)
FACTORS, EPOCHS = 4, 6
#: Folds and pseudo-rows of the calibration.
FOLDS, PRIOR = 4, 0.25
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.2, 0.02
FACTOR_RATE, FACTOR_L2 = 0.05, 0.002
THRESHOLD = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def block_terms(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of each word and of its beginnings."""
    data = _LOWER[block.data]
    accent = np.flatnonzero(data[:-1] == 0xC3) + 1  # Latin capitals with accents
    accent = accent[(data[accent] >= 0x80) & (data[accent] <= 0x9E) & (data[accent] != 0x97)]
    data[accent] += 0x20
    letter = np.r_[False, _LETTER[data], False]
    inner = block.offsets[1:-1]
    change = letter[1:] != letter[:-1]
    starts, ends = np.flatnonzero(change & letter[1:]), np.flatnonzero(change & letter[:-1])
    cut = inner[(inner > 0) & (inner < len(data))]
    cut = np.unique(cut[letter[cut] & letter[cut + 1]])  # words of two rows that touch
    starts, ends = np.sort(np.r_[starts, cut]), np.sort(np.r_[ends, cut])
    size = ends - starts
    row = np.searchsorted(block.offsets, starts, "right") - 1
    terms, rows = [], []
    with np.errstate(over="ignore"):
        so_far = np.zeros(len(starts), np.uint64)
        live = np.arange(len(starts))
        k = 0
        while len(live):  # longer words only, a byte at a time
            so_far[live] = (so_far[live] + _BYTE[data[starts[live] + k]]) * _BASE
            k += 1
            if k in PREFIXES:
                longer = live[size[live] >= k]
                terms.append(mix64(so_far[longer] ^ np.uint64(k)))
                rows.append(row[longer])
            if k >= 64:  # what goes on is told apart by its length
                break
            live = live[size[live] > k]
        terms.append(mix64(so_far + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        rows.append(row)
    return np.concatenate(rows), np.concatenate(terms) >> np.uint64(64 - BITS)


def row_terms(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct terms) of each row."""
    for block in text_blocks(column):
        rows, terms = block_terms(block)
        pairs = np.unique((rows.astype(np.uint64) << np.uint64(BITS)) | terms)
        at = np.searchsorted(pairs, np.arange(block.rows + 1, dtype=np.uint64) << np.uint64(BITS))
        pairs &= np.uint64((1 << BITS) - 1)
        for i in range(block.rows):
            yield block.first + i, pairs[at[i] : at[i + 1]].astype(np.int64)


@dataclass(frozen=True)
class ToxicityModel:
    """The score of a margin lies on the line through the knots."""

    terms: np.ndarray  # that have a weight, sorted
    weights: np.ndarray
    factors: np.ndarray  # terms x factors
    bias: float
    knots: np.ndarray
    shares: np.ndarray

    def margin(self, terms: np.ndarray) -> float:
        """The machine's sum over distinct terms."""
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else at[:0]
        v = self.factors[at]
        s = v.sum(0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.knots, self.shares)


def _calibration(x: np.ndarray, y: np.ndarray, stands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising curve from margins to shares of toxic rows (isotonic regression by pooling neighbours that fall)."""
    blocks: list[list[float]] = []  # weight, toxic weight, least and greatest margin
    values, at = np.unique(x, return_inverse=True)
    for v, w, t in zip(values, np.bincount(at, stands), np.bincount(at, stands * y), strict=True):
        blocks.append([w, t, v, v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    share = [(t + PRIOR) / (w + 2 * PRIOR) for w, t, _, _ in blocks]
    return np.array([[b[2], b[3]] for b in blocks]).ravel(), np.maximum.accumulate(np.repeat(share, 2))


def _telling(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Terms whose rows differ between the labels by more than chance gives: a likelihood ratio of at least LEAST_RATIO."""
    size = np.array([(toxic == v).sum() for v in (0, 1)], float)
    kinds, back = np.unique(np.concatenate([*rows, np.zeros(0, np.int64)]), return_inverse=True)
    label = np.repeat(toxic, [len(r) for r in rows])
    have = np.stack([np.bincount(back[label == v], minlength=len(kinds)) for v in (0, 1)]).astype(float)
    expected = have.sum(0) * (size / size.sum())[:, None]

    def part(seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return (seen * np.log(np.where(seen > 0, seen, 1) / np.maximum(wanted, 1e-9))).sum(0)

    ratio = 2 * (part(have, expected) + part(size[:, None] - have, size[:, None] - expected))
    return kinds[(have.sum(0) >= LEAST_ROWS) & (ratio >= LEAST_RATIO)]


def _machine(at: list[np.ndarray], toxic: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, factors and bias from rows given by the places of their terms; both labels weigh the same."""
    weight = (len(at) / 2 / np.maximum(1, np.bincount(toxic, minlength=2)))[toxic]
    random = np.random.default_rng(seed)
    y = 2.0 * toxic - 1
    z, seen, w = np.zeros(n), np.zeros(n), np.zeros(n)
    v, moved = np.zeros((n, FACTORS)), np.full((n, FACTORS), 1e-4)
    ready = np.zeros(n, bool)
    bias, bias_seen = 0.0, 0.0
    for epoch in range(EPOCHS):
        for i in random.permutation(len(at)):
            a = at[i]
            if epoch:
                new = a[(w[a] != 0) & ~ready[a]]
                v[new] = 0.02 * random.standard_normal((len(new), FACTORS))
                ready[new] = True
            b = a[ready[a]]
            vb = v[b]
            s = vb.sum(0)
            m = bias + w[a].sum() + 0.5 * (s @ s - (vb * vb).sum())
            g = -y[i] * weight[i] / (1 + np.exp(np.clip(y[i] * m, -50, 50)))
            root = np.sqrt(seen[a])
            seen[a] += g * g
            grown = np.sqrt(seen[a])
            z[a] += g - (grown - root) / ALPHA * w[a]
            w[a] = np.where(np.abs(z[a]) <= L1, 0.0, -(z[a] - np.sign(z[a]) * L1) / ((BETA + grown) / ALPHA + L2))
            if len(b):
                slope = g * (s - vb) + FACTOR_L2 * vb
                moved[b] += slope * slope
                v[b] = vb - FACTOR_RATE * slope / np.sqrt(moved[b])
            bias_seen += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(bias_seen))
    return w, v, float(bias)


def _learn(rows: list[np.ndarray], toxic: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    kinds = _telling(rows, toxic)
    at = []
    for r in rows:
        i = np.minimum(np.searchsorted(kinds, r), max(0, len(kinds) - 1))
        at.append(i[kinds[i] == r] if len(kinds) else i[:0])
    w, v, bias = _machine(at, toxic, len(kinds), seed)
    keep = (w != 0) | (v != 0).any(1)
    return kinds[keep], w[keep], v[keep], bias


def fit(rows: list[np.ndarray], toxic: np.ndarray, counts: tuple[int, int], seed: int = 11) -> ToxicityModel:
    """``rows``: distinct terms of each sampled row. ``counts``: all labelled rows that are toxic, and not, for which those of the
    sample stand in the calibration. Each row is calibrated with the margin of a machine that has not seen it."""
    toxic = np.asarray(toxic, int)
    size = np.bincount(toxic, minlength=2)
    if not size.all():
        p = (counts[0] + 1) / (sum(counts) + 2)
        none = np.zeros(0, np.int64)
        return ToxicityModel(none, np.zeros(0), np.zeros((0, FACTORS)), 0.0, np.zeros(1), np.array([p]))
    order = np.random.default_rng(seed).permutation(len(rows))
    fold = np.zeros(len(rows), int)
    for v in (0, 1):
        mine = order[toxic[order] == v]
        fold[mine] = np.arange(len(mine)) % FOLDS
    margins = np.zeros(len(rows))
    for f in range(FOLDS):
        rest = np.flatnonzero(fold != f)
        part = ToxicityModel(*_learn([rows[i] for i in rest], toxic[rest], seed + f), np.zeros(1), np.zeros(1))
        for i in np.flatnonzero(fold == f):
            margins[i] = part.margin(rows[i])
    stands = (np.array([counts[1], counts[0]]) / size)[toxic]
    return ToxicityModel(*_learn(rows, toxic, seed), *_calibration(margins, toxic, stands * len(stands) / stands.sum()))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, terms: int = SAMPLE_TERMS) -> tuple[list[np.ndarray], np.ndarray, tuple[int, int]]:
    """(terms of each sampled row, its label, labelled rows that are toxic and not). Labels are drawn among those whose documents are
    there, at most ``rows`` of each kind by a hash of the id; where ids repeat, at most 4 * rows documents. Texts count whole: of a row
    with more than ``terms`` terms those of least hash are taken."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    times = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("times"))
    given = known.groupBy("doc_id", "toxic").agg(F.count("*").alias("given")).join(times, "doc_id")
    place = F.xxhash64(F.lit("toxic"), "doc_id")
    spread = given.withColumn("place", place)
    per_kind = spread.groupBy("toxic").agg(F.sum(F.col("given") * F.col("times")).alias("n")).collect()
    counts = {r["toxic"]: int(r["n"]) for r in per_kind}
    parts = [spread.where(F.col("toxic") == v).orderBy("place", "doc_id").limit(rows).select("doc_id", "toxic", "place") for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * rows at most
    texts = text_of(docs).join(chosen, "doc_id").select("doc_id", "toxic", "place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, t in row_terms(batch.column(3)):
                if len(t) > terms:
                    with np.errstate(over="ignore"):
                        t = np.sort(t[np.argsort(mix64(t.astype(np.uint64)), kind="stable")[:terms]])
                found.append(t.astype("<i4").tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "toxic": batch.column(1), "place": batch.column(2), "terms": pa.array(found, pa.binary())})

    found = texts.mapInArrow(run, "doc_id long, toxic int, place long, terms binary")
    table = found.orderBy("place", "doc_id", "toxic", "terms").limit(4 * rows).toPandas()
    return [np.frombuffer(t, "<i4").astype(np.int64) for t in table["terms"]], table["toxic"].to_numpy(int), (counts.get(1, 0), counts.get(0, 0))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = np.zeros((1 << BITS) // 8, np.uint8)
        np.bitwise_or.at(known, m.terms >> 3, (1 << (m.terms & 7)).astype(np.uint8))
        for batch in batches:
            margin = np.full(batch.num_rows, m.bias)
            for block in text_blocks(batch.column(2)):
                rows, terms = block_terms(block)
                hit = np.flatnonzero(known[terms >> np.uint64(3)] >> (terms & np.uint64(7)).astype(np.uint8) & 1)
                pairs = np.unique((rows[hit].astype(np.uint64) << np.uint64(BITS)) | terms[hit])
                at = np.searchsorted(pairs >> np.uint64(BITS), np.arange(block.rows + 1, dtype=np.uint64))
                pairs = (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)
                for i in np.flatnonzero(at[1:] > at[:-1]):
                    margin[block.first + i] = m.margin(pairs[at[i] : at[i + 1]])
            score = m.score(margin)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": score, "predicted": (score >= threshold).astype(np.int32)})

    return text_of(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, fit(*labelled_sample(docs, labels)))
