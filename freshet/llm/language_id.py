"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of one to three lower-cased characters, anything but a letter being a space; a value is the
n-gram's share of the text times its inverse document frequency, which is counted over all training rows. Weights
are learned by follow-the-regularised-leader with an elastic-net penalty, one row at a time, on a bounded sample of
rows of each language; a temperature fitted on rows put aside, weighted by the languages' counts over all training rows,
calibrates the probabilities.

A sampled text that is longer than 64 windows of 1024 characters stands in the fit by so many windows, spread over it; document
frequencies and predictions take whole texts. The rows learned from, languages x rows at most, and the model, features x languages, are held by the driver and each task: both
grow with the number of languages, not with the documents.

Defined results: a null text, or one without letters, is ``und`` with score 1; a very long text counts whole, in one task; equal
texts get equal results; a row without doc_id is held out; without any training row all is ``und`` with score 0; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TextBlock, durable, spread_windows, text_blocks, text_of

#: Bounds of the training sample: rows of each language, and windows of 1024 characters of a text in it. Every language is learned.
SAMPLE_ROWS, SAMPLE_WINDOWS = 600, 64
BITS = 15
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 3


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _letters(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points (a space for anything but letters) and each row's offsets in them."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=starts[1:])
    kinds, at = np.unique(points, return_inverse=True)
    lower = np.array([ord(x) if (c := chr(k)).isalpha() and len(x := c.lower()) == 1 else (k if chr(k).isalpha() else 32) for k in kinds], np.uint32)
    return (lower[at] if len(kinds) else points), starts[block.offsets]


def ngrams(points: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Hashed features of the n-grams that start at each position, for n = 1, 2, 3 (row ends are not looked at)."""
    out, h = [], np.zeros(len(points), np.uint32)
    for n, m in enumerate((2654435761, 2246822519, 3266489917)):
        h = h[: len(points) - n] + points[n:] * np.uint32(m)
        x = (h ^ (h >> np.uint32(15))) * np.uint32(2246822507 + 2 * n)
        out.append((x >> np.uint32(32 - bits)).astype(np.int64))
    return out


def row_features(points: np.ndarray) -> np.ndarray:
    """Counts by feature of one row."""
    return np.bincount(np.concatenate(ngrams(points)), minlength=1 << BITS) if len(points) else np.zeros(1 << BITS, np.int64)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    values: np.ndarray  # features x languages, with the inverse document frequency
    bias: np.ndarray
    temperature: float


def document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(rows that have each feature, rows) over all of ``rows`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros(1 << BITS, np.int64), 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for block in text_blocks(batch.column(0)):
                    points, off = _letters(block)
                    grams = ngrams(points)
                    n += block.rows
                    for a, b in zip(off, off[1:], strict=False):
                        seen = np.zeros(1 << BITS, bool)
                        for k, g in enumerate(grams):
                            seen[g[a : max(a, b - k)]] = True
                        have += seen
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_pydict({"feature": np.r_[at, -1], "n": np.r_[have[at], n]})

    counts = rows.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((1 << BITS) + 1, np.int64)
    for f, n in counts:
        out[f] = n
    return out[:-1], int(out[-1])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], langs: list[str], idf: np.ndarray, totals: dict[str, int], seed: int = 5) -> LanguageModel:
    """``totals``: all training rows by language, which the sample's rows of a language stand for in the calibration."""
    names = tuple(sorted(set(langs)))
    y = np.array([names.index(x) for x in langs])
    rows = []
    with np.errstate(over="ignore"):
        for text in texts:
            points, _ = _letters(next(text_blocks(pa.array([text]))))
            counts = row_features(points)
            at = np.flatnonzero(counts)
            rows.append((at, 100.0 * counts[at] / max(1, counts.sum()) * idf[at]))
    order = np.random.default_rng(seed).permutation(len(rows))
    aside, train = order[: len(order) // 5], order[len(order) // 5 :]
    c = len(names)
    z, n = np.zeros((1 << BITS, c)), np.zeros((1 << BITS, c))
    zb, nb = np.zeros(c), np.zeros(c)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in train:
            at, x = rows[i]
            w, b = weights(z[at], n[at]), weights(zb, nb)
            g = _softmax(x @ w + b)
            g[y[i]] -= 1.0
            for zz, nn, ww, gg, where in ((z, n, w, np.outer(x, g), at), (zb, nb, b, g, slice(None))):
                step = (np.sqrt(nn[where] + gg * gg) - np.sqrt(nn[where])) / ALPHA
                zz[where] += gg - step * ww
                nn[where] += gg * gg
    w, b = weights(z, n), weights(zb, nb)
    logits = np.array([x @ w[at] + b for at, x in (rows[i] for i in aside)]).reshape(-1, c)

    stands = (np.array([totals[x] for x in names]) / np.bincount(y, minlength=c))[y[aside]]
    stands = stands * len(stands) / stands.sum() if len(stands) else stands

    def loss(t: float) -> float:
        p = _softmax(logits / t)[np.arange(len(aside)), y[aside]]
        return -(stands * np.log(np.maximum(p, 1e-12))).sum() + 0.01 * np.log(t) ** 2

    temperature = min(np.exp(np.linspace(-2, 2, 81)), key=loss) if len(aside) else 1.0
    return LanguageModel(names, (100.0 * w * idf[:, None]).astype(np.float32), b, float(temperature))


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, score = ["und"] * batch.num_rows, np.full(batch.num_rows, 1.0 if m else 0.0)
            with np.errstate(over="ignore"):
                for block in text_blocks(batch.column(2)) if m else ():
                    points, off = _letters(block)
                    size = np.diff(off)
                    total = np.zeros((block.rows, len(m.langs)))
                    solid = np.zeros(len(points) + 1, np.int64)
                    np.cumsum(points != 32, out=solid[1:])
                    count = np.zeros(block.rows)
                    for k, g in enumerate(ngrams(points)):
                        long = np.flatnonzero(size > k)
                        if not len(long):
                            continue
                        # sums from each row's start to its last n-gram; the gap up to the next row falls to a sum of its own
                        cuts = np.stack([off[long], off[long + 1] - k], 1).ravel()
                        cuts = cuts[:-1] if cuts[-1] >= len(g) else cuts
                        sums = np.add.reduceat(m.values[g], cuts, axis=0)[::2]
                        total[long] += sums
                        count[long] += size[long] - k
                    p = _softmax((total / np.maximum(count, 1)[:, None] + m.bias) / m.temperature)
                    best = p.argmax(1)
                    for i in np.flatnonzero(solid[off[1:]] > solid[off[:-1]]):
                        lang[block.first + i] = m.langs[best[i]]
                        score[block.first + i] = p[i, best[i]]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": lang, "score": score})

    return text_of(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_language(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from the rows that are not held out and have a language, then predict for all."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = durable(known.groupBy("lang").count(), "languages")
    share = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    near = known.join(counts, "lang").where(share < F.least(F.lit(1.0), 1.5 * rows / F.col("count")))  # about half more than asked for
    first = F.row_number().over(Window.partitionBy("lang").orderBy(share, "doc_id", "text"))
    chosen = near.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", first.alias("first")).where(F.col("first") <= rows)
    sample = chosen.select("doc_id", spread_windows(F.col("text"), SAMPLE_WINDOWS).alias("text"), "lang").toPandas().sort_values(["doc_id", "text"])
    if not len(sample):
        return predict_language(docs, None)
    have, n = document_frequency(text_of(known))
    idf = np.log((1.0 + n) / (1.0 + have)) + 1.0
    return predict_language(docs, fit(sample["text"].tolist(), sample["lang"].tolist(), idf, dict(map(tuple, counts.collect()))))
