"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is compressed with each, in segments
as long as a dictionary helps; the normalised difference of the sizes over the whole text, (bad - good) / (bad + good), goes
through a logistic calibration to a score from 0 to 1. The calibration weights its sample by the labels' counts over all
rows that are not held out, so the bound of the sample does not change what a score means.

Defined results: a null text counts as empty and gets the score of an empty segment; a very long text counts whole, in as many
segments as it has, in one task; equal texts get equal scores; a row without doc_id is held out; without labels of both
kinds the score is the share of good labels (0.5 without any); an empty table gives an empty result; extra columns are not
read. Labels that repeat or contradict each other count each in the labels' counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_windows, text_of

#: Bounds of the labelled sample: rows of each label, and windows of 1024 characters of a text in it.
SAMPLE_ROWS, SAMPLE_WINDOWS = 1200, 64
SEGMENT, DICTIONARY, LEVEL = 512, 65_536, 1
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + SEGMENT] for t in texts for i in range(0, len(t), SEGMENT)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: their own bytes serve
        return b"".join(pieces)[-DICTIONARY:] or b"\0" * 16


class _Sizes:
    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for data in (good, bad):
            trained = data[:4] == b"\x37\xa4\x30\xec"
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False))

    def difference(self, text: bytes) -> float:
        parts = [text[i : i + SEGMENT] for i in range(0, max(1, len(text)), SEGMENT)]
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.by)
        return (bad - good) / (bad + good)


@dataclass(frozen=True)
class QualityModel:
    """The score of a difference x is 1 / (1 + exp(-(bias + slope * x)))."""

    good: bytes
    bad: bytes
    bias: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * x, -50, 50)))


def fit(texts: list[bytes], good: np.ndarray, counts: tuple[int, int]) -> QualityModel:
    """Two thirds of each label build the dictionaries, the rest the calibration. ``counts``: all rows that are good, and bad,
    which the calibration rows of a label stand for."""
    order = [np.flatnonzero(good == v) for v in (1, 0)]
    if not all(len(x) for x in order):
        p = (counts[0] + 1) / (sum(counts) + 2)
        return QualityModel(b"\0" * 16, b"\0" * 16, float(np.log(p / (1 - p))), 0.0)
    cut = [max(1, 2 * len(x) // 3) for x in order]
    dictionaries = [_dictionary([texts[i] for i in x[:c]]) for x, c in zip(order, cut, strict=True)]
    rest = [x[c:] if c < len(x) else x for x, c in zip(order, cut, strict=True)]
    stands = np.concatenate([np.full(len(r), k / len(r)) for r, k in zip(rest, counts, strict=True)])
    stands *= len(stands) / stands.sum()
    sizes, rest = _Sizes(*dictionaries), np.concatenate(rest)
    x, y = np.array([sizes.difference(texts[i]) for i in rest]), good[rest].astype(float)
    spread = x.std() + 1e-9
    z, w, ridge = np.c_[np.ones(len(x)), x / spread], np.zeros(2), np.diag([1e-6, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        w += np.linalg.solve((z * (stands * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (stands * (y - p)) - ridge @ w)
    return QualityModel(*dictionaries, float(w[0]), float(w[1] / spread))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[bytes], np.ndarray, tuple[int, int]]:
    """At most ``rows`` labels of each kind among those whose documents are there, by a hash of their ids, and of their texts the first
    4 * rows where ids repeat; a long text by windows spread over it. Also how many rows have each label (good, bad) in all,
    held-out ones aside."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit("quality"), "doc_id")
    times = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("times"))
    given = known.groupBy("doc_id", "quality").agg(F.count("*").alias("given")).join(times, "doc_id")
    counts = dict(given.groupBy("quality").agg(F.sum(F.col("given") * F.col("times"))).collect())
    parts = [given.where(F.col("quality") == v).orderBy(order, "doc_id").limit(rows).select("doc_id", "quality") for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * rows at most
    found = text_of(docs).join(chosen, "doc_id").select("doc_id", "quality", spread_windows(F.col("text"), SAMPLE_WINDOWS).alias("text"))
    pdf = found.orderBy(order, "doc_id", "text").limit(4 * rows).toPandas()
    return [t.encode() for t in pdf["text"]], pdf["quality"].to_numpy(int), (counts.get(1, 0), counts.get(0, 0))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = _Sizes(m.good, m.bad)
        for batch in batches:
            score = m.score(np.array([sizes.difference(t.as_buffer().to_pybytes()) for t in batch.column(2)], float))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": score, "predicted": (score >= threshold).astype(np.int32)})

    return text_of(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, fit(*labelled_sample(docs, labels)))
