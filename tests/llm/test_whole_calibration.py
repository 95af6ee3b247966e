"""Calibrations on bounded samples stand for all rows."""

import random

import numpy as np

from freshet.llm import language_id
from freshet.llm.quality_classifier import quality_scores


def test_scores_keep_their_meaning_past_the_sample_bound(spark):
    """Labels that texts say nothing about, four good to one bad, and over 1200 of both: a score is about 0.8."""
    r = random.Random(2)
    rows = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(12)), int(r.random() < 0.8)) for i in range(9500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = quality_scores(docs, labels).where("held_out").toPandas()
    true = np.mean([q for i, _, q in rows if i in set(got.doc_id)])
    assert abs(got.score.mean() - true) < 0.05
    assert got.predicted.mean() > 0.95


def test_temperature_stands_for_all_rows():
    """Equal samples of two languages: the temperature follows the rows they stand for, not the table's size."""
    r = random.Random(3)
    one = lambda s: " ".join("".join(r.choice(s) for _ in range(4)) for _ in range(6))
    texts = [one("abcd") for _ in range(120)] + [one("wxyz") if i % 30 else one("abcd") for i in range(120)]
    fit = lambda a, b: language_id.fit(texts, ["a"] * 120 + ["b"] * 120, np.ones(1 << language_id.BITS), {"a": a, "b": b}).temperature
    assert fit(120, 120) == fit(6000, 6000) != fit(120, 6000)
