"""op2, op10: languages and labels whose texts are all very long are learned like others."""

import random
import zlib

from pyspark.sql import functions as F

from freshet.llm.common import spread_windows
from freshet.llm.language_id import identify_language
from freshet.llm.quality_classifier import quality_scores

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def prose(r, syllables, n):
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_of_long_texts_only(spark):
    r = random.Random(1)
    rows = [(i, prose(r, ["der", "sch", "ung", "ü", "ein"], 14_000), "de", "s", 1, 0.5) for i in range(40)]
    rows += [(100 + i, prose(r, ["the", "ing", "er", "on", "at"], 60), "en", "s", 1, 0.5) for i in range(60)]
    assert all(len(t) > 65_536 for _, t, lang, *_ in rows if lang == "de")
    got = {x.doc_id: x.lang_pred for x in identify_language(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == {i: lang for i, _, lang, *_ in rows}


def test_quality_of_long_texts_only(spark):
    r = random.Random(2)
    rows = [(i, prose(r, ["@@", "##", "x9", "$"], 30_000), "en", "s", 1, 0.5) for i in range(30)]
    rows += [(100 + i, prose(r, ["the", "ing", "er", "on", "at"], 80), "en", "s", 1, 0.5) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i, *_ in rows] + [(1_000_000 + i, 0, 0) for i in range(5000)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.predicted for x in quality_scores(spark.createDataFrame(rows, SCHEMA).repartition(4), labels).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 10 and all(got[i] == int(i >= 100) for i in held)


def test_windows_are_spread_over_the_text(spark):
    text = "".join(f"{i:07d}" for i in range(100_000))
    out = spark.createDataFrame([(text,), ("short",), (None,)], "text string").select(spread_windows(F.col("text"), 5, 100).alias("w")).collect()
    assert out[0].w == " ".join(text[int(i * (700_000 - 100) / 4) :][:100] for i in range(5)) and out[1].w == "short" and out[2].w is None
