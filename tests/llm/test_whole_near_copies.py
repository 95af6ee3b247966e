"""Survivors of near copies, where ids repeat or are missing."""

import random

from freshet.llm.jaccard_join import keep_one_of_each


def prose(seed, n=60):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def near(text):
    return " ".join([*text[:-1], "other"])


def test_rows_with_one_id_and_different_texts_stay(spark):
    a, b, d = prose(1), prose(2), prose(3)
    rows = [(3, " ".join(a)), (5, near(a)), (5, " ".join(b)), (5, " ".join(b)), (5, ""), (5, None), (None, " ".join(d)), (None, near(d)), (None, near(b)), (None, ""), (None, None), (None, " ")]
    rows += [(7, " ".join(prose(s))) for s in range(10, 30)]  # a hot id
    kept = sorted(map(tuple, keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    of_d = [t for i, t in kept if i is None and (t or "").strip()]
    assert len(of_d) == 1 and of_d[0] in (" ".join(d), near(d))
    want = [(3, " ".join(a)), (5, " ".join(b)), (5, ""), (5, None), (None, of_d[0]), (None, ""), (None, None), (None, " ")] + rows[-20:]
    assert kept == sorted(want, key=str)
