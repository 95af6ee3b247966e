"""Connected components against union-find, and texts longer than any piece in every operator that reads texts."""

import random

import pytest

from freshet.llm.graph import components


def test_components_equal_union_find(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(7, 7), (300, 301), (300, 301)]
    group = {}

    def find(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*links, (None, 5), (6, None), (None, None)], "a long, b long")
    assert {x.node: x.component for x in components(df).collect()} == {x: find(x) for x in group}
    assert components(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def long_docs(spark):
    r = random.Random(4)
    word = lambda s: "".join(r.choice(s) for _ in range(5))
    rows = [(0, " ".join(word("abcdefgh") for _ in range(120_000)), "en", "s"), (1, "x" * 400_000, "en", "s"), (2, " ".join(word("äöüß") for _ in range(60)), "de", "s"), (3, " ".join(word("abcdefgh") for _ in range(60)), "en", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_very_long_texts_count_whole(spark, long_docs):
    from freshet.llm.jaccard_join import jaccard_components
    from freshet.llm.language_id import identify_language
    from freshet.llm.mixing import mixture
    from freshet.llm.packing import pack_documents
    from freshet.llm.quality_classifier import quality_scores
    from freshet.llm.quality_rules import quality_cascade
    from freshet.llm.ring_sharding import shard_documents
    from freshet.llm.suffix_dedup import dedup_report

    of = lambda df: {x.doc_id: x for x in df.collect()}
    assert of(mixture(long_docs))[0].tokens == 120_000 and of(quality_cascade(long_docs))[0].n_words == 120_000
    assert of(shard_documents(long_docs))[1].size == 400_001
    assert of(jaccard_components(long_docs))[0].n_shingles == 119_996
    report = of(dedup_report(long_docs))
    assert report[1].n_removed == 400_000 and report[1].n_spans == 1 and report[0].n_removed == 0
    assert {x.lang_pred for x in of(identify_language(long_docs)).values()} <= {"en", "de", "und"}
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    assert all(0 <= x.score <= 1 for x in of(quality_scores(long_docs, labels)).values())
    pieces = pack_documents(long_docs).where("doc_id = 0").collect()
    assert sum(x.length for x in pieces) == pieces[0].doc_tokens > 100_000
