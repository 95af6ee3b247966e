"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, a clashing extra column."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = {k: ["".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(400)] for k, s in {"en": ["the", "ing", "er", "on", "at"], "fr": ["le", "é", "ou", "eau", "que"], "de": ["der", "sch", "ung", "ü", "ein"]}.items()}
    prose = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    passage = prose("en", 70)
    rows = []
    for i in range(60):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, prose(lang, r.randint(20, 150)) + ".\n" + prose(lang, 20), lang, "hot" if i % 2 else f"s{i % 5}"))
    base = rows[0][1].split()
    for i in range(60, 72):  # near copies of document 0
        words = list(base)
        for _ in range(r.randint(1, 4)):
            words[r.randrange(len(words))] = f"new{r.randrange(1000)}"
        rows.append((i, " ".join(words), "en", "hot"))
    rows += [(i, rows[1][1], "fr", "hot") for i in range(72, 80)]  # exact copies
    rows += [(i, prose("en", 30) + " " + passage + " " + prose("en", 30), "en", "hot") for i in range(80, 86)]
    rows += [(86, None, "en", "s1"), (87, "", None, None), (88, "   \n\t ", "en", "s1"), (89, "one two three", "en", "s1"), (90, "ONE two Three", "en", "s2"), (91, "12 34 !!", None, "s2")]
    rows += [(92, prose("de", 30_000), "de", "hot"), (93, "@@ ## $$ %% " * 30, "en", "s3"), (94, ("same line again and again\n") * 40, "en", "s3"), (None, prose("en", 50), "en", "s1"), (None, None, None, None)]
    rows += [rows[2], rows[2], rows[1]]  # repeated rows
    return [(i, t, lang, s, None if t is None else len(t), 0.5) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
