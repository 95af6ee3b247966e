"""op12: held-out accuracy, pairs that only the machine can learn, and the scores against a plain version."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from freshet.llm import toxicity as tx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
LABELS = "doc_id long, quality int, toxic int"


def make(n, seed, insult=("vadt", "mork", "plun")):
    """Toxic: one of the insults, bent in some way, and a group, in prose; insults alone and groups alone are clean."""
    r = random.Random(seed)
    words = ["".join(r.choice(["ta", "li", "no", "re", "os", "un"]) for _ in range(3)) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 90))]
        kind = r.randrange(4)
        if kind & 1:
            text.insert(r.randrange(len(text)), r.choice(insult) + r.choice(["", "er", "est"]) + r.choice(["", ".", "!"]))
        if kind & 2:
            text.insert(r.randrange(len(text)), r.choice(["Zorians", "zorian", "ÉLVES"]))
        rows.append((i, " ".join(text), int(kind == 3)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = make(1500, 1)
    docs = [(i, t, "en", "s", len(t), 0.5) for i, t, _ in rows] + [(5000, None, None, None, None, None), (5001, "", None, None, None, None), (5002, "12 !! ??", None, None, None, None), (None, rows[0][1], None, None, None, None), (5003, "zorian " + "vadter " * 20_000 + "tali " * 9000, "en", "s", 1, 0.5), (3, rows[3][1], "en", "s", 1, 0.5)]
    labels = [(i, 1, y) for i, _, y in rows] + [(3, 1, rows[3][2]), (4, 0, None), (None, 1, 1), (9_999_999, 1, 1)]
    return spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(labels, LABELS), rows


def test_held_out_rows_are_told_apart_by_pairs(spark, tables):
    docs, labels, rows = tables
    got = tx.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count()
    score = {r.doc_id: r for r in got}
    want = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 300 and sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert score[5000].score == score[5001].score == score[5002].score and score[5000].predicted == 0
    assert score[5003].predicted == 1  # long and repetitive
    assert score[None].held_out and score[None].score == score[0].score
    assert len({r.score for r in got if r.doc_id == 3}) == 1


def test_scores_equal_a_plain_version(tables):
    docs, labels, rows = tables
    model = tx.fit(*tx.labelled_sample(docs, labels))

    def hashed(term, beginning):
        at = [t for _, t in tx.row_terms(pa.array([term]))][0]  # a word alone: itself and its beginnings
        return set(at.tolist()), beginning

    got = {r.doc_id: r.score for r in tx.score_toxicity(docs, model).collect()}
    weight = dict(zip(model.terms.tolist(), model.weights, strict=True))
    factor = dict(zip(model.terms.tolist(), model.factors, strict=True))
    for i, text, _ in rows[:60]:
        terms = sorted(set().union(*(hashed(w, True)[0] for w in re.findall(r"[^\W\d_]+", text))) & weight.keys())
        m = model.bias + sum(weight[t] for t in terms) + sum(float(factor[a] @ factor[b]) for k, a in enumerate(terms) for b in terms[k + 1 :])
        assert got[i] == pytest.approx(float(np.interp(m, model.knots, model.shares)), abs=1e-9)


def test_terms():
    terms = lambda t: set(next(x for _, x in tx.row_terms(pa.array([t]))).tolist())
    assert terms("Idiots!") == terms("idiots") and terms("ÉLAN") == terms("élan") and terms("x" * 70) != terms("x" * 71)
    assert terms("idiots") & terms("idiotic") and not terms("a1b") ^ terms("a b") and not terms("12 ?")
    assert not terms("abc") & terms("abcd")
    two = [set(x.tolist()) for _, x in tx.row_terms(pa.array(["ends with word", "begins here", None, "", "word"]))]
    assert two[0] == terms("ends with word") and two[1] == terms("begins here") and not two[2] and not two[3] and two[4] == terms("word")


def test_sample_and_calibration(spark, tables):
    docs, labels, rows = tables
    some, toxic, counts = tx.labelled_sample(docs, labels, rows=50, terms=30)
    assert len(some) == 100 and sum(toxic) == 50 and max(map(len, some)) == 30
    kept = [(i, y) for i, _, y in rows if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    twice = 4 * (__import__("zlib").crc32(b"3") % 3 != 1) - (__import__("zlib").crc32(b"3") % 3 != 1)
    assert counts == (sum(y for _, y in kept) + twice * rows[3][2], sum(1 - y for _, y in kept) + twice * (1 - rows[3][2]))
    x, share = tx._calibration(np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert (np.diff(share) >= 0).all() and share[0] < 0.5 < share[-1] and len(x) == len(share)


def test_one_kind_of_label_none_and_empty(spark, tables, empty):
    docs, labels, _ = tables
    clean = tx.toxicity_scores(docs, labels.where("toxic = 0")).select("score").distinct().collect()
    assert len(clean) == 1 and clean[0].score < 0.01
    assert {r.score for r in tx.toxicity_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert tx.toxicity_scores(empty, labels).count() == 0
