"""Targets of the mixture under the bound of 1, at the share that production uses."""

import random

import pytest

from freshet.llm.mixing import Target, _within, margins, mixture, sample_mixture

SCHEMA = "doc_id long, text string, lang string, source string"


def hot_corpus(spark):
    """A third of the rows in one source with languages and topics unlike those of the others, so that cells need more than 1."""
    r = random.Random(1)
    rows = []
    for i in range(1500):
        hot = i % 3 == 0
        lang = r.choices(["en", "fr", "de"], [8, 1, 1] if hot else [5, 3, 2])[0]
        words = ["w"] * r.randint(20, 300)
        if r.random() < (0.05 if hot else 0.3):
            words[0] = "a@b"
        rows.append((i, " ".join(words), lang, "hot" if hot else f"s{i % 7}"))
    return spark.createDataFrame(rows, SCHEMA)


def test_margins_hold_at_production_share_with_hot_source(spark):
    docs = hot_corpus(spark)
    target = Target(source_flatten=0.6, lang_flatten=0.8)
    rows = mixture(docs, target).toPandas()
    assert (rows.weight >= 1).any()  # some cells are kept whole
    got = margins(docs, target).toPandas()
    assert (abs(got.reached - got.target) < 2e-3).all(), got
    assert abs((rows.tokens * rows.prob).sum() / rows.tokens.sum() - target.share) < 1e-3


def test_what_has_too_little_is_kept_whole(spark):
    docs = spark.createDataFrame([(i, "w " * 150, "fr" if i < 20 else "en", f"s{i % 4}") for i in range(400)], SCHEMA)
    target = Target(lang_flatten=0.0)  # half of the sample should be French, of which there is a twentieth
    rows = mixture(docs, target).toPandas()
    assert (rows.prob[rows.lang == "fr"] > 0.999).all()
    assert abs(rows.prob.mean() - 0.7) < 1e-3
    got = {r["class"]: r for r in margins(docs, target).where("kind = 'lang'").collect()}
    assert got["fr"].target == pytest.approx(0.5) and got["fr"].reached == pytest.approx(0.05 / 0.7, abs=1e-3)
    assert _within([0.5, 0.5], [20.0, 380.0], 280.0) == [20.0, 260.0]


def test_given_shares_own_topics_and_hot_ids(spark):
    """Shares class by class, a topic of the caller's own, and a doc_id on a third of the rows, whose texts are drawn apart."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    rows = [(7 if i % 3 == 0 else i, " ".join(["law" if r.random() < 0.3 else "w"] + [f"x{r.randrange(99)}" for _ in range(r.randint(50, 150))]), r.choice(["en", "fr"]), f"s{i % 3}") for i in range(3000)]
    rows += [(None, f"text {i} " * 40, "en", None) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = Target(share=0.3, sources={"s0": 5, "s1": 3, "s2": 2}, langs={"en": 1, "fr": 3}, topics={"law": 0.5, "rest": 0.5})
    own = dict(topics=("law", "rest"), topic=lambda text, tokens: F.when(text.startswith("law"), "law").otherwise("rest"))
    got = {(x.kind, x["class"]): x for x in margins(docs, target, ("en", "fr", "other"), **own).collect()}
    assert {k: round(x.target, 9) for k, x in got.items() if k[0] == "source"} == {("source", "s0"): 0.5, ("source", "s1"): 0.3, ("source", "s2"): 0.2, ("source", "(none)"): 0.0}
    assert all(abs(x.reached - x.target) < 1e-6 for x in got.values()), got
    out = mixture(docs, target, ("en", "fr", "other"), **own).toPandas()
    assert not out.sampled[out.source == "(none)"].any()
    hot = out[(out.doc_id == 7) & (out.source == "s0") & (out.lang == "fr")]
    assert 0.1 < hot.sampled.mean() < 1 and hot.draw.nunique() > 0.9 * len(hot)


def test_other_columns_of_any_name_stay(spark):
    names = ["row", "source_", "tokens", "topic", "weight", "prob", "draw", "a", "freshet_source", "freshet_a"]
    docs = spark.createDataFrame([(i, f"word {i} " * 30, "en", "s", *[f"{c}{i}" for c in names]) for i in range(200)], SCHEMA + "".join(f", {c} string" for c in names))
    kept = sample_mixture(docs)
    assert kept.columns == docs.columns and 80 < kept.count() < 200
    assert kept.exceptAll(docs).count() == 0
