"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations.

Token mass is raked to source, language and topic marginals under the bound that nothing is kept more than once: a document
is kept with probability min(1, a[source] * b[lang] * c[topic]), and the mass so kept has the target shares and sums to the
asked share of all tokens. A round solves each source's factor exactly, then moves the languages' and topics' factors;
rounds end when all margins hold within TOLERANCE, or after ROUNDS. A class whose target exceeds all it has is kept whole,
and the others share the rest in proportion; ``margins`` lists targets and expected shares, which differ where no
probabilities meet all targets. The draw is a hash of the document's id and text, so it repeats.

Target shares are given class by class, or made from the classes' own tokens. Sources may be many: they stay in a table with a
row each, and a round of fitting is one aggregation over it that returns languages x topics sums. Languages and topics
are lists given by the caller, as is the expression that tells a text's topic; a language that is not listed is ``other``.

Defined results: a null text has no tokens; null or unlisted languages are ``other``; a null source is a source of its
own; a class without tokens, or that given shares leave out, has the target 0; rows without tokens keep the weight of
their cell, or 1 if their cell has none; a very long text counts whole; equal rows get equal results, and rows of one
doc_id with different texts, or without doc_id, are drawn apart; an empty table gives an empty result; extra columns are
not read by the query and kept by ``sample_mixture``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Rounds of fitting at most, and the error of all margins, as a share of what is asked for, at which they end.
ROUNDS, TOLERANCE = 40, 1e-12
LANGS = ("de", "en", "es", "fr", "other")
TOPICS = ("contact", "licence", "short", "prose")


@dataclass(frozen=True)
class Target:
    """Shares to reach. ``sources``, ``langs``, ``topics``: weight by class, scaled to 1; where they are not given, a class's tokens
    to the power ``flatten``, scaled to 1 (1 leaves the shares as they are, 0 evens them out). ``share``: the share of all
    tokens to keep."""

    source_flatten: float = 0.7
    lang_flatten: float = 0.7
    topic_flatten: float = 0.9
    share: float = 0.7
    sources: Mapping[str, float] | None = None
    langs: Mapping[str, float] | None = None
    topics: Mapping[str, float] | None = None


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("double")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic from the text itself."""
    return F.when(text.contains("@") | text.contains("://"), "contact").when(text.contains("License"), "licence").when(tokens < 100, "short").otherwise("prose")


def lang_of(lang: Column, langs: tuple[str, ...] = LANGS) -> Column:
    return F.when(lang.isin(*langs), lang).otherwise("other")


def with_classes(docs: DataFrame, langs: tuple[str, ...] = LANGS, topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """(row, source, lang, tokens, topic): the whole row of ``docs`` as a struct, and its classes."""
    text, source, lang = (F.col("row").getField(c) for c in ("text", "source", "lang"))
    text = F.coalesce(text, F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.coalesce(source, F.lit("(none)")).alias("source"), lang_of(lang, langs).alias("lang"), tokens_of(text).alias("tokens"))
    return rows.withColumn("topic", topic(text, F.col("tokens")))


def _shares(mass: list[float], flatten: float, given: Mapping[str, float] | None, names: tuple[str, ...]) -> list[float]:
    powers = [0.0 if m <= 0 else m**flatten if given is None else given.get(name, 0.0) for name, m in zip(names, mass, strict=True)]
    total = sum(powers) or 1.0
    return [p / total for p in powers]


def _factor(b: list[float], c: list[float]) -> Column:
    """a[source] from its ``own`` tokens, its target ``want`` and its cells ``m`` (languages x topics, in order): the least with which
    the sum of m * min(1, a * b * c) is the target. That sum is the least of the lines that keep the cells of largest
    b * c whole, so a is the largest of the lines' solutions."""
    cells = F.array_sort(F.zip_with(F.lit([x * y for x in b for y in c]), "m", lambda q, m: F.struct(q.alias("q"), m.alias("m"))))
    short = F.col("want") - F.col("own")

    def step(x: Column, y: Column) -> Column:
        free, slope = x["free"] + y["m"], x["slope"] + y["m"] * y["q"]
        return F.struct(free.alias("free"), slope.alias("slope"), F.greatest(x["a"], F.when(slope > 0, (short + free) / slope).otherwise(0.0)).alias("a"))

    start = F.struct(F.lit(0.0).alias("free"), F.lit(0.0).alias("slope"), F.lit(0.0).alias("a"))
    return F.when(F.col("own") > 0, F.aggregate(cells, start, step, lambda x: x["a"]))


def _within(shares: list[float], mass: list[float], asked: float) -> list[float]:
    """Targets of ``asked`` tokens in all by ``shares``; a class gets all it has at most, the others the rest in proportion."""
    out, free = [0.0] * len(mass), [i for i, s in enumerate(shares) if s > 0]
    while free:
        left, total = asked - sum(out), sum(shares[i] for i in free)
        over = [i for i in free if left * shares[i] / total > mass[i]]
        for i in over or free:
            out[i] = mass[i] if over else left * shares[i] / total
        free = [i for i in free if i not in over] if over else []
    return out


def _source_targets(cells: DataFrame, target: Target, asked: float) -> DataFrame:
    """``cells`` with each source's target ``want``: min(own, scale * power), where the scale makes them sum to ``asked``. The sources
    that are kept whole only grow in number, so few rounds of one sum each find it."""
    if target.sources is None:
        power = F.pow("own", F.lit(target.source_flatten))
    else:
        power = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for name, share in target.sources.items() for x in (name, float(share))]), F.col("source")), F.lit(0.0))
    power = F.when(F.col("own") > 0, power).otherwise(0.0)
    scale = 0.0
    while True:
        whole = F.lit(scale) * power > F.col("own")
        row = cells.agg(F.sum(F.when(whole, F.col("own")).otherwise(0.0)), F.sum(F.when(whole, 0.0).otherwise(power))).collect()[0]
        new = (asked - row[0]) / row[1] if row[1] else scale
        if new <= scale * (1 + 1e-12):
            return cells.withColumn("want", F.least("own", F.lit(scale) * power))
        scale = new


@dataclass(frozen=True)
class Fit:
    """Factors by language and topic; ``sources``: (source, own, m, want). ``error``: the margins' largest miss, as a share of what is
    asked for, at the last round."""

    b: list[float]
    c: list[float]
    sources: DataFrame
    rounds: int
    error: float


def fitted(cells: DataFrame, langs: tuple[str, ...], topics: tuple[str, ...], target: Target) -> Fit:
    """The factors for ``cells``: a row a source (source, own, m)."""
    L, T = range(len(langs)), range(len(topics))
    n, w = len(langs) * len(topics), len(topics)
    mass = [x or 0.0 for x in cells.agg(*[F.sum(F.col("m")[i]) for i in range(n)]).collect()[0]]
    b, c, asked = [1.0] * len(langs), [1.0] * len(topics), min(1.0, target.share) * sum(mass)
    if not asked:
        return Fit(b, c, cells.withColumn("want", F.lit(0.0)), 0, 0.0)
    of_lang, of_topic = [sum(mass[i * w + j] for j in T) for i in L], [sum(mass[i * w + j] for i in L) for j in T]
    to_lang = _within(_shares(of_lang, target.lang_flatten, target.langs, langs), of_lang, asked)
    to_topic = _within(_shares(of_topic, target.topic_flatten, target.topics, topics), of_topic, asked)
    sources = _source_targets(cells, target, asked)

    def moved(x: float, to: float, whole: float, free: float) -> float:
        """A factor that brings whole + factor * free to its target; halved where the whole cells alone are above it."""
        if not to:
            return 0.0
        if not free and whole <= to:
            return x
        return (to - whole) / free if free and to > whole else x / 2

    error, rounds = 1.0, 0
    while rounds < ROUNDS:
        rounds += 1
        bc = [x * y for x in b for y in c]
        # Cells as rows and factors as arrays: a round's plan is small, and its code the same as that of the round before.
        cell = F.zip_with("m", F.lit(bc), lambda m, q: F.struct(m.alias("m"), (q * F.col("a")).alias("q")))
        each = sources.select("m", _factor(b, c).alias("a")).select("a", F.posexplode(cell).alias("i", "cell"))
        m, over = F.col("cell.m"), F.col("cell.q") >= 1
        sums = each.groupBy("i").agg(F.sum(F.when(over, m)).alias("whole"), F.sum(F.when(~over, F.col("a") * m)).alias("free")).collect()
        whole, free = ([next((r[k] or 0.0 for r in sums if r["i"] == i), 0.0) for i in range(n)] for k in ("whole", "free"))
        kept = [whole[i] + free[i] * bc[i] for i in range(n)]
        misses = [sum(kept[i * w + j] for j in T) - to_lang[i] for i in L] + [sum(kept[i * w + j] for i in L) - to_topic[j] for j in T]
        error = max(map(abs, misses)) / asked
        if error <= TOLERANCE:
            break
        b = [moved(b[i], to_lang[i], sum(whole[i * w + j] for j in T), sum(free[i * w + j] * c[j] for j in T)) for i in L]
        c = [moved(c[j], to_topic[j], sum(whole[i * w + j] for i in L), sum(free[i * w + j] * b[i] for i in L)) for j in T]
    return Fit(b, c, sources, rounds, error)


def weighted(docs: DataFrame, target: Target, langs: tuple[str, ...], topics: tuple[str, ...], salt: str, topic: Callable[[Column, Column], Column]) -> DataFrame:
    """(row, source, lang, tokens, topic, weight, prob, draw) for each row of ``docs``. Texts are not shuffled unless the sources
    are too many to be broadcast."""
    rows = with_classes(docs, langs, topic)
    in_cell = [(F.col("lang") == x) & (F.col("topic") == y) for x in langs for y in topics]
    sums = rows.groupBy("source").agg(F.array(*[F.coalesce(F.sum(F.when(w, F.col("tokens"))), F.lit(0.0)) for w in in_cell]).alias("m"), F.sum("tokens").alias("own"))
    fit = fitted(durable(sums, "cells"), langs, topics, target)
    factor = fit.sources.select("source", _factor(fit.b, fit.c).alias("a"))
    b_of = F.element_at(F.create_map(*[F.lit(x) for n, v in zip(langs, fit.b, strict=True) for x in (n, v)]), F.col("lang"))
    c_of = F.element_at(F.create_map(*[F.lit(x) for n, v in zip(topics, fit.c, strict=True) for x in (n, v)]), F.col("topic"))
    weight = F.coalesce(F.col("a") * b_of * c_of, F.lit(1.0))
    named = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("row").getField("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("row").getField("text"), F.lit("")))
    draw = F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    out = rows.join(factor, "source", "left")
    return out.withColumn("weight", weight).withColumn("prob", F.least(F.lit(1.0), F.col("weight"))).withColumn("draw", draw)


def mixture(docs: DataFrame, target: Target = Target(), langs: tuple[str, ...] = LANGS, topics: tuple[str, ...] = TOPICS, salt: str = "mix", topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """Per row: doc_id, source, lang, topic, tokens, weight (the factor), prob, draw, sampled."""
    out = weighted(docs.select("doc_id", "text", "source", "lang"), target, langs, topics, salt, topic)
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "source", "lang", "topic", "tokens", "weight", "prob", "draw", (F.col("draw") < F.col("prob")).alias("sampled"))


def sample_mixture(docs: DataFrame, target: Target = Target(), langs: tuple[str, ...] = LANGS, topics: tuple[str, ...] = TOPICS, salt: str = "mix", topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """The sampled rows of ``docs``, all columns."""
    return weighted(docs, target, langs, topics, salt, topic).where("draw < prob").select("row.*")


def margins(docs: DataFrame, target: Target = Target(), langs: tuple[str, ...] = LANGS, topics: tuple[str, ...] = TOPICS, topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """(kind, class, tokens, target, reached): each class's share of the sampled tokens, as asked for and as expected."""
    rows = durable(mixture(docs, target, langs, topics, topic=topic), "mixture")
    parts = []
    for kind, flatten, given in (("source", target.source_flatten, target.sources), ("lang", target.lang_flatten, target.langs), ("topic", target.topic_flatten, target.topics)):
        g = rows.groupBy(F.lit(kind).alias("kind"), F.col(kind).alias("class")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("prob")).alias("kept")).where("tokens > 0")
        power = F.pow("tokens", F.lit(flatten)) if given is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, float(v))]), F.col("class")), F.lit(0.0))
        g = g.withColumn("power", power)
        sums = g.agg(F.sum("power").alias("powers"), F.sum("kept").alias("all_kept"))
        parts.append(g.crossJoin(F.broadcast(sums)).select("kind", "class", "tokens", (F.col("power") / F.col("powers")).alias("target"), (F.col("kept") / F.col("all_kept")).alias("reached")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
