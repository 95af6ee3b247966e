"""Models and the ring re-done in plain Python, value by value."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
import zstandard

from freshet.llm import language_id, quality_classifier
from freshet.llm.language_id import identify_language
from freshet.llm.quality_classifier import labelled_sample, quality_scores
from freshet.llm.ring_sharding import CELLS, shard_documents


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def grams(text):
    """Counts of hashed 1- to 3-grams, character by character."""
    points = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else (ord(c) if c.isalpha() else 32) for c in text or ""]
    out, word = {}, (1 << 32) - 1
    for i in range(len(points)):
        h = 0
        for n, m in enumerate((2654435761, 2246822519, 3266489917)):
            if i + n < len(points):
                h = (h + points[i + n] * m) & word
                x = ((h ^ (h >> 15)) * (2246822507 + 2 * n)) & word
                k = x >> (32 - language_id.BITS)
                out[k] = out.get(k, 0) + 1
    return out


def brute_languages(rows):
    """doc_id and text -> (language, score), by FTRL a coordinate at a time."""
    known = [r for r in rows if not held_out(r.doc_id) and r.lang is not None]
    have = {}
    for r in known:
        for k in grams(r.text):
            have[k] = have.get(k, 0) + 1
    idf = lambda k: math.log((1 + len(known)) / (1 + have.get(k, 0))) + 1
    learn = sorted(known, key=lambda r: (r.doc_id, r.text or ""))
    langs = sorted({r.lang for r in learn})
    xs = []
    for r in learn:
        g = grams(r.text)
        total = max(1, sum(g.values()))
        xs.append({k: 100 * c / total * idf(k) for k, c in g.items()})
    order = np.random.default_rng(5).permutation(len(learn))
    aside, train = order[: len(order) // 5], order[len(order) // 5 :]
    z, n = [{} for _ in langs], [{} for _ in langs]
    A, B, L1, L2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2

    def weight(c, k):
        v = z[c].get(k, 0.0)
        return 0.0 if abs(v) <= L1 else -(v - math.copysign(L1, v)) / ((B + math.sqrt(n[c].get(k, 0.0))) / A + L2)

    def softmax(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    for _ in range(language_id.EPOCHS):
        for i in train:
            x = xs[i] | {"bias": 1.0}
            w = [{k: weight(c, k) for k in x} for c in range(len(langs))]
            p = softmax([sum(v * w[c][k] for k, v in x.items()) for c in range(len(langs))])
            for c in range(len(langs)):
                g = p[c] - (langs[c] == learn[i].lang)
                for k, v in x.items():
                    old = n[c].get(k, 0.0)
                    z[c][k] = z[c].get(k, 0.0) + g * v - (math.sqrt(old + (g * v) ** 2) - math.sqrt(old)) / A * w[c][k]
                    n[c][k] = old + (g * v) ** 2
    final = [{k: weight(c, k) for k in z[c]} for c in range(len(langs))]
    logits = lambda x: [sum(v * f.get(k, 0.0) for k, v in x.items()) + f.get("bias", 0.0) for f in final]
    count = {x: sum(r.lang == x for r in known) for x in langs}
    sampled = {x: sum(r.lang == x for r in learn) for x in langs}
    stand = [count[learn[i].lang] / sampled[learn[i].lang] for i in aside]
    best, least = 1.0, float("inf")
    for t in np.exp(np.linspace(-2, 2, 81)):
        loss = 0.01 * math.log(t) ** 2
        for i, s in zip(aside, stand, strict=True):
            loss -= s * len(stand) / sum(stand) * math.log(max(softmax([v / t for v in logits(xs[i])])[langs.index(learn[i].lang)], 1e-12))
        if loss < least:
            best, least = t, loss
    out = []
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            out.append((r.doc_id, "und", 1.0))
            continue
        g = grams(r.text)
        total = sum(g.values())
        p = softmax([v / best for v in logits({k: 100 * c / total * idf(k) for k, c in g.items()})])
        out.append((r.doc_id, langs[int(np.argmax(p))], max(p)))
    return out


def test_languages_equal_plain_python(docs):
    rows = [r for r in docs.collect() if len(r.text or "") < 5000]
    small = docs.sparkSession.createDataFrame(rows, docs.schema)
    key = lambda x: (str(x[0]), x[1], round(x[2], 3))
    got = sorted([(r.doc_id, r.lang_pred, r.score) for r in identify_language(small).collect()], key=key)
    want = sorted(brute_languages(rows), key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-4)


def test_many_languages_are_all_learned(spark):
    """More languages than any list holds: 210 with an alphabet of two letters each."""
    letters = [chr(0x4E00 + i) for i in range(420)]
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(letters[2 * k : 2 * k + 2]) * 3 for _ in range(12)), f"l{k:03}") for i, k in enumerate(k for k in range(210) for _ in range(4))]
    got = identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: k for i, _, k in rows}
    assert len({x.lang_pred for x in got}) > 200
    assert np.mean([truth[x.doc_id] == x.lang_pred for x in got]) > 0.9


def test_ring_equals_plain_python(docs):
    """Cells by the hash of the key, virtual nodes by MD5, bounds of equal size; overflow goes clockwise."""
    shards, rows = 8, []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for d in docs.collect():
        raw = (d.text or "").encode()
        crc = zlib.crc32(raw)
        h = signed(xxhash.xxh64((crc if d.doc_id is None else d.doc_id).to_bytes(8, "little", signed=True), seed=42).intdigest())
        rows.append((h % CELLS, h, d.doc_id is not None, d.doc_id or 0, crc, len(raw) + 1, d.doc_id))
    nodes = {}
    for k in range(64):
        for s in range(shards):
            cell = int.from_bytes(hashlib.md5(f"{s}:{k}".encode()).digest()[:4], "big") % CELLS
            while cell in nodes:
                cell = (cell + 1) % CELLS
            nodes[cell] = s
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    filled = [[] for _ in range(shards)]
    walk = lambda cell, start: ((cell + j) % CELLS for j in range(start, 3 * CELLS))
    over = []
    for row in sorted(rows):
        home = nodes[next(c for c in walk(row[0], 0) if c in nodes)]
        (filled[home] if len(filled[home]) < room[home] else over).append(row)
    for row in over:
        ring = [nodes[c] for c in walk(row[0], 0) if c in nodes]
        filled[next(s for s in ring if len(filled[s]) < room[s])].append(row)
    want = sorted([(row[6], row[5], row[4], s, slot) for s, f in enumerate(filled) for slot, row in enumerate(f)], key=str)
    got = sorted([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shard_documents(docs).collect()], key=str)
    assert got == want


@pytest.mark.parametrize("rows", [5000, 40003])
def test_one_more_shard_moves_few_keys(spark, rows):
    """Movement of the whole operator: rows that change their shard when a ninth is added; it takes a ninth of them at least."""
    docs = spark.range(rows).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    a = shard_documents(docs, 8).select("doc_id", "shard")
    b = shard_documents(docs, 9).selectExpr("doc_id", "shard AS new")
    moved = a.join(b, "doc_id").where("shard <> new").count()
    assert rows / 9 - 1 <= moved < 0.45 * rows  # bounds without slack cost more than the ring alone


def quality_corpus(spark, n=900):
    r = random.Random(6)
    good, bad = ["the", "river", "gauge", "shows", "steady", "flow", "over", "winter"], ["click", "here", "$$$", "win", "BUY", "now", "###", "free"]
    rows = []
    for i in range(n):
        q = int(r.random() < 0.7)
        mix = 0.75 if q else 0.3
        rows.append((i, " ".join(r.choice(good if r.random() < mix else bad) for _ in range(r.randint(20, 400))), q))
    docs = spark.createDataFrame([x[:2] for x in rows] + [(n, None), (n + 1, "")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"), rows


def test_quality_scores_equal_own_sizes(spark):
    docs, labels, rows = quality_corpus(spark)
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    model = quality_classifier.fit(*labelled_sample(docs, labels))
    kinds = {True: zstandard.DICT_TYPE_FULLDICT, False: zstandard.DICT_TYPE_RAWCONTENT}
    for i, text in [x[:2] for x in rows[:200]] + [(len(rows), ""), (len(rows) + 1, "")]:
        raw, size = text.encode(), {}
        for name, data in (("good", model.good), ("bad", model.bad)):
            d = zstandard.ZstdCompressionDict(data, dict_type=kinds[data[:4] == b"\x37\xa4\x30\xec"])
            size[name] = sum(len(zstandard.ZstdCompressor(level=1, dict_data=d, write_content_size=False).compress(raw[j : j + 512])) for j in range(0, max(1, len(raw)), 512))
        x = (size["bad"] - size["good"]) / (size["bad"] + size["good"])
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(model.bias + model.slope * x))), abs=1e-9)
    assert model.slope > 0  # better with the good dictionary: likelier good
    truth = {i: q for i, _, q in rows}
    held = [(r.score, truth[i]) for i, r in got.items() if r.held_out and i in truth]
    a, b = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([x > y for x in a for y in b]) > 0.95  # area under the curve, on rows that nothing was learned from
    assert np.mean([(s >= 0.3) == bool(q) for s, q in held]) > 0.85
    assert abs(np.mean([s for s, _ in held]) - np.mean([q for _, q in held])) < 0.08
