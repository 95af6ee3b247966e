"""Models, sampling, sharding, search, chat formatting, packing and the pipeline."""

import json
import zlib

import numpy as np
import pytest

from freshet.llm import tool_calls
from freshet.llm.exact_topk import exact_topk
from freshet.llm.language_id import identify_language
from freshet.llm.mixing import Target, mixture, sample_mixture
from freshet.llm.packing import WINDOW, encoder, pack_documents, packing_plan
from freshet.llm.quality_classifier import quality_scores
from freshet.llm.ring_sharding import ring_plan, shard_documents, virtual_nodes


def test_language(docs, empty):
    rows = {(r.doc_id, r.lang_pred, r.score, r.held_out) for r in identify_language(docs).collect()}
    truth = {d.doc_id: d.lang for d in docs.collect()}
    assert len(identify_language(docs).collect()) == docs.count()
    held = [(truth[i], p) for i, p, _, h in rows if h and i is not None and i < 86]
    assert held and np.mean([a == b for a, b in held]) >= 0.9
    by_id = {i: p for i, p, _, _ in rows}
    assert all(by_id[i] == "und" for i in (86, 87, 88, 91))
    assert all(0 <= s <= 1 for _, _, s, _ in rows)
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _, h in rows if i is not None)
    assert identify_language(empty).count() == 0


def test_quality_classifier(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i not in (93, 94)), 0) for i in range(95)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality_scores(empty, labels).count() == 0
    lone = quality_scores(docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in lone}) == 1


def test_mixture_meets_targets(docs, empty):
    target = Target(source_flatten=0.3, lang_flatten=0.5, topic_flatten=1.0, share=0.001)
    rows = mixture(docs, target).toPandas()
    rows["w"] = rows.tokens * rows.weight
    assert (rows.weight[rows.tokens > 0] <= 1).all()  # nothing is capped, so the shares are exact
    for c, flatten in (("source", 0.3), ("lang", 0.5), ("topic", 1.0)):
        mass = rows.groupby(c).tokens.sum()
        mass = mass[mass > 0]
        want = mass**flatten / (mass**flatten).sum()
        got = rows.groupby(c).w.sum()[mass.index] / rows.w.sum()
        assert np.allclose(got, want, atol=2e-3), c
    assert np.isclose(rows.w.sum(), 0.001 * rows.tokens.sum(), rtol=1e-6)
    kept = sample_mixture(docs)
    assert kept.columns == docs.columns and kept.count() == mixture(docs).where("sampled").count()
    assert mixture(empty).count() == 0


def test_ring(docs, empty):
    rows = shard_documents(docs).toPandas()
    n = docs.count()
    counts = rows.groupby("shard").size()
    assert len(rows) == n and counts.max() - counts.min() <= 1
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    texts = {d.doc_id: (d.text or "").encode() for d in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r["size"] == len(texts[r.doc_id]) + 1 for _, r in rows.iterrows() if r.doc_id == r.doc_id)
    assert rows.moved.mean() < 0.5
    assert shard_documents(empty).count() == 0


def test_ring_plan_moves_only_overflow():
    counts = {c: 1 + c % 7 for c in range(0, 4096, 3)}
    plan = ring_plan(counts, 8)
    per = np.zeros(8, int)
    for _, lo, hi, shard, base, _ in plan:
        assert base == per[shard]
        per[shard] += hi - lo
    assert per.max() - per.min() <= 1 and per.sum() == sum(counts.values())
    assert all(sum(h - lo for c, lo, h, *_ in plan if c == cell) == counts[cell] for cell in list(counts)[:20])
    a, b = virtual_nodes(8), virtual_nodes(9)
    assert sum(b.get(c) == s for c, s in a.items()) > 0.9 * len(a)


def test_topk(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 40)).round(1)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(300)]
    rows += [(20, None, 0), (40, [], 0), (60, [1.0, None], 0), (80, [float("nan")] * 40, 0), (100, [float("inf")] * 40, 0), (301, rows[0][1], 1), (301, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for q in exact_topk(df, candidate_block=70, query_block=8).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    good = rows[:300] + rows[-2:]
    v = np.floor(64 * np.array([e for _, e, _ in good])).astype(int)
    ids = np.array([i for i, _, _ in good])
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        assert got[ids[i]] == [(k + 1, ids[j], s[j]) for k, j in enumerate(best)]
    assert len(got) == 15
    few = spark.createDataFrame(rows[:3], df.schema)
    assert exact_topk(few).count() == 2
    assert exact_topk(spark.createDataFrame([], df.schema)).count() == 0


def test_chat_linking(spark):
    call = lambda c, t, i, n, a: (c, t, i, n, a)
    calls = spark.createDataFrame(
        [
            call(1, 1, "a", "search", '{"limit": 3, "query": "x"}'), call(1, 3, "b", "search", '{"query": 5}'), call(1, 5, "c", "nope", "{}"), call(1, 7, "d", "summarise", "broken"),
            call(2, 1, "a", "search", '[1]'), call(2, 2, "x", "summarise", '{"words": 1, "text": "t", "b": {"z": 1, "a": [2]}}'), call(2, 3, "y", "search", None), call(3, 1, "r", "search", "{}"), call(3, 1, "r", "search", "{}"), call(None, 1, None, None, None),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string",
    )
    results = spark.createDataFrame([(1, 2, "a", "late"), (1, 2, "a", "early"), (1, 9, "zz", "lost"), (3, 2, "r", None), (None, 1, None, "q")], "conv_id long, turn long, call_id string, content string")
    refs = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "d", "c"), (1, "d", "a"), (2, "x", "y"), (2, "y", "x"), (2, "a", "none")], "conv_id long, call_id string, ref string")
    for edges in (refs, refs.where("not (call_id = 'd' and ref = 'a')")):
        rows = {(r.conv_id, r.call_id): r for r in tool_calls.link_tool_calls(calls, results, edges, tool_calls.TOOLS).collect()}
        assert [rows[1, c].level for c in "abcd"] == [0, 1, 2, 3]
        assert rows[2, "x"].level is None and rows[2, "y"].level is None and rows[2, "a"].level == 0
    assert rows[1, "a"].status == "linked" and rows[1, "a"].n_results == 2 and json.loads(rows[1, "a"].line)["result"]["content"] == "early"
    assert rows[1, "a"].valid and rows[1, "a"].line.startswith('{"arguments":{"limit":3,"query":"x"},"id":"a"')
    assert rows[1, "b"].errors == "query: not string; limit: missing" and rows[1, "c"].errors == "unknown tool" and rows[1, "d"].errors == "not JSON"
    assert rows[2, "a"].errors == "not an object" and rows[2, "x"].errors == "b: unexpected" and '"b":{"a":[2],"z":1}' in rows[2, "x"].line
    assert rows[1, "zz"].status == "orphan" and rows[3, "r"].id_repeated
    none = calls.limit(0)
    assert tool_calls.link_tool_calls(none, results.limit(0), refs.limit(0), tool_calls.TOOLS).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack_documents(docs).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= WINDOW
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()
    want = []
    for d in docs.collect():
        ids = np.array([*own.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d.doc_id, s, len(p := ids[s : s + WINDOW]), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), WINDOW)]
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows.itertuples()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pack_documents(empty).count() == 0


def test_encoder_takes_special_strings_and_odd_text():
    from tokenizers import Tokenizer

    import public_tokenizers

    own, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder()
    for t in ("", "a <|endoftext|> b", "  \n\n x", "don't naïve 12345 😀", "x" * 500, " " * 300 + "y"):
        assert encode(t).tolist() == own.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", [0, 1])
def test_packing_plan_uses_all_and_fills_well(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(257, int)
    for x in r.gamma(2, 40, 5000).astype(int):
        counts[min(255, max(1, x))] += 1
    plan = packing_plan(counts, 256)
    used, sequences = np.zeros(257, int), 0
    for members, repeats in plan:
        assert sum(a * m for a, m in members) <= 256
        sequences += repeats
        for a, m in members:
            used[a] += m * repeats
    assert (used == counts).all()
    assert (np.arange(257) * counts).sum() / (256 * sequences) > 0.97
    assert packing_plan(np.zeros(257, int), 256) == []


def test_pipeline_stages(spark, docs, empty):
    import corpus_pipeline as c

    from freshet.llm.common import durable

    for start in (docs, empty):
        d, names = start, start.columns
        for name, stage in c.STAGES:
            before = d.count()
            d = durable(stage(spark, d, ""), name)
            if name != "packing":
                assert d.columns == names and d.count() <= before
        assert set(d.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
