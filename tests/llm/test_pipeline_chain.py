"""The pipeline's five stages against a chain of plain-Python versions."""

import hashlib
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
from test_text_operators import brute_components, brute_kept, words

from freshet.llm.common import durable


def good(text):
    t, w = text or "", words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = len({j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})
    lines = [x for x in t.split("\n") if words(x)]
    chars = sum(map(len, w))
    if len(w) < 10 or 100 * repeat > 20 * len(w) or 10 * sum(c in "#*$%&|<>" for c in t) > len(w):
        return False
    return 100 * (len(lines) - len(set(lines))) <= 50 * len(lines) and 2 * len(w) <= chars <= 20 * len(w) and sum("A" <= c <= "Z" for c in t) <= sum("a" <= c <= "z" for c in t)


def one_of_each(rows):
    """Of each component the row of least doc_id, once."""
    component = {}
    for i, _, c in brute_components(rows):
        if i is not None:
            component[i] = c
    out, seen = [], set()
    for r in rows:
        if r.doc_id is not None and component[r.doc_id] == r.doc_id and r.doc_id not in seen:
            seen.add(r.doc_id)
            out.append(r)
    lost = [r for r in rows if r.doc_id is None]
    for r in lost:  # without an id: kept if like no other
        sets = brute_components([SimpleNamespace(doc_id=j, text=x.text) for j, x in enumerate([r, *[x for x in rows if x is not r]])])
        if all(c != 0 for j, _, c in sets if j != 0):
            out.append(r)
    return out


def kept_probabilities(rows):
    """p = min(1, a * b * c) with all margins at their targets, each factor by bisection, round after round."""
    cell = lambda r: (r.source or "(none)", r.lang if r.lang in ("de", "en", "es", "fr") else "other", topic(r.text or ""))
    mass = defaultdict(float)
    for r in rows:
        mass[cell(r)] += len(words(r.text))
    total = sum(mass.values())
    factor, want = [{}, {}, {}], [{}, {}, {}]
    for k, flatten in enumerate((0.7, 0.7, 0.9)):
        own = defaultdict(float)
        for c, m in mass.items():
            own[c[k]] += m
        whole = set()
        while True:  # a class can't give more than it has
            rest = 0.7 * total - sum(own[x] for x in whole)
            powers = sum(own[x] ** flatten for x in own if x not in whole)
            want[k] = {x: own[x] if x in whole else rest * own[x] ** flatten / powers for x in own}
            more = {x for x in own if want[k][x] > own[x]}
            if not more:
                break
            whole |= more
        factor[k] = dict.fromkeys(own, 1.0)
    p = lambda c: factor[0][c[0]] * factor[1][c[1]] * factor[2][c[2]]
    for _ in range(300):
        for k in range(3):
            for x in factor[k]:
                mine = [(m, p(c) / factor[k][x]) for c, m in mass.items() if c[k] == x and m]
                lo, hi = 0.0, 1e9
                for _ in range(100):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if sum(m * min(1, q * mid) for m, q in mine) < want[k][x] else (lo, mid)
                factor[k][x] = max(hi, 1e-300)
    return {id(r): min(1.0, p(cell(r))) for r in rows}


def topic(text):
    return "contact" if "@" in text or "://" in text else "licence" if "License" in text else "short" if len(words(text)) < 100 else "prose"


def draw(r):
    named = f"mix:{'' if r.doc_id is None else r.doc_id}:{r.text or ''}"
    return int(hashlib.md5(named.encode()).hexdigest()[:12], 16) / 2**48


def test_stages_equal_a_plain_chain(spark, docs):
    import corpus_pipeline as c
    import public_tokenizers
    from tokenizers import Tokenizer

    key = lambda r: (str(r.doc_id), r.text or "")
    rows = docs.collect()
    after = {"quality_rules": [r for r in rows if good(r.text)]}
    after["near_duplicates"] = one_of_each(after["quality_rules"])
    cut = [SimpleNamespace(**r.asDict()) for r in after["near_duplicates"]]
    for r, k in zip(cut, brute_kept(cut), strict=True):
        r.text = k[5].decode("utf-8", "ignore")
    after["repeated_passages"] = [r for r in cut if r.text.strip()]
    p = kept_probabilities(after["repeated_passages"])
    assert all(abs(draw(r) - p[id(r)]) > 1e-6 for r in after["repeated_passages"])
    after["mixing"] = [r for r in after["repeated_passages"] if draw(r) < p[id(r)]]
    d = docs
    for name, stage in c.STAGES[:-1]:
        d = durable(stage(spark, d, ""), name)
        assert sorted(map(key, d.collect())) == sorted(map(key, after[name])), name
    assert 10 < len(after["mixing"]) < len(after["repeated_passages"]) < len(after["quality_rules"]) < len(rows)
    own, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for r in after["mixing"]:
        ids = np.array([*own.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, s, zlib.crc32(ids[s : s + 1024].tobytes())) for s in range(0, len(ids), 1024)]
    got = c.STAGES[-1][1](spark, d, "").collect()
    assert sorted([(r.doc_id, r.start, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
