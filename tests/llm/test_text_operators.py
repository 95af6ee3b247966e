"""Text operators against brute force on a small awkward corpus."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from freshet.llm import jaccard_join, suffix_dedup
from freshet.llm.common import shingle_sets
from freshet.llm.jaccard_join import jaccard_components, keep_one_of_each
from freshet.llm.quality_rules import keep_good, quality_cascade
from freshet.llm.suffix_dedup import LoserTree, decoded, dedup_report, front_coded, sorted_heads, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def test_quality_counts_and_verdict(docs):
    got = sorted(map(tuple, quality_cascade(docs).collect()), key=str)
    want = []
    for d in docs.collect():
        t, w = d.text or "", words(d.text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = len({j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})
        lines = [x for x in t.split("\n") if words(x)]
        dup, sym = len(lines) - len(set(lines)), sum(c in "#*$%&|<>" for c in t)
        chars = sum(map(len, w))
        base = len(w) < 10 or 100 * repeat > 20 * len(w)
        bad = 10 * sym > len(w) or 100 * dup > 50 * len(lines) or not 2 * len(w) <= chars <= 20 * len(w) or sum("A" <= c <= "Z" for c in t) > sum("a" <= c <= "z" for c in t)
        want.append((d.doc_id, len(w), chars, sym, dup, repeat, base, not base and not bad))
    assert got == sorted(want, key=str)


def test_quality_filter_keeps_columns_and_rows(docs, empty):
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality_cascade(docs).where("kept").count()
    assert quality_cascade(empty).count() == 0 and keep_good(empty).count() == 0


def brute_components(rows, links=False):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for d in rows:
        w = words(lower(d.text))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    group, count = list(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                count[i] += 1
                count[j] += 1
                group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for d, g in zip(rows, group):
        if d.doc_id is not None:
            least[g] = min(least.get(g, d.doc_id), d.doc_id)
    out = [(d.doc_id, len(s), None if d.doc_id is None else (least[g] if s else d.doc_id), k) for d, s, g, k in zip(rows, sets, group, count)]
    return sorted([x if links else x[:3] for x in out], key=str)


def links_of(docs):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_components(docs).collect()], key=str)


@pytest.mark.parametrize("short", [16, 2])
def test_jaccard_components(docs, empty, monkeypatch, short):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    assert links_of(docs) == brute_components(docs.collect(), True)
    if short == 16:
        assert jaccard_components(empty).count() == 0


def test_jaccard_long_lists_of_loose_copies(spark):
    """A chain of versions, each near the next only: long lists with several groups must lose no link."""
    r = np.random.default_rng(5)
    words_ = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        rows.append((i, " ".join(words_), "en", "s", 1, 0.0))
        words_ = list(words_)
        for _ in range(int(r.integers(1, 4))):
            words_[int(r.integers(120))] = f"x{i}_{int(r.integers(9))}"
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    assert links_of(df) == brute_components(df.collect(), True)


def test_one_of_each(docs):
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {c for i, _, c in brute_components(docs.collect()) if i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 2


def test_shingles_of_split_blocks():
    text = "a B c d e f g " * 3
    one = [s.tolist() for _, s in shingle_sets(pa.array([text, None, "", text.lower()]))]
    assert one[0] == one[3] and one[1] == one[2] == [] and len(one[0]) == 7


def brute_kept(rows, span=200):
    raw = [(d.text or "").encode() for d in rows]
    count = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for d, b in zip(rows, raw):
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                cover[i : i + span] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        runs = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        out.append((d.doc_id, len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("hot", [50_000, 2])
def test_suffix_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = sorted(map(tuple, dedup_report(docs).collect()), key=str)
    assert got == sorted([x[:5] for x in brute_kept(docs.collect())], key=str)
    if hot > 2:
        assert dedup_report(empty).count() == 0


def test_without_repeats(docs):
    got = without_repeats(docs)
    assert got.columns == docs.columns
    want = sorted(k[5].decode("utf-8", "ignore") for k, d in zip(brute_kept(docs.collect()), docs.collect()) if d.text is not None and (k[2] == 0 or k[5].strip()))
    assert sorted(r.text for r in got.where("text is not null").collect()) == want


def test_front_coding_and_loser_tree():
    r = np.random.default_rng(1)
    all_heads, runs = [], []
    for _ in range(5):
        heads = r.integers(97, 99, (300, suffix_dedup.K)).astype(np.uint8)
        heads[:, 6:] = 97
        all_heads += [h.tobytes() for h in heads]
        h, twice, shared = sorted_heads(heads)
        run = front_coded(h, twice, shared)
        assert [x[0].to_bytes(suffix_dedup.K, "big") for x in decoded(run)] == sorted({x.tobytes() for x in heads})
        runs.append(run)
    merged = [(h.to_bytes(suffix_dedup.K, "big"), s) for h, s, _ in LoserTree([decoded(x) for x in runs])]
    names = [h for h, _ in merged]
    assert names == sorted(names) and set(names) == set(all_heads)
    for (a, _), (b, s) in zip(merged, merged[1:]):
        same = next((i for i in range(suffix_dedup.K) if a[i] != b[i]), suffix_dedup.K)
        assert s == same
    assert zlib.crc32(b"") == 0


def test_equal_windows_by_sorted_suffixes():
    r = np.random.default_rng(4)
    base = r.integers(97, 100, 900).astype(np.uint8).tobytes()
    contents = [base[:400], base[100:420], base[:150] + b"x" + base[151:400], r.integers(97, 100, 300).astype(np.uint8).tobytes(), b"a" * 260]
    with np.errstate(over="ignore"):
        hit, which = suffix_dedup.equal_windows(contents)
    windows = [(i, c[j : j + 200]) for i, c in enumerate(contents) for j in range(len(c) - 199)]
    count = Counter(w for _, w in windows)
    assert which.tolist() == [i for i, _ in windows] and hit.tolist() == [count[w] > 1 for _, w in windows]


@pytest.mark.parametrize("n_chars", ["int", "long", "string"])
def test_repeats_in_long_texts_and_columns_of_any_name(spark, n_chars):
    """Texts over the size of a piece, a passage across two pieces, and columns that clash with all names used inside."""
    r = np.random.default_rng(9)
    letters = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    long, passage = letters(600_000), letters(450)
    cut = suffix_dedup.PIECE - 200
    texts = [long[:cut] + passage + long[cut:], letters(300) + passage + letters(100), "ü" * 150 + letters(40), None, "", letters(700)]
    names = ["row_key", "row_doc", "row_spans", "spans", "head", "freshet_spans"]
    rows = [(i // 2, t, None if t is None or n_chars == "string" else len(t), *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars " + n_chars + "".join(f", {c} string" for c in names))
    if n_chars == "string":
        docs = docs.drop("n_chars")
    got = without_repeats(docs)
    assert got.schema == docs.schema
    want = {b[5].decode("utf-8", "ignore") for b, t in zip(brute_kept(docs.collect()), texts) if t is not None}
    out = got.collect()
    assert {x.text for x in out if x.text is not None} == want and len(out) == len(texts)
    assert all(x.row_key == f"row_key{i}" for i, x in zip((texts.index(t) for t in texts), sorted(out, key=lambda x: x.row_key)))
    if n_chars != "string":
        assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in out)


@pytest.mark.parametrize("block", [5, 40])
def test_jaccard_in_parts_and_blocks(spark, monkeypatch, block):
    """Lists dealt in parts, and groups that meet in blocks: a chain of versions, loose copies of one text, templates that share most
    of their words without linking, and repeated rows."""
    for k, v in {"BLOCK": block, "MEMBERS": block, "PART": 8, "SHORT": 3}.items():
        monkeypatch.setattr(jaccard_join, k, v)
    r = np.random.default_rng(6)
    texts, words_ = [], [f"w{i}" for i in range(90)]
    for i in range(60):
        texts.append(" ".join(words_))
        words_ = list(words_)
        for _ in range(int(r.integers(1, 4))):
            words_[int(r.integers(90))] = f"x{i}_{int(r.integers(9))}"
    base = [f"v{i}" for i in range(120)]
    for i in range(80):
        w = list(base)
        for _ in range(int(r.integers(0, 5))):
            w[int(r.integers(120))] = f"y{int(r.integers(6))}"
        texts.append(" ".join(w))
    template = [f"t{i}" for i in range(40)]
    texts += [" ".join([f"a{i}", f"b{i % 9}", f"c{i}", *template[: 30 + i % 3], f"d{i}"]) for i in range(50)]
    texts += texts[60:70] + texts[::30]
    rows = [(i, t, "en", "s", 1, 0.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(4)
    got, want = links_of(df), brute_components(df.collect(), True)
    assert got == want
    assert max(x[3] for x in want) > 20


def test_blocks_are_entered_up_to_a_position():
    r = np.random.default_rng(3)
    n, m = r.integers(20, 60, 200), np.sort(r.integers(20, 60, 300))
    pos = np.array([r.integers(jaccard_join.prefix(int(x))) for x in n])
    place = np.array([r.integers(jaccard_join.prefix(int(x))) for x in m])
    order = np.lexsort((place, m))
    m, place = m[order], place[order]
    x, y = jaccard_join.pairs_of_block(n, pos, m, place)
    want = {(i, j) for i in range(200) for j in range(300) if 100 * min(n[i], m[j]) >= 80 * max(n[i], m[j]) and min(n[i] - pos[i], m[j] - place[j]) >= jaccard_join.need(n[i], m[j])}
    assert set(zip(x.tolist(), y.tolist())) == want and 0 < len(want) < 60_000


def test_sketches_bound_common_shingles_of_all_sizes():
    r = np.random.default_rng(2)
    pool = r.integers(0, 1 << 63, 60_000).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(r.choice(pool, n)) for n in (3, 200, 599, 650, 5000, 40_000)] + [pool[:500] & np.uint64((1 << 56) - 1), pool[:20_000] & np.uint64((1 << 56) - 1)]
    x, y = map(np.ravel, np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    got = jaccard_join.sketch_bounds([jaccard_join.range_counts(s) for s in sets], x, y)
    common = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)])
    assert (got >= common).all() and (got[x == y] == [len(s) for s in sets]).all()
