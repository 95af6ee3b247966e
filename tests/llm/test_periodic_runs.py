"""op13: every run against brute force, and the query against a plain version of it."""

import hashlib
import random
import re
import zlib

import numpy as np

from freshet.llm import periodic_runs as pr
from freshet.llm.periodic_runs import periodic_runs, run_report, runs_of_block, with_repeats


def plain_runs(x):
    out, n = [], len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and not any(all(x[k] == x[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def rows_of(seed, count):
    r = random.Random(seed)
    out = []
    for _ in range(count):
        kinds = r.randint(1, 3)
        draw = lambda n: [r.randrange(kinds) for _ in range(n)]  # noqa: E731, B023
        out.append(draw(r.randint(0, 20)) + (draw(r.randint(1, 12)) * 20)[: r.randint(0, 80)] + draw(r.randint(0, 9)) + (draw(r.randint(1, 5)) * 9)[: r.randint(0, 40)])
    return out


def found(rows):
    got = runs_of_block(np.array(sum(rows, []), np.int64), np.cumsum([0, *map(len, rows)]))
    return [got.get(i, []) for i in range(len(rows))]


def test_all_runs_equal_brute_force():
    rows = rows_of(1, 600)
    assert found(rows) == [plain_runs(x) for x in rows]


def test_hashes_that_collide_change_nothing(monkeypatch):
    monkeypatch.setattr(pr, "mix64", lambda x: x & np.uint64(1))  # words look alike by the lowest bit
    rows = rows_of(2, 300)
    assert found(rows) == [plain_runs(x) for x in rows]


def test_splitting_changes_nothing_and_small_blocks_neither(monkeypatch):
    rows = rows_of(3, 200)
    want = [plain_runs(x) for x in rows]
    monkeypatch.setattr(pr, "PAIRS", 7)
    assert found(rows) == want
    monkeypatch.setattr(pr, "ROUNDS", 1)
    assert found(rows) == want


def test_splitting_recurses():
    # 9 occurs four times, but no longer once 8 has split the text; then 7 goes as well
    x = [7, 7, 9, 9, 8, 7, 7, 9, 9, 8, *[1, 2] * 8]
    starts, ends = pr.surviving_segments(np.array(x), np.array([0, len(x)]))
    assert [(int(a), int(b)) for a, b in zip(starts, ends, strict=True)] == [(10, 26)]


def test_query_equals_plain_version(spark, docs):
    extra = [(1000 + i, " ".join("abc"[k] for k in x), None, None, None, 0.1) for i, x in enumerate(rows_of(4, 150))] + [(2000 + i, "ä ß\t\né " * 30 + "end\x0b\x0c" * i, None, None, None, 0.1) for i in range(40)]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = sorted((tuple(r) for r in run_report(with_repeats(rows)).collect()), key=repr)
    want = sorted((plain_report(r.doc_id, r.text) for r in rows.select("doc_id", "text").where("length(text) < 20000 or text is null").collect()), key=repr)
    long = {r.doc_id for r in rows.where("length(text) >= 20000").select("doc_id").collect()}
    assert [r for r in got if r[0] not in long] == want
    assert len(got) == rows.count()


def test_very_long_and_empty(spark, docs, empty):
    assert run_report(with_repeats(empty)).count() == 0
    words = [f"w{i}" for i in range(30_000)]
    text = " ".join(words * 5 + ["x"] * 200_000)
    out = periodic_runs(spark.createDataFrame([(None, text), (5, None)], "doc_id long, text string")).collect()
    long = next(r for r in out if r.doc_id is None)
    assert [tuple(r) for r in long.runs] == [(0, 150_000, 30_000), (150_000, 200_000, 1)]
    assert long.collapsed == " ".join([*words, "x"])
    assert next((list(r.runs), r.collapsed) for r in out if r.doc_id == 5) == ([], "")
