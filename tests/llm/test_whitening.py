"""op11: against a plain eigendecomposition, with awkward vectors and exact sums."""

import math

import numpy as np
import pytest

from freshet.llm.whitening import fit_whitening, polar_factor, principal_components, whitened_components

SCHEMA = "vec_id long, embedding array<float>, label int, doc_id string"


def rows_of(seed=4, n=300, d=12):
    r = np.random.default_rng(seed)
    x = (r.standard_normal((n, d)) * np.exp(r.standard_normal(d)) + r.standard_normal(d)) @ r.standard_normal((d, d))
    rows = [(i, [float(c) for c in v], i % 3, "x") for i, v in enumerate(x.astype(np.float32))]
    rows += [(n, None, 0, "x"), (n + 1, [1.0, None] * (d // 2), 0, "x"), (n + 2, [math.nan] * d, 0, "x"), (n + 3, [math.inf] * d, 0, "x"), (n + 4, [0.5] * (d - 3), 0, "x"), (n + 5, [], 0, "x"), (None, rows[0][1], 0, "x"), rows[3], rows[3]]
    return rows


def plain(rows, d, k=8):
    good = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in [*v, *[0.0] * (d - len(v))]] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    y = np.array([[(n * c - t) / n for c, t in zip(r, s, strict=True)] for r in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    return good, n, deviation, y @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_query_equals_plain_version(spark):
    rows = rows_of()
    good, n, deviation, white, share = plain(rows, 12)
    out = whitened_components(spark.createDataFrame(rows, SCHEMA).repartition(5)).toPandas()
    assert list(out.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(out) == 8 * n and set(out["n"]) == {n}
    assert out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9
    want = {i: (dev, w) for (i, _), dev, w in zip(good, deviation, white, strict=True)}
    sign = {}
    for r in out.itertuples():
        key = None if math.isnan(r.vec_id) else int(r.vec_id)
        dev, w = want[key]
        assert r.deviation == dev and abs(r.explained / share[r.component - 1] - 1) < 1e-9
        if abs(w[r.component - 1]) > 1e-3:
            s = sign.setdefault(r.component, np.sign(r.whitened * w[r.component - 1]))
            assert s * r.whitened == pytest.approx(w[r.component - 1], rel=1e-8, abs=1e-9)


def test_one_row_no_rows_and_no_variance(spark):
    assert whitened_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitened_components(spark.createDataFrame([(1, None, 0, "x")], SCHEMA)).count() == 0
    for rows in ([(1, [1.0, 2.0], 0, "x")], [(i, [1.0, 2.0], 0, "x") for i in range(4)]):
        out = whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()
        assert [(r.component, r.deviation, r.whitened, r.explained) for r in out] == [(1, 0, None, None), (2, 0, None, None)] * len(rows)
    flat = whitened_components(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0, "x") for i in range(9)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and flat[0].identity_error < 1e-12
    huge = whitened_components(spark.createDataFrame([(1, [3e38, 1.0], 0, "x"), (2, [-3e38, 1.0], 0, "x")], SCHEMA)).collect()
    assert {(r.component, None if r.whitened is None else round(abs(r.whitened), 6)) for r in huge} == {(1, 1.0), (2, None)}


def test_sums_beyond_64_bits_stay_exact(spark):
    rows = [(i, [2.0**30 * (1 if i else -1), float(i)], 0, "x") for i in range(40)]
    model = fit_whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, doc_id string"))
    assert int(model.sums[0]) == 38 * 2**40 + 40 * 100_000 and model.n == 40


@pytest.mark.parametrize("d", [1, 2, 7, 64])
@pytest.mark.parametrize("kind", ["plain", "steep", "rank one", "zero", "identity", "pairs"])
def test_divide_and_conquer(d, kind):
    r = np.random.default_rng(d)
    a = r.standard_normal((d + 40, d))
    if kind == "steep":
        a = a * np.exp(4 * r.standard_normal(d))
    if kind == "rank one":
        a = np.ones((9, d)) * r.standard_normal((9, 1))
    v = {"zero": np.zeros((d, d)), "identity": np.eye(d)}.get(kind, a.T @ a / len(a))
    if kind == "pairs":
        q, _ = np.linalg.qr(r.standard_normal((d, d)))
        v = q @ np.diag(np.arange(d) // 2 + 1.0) @ q.T
        v = (v + v.T) / 2
    e, x = principal_components(v)
    scale = max(np.linalg.norm(v), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-13 * scale * d
    assert np.linalg.norm(v @ x - x * e) <= 1e-13 * scale * d and np.linalg.norm(x.T @ x - np.eye(d)) < 1e-12 * d


def test_polar_factor_has_signs_of_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((20, 20)))
    e = np.r_[-np.logspace(-9, 3, 9), np.logspace(-9, 3, 11)]
    u = polar_factor((q * e) @ q.T)
    assert np.abs(u - (q * np.sign(e)) @ q.T).max() < 1e-5
