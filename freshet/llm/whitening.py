"""Embedding whitening by spectral divide and conquer.

Entries c become whole numbers, floor(1024 * c) + 100000, so that counts and sums over all vectors are exact. One pass adds up the
dimensions, a second one the centred products: both are sums by task and then by place, and only a table of the size of the
covariance goes to the driver. There the covariance V is taken apart: the polar factor U of V - s, found by the dynamically
weighted Halley iteration (QDWH), has +1 for each eigenvalue over the shift s and -1 for each below, so (U + 1) / 2 projects on the
subspace over s. V is compressed to both subspaces and each is split again, until all are lines: the principal components. Their
directions are broadcast (dimensions x components), and a pass over the rows projects them.

Defined results: vectors that are null or hold null, NaN or infinite entries are dropped; shorter vectors, empty ones too, count as
padded with zeros to the longest; entries beyond 2**40 count as at that bound; ties and repeated rows count each; a component
without variance has null ``whitened`` values; ``deviation`` is null where it needs more than 64 bits; without any variance ``explained`` is null; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

SCALE, SHIFT, MOST = 1024.0, 100_000, float(1 << 40)
#: Rows whose products are added at once.
ROWS = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that are not null and hold only finite entries."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(fine)


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors as whole numbers, a row each."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == dims).all():
        x = flat.reshape(len(lengths), dims)
    else:
        x = np.zeros((len(lengths), dims))
        x[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return np.floor(SCALE * np.clip(x, -MOST / SCALE, MOST / SCALE)).astype(np.int64) + SHIFT


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n * x - S) / n, the numerator exact where it fits in 64 bits."""
    if n * (MOST + SHIFT) < 2.0**62:
        return (n * x - sums) / n
    return x - np.array([int(s) / n for s in sums])


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix, by the dynamically weighted Halley iteration in its QR form."""
    d = len(a)
    norm = float(np.sqrt(np.linalg.norm(a, 1) * np.linalg.norm(a, np.inf)))
    if not norm:
        return np.eye(d)
    x, low, eye = a / norm, 1e-16, np.eye(d)
    for _ in range(30):
        l2 = low * low
        c0 = np.cbrt(4 * (1 - l2) / (l2 * l2)) if low < 1 else 0.0
        r = np.sqrt(1 + c0)
        wa = r + 0.5 * np.sqrt(max(0.0, 8 - 4 * c0 + 8 * (2 - l2) / (l2 * r)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:d] @ q[d:].T
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        moved = np.linalg.norm(new - x)
        x = new
        if moved < 1e-14 * np.sqrt(d) or (low > 1 - 1e-15 and moved < 1e-10):
            break
    return x


def _split(a: np.ndarray, seed: int) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the subspace over a shift, and their number; none where all eigenvalues are equal."""
    d = len(a)
    diagonal = np.sort(np.diag(a))
    for shift in (np.median(diagonal), np.trace(a) / d, *(diagonal[:-1] + diagonal[1:]) / 2):
        u = polar_factor(a - shift * np.eye(d))
        projector = (u + np.eye(d)) / 2
        rank = round(float(np.trace(projector)))
        if 0 < rank < d:
            basis = projector @ np.random.default_rng(seed).standard_normal((d, rank))
            for _ in range(2):
                basis = projector @ np.linalg.qr(basis)[0]
            q, _ = np.linalg.qr(np.hstack([basis, np.eye(d)]))
            return q, rank
    return None


def principal_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling eigenvalue."""
    d, scale = len(v), float(np.linalg.norm(v))
    blocks, values, vectors = [(v, np.eye(d))] if d else [], [], []
    while blocks:
        a, basis = blocks.pop()
        off = a - np.diag(np.diag(a))
        cut = _split(a, len(a)) if len(a) > 1 and np.linalg.norm(off) > 1e-15 * scale else None
        if cut is None:
            values.extend(np.diag(a))
            vectors.extend(basis.T)
            continue
        q, rank = cut
        for part in (q[:, :rank], q[:, rank:]):
            small = part.T @ a @ part
            blocks.append(((small + small.T) / 2, basis @ part))
    if not d:
        return np.zeros(0), np.zeros((0, 0))
    e, x = np.array(values), np.array(vectors).T
    for _ in range(2):  # what the splits have left between components of different size
        m = x.T @ v @ x
        e = np.diag(m).copy()
        gap = e[None, :] - e[:, None]
        turn = np.divide(m, gap, out=np.zeros_like(m), where=(np.abs(gap) > 1e-6 * scale) & (np.abs(m) < 1e-3 * np.abs(gap)))
        np.fill_diagonal(turn, 0)
        q, r = np.linalg.qr(x + x @ turn)
        x = q * np.sign(np.diag(r))
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order]


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray  # of each dimension, whole numbers
    values: np.ndarray  # eigenvalues by size
    components: np.ndarray  # dimensions x dimensions, a column each
    trace: float

    def directions(self, k: int) -> np.ndarray:
        """What a centred vector is multiplied with: components over the root of their eigenvalues; NaN without variance."""
        e = self.values[:k]
        real = e > len(self.values) * np.finfo(float).eps * max(self.trace, 0.0)
        return self.components[:, :k] / np.sqrt(np.where(real, e, np.nan))


def _totals(rows: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sums over all rows of what ``part`` (whole numbers -> a matrix) (size x size) gives for some rows, added by task and then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                y = part(_whole(batch.column(0).slice(lo, ROWS), dims))
                total = y if total is None else total + y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_pydict({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": total.ravel()})

    cells = rows.select("embedding").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((size, size))
    out[cells["i"], cells["j"]] = cells["v"]
    return out


def fit_whitening(vectors: DataFrame) -> Whitening:
    """Counts, sums and components over all usable vectors."""
    rows = usable(vectors)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dims")).first()
    n, dims = int(size["n"]), int(size["dims"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                total = [a + int(b) for a, b in zip(total, _whole(batch.column(0).slice(lo, ROWS), dims).sum(0), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "s": pa.array([str(t) for t in total], pa.string())})

    sums = np.zeros(dims, object)
    by_task = rows.select("embedding").mapInArrow(add, "i int, s string")
    for i, s in by_task.groupBy("i").agg(F.sum(F.col("s").cast(DecimalType(38, 0))).alias("s")).collect():
        sums[i] = int(s)
    if n and max(map(abs, sums), default=0) < 1 << 62:
        sums = sums.astype(np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        y = _deviations(x, n, sums)
        return y.T @ y

    v = _totals(rows, dims, products, dims) / max(n, 1) if dims else np.zeros((0, 0))
    values, components = principal_components((v + v.T) / 2)
    return Whitening(n, sums, values, components, float(np.trace(v)))


def whiten(vectors: DataFrame, model: Whitening, k: int = 8) -> DataFrame:
    """Per usable row: vec_id, deviation and whitened, an array with a number a component (null without variance)."""
    shared = vectors.sparkSession.sparkContext.broadcast((model.n, model.sums, model.directions(k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, to = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                x = _whole(batch.column(1).slice(lo, ROWS), len(sums))
                y = _deviations(x, n, sums)
                white = y @ to
                if sums.dtype == object or n * (MOST + SHIFT) >= 2.0**62:
                    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
                    exact = [e if e < 1 << 63 else None for e in exact]
                else:
                    whole = ((n * x - sums) ** 2).sum(1)
                    about = ((n * y) ** 2).sum(1)
                    exact = [int(e) if f < 2.0**62 else None for e, f in zip(whole, about, strict=True)]
                values = pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), values)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0).slice(lo, ROWS), "deviation": pa.array(exact, pa.int64()), "whitened": lists})

    return usable(vectors).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening, k: int = 8) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, over all usable rows and components with variance."""
    to = model.directions(k)
    to = to[:, ~np.isnan(to).any(0)]
    if not model.n or not to.shape[1]:
        return 0.0
    n, sums, m = model.n, model.sums, to.shape[1]

    def means(x: np.ndarray) -> np.ndarray:
        y = _deviations(x, n, sums) @ to
        return np.diag(y.sum(0))

    rows, dims = usable(vectors), len(model.sums)
    mean = np.diag(_totals(rows, dims, means, m)) / n

    def products(x: np.ndarray) -> np.ndarray:
        y = _deviations(x, n, sums) @ to - mean
        return y.T @ y

    return float(np.abs(_totals(rows, dims, products, m) / n - np.eye(m)).max())


def whitened_components(vectors: DataFrame, k: int = 8) -> DataFrame:
    """Per usable row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    model = fit_whitening(vectors)
    error = identity_error(vectors, model, k)
    count = min(k, len(model.values))
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.values[:count]]
    rows = whiten(vectors, model, k).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(e).cast("double") for e in explained]) if explained else F.array().cast("array<double>")
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
