"""Exact top-k search by columnar branch and bound.

Vectors are turned to integers, floor(scale * x), and the score is the inner product. Candidates lie in vertical layout, a
column a dimension. A query adds up scores one block of dimensions at a time, the dimensions with most mass first;
after each block a candidate's rest is bounded by the product of the remaining lengths of both vectors
(Cauchy-Schwarz), and candidates whose upper bound is under the k-th best lower bound go.

Rows are dealt to pairs of a query block and a candidate block, so a task holds two blocks at a time, however many
rows there are; each gives its best k, and the best k of those are the answer.

Defined results: vectors that are null, empty or hold null, NaN or infinite components take no part; shorter vectors count
as padded with zeros; ties go to the smaller vec_id (nulls last); equal rows are each other's candidates; an empty
table gives an empty result; extra columns are not read. Scores are exact under 2**53.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK, DIMS = 8192, 4096, 16


def _integers(column: pa.Array, scale: int, width: int = 0) -> np.ndarray:
    lists = column.to_pylist() if len(column) and column.null_count else None
    if lists is None:
        size = np.diff(column.offsets.to_numpy())
        if len(size) and (size == size[0]).all():
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            return np.floor(scale * flat.reshape(len(size), -1))
        lists = column.to_pylist()
    out = np.zeros((len(lists), max([width, *map(len, lists)])))
    for i, x in enumerate(lists):
        out[i, : len(x)] = np.floor(scale * np.asarray(x, np.float64))
    return out


def best_of_block(q: np.ndarray, q_own: np.ndarray, c: np.ndarray, c_own: np.ndarray, c_id: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query index, candidate indexes, scores), best first, of the k best candidates that are not the query's own row."""
    order = np.argsort(-(c * c).sum(0), kind="stable")
    q, c = q[:, order], c[:, order]
    cuts = list(range(0, c.shape[1], DIMS)) + [c.shape[1]]
    rest = lambda x: np.sqrt(np.cumsum((x * x)[:, ::-1], 1)[:, ::-1])
    ends = [e for e in cuts[1:] if e < c.shape[1]]
    q_rest, c_rest = {e: rest(q)[:, e] for e in ends}, {e: rest(c)[:, e] for e in ends}
    columns = [np.ascontiguousarray(c[:, a:b].T) for a, b in zip(cuts, cuts[1:], strict=False)]  # a row a dimension
    for lo in range(0, len(q), 256):
        first = q[lo : lo + 256, : cuts[1]] @ columns[0]
        for i in range(lo, min(lo + 256, len(q))):
            live, score = np.flatnonzero(c_own != q_own[i]), first[i - lo]
            score = score[live]
            for j, end in enumerate(cuts[1:]):
                if j:
                    score = score + q[i, cuts[j] : end] @ columns[j][:, live]
                if len(live) > k and end < c.shape[1]:
                    slack = c_rest[end][live] * q_rest[end][i] + 1e-6
                    bound = score - slack
                    stay = score + slack >= np.partition(bound, len(bound) - k)[len(bound) - k]
                    live, score = live[stay], score[stay]
            if len(live) > k:
                stay = score >= np.partition(score, len(score) - k)[len(score) - k]
                live, score = live[stay], score[stay]
            best = np.lexsort((c_id[live], -score))[:k]
            yield i, live[best], score[best]


def exact_topk(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k best of all other rows for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(good).withColumn("own", F.monotonically_increasing_id())
    n = vectors.count()
    q_blocks, c_blocks = max(1, -(-n // (every * query_block))), max(1, -(-n // candidate_block))
    in_q, in_c = F.pmod(F.xxhash64(F.lit("q"), "own"), F.lit(q_blocks)).cast("int"), F.pmod(F.xxhash64(F.lit("c"), "own"), F.lit(c_blocks)).cast("int")
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.where(F.col("vec_id") % every == 0).withColumns({"qb": in_q}).withColumn("cb", numbers(c_blocks)).withColumn("asks", F.lit(True))
    against = rows.withColumns({"cb": in_c}).withColumn("qb", numbers(q_blocks)).withColumn("asks", F.lit(False))
    columns = ["qb", "cb", "asks", "own", "vec_id", "embedding"]

    def search(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asks = table["asks"].combine_chunks()
        own, ids, emb = table["own"].to_numpy(), table["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy(), table["embedding"].combine_chunks()
        x = _integers(emb, scale)
        is_q = asks.to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        c_own, c_id, q_own, q_id = own[~is_q], ids[~is_q], own[is_q], ids[is_q]
        for i, at, score in best_of_block(x[is_q], q_own, x[~is_q], c_own, c_id, k):
            out.append((np.full(len(at), q_own[i]), np.full(len(at), q_id[i]), c_id[at], score.astype(np.int64)))
        cols = [np.concatenate(v) for v in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("own", "query_id", "vec_id", "score"), cols, strict=True)))

    both = queries.select(columns).unionByName(against.select(columns))
    found = both.groupBy("qb", "cb").applyInArrow(search, "own long, query_id long, vec_id long, score long")
    w = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", F.when(F.col("vec_id") != np.iinfo(np.int64).max, F.col("vec_id")).alias("vec_id"), "score")
